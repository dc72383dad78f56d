import gzip
import hashlib
import uuid

import pytest

from claimtrends.llm import warc
from claimtrends.llm.common import Stages

PAGES = "page_id long, url string, html string, digest string"


def expected(rows):
    first = {}
    for page, _, html, _ in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, _, html, _ in rows:
        body = (html or "").encode()
        low = first.get(html or "")
        again = len(body) >= 100 and low is not None and page != low
        out.append((page, len(body), hashlib.sha256(body).hexdigest(),
                    "revisit" if again else "response", low if again else None))
    return sorted(out, key=str)


ROWS = [
    (5, "http://a", "x" * 100, None), (3, None, "x" * 100, "c"), (9, "u\r\nX: y", "x" * 100, None),
    (3, None, "x" * 100, "c"), (1, "", "x" * 99, None), (2, "b", "x" * 99, None),
    (4, "é", "été\r\n\r\nWARC/1.1\r\n\r\n" * 9000, None), (6, "s", "y" * 65_536, None),
    (7, "s", "z" * 65_537, None), (7, "s", "z" * 65_537, None), (None, "n", "x" * 100, None),
    (None, None, None, None), (10, "e", "", None), (None, "m", "q" * 200_000, None),
    (None, "m", "q" * 200_000, None),
]


@pytest.mark.parametrize("per_archive", [1, 3, 4000])
def test_round_trip(llm, monkeypatch, per_archive):
    pages = llm.createDataFrame(ROWS, PAGES)
    path = Stages(llm, "test").path("archives")
    warc.write_archives(pages, path, per_archive=per_archive)
    whole = warc.read_chunks(llm, path)
    assert whole.selectExpr("max(length(data))").first()[0] == warc.CHUNK
    for chunks in (whole, warc.read_chunks(llm, path, payloads=False)):
        assert sorted(map(tuple, warc.records(chunks).collect()), key=str) == expected(ROWS)
    with pytest.raises(Exception, match="chunk is missing"):
        warc.records(whole.where("not (page_id = 4 and chunk_no = 1)")).collect()
    with pytest.raises(Exception, match="recorded digest"):
        warc.records(whole.where("not (page_id = 4 and chunk_no = 2)")).collect()


def test_empty_table(llm):
    assert warc.round_trip(llm.createDataFrame([], PAGES)).count() == 0


def test_archives_are_plain_warc(llm, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    warc.write_archives(llm.createDataFrame(ROWS[:2], PAGES).coalesce(1), path)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(tmp_path.glob("*/part-*")))
    assert data.count(b"WARC/1.1\r\n") == 2 and data.endswith(b"\r\n\r\n")
    assert b"WARC-Type: revisit\r\n" in data and b"WARC-Refers-To: <urn:page:3:" in data
    packed = memoryview(gzip.compress(data[:700]) + gzip.compress(data[700:]))
    assert len(list(warc.parse(packed))) == 2
    with pytest.raises(ValueError):
        list(warc.parse(memoryview(gzip.compress(data[:-6]))))
