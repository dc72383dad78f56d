"""WARC archives as a chunked record table.

A record is rows of (record id, chunk number, bytes): payloads beyond the chunk size become a
first record and continuation records, as WARC segmentation has it. Spark's text writer puts them
into archives; reading turns each archive back into chunk rows while it is unpacked piece by
piece. A running SHA-256 is carried from chunk to chunk, so that no step ever holds a record.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages

#: Payload bytes of a chunk, chunk records of an archive, and bytes from which copies revisit.
CHUNK, PER_ARCHIVE, LEAST = 65_536, 4_000, 100
#: Fixed values of the format.
VERSION, END = "WARC/1.1", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The tables hold no crawl time.
DATE = "1970-01-01T00:00:00Z"

CHUNKS = (
    "record_id string, chunk_no int, page_id long, record_type string, refers_to long,"
    " payload_bytes long, payload_digest string, data binary"
)


def _record_id(page: Column, digest: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), digest)


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a field whose value is null has none."""
    parts = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in fields]
    return F.concat(F.lit(f"{VERSION}\r\n"), *parts, F.lit("\r\n"))


def typed(pages: DataFrame, stages: Stages) -> DataFrame:
    """page_id, url, payload, length, digest and first: the page a revisit refers to, or null.

    Of equal payloads of at least LEAST bytes the smallest page_id is the response; rows that
    repeat that id are responses too. A null id never is, unless all are null.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select(
        "page_id", "url", payload.alias("payload"), F.octet_length(payload).alias("length"),
        F.sha2(payload, 256).alias("digest"),
    )
    first = own.where(F.col("length") >= LEAST).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    first = stages.save(first.where("n > 1").select("digest", "first"), "first")
    same = F.col("page_id").eqNullSafe(F.col("first"))
    return own.join(first, "digest", "left").withColumn("first", F.when(~same, F.col("first")))


def write_archives(pages: DataFrame, path: str, chunk: int = CHUNK, per_archive: int = PER_ARCHIVE) -> None:
    """Write one WARC record per row of (page_id, url, html) into compressed archives under ``path``.

    Payloads of more than ``chunk`` bytes become a first record and numbered continuations.
    Null html is an empty payload; a null url leaves out the target; other columns are ignored.
    """
    rows = typed(pages, Stages(pages.sparkSession, "warc"))
    revisit = F.col("first").isNotNull()
    size = F.when(revisit, 0).otherwise(F.col("length"))
    count = F.greatest(F.lit(1), F.ceil(size / F.lit(chunk)).cast("int"))
    rows = rows.withColumn("count", count).withColumn(
        "no", F.explode(F.sequence(F.lit(0), F.col("count") - 1))
    )
    data = F.when(revisit, F.lit(b"")).otherwise(
        F.expr(f"substring(payload, no * {chunk} + 1, {chunk})")
    )
    several, head = F.col("count") > 1, F.col("no") == 0
    own = _record_id(F.col("page_id"), F.col("digest"))
    name = F.concat(F.lit("<"), own, F.lit(":"), F.col("no").cast("string"), F.lit(">"))
    header = _lines(
        ("WARC-Type", F.when(~head, "continuation").when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", name),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Profile", F.when(revisit, PROFILE)),
        ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<"), _record_id(F.col("first"), F.col("digest")), F.lit(":0>")))),
        ("WARC-Segment-Number", F.when(several, (F.col("no") + 1).cast("string"))),
        ("WARC-Segment-Origin-ID", F.when(~head, F.concat(F.lit("<"), own, F.lit(":0>")))),
        ("WARC-Segment-Total-Length", F.when(several & (F.col("no") == F.col("count") - 1), F.col("length").cast("string"))),
        ("X-Payload-Length", F.col("length").cast("string")),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.octet_length("data").cast("string")),
    )
    value = F.concat(header.cast("binary"), F.col("data")).cast("string")
    rows.withColumn("data", data).select(value.alias("value")).write.option(
        "lineSep", END
    ).option("compression", "gzip").option("maxRecordsPerFile", per_archive).text(path)


class _Reader:
    """Bytes of a compressed archive, unpacked a piece at a time."""

    def __init__(self, packed: memoryview, piece: int = 262_144):
        self.packed, self.piece, self.at = packed, piece, 0
        self.unpack, self.held = zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        if self.at >= len(self.packed) and not self.unpack.unconsumed_tail:
            return False
        source = self.unpack.unconsumed_tail
        if not source:
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
            source = self.packed[self.at: self.at + self.piece]
            self.at += len(source)
        self.held += self.unpack.decompress(source, self.piece)
        if self.unpack.eof:
            self.at -= len(self.unpack.unused_data)
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (found := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                return None
        out = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("an archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _page(record_id: str) -> int | None:
    page = record_id.split(":")[2]
    return int(page) if page else None


def parse(packed: memoryview) -> Iterator[tuple]:
    """Whether it is all of its record, and a chunk row, for each chunk of an archive in order.

    Raises where the bytes are no WARC record.
    """
    reader, mark = _Reader(packed), END.encode()
    while (head := reader.until(mark)) is not None:
        version, *lines = head.decode().split("\r\n")
        if version != VERSION:
            raise ValueError(f"no WARC record: {version[:40]!r}")
        field = dict(line.split(": ", 1) for line in lines)
        data = reader.exactly(int(field["Content-Length"]))
        if reader.exactly(len(mark)) != mark:
            raise ValueError("a record does not end where its length says")
        own, no = field["WARC-Record-ID"].strip("<>").rsplit(":", 1)
        refers = field.get("WARC-Refers-To")
        yield (
            "WARC-Segment-Number" not in field, own, int(no), _page(own), field["WARC-Type"], _page(refers.strip("<>")) if refers else None,
            int(field["X-Payload-Length"]), field["WARC-Payload-Digest"].removeprefix("sha256:"), data,
        )


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names
    )


def _verified(row: tuple) -> tuple:
    """A record of one chunk without its bytes, once they gave the recorded digest and length."""
    kind, length, digest, data = row[3], *row[5:]
    if kind == "response" and (len(data), hashlib.sha256(data).hexdigest()) != (length, digest):
        raise ValueError(f"page {row[2]}: its bytes do not give the recorded digest")
    return (*row[:-1], None)


def read_chunks(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The chunk rows (CHUNKS) of all archives under ``path``.

    Without ``payloads`` a record of one chunk is verified on the spot and leaves its bytes
    behind; only chunks of longer records carry theirs on.
    """
    names = ["record_id", "chunk_no", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "data"]
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for content in batch.column(0):
                for single, *row in parse(memoryview(content.as_buffer())):
                    rows.append(tuple(row) if payloads or not single else _verified(tuple(row)))
                    held += len(rows[-1][-1] or b"")
                    if held > 4_000_000 or len(rows) >= 2_000:
                        yield _table(rows, names, types)
                        rows, held = [], 0
        if rows:
            yield _table(rows, names, types)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Chunks are sorted by record and number and their digest carried along; a response whose
    bytes do not give the digest and length in its header is an error. Equal rows of the source
    are equal records: each chunk then comes as often, is digested once, and as many rows come
    out. Rows that left their bytes behind are verified already. Revisits have no bytes; theirs
    are the header's.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, running, size, next_no, copies = None, None, 0, 0, 0

        def close() -> list[tuple]:
            if own is None:
                return []
            length, digest, kind = own[3:]
            if kind == "response" and (size, running.hexdigest()) != (length, digest):
                raise ValueError(f"page {own[1]}: its chunks do not give the recorded digest")
            return [(own[1], length, digest, kind, own[2])] * copies

        for batch in batches:
            done = []
            columns = [batch.column(i) for i in range(7)]
            for i, (rid, no, page, kind, refers, length, digest) in enumerate(
                zip(*(c.to_pylist() for c in columns), strict=True)
            ):
                if not batch.column(7)[i].is_valid:
                    done.append((page, length, digest, kind, refers))
                    continue
                if no == 0 and (own is None or own[0] != rid):
                    done += close()
                    own = (rid, page, refers, length, digest, kind)
                    running, size, next_no, copies = hashlib.sha256(), 0, 0, 0
                copies += no == 0
                if own is None or own[0] != rid or no > next_no:
                    raise ValueError(f"page {page}: a chunk is missing")
                if no == next_no:
                    data = batch.column(7)[i].as_buffer()
                    running.update(data)
                    size, next_no = size + len(data), next_no + 1
            if done:
                yield _table(done, names, types)
        if own is not None:
            yield _table(close(), names, types)

    ordered = chunks.repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return ordered.mapInArrow(run, schema)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, by default into the shared folder, and read the records back."""
    spark = pages.sparkSession
    path = path or Stages(spark, "warc").path("archives")
    write_archives(pages, path)
    return records(read_chunks(spark, path, payloads=False))
