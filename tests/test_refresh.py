import random

import pytest

from claimtrends.plans import read_stages, refresh, run
from claimtrends.sources import Store, stage_tables

HEADER = ("State,NDC,Year,Quarter,Product Name,Units Reimbursed,Number of Prescriptions,"
          "Total Amount Reimbursed,Medicaid Amount Reimbursed,Non Medicaid Amount Reimbursed")


def lines(rng, quarters, states=("CA", "TX"), codes=4, share=0.7):
    out = []
    for year, quarter in quarters:
        for state in states:
            for code in range(codes):
                for product in ("A", "B"):
                    if rng.random() < share:
                        cents = rng.randrange(1, 10**7)
                        out.append(f"{state},{code},{year},{quarter},{product},{rng.randrange(9)}.5,{rng.randrange(5)},"
                                   f"{cents / 100:.2f},{cents / 100:.2f},0.00")
    return out


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.csv").write_text("\n".join([HEADER, *rows]) + "\n")


def same(a, b):
    columns = sorted(b.columns)
    assert sorted(a.columns) == columns
    assert sorted(map(str, a.select(*columns).collect())) == sorted(map(str, b.select(*columns).collect()))


KNOWN = {"total_amount": 2, "medicaid_amount": 2, "non_medicaid_amount": 2, "units_reimbursed": 1}
QUARTERS = [(2015 + i // 4, 1 + i % 4) for i in range(24)]


@pytest.mark.parametrize("late", [0, 5, 20])
def test_equals_a_full_run(spark, tmp_path, late):
    rng = random.Random(late)
    raw, root = tmp_path / "raw", str(tmp_path / "store")
    put(raw, "a", lines(rng, QUARTERS[:18]))
    with stage_tables(spark):
        first = refresh(spark, str(raw), root, KNOWN)
        assert first.counts["aggregates"] == first.aggregates.count()
        put(raw, "b", lines(rng, QUARTERS[18:20]) + lines(rng, QUARTERS[late:late + 2], states=("CA",), codes=2, share=0.5))
        put(raw, "c", lines(rng, QUARTERS[20:21], states=("NY",)))
        second = refresh(spark, str(raw), root, KNOWN)
        full = run(spark, str(raw), str(tmp_path / "full"), KNOWN)
        for name in ("aggregates", "features", "risks"):
            same(getattr(second, name), getattr(full, name))
            same(getattr(read_stages(spark, root), name), getattr(full, name))
        assert read_stages(spark, root, 1).risks.count() == first.risks.count()


def test_only_new_files_are_read_and_only_changed_quarters_written(spark, tmp_path, monkeypatch):
    from claimtrends.plans import refresh as function
    import sys
    module = sys.modules[function.__module__]
    rng, seen = random.Random(3), []
    raw, root = tmp_path / "raw", str(tmp_path / "store")
    put(raw, "a", lines(rng, QUARTERS[:12]))
    read = module.read_claim_files
    monkeypatch.setattr(module, "read_claim_files", lambda s, paths: (seen.append([p.rsplit("/", 1)[1] for p in paths]), read(s, paths))[1])
    refresh(spark, str(raw), root, KNOWN)
    put(raw, "b", lines(rng, QUARTERS[12:13]))
    refresh(spark, str(raw), root, KNOWN)
    old, new = (Store(spark, root).commit(n).tables for n in (1, 2))
    for table in ("aggregates", "features", "risks"):
        moved = {q for q, f in new[table]["folders"].items() if old[table]["folders"].get(q) != f}
        assert moved == {"quarter_start=2018-01-01/"}
    refresh(spark, str(raw), root, KNOWN)
    assert seen == [["a.csv"], ["b.csv"]] and Store(spark, root).numbers() == [1, 2]
    # a changed file, or another setting, asks for a full build
    put(raw, "a", lines(rng, QUARTERS[:11]))
    stages = refresh(spark, str(raw), root, KNOWN)
    assert seen[2:] == [["a.csv", "b.csv"]]
    same(stages.risks, run(spark, str(raw), str(tmp_path / "full"), KNOWN).risks)
    refresh(spark, str(raw), root, KNOWN, lags=(1,))
    assert seen[3:] == [["a.csv", "b.csv"]]


def test_a_failing_refresh_leaves_the_store(spark, tmp_path):
    raw, root = tmp_path / "raw", str(tmp_path / "store")
    put(raw, "a", lines(random.Random(1), QUARTERS[:6]))
    before = refresh(spark, str(raw), root, KNOWN).risks.count()
    put(raw, "b", ["CA,1,2020,1,A,1.25,1,1.00,1.00,0.00"])  # more decimals than known
    with pytest.raises(Exception, match="more than 1 decimals"):
        refresh(spark, str(raw), root, KNOWN)
    assert read_stages(spark, root).risks.count() == before and Store(spark, root).numbers() == [1]


def test_files_without_a_clean_claim(spark, tmp_path):
    raw, root = tmp_path / "raw", str(tmp_path / "store")
    put(raw, "a", ["CALIFORNIA,1,2020,1,A,1,1,1,1,0"])
    assert refresh(spark, str(raw), root, KNOWN).risks.count() == 0
    put(raw, "b", lines(random.Random(2), QUARTERS[:3]))
    n = refresh(spark, str(raw), root, KNOWN).risks.count()
    put(raw, "c", ["CALIFORNIA,1,2020,1,A,1,1,1,1,0"])
    assert refresh(spark, str(raw), root, KNOWN).risks.count() == n > 0
    assert len(Store(spark, root).commit().note["inputs"]) == 3
    with pytest.raises(FileNotFoundError):
        refresh(spark, str(tmp_path / "absent"), root)
