"""Stage tables that follow a folder of CSV files without a full run.

Totals of claims add up, so new files are rolled up on their own and merged into the quarters
they touch. A feature looks back a fixed number of rows, so only series with new claims are
computed again, from their first touched quarter on, with that many rows before it. Percentiles
belong to a state and quarter, so risks are graded again in the quarters that changed. All three
tables lie in one store by quarter, and one commit puts the changed quarters in place.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..columns import DRUG_SERIES, RiskRules
from ..operators.aggregate import Decimals, merge_totals, quarterly_totals, safe_ratios
from ..operators.features import DEFAULT_LAGS, LOOKBACK
from ..sources.claims_csv import read_claim_files
from ..sources.snapshots import Commit, Store, input_files
from ..sources.tables import checkpoint_table
from .pipeline import Stages, quality_checked, risks_from_features, series_features

TABLES = ("aggregates", "features", "risks")
QUARTER = "quarter_start"


def read_stages(spark: SparkSession, root: str, version: int | None = None) -> Stages:
    """The stage tables of a store as of a version, the newest by default."""
    store = Store(spark, root)
    commit = store.commit(version)
    return Stages(*[store.read(name, commit) for name in TABLES])


def _quarters(df: DataFrame) -> list[str]:
    """Folders of the quarters in a table; as many as the calendar has."""
    return sorted(f"{QUARTER}={r[0]}/" for r in df.select(QUARTER).distinct().collect())


def _touched_rows(aggregates: DataFrame, firsts: DataFrame, lookback: int) -> DataFrame:
    """Rows of the touched series from their first touched quarter on, and ``lookback`` rows before."""
    spec = DRUG_SERIES
    rows = aggregates.join(firsts, list(spec.keys))
    later = rows.where(F.col(QUARTER) >= F.col("first_touched"))
    earlier = rows.where(F.col(QUARTER) < F.col("first_touched"))
    last = Window.partitionBy(*spec.keys).orderBy(*[F.desc(c) for c in (spec.time, *spec.tiebreak)])
    near = earlier.withColumn("back", F.row_number().over(last))
    return later.unionByName(near.where(F.col("back") <= lookback).drop("back"))


def refresh(
    spark: SparkSession,
    raw_folder: str,
    root: str,
    decimals: Decimals = None,
    lags: Sequence[int] = DEFAULT_LAGS,
    strict: bool = False,
    rules: RiskRules = RiskRules(),
    min_prior: int = 1,
) -> Stages:
    """Bring the store at ``root`` up to the CSV files of a folder; equal to a run over all of them.

    Files are known by path, length and time of change. Only new ones are read; if one that was
    taken in has changed or gone, or a setting differs from the last time, everything is built anew.
    Nothing is read if nothing is new. A refresh that fails leaves the store as it was. With
    ``decimals`` totals do not depend on how files came in; without, they may differ in the last
    bits. Thresholds are those per state and quarter.
    """
    store = Store(spark, root)
    base = store.commit()
    present = input_files(spark, raw_folder)
    settings = {"decimals": decimals if isinstance(decimals, int | None) else dict(decimals), "lags": list(lags),
                "strict": strict, "min_prior": min_prior, "rules": repr(sorted(asdict(rules).items()))}
    taken = base.note.get("inputs", {})
    whole = not base.number or base.note.get("settings") != settings or any(
        present.get(path) != seen for path, seen in taken.items())
    new = sorted(path for path in present if whole or path not in taken)
    if not present:
        raise FileNotFoundError(f"no CSV files in {raw_folder}")
    if not new:
        return read_stages(spark, root)

    checked = quality_checked(read_claim_files(spark, new), strict)
    delta = checkpoint_table(quarterly_totals(checked, decimals), "delta")
    note = {"inputs": present, "settings": settings}
    if whole:
        base = Commit(base.number, {}, base.note)
    elif delta.isEmpty():
        store.publish([], base, note)
        return read_stages(spark, root)
    touched = _quarters(delta)
    totals = delta
    if not whole:
        totals = merge_totals(store.read("aggregates", base, touched), delta, decimals)
    by_quarter = (QUARTER,)
    parts = [store.write("aggregates", safe_ratios(totals), by_quarter)]
    pending = store.preview(parts, base, whole)

    if whole:
        made = series_features(store.read("aggregates", pending), lags, min_prior=min_prior)
        changed = touched
    else:
        firsts = checkpoint_table(
            delta.groupBy(*DRUG_SERIES.keys).agg(F.min(QUARTER).alias("first_touched")), "firsts")
        lookback = max(LOOKBACK, *lags) if lags else LOOKBACK
        rows = checkpoint_table(_touched_rows(store.read("aggregates", pending), firsts, lookback), "touched")
        again = series_features(rows, lags, min_prior=min_prior)
        again = checkpoint_table(
            again.where(F.col(QUARTER) >= F.col("first_touched")).drop("first_touched"), "again")
        changed = _quarters(again)
        same = store.read("features", base, changed).join(firsts, list(DRUG_SERIES.keys), "left").where(
            F.col("first_touched").isNull() | (F.col(QUARTER) < F.col("first_touched"))
        ).drop("first_touched")
        made = same.unionByName(again)
    parts.append(store.write("features", made, by_quarter))
    pending = store.preview(parts, base, whole)

    risks = risks_from_features(
        store.read("features", pending, changed), store.read("aggregates", pending, changed), rules)
    parts.append(store.write("risks", risks, by_quarter))
    commit = store.publish(parts, base, note, whole)
    out = [store.read(name, commit) for name in TABLES]
    return Stages(*out, counts={part.table: part.rows for part in parts})
