"""From raw claim rows to one canonical, quality-flagged table."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import CLAIM_MEASURES, COLUMN_KINDS, HEADER_VARIANTS
from ..functions import digits_padded, flag, quarter_start, to_number, to_whole


def detect_columns(headers: Iterable[str]) -> dict[str, str]:
    """Canonical name -> header, for each canonical column that has one."""
    present = set(headers)
    matches = {
        name: next((v for v in variants if v in present), None)
        for name, variants in HEADER_VARIANTS.items()
    }
    return {name: header for name, header in matches.items() if header is not None}


def _canonical(header: str, kind: str) -> Column:
    raw = F.col(f"`{header.replace('`', '``')}`")
    if kind == "double":
        return to_number(raw)
    if kind in ("int", "bigint"):
        return to_whole(raw, kind)
    return F.upper(F.trim(raw)) if kind == "code" else F.trim(raw)


def add_quarter_start(df: DataFrame) -> DataFrame:
    return df.withColumn("quarter_start", quarter_start(F.col("year"), F.col("quarter")))


def add_normalized_ndc(df: DataFrame) -> DataFrame:
    return df.withColumn("ndc11_normalized", digits_padded(F.col("ndc11")))


def add_spend_mismatch(df: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """True where all three amounts are known and the parts miss the total."""
    gap = F.col("total_amount") - (F.col("medicaid_amount") + F.col("non_medicaid_amount"))
    return df.withColumn("spend_mismatch", flag(F.abs(gap) > tolerance))


def apply_schema(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename, trim and cast the mapped columns, then derive what they allow."""
    out = df.select(*[
        _canonical(header, COLUMN_KINDS[name]).alias(name) for name, header in mapping.items()
    ])
    if {"year", "quarter"} <= mapping.keys():
        out = add_quarter_start(out)
    if "ndc11" in mapping:
        out = add_normalized_ndc(out)
    if {"total_amount", "medicaid_amount", "non_medicaid_amount"} <= mapping.keys():
        out = add_spend_mismatch(out)
    return out


def validate_ranges(df: DataFrame, strict: bool = False) -> DataFrame:
    """Flag impossible quarters, states and drug codes; turn negative measures to null.

    ``strict`` also asks for two letters in the state and for 1 to 11 digits in the code
    before padding.
    """
    have = set(df.columns)
    flags: dict[str, Column] = {}
    if "quarter" in have:
        flags["invalid_quarter"] = flag(~F.col("quarter").between(1, 4))
    if "state" in have:
        bad_state = F.length("state") != 2
        if strict:
            bad_state = ~F.col("state").rlike("^[A-Z]{2}$")
        flags["invalid_state"] = flag(bad_state)
    if "ndc11_normalized" in have:
        code = F.col("ndc11_normalized")
        well_formed = flag(code.rlike(r"\A[0-9]{11}\z"))
        if strict and "ndc11" in have:
            digits = F.length(F.regexp_replace("ndc11", "[^0-9]", ""))
            well_formed = well_formed & flag(digits.between(1, 11))
        flags["invalid_ndc"] = ~well_formed
    measures = {c: F.when(F.col(c) >= 0, F.col(c)) for c in CLAIM_MEASURES if c in have}
    return df.withColumns({**flags, **measures})


def _clean(df: DataFrame) -> list[Column]:
    """What a clean row fulfils, one condition per column, as far as the table has it.

    The code flag covers a null code, so the code is not derived once more for it.
    """
    flags = [c for c in ("invalid_quarter", "invalid_state", "invalid_ndc") if c in df.columns]
    needed = ["state", "quarter_start"]
    if "invalid_ndc" not in flags:
        needed.append("ndc11_normalized")
    return [
        *[~F.col(name) for name in flags],
        *[F.col(name).isNotNull() for name in needed],
        *_nonnegative(df),
    ]


def _nonnegative(df: DataFrame) -> list[Column]:
    totals = ("total_units", "total_scripts", "total_spend")
    return [flag(F.col(name) >= 0) for name in totals if name in df.columns]


def _where_all(df: DataFrame, conditions: list[Column]) -> DataFrame:
    # Separate conditions can each be pushed to their own side of a join.
    return reduce(DataFrame.where, conditions, df)


def cleanse(df: DataFrame) -> DataFrame:
    """Drop flagged rows and rows without state, drug code or quarter."""
    return _where_all(df, _clean(df))


def nonnegative_measures(df: DataFrame) -> DataFrame:
    """Keep rows whose totals, as far as the table has them, are known and not negative."""
    return _where_all(df, _nonnegative(df))


def cleansing_counts(df: DataFrame) -> DataFrame:
    """Number of rows before and after cleansing, from one pass, one row per stage."""
    kept = reduce(lambda a, b: a & b, _clean(df))
    counts = df.agg(F.count(F.lit(1)).alias("raw"), F.count_if(kept).alias("cleansed"))
    return counts.unpivot([], ["raw", "cleansed"], "stage", "row_count")


def time_dimensions(df: DataFrame) -> DataFrame:
    """Year and quarter of each row's quarter start."""
    return df.withColumns({
        "year": F.year("quarter_start"), "quarter": F.quarter("quarter_start"),
    })
