"""Claims to quarterly totals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import AGGREGATE_KEYS, CLAIM_MEASURES
from ..functions import ratio, ratio_or_zero

TOTALS = {
    "total_units": "units_reimbursed",
    "total_scripts": "prescriptions",
    "total_spend": "total_amount",
    "medicaid_spend": "medicaid_amount",
    "non_medicaid_spend": "non_medicaid_amount",
}


AMOUNTS = ("total_amount", "medicaid_amount", "non_medicaid_amount")

Decimals = int | Mapping[str, int] | None


def _total(source: str, decimals: int | None) -> Column:
    """A sum, exact if the column's decimals are known; a value with more of them raises."""
    if decimals is None:
        return F.sum(source)
    scaled = F.col(source) * float(10**decimals)
    whole = F.rint(scaled)
    # A sum or a difference of decimals may be off by the last bits of a double.
    noise = F.abs(scaled) * 1e-15 + 1e-6
    lost = F.concat(F.lit(f"{source} has more than {decimals} decimals: "), F.col(source).cast("string"))
    exact = F.when(F.abs(whole - scaled) <= noise, whole.cast("bigint"))
    return F.sum(exact.otherwise(F.raise_error(lost).cast("bigint"))) / float(10**decimals)


def _known(decimals: Decimals) -> Mapping[str, int]:
    return dict.fromkeys(AMOUNTS, decimals) if isinstance(decimals, int) else decimals or {}


def merge_totals(totals: DataFrame, more: DataFrame, decimals: Decimals = None) -> DataFrame:
    """Quarterly totals of all claims from the totals of two sets of them.

    With ``decimals`` as for ``quarterly_totals`` the result is that of one pass over all claims;
    columns without known decimals are added as doubles.
    """
    known = _known(decimals)
    both = totals.select(*AGGREGATE_KEYS, *TOTALS).unionByName(more.select(*AGGREGATE_KEYS, *TOTALS))

    def merged(name: str, source: str) -> Column:
        if source not in known:
            return F.sum(name)
        scale = float(10 ** known[source])
        return F.sum(F.rint(F.col(name) * scale).cast("bigint")) / scale

    sums = [merged(name, source).alias(name) for name, source in TOTALS.items()]
    return both.groupBy(*AGGREGATE_KEYS).agg(*sums)


def quarterly_totals(df: DataFrame, decimals: Decimals = None) -> DataFrame:
    """Five sums per state, drug, product and quarter; unknown measures count as 0.

    Sums combine on the map side, so a key that holds a third of all claims sends one
    row per task. ``decimals`` adds whole numbers of the last decimal: the totals then do
    not depend on the order of addition. A number holds for the three amounts, and units
    are added as they are; a mapping names the decimals of each claim column. A value that
    has more decimals raises, as does a sum too large for a long.
    """
    filled = df.fillna(dict.fromkeys(CLAIM_MEASURES, 0))
    known = _known(decimals)
    totals = [_total(source, known.get(source)).alias(name) for name, source in TOTALS.items()]
    return filled.groupBy(*AGGREGATE_KEYS).agg(*totals)


def safe_ratios(df: DataFrame) -> DataFrame:
    """Unit prices and the Medicaid share, null where the denominator is not positive."""
    spend = F.col("total_spend")
    return df.withColumns({
        "spend_per_script": ratio(spend, F.col("total_scripts")),
        "spend_per_unit": ratio(spend, F.col("total_units")),
        "medicaid_share": ratio(F.col("medicaid_spend"), spend),
    })


def safe_ratios_zero(df: DataFrame) -> DataFrame:
    """Unit prices for display: two decimals, 0 where the denominator is not positive."""
    spend = F.col("total_spend")
    return df.withColumns({
        "spend_per_script": ratio_or_zero(spend, F.col("total_scripts")),
        "spend_per_unit": ratio_or_zero(spend, F.col("total_units")),
    })


def quarterly_aggregates(
    df: DataFrame, decimals: Decimals = None, by_state: bool = False
) -> DataFrame:
    """Quarterly totals with ratios.

    ``by_state`` brings the rows of a state together, in parts of even size: a large state
    has several, and small ones share one.
    """
    out = safe_ratios(quarterly_totals(df, decimals))
    return out.hint("rebalance", "state") if by_state else out
