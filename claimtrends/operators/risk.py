"""Risk rules: spend thresholds, flags, level and score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import DashboardRules, RiskRules
from ..functions import flag, round_to
from ..sources.tables import checkpoint_table
from .joins import attach
from .quantiles import approx_quantiles, exact_quantile, exact_quantiles

PEERS = ("state", "quarter_start")


def _quantiles(rules: RiskRules) -> dict[str, float]:
    return {
        "spend_75th_percentile": rules.high_cost_quantile,
        "spend_90th_percentile": rules.very_high_cost_quantile,
    }


def spend_thresholds(df: DataFrame, rules: RiskRules = RiskRules()) -> DataFrame:
    """Spend percentiles per state and quarter. Needs only the aggregates."""
    return approx_quantiles(df, "total_spend", _quantiles(rules), PEERS)


def spend_percentiles(
    df: DataFrame, thresholds: DataFrame | None = None, rules: RiskRules = RiskRules()
) -> DataFrame:
    """Attach the percentiles of each row's state and quarter.

    ``thresholds`` takes a stored ``spend_thresholds`` table, which spares the shuffle of
    the rows: its size is known, so it can be broadcast.
    """
    if thresholds is None:
        thresholds = spend_thresholds(df, rules)
    return attach(df, thresholds, PEERS)


def spend_percentiles_global(df: DataFrame, rules: RiskRules = RiskRules()) -> DataFrame:
    """The same over all rows. Both percentiles are exact, from one pass, as scalar subqueries."""
    names = _quantiles(rules)
    found = checkpoint_table(exact_quantiles(df, "total_spend", names, (), interpolate=False), "quantiles")
    return df.withColumns({name: found.select(name).scalar() for name in names})


def risk_flags(df: DataFrame, rules: RiskRules = RiskRules()) -> DataFrame:
    """Eight flags. An unknown input never raises one."""
    spend, cv = F.col("total_spend"), F.col("cv_spend")
    growth = F.col("rolling_4q_growth_spend")
    change = F.abs("qoq_spend_change")
    return df.withColumns({
        "high_cost": flag(spend >= F.col("spend_75th_percentile")),
        "very_high_cost": flag(spend >= F.col("spend_90th_percentile")),
        "high_vol": flag(cv > rules.cv_high)
        | flag(change > rules.change_high)
        | flag(cv.isNull() & (change > rules.change_high_without_cv)),
        "extreme_vol": flag(cv > rules.cv_extreme) | flag(change > rules.change_extreme),
        "fast_riser": flag(growth > rules.growth_fast),
        "extreme_riser": flag(growth > rules.growth_extreme),
        "declining": flag(growth < -rules.growth_fast),
        "rapid_decline": flag(growth < -rules.growth_extreme),
    })


def _any(*names: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(n) for n in names])


def _level(high: Column, medium: Column) -> Column:
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def _points(weights: tuple[tuple[str, int], ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.col(n), w).otherwise(0) for n, w in weights])


def risk_level(df: DataFrame) -> DataFrame:
    moving = _any("high_vol", "fast_riser", "extreme_riser")
    worrying = _any("high_cost", "extreme_vol", "rapid_decline") | moving
    return df.withColumn("risk_level", _level(F.col("high_cost") & moving, worrying))


def risk_score(df: DataFrame, rules: RiskRules = RiskRules()) -> DataFrame:
    """Points for the level plus points for flags, at most 100."""
    base = F.coalesce(
        *[F.when(F.col("risk_level") == level, points) for level, points in rules.score_levels],
        F.lit(0),
    )
    total = base + _points(rules.score_weights)
    return df.withColumn("risk_score", F.least(F.lit(rules.score_cap), total))


def flag_risks(
    df: DataFrame,
    by_state: bool = True,
    thresholds: DataFrame | None = None,
    rules: RiskRules = RiskRules(),
) -> DataFrame:
    """Thresholds within state and quarter, or over all rows, then flags, level, score."""
    if by_state:
        out = spend_percentiles(df, thresholds, rules)
    else:
        out = spend_percentiles_global(df, rules)
    return risk_score(risk_level(risk_flags(out, rules)), rules)


def high_cost_exact(df: DataFrame, rules: DashboardRules = DashboardRules()) -> DataFrame:
    """Rows at or above the interpolated spend quantile of their state."""
    cut = exact_quantile(df, "total_spend", rules.high_cost_quantile, ("state",), "spend_cut")
    out = attach(df, cut, ("state",))
    return out.withColumn("high_cost", flag(F.col("total_spend") >= F.col("spend_cut")))


def dashboard_risks(latest: DataFrame, rules: DashboardRules = DashboardRules()) -> DataFrame:
    """The dashboard's rules on one quarter of ``product_trends`` rows."""
    cv = F.col("cv_spend")
    out = high_cost_exact(latest, rules).drop("spend_cut")
    out = out.withColumns({
        "high_vol": flag(cv > rules.cv_high)
        | flag(F.abs("qoq_spend_change") > rules.change_high),
        "fast_riser": flag(F.col("rolling_4q_growth_spend") > rules.growth_fast),
    })
    moving = _any("high_vol", "fast_riser")
    spread = F.when(
        cv.isNotNull(),
        F.greatest(F.lit(0.0), F.least(F.lit(rules.cv_weight), cv * rules.cv_weight)),
    )
    return out.withColumns({
        "risk_level": _level(F.col("high_cost") & moving, F.col("high_cost") | moving),
        "risk_score": round_to(_points(rules.score_weights) + spread, 1),
    })
