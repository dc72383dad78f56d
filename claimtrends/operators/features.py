"""Trend features of a series. Frames count rows of the series, in its unique order.

Each operator adds its window inputs in one step, derives its columns from them and drops
the inputs again, so a run of operators needs one exchange and one sort. Groups are
series of quarter rows, already aggregated; see ``long_series`` for series that are
still too long for one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import DRUG_SERIES, PRODUCT_SERIES, SeriesSpec
from ..functions import quarter_index

GROWTH_MEASURES = ("spend", "units")
TREND_STEP = 0.05
DEFAULT_LAGS = (1, 2, 4)
LOOKBACK = 7

Columns = dict[str, Column]


class _Frames:
    """The windows of a series: its row order and the frames used on it."""

    def __init__(self, spec: SeriesSpec):
        self.measures = spec.measures
        self.growing = [(m, c) for m, c in spec.measures if m in GROWTH_MEASURES]
        self.rows = spec.ordered()
        self.last4 = self.rows.rowsBetween(-3, 0)
        self.prior4 = self.rows.rowsBetween(-7, -4)


def _derive(df: DataFrame, inputs: Columns, *steps: Columns) -> DataFrame:
    """Add window inputs at once, then each step of derived columns, then drop inputs."""
    out = df.withColumns(inputs)
    for columns in steps:
        out = out.withColumns(columns)
    return out.drop(*[name for name in inputs if name.startswith("__")])


def _previous(frames: _Frames) -> Columns:
    return {f"__prev_{m}": F.lag(c, 1).over(frames.rows) for m, c in frames.measures}


def _changes(frames: _Frames, infinite: bool = False) -> Columns:
    """Relative change to the previous row. From zero it is null, or signed infinity."""
    out = {}
    for m, c in frames.measures:
        value, prev = F.col(c), F.col(f"__prev_{m}")
        change = F.when(prev != 0, (value - prev) / prev)
        if infinite:
            change = change.when(
                (prev == 0) & (value != 0), F.signum(value) * F.lit(float("inf"))
            )
        out[f"qoq_{m}_change"] = change
    return out


def _rolling(frames: _Frames) -> Columns:
    out = {}
    for m, c in frames.measures:
        out[f"t4q_{m}_avg"] = F.avg(c).over(frames.last4)
        out[f"t4q_{m}_std"] = F.stddev_samp(c).over(frames.last4)
    return out


def _variation(frames: _Frames) -> Columns:
    out = {}
    for m, _ in frames.measures:
        mean, spread = F.col(f"t4q_{m}_avg"), F.col(f"t4q_{m}_std")
        out[f"cv_{m}"] = F.when(mean > 0, spread / mean)
    return out


def _growth_sums(frames: _Frames) -> Columns:
    out = {}
    for m, c in frames.growing:
        out[f"__last4_{m}"] = F.sum(c).over(frames.last4)
        out[f"__prior4_{m}"] = F.sum(c).over(frames.prior4)
    out["__prior_rows"] = F.count(F.lit(1)).over(frames.prior4)
    return out


def _growth(frames: _Frames, min_prior: int) -> Columns:
    out = {}
    for m, _ in frames.growing:
        last, prior = F.col(f"__last4_{m}"), F.col(f"__prior4_{m}")
        enough = (prior > 0) & (F.col("__prior_rows") >= min_prior)
        out[f"rolling_4q_growth_{m}"] = F.when(enough, (last - prior) / prior)
    return out


def _lags(frames: _Frames, lags: Sequence[int]) -> Columns:
    return {
        f"{m}_lag_{k}q": F.lag(c, k).over(frames.rows) for k in lags for m, c in frames.measures
    }


def _direction(change: Column) -> Column:
    return (
        F.when(change > TREND_STEP, "increasing")
        .when(change < -TREND_STEP, "decreasing")
        .otherwise("stable")
    )


def _directions(frames: _Frames) -> Columns:
    return {
        f"trend_direction_{m}": _direction(F.col(f"qoq_{m}_change")) for m, _ in frames.growing
    }


def qoq_change(df: DataFrame, spec: SeriesSpec = DRUG_SERIES) -> DataFrame:
    frames = _Frames(spec)
    return _derive(df, _previous(frames), _changes(frames))


def rolling_stats(df: DataFrame, spec: SeriesSpec = DRUG_SERIES) -> DataFrame:
    """Mean and sample deviation of the last four rows, fewer at the start."""
    frames = _Frames(spec)
    return _derive(df, _rolling(frames))


def variation(df: DataFrame, spec: SeriesSpec = DRUG_SERIES) -> DataFrame:
    """Rolling statistics and their coefficient of variation."""
    frames = _Frames(spec)
    return _derive(df, _rolling(frames), _variation(frames))


def rolling_growth(
    df: DataFrame, spec: SeriesSpec = DRUG_SERIES, min_prior: int = 1
) -> DataFrame:
    """Last four rows against the four before; ``min_prior=4`` asks for all four."""
    frames = _Frames(spec)
    return _derive(df, _growth_sums(frames), _growth(frames, min_prior))


def trend_direction(df: DataFrame, spec: SeriesSpec = DRUG_SERIES) -> DataFrame:
    frames = _Frames(spec)
    return _derive(df, _previous(frames), _changes(frames), _directions(frames))


def lag_features(
    df: DataFrame, spec: SeriesSpec = DRUG_SERIES, lags: Sequence[int] = DEFAULT_LAGS
) -> DataFrame:
    return df.withColumns(_lags(_Frames(spec), lags))


def trend_features(
    df: DataFrame,
    spec: SeriesSpec = DRUG_SERIES,
    lags: Sequence[int] = (),
    min_prior: int = 1,
) -> DataFrame:
    """All trend features, and lags if asked for, over one window."""
    frames = _Frames(spec)
    inputs = {
        **_previous(frames), **_rolling(frames), **_growth_sums(frames), **_lags(frames, lags),
    }
    derived = {**_changes(frames), **_variation(frames), **_growth(frames, min_prior)}
    return _derive(df, inputs, derived, _directions(frames))


def calendar_features(
    df: DataFrame, spec: SeriesSpec = DRUG_SERIES, lags: Sequence[int] = DEFAULT_LAGS
) -> DataFrame:
    """Changes, rolling statistics, growth and lags whose frames count quarters instead of rows.

    All rows of a quarter are in its frames, several products included: a change compares a
    quarter's total with that of the quarter before, and is null where that one has no rows. Means
    and deviations are over the rows of the last four quarters. One exchange and one sort for all;
    a series is one task's work.
    """
    quarters = Window.partitionBy(*spec.keys).orderBy("__quarter")
    span = lambda a, b: quarters.rangeBetween(a, b)
    inputs, derived = {}, {}
    for m, c in spec.measures:
        inputs[f"__now_{m}"] = F.sum(c).over(span(0, 0))
        inputs[f"__before_{m}"] = F.sum(c).over(span(-1, -1))
        inputs[f"calendar_4q_{m}_avg"] = F.avg(c).over(span(-3, 0))
        inputs[f"calendar_4q_{m}_std"] = F.stddev_samp(c).over(span(-3, 0))
        inputs |= {f"calendar_{m}_lag_{k}q": F.sum(c).over(span(-k, -k)) for k in lags}
        now, before = F.col(f"__now_{m}"), F.col(f"__before_{m}")
        derived[f"calendar_{m}_change"] = F.when(before != 0, (now - before) / before)
        if m in GROWTH_MEASURES:
            inputs[f"__last_{m}"] = F.sum(c).over(span(-3, 0))
            inputs[f"__prior_{m}"] = F.sum(c).over(span(-7, -4))
            last, prior = F.col(f"__last_{m}"), F.col(f"__prior_{m}")
            derived[f"calendar_4q_growth_{m}"] = F.when(prior > 0, (last - prior) / prior)
    numbered = df.withColumn("__quarter", quarter_index(F.col(spec.time)))
    return _derive(numbered, inputs, derived).drop("__quarter")


def qoq_change_by_product(df: DataFrame, spec: SeriesSpec = PRODUCT_SERIES) -> DataFrame:
    """Changes along a product name; a rise from zero is infinite."""
    frames = _Frames(spec)
    return _derive(df, _previous(frames), _changes(frames, infinite=True))


def _product_rolling(frames: _Frames) -> Columns:
    return {
        "rolling_4q_spend_avg": F.avg("total_spend").over(frames.last4),
        "rolling_4q_spend_std": F.stddev_samp("total_spend").over(frames.last4),
    }


def _product_variation() -> Columns:
    mean, spread = F.col("rolling_4q_spend_avg"), F.col("rolling_4q_spend_std")
    return {"cv_spend": F.when(mean != 0, spread / mean)}


def rolling_stats_by_product(df: DataFrame, spec: SeriesSpec = PRODUCT_SERIES) -> DataFrame:
    frames = _Frames(spec)
    return _derive(df, _product_rolling(frames), _product_variation())


def _fourth_last(frames: _Frames) -> Columns:
    return {"__first": F.lag("total_spend", 3).over(frames.rows)}


def _endpoint_growth() -> Columns:
    first = F.col("__first")
    growth = F.when(first != 0, (F.col("total_spend") - first) / first).otherwise(0.0)
    return {"rolling_4q_growth_spend": growth}


def endpoint_growth(df: DataFrame, spec: SeriesSpec = PRODUCT_SERIES) -> DataFrame:
    """Last row of a four-row frame against its first; 0 for short frames or from zero."""
    frames = _Frames(spec)
    return _derive(df, _fourth_last(frames), _endpoint_growth())


def product_trends(df: DataFrame, spec: SeriesSpec = PRODUCT_SERIES) -> DataFrame:
    """The dashboard's features: changes, rolling statistics and endpoint growth."""
    frames = _Frames(spec)
    inputs = {**_previous(frames), **_product_rolling(frames), **_fourth_last(frames)}
    derived = {
        **_changes(frames, infinite=True), **_product_variation(), **_endpoint_growth(),
    }
    return _derive(df, inputs, derived)
