"""Forecasts by a trend that may bend and a yearly season, with bands from their own past errors.

The design is an intercept, a slope, changes of slope at fixed distances from a series' first
quarter, and the yearly Fourier terms that quarters can tell apart: whole numbers all. Ridge
penalties keep unused changes small. The normal equations are running sums along the series, so
one window gives the model as it would have been fitted at every quarter. The newest one makes
the forecast, the earlier ones the backtest, and the errors of those the band of each step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar_quarter_end, next_quarter_start, quarter_index
from .forecast import HORIZON, SERIES, TOO_SHORT, _chosen, _named, _periods, quarter_points
from .joins import attach


@dataclass(frozen=True)
class TrendModel:
    """Where the slope may change, and the penalties of the coefficients.

    Changes lie ``every`` quarters apart from the first quarter on; a later quarter has the last
    slope. The slope's penalty only settles series of one quarter.
    """

    changes: int = 4
    every: int = 6
    slope_penalty: float = 0.001
    change_penalty: float = 8.0
    season_penalty: float = 0.5
    least_origin: int = 8
    coverage: float = 0.8
    recent: int = 14

    @property
    def size(self) -> int:
        return 5 + self.changes

    def design(self, t: Column, quarter: Column) -> list[Column]:
        """The columns for a quarter ``t`` after the first, itself number ``quarter`` of its year."""
        q = quarter - 1
        hinges = [F.greatest(t - self.every * (k + 1), F.lit(0)) for k in range(self.changes)]
        even = F.when(q % 2 == 0, 1 - q).otherwise(0)
        odd = F.when(q % 2 == 1, 2 - q).otherwise(0)
        columns = [F.lit(1), t, *hinges, even, odd, 1 - 2 * (q % 2)]
        return [c.cast("double") for c in columns]

    def penalties(self) -> list[float]:
        return [0.0, self.slope_penalty, *[self.change_penalty] * self.changes, *[self.season_penalty] * 3]


def _solved(matrix: Column, size: int) -> Column:
    """Coefficients from the rows of symmetric normal equations, right side last, by elimination.

    Penalties make the matrix positive definite, so pivots are taken as they come.
    """
    kind = "array<array<double>>"

    def step(m: Column, k: Column) -> Column:
        pivot = F.get(m, k)
        head = F.get(pivot, k)

        def reduced(row: Column, i: Column) -> Column:
            own = F.get(row, k)
            other = F.zip_with(row, pivot, lambda a, b: a - own * b / head)
            return F.when(i == k, F.transform(pivot, lambda x: x / head)).otherwise(other)

        return F.transform(m, reduced).cast(kind)

    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), matrix.cast(kind), step)
    return F.transform(done, lambda row: F.get(row, F.lit(size)))


def _fitted(frame: DataFrame, model: TrendModel, horizon: int) -> DataFrame:
    """One row per series and quarter: the model fitted up to it, and the points that follow."""
    series = Window.partitionBy(*SERIES).orderBy("ds")
    whole = Window.partitionBy(*SERIES)
    timed = quarter_points(frame).withColumn("index", quarter_index(F.col("ds")))
    timed = timed.withColumns({
        "t": F.col("index") - F.min("index").over(whole), "points": F.sum("rows").over(whole),
        "last": F.max("ds").over(whole),
    })
    columns = model.design(F.col("t"), F.quarter("ds"))
    x = [f"x{i}" for i in range(model.size)]
    timed = timed.withColumns(dict(zip(x, columns)))
    so_far = series.rowsBetween(Window.unboundedPreceding, 0)
    ahead = series.rowsBetween(1, horizon)
    pairs = [(i, j) for i in range(model.size) for j in range(i, model.size)]
    sums = {f"m{i}_{j}": F.sum(F.col(x[i]) * F.col(x[j])).over(so_far) for i, j in pairs}
    sums |= {f"v{i}": F.sum(F.col(x[i]) * F.col("y")).over(so_far) for i in range(model.size)}
    sums |= {"seen": F.count(F.lit(1)).over(so_far), "ahead": F.collect_list(F.struct("t", "y")).over(ahead)}
    summed = timed.select("*", *[c.alias(n) for n, c in sums.items()])
    penalties = model.penalties()
    rows = []
    for i in range(model.size):
        row = [F.col(f"m{min(i, j)}_{max(i, j)}") + (penalties[i] if i == j else 0.0) for j in range(model.size)]
        rows.append(F.array(*row, F.col(f"v{i}")))
    return summed.select(
        *SERIES, "ds", "t", "points", "last", "seen", "ahead", _solved(F.array(*rows), model.size).alias("coefficients")
    )


def _value(model: TrendModel, t: Column, quarter: Column) -> Column:
    terms = [F.get("coefficients", F.lit(i)) * x for i, x in enumerate(model.design(t, quarter))]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def _backtested(fitted: DataFrame, model: TrendModel, horizon: int) -> DataFrame:
    tried = fitted.where((F.col("seen") >= model.least_origin) & (F.size("ahead") > 0))
    steps = tried.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    there = F.filter("ahead", lambda a: a["t"] == F.col("t") + F.col("step"))
    steps = steps.withColumn("actual", F.get(there, F.lit(0))["y"]).where(F.col("actual").isNotNull())
    after = next_quarter_start(F.col("ds"), F.col("step"))
    value = _value(model, F.col("t") + F.col("step"), F.quarter(after))
    return steps.select(
        *SERIES, F.col("ds").alias("origin"), "step", value.alias("forecast"), "actual",
        (F.col("actual") - value).alias("error"),
    )


def backtest(frame: DataFrame, model: TrendModel = TrendModel(), horizon: int = HORIZON) -> DataFrame:
    """(series, origin, step, forecast, actual, error) of every earlier quarter's own forecast.

    An origin has ``least_origin`` quarters up to itself; steps whose quarter has no point are left
    out. The sums run along the series, so the data are read and sorted once for all origins.
    """
    return _backtested(_fitted(frame, model, horizon), model, horizon)


def bands(errors: DataFrame, model: TrendModel = TrendModel()) -> DataFrame:
    """(series, step, tries, half_width): the error that the wanted share of backtests stays within.

    Of the n newest errors of a step, ``recent`` at most, it is the smallest that at least
    (n + 1) * coverage are not above, which holds that share for the next one too; a series with
    fewer errors than that asks for has none. Older errors are those of a model with few points.
    """
    newest = F.sort_array(F.collect_list(F.struct("origin", F.abs("error").alias("size"))), asc=False)
    found = errors.groupBy(*SERIES, "step").agg(F.slice(newest, 1, model.recent).alias("newest"))
    sizes = F.array_sort(F.transform("newest", lambda e: e["size"]))
    place = F.ceil((F.size("newest") + 1) * F.lit(model.coverage)).cast("int")
    return found.select(
        *SERIES, "step", F.size("newest").alias("tries"), F.get(sizes, place - 1).alias("half_width")
    )


def forecast_changepoint(
    frame: DataFrame, universe: DataFrame, metric: str = "spend",
    model: TrendModel = TrendModel(), horizon: int = HORIZON,
) -> DataFrame:
    """Forecast every chosen series, in the columns of the built-in forecast.

    Series of fewer rows than a forecast asks for get one row with an error. Bounds are null where a series
    has too few earlier forecasts of a step to tell how far they err.
    """
    fitted = _fitted(frame, model, horizon)
    # a series has as many errors of a step as quarters at most
    wide = bands(_backtested(fitted, model, horizon), model).groupBy(*SERIES).agg(
        F.map_from_entries(F.collect_list(F.struct("step", "half_width"))).alias("widths"))
    newest = fitted.where(F.col("ds") == F.col("last")).drop("ahead", "ds", "seen")
    rows = attach(_chosen(universe), attach(newest, wide, SERIES), SERIES)
    steps = rows.withColumn("forecast_period", F.explode(_periods(horizon)))
    step = F.col("forecast_period")
    start = next_quarter_start(F.col("last"), step)
    value = F.when(step.isNotNull(), _value(model, F.col("t") + step, F.quarter(start)))
    margin = F.try_element_at("widths", step)
    return _named(
        steps.withColumns({
            "forecast_date": calendar_quarter_end(F.col("last"), step),
            "forecast_quarter_start": start,
            "forecast_value": value,
            "forecast_lower": value - margin,
            "forecast_upper": value + margin,
            "error": F.when(step.isNull(), TOO_SHORT),
        }),
        metric,
    )
