"""Four-quarter forecasts for all chosen series in one plan.

The built-in model is a linear trend times a seasonal index with a normal 80% band that is as
wide as the degrees of freedom left and the distance ahead ask for. Other
solvers give other numbers; ``forecast_with`` takes any per-series model instead.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import DRUG_SERIES, FORECAST_SCHEMA
from ..functions import calendar_quarter_end, next_quarter_start, quarter_index
from .joins import attach, keep_matching
from .serve import latest_per_series, top_per_state

SERIES = DRUG_SERIES.keys
HORIZON = 4
MIN_POINTS = 4
TOO_SHORT = "Insufficient data"
# Fixed value: half width of the central 80% of a normal distribution.
BAND = 1.2815515655
# Below this share of the mean level a trend is too close to zero to divide by.
TREND_FLOOR = 0.05

Model = Callable[[pd.DataFrame, int], pd.DataFrame]


def forecast_universe(df: DataFrame, top_k: int = 50, metric: str = "spend") -> DataFrame:
    """The k largest series of each state by their latest value."""
    return top_per_state(latest_per_series(df), f"total_{metric}", top_k)


def forecast_input(history: DataFrame, universe: DataFrame) -> DataFrame:
    """All history rows of the chosen series."""
    return keep_matching(history, universe, SERIES)


def series_frame(history: DataFrame, universe: DataFrame, metric: str = "spend") -> DataFrame:
    """Date and value of each known point of the chosen series."""
    points = forecast_input(history, universe).select(
        *SERIES, F.col("quarter_start").alias("ds"), F.col(f"total_{metric}").cast("double").alias("y")
    )
    return points.dropna(subset=["ds", "y"])


def quarter_points(frame: DataFrame) -> DataFrame:
    """One point per series and quarter: the mean over product names, and how many.

    A series then has no more points than there are quarters, whatever its data.
    """
    return frame.groupBy(*SERIES, "ds").agg(F.avg("y").alias("y"), F.count("y").alias("rows"))


def _fits(points: DataFrame) -> DataFrame:
    """Trend, seasonal indices and residual deviation, one row per series of ``MIN_POINTS`` rows or more.

    Shorter series have no forecast, so they go before anything is fitted. A season seen once
    would fit itself, so only one seen twice has an index of its own. The squared residuals are
    divided by the points less the fitted parameters; where none are left the deviation is null.
    Windows and the last aggregation share one exchange on the series keys.
    """
    series = Window.partitionBy(*SERIES)
    season = Window.partitionBy(*SERIES, "season")
    enough = points.withColumn("points", F.sum("rows").over(series)).where(F.col("points") >= MIN_POINTS)
    timed = enough.withColumns({"t": quarter_index(F.col("ds")), "season": F.quarter("ds")})
    trended = timed.withColumns({
        "slope": F.coalesce(F.regr_slope("y", "t").over(series), F.lit(0.0)),
        "mean_t": F.avg("t").over(series),
        "mean_y": F.avg("y").over(series),
        "level": F.avg(F.abs("y")).over(series),
    }).withColumn("base", F.col("mean_y") + F.col("slope") * (F.col("t") - F.col("mean_t")))
    usable = F.when(F.col("base") > F.col("level") * TREND_FLOOR, F.col("y") / F.col("base"))
    seasonal = trended.withColumn("seen", F.count(usable).over(season)).withColumn(
        "index", F.when(F.col("seen") > 1, F.avg(usable).over(season)).otherwise(1.0)
    )
    own_season = [F.max(F.when((F.col("season") == s) & (F.col("seen") > 1), 1).otherwise(0)) for s in range(1, 5)]
    residual = F.col("y") - F.col("base") * F.col("index")
    indices = [
        F.max(F.when(F.col("season") == s, F.col("index"))).alias(f"index_{s}") for s in range(1, 5)
    ]
    return seasonal.groupBy(*SERIES).agg(
        F.first("points").alias("points"),
        F.max("ds").alias("last"),
        F.first("slope").alias("slope"),
        F.first("mean_t").alias("mean_t"),
        F.first("mean_y").alias("mean_y"),
        F.count(F.lit(1)).alias("quarters"),
        (F.var_pop("t") * F.count("t")).alias("spread"),
        F.sum(residual * residual).alias("squares"),
        sum(own_season[1:], own_season[0]).alias("seasons"),
        *indices,
    ).withColumn("left", F.col("quarters") - F.least("quarters", F.lit(2)) - F.col("seasons")).withColumn(
        "deviation", F.when(F.col("left") > 0, F.sqrt(F.col("squares") / F.col("left")))
    )


def _periods(horizon: int) -> Column:
    """Steps to forecast; a series that is too short gets one row without a step."""
    steps = F.sequence(F.lit(1), F.lit(horizon))
    return F.when(F.col("points") >= MIN_POINTS, steps).otherwise(
        F.array(F.lit(None).cast("int"))
    )


def _named(rows: DataFrame, metric: str) -> DataFrame:
    renamed = rows.withColumns({
        "ndc11": F.col("ndc11_normalized"),
        "product_name": F.col("product_name_fda10"),
        "metric": F.lit(metric),
    })
    return renamed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FORECAST_SCHEMA])


def _chosen(universe: DataFrame) -> DataFrame:
    return universe.select(*SERIES, "product_name_fda10")


def forecast_seasonal_trend(
    frame: DataFrame, universe: DataFrame, metric: str = "spend", horizon: int = HORIZON
) -> DataFrame:
    """Forecast every chosen series; one row with an error for those too short.

    MIN_POINTS counts rows, as product names of a quarter do; bounds are null where a series has
    too few quarters to tell its noise.
    """
    fits = attach(_chosen(universe), _fits(quarter_points(frame)), SERIES)
    steps = fits.withColumn("forecast_period", F.explode(_periods(horizon)))
    step = F.col("forecast_period")
    next_start = next_quarter_start(F.col("last"), step)
    season = F.quarter(next_start)
    index = F.coalesce(
        *[F.when(season == s, F.col(f"index_{s}")) for s in range(1, 5)], F.lit(1.0)
    )
    away = quarter_index(next_start) - F.col("mean_t")
    value = (F.col("mean_y") + F.col("slope") * away) * index
    tilt = F.when(F.col("spread") > 0, away * away / F.col("spread")).otherwise(0.0)
    margin = F.col("deviation") * BAND * F.sqrt(1 + 1 / F.col("quarters") + tilt)
    known = step.isNotNull()
    return _named(
        steps.withColumns({
            "forecast_date": calendar_quarter_end(F.col("last"), step),
            "forecast_quarter_start": next_start,
            "forecast_value": F.when(known, value),
            "forecast_lower": F.when(known, value - margin),
            "forecast_upper": F.when(known, value + margin),
            "error": F.when(~known, TOO_SHORT),
        }),
        metric,
    )


def run_batch_forecasts(
    history: DataFrame, universe: DataFrame, metric: str = "spend", model: Model | None = None
) -> DataFrame:
    """Forecasts of a metric for a universe, by the built-in model or a given one."""
    frame = series_frame(history, universe, metric)
    if model is None:
        return forecast_seasonal_trend(frame, universe, metric)
    return forecast_with(frame, universe, model, metric)


def forecast_dates(history: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """The quarter ends after the last observation of each series."""
    last = history.groupBy(*SERIES).agg(F.max("quarter_start").alias("last_quarter"))
    steps = last.withColumn("forecast_period", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    step = F.col("forecast_period")
    return steps.withColumns({
        "forecast_date": calendar_quarter_end(F.col("last_quarter"), step),
        "forecast_quarter_start": next_quarter_start(F.col("last_quarter"), step),
    })


_MODEL_SCHEMA = T.StructType([
    *[T.StructField(k, T.StringType()) for k in SERIES],
    T.StructField("last", T.DateType()),
    T.StructField("forecast_period", T.IntegerType()),
    T.StructField("forecast_value", T.DoubleType()),
    T.StructField("forecast_lower", T.DoubleType()),
    T.StructField("forecast_upper", T.DoubleType()),
    T.StructField("error", T.StringType()),
])


def _guarded(model: Model, horizon: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Run a model on one series; what it raises or fails to give is the series' error row."""
    wanted = ("yhat", "yhat_lower", "yhat_upper")

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        points = group.sort_values("ds", ignore_index=True)
        steps, values, error = [None], [[None]] * 3, None
        try:
            if points["rows"].sum() < MIN_POINTS:
                raise ValueError(TOO_SHORT)
            history = points[["ds", "y"]].assign(ds=pd.to_datetime(points["ds"]))
            result = model(history, horizon)
            if missing := [c for c in wanted if c not in result]:
                raise ValueError(f"the model gave no {', '.join(missing)}")
            if len(result) != horizon:
                raise ValueError(f"the model gave {len(result)} steps of {horizon}")
            values = [result[c].astype("float64").to_list() for c in wanted]
            steps = list(range(1, horizon + 1))
        except Exception as failure:  # noqa: BLE001 - any failure belongs to its series
            error = str(failure) or type(failure).__name__
        last = points["ds"].iloc[-1]
        columns = [[fixed] * len(steps) for fixed in (*key, last)]
        columns += [pd.array(steps, "Int32"), *[pd.Series(v, dtype="float64") for v in values]]
        columns += [[error] * len(steps)]
        return pd.DataFrame(dict(zip(_MODEL_SCHEMA.names, columns)))

    return run


def forecast_with(
    frame: DataFrame,
    universe: DataFrame,
    model: Model,
    metric: str = "spend",
    horizon: int = HORIZON,
) -> DataFrame:
    """Forecast with a pandas model that maps (ds, y) points to yhat, yhat_lower, yhat_upper.

    Groups run on the executors and hold one point per quarter, ``ds`` as timestamps. A series
    whose model raises, or gives other columns, another number of steps or no numbers, has one
    row with its error and leaves the others alone.
    """
    points = quarter_points(frame)
    results = points.groupBy(*SERIES).applyInPandas(_guarded(model, horizon), _MODEL_SCHEMA)
    rows = attach(_chosen(universe), results, SERIES)
    step = F.col("forecast_period")
    missing = F.col("last").isNull()
    return _named(
        rows.withColumns({
            "forecast_date": calendar_quarter_end(F.col("last"), step),
            "forecast_quarter_start": next_quarter_start(F.col("last"), step),
            "error": F.when(missing, TOO_SHORT).otherwise(F.col("error")),
        }),
        metric,
    )
