"""Key figures of any chosen states and quarters from stored bitmaps of drug codes.

A distinct count of a subset is not a sum of its parts' counts. Here each drug code has a small
number, and each state and quarter keeps bitmaps of its codes (4 KB for 32,768 codes, only where
there are any) beside its spend. Bitmaps combine by OR, so any subset is counted exactly without
reading aggregates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpoint_table
from .joins import attach

CODE = "ndc11_normalized"
CELL = ("state", "quarter_start")


@dataclass(frozen=True)
class Subset:
    """Chosen states and quarters; without states, or without a bound, all of them."""

    states: Sequence[str] = ()
    first: date | None = None
    last: date | None = None


def code_numbers(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Codes numbered from 1 without gaps; ``known`` codes keep their numbers and new ones follow.

    Null codes have none, as a distinct count passes over them. New codes are numbered in order
    by a distributed sort: a code's place in its task plus the codes of the tasks before.
    """
    codes = df.select(CODE).where(F.col(CODE).isNotNull()).distinct()
    start = F.lit(0).cast("long")
    if known is not None:
        codes = codes.join(known.select(CODE), CODE, "left_anti")
        start = F.coalesce(known.agg(F.max("number").alias("n")).scalar(), start)
    placed = codes.orderBy(CODE).withColumn("__id", F.monotonically_increasing_id())
    stored = checkpoint_table(placed, "codes").withColumn("__task", F.shiftright("__id", 33))
    # one row a task of the sort
    tasks = stored.groupBy("__task").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    within = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = stored.join(tasks, "__task").select(
        CODE, (start + F.col("__before") + within + 1).alias("number")
    )
    return numbered if known is None else known.select(CODE, "number").unionByName(numbered)


def kpi_cells(df: DataFrame, numbers: DataFrame) -> DataFrame:
    """Per state, quarter and block of 32,768 numbers: bitmap, spend and number of rows.

    Rows without a code are a block of their own, null, whose bitmap is empty.
    """
    rows = attach(df.select(*CELL, CODE, "total_spend"), numbers, (CODE,))
    number = F.col("number")
    return rows.groupBy(*CELL, F.bitmap_bucket_number(number).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("codes"),
        F.sum("total_spend").alias("spend"), F.count(F.lit(1)).alias("rows"),
    )


def merge_cells(cells: DataFrame, more: DataFrame) -> DataFrame:
    """Cells of two disjoint sets of rows, numbered alike, as one table of cells."""
    return cells.unionByName(more).groupBy(*CELL, "block").agg(
        F.bitmap_or_agg("codes").alias("codes"), F.sum("spend").alias("spend"), F.sum("rows").alias("rows"),
    )


def _holds(subset: Subset):
    tests = [F.lit(True)]
    if subset.states:
        tests.append(F.col("state").isin(list(subset.states)))
    if subset.first is not None:
        tests.append(F.col("quarter_start") >= F.lit(subset.first))
    if subset.last is not None:
        tests.append(F.col("quarter_start") <= F.lit(subset.last))
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def kpi_of(cells: DataFrame, subsets: Mapping[str, Subset]) -> DataFrame:
    """The key figures of each named subset, one row each, in one pass over the cells.

    They are those of ``kpi_summary`` of the chosen rows; a subset without rows has zero counts and
    null figures. A null state or quarter is in a subset only where that does not ask for any.
    """
    spark = cells.sparkSession
    named = [F.when(_holds(s), F.lit(name)) for name, s in subsets.items()]
    member = F.explode(F.array_compact(F.array(*named))).alias("subset")
    chosen = cells.select(member, "*")
    blocks = chosen.groupBy("subset", "block").agg(F.bitmap_count(F.bitmap_or_agg("codes")).alias("n"))
    drugs = blocks.groupBy("subset").agg(F.sum("n").alias("unique_drugs"))
    states = chosen.groupBy("subset", "state").agg(
        F.sum("spend").alias("spend"), F.max("quarter_start").alias("latest"))
    totals = states.groupBy("subset").agg(
        F.sum("spend").alias("total_spend"), F.count("state").alias("states"),
        F.max("latest").alias("latest_quarter"),
    )
    wanted = spark.createDataFrame([(name,) for name in subsets], "subset string")
    out = wanted.join(totals, "subset", "left").join(drugs, "subset", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "subset", "total_spend", F.coalesce("unique_drugs", zero).alias("unique_drugs"),
        F.coalesce("states", zero).alias("states"), "latest_quarter",
        F.date_format("latest_quarter", "yyyy-MM").alias("latest_month"),
    )
