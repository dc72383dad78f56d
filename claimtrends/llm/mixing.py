"""Mixing sources to target weights by capped water-filling.

Every source asks for its weight's share of all words. A source that would be read more often
than ``epochs`` times is clamped there, and what it leaves is shared out again by the weights of
the others, until no source is above. A target of, say, 2.4 times a source's words is two whole
repetitions of every document and a seeded sample of documents with four tenths of the words.

Which documents the sample holds follows from a seeded hash of each: those below a threshold. The
threshold is found by cutting the hashes of a source into cells and going on in the cell where
the words run out, so a source of any size only sends sums of cells. The last cell holds a few
documents, which are taken in the order of their hashes where they still fit.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages

#: Weights of the sources in order, repeating, and repetitions at most.
WEIGHTS, EPOCHS = (5, 2, 1), 3
#: Documents of a source's last cell at most, and the documents a new cell should hold.
CELL, AIM = 256, 128
_LEAST, _MOST = -(2**63), 2**63 - 1


def _numbered(sources: DataFrame, stages: Stages) -> DataFrame:
    """``sources`` with ``place``, from 0: by code point, null last.

    A range sort deals them out, and places within a part are offset by the parts before.
    """
    order = [F.col("source").isNull(), F.col("source")]
    parts = sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    parts = stages.save(parts, "sources")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(before, F.lit(0)).alias("offset")
    )
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    placed = parts.withColumn("own", own).join(offsets, "part")
    return placed.withColumn("place", F.col("own") + F.col("offset")).drop("own", "offset", "part")


def water_level(sources: DataFrame, epochs: int = EPOCHS) -> Fraction:
    """Words per unit of weight that unclamped sources get; ``sources`` has words and weight.

    Each round is one sum over the sources: those that the level of the round before clamps give
    their most, the others share the rest. Rounds end when no further source is clamped.
    """
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    total = sources.agg(F.sum("words").alias("t")).first().t or 0
    level = None
    while True:
        if level is None:
            clamped = F.lit(False)
        else:
            clamped = whole("words") * F.lit(epochs * level.denominator).cast("decimal(20,0)") < (
                whole("weight") * F.lit(level.numerator).cast("decimal(20,0)"))
        found = sources.agg(
            F.sum(F.when(clamped, whole("words") * epochs)).alias("given"),
            F.sum(F.when(~clamped, F.col("weight"))).alias("open"),
        ).first()
        if not found.open:
            return level or Fraction(0)
        new = Fraction(total - int(found.given or 0), int(found.open))
        if new == level:
            return level
        level = new


def targets(sources: DataFrame, stages: Stages, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, words, docs, target, times, rest): ``rest`` words of one more repetition."""
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    placed = _numbered(sources, stages).withColumn(
        "weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int"))
    )
    placed = stages.save(placed.drop("place"), "weights")
    level = water_level(placed, epochs)
    share = F.col("weight") * F.lit(float(level.numerator)) / F.lit(float(level.denominator))
    target = F.least(share, F.col("words") * F.lit(float(epochs)))
    return placed.withColumn("target", target).withColumn(
        "times", F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("long")
    ).withColumn(
        "rest", F.round(F.col("target") - F.col("times") * F.col("words")).cast("long")
    ).select("source", "words", "docs", "target", "times", "rest")


def _inside() -> Column:
    return F.col("h").between(F.col("lo"), F.col("hi")) & F.col("g").between(F.col("lo2"), F.col("hi2"))


def _narrow(rows: DataFrame, cells: DataFrame, stages: Stages, key: str, low: str, high: str) -> DataFrame:
    """Cells of at most CELL documents, or of one value of ``key``, around each source's threshold."""
    cells, round_ = cells.withColumn("shift", F.lit(64)), 0
    while True:
        cells = stages.save(cells, f"cells-{key}{round_}")
        wide = (F.col("n") > CELL) & (F.col("shift") > 0)
        if cells.where(wide).isEmpty():
            return cells.drop("shift")
        bits = F.least(F.lit(10), F.ceil(F.log2(F.col("n") / AIM)).cast("int"), F.col("shift"))
        finer = cells.where(wide).withColumn("shift", F.col("shift") - bits)
        cut = rows.join(finer, F.col("source").eqNullSafe(F.col("owner"))).where(_inside())
        cut = cut.groupBy("owner", F.expr(f"shiftright({key}, shift)").alias("part")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("count"))
        own = Window.partitionBy("owner").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        cut = cut.withColumn("before", F.sum("words").over(own) - F.col("words")).select(
            F.col("owner").alias("of"), "part", "words", "count", "before")
        hit = finer.join(cut, F.col("owner").eqNullSafe(F.col("of"))).where(
            (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        hit = hit.withColumns({
            low: F.expr("shiftleft(part, shift)"), "n": F.col("count"), "rest": F.col("rest") - F.col("before"),
        }).withColumn(high, F.expr(f"{low} + (shiftleft(1L, shift) - 1)"))
        cells = cells.where(~wide).unionByName(hit.select(*cells.columns))
        round_ += 1


def _fitting(cell: pd.DataFrame) -> pd.DataFrame:
    """Documents of one cell in the order of their hashes, where the words left allow.

    Then the one that comes nearest is added, or put in place of one taken, if that comes nearer.
    """
    cell = cell.sort_values(["h", "g"], kind="stable", ignore_index=True)
    size, rest = cell["size"].to_numpy(), int(cell["rest"].iloc[0])
    more = np.zeros(len(size), np.int64)
    for i, n in enumerate(size.tolist()):
        if n <= rest:
            more[i], rest = 1, rest - n
    out, held = np.flatnonzero(more == 0), np.concatenate([[-1], np.flatnonzero(more)])
    if len(out) and rest:
        gain = size[out][:, None] - np.where(held < 0, 0, size[held])
        add, drop = np.unravel_index(np.abs(gain - rest).argmin(), gain.shape)
        if abs(gain[add, drop] - rest) < rest:
            more[out[add]] = 1
            if drop:
                more[held[drop]] = 0
    cell["taken"] = (cell["times"] + more) * size
    return cell


def mix(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: int = 13,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and taken.

    size counts words, runs of other characters than ASCII white space; taken is size times the
    repetitions of the document, which differ by one at most within a source and are never more
    than ``epochs``. The words taken of a source miss its target by half of the smallest document that
    is left in its last cell at most, mostly by a few words. Null and empty texts have size 0 and
    take nothing; a null source is a source, the last. Repeated rows are documents of their own,
    told apart by their place in the stored table, so a row that a third of the table repeats
    is taken as often as needed. Which of equal rows is taken does not matter, so reruns agree.
    Other columns are not looked at; an empty table gives an empty result.
    """
    spark, stages = docs.sparkSession, Stages(docs.sparkSession, "mixing")
    kind = docs.schema[id_col].dataType.simpleString()
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), body).alias("h"),
        F.xxhash64(F.monotonically_increasing_id()).alias("g"),
    )
    slim = stages.save(slim, "sizes")
    sources = slim.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
    plan = stages.save(targets(sources, stages, weights, epochs), "targets")
    cells = plan.select(
        F.col("source").alias("owner"), F.col("words").alias("source_size"), "target", "times", "rest",
        F.col("docs").alias("n"), *[F.lit(v).cast("long").alias(c) for c, v in
                                   (("lo", _LEAST), ("hi", _MOST), ("lo2", _LEAST), ("hi2", _MOST))],
    )
    # a source that takes no part of a repetition has no cell to look into
    idle = F.col("rest") == 0
    cells = cells.withColumns({"n": F.when(idle, 0).otherwise(F.col("n")), "hi": F.when(idle, F.col("lo")).otherwise(F.col("hi")),
                               "hi2": F.when(idle, F.col("lo2")).otherwise(F.col("hi2"))})
    cells = _narrow(slim, cells, stages, "h", "lo", "hi")
    cells = _narrow(slim, cells, stages, "g", "lo2", "hi2")
    rows = slim.join(cells, F.col("source").eqNullSafe(F.col("owner"))).drop("owner", "n")
    below = (F.col("h") < F.col("lo")) | ((F.col("h") <= F.col("hi")) & (F.col("g") < F.col("lo2")))
    names = ["doc_id", "source", "size", "source_size", "target", "taken"]
    clear = rows.where(~_inside()).withColumn(
        "taken", F.col("size") * (F.col("times") + F.when(below, 1).otherwise(0)))
    open_ = rows.where(_inside()).select("doc_id", "source", "size", "source_size", "target", "times", "rest", "h", "g")
    schema = (f"doc_id {kind}, source string, size long, source_size long, target double, times long, rest long,"
              " h long, g long, taken long")
    fitted = open_.groupBy("source").applyInPandas(_fitting, schema)
    return clear.select(*names).unionByName(fitted.select(*names))
