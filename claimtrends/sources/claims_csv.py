"""CSV folders whose files may differ in their headers."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.canonical import apply_schema, detect_columns

HEADER_READERS = 32


def _list_csv(spark: SparkSession, folder: str) -> list[str]:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv")
    try:
        # This lists the folder without a job; the names come as URIs.
        paths = [unquote(path) for path in files.load(folder).inputFiles()]
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"folder {folder} not found") from error
        raise
    if not paths:
        raise FileNotFoundError(f"no CSV files in {folder}")
    return sorted(paths)


def _open_quotes(line: str) -> bool:
    """Whether a quote is still open at the end of a line."""
    return line.replace('\\"', "").count('"') % 2 == 1


def _first_record(spark: SparkSession, path: str) -> str | None:
    """The first record with any text, straight from the file system; None if there is none.

    It goes on over line breaks within quotes, a thousand lines at most.
    """
    java, target = spark._jvm.java, spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = java.io.BufferedReader(java.io.InputStreamReader(files.open(target), "UTF-8"))
    try:
        while (line := reader.readLine()) is not None and not line.strip():
            pass
        lines = [line]
        while line is not None and len(lines) < 1_000 and _open_quotes("\n".join(lines)):
            if (line := reader.readLine()) is not None:
                lines.append(line)
        return None if lines[0] is None else "\n".join(lines)
    finally:
        reader.close()


def _header(spark: SparkSession, path: str, multiline: bool = False) -> tuple[str, ...]:
    reader = spark.read.option("header", True).option("multiLine", multiline)
    return tuple(reader.csv(path).columns)


Group = tuple[tuple[str, ...], bool]


def _groups(spark: SparkSession, paths: list[str], broken: set[str] = frozenset()) -> dict[Group, list[str]]:
    """Files by header and by whether their records may hold line breaks, as those ``broken`` do."""
    firsts: dict[tuple[str, bool], list[str]] = {}
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        for path, first in zip(paths, pool.map(lambda path: _first_record(spark, path), paths)):
            if first is not None:  # an empty file has none
                firsts.setdefault((first, "\n" in first or path in broken), []).append(path)
    groups: dict[Group, list[str]] = {}
    for (_, multiline), members in firsts.items():  # Spark splits each distinct header once
        header = _header(spark, members[0], multiline)
        groups.setdefault((header, multiline), []).extend(members)
    return groups


def _scan(spark: SparkSession, group: Group, paths: list[str], *more: str, **options: object) -> DataFrame:
    """One all-text scan of the files that share a header."""
    header, multiline = group
    schema = ", ".join([*[f"`{name.replace('`', '``')}` STRING" for name in header], *more])
    reader = spark.read.schema(schema).option("header", True).option("multiLine", multiline)
    return reader.options(**options).csv(paths)


def _scans(spark: SparkSession, paths: list[str], uniform: bool) -> list[DataFrame]:
    """One all-text scan per distinct header, however many files share it."""
    groups = {(_header(spark, paths[0]), False): paths} if uniform else _groups(spark, paths)
    if not any(header for header, _ in groups):
        raise FileNotFoundError(f"no CSV headers in {paths[0].rpartition('/')[0]}")
    options = {"enforceSchema": False} if uniform else {}
    return [_scan(spark, group, members, **options) for group, members in groups.items()]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_raw_csvs(spark: SparkSession, folder: str, uniform: bool = False) -> DataFrame:
    """All ``*.csv`` files of a folder as text columns, united by column name.

    Only the first record of each file is read to learn its header, without a job for it; jobs
    grow with the number of distinct headers. With ``uniform`` the first file speaks for all,
    and Spark raises while scanning if another one differs. Records with a field too few or too
    many are filled and cut, as Spark does; ``read_checked_claims`` sets them apart.
    """
    return _union(_scans(spark, _list_csv(spark, folder), uniform))


def read_claims(spark: SparkSession, folder: str, uniform: bool = False) -> DataFrame:
    """The folder in canonical columns, each header mapped on its own before the union."""
    return read_claim_files(spark, _list_csv(spark, folder), uniform)


def read_claim_files(spark: SparkSession, paths: list[str], uniform: bool = False) -> DataFrame:
    """``read_claims`` of given files."""
    return _union([
        apply_schema(scan, detect_columns(scan.columns)) for scan in _scans(spark, paths, uniform)
    ])


@dataclass(frozen=True)
class CheckedClaims:
    """Claims of whole records, and the records that are broken.

    ``quarantine`` has a row for each: ``file``, ``block_start`` (the byte at which the part of
    the file starts in which it lies), ``record`` (its number in that part, from 1, the header
    not counted), ``fields`` (how many the header asks for) and ``raw``, the record as it stands.
    """

    claims: DataFrame
    quarantine: DataFrame


_BROKEN = "_broken_record"


def _multiline_files(spark: SparkSession, paths: list[str]) -> set[str]:
    """Files in which a quote is open at the end of some line; one pass over the text."""
    line = F.replace(F.col("value"), F.lit('\\"'), F.lit(""))
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    lines = spark.read.text(paths).where(quotes % 2 == 1)
    found = lines.select(F.col("_metadata.file_path").alias("path")).distinct().collect()
    names = {_plain(unquote(r.path)) for r in found}
    return {path for path in paths if _plain(path) in names}


def _plain(path: str) -> str:
    """A path with one slash after its scheme, as Spark writes it either way."""
    return re.sub(r"^(\w+):/+", r"\1:/", path)


def _any_value(scan: DataFrame) -> Column:
    """True for every row. Spark refuses to read the column of broken records alone."""
    first = F.col(f"`{scan.columns[0].replace('`', '``')}`")
    return first.isNull() | (F.length(first) >= 0)


def _placed(scan: DataFrame, fields: int) -> DataFrame:
    """The broken records of a scan with their places.

    A task reads a part of a file from its start to its end, so a record's number is its distance
    from the part's first one. Only that is looked up: records that are whole are not moved.
    """
    part = ["file", "block_start"]
    rows = scan.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("place"), F.when(_any_value(scan), F.col(_BROKEN)).alias("raw"),
    )
    firsts = rows.groupBy(*part).agg(F.min("place").alias("first"), F.count("raw").alias("broken"))
    firsts = firsts.where(F.col("broken") > 0).drop("broken")
    return rows.where(F.col("raw").isNotNull()).join(firsts, part).select(
        *part, (F.col("place") - F.col("first") + 1).alias("record"), F.lit(fields).alias("fields"), "raw"
    )


def read_checked_claims(spark: SparkSession, folder: str) -> CheckedClaims:
    """The folder in canonical columns, with broken records set apart instead of filled or cut.

    A record is broken if it has another number of fields than its file's header; each record of
    the files is in one of the two tables. Line breaks within quotes belong to their record: one
    pass over the text finds the files that have any, and only these are read whole by a task each,
    all others are split as usual. Blank lines are no records.
    """
    paths = _list_csv(spark, folder)
    groups = _groups(spark, paths, _multiline_files(spark, paths))
    if not any(header for header, _ in groups):
        raise FileNotFoundError(f"no CSV headers in {folder}")
    claims, broken = [], []
    for group, members in groups.items():
        scan = _scan(spark, group, members, f"`{_BROKEN}` STRING", columnNameOfCorruptRecord=_BROKEN, columnPruning=False)
        whole = scan.where(F.col(_BROKEN).isNull() & _any_value(scan))
        claims.append(apply_schema(whole, detect_columns(group[0])))
        broken.append(_placed(scan, len(group[0])))
    return CheckedClaims(_union(claims), reduce(DataFrame.unionByName, broken))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
