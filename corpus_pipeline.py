"""A corpus pipeline over ``documents``; each stage is stored and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimtrends.llm import crf, decontaminate, pieces, secrets, simhash
from claimtrends.llm.common import Stages, prepare

#: A document is rejected where the largest posteriors of its words have a lower mean.
LEAST_CERTAINTY = 0.5
#: A public tokenizer's model, read on the driver.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or a clear language go; a missing ``lang`` is filled in.

    A word is as clear as its likeliest language is; a document stays from a mean of
    LEAST_CERTAINTY on, however many languages its words share. Where no row has a ``lang`` there
    is no model: then every document with a letter stays, and ``lang`` stays null.
    """
    prepare(spark)
    model = crf.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = ("_lang", "_score", "_certainty")
    found = crf.identify(docs, model, names=names[:2], certainty=names[2])
    found = found.where((F.col("_lang") != crf.UNKNOWN) & (F.col("_certainty") >= LEAST_CERTAINTY))
    return found.withColumn("lang", F.coalesce("lang", "_lang")).drop(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest id, then the smallest md5.

    Groups are those of the SimHash operator, 64 bits over shingles of three words, linked at three
    differing bits or fewer. Null texts and texts without words have fingerprint zero and are one group;
    a null id comes after all others, and rows equal in id and text are one document.
    """
    prepare(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go."""
    prepare(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced; ``n_chars`` follows."""
    prepare(spark)
    return secrets.redact(docs, secrets.fit(docs)).withColumn("n_chars", F.length("text").cast("long"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids in place of the text."""
    prepare(spark)
    return pieces.encoded(docs, pieces.load(TOKENIZER))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("redaction", redaction),
    ("encoding", encoding),
]

#: Models and hashes of the stages are beyond SQL; a test holds them against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    stages = Stages(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = stages.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
