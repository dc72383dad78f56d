"""The operators as registered queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf, decontaminate, maxscore, mixing, negatives, pieces, quality, repeats, ring, runs, secrets, simhash, warc
from .common import prepare


#: Shards of op10; a public tokenizer's model, read on the driver.
SHARDS, TOKENIZER = 24, "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def _remainder(n: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    labels = _table(spark, folder, "labels").where(_remainder(5) != 0)
    weights = quality.fit(docs, labels.select("doc_id", F.col("quality").cast("int").alias("label")))
    return quality.scored(docs, weights).select(
        "doc_id", (_remainder(5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op3_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.digests(_table(spark, folder, "documents"))


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = crf.fit(docs.where(_remainder(4) != 2))
    return crf.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score"
    )


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(
        _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    )


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return secrets.find(docs, secrets.fit(docs))


def op7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return pieces.encoded(docs, pieces.load(TOKENIZER))


def op8_maxscore(spark: SparkSession, folder: str) -> DataFrame:
    vectors = maxscore.quantised(_table(spark, folder, "embeddings"))
    return maxscore.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(_table(spark, folder, "pages"))


def op10_ring(spark: SparkSession, folder: str) -> DataFrame:
    return ring.shard(_table(spark, folder, "documents"), SHARDS).withColumns(
        {"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}
    )


def op11_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    vectors = negatives.quantised(rows.withColumn("label", moved))
    return negatives.mine(vectors, vectors.where("vec_id % 100 = 0"))


def op12_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.detect(_table(spark, folder, "documents"), change=runs.planted)


def op13_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_repeats": op3_repeats,
    "op4_language": op4_language,
    "op5_decontaminate": op5_decontaminate,
    "op6_secrets": op6_secrets,
    "op7_pieces": op7_pieces,
    "op8_maxscore": op8_maxscore,
    "op9_warc": op9_warc,
    "op10_ring": op10_ring,
    "op11_negatives": op11_negatives,
    "op12_runs": op12_runs,
    "op13_mixing": op13_mixing,
}

_CAPITALS = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _CAPITALS.format("text") + r", '[0-9a-z\x{80}-\x{10FFFF}]+')"
_SHINGLES = "list_distinct(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' ')))"

ORACLES: dict[str, str] = {
    "op5_decontaminate": f"""
        WITH item_words AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
        items AS (SELECT row_number() OVER () AS item_row, item_id, ws, least(5, len(ws)) AS k
                  FROM item_words WHERE len(ws) > 0),
        item_grams AS (SELECT item_row, item_id, k, {_SHINGLES} AS grams FROM items),
        item_gram AS (SELECT item_row, item_id, k, len(grams) AS shingles, unnest(grams) AS gram
                      FROM item_grams),
        docs AS (SELECT row_number() OVER () AS doc_row, doc_id, {_WORDS} AS ws FROM documents),
        doc_gram AS (SELECT doc_row, doc_id, k, unnest({_SHINGLES}) AS gram
                     FROM docs, (SELECT DISTINCT k FROM items) WHERE len(ws) >= k),
        hits AS (SELECT doc_row, doc_id, item_row, item_id, shingles, count(*) AS shared
                 FROM doc_gram JOIN item_gram USING (k, gram) GROUP BY ALL)
        SELECT doc_id, item_id, shared::INTEGER AS shared, shingles::INTEGER AS shingles,
               shared / shingles AS containment
        FROM hits WHERE shared >= ceil(0.8 * shingles - 1e-9)
    """,
    "op8_maxscore": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
            FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) a
            JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
        ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)
                   ::INTEGER AS rank, vec_id, score
            FROM scored)
        SELECT * FROM ranked WHERE rank <= 5
    """,
    "op9_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS n
            FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
               CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END
                   AS record_type,
               CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM f
    """,
    "op11_negatives": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q,
                   CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                   list_dot_product(a.q, b.q)::BIGINT AS score
            FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0) a
            JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
        positive AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id,
               (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM positive JOIN scored USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        QUALIFY rank <= 5
    """,
}
