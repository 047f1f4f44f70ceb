"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Every stage but the last returns the columns of its input. Rows are matched with a stage's decisions by id and
text, so rows that share an id are judged each for itself; where one of them has to stay (near
duplicates), it is the one with the smallest text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from incidentlens.llm import bpe, decontaminate, ngram_join, pii, quality_lm
from incidentlens.llm.tables import bounded_broadcast, scratch, table, workspace

RANKS = "byte_bpe_50k.tiktoken"


def _without(docs: DataFrame, rows: DataFrame, ws) -> DataFrame:
    """``docs`` without those whose id and text number are in ``rows``; all columns and other rows stay."""
    out = ws.save(rows.select("doc_id", "text_key").distinct(), "out")
    left = docs.alias("d")
    right = bounded_broadcast(out.df, out.rows, 64).alias("o")
    same = F.expr("d.doc_id <=> o.doc_id AND xxhash64(d.text) = o.text_key")
    return left.join(right, same, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an unlikely perplexity for their language go."""
    judged = quality_lm.classify(docs, table(spark, sf_dir, "labels"))
    return _without(docs, judged.filter("NOT kept"), workspace(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest id stays."""
    ws = workspace(docs)
    found = ws.write(ngram_join.similar_components(docs), "components").filter("doc_id IS NOT NULL")
    gone = ws.save(found.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    several = ws.save(
        found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"),
        "several",
    )
    kept = docs.join(bounded_broadcast(gone.df, gone.rows, 64), "doc_id", "left_anti").select(*docs.columns)
    if not several.rows:
        return kept
    ids = bounded_broadcast(several.df, several.rows, 64)
    single = kept.join(ids, "doc_id", "left_anti").select(*docs.columns)
    order = Window.partitionBy("doc_id").orderBy(*[F.col(c) for c in dict.fromkeys(["text", *docs.columns])])
    rank = "rank"
    while rank in docs.columns:
        rank += "_"
    ranked = kept.join(ids, "doc_id", "left_semi").select(*docs.columns, F.row_number().over(order).alias(rank))
    return single.unionByName(ranked.filter(F.col(rank) == 1).drop(rank))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go."""
    judged = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, judged.filter("contaminated"), workspace(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; ``n_chars`` follows the text."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of what they decode to."""
    path = public_tokenizers.path(RANKS)
    return bpe.round_trip(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        "token_ids",
        F.sha2(bpe.ids_text().cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("byte-level BPE", tokens),
]

# The stages' models and components cannot be put into one SQL text; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = table(spark, sf_dir, "documents"), workspace(spark)
    for number, (_, stage) in enumerate(STAGES):
        with scratch():  # what a stage has written goes once its result is
            docs = ws.write(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
