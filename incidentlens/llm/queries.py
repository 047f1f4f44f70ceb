"""The contract's queries: thin, each over its whole table, each through its operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens.llm import bpe, chat, decontaminate, hard_negatives, line_rules, merkle, minhash, ngram_join, oracle, pii, quality_lm, substring, toxicity, url_filter
from incidentlens.llm.tables import table

RANKS = "byte_bpe_50k.tiktoken"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(bpe.ids_text().cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    return chat.digest_conversations(chat.format_conversations(rows.unionByName(extra)))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_lm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    each = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return found.select("doc_id", "lang", "units", "log_ppl", "perplexity", "kept", each).drop("copy")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents")).drop("redacted")

    def counted(kind: str):
        return F.size(F.filter("found", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(spans):
        text = F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string")))
        return F.array_join(text, ",")

    base = F.filter("found", lambda s: s.kind.isin(*pii.BASE_KINDS))
    return found.select(
        "doc_id",
        *[counted(kind) for kind in pii.BASE_KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean_lines(table(spark, sf_dir, "documents")).drop("cleaned")


URL_RULES = (
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


MANIFEST_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
AZ, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*MANIFEST_COLUMNS)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    now = docs.select(
        *MANIFEST_COLUMNS, F.when(tampered, F.translate("text", AZ, SMALL)).otherwise(F.col("text")).alias("text_now")
    )
    leaf_now = merkle.leaf_digest(*MANIFEST_COLUMNS[:-1], "text_now")
    found = merkle.manifest(now, MANIFEST_COLUMNS, "lang", "doc_id", carry={"leaf_now": leaf_now})
    proof = F.array_join(F.transform(merkle.proof_digests(F.col("steps")), merkle.hexed), "")
    return merkle.verify(found, F.col("leaf_now")).select(
        "doc_id",
        *[merkle.hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(proof.cast("binary"), 256).alias("proof_sha256"),
        merkle.hexed(F.col("folded_root")).alias("folded_root"),
        "verified",
    )


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding"
    )
    return hard_negatives.mine(rows, F.col("id") % 50 == 0)


QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_byte_bpe, op3_toxicity, op4_ngram_join, op5_chat_format, op6_substring, op7_quality, op8_pii, op9_line_rules, op10_url_filter,
    op11_merkle, op12_minhash, op13_hard_negatives,
)}
ORACLE: dict[str, str] = oracle.STATEMENTS
