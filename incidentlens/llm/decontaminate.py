"""Benchmark decontamination by winnowing. Native.

Every WINDOW consecutive words hold WINDOW - GRAM + 1 word GRAM-grams; the smallest hash of each such
stretch is kept as a fingerprint. Two texts that share WINDOW words keep the same smallest hash there,
so joining fingerprints misses no shared window. Documents that share a fingerprint are candidates;
in them, the windows around each shared gram are compared with the benchmark word for word.

Benchmark items with fewer words than WINDOW are one window of their own length; for each such length
(WINDOW - 1 lengths at most) the hashes of all stretches of that length join the fingerprints.

Definitions
* null or wordless documents: no words, no hits, not contaminated; such items never occur;
* repeated document rows give one result row each, also with null ids; an item id that is repeated
  counts once; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlens.llm.tables import bounded_broadcast, workspace

WINDOW = 13
GRAM = 8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITAL_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text whose letters A-Z are in lower case; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def folded_words(text: Column) -> Column:
    """As many words in capitals. Capitals equate more than A-Z with a-z does, and unlike lower case do
    not depend on neighbouring letters, so equal words stay equal in any text."""
    return F.array_remove(F.split(F.upper(F.coalesce(text, F.lit(""))), CAPITAL_SEPARATORS), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, not at each use inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _stretches(array: Column, length: int, body) -> Column:
    """``body`` of each run of ``length`` consecutive elements."""
    starts = F.sequence(F.lit(1), F.size(array) - (length - 1))
    each = F.transform(starts, lambda i: body(F.slice(array, i, length)))
    return F.when(F.size(array) >= length, each).otherwise(F.array().cast("array<bigint>"))


def grams(array: Column, length: int = GRAM) -> Column:
    return _stretches(array, length, lambda part: F.xxhash64(part))


def fingerprints(array: Column, short: list[int]) -> Column:
    """Winnowed gram hashes, and the hashes of all stretches of the ``short`` lengths."""
    kept = let(grams(array), lambda h: _stretches(h, WINDOW - GRAM + 1, F.array_min))
    return F.array_distinct(F.concat(kept, *[grams(array, n) for n in short]))


def _item_windows(benchmark: DataFrame) -> DataFrame:
    exact = words(F.translate(F.col("text"), UPPER, LOWER))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), exact.alias("words"))
    items = items.filter("item_id IS NOT NULL AND size(words) > 0")
    length = F.least(F.size("words"), F.lit(WINDOW))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    cut = F.transform(starts, lambda i: F.slice("words", i, length))
    return items.select("item_id", F.explode(cut).alias("window"))


KEY = ["doc_id", "text_key"]


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key``, ``n_words``, ``n_hit``, ``items`` (sorted ids), ``contaminated`` per row."""
    ws = workspace(docs)
    # One row per distinct window, with its fingerprint and the items that hold it.
    found = _item_windows(benchmark.select("item_id", "text"))
    whole = F.size("window") == WINDOW
    folded = F.transform("window", F.upper)
    one_print = F.when(whole, F.array_min(let(folded, lambda a: grams(a)))).otherwise(F.xxhash64(folded))
    windows = ws.save(
        found.groupBy("window")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        .select("window", one_print.alias("print"), "items", F.xxhash64("items").alias("items_key")),
        "item-windows",
    )
    lengths = windows.df.select(F.size("window").alias("n")).distinct().collect()  # 13 at most
    short = sorted(row["n"] for row in lengths if row["n"] < WINDOW)
    prints = ws.save(windows.df.select("print").distinct().withColumn("shared", F.lit(True)), "item-prints")

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    # Exploding a one-element array keeps the optimizer from cutting the words again at each use.
    cut = keyed.select(*KEY, F.explode(F.array(folded_words(F.col("text")))).alias("words"))
    spread = cut.select(
        *KEY,
        F.size("words").alias("n_words"),
        F.posexplode_outer(fingerprints(F.col("words"), short)).alias("at", "print"),
    )
    screened = ws.save(
        spread.join(bounded_broadcast(prints.df, prints.rows, 64), "print", "left")
        .groupBy(*KEY, "n_words")
        .agg(
            F.count_if(F.coalesce(F.col("at"), F.lit(0)) == 0).alias("copies"),
            F.coalesce(F.bool_or("shared"), F.lit(False)).alias("candidate"),
        ),
        "screened",
    )
    wanted = ws.save(screened.df.filter("candidate").select(*KEY), "candidates")
    near = keyed.alias("d").join(
        bounded_broadcast(wanted.df, wanted.rows, 64).alias("w"), _same("d", "w"), "left_semi"
    )
    hits = ws.save(_window_hits(near, windows, short), "hits")
    judged = ws.save(_per_document(hits.df, windows.df), "judged").df
    out = screened.df.alias("s").join(judged.alias("h"), _same("s", "h"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    n_words = F.col("n_words").cast("bigint")
    return out.select(
        F.col("s.doc_id").alias("doc_id"),
        F.col("s.text_key").alias("text_key"),
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def _same(left: str, right: str) -> Column:
    return F.expr(" AND ".join(f"{left}.{c} <=> {right}.{c}" for c in KEY))


def _window_hits(docs: DataFrame, windows, short: list[int]) -> DataFrame:
    """Where benchmark windows occur in candidate documents: key, start, length, items_key."""
    exact = words(F.translate("text", UPPER, LOWER))
    cut = docs.dropDuplicates(KEY).select(
        *KEY, F.explode(F.array(F.struct(folded_words(F.col("text")).alias("folded"), exact.alias("exact")))).alias("w")
    ).select(*KEY, "w.*")
    hashed = cut.select(*KEY, "folded", "exact", F.explode(F.array(grams(F.col("folded")))).alias("grams"))
    n = F.size("exact")

    def at(length: int, print_at) -> Column:
        starts = F.sequence(F.lit(1), n - (length - 1))
        each = F.transform(
            starts, lambda i: F.struct(i.alias("start"), print_at(i).alias("print"), F.lit(length).alias("length"))
        )
        empty = F.array().cast("array<struct<start: int, print: bigint, length: int>>")
        return F.when(n >= length, each).otherwise(empty)

    places = F.concat(
        at(WINDOW, lambda i: F.array_min(F.slice("grams", i, WINDOW - GRAM + 1))),
        *[at(k, lambda i, k=k: F.xxhash64(F.slice("folded", i, k))) for k in short],
    )
    each = hashed.select(*KEY, "exact", F.explode(places).alias("place")).select(
        *KEY, "place.start", "place.length", "place.print", F.slice("exact", F.col("place.start"), F.col("place.length")).alias("window")
    )
    items = bounded_broadcast(windows.df.select("print", "window", "items_key"), windows.rows, 1024)
    return each.join(items, ["print", "window"]).select(*KEY, "start", "length", "items_key")


def _per_document(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """Words covered by hits, and the items hit. Documents with the same item sets share one list."""
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))))
    grouped = hits.groupBy(*KEY).agg(
        spans.alias("spans"), F.array_sort(F.collect_set("items_key")).alias("sets")
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "spans",
        zero,
        lambda seen, s: F.struct(
            (seen.n + F.greatest(s.end, seen.end) - F.greatest(s.start, seen.end)).alias("n"),
            F.greatest(s.end, seen.end).alias("end"),
        ),
        lambda seen: seen.n,
    )
    grouped = grouped.select(*KEY, covered.alias("n_hit"), "sets")
    lists = windows.select("items_key", "items").dropDuplicates(["items_key"])
    combined = (
        grouped.select("sets").distinct()
        .select("sets", F.explode("sets").alias("items_key"))
        .join(lists, "items_key")
        .select("sets", F.explode("items").alias("item"))
        .groupBy("sets")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return grouped.join(combined, "sets").select(*KEY, "n_hit", "items")
