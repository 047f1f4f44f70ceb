"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model predicts each UTF-16 unit of a text from the three before it (texts start after three
newlines). Trusted text is every document labelled quality 1; all of it is counted. Counts, discounts
and probabilities of the four orders are joins and aggregations of n-gram tables, sharded by n-gram;
a 4-gram is one BIGINT. Then each document's log-probability is added up against the model.

A model of SHARD_ROWS entries or fewer, which are counted first, is fetched and broadcast. A larger one stays
on the executors: texts in lots ask for their different 4-grams, the model's tables are joined to these order by
order, and the answers go back to the lots, where each text is added up. Log-probabilities are kept in millionths and summed as integers: results do not depend on order.

A document is rejected when its log-perplexity lies outside the quantiles LOW and HIGH of the trusted
documents of its language, each moved outwards by SLACK + SPREAD / sqrt(units) nats: the mean over few
units varies more, and unusual clean text should stay. The quantiles are those of held-out scores: the
trusted texts are dealt into two halves, each scored by a model of the other, as unlabelled text is new to
the model, too; scores of trusted texts by the whole model widen them. Few rows make poor quantiles: with n trusted
rows in a language its own limits count n / (n + FEW_ROWS), and the wider of its own and the all-language
limits, moved outwards by WIDE, the rest.

Definitions
* null or empty text: nothing to predict, log-perplexity null, rejected (there is nothing to train on);
* null language is a language of its own; one without trusted documents uses the quantiles of all
  trusted documents, moved by WIDE; without trusted text in both halves nothing but empty text is rejected;
* a document labelled several times is trusted if no label says otherwise; repeated document rows get
  one result row each; long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from incidentlens.llm.tables import arrow_schema, bounded_broadcast, map_rows, workspace

ORDER = 4
LOW, HIGH, SLACK = 0.002, 0.995, 0.08
SPREAD = 2.0
FEW_ROWS, WIDE = 10, 0.5  # the rows that count half, and by how many nats the limits for none are wider
SHARD_ROWS = 2_000_000
LOT_UNITS = 1 << 21
MICRO = 1_000_000
BINS = 1_000  # quantiles are found on a grid of thousandths of a nat
UNITS = 1 << 16
_START = np.full(ORDER - 1, 10, np.uint64)
COUNT_UNITS = 1 << 21  # n-grams are counted in lots of some so many units
# kinds of model entries: probability of an n-gram, weight of the shorter context after a context
PROB, BACK = 0, 1
NO_ENTRY = -round(np.log(UNITS) * MICRO)  # of a unit never seen


def keys_of(text: str | None) -> np.ndarray:
    """The 4-gram that ends in each UTF-16 unit of the text, as unsigned 64-bit numbers."""
    data = (text or "").encode("utf-16-le", "surrogatepass")
    units = np.concatenate([_START, np.frombuffer(data, np.uint16).astype(np.uint64)])
    n = len(units) - (ORDER - 1)
    out = units[:n].copy()
    for j in range(1, ORDER):
        out = (out << np.uint64(16)) | units[j : j + n]
    return out


def _count(rows: Iterator[tuple]) -> Iterator[tuple]:
    waiting, held = [], 0
    for (text,) in rows:
        waiting.append(keys_of(text))
        held += len(waiting[-1])
        if held >= COUNT_UNITS:
            yield from _counted(waiting)
            waiting, held = [], 0
    if held:
        yield from _counted(waiting)


def _counted(parts: list[np.ndarray]) -> Iterator[tuple]:
    grams, counts = np.unique(np.concatenate(parts), return_counts=True)
    yield from zip(grams.view(np.int64).tolist(), counts.tolist())


def count_grams(texts: DataFrame) -> DataFrame:
    """``gram`` and ``c`` of all 4-grams of the column ``text``; counted per task before the shuffle."""
    counted = map_rows(texts, ["text"], _count, "gram bigint, c bigint")
    return counted.groupBy("gram").agg(F.sum("c").alias("c"))


def _suffix(gram: Column, n: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (16 * n)) - 1))


def _context(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, 16)


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, and 3 or more."""
    n = counts.agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    y = n["n1"] / (n["n1"] + 2 * n["n2"]) if n["n1"] else 0.5
    return [
        min(max(k - (k + 1) * y * n[f"n{k + 1}"] / n[f"n{k}"], 0.0), k) if n[f"n{k}"] else k / 2
        for k in (1, 2, 3)
    ]


def build_model(texts: DataFrame, ws) -> DataFrame:
    """Entries (kind, n, key, micro): log-probabilities of n-grams and weights of contexts of length n.

    Lower orders count distinct left neighbours, the highest counts occurrences.
    """
    top = ws.save(count_grams(texts), "grams4").df
    by_order = {ORDER: top}
    for n in range(ORDER - 1, 0, -1):
        longer = by_order[n + 1]
        shorter = longer.groupBy(_suffix(F.col("gram"), n).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        by_order[n] = ws.save(shorter, f"grams{n}").df
    entries, lower = [], None
    for n in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(by_order[n])
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        # at most as many rows as there are different units share a context
        context = Window.partitionBy("context")
        stats = by_order[n].withColumn("context", _context(F.col("gram")) if n > 1 else F.lit(0).cast("bigint"))
        stats = stats.select(
            "gram",
            "context",
            (F.col("c") - discount).alias("left"),
            F.sum("c").over(context).alias("total"),
            (F.sum(discount).over(context) / F.sum("c").over(context)).alias("back"),
        )
        if lower is None:
            joined = stats.withColumn("p_lower", F.lit(1.0 / UNITS))
        else:
            joined = stats.withColumn("suffix", _suffix(F.col("gram"), n - 1)).join(lower, "suffix")
        p = F.col("left") / F.col("total") + F.col("back") * F.col("p_lower")
        saved = ws.save(joined.select("gram", "context", "back", p.alias("p")), f"order{n}").df
        lower = saved.select(F.col("gram").alias("suffix"), F.col("p").alias("p_lower"))
        micro = lambda c: F.round(F.log(c) * MICRO).cast("int").alias("micro")
        entries.append(saved.select(F.lit(PROB).alias("kind"), F.lit(n).alias("n"), F.col("gram").alias("key"), micro("p")))
        contexts = saved.filter("back > 0").groupBy("context").agg(F.first("back").alias("back"))
        entries.append(
            contexts.select(F.lit(BACK).alias("kind"), F.lit(n - 1).alias("n"), F.col("context").alias("key"), micro("back"))
        )
    out = entries[0]
    for more in entries[1:]:
        out = out.unionByName(more)
    return out


class Lookup:
    """Tables of a whole model. ``total`` adds up a text's positions."""

    def __init__(self, arrays: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]):
        self.tables = {k: _Table(*v) for k, v in arrays.items()}

    def total(self, text: str | None) -> tuple[int, int]:
        keys = keys_of(text)
        positions, out = len(keys), 0
        for n in range(ORDER, 0, -1):
            suffix = keys & np.uint64((1 << (16 * n)) - 1) if n < ORDER else keys
            values, found = self.tables[PROB, n].find(suffix)
            out += int(values[found].sum())
            keys = keys[~found]
            if not len(keys):
                return out, positions
            contexts = (suffix[~found] >> np.uint64(16)) if n > 1 else np.zeros(len(keys), np.uint64)
            values, found = self.tables[BACK, n - 1].find(contexts)
            out += int(values[found].sum())
        return out + NO_ENTRY * len(keys), positions


class _Table:
    """Sorted keys with values; most lookups end in a direct slot, the others in a binary search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order].astype(np.int64)
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        self.slots = np.zeros(1 << (64 - int(self.shift)), np.int32)
        if len(keys):
            self.slots[self._slot(self.keys)] = np.arange(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (((keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = self.slots[self._slot(keys)]
        found = self.keys[at] == keys
        rest = np.flatnonzero(~found)
        if len(rest):
            again = np.minimum(np.searchsorted(self.keys, keys[rest]), len(self.keys) - 1)
            hit = self.keys[again] == keys[rest]
            at[rest[hit]] = again[hit]
            found[rest[hit]] = True
        return self.values[at], found


def perplexity(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``text_key``, ``copies`` (equal rows), ``units`` and ``log_ppl``.

    ``trusted`` holds the texts to learn from.
    """
    ws = workspace(docs)
    entries = ws.save(build_model(trusted.select("text"), ws), "model")
    rows = docs.select("doc_id", "lang", F.xxhash64("text").alias("text_key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang string, text_key bigint, micro bigint, units bigint"
    if entries.rows <= SHARD_ROWS:
        scored = _by_broadcast(rows, entries.df, schema)
    else:
        scored = _by_join(rows, entries.df, schema, ws)
    added = scored.groupBy("doc_id", "lang", "text_key").agg(
        F.first("micro").alias("micro"), F.first("units").alias("units"), F.count(F.lit(1)).cast("int").alias("copies")
    )
    log_ppl = F.when(F.col("units") > 0, -F.col("micro") / F.col("units") / MICRO)
    return added.select("doc_id", "lang", "text_key", "copies", "units", log_ppl.alias("log_ppl"))


def _by_broadcast(rows: DataFrame, entries: DataFrame, schema: str) -> DataFrame:
    """Totals of each text, against a model small enough for the driver and every worker."""
    shared = rows.sparkSession.sparkContext.broadcast(_arrays(entries))

    def score(part: Iterator[tuple]) -> Iterator[tuple]:
        tables = Lookup(shared.value)
        for doc_id, lang, text_key, text in part:
            yield doc_id, lang, text_key, *tables.total(text)

    return map_rows(rows, ["doc_id", "lang", "text_key", "text"], score, schema)


def _by_join(rows: DataFrame, entries: DataFrame, schema: str, ws) -> DataFrame:
    """Totals of each text, against a model of any size, which stays on the executors.

    Texts are dealt into lots of LOT_UNITS units or so; each lot asks for its different 4-grams once, so that
    no 4-gram stands on more rows than there are lots, and gets their log-probabilities back.
    """
    names, most = ["doc_id", "lang", "text_key", "text"], LOT_UNITS

    def deal(part: Iterator[tuple]) -> Iterator[tuple]:
        lot, held = TaskContext.get().partitionId() << 32, 0
        for row in part:
            units = len(row[3] or "") + 1
            if held and held + units > most:
                lot, held = lot + 1, 0
            held += units
            yield lot, *row

    def ask(part: Iterator[tuple]) -> Iterator[tuple]:
        for lot, same in groupby(part, key=lambda row: row[0]):
            for gram in np.unique(np.concatenate([keys_of(text) for _, text in same])).view(np.int64).tolist():
                yield lot, gram

    kind = rows.schema["doc_id"].dataType.simpleString()
    # Written, so that a text keeps its lot.
    dealt = ws.write(map_rows(rows, names, deal, f"lot bigint, doc_id {kind}, lang string, text_key bigint, text string"), "lots")
    asked = ws.write(map_rows(dealt, ["lot", "text"], ask, "lot bigint, gram bigint"), "lot-grams")
    answers = asked.join(_resolved(asked.select("gram"), entries, ws), "gram").select("lot", "gram", "micro")
    out = arrow_schema(schema)

    def add(texts: pa.Table, known: pa.Table) -> pa.Table:
        grams, micro = (known.column(c).to_numpy().astype(np.int64) for c in ("gram", "micro"))
        order = np.argsort(grams, kind="stable")
        grams, micro = grams[order], micro[order]
        totals, units = [], []
        for text in texts.column("text").to_pylist():
            keys = keys_of(text).view(np.int64)
            totals.append(int(micro[np.searchsorted(grams, keys)].sum()) if len(keys) else 0)
            units.append(len(keys))
        columns = [texts.column(c) for c in names[:3]] + [pa.array(totals, pa.int64()), pa.array(units, pa.int64())]
        return pa.table([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    return dealt.groupBy("lot").cogroup(answers.groupBy("lot")).applyInArrow(add, schema)


def _resolved(grams: DataFrame, entries: DataFrame, ws) -> DataFrame:
    """``gram`` and ``micro`` of different 4-grams, whether the model holds them or not.

    From the shortest suffixes up; no key has more rows than there are different units.
    """
    needed = {ORDER: ws.write(grams.distinct(), "needed4")}
    for n in range(ORDER - 1, 0, -1):
        needed[n] = ws.write(needed[n + 1].select(_suffix(F.col("gram"), n).alias("gram")).distinct(), f"needed{n}")

    def of(kind: int, n: int, key: str, value: str) -> DataFrame:
        return entries.filter((F.col("kind") == kind) & (F.col("n") == n)).select(F.col("key").alias(key), F.col("micro").alias(value))

    none = of(BACK, 0, "context", "back").first()
    lower, base = None, NO_ENTRY + (none["back"] if none else 0)
    for n in range(1, ORDER + 1):
        asked = needed[n].join(of(PROB, n, "gram", "own"), "gram", "left")
        if lower is None:
            shorter = F.lit(base)
        else:
            asked = asked.withColumns({"context": _context(F.col("gram")), "suffix": _suffix(F.col("gram"), n - 1)})
            asked = asked.join(of(BACK, n - 1, "context", "back"), "context", "left").join(lower, "suffix")
            shorter = F.coalesce("back", F.lit(0)) + F.col("below")
        found = ws.write(asked.select("gram", F.coalesce("own", shorter).cast("bigint").alias("micro")), f"resolved{n}")
        lower = found.select(F.col("gram").alias("suffix"), F.col("micro").alias("below"))
    return found


def _arrays(entries: DataFrame) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    found = entries.select("kind", "n", "key", "micro").toArrow()
    kind, n, key, micro = (found.column(c).to_numpy() for c in ("kind", "n", "key", "micro"))
    wanted = [(PROB, i) for i in range(1, ORDER + 1)] + [(BACK, i) for i in range(ORDER)]
    return {
        (k, i): (key[(kind == k) & (n == i)].astype(np.int64).view(np.uint64), micro[(kind == k) & (n == i)].astype(np.int32))
        for k, i in wanted
    }


def trusted_ids(labels: DataFrame) -> DataFrame:
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    return known.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")


def limits(scored: DataFrame, low: float = LOW, high: float = HIGH, slack: float = SLACK) -> DataFrame:
    """``lang``, ``rows``, ``lower``, ``upper``: exact quantiles on the grid; the row with null ``lang`` = all."""
    binned = scored.filter("log_ppl IS NOT NULL").select(
        F.coalesce("lang", F.lit("")).alias("lang"), F.floor(F.col("log_ppl") * BINS).alias("bin"), "copies"
    )
    both = binned.groupBy("lang", "bin").agg(F.sum("copies").alias("n"))
    both = both.unionByName(
        both.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "bin", "n")
    )
    # Bins are few: log-perplexity is at most ln(UNITS) and some.
    upto = Window.partitionBy("lang").orderBy("bin")
    whole = Window.partitionBy("lang")
    ranked = both.select("lang", "bin", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("total"))
    return ranked.groupBy("lang").agg(
        F.first("total").alias("rows"),
        (F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * low), F.col("bin"))) / BINS - slack).alias("lower"),
        ((F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * high), F.col("bin"))) + 1) / BINS + slack).alias("upper"),
    )


def held_out(trusted: DataFrame, scored: DataFrame) -> DataFrame:
    """Scores of trusted texts by a model that has not seen them: each half by the other's counts.

    Equal texts lie in one half. Without text in both halves there are no such scores; ``scored`` has their columns.
    """
    half = F.pmod(F.xxhash64("text", F.lit(29)), F.lit(2)).cast("int")
    halves = [trusted.filter(half == k) for k in (0, 1)]
    some = trusted.filter("text <> ''").select(half.alias("half")).distinct().count()
    if some < 2:
        return scored.limit(0)
    parts = [perplexity(own, other) for own, other in (halves, halves[::-1])]
    return parts[0].unionByName(parts[1])


def ranges_of(held: DataFrame, seen: DataFrame) -> DataFrame:
    """``lang``, ``lower``, ``upper``; a null ``lang`` is for languages without trusted documents.

    Held-out and seen scores both count as usual, since copies of trusted texts have the latter.
    """
    own, known = limits(held).alias("h"), limits(seen).alias("s")
    both = own.join(known, F.expr("h.lang <=> s.lang")).select(
        "h.lang",
        "h.rows",
        F.least("h.lower", "s.lower").alias("lower"),
        F.greatest("h.upper", "s.upper").alias("upper"),
    )
    overall = both.filter("lang IS NULL").select(F.col("lower").alias("low"), F.col("upper").alias("high"))
    # A language without trusted rows, which is what the null row is for, has the wide limits alone.
    own = F.when(F.col("lang").isNull(), F.lit(0.0)).otherwise(F.col("rows") / (F.col("rows") + FEW_ROWS))
    lower, upper = F.least("lower", "low") - WIDE, F.greatest("upper", "high") + WIDE
    return both.join(F.broadcast(overall)).select(
        "lang",
        (own * F.col("lower") + (1 - own) * lower).alias("lower"),
        (own * F.col("upper") + (1 - own) * upper).alias("upper"),
    )


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``text_key``, ``copies``, ``units``, ``log_ppl``, ``perplexity``, ``kept``."""
    ws = workspace(docs)
    ids = ws.save(trusted_ids(labels), "trusted")
    known = bounded_broadcast(ids.df, ids.rows, 64)
    trusted = ws.write(docs.select("doc_id", "lang", "text").join(known, "doc_id", "left_semi"), "trusted-texts")
    scored = ws.save(perplexity(docs, trusted), "perplexity").df
    held = ws.write(held_out(trusted, scored), "held-out")
    ranges = ws.save(ranges_of(held, scored.join(known, "doc_id", "left_semi")), "limits").df
    overall = ranges.filter("lang IS NULL").first()
    lower, upper = (overall["lower"], overall["upper"]) if overall else (None, None)
    judged = scored.withColumn("known", F.coalesce("lang", F.lit(""))).join(
        ranges.filter("lang IS NOT NULL").withColumnRenamed("lang", "known"), "known", "left"
    )
    few = SPREAD / F.sqrt(F.greatest("units", F.lit(1)))
    inside = F.col("log_ppl").between(
        F.coalesce("lower", F.lit(lower).cast("double"), F.lit(float("-inf"))) - few,
        F.coalesce("upper", F.lit(upper).cast("double"), F.lit(float("inf"))) + few,
    )
    return judged.select(
        "doc_id", "lang", "text_key", "copies", "units", "log_ppl",
        F.exp("log_ppl").alias("perplexity"),
        F.coalesce(inside, F.lit(False)).alias("kept"),
    )
