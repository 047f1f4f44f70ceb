"""URL filter: host and path rules first, then a ratio of two character language models. Native.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs (those that a rule
decides), give each character's probability after its ORDER - 1 predecessors; Witten-Bell smoothing
backs off to shorter contexts as far as a context was seen. A URL's score is the difference of the two
log-likelihoods divided by its length; it is accepted from the threshold that best separates the rules'
own URLs (least sum of both error shares; the lowest such threshold on ties). For that they are scored
as unknown URLs are, by models that have not seen them: dealt into two halves by their text, each half is
scored by the models of the other.

Log ratios are rounded to 1e-6 and summed as integers, so that scores do not depend on the order of
additions. The model is a written table; it meets the URLs in ordinary joins on n-grams.

Definitions
* the models learn from and score the whole text of a URL, with scheme, query and fragment; rules see host and path;
* null URL: the empty text is scored; null URL or no ``://``: host and path are empty, no rule fits;
* the longest rule (host and path together) wins, on a tie the one with the longer host;
* no accepted or no rejected URLs: that model is uniform, and without either the threshold is 0;
* repeated rows give one result row each; null page ids are kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from incidentlens.llm.tables import workspace

ORDER = 4
UNIT = 1_000_000
# Scores are calibrated on a grid of this many steps per nat, within +-SCORE_LIMIT.
STEPS = 100
SCORE_LIMIT = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = F.col("host")
        return ((host == self.host) | host.endswith("." + self.host)) & F.col("path").startswith(self.path)


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    return pages.withColumns(
        {
            "host": F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER),
            "path": F.regexp_extract(text, pattern, 2),
        }
    )


def with_rule(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rule`` and ``rule_verdict`` of the longest fitting rule, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    none = F.lit(None).cast("string")
    rule, verdict = none, none
    for r in reversed(ordered):
        rule = F.when(r.fits(), F.lit(r.text)).otherwise(rule)
        verdict = F.when(r.fits(), F.lit(r.verdict)).otherwise(verdict)
    return pages.withColumns({"rule": rule, "rule_verdict": verdict})


def _grams(text: Column) -> Column:
    """The ORDER-grams that end in each character of the text and in END."""
    padded = F.concat(F.lit(START * (ORDER - 1)), text, F.lit(END))
    ends = F.sequence(F.lit(1), F.length(text) + 1)
    return F.transform(ends, lambda i: F.substring(padded, i, F.lit(ORDER)))


def score_grams(grams: DataFrame, ws) -> DataFrame:
    """``gram`` and its log ratio in units of 1/UNIT, from rows (gram, accepted, rejected counts)."""
    ends = grams.withColumn("w", F.substring("gram", ORDER, 1))
    single = ends.groupBy("w").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    single = ws.save(single, "url-chars").df
    n = single.agg(
        F.count(F.lit(1)).alias("v"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}") for c in "ar"],
        *[F.count_if(F.col(c) > 0).alias(f"t_{c}") for c in "ar"],
    ).first()
    scored = ends.select("gram", "w").join(single, "w")
    for c in "ar":
        total, types = n[f"n_{c}"], n[f"t_{c}"]
        p = (F.col(c) + types / max(n["v"], 1)) / (total + types) if total else F.lit(1 / max(n["v"], 1))
        scored = scored.withColumn(f"p_{c}", p)
    scored = scored.select("gram", "w", "p_a", "p_r")
    for length in range(2, ORDER + 1):
        context = F.substring("gram", ORDER - length + 1, length - 1)
        follow = (
            ends.filter("a + r > 0")
            .groupBy(context.alias("context"), "w")
            .agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
            .groupBy("context")
            .agg(
                *[F.sum(c).alias(f"n_{c}") for c in "ar"],
                *[F.count_if(F.col(c) > 0).alias(f"t_{c}") for c in "ar"],
                # at most one entry per character
                F.map_from_entries(F.collect_list(F.struct("w", F.struct("a", "r")))).alias("seen"),
            )
        )
        scored = scored.withColumn("context", context).join(follow, "context", "left")
        for c in "ar":
            seen = F.coalesce(F.try_element_at("seen", F.col("w"))[c], F.lit(0))
            backed = (seen + F.col(f"t_{c}") * F.col(f"p_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))
            p = F.when(F.col(f"n_{c}") > 0, backed).otherwise(F.col(f"p_{c}"))
            scored = scored.withColumn(f"p_{c}", p)
        scored = scored.select("gram", "w", "p_a", "p_r")
    ratio = F.round((F.log("p_a") - F.log("p_r")) * UNIT).cast("bigint")
    return scored.select("gram", ratio.alias("ratio"))


def _threshold(scored: DataFrame) -> int:
    """The grid step at and above which a score is accepted. The grid has a fixed number of steps."""
    counts = scored.filter("rule_verdict IS NOT NULL").groupBy(_step(F.col("held_score")).alias("step")).agg(
        F.count_if(F.col("rule_verdict") == "allow").alias("a"),
        F.count_if(F.col("rule_verdict") == "block").alias("r"),
    )
    total = Window.partitionBy()
    below = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    missed = F.coalesce(F.sum("a").over(below), F.lit(0)) / F.greatest(F.sum("a").over(total), F.lit(1))
    caught = F.coalesce(F.sum("r").over(below), F.lit(0)) / F.greatest(F.sum("r").over(total), F.lit(1))
    best = counts.select("step", (missed - caught).alias("error")).orderBy("error", "step").first()
    return best["step"] if best else 0


def _step(score: Column) -> Column:
    return F.floor(F.greatest(F.least(score, F.lit(SCORE_LIMIT)), F.lit(-SCORE_LIMIT)) * STEPS)


def half_of(url: Column) -> Column:
    """0 or 1: the half of the decided URLs that a URL belongs to."""
    return F.pmod(F.xxhash64(url, F.lit(31)), F.lit(2)).cast("int")


def judge(classes: DataFrame, ws) -> DataFrame:
    """``url``, ``score`` and ``accepted`` of different URLs, from ``url``, ``n`` (rows) and ``rule_verdict``."""
    rows = classes.select("url", "n", "rule_verdict", half_of(F.col("url")).alias("half"), F.explode(_grams(F.col("url"))).alias("gram"))

    def held(verdict: str, half: int) -> Column:
        return F.sum(F.when((F.col("rule_verdict") == verdict) & (F.col("half") == half), F.col("n")).otherwise(0))

    counts = rows.groupBy("gram").agg(*[held(v, k).alias(f"{v[0]}{k}") for v in ("allow", "block") for k in (0, 1)])
    counts = ws.save(counts, "url-grams").df
    model = score_grams(counts.selectExpr("gram", "a0 + a1 AS a", "b0 + b1 AS r"), ws)
    for half in (0, 1):  # what judges this half is learned from the other
        other = score_grams(counts.selectExpr("gram", f"a{1 - half} AS a", f"b{1 - half} AS r"), ws)
        model = model.join(other.withColumnRenamed("ratio", f"ratio{half}"), "gram")
    model = ws.save(model, "url-model").df
    total = rows.join(model, "gram").groupBy("url", "rule_verdict", "half").agg(
        F.sum("ratio").alias("ratio"), F.sum(F.expr("if(half = 0, ratio0, ratio1)")).alias("held"), F.count(F.lit(1)).alias("length")
    )
    score, held_score = (F.col(c) / (F.lit(UNIT) * F.col("length")) for c in ("ratio", "held"))
    scored = ws.save(total.select("url", "rule_verdict", score.alias("score"), held_score.alias("held_score")), "url-scores").df
    return scored.select("url", "score", (_step(F.col("score")) >= _threshold(scored)).alias("accepted"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", page_id: str = "page_id") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``score`` (nats per character) per row."""
    ws = workspace(pages)
    parts = with_rule(with_parts(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")), "url"), rules)
    parts = parts.withColumn("url", F.coalesce("url", F.lit("")))
    # Equal URLs are one row of a class until the end.
    classes = ws.save(
        parts.groupBy("url").agg(
            F.first("rule_verdict").alias("rule_verdict"), F.count(F.lit(1)).alias("n")
        ),
        "url-classes",
    ).df
    verdict = F.coalesce("rule_verdict", F.when(F.col("accepted"), "allow").otherwise("block"))
    return parts.join(judge(classes, ws), "url").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "score"
    )
