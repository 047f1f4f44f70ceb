"""Exact-size random sample without replacement, reproducible by seed.

Rows are ordered by a seeded digest of ``row_id``; the sample is the first n. The cut-off is
found from counts per digest prefix, so no pass sorts the table: each pass narrows the cut-off to
one prefix (65,536 groups at most), until the rows sharing the prefix are few enough to sort.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sample_digest
from ..sizes import Sizes

DIGEST_DIGITS = 32
MAX_DIGITS = 4


def sample_size(rows: int, pct: int) -> int:
    """Whole rows only: 10 % of 1,009 rows are 100."""
    if not 0 <= pct <= 100:
        raise ValueError("pct must be between 0 and 100")
    return rows * int(pct) // 100


@dataclass(frozen=True)
class SampleCut:
    """The last sampled row in sample order; ``None`` fields mean an empty sample."""

    seed: int
    digest: str | None
    row_id: int | None

    def contains(self) -> str:
        """SQL condition, true for sampled rows."""
        if self.digest is None:
            return "false"
        digest = sample_digest("row_id", self.seed)
        # One comparison of pairs, so that the digest is computed once per row.
        last = f"struct('{self.digest}' AS digest, {self.row_id}L AS row_id)"
        return f"struct({digest} AS digest, row_id) <= {last}"


def find_cut(
    incidents: DataFrame, rows: int, size: int, seed: int, sizes: Sizes = Sizes()
) -> SampleCut:
    """Locate the ``size``-th of ``rows`` rows in sample order; the driver sees one row per pass."""
    if size <= 0:
        return SampleCut(seed, None, None)
    if size > rows:
        raise ValueError("the sample is larger than the table")
    digests = incidents.selectExpr("row_id", f"{sample_digest('row_id', seed)} AS digest")
    wanted, held, prefix = size, rows, ""
    while held > sizes.sort_rows and len(prefix) < DIGEST_DIGITS:
        # Digits that should leave few enough rows; at most 16^4 groups reach the window.
        digits = min(MAX_DIGITS, math.ceil(math.log(held / sizes.sort_rows, 16)) + 1)
        groups = (
            digests.filter(F.col("digest").startswith(prefix))
            .groupBy(F.substring("digest", 1, len(prefix) + digits).alias("prefix"))
            .agg(F.count(F.lit(1)).alias("held"))
        )
        order = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
        upto = groups.withColumn("upto", F.sum("held").over(order))
        found = upto.filter(F.col("upto") >= wanted).orderBy("prefix").first()
        wanted -= found["upto"] - found["held"]
        held, prefix = found["held"], found["prefix"]
    last = (
        digests.filter(F.col("digest").startswith(prefix))
        .orderBy("digest", "row_id")
        .offset(wanted - 1)
        .first()
    )
    return SampleCut(seed, last["digest"], last["row_id"])


def draw_sample(incidents: DataFrame, cut: SampleCut) -> DataFrame:
    """The sampled rows with their ``digest``; sample order is (digest, row_id)."""
    digest = sample_digest("row_id", cut.seed)
    return incidents.filter(cut.contains()).selectExpr("*", f"{digest} AS digest")


def without_sample(incidents: DataFrame, cut: SampleCut) -> DataFrame:
    """All other rows, by comparing with the cut-off; no join."""
    return incidents.filter(f"NOT {cut.contains()}")
