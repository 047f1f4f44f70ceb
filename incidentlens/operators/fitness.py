"""Fitness: how many other incidents a suppressor stands for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rule import STRONG_FITNESS


def fitness_counts(assigned: DataFrame) -> DataFrame:
    """``(owner_id, fitness)`` for suppressors with at least one other incident."""
    credits = assigned.filter("owner_id <> row_id")
    return credits.groupBy("owner_id").agg(F.count(F.lit(1)).alias("fitness"))


def add_fitness(*parts: DataFrame) -> DataFrame:
    """Sum several ``(owner_id, fitness)`` tables, one per stage or partition."""
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy("owner_id").agg(F.sum("fitness").alias("fitness"))


def with_fitness(suppressors: DataFrame, counts: DataFrame) -> DataFrame:
    """Attach counts to their suppressors; those without any get 0."""
    named = counts.selectExpr("owner_id AS row_id", "fitness AS counted")
    joined = suppressors.join(named, "row_id", "left")
    return joined.selectExpr(*suppressors.columns, "coalesce(counted, 0L) AS fitness")


def nonzero(suppressors: DataFrame) -> DataFrame:
    return suppressors.filter("fitness <> 0")


def strong(suppressors: DataFrame, min_fitness: int = STRONG_FITNESS) -> DataFrame:
    """Suppressors whose fitness exceeds ``min_fitness``."""
    return suppressors.filter(F.col("fitness") > min_fitness)


def run_summary(suppressors: DataFrame, min_fitness: int = STRONG_FITNESS) -> DataFrame:
    """One row: suppressors before and after dropping fitness 0, strong ones, incidents covered."""
    fitness = F.col("fitness")
    return suppressors.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(fitness != 0).alias("final"),
        F.count_if(fitness > min_fitness).alias("strong"),
        F.coalesce(F.sum("fitness"), F.lit(0)).cast("bigint").alias("suppressed"),
    )


def conservation_check(suppressors: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row: every incident is a suppressor or counted in exactly one fitness."""
    sides = incidents.selectExpr("1L AS incident", "0L AS survivor", "0L AS fitness").unionAll(
        suppressors.selectExpr("0L", "1L", "fitness")
    )
    totals = sides.selectExpr(
        "coalesce(sum(incident), 0L) AS incidents",
        "coalesce(sum(survivor), 0L) AS survivors",
        "coalesce(sum(fitness), 0L) AS suppressed",
    )
    return totals.selectExpr(
        "*",
        "incidents - suppressed AS raw_spots",
        "incidents - suppressed = survivors AS conserved",
    )
