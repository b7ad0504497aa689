"""One-to-one assignment in tiers: what a pass in order gives, by rounds of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.dedupe import cut


def aligned(left: DataFrame, right: DataFrame, tiers: list[tuple[Column, Column]], left_key: str = "ord", right_key: str = "ord") -> DataFrame:
    """(a, b, tier): rows of left, in order of their key, each with the row of right that it takes.

    A left row takes, by its first tier that can, the right row whose value in that tier is its own, if that is not taken yet;
    of right rows that share a value the last counts. Nulls and empty values match nothing. Every right row is taken once.

    Rounds: an open row asks for the first of its right rows that is left; one gets it as soon as no earlier open row may
    still want it. Each round decides the earliest open row, and as a rule nearly all.
    """
    edges = []
    for t, (own, other) in enumerate(tiers):
        value = lambda c: F.nullif(c.cast("string"), F.lit(""))
        last = right.select(value(other).alias("v"), F.col(right_key).alias("b")).filter("v is not null").groupBy("v").agg(F.max("b").alias("b"))
        edges.append(left.select(value(own).alias("v"), F.col(left_key).alias("a")).join(last, "v").select("a", "b", F.lit(t).alias("tier")))
    open_ = cut(reduce(DataFrame.unionAll, edges).groupBy("a", "b").agg(F.min("tier").alias("tier")))
    given = None
    while not open_.isEmpty():
        wish = open_.groupBy("a").agg(F.min_by("b", "tier").alias("b"), F.min("tier").alias("tier"))
        earliest = open_.groupBy("b").agg(F.min("a").alias("a"))
        now = cut(wish.join(earliest, ["a", "b"]).select("a", "b", "tier"))
        given = now if given is None else cut(given.unionAll(now))
        open_ = cut(open_.join(now.select("a"), "a", "left_anti").join(now.select("b"), "b", "left_anti"))
    return given if given is not None else open_.select("a", "b", "tier")
