"""Ranked selection with quotas, top-ups and tracks. Ties go to the smaller ord."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import fixed as V
from granary.functions.text import sentences, text_of
from granary.operators.dedupe import cut


def ranked(rows: DataFrame, by: list[Column], key: str | None = None, most: int | None = None, name: str = "rank") -> DataFrame:
    """rows with their rank (within key, if given), at most `most` of each. Tasks pass on only as many rows of a key as can be kept."""
    w = Window.partitionBy(key if key else F.lit(0)).orderBy(*by, "ord")
    if key is None and most is not None:
        rows = rows.orderBy(*by, "ord").limit(most)
    out = rows.withColumn(name, F.row_number().over(w))
    return out if most is None else out.filter(F.col(name) <= most)


def quota_top(rows: DataFrame, key: str, by: list[Column], quotas: dict[str, int] = V.QUOTAS) -> DataFrame:
    """Of each bucket as many of its best rows as its quota says; other buckets have none."""
    quota = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(key)), F.lit(0))
    return ranked(rows, by, key, max(quotas.values())).filter(F.col("rank") <= quota)


def executive(rows: DataFrame, quotas: dict[str, int] = V.QUOTAS, most: int = V.MAX_SELECTED) -> DataFrame:
    """Selected rows with bucket and step: quotas first, then the best of the rest, then channels below their quota get more.

    Reads item_id, ord, best_channel, the four channel scores, final_score, fulltext_len, frontier_score and age_h. Only
    the best rows of each bucket and channel, a few dozen whatever the input, go through the later steps.
    """
    rank = F.greatest(*[F.col(f"{k}_score") for k in V.CHANNELS]) * 0.7 + F.col("final_score") * 3 + F.when(F.coalesce(F.col("fulltext_len"), F.lit(0)) >= V.LONG_TEXT, 30).otherwise(0)
    # Scores are worked out in one scan; what follows reads these narrow rows.
    rows = cut(rows.select("item_id", "ord", "best_channel", *[f"{k}_score" for k in V.CHANNELS], rank.alias("_rank"), "frontier_score", "age_h"))
    total = sum(quotas.values())
    by = [F.desc("_rank")]
    pool = ranked(rows, by, "best_channel", most + total, "_in_bucket")
    fits = []
    for name, (score, frontier) in V.BACKFILL_CHANNEL.items():
        ok = (F.col(f"{name}_score") >= score) & ((F.col("frontier_score") <= 0) | (F.col("frontier_score") >= frontier)) & F.coalesce(F.col("age_h") <= 72, F.lit(True))
        fits.append(rows.filter(ok).orderBy(F.desc(f"{name}_score"), *by, "ord").limit(most + 2 * total))
    for extra in fits:
        pool = pool.unionByName(extra, allowMissingColumns=True)
    # A few dozen rows: quotas and number of channels bound them. The steps consume rows one after the other.
    names = [*V.CHANNELS]
    limits = {k: V.BACKFILL_CHANNEL[k] for k in V.BACKFILL_CHANNEL}

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(batches))
        frame = frame.drop_duplicates("item_id").sort_values(["_rank", "ord"], ascending=[False, True], kind="stable")
        bucket: dict[str, tuple[str, str]] = {}
        have = dict.fromkeys(names, 0)
        for r in frame.itertuples():
            if have.get(r.best_channel, 0) < quotas.get(r.best_channel, 0):
                bucket[r.item_id], have[r.best_channel] = (r.best_channel, "quota"), have[r.best_channel] + 1
        for r in frame.itertuples():
            if len(bucket) >= most:
                break
            if r.item_id not in bucket:
                bucket[r.item_id], have[r.best_channel] = (r.best_channel, "rank"), have.get(r.best_channel, 0) + 1
        for name, (score, frontier) in limits.items():
            own = frame.sort_values([f"{name}_score", "_rank", "ord"], ascending=[False, False, True], kind="stable")
            for r in own.itertuples():
                if have[name] >= quotas.get(name, 0):
                    break
                fresh = pd.isna(r.age_h) or r.age_h <= 72
                front = pd.isna(r.frontier_score) or r.frontier_score <= 0 or r.frontier_score >= frontier
                if r.item_id not in bucket and getattr(r, f"{name}_score") >= score and front and fresh:
                    bucket[r.item_id], have[name] = (name, "backfill"), have[name] + 1
        yield pd.DataFrame([(k, b, s) for k, (b, s) in bucket.items()], columns=["item_id", "bucket", "step"])

    return pool.select(rows.columns).coalesce(1).mapInPandas(pick, "item_id string, bucket string, step string")


def tracks(rows: DataFrame, first: int = 50, others: int = 4) -> DataFrame:
    """Rows with track A (frontier of 65 and more), B (business) or C (product), each up to its number, of some channel score of 55."""
    ok = F.greatest("product_score", "tech_score", "business_score") >= 55
    track = (
        F.when((F.col("frontier_score") >= 65) & ok, "A").when((F.col("best_channel") == "business") & (F.col("business_score") >= 55) & (F.col("frontier_score") >= 45), "B")
        .when((F.col("best_channel") == "product") & (F.col("product_score") >= 55) & (F.col("frontier_score") >= 45), "C")
    )
    out = rows.withColumn("track", track).filter("track is not null")
    return ranked(out, [F.desc("frontier_score")], "track", max(first, others)).filter(F.col("rank") <= F.when(F.col("track") == "A", first).otherwise(others))


def watch_list(cards: DataFrame, events: DataFrame, total: int = 6, most: int = 8, least: int = 600) -> DataFrame:
    """Long dated texts that are no events: as many as the events lack to `total`."""
    free = cards.join(events.select("item_id"), "item_id", "left_anti").filter((F.length(text_of("body")) >= least) & F.col("published_at").isNotNull())
    n = events.agg(F.least(F.greatest(F.lit(total) - F.count("*"), F.lit(0)), F.lit(most)).alias("_n"))
    out = ranked(free.withColumn("_len", F.length(text_of("body"))), [F.desc("_len"), F.desc("final_score")], most=most)
    return out.crossJoin(F.broadcast(n)).filter("rank <= _n").drop("_n", "_len")  # one row


def batches(rows: DataFrame, size: int = 20) -> DataFrame:
    """rows with the number of their batch, by ord from 1 on."""
    return rows.withColumn("batch", F.floor((F.col("ord") - 1) / size))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with ord from 1 on, by key, without one task that sorts all: ranges are counted, then numbered each by itself. Ranges are drawn once and stored, as Spark would sample others the second time."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(rows.repartitionByRange(n, key).withColumn("_p", F.spark_partition_id()))
    counts = parts.groupBy("_p").agg(F.count("*").alias("_c"))
    base = counts.withColumn("_base", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    own = parts.withColumn("_rn", F.row_number().over(Window.partitionBy("_p").orderBy(key)))
    return own.join(F.broadcast(base.select("_p", "_base")), "_p").withColumn("ord", F.col("_base") + F.col("_rn")).drop("_p", "_rn", "_base")  # as few


def span(c: Column, low: float, high: float, least: int = 1) -> Column:
    """The elements from int(n * low) to int(n * high) of an array; the whole if these are fewer than `least`."""
    n = F.size(c)
    a, b = F.floor(n * low).cast("int"), F.floor(n * high).cast("int")
    part = F.slice(c, a + 1, F.greatest(b - a, F.lit(0)))
    return F.when(F.size(part) >= least, part).otherwise(c)


def best_sentences(text: Column, score, most: int = 7) -> Column:
    """The sentences of the highest scores, in their order in the text; score takes a sentence and gives a number."""
    s = F.transform(sentences(text), lambda x, i: F.struct((-score(x)).cast("double").alias("s"), i.alias("i"), x.alias("x")))
    best = F.slice(F.array_sort(s), 1, most)
    return F.transform(F.array_sort(F.transform(best, lambda x: F.struct(x["i"].alias("i"), x["x"].alias("x")))), lambda x: x["x"])


def quote_score(s: Column) -> Column:
    """Numbers, money, names and length of a sentence as a score."""
    names = s.rlike(V.COMPANIES).cast("int")
    return 3 * s.rlike(r"\d").cast("int") + 2 * s.rlike(r"[$€£¥]\s*\d").cast("int") + names + F.least(F.floor(F.length(s) / 30), F.lit(3))


def supplementary_quotes(text: Column, most: int = 12) -> Column:
    """Different sentences of the highest quote scores."""
    s = F.transform(F.array_distinct(sentences(text)), lambda x, i: F.struct((-quote_score(x)).cast("double").alias("s"), i.alias("i"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(s), 1, most), lambda x: x["x"])


def first_matching(items: Column, *tests) -> Column:
    """The first element that passes the first test that any passes; null if none."""
    return F.coalesce(*[F.try_element_at(F.filter(items, t), F.lit(1)) for t in tests])


def actions(cards: DataFrame, most: int = 8) -> DataFrame:
    """The first cards as MOVE, TEST or WATCH by their score, in this order."""
    kind = F.when(F.col("final_score") >= 8, "MOVE").when(F.col("final_score") >= 6, "TEST").otherwise("WATCH")
    place = F.when(kind == "MOVE", 0).when(kind == "TEST", 1).otherwise(2)
    return cards.orderBy("ord").limit(most).withColumn("action", kind).withColumn("_place", place).orderBy("_place", "ord").drop("_place")


def impact_ranking(cards: DataFrame, most: int = 8) -> DataFrame:
    """The first cards ranked by impact."""
    return ranked(cards.orderBy("ord").limit(most), [F.desc("impact")])

