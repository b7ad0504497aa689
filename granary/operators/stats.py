"""Aggregates and run verdicts. Each returns a small table; verdicts are rows of (gate, metric, value, threshold, status)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import evidence as E
from granary.functions import fixed as V
from granary.functions.scores import impact, names_topic
from granary.functions.text import proof_tokens, strip, text_of
from granary.operators.matching import first_mentions


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b, rounded; 0 without b."""
    return F.when(b > 0, F.round(a / b, digits)).otherwise(0.0)


def pool_stats(rows: DataFrame, score: str = "frontier_score", age: str = "age_h") -> DataFrame:
    """Totals of a pool: by score, by score within 72 hours, and the share of dates that are fallbacks."""
    recent = F.coalesce(F.col(age) <= 72, F.lit(False))
    s = F.col(score)
    return rows.agg(
        F.count("*").alias("total"), F.count_if(s >= 70).alias("ge70"), F.count_if(s >= 85).alias("ge85"), F.count_if((s >= 70) & recent).alias("ge70_72h"), F.count_if((s >= 85) & recent).alias("ge85_72h"),
        F.count_if(F.col(age).isNull()).alias("undated"), ratio(F.count_if(F.col(age).isNull()), F.count("*")).alias("undated_ratio"),
    )


def score_histogram(rows: DataFrame, score: str = "frontier_score") -> DataFrame:
    s = F.col(score)
    bucket = F.when(s >= 85, "85+").when(s >= 70, "70-84").when(s >= 50, "50-69").otherwise("0-49")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def best_samples(rows: DataFrame, score: str = "frontier_score", low: int = 85, high: int = 100, most: int = 10) -> DataFrame:
    """The rows of the best scores within bounds; ties in order."""
    return rows.filter(F.col(score).between(low, high)).orderBy(F.desc(score), "ord").limit(most)


def latency(rows: DataFrame, value: str = "latency") -> DataFrame:
    """n, median and the value at index int(0.95 n) of the sorted values, without a task that holds all of them."""
    v = rows.select(F.col(value).cast("double").alias("v")).filter("v is not null")
    by_value = v.groupBy("v").agg(F.count("*").alias("c"))
    # Positions of different values: totals of buckets first, then running counts within a bucket.
    b = by_value.withColumn("bucket", F.floor(F.signum("v") * F.log2(F.abs(F.col("v")) + 1) * 64).cast("long"))
    sums = b.groupBy("bucket").agg(F.sum("c").alias("s"))
    before = sums.withColumn("base", F.sum("s").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))  # one row for each bucket, some thousands at most
    total = sums.agg(F.sum("s").alias("n"))
    inner = b.join(F.broadcast(before.select("bucket", F.coalesce("base", F.lit(0)).alias("base"))), "bucket")  # as bounded as the buckets
    w = Window.partitionBy("bucket").orderBy("v")
    placed = inner.withColumn("hi", F.col("base") + F.sum("c").over(w)).withColumn("lo", F.col("hi") - F.col("c"))
    t = placed.crossJoin(F.broadcast(total))  # one row
    at = lambda i: F.max(F.when((F.col("lo") <= i) & (i < F.col("hi")), F.col("v")))
    mid_low, mid_high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    p95 = F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)
    return t.agg(F.max("n").alias("n"), F.round((at(mid_low) + at(mid_high)) / 2, 3).alias("p50"), F.round(at(p95), 3).alias("p95"))


def outcomes(rows: DataFrame) -> DataFrame:
    """attempted, success, fail, success_rate of rows with a status."""
    ok = F.count_if(F.col("status") == "ok")
    return rows.agg(F.count("*").alias("attempted"), ok.alias("success"), (F.count("*") - ok).alias("fail"), F.when(F.count("*") > 0, F.round(100 * ok / F.count("*"), 1)).otherwise(0.0).alias("success_rate"))


def market_heat(rows: DataFrame, score: str = "final_score") -> DataFrame:
    """A heat from 0 to 100 by mean score and number, and its level."""
    heat = F.greatest(F.lit(0), F.least(F.lit(100), (F.least(F.coalesce(F.avg(score), F.lit(0.0)) * 10, F.lit(80.0)) + F.least(F.count("*") * 4, F.lit(20))).cast("int")))
    one = rows.agg(heat.alias("heat"), F.count("*").alias("n"))
    return one.withColumn("level", F.when(F.col("heat") >= 75, "VERY_HIGH").when(F.col("heat") >= 50, "HIGH").when(F.col("heat") >= 25, "MEDIUM").otherwise("LOW"))


def platform_stats(rows: DataFrame, source: str = "source_name", score: str = "final_score") -> DataFrame:
    """For each source the rows, the sum of their heat and how many passed."""
    heat = F.sum(F.greatest(F.col(score) * 10, F.lit(0.0)).cast("int"))
    return rows.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("items_seen"), heat.cast("long").alias("heat_sum"), F.count_if(F.col("passed")).alias("gate_pass"))


def top_sources(rows: DataFrame, source: str = "source_name", most: int = 3) -> DataFrame:
    out = rows.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("items_seen"), F.count_if("event_pass").alias("gate_pass"), F.count_if(F.col("signal_pass") & ~F.col("event_pass")).alias("gate_soft_pass"))
    return out.orderBy(F.desc("gate_pass"), F.desc("gate_soft_pass"), F.desc("items_seen"), "source").limit(most)


def source_share(rows: DataFrame, source: str = "source_name") -> DataFrame:
    """n and the largest share of one source."""
    c = rows.groupBy(source).agg(F.count("*").alias("c"))
    return c.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.when(F.sum("c") > 0, F.round(F.max("c") / F.sum("c"), 4)).otherwise(0.0).alias("max_share"))


def proof_coverage(rows: DataFrame, text: str = "body") -> DataFrame:
    """n, how many rows have a token of proof, and their share."""
    has = F.count_if(proof_tokens(F.col(text)) > 0)
    return rows.agg(F.count("*").alias("n"), has.alias("with_proof"), ratio(has, F.count("*")).alias("coverage"))


def frequency(rows: DataFrame, array: str, most: int = 5) -> DataFrame:
    """The most frequent elements of an array column; ties in order of first appearance."""
    out = rows.select("ord", F.posexplode(array).alias("pos", "value")).groupBy("value").agg(F.count("*").alias("n"), F.min(F.struct("ord", "pos")).alias("_first"))
    return out.orderBy(F.desc("n"), "_first").limit(most).select("value", "n")


def bullet_stats(rows: DataFrame, array: str) -> DataFrame:
    b = rows.select(F.explode(array).alias("b"))
    return b.agg(F.count("*").alias("n"), F.coalesce(F.round(F.avg(F.length("b")), 1), F.lit(0.0)).alias("avg_len"), F.coalesce(F.min(F.length("b")), F.lit(0)).alias("min_len"))


def funnel(rows: DataFrame, **stages: Column) -> DataFrame:
    """(stage, position, n): how many rows satisfy each stage, from one pass."""
    one = rows.agg(*[F.count_if(c).alias(n) for n, c in stages.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("stage"), F.lit(i).alias("position"), F.col(n).alias("n")) for i, n in enumerate(stages)])).alias("x")).select("x.*")


def cooccurring(rows: DataFrame, array: str, key: str = "ord", least: int = 2) -> DataFrame:
    """(i, j, shared): pairs of keys, i < j, that share at least `least` different elements.

    Prefix filtering: elements are ranked by how many rows have them, the rarest first; two rows that share `least` have one in
    common within the first size - least + 1 of each, and only these are joined. An element that a third of all rows have
    comes last, so it pairs rows only where nothing rarer is left to tell them apart. Candidates are counted on the whole arrays.
    """
    own = rows.select(F.col(key).alias("k"), F.array_distinct(F.col(array)).alias("s")).filter(F.size("s") >= least)
    each = own.select("k", F.explode("s").alias("e"))
    often = each.groupBy("e").agg(F.count("*").alias("n"))
    ranked = each.join(often, "e").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "e"))).alias("s"))  # a row's own elements
    first = ranked.select("k", F.explode(F.slice(F.col("s"), F.lit(1), F.size("s") - F.lit(least - 1))).alias("x")).select("k", F.col("x.e").alias("e"))
    pairs = first.join(first.withColumnRenamed("k", "j"), "e").filter("k < j").select(F.col("k").alias("i"), "j").distinct()
    left, right = own.select(F.col("k").alias("i"), F.col("s").alias("a")), own.select(F.col("k").alias("j"), F.col("s").alias("b"))
    shared = F.size(F.array_intersect("a", "b")).cast("long")
    return pairs.join(left, "i").join(right, "j").select("i", "j", shared.alias("shared")).filter(F.col("shared") >= least)


def company_watch(cards: DataFrame, text: Column, score: Column, richness: Column, names: dict[str, tuple[str, ...]] | None = None, most: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(companies, summary) of cards with ord, title and is_valid.

    companies: (tier, rank, name, ord, title, impact, impact_label): each watched company with the first valid card that
    names it, those of a tier in order of cards and then of the list, `most` of them. summary: mentions, impact_score_avg,
    trend_direction, success_count and fail_count of all cards; all mentions count, those beyond `most`, too.
    """
    names = names or {"tier_a": V.WATCHED, "tier_b": V.WATCHED_MORE}
    most = most or {"tier_a": 7, "tier_b": 5}
    flat = [n for own in names.values() for n in own]
    tier = F.element_at(F.create_map(*[F.lit(x) for t, own in names.items() for n in own for x in (n, t)]), F.col("name"))
    rows = cards.withColumn("_text", text).withColumn("_impact", impact(score, richness))
    found = first_mentions(rows.filter("is_valid"), flat, F.col("_text")).withColumn("tier", tier)  # a row for each name, at most
    w = Window.partitionBy("tier").orderBy("first", "place")
    named = F.broadcast(found.withColumn("rank", F.row_number().over(w)))
    label = F.get(F.array(*map(F.lit, V.IMPACT_LABELS)), F.col("_impact") - 1)
    all_ = rows.join(named, rows["ord"] == named["first"]).select("tier", "rank", "name", "ord", "title", F.col("_impact").alias("impact"), label.alias("impact_label"))
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in most.items() for x in kv]), F.col("tier"))
    counts = cards.agg(F.count_if("is_valid").alias("success_count"), F.count_if(~F.col("is_valid")).alias("fail_count"))
    one = all_.agg(F.count("*").alias("mentions"), F.coalesce(F.round(F.avg("impact"), 2), F.lit(0.0)).alias("impact_score_avg")).crossJoin(F.broadcast(counts))  # one row
    trend = F.when(F.col("mentions") == 0, "STABLE").when((F.col("impact_score_avg") >= 3.8) | (F.col("mentions") >= 3), "UP").when(F.col("impact_score_avg") <= 2.0, "DOWN").otherwise("STABLE")
    return all_.filter(F.col("rank") <= limit), one.select("mentions", "impact_score_avg", trend.alias("trend_direction"), "success_count", "fail_count")


def signal_summary(cards: DataFrame, source: str = "source_name", score: str = "final_score", order: str = "ord", rows: int = 3, signals: dict[str, str] | None = None) -> DataFrame:
    """Exactly `rows` rows, whatever the number of cards: kinds of signals in turn, each dealt the next card by order, over again when there are fewer.

    (position, signal, label, title, source_name, platform_count, heat_score, heat, signals_insufficient, passed_total_count):
    heat follows from the card's score, platform_count is how many cards its source has; a card's title is used once, then
    the signal's label stands for it. Without cards the rows have a score of 3, no source (scan) and count 1.
    """
    signals = signals or V.SIGNALS
    name = F.coalesce(F.nullif(strip(text_of(source)), F.lit("")), F.lit("scan"))
    counts = cards.groupBy(name.alias("source_name")).agg(F.count("*").alias("platform_count"))
    total = counts.agg(F.coalesce(F.sum("platform_count"), F.lit(0)).alias("passed_total_count"))
    first = cards.orderBy(order).limit(rows).select(F.col(order).alias("_o"), text_of("title").alias("title"), name.alias("source_name"), F.col(score).alias("_score"))
    dealt = first.agg(F.array_sort(F.collect_list(F.struct("_o", "title", "source_name", "_score"))).alias("dealt"))  # `rows` cards
    kinds = F.array(*[F.struct(F.lit(k).alias("signal"), F.lit(v).alias("label")) for k, v in signals.items()])
    seats = dealt.crossJoin(F.broadcast(total)).withColumn("kinds", kinds).select("*", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("position"))  # one row
    n = F.size("dealt")
    seats = seats.withColumn("kind", F.get("kinds", F.col("position") % F.lit(len(signals)))).withColumn("card", F.when(n > 0, F.get("dealt", F.col("position") % F.greatest(n, F.lit(1)))))
    own = seats.select("position", "kind", "card", n.alias("n"), "passed_total_count", F.coalesce("card.source_name", F.lit("scan")).alias("source_name"))
    own = own.join(counts, "source_name", "left")
    heat = F.least(F.lit(100), F.greatest(F.lit(30), F.bround(F.coalesce(F.nullif(F.col("card._score"), F.lit(0.0)), F.lit(3.0)) * 12, 0).cast("int")))
    title = F.when((F.col("position") < F.col("n")) & (strip(F.col("card.title")) != ""), strip(F.col("card.title"))).otherwise(F.col("kind.label"))
    out = own.withColumn("heat_score", heat)
    return out.select(
        "position", "kind.signal", "kind.label", F.substring(title, 1, 80).alias("title"), "source_name", F.coalesce("platform_count", F.lit(1)).alias("platform_count"), "heat_score",
        F.when(F.col("heat_score") >= 75, "hot").when(F.col("heat_score") >= 50, "warm").otherwise("cool").alias("heat"), (F.col("passed_total_count") < rows).alias("signals_insufficient"), "passed_total_count",
    ).orderBy("position")


def verdict(gate: str, metric: str, value: Column, threshold: float, at_least: bool = True, waived: Column | None = None) -> Column:
    ok = value >= threshold if at_least else value <= threshold
    waived = F.lit(False) if waived is None else waived
    status = F.when(ok, "PASS").when(waived, "SKIP").otherwise("FAIL")
    return F.struct(F.lit(gate).alias("gate"), F.lit(metric).alias("metric"), value.cast("double").alias("value"), F.lit(float(threshold)).alias("threshold"), status.alias("status"))


def verdicts(one: DataFrame, *rows: Column) -> DataFrame:
    """Verdicts over a table of one row."""
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def pool_verdicts(pool: DataFrame, total: int = V.POOL_TOTAL, fresh: int = V.POOL_FRESH) -> DataFrame:
    return verdicts(pool, verdict("POOL_HEALTH", "total", F.col("total"), total), verdict("POOL_HEALTH", "ge85_72h", F.col("ge85_72h"), fresh))


def run_verdicts(selected: DataFrame, source: str = "source_name", text: str = "body") -> DataFrame:
    """Diversity of sources, coverage of proof, and whether enough rows with long texts were selected; the first two are waived on a day with few rows."""
    per = selected.groupBy(source).agg(F.count("*").alias("c"), F.count_if(proof_tokens(F.col(text)) > 0).alias("proof"), F.count_if(F.length(text_of(text)) >= V.LONG_TEXT).alias("long"))
    one = per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), ratio(F.max("c"), F.sum("c")).alias("share"), ratio(F.sum("proof"), F.sum("c")).alias("coverage"), F.coalesce(F.sum("long"), F.lit(0)).alias("long"))
    sparse = F.col("n") < V.SPARSE_DAY
    return verdicts(
        one, verdict("SOURCE_DIVERSITY", "max_share", F.col("share"), V.SOURCE_SHARE, False, sparse), verdict("PROOF_COVERAGE", "coverage", F.col("coverage"), V.PROOF_COVERAGE, True, sparse),
        verdict("POOL_SUFFICIENCY", "selected", F.col("n"), V.MIN_EVENTS), verdict("POOL_SUFFICIENCY", "long_texts", F.col("long"), V.LONG_NEEDED),
    )


def fault_verdicts(rows: DataFrame, none: dict[str, Column], some: dict[str, Column], enough: int = 10, spare: int = 2) -> DataFrame:
    """Verdicts (gate, metric, value, threshold, status) on how many rows have a fault, from one pass.

    Gates of `none` fail with the first such row. Gates of `some` pass when `enough` rows, or all of fewer, are without
    fault, or when no more than `spare` have one. A fault is a boolean, or an array of codes; null counts as a fault of `none`.
    """
    bad = lambda c, null: F.coalesce(c, F.lit(null))
    one = rows.agg(F.count("*").alias("_n"), *[F.count_if(bad(c, True)).alias(k) for k, c in none.items()], *[F.count_if(bad(c, False)).alias(k) for k, c in some.items()])
    strict = [verdict(k, "failed", F.col(k), 0, at_least=False) for k in none]
    passed = lambda k: (F.col("_n") - F.col(k) >= F.least(F.lit(enough), F.col("_n"))) | (F.col(k) <= spare)
    lenient = [F.struct(F.lit(k).alias("gate"), F.lit("failed").alias("metric"), F.col(k).cast("double").alias("value"), F.lit(float(spare)).alias("threshold"), F.when(passed(k), "PASS").otherwise("FAIL").alias("status")) for k in some]
    return verdicts(one, *strict, *lenient)


def narrative_verdicts(cards: DataFrame) -> DataFrame:
    """fault_verdicts() of cards with title, q1, q2, actor, anchors, quote_1, quote_2, moves and risks: topic, boilerplate and anchored bullets for all, the structure of both narratives for ten."""
    both = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("moves", "risks")])
    anchors = F.coalesce(F.col("anchors"), F.array().cast("array<string>"))
    has = lambda codes: F.size(codes) > 0
    none = {
        "AI_PURITY": ~names_topic(F.col("title"), F.col("quote_1"), F.col("quote_2"), F.array_join(anchors, " ")), "NO_BOILERPLATE": has(E.check_boilerplate(F.col("q1"), F.col("q2"))), "MOVES_ANCHORED": has(E.check_anchored(both, anchors)),
    }
    some = {"Q1_STRUCTURE": has(E.check_structure(F.col("q1"), "Q1", anchors, actor=F.col("actor"))), "Q2_STRUCTURE": has(E.check_structure(F.col("q2"), "Q2", anchors, quote=F.col("quote_2")))}
    return fault_verdicts(cards, none, some)


def acceptance(spark: SparkSession) -> DataFrame:
    """The gates and their thresholds as a table."""
    rows = [("POOL_HEALTH", "total", float(V.POOL_TOTAL)), ("POOL_HEALTH", "ge85_72h", float(V.POOL_FRESH)), ("EXEC_KPI", "events", float(V.MIN_EVENTS)), ("SOURCE_DIVERSITY", "max_share", V.SOURCE_SHARE), ("PROOF_COVERAGE", "coverage", V.PROOF_COVERAGE)]
    rows += [("EXEC_KPI", k, float(n)) for k, n in V.QUOTAS.items() if n > 1]
    return spark.createDataFrame(rows, "gate string, metric string, threshold double")
