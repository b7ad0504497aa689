"""Selection for a brief: every card gets a reason or a place. Evidence is mined from the text, cards that say the same as a better one go, the best of the rest stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import mining as M
from granary.functions.evidence import frame_signature, url_and_title_tokens
from granary.functions.scores import is_first_rank
from granary.functions.text import once, squeeze, text_of
from granary.operators.dedupe import cut, keep_first
from granary.operators.select import numbered
from granary.operators.stats import cooccurring

# Fixed values
NUMERIC_ACTOR = (r"^[0-9.,%mbkMBKxXvV\-_/\s]+$", r"^[vV]?\d+(?:\.\d+){0,4}[A-Za-z]{0,4}$")
LEAST_TEXT, LEAST_FACTS, MOST_FACTS, SHARED_FRAMES = 200, 6, 12, 2
FACT = "array<struct<text: string, score: int, index: int>>"
JUDGED = "array<struct<s: string, low: string, n: int, title: int, anchor: int>>"


def _more(f: Column, texts: Column, own: Column, first: int, most: int, loose: bool) -> Column:
    """Facts from texts (structs of s and g, its bits) that are not among the own ones yet: with evidence, a word of the title, an anchor or two key words; if loose, long ones with evidence or two key words. No more texts are looked at than it takes."""
    shown = F.transform(own, lambda y: F.lower(y["text"]))

    def judged(x: Column) -> Column:
        s, low = x["s"], F.lower(x["s"])

        def of(y: Column) -> Column:
            return F.struct(y["s"], y["low"], M.strong(M.signals(y["s"], y["g"])).alias("n"), M.within(y["low"], f["words"]).alias("title"), F.size(F.filter(f["names"], lambda a: F.contains(y["low"], a["low"]))).alias("anchor"))

        return once(F.struct(s.alias("s"), x["g"], low.alias("low")), of)

    def taking(own: Column, shown: Column) -> Column:
        need = F.greatest(F.lit(0), F.lit(most) - F.size(own))
        keys = lambda x: F.size(M.key_tokens(x["s"]))

        def step(out: Column, x: Column) -> Column:
            near = lambda y: (y["n"] > 0) | (keys(y) >= 2) if loose else (y["n"] > 0) | (y["title"] >= 1) | (y["anchor"] >= 1) | (keys(y) >= 2)
            new = lambda y: ~F.array_contains(shown, y["low"]) & ~F.exists(out, lambda z: z["low"] == y["low"]) & near(y)
            added = lambda y: F.when(new(y), F.concat(out, F.array(y))).otherwise(out)
            ok = (F.length(x["s"]) >= (24 if loose else 1)) & ~M.is_blocked(x["s"], x["g"])
            return F.when(F.size(out) >= need, out).when(ok, once(judged(x), added)).otherwise(out)

        none = F.array().cast(JUDGED)
        extra = lambda x: (keys(x) >= 3).cast("int") if loose else F.lit(0)
        taken = F.transform(F.aggregate(texts, none, step), lambda x: F.struct(x["s"].alias("text"), F.greatest(F.lit(1), x["n"] + x["title"] + x["anchor"] + extra(x)).alias("score")))
        return F.concat(own, F.transform(taken, lambda x, i: F.struct(x["text"], x["score"], (F.lit(first) + F.size(own) + i).alias("index"))))

    return once(F.struct(own.alias("own"), shown.alias("shown")), lambda x: taking(x["own"], x["shown"]))


def with_facts(rows: DataFrame, wanted: Column, name: str = "facts") -> DataFrame:
    """rows with an array of structs of text, score and index, the best first: the fact pack, and where that is thin what the other miners find, then any sentence with evidence. Rows that are not wanted have null."""
    text, title, actor, anchors, every = (F.col(c) for c in ("body", "title", "actor", "anchors", "_every"))
    only = lambda c: F.when(wanted, c)
    # Step by step: one expression of all this is more than the analyzer takes in its rounds. A text is split once for all miners.
    rows = rows.withColumn("_every", M.sieved_sentences(only(text)))
    rows = rows.withColumn("_pack", only(M.fact_pack(text, title, actor, anchors, mined=every))).withColumn("_mined", only(M.scored_candidates(text, title, actor, anchors, mined=every)))
    rows = rows.withColumn("_candidates", only(M.told_candidates(text, title, actor, anchors, mined=every)))
    own = F.struct(F.col("_pack").alias("pack"), F.col("_mined").alias("mined"), F.col("_candidates").alias("candidates"), every.alias("all"), url_and_title_tokens(title).alias("words"), M.marked(M.names_of(anchors)).alias("names"))
    return rows.withColumn("_own", only(own)).withColumn(name, only(_facts(F.col("_own")))).drop("_pack", "_mined", "_candidates", "_every", "_own")


def _facts(own: Column) -> Column:
    def of(f: Column) -> Column:
        others = F.concat(F.transform(f["mined"], lambda x: F.struct(x["text"].alias("s"), x["g"].alias("g"))), f["candidates"])
        second = lambda own: F.when(F.size(own) >= LEAST_FACTS, own).otherwise(_more(f, others, own, 1000, MOST_FACTS, False))
        third = lambda own: F.when(F.size(own) >= LEAST_FACTS, own).otherwise(_more(f, f["all"], own, 1500, LEAST_FACTS, True))
        every = once(once(F.transform(f["pack"], lambda x: F.struct(x["text"].alias("text"), x["score"].cast("int").alias("score"), x["index"].cast("int").alias("index"))).cast(FACT), second), third)
        order = F.sort_array(F.transform(every, lambda x: F.struct((-x["score"]).alias("r"), x["index"].alias("index"), x["text"].alias("text"))))
        return F.transform(order, lambda x: F.struct(x["text"].alias("text"), (-x["r"]).alias("score"), x["index"].alias("index")))

    return once(own, of)


def two_quotes(facts: Column) -> Column:
    """The first two different facts of 80 characters and more, as reports show them."""
    shown = F.filter(F.transform(facts, lambda x: M.clip(M.quote_text(x["text"]), M.QUOTE_MOST)), lambda q: F.length(q) >= M.QUOTE_LEAST)
    return F.slice(M.distinct_by(shown, F.lower), 1, 2)


def selection(cards: DataFrame, most: int = 10) -> DataFrame:
    """cards with reason, place, quote_1, quote_2 and n_facts: the first rule that a card fails, or its place among the selected.

    Reads ord, title, body, url, source_name, actor, anchors and relevant. Rules in order: non_ai, actor_invalid,
    fulltext_too_short, anchor_missing, fact_pack_insufficient, fact_pack_quote_missing, quote_cta_hit; then duplicate_frames
    (two sentence frames shared with a card kept before it, in order of rank, relevance, length of text and quotes, anchors and
    ord), then beyond_limit.
    """
    actor, anchors = squeeze(F.col("actor")), M.names_of(F.col("anchors"))
    body = squeeze(F.col("body"))
    numeric = actor.rlike(NUMERIC_ACTOR[0]) | actor.rlike(NUMERIC_ACTOR[1])
    early = (
        F.when(~F.coalesce(F.col("relevant"), F.lit(False)), "non_ai").when((actor == "") | numeric, "actor_invalid").when(F.length(body) < LEAST_TEXT, "fulltext_too_short").when(F.size(anchors) == 0, "anchor_missing")
    )
    rows = with_facts(cards.withColumn("_early", early), F.col("_early").isNull(), "_facts")
    rows = rows.withColumn("_quotes", two_quotes(F.col("_facts")))
    calls = F.exists("_quotes", M.is_call)
    reason = F.coalesce(F.col("_early"), F.when(F.size("_facts") < LEAST_FACTS, "fact_pack_insufficient").when(F.size("_quotes") < 2, "fact_pack_quote_missing").when(calls, "quote_cta_hit"))
    frames = F.array_distinct(F.transform("_facts", lambda x: frame_signature(x["text"], F.col("actor"), F.col("anchors"))))
    rank = F.struct(
        (-is_first_rank(F.col("source_name"), F.col("url"), F.col("title")).cast("int")).alias("a"), (-F.length(body)).alias("b"), (-F.aggregate("_quotes", F.lit(0), lambda s, q: s + F.length(q))).alias("c"),
        (-F.size(F.coalesce(F.col("anchors"), F.array().cast(M.NONE)))).alias("d"), F.col("ord").alias("e"),
    )
    # Texts are mined once; what follows are narrow rows.
    mined = cut(rows.select("ord", reason.alias("_reason"), F.size("_facts").alias("n_facts"), F.get("_quotes", F.lit(0)).alias("quote_1"), F.get("_quotes", F.lit(1)).alias("quote_2"), F.when(reason.isNull(), frames).alias("_frames"), F.when(reason.isNull(), rank).alias("_rank")))
    good = cut(numbered(mined.filter("_reason is null").select(F.col("ord").alias("_ord"), "_frames", "_rank"), "_rank"))
    kept = keep_first(good.select(F.col("ord").alias("k")), cooccurring(good, "_frames", "ord", SHARED_FRAMES).select(F.col("i").alias("a"), F.col("j").alias("b")))
    kept = numbered(kept.select(F.col("k")), "k").select("k", F.col("ord").alias("place"))
    places = good.select("_ord", F.col("ord").alias("k")).join(kept, "k", "left").select(F.col("_ord").alias("ord"), "place")
    out = mined.join(places, "ord", "left")
    last = F.coalesce(F.col("_reason"), F.when(F.col("place").isNull(), "duplicate_frames").when(F.col("place") > most, "beyond_limit"))
    out = out.select("ord", last.alias("reason"), F.when(last.isNull(), F.col("place")).alias("place"), "quote_1", "quote_2", F.greatest(F.coalesce("n_facts", F.lit(0)), F.lit(0)).alias("n_facts"))
    return cards.join(out, "ord")
