"""Classification and scoring as columns."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import fixed as V
from granary.functions.sieve import Sieve, widened
from granary.functions.text import count, count_sentences, first_of, has_any, hits, info_density, lowered, once, rounded, sieved, squeeze, strip, text_of
from granary.operators.matching import class_hits


def _hard(t: Column, low: Column) -> Column:
    out = None
    for tokens, ok in (((*V.HARD_TOKENS, *V.NEWSLETTER_TOKENS), F.lit(True)), (V.WEAK_TOKENS, F.length(t) < V.WEAK_BELOW)):
        for w in tokens:
            hit, value = F.contains(low, F.lit(w)) & ok, F.lit(f"rejected_keyword:{w}")
            out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def _fragment(t: Column, low: Column) -> Column:
    ends = reduce(or_, [t.rlike(p) for p in V.FRAGMENT_ENDS])
    return (t == "") | has_any(low, V.FRAGMENT_TERMS) | t.endswith(",") | ((F.length(t) < 80) & ~t.rlike("[.!?。？！]")) | ends


def hard_reject_reason(body: Column) -> Column:
    """rejected_keyword:<token> of the first token that rejects a text; null if none."""
    return sieved(strip(text_of(body)), text_of(body), GATE_SIEVE, lambda t, low, bits: F.when(GATE_SIEVE.can(bits, "hard"), _hard(t, low)))


def is_fragment_placeholder(body: Column) -> Column:
    return lowered(strip(text_of(body)), _fragment)


#: Whether a text can have a token that rejects it.
GATE_SIEVE = Sieve(("hard", "(?i)" + "|".join(map(re.escape, (*V.HARD_TOKENS, *V.NEWSLETTER_TOKENS, *V.WEAK_TOKENS)))))


def body_facts(body: Column) -> Column:
    """A struct of what gates ask of a text: hard (the reason that rejects it, or fragment_placeholder), length and sentences. The stripped text and its lower-cased form are made once."""
    gate = sieved(
        strip(text_of(body)), text_of(body), GATE_SIEVE,
        lambda t, low, bits: F.struct(F.coalesce(F.when(GATE_SIEVE.can(bits, "hard"), _hard(t, low)), F.when(_fragment(t, low), "fragment_placeholder")).alias("hard"), F.length(t).alias("length")),
    )
    return once(F.struct(gate.alias("g"), count_sentences(body).alias("n")), lambda x: F.struct(x["g"]["hard"].alias("hard"), x["g"]["length"].alias("length"), x["n"].alias("sentences")))


def reason_of(facts: Column, least: int = V.EVENT_LEVEL[0], sentences: int = V.EVENT_LEVEL[1]) -> Column:
    """Why a text of these facts is no valid article: the first rule that fails; null if it is one."""
    return F.coalesce(facts["hard"], F.when(facts["length"] < least, "content_too_short").when(facts["sentences"] < sentences, "insufficient_sentences"))


def article_reason(body: Column, least: int = V.EVENT_LEVEL[0], sentences: int = V.EVENT_LEVEL[1]) -> Column:
    """reason_of() a text; for several levels of one text take body_facts() once."""
    return once(body_facts(body), lambda x: reason_of(x, least, sentences))


def is_on_topic(title: Column, body: Column, words: tuple[str, ...] = V.TOPIC_WORDS) -> Column:
    """Whether a topic word stands in title or body between word boundaries."""
    own = "|".join(sorted(words, key=len, reverse=True))
    return F.concat_ws(" ", text_of(title), text_of(body)).rlike(rf"(?iU)(?:^|\b| )(?:{own})(?:\b| |$)")


def density_reason(info: Column, kind: str) -> Column:
    """The first density rule of a kind (event, signal, corp) that a breakdown fails; null if none."""
    score, entities, numbers, sentences = V.INFO_LEVELS[kind]
    return (
        F.when(info["fragment_penalty"] > 0, "fragment_placeholder").when((info["boilerplate_hits"] > 0) & (info["score"] < score), "boilerplate").when(info["score"] < score, "low_density_score")
        .when(info["entity_hits"] < entities, "missing_entities").when(info["numeric_hits"] < numbers, "missing_numbers").when(info["sentence_count"] < sentences, "insufficient_sentences")
    )


def density_tier(body: Column, kind: str = "event") -> Column:
    """A struct of tier (A, B or C), score and reasons."""
    none = F.array().cast("array<string>")

    def tier_of(info: Column) -> Column:
        own, signal = density_reason(info, kind), density_reason(info, "signal")
        flagged = (info["fragment_penalty"] > 0) | (info["boilerplate_hits"] > 0)
        flags = F.array_compact(F.array(F.when(info["fragment_penalty"] > 0, "fragment_placeholder"), F.when(info["boilerplate_hits"] > 0, "boilerplate"), F.coalesce(signal, own)))

        def tiered(x: Column) -> Column:
            reasons = F.when(x["a"], none).when(x["b"], F.array_compact(F.array(x["own"]))).otherwise(F.when(F.size(x["flags"]) > 0, F.array_distinct(x["flags"])).otherwise(F.array(F.lit("low_density_score"))))
            return F.struct(F.when(x["a"], "A").when(x["b"], "B").otherwise("C").alias("tier"), x["score"].alias("score"), reasons.alias("reasons"))

        return once(F.struct((~flagged & own.isNull()).alias("a"), (~flagged & signal.isNull()).alias("b"), own.alias("own"), flags.alias("flags"), info["score"].alias("score")), tiered)

    return once(info_density(body), tier_of)


#: The patterns of channels and of relevance. An amount's end may be a sign, so the wider form goes without a boundary there.
_IN_CHANNELS = (*(p for own in V.CHANNELS.values() for p in own), V.STRONG_TECH, (V.NUMBER_BOOST, widened(V.NUMBER_BOOST.replace(r"?B?\b", "?B?"))))
CHANNEL_SIEVE = Sieve(*_IN_CHANNELS)
RELEVANCE_SIEVE = Sieve(*_IN_CHANNELS, *V.AI_CORE, *V.BUILDING, V.COMPANIES, V.MODELS)


def _channels(full: Column, url: Column, bits: Column, sieve: Sieve) -> Column:
    at = lambda host, n: F.when(F.contains(url, F.lit(host)), n).otherwise(0)
    more = {"tech": at("arxiv.org", 3) + at("huggingface.co", 1), "dev": at("github.com", 3) + at("huggingface.co", 2)}
    raw = F.struct(*((sieve.count(bits, full, en) + sieve.count(bits, full, zh) + more.get(k, F.lit(0))).alias(k) for k, (en, zh) in V.CHANNELS.items()), sieve.has(bits, full, V.NUMBER_BOOST).alias("_numbers"))

    def scored(r: Column) -> Column:
        first = first_of({k: r[k] for k in V.CHANNELS})
        lead = F.greatest(*(r[k] for k in V.CHANNELS))
        best = once(first, lambda b: F.when(b.isin("business", "dev") & (r["tech"] >= lead - 2) & sieve.has(bits, full, V.STRONG_TECH), "tech").otherwise(b))
        boost = F.when(r["_numbers"], 20).otherwise(0)
        return F.struct(*(F.when(r[k] == 0, 0).otherwise(F.least(r[k] * 25 + boost, F.lit(100))).cast("int").alias(f"{k}_score") for k in V.CHANNELS), best.alias("best_channel"))

    return once(raw, scored)


def channels(text: Column, url: Column | None = None, platform: Column | None = None) -> Column:
    """A struct of product, tech, business and dev scores and the best channel."""
    url = text_of(url if url is not None else F.lit(""))
    full = F.concat_ws(" ", text_of(text), url, text_of(platform if platform is not None else F.lit("")))
    return once(F.struct(full.alias("full"), F.lower(url).alias("url"), CHANNEL_SIEVE.of(full).alias("bits")), lambda x: _channels(x["full"], x["url"], x["bits"], CHANNEL_SIEVE))


def relevance(text: Column, url: Column | None = None) -> Column:
    """A struct of relevant and its reason: buildings without the topic's core are out, known names and the core are in."""
    url = text_of(url if url is not None else F.lit(""))
    full, sieve = F.concat_ws(" ", text_of(text), url), RELEVANCE_SIEVE

    def facts(x: Column) -> Column:
        full = x["full"]
        has = lambda p: sieve.has(x["bits"], full, p)
        either = lambda patterns: has(patterns[0]) | has(patterns[1])
        # The channels read an empty platform behind the address, and so a blank; the other patterns do not.
        top = once(_channels(F.concat(full, F.lit(" ")), x["url"], x["bits"], sieve), lambda ch: F.greatest(*(ch[f"{k}_score"] for k in V.CHANNELS)))
        return F.struct(either(V.AI_CORE).alias("core"), either(V.BUILDING).alias("building"), (has(V.COMPANIES) | has(V.MODELS)).alias("known"), top.alias("top"))

    def result(x: Column) -> Column:
        core, known, top = x["core"], x["known"], x["top"]
        out = x["building"] & ~core
        reason = (
            F.when(out, "hard_neg:building_real_estate_no_ai_core").when(known, "whitelist:company_or_model").when(core & (top >= 35), F.concat(F.lit("channel_score="), top.cast("string"), F.lit(",ai_core=True")))
            .when(core, F.concat(F.lit("ai_core_present,channel_score="), top.cast("string"))).otherwise(F.concat(F.lit("no_ai_core,max_channel_score="), top.cast("string")))
        )
        return F.struct((~out & (known | core)).alias("relevant"), reason.alias("reason"))

    return once(once(F.struct(full.alias("full"), F.lower(url).alias("url"), sieve.of(F.concat(full, F.lit(" "))).alias("bits")), facts), result)


def recency_points(ts: Column, as_of: Column) -> Column:
    hours = (F.unix_micros(as_of) - F.unix_micros(ts)) / 3.6e9
    out = F.when(ts.isNull(), V.RECENCY_UNKNOWN)
    for limit, points in V.RECENCY:
        out = out.when(hours < limit, points)
    return out.otherwise(V.RECENCY_OLD)


def frontier_score(title: Column, summary: Column, content: Column, url: Column, platform: Column, ts: Column, as_of: Column) -> Column:
    """Recency, platform, words, structure, business and product as points from 0 to 100."""
    head = F.concat_ws(" ", text_of(title), text_of(summary))
    full = F.concat_ws(" ", text_of(title), text_of(summary), text_of(content), text_of(url))
    p = F.lower(text_of(platform))
    low = F.lower(head)
    at = F.regexp_instr(full, F.lit(V.BENCHMARK_NAME))
    name = F.length(F.regexp_substr(full, F.lit(V.BENCHMARK_NAME)))
    window = F.substring(full, F.greatest(at - 80, F.lit(1)), F.least(at - 1, F.lit(80)) + name + 80)
    points = lambda c, n: F.when(c, n).otherwise(0)
    structure = (
        points(F.contains(text_of(url), F.lit("arxiv.org/abs/")) | full.rlike(V.ARXIV), 15) + points(full.rlike(V.VERSION_TAG), 10) + points((at > 0) & window.rlike(V.SCORE_NEAR), 15)
        + points(full.rlike(V.PARAM_SCALE), 10) + points(full.rlike(V.RELEASE_WORDS), 15)
    )
    business = points(full.rlike(V.BIG_TECH), 15) + points(full.rlike(V.BUSINESS_TERMS) | full.rlike(V.MONEY_AMOUNT), 10)
    product = points(full.rlike(V.LAUNCH_WORDS), 12) + points(full.rlike(V.DATED_VERSION) | full.rlike(V.VERSION_TAG), 8)
    total = (
        recency_points(ts, as_of) + F.when(p.isin(*V.HIGH_PLATFORMS), 20).when(p.isin(*V.MEDIUM_PLATFORMS), 12).when(p.isin(*V.COMMUNITY_PLATFORMS), 8).otherwise(4)
        + F.least(3 * hits(low, V.FRONTIER_HIGH) + hits(low, V.FRONTIER_LOW), F.lit(30)) + F.least(structure, F.lit(40)) + F.least(business, F.lit(25)) + F.least(product, F.lit(20))
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")


def _head(title: Column, body: Column) -> Column:
    return F.lower(F.concat_ws(" ", text_of(title), F.substring(text_of(body), 1, 1000)))


def category(title: Column, body: Column, source_category: Column) -> Column:
    """A struct of category and confidence: the most keywords in title and first 1000 characters, else what the source is mapped to. One automaton looks for all keywords."""
    found = class_hits(_head(title, body), V.CATEGORIES)
    scores = {k: found[f"c{i}"] for i, k in enumerate(V.CATEGORIES)}
    most = F.greatest(*scores.values())
    mapped = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in V.SOURCE_CATEGORIES.items() for x in kv]), text_of(source_category)), F.lit(V.OTHER_CATEGORY))
    return F.struct(F.when(most > 0, first_of(scores)).otherwise(mapped).alias("category"), F.when(most > 0, F.bround(F.least(F.lit(1.0), most / 5.0), 2)).otherwise(0.3).alias("confidence"))


def mechanism(title: Column, body: Column) -> Column:
    found = class_hits(_head(title, body), V.MECHANISMS)
    scores = {k: found[f"c{i}"] for i, k in enumerate(V.MECHANISMS)}
    return F.when(F.greatest(*scores.values()) > 0, first_of(scores)).otherwise(V.DEFAULT_MECHANISM)


def is_ad(title: Column, body: Column) -> Column:
    return hits(F.lower(F.concat_ws(" ", text_of(body), text_of(title))), V.AD_WORDS) >= 2


def rule_scores(title: Column, body: Column, source_name: Column, source_category: Column, n_entities: Column, n_points: Column) -> Column:
    """A struct of novelty, utility, heat, feasibility, final_score, dup_risk, is_ad and tags. Rounding is half-even."""
    t = text_of(body)
    n = F.length(t)
    cap = lambda x: rounded(F.least(F.lit(10.0), x), 1)
    lookup = lambda values, c, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), text_of(c)), F.lit(other))
    novelty, utility = cap(3 + n / 500 + n_entities * 0.5), cap(4 + n_points * 1.5 + n_entities * 0.5)
    heat, feasible = cap(lookup(V.SOURCE_HEAT, source_name, 5) + n / 1000), lookup(V.FEASIBILITY, source_category, 5).cast("double")
    ad = is_ad(title, t)
    return F.struct(
        novelty.alias("novelty"), utility.alias("utility"), heat.alias("heat"), feasible.alias("feasibility"), rounded((novelty + utility + heat + feasible) / 4, 2).alias("final_score"), F.lit(0.0).alias("dup_risk"),
        ad.alias("is_ad"), F.array_compact(F.array(source_category, source_name, F.when(ad, "ad"))).alias("tags"),
    )


def passes(b: Column, score: float = V.GATE_SCORE, dup_risk: float = V.GATE_DUP_RISK) -> Column:
    return (b["final_score"] >= score) & (b["dup_risk"] <= dup_risk) & ~b["is_ad"]


def signal_strength(b: Column, evidence: Column) -> Column:
    raw = b["novelty"] * 0.2 + b["utility"] * 0.15 + b["heat"] * 0.15 + b["feasibility"] * 0.15 + b["final_score"] * 0.15 + evidence * 2.0
    return rounded(F.least(F.lit(10.0), raw), 2)


def impact(score: Column, richness: Column) -> Column:
    """Impact from 1 to 5."""
    return F.least(F.lit(5), F.greatest(F.lit(1), F.bround(score / 2 + F.least(richness * 0.3, F.lit(1.5)), 0).cast("int")))


def card(title: Column, summary: Column, b: Column, source_name: Column, url: Column) -> Column:
    """A struct of card_md, title, brief and cta_url."""
    tags = F.array_join(F.transform(b["tags"], lambda x: F.concat(F.lit("#"), x)), " ")
    md = F.concat(
        F.lit("**"), text_of(title), F.lit("**\n\n"), text_of(summary), F.lit("\n\n---\n評分: "), F.format_string("%.1f", b["final_score"]), F.lit(" | 來源: "), text_of(source_name), F.lit("\n標籤: "), tags, F.lit("\n\n[查看原文]("), text_of(url), F.lit(")")
    )
    s = text_of(summary)
    return F.struct(md.alias("card_md"), text_of(title).alias("title"), F.when(F.length(s) > 30, F.concat(F.substring(s, 1, 30), F.lit("..."))).otherwise(s).alias("brief"), text_of(url).alias("cta_url"))


def traffic_light(success: Column, p95: Column) -> Column:
    return F.when((success >= 80) & (p95 < 30), "green").when((success >= 50) | (p95 < 60), "yellow").otherwise("red")


def is_index_page(title: Column, body: Column) -> Column:
    return has_any(F.lower(F.concat_ws(" ", text_of(title), text_of(body))), V.INDEX_WORDS)


EVENT_SIEVE = Sieve(f"(?iu){V.EVENT_VERBS}", f"(?iu){V.EVENT_TIMES}")


def is_non_event(title: Column, body: Column, line: Column | None = None) -> Column:
    """By its title, as an index, or because it has less than two of an action, a time and a subject."""
    head = strip(text_of(title))
    t = F.concat_ws(" ", head, strip(text_of(body)), F.lit("") if line is None else text_of(line))
    bits, (verbs, times) = EVENT_SIEVE.of(t), EVENT_SIEVE.at
    elements = once(F.struct(t.alias("t"), bits.alias("bits")), lambda x: EVENT_SIEVE.has(x["bits"], x["t"], verbs).cast("int") + EVENT_SIEVE.has(x["bits"], x["t"], times).cast("int") + x["t"].rlike(V.EVENT_SUBJECT).cast("int"))
    return head.rlike("(?i)" + "|".join(V.NON_EVENT_TITLES)) | is_index_page(title, body) | (elements <= 1)


def is_banner(body: Column) -> Column:
    """Two phrases of a site's interface, or one in a short text."""
    t = text_of(body)
    n = hits(F.lower(t), V.BANNERS)
    return (n >= 2) | ((n >= 1) & (F.length(strip(t)) < V.BANNER_BELOW))


def is_invalid(body: Column) -> Column:
    """A banner, or a short text with fewer than two words of some length."""
    t = strip(text_of(body))
    return is_banner(body) | ((F.length(t) < V.INVALID_BELOW) & (count(t, "[\\u4e00-\\u9fff]{2,}") + count(t, "[a-zA-Z]{4,}") < 2))


def needs_fulltext(title: Column, body: Column, source_name: Column) -> Column:
    """The text is no more than data about the item: addresses of a thread, the title, or little from a site of threads."""
    b, s = text_of(body), strip(text_of(body))
    thread = b.contains("Comments URL:") & b.contains("ycombinator.com")
    return thread | ((s == strip(text_of(title))) & (s != "")) | (F.lower(text_of(source_name)).isin(*V.THREAD_SOURCES) & (F.length(b) < 200))


def is_placeholder(c: Column) -> Column:
    low = F.lower(text_of(c))
    return (strip(low) == "") | has_any(low, V.PLACEHOLDERS)


def has_source(url: Column, source_name: Column) -> Column:
    """There is an address, or the name of a source that says something."""
    return strip(text_of(url)).rlike("^https?://") | ~F.lower(strip(text_of(source_name))).isin(*V.NO_SOURCES)


def is_banned(c: Column) -> Column:
    return has_any(text_of(c), V.REPORT_BANNED)


def is_first_rank(source_name: Column, url: Column, title: Column) -> Column:
    """By the names of laboratories in source, address or title, or by the address of a blog of theirs."""
    return squeeze(F.concat_ws(" ", text_of(source_name), text_of(url), text_of(title))).rlike(f"(?i){V.FIRST_SOURCE}") | squeeze(url).rlike(f"(?i){V.FIRST_URL}")


_WORDS = sorted(V.TOPIC_TERMS, key=len, reverse=True)
#: Terms begin and end with ASCII letters or digits, so what is no word character beside them is a boundary to ASCII, too.
TOPIC = r"(?iU)(?<!\w)(?:" + "|".join(rf"\Q{w}\E" + ("" if w in V.TOPIC_PREFIXES else r"(?!\w)") for w in _WORDS) + ")"
TOPIC_SIEVE = Sieve((TOPIC, "(?i)" + "|".join(rf"\b{re.escape(w)}" + ("" if w in V.TOPIC_PREFIXES else r"\b") for w in _WORDS)))


def names_topic(*texts: Column) -> Column:
    """Whether one of the texts has a term of the topic as a word of its own, or a word that begins with one of some."""
    every = squeeze(F.concat_ws(" ", *[text_of(t) for t in texts]))
    return once(F.struct(every.alias("t"), TOPIC_SIEVE.of(every).alias("bits")), lambda x: TOPIC_SIEVE.has(x["bits"], x["t"], TOPIC))
