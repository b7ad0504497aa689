"""Anchors, quotes and what they prove, as columns: extraction and validators that list what is wrong."""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import fixed as V
from granary.functions.sieve import Sieve
from granary.functions.text import cjk_share, count, matches, once, sentences, squeeze, strip, text_of

# Fixed values
COMPANY = (
    r"(?iU)\b(?:OpenAI|Anthropic|Google|Microsoft|Meta|NVIDIA|Apple|Amazon|Tesla|DeepMind|Hugging Face|HuggingFace|Mistral|Llama|Falcon|Gemini|Claude|GPT|xAI|Grok|Perplexity|Cohere|Stability AI|Midjourney|Runway"
    r"|IBM|Intel|AMD|Qualcomm|Samsung|ByteDance|Baidu|Alibaba|Tencent|Scale AI|Databricks|Snowflake|MongoDB|Pinecone|Weaviate)\b"
)
VERSION = r"(?iU)\b(?:v|version\s*)?\d+\.\d+(?:\.\d+)?(?:[a-z]\d*)?\b"
QUANTITY = r"(?U)\b\d+(?:\.\d+)?(?:x|%|B|M|K|bn|mn|trillion|billion|million)?\b"
TITLE_STOPS = (
    "the", "a", "an", "in", "on", "at", "to", "of", "for", "and", "or", "but", "with", "by", "from", "is", "are", "was", "were", "has", "have", "had", "its", "it", "that", "this", "these", "those", "as", "be",
    "will", "can", "not", "we", "our", "their", "new", "how", "what",
)
MONEY = r"(?iU)\$[\d,]+(?:\.\d+)?\s*(?:billion|million|trillion|B|M|T)\b|\b\d+(?:\.\d+)?\s*(?:billion|million)\s*(?:dollars?|USD)?|\b\d+億(?:元|美元|港幣|人民幣)|\b\d+萬美元|\b\d+(?:\.\d+)?\s*兆|\$\d{3,}(?:,\d{3})*(?:\.\d+)?(?:/(?:day|hr|hour|month|mo|year|wk))?\b"
GENERIC_VERSION = r"(?iU)\bv\d+(?:\.\d+){1,3}\b|\b\d{4}\.\d{1,2}\b|\b(?:R|V)\d{1,2}\b"
PARAMS = r"(?iU)(?<!\$)\b\d+(?:\.\d+)?\s*B\b(?!\s*(?:illion\b|yte\b|road\b|ase\b))"
BENCHMARKS = (
    "MMLU", "GPQA", "GPQA Diamond", "SWE-bench", "SWE-Bench", "SWEbench", "HumanEval", "HumanEval+", "MATH", "MATH-500", "HellaSwag", "WinoGrande", "ARC-Challenge", "GSM8K", "TruthfulQA", "BigBench", "BIG-Bench", "MT-Bench",
    "AlpacaEval", "HELM", "LMSys", "Chatbot Arena", "LiveBench", "AIME", "AMC", "leaderboard", "benchmark", "基準測試", "評測", "跑分", "排行榜", "基準", "Elo score", "arena score",
)
BOILERPLATE = r"最新公告顯示|確認.*原文出處|原文已提供.*依據|避免基於推測|引發.*(?:討論|關注|熱議)|具有.*(?:實質|重大).*(?:影響|意義)|各方.*(?:評估|追蹤).*後續"
UI_WORDS = (
    "sign", "sign up", "sign in", "subscribe", "login", "log in", "register", "privacy", "privacy policy", "terms", "terms of service", "cookie", "cookies", "home", "menu", "share", "follow", "click", "click here", "read more",
    "continue", "next", "previous", "back", "close", "search", "submit", "download", "upload", "comment", "comments", "reply", "like", "dislike", "settings", "account", "profile", "newsletter", "unsubscribe", "advertisement",
    "sponsored", "accept", "decline", "allow", "deny", "skip", "dismiss", "登入", "註冊", "訂閱", "隱私", "條款", "分享", "追蹤", "首頁", "選單", "搜尋", "下載", "留言", "回覆", "更多", "設定", "帳號", "關閉", "接受", "拒絕",
)
SHORT_ACRONYMS = (
    "AI", "ML", "US", "USA", "EU", "UK", "UN", "WHO", "FDA", "FAA", "FCC", "FTC", "EPA", "SEC", "DOJ", "FBI", "CIA", "NSA", "GDP", "IPO", "CEO", "CTO", "CFO", "API", "SDK", "GPU", "CPU", "TPU", "RAM", "SSD", "USB", "VPN", "DNS",
    "SSL", "TLS", "SQL", "AWS", "GCP", "ARM", "AMD", "IBM", "SAP", "BMW", "ESG", "ETF", "LLM", "NLP", "AGI", "ASI", "GPT", "CVE", "IOT", "EV",
)
GEOGRAPHY = ("desert", "river", "mountain", "lake", "valley", "island", "peninsula", "ocean", "sea", "forest", "plain", "plateau", "coast", "bay", "gulf", "canyon", "glacier", "volcano")
GEOGRAPHIC_CATEGORY = "氣候/能源"
TITLE_TOKEN_STOPS = ("the", "and", "for", "with", "from", "into", "about", "this", "that")


def distinct_ci(items: Column) -> Column:
    """The first of each text, whatever the case, in order."""

    def fold(out: Column, x: Column) -> Column:
        return F.when(F.exists(out, lambda y: F.lower(y) == F.lower(x)), out).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(items, F.array().cast("array<string>"), fold)


def event_anchors(title: Column, *texts: Column, most: int = 8) -> Column:
    """Companies, versions, numbers, then capitalised words of the title; each once."""
    every = squeeze(F.concat_ws(" ", text_of(title), *[text_of(t) for t in texts]))
    words = F.filter(F.transform(F.split(squeeze(title), " "), lambda w: F.regexp_replace(w, r"(?U)[^\w\-.]", "")), lambda w: w.rlike(r"^\p{Lu}") & ~F.lower(w).isin(*TITLE_STOPS) & (F.length(w) >= 3))
    found = F.concat(matches(every, COMPANY), matches(every, VERSION), matches(every, QUANTITY), words)
    return F.slice(distinct_ci(F.filter(F.transform(found, strip), lambda x: F.length(x) >= 2)), 1, most)


_NAMED = {k: rf"(?iU)\b\Q{k}\E\b" for k in BENCHMARKS}
ANCHOR_SIEVE = Sieve(V.MODELS, GENERIC_VERSION, MONEY, PARAMS, COMPANY, *((p, "(?i)" + re.escape(k)) for k, p in _NAMED.items()))


def typed_anchors(title: Column, text: Column, most: int = 5) -> Column:
    """Structs of (type, value) by rank of type: model, benchmark, money, params, version, company; none within another."""
    src = strip(F.concat_ws(" ", strip(text_of(title)), strip(text_of(text))))
    clean = lambda a: F.filter(F.transform(a, lambda x: F.regexp_replace(strip(x), "[.,;:!?]+$", "")), lambda x: F.length(x) >= 2)
    none = F.array().cast("array<string>")

    def ranked(name: str, points: int, found: Column) -> Column:
        longer = name in ("product", "money")
        return F.transform(found, lambda x, i: F.struct((-F.lit(points * 100) - (F.length(x) if longer else F.lit(0))).alias("r"), i.alias("i"), F.lit(name).alias("type"), x.alias("value")))

    def found(x: Column) -> Column:
        own = lambda p: clean(ANCHOR_SIEVE.matches(x["bits"], x["src"], p))
        bench = F.slice(F.array_compact(F.array(*[F.when(ANCHOR_SIEVE.has(x["bits"], x["src"], p), F.lit(k)) for k, p in _NAMED.items()])), 1, 1)
        version = lambda model: F.when(F.size(model) > 0, none).otherwise(own(GENERIC_VERSION))
        typed = lambda model: F.concat(*[ranked(*k) for k in [("product", 6, model), ("benchmark", 5, bench), ("money", 4, own(MONEY)), ("params", 3, own(PARAMS)), ("version", 2, version(model))]])
        company = F.transform(own(COMPANY), lambda x, i: F.struct(F.lit(0).alias("r"), i.alias("i"), F.lit("company").alias("type"), x.alias("value")))
        return once(once(own(V.MODELS), typed), lambda t: F.slice(F.array_sort(F.when(F.size(t) > 0, t).otherwise(company)), 1, most))

    def fold(out: Column, x: Column) -> Column:
        inside = F.exists(out, lambda y: F.contains(F.lower(y["value"]), F.lower(x["value"])) | F.contains(F.lower(x["value"]), F.lower(y["value"])))
        return F.when(inside, out).otherwise(F.concat(out, F.array(F.struct(x["type"], x["value"]))))

    best = once(F.struct(src.alias("src"), ANCHOR_SIEVE.of(src).alias("bits")), found)
    return F.aggregate(best, F.array().cast("array<struct<type: string, value: string>>"), fold)


def primary_anchor(anchors: Column) -> Column:
    """The value of the first typed anchor; null if there is none."""
    return F.try_element_at(anchors, F.lit(1))["value"]


def url_and_title_tokens(title: Column) -> Column:
    """Lower-cased words and CJK runs of a title, without stop words, each once."""
    found = F.regexp_extract_all(squeeze(title), F.lit("[A-Za-z][A-Za-z0-9\\-]{2,}|[\\u4e00-\\u9fff]{2,}"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda t: ~t.isin(*TITLE_TOKEN_STOPS)))


def _has(text: Column, items: Column) -> Column:
    low = F.lower(text)
    return F.exists(F.filter(items, lambda a: F.length(a) >= 2), lambda a: F.contains(low, F.lower(a)))


def quote_is_relevant(quote: Column, actor: Column, title_tokens: Column, anchors: Column) -> Column:
    """Whether a quote names the actor, two title words or an anchor, or one title word with a number."""
    q = F.lower(squeeze(quote))
    a = F.lower(squeeze(actor))
    shared = F.size(F.filter(title_tokens, lambda t: F.contains(q, t)))
    number = q.rlike(r"\d|[$€£¥%]")
    return (q != "") & (((a != "") & F.contains(q, a)) | (shared >= 2) | _has(q, anchors) | ((shared >= 1) & number))


def sentence_score(sentence: Column, actor: Column, title_tokens: Column, anchors: Column) -> Column:
    """2 for a number, 2 for the actor or two title words, 2 for an anchor."""
    s = F.lower(squeeze(sentence))
    shared = F.size(F.filter(title_tokens, lambda t: F.contains(s, t)))
    named = ((F.lower(squeeze(actor)) != "") & F.contains(s, F.lower(squeeze(actor)))) | (shared >= 2)
    return 2 * s.rlike(r"\d").cast("int") + 2 * named.cast("int") + 2 * _has(s, anchors).cast("int")


def long_enough(sentence: Column) -> Column:
    """20 CJK characters where there are any, else 40 characters."""
    n = count(text_of(sentence), "[\\u4e00-\\u9fff]")
    return F.when(n > 0, n >= 20).otherwise(F.length(squeeze(sentence)) >= 40)


def quoted(text: Column) -> Column:
    """The texts within quotation marks."""
    found = F.concat(*[F.regexp_extract_all(text_of(text), F.lit(p), F.lit(1)) for p in ("「([^」]+)」", '"([^"]+)"', "“([^”]+)”")])
    return F.filter(F.transform(found, strip), lambda x: x != "")


def has_window(text: Column, quote: Column, width: int = 10) -> Column:
    """Whether a stretch of `width` characters of the quote stands in the text; a shorter quote stands for itself."""
    t, q = squeeze(text), squeeze(quote)
    at = F.sequence(F.lit(1), F.greatest(F.length(q) - width + 1, F.lit(1)))
    return (q != "") & F.exists(at, lambda i: F.contains(t, F.substring(q, i, F.lit(width))))


def _codes(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, code) for bad, code in rules]))


def check_structure(text: Column, name: str, anchors: Column, actor: Column | None = None, quote: Column | None = None) -> Column:
    """The codes of what a generated sentence lacks: characters, an anchor (or the actor, or the quote's beginning), a window in corner brackets."""
    t = squeeze(text)
    named = _has(t, anchors)
    if actor is not None:
        a = squeeze(actor)
        named = named | ((a != "") & F.contains(F.lower(t), F.lower(a)))
    if quote is not None:
        head = F.lower(F.substring(squeeze(quote), 1, 20))
        named = named | ((head != "") & F.contains(F.lower(t), head))
    window = F.regexp_extract(t, "「(.+?)」", 1)
    open_ = F.contains(t, F.lit("「")) & F.contains(t, F.lit("」"))
    missing = f"{name}_NO_ACTOR_OR_ANCHOR" if actor is not None else f"{name}_NO_ANCHOR_OR_QUOTE_FRAG"
    low, no_window, short = (count(t, "[\\u4e00-\\u9fff]") < 15, f"{name}_CHARS_LOW"), (~open_, f"{name}_NO_QUOTE_WINDOW"), (open_ & (F.length(strip(window)) < 5), f"{name}_WINDOW_TOO_SHORT")
    rules = [low, (~named, missing), no_window, short] if actor is not None else [low, no_window, short, (~named, missing)]
    return F.when(t == "", F.array(F.lit(f"{name}_EMPTY"))).otherwise(_codes(*rules))


def check_boilerplate(*texts: Column) -> Column:
    """Codes of banned phrases, each once."""
    found = F.regexp_extract_all(F.concat_ws(" ", *[text_of(t) for t in texts]), F.lit(BOILERPLATE), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.concat(F.lit("BOILERPLATE:"), F.substring(x, 1, 30))))


def check_anchored(bullets: Column, anchors: Column) -> Column:
    """Codes of bullets without an anchor; none if there are no anchors."""
    usable = F.filter(anchors, lambda a: F.length(a) >= 2)
    bad = F.filter(bullets, lambda b: ~F.exists(usable, lambda a: F.contains(F.lower(b), F.lower(a))))
    return F.when(F.size(usable) == 0, F.array().cast("array<string>")).otherwise(F.transform(bad, lambda b: F.concat(F.lit("UNANCHORED_BULLET:"), F.substring(b, 1, 40))))


def frame_signature(sentence: Column, actor: Column, anchors: Column) -> Column:
    """A sentence's beginning and the hash of its first words, with actor, anchors and numbers masked."""
    low = F.lower(squeeze(sentence))
    a = F.lower(squeeze(actor))
    masked = F.when(a != "", F.replace(low, a, F.lit("actor"))).otherwise(low)
    masked = F.aggregate(F.transform(anchors, F.lower), masked, lambda s, x: F.when(x != "", F.replace(s, x, F.lit("anchor"))).otherwise(s))
    masked = F.regexp_replace(masked, r"\d+(?:[.,]\d+)*", "num")
    words = F.slice(F.array_distinct(F.filter(F.split(masked, r"(?U)\W+"), lambda w: (F.length(w) >= 3) & ~w.isin("the", "and", "for", "with", "from", "actor", "anchor", "num"))), 1, 6)
    return F.concat(F.substring(masked, 1, 24), F.lit("|"), F.substring(F.sha1(F.array_join(words, " ").cast("binary")), 1, 12))


def entity_reason(entity: Column, category: Column, key_points: Column, title: Column) -> Column:
    """Why an entity is noise: the first rule that hits; null if none does."""
    e = strip(text_of(entity))
    low = F.lower(e)
    mentioned = F.exists(key_points, lambda k: F.contains(F.lower(k), low)) | F.contains(F.lower(text_of(title)), low)
    kept = (text_of(category) == GEOGRAPHIC_CATEGORY) & mentioned
    return (
        F.when(F.length(e) <= 1, "too_short").when(e.rlike(r"(?U)^(?:\d+|\W+)$"), "numeric_or_symbol").when(e.rlike(r"https?://|www\.|\.com|\.org|\.net|\.io|/"), "url_fragment").when(low.isin(*UI_WORDS), "ui_word")
        .when((F.length(e) <= 3) & (e == F.upper(e)) & e.rlike(r"\p{Lu}") & ~e.isin(*SHORT_ACRONYMS), "unknown_short_acronym").when(low.isin(*GEOGRAPHY) & ~kept, "geo_generic")
    )


def clean_entities(entities: Column, category: Column, key_points: Column, title: Column) -> Column:
    """A struct of cleaned entities and of (entity, reason) removed."""
    own = F.filter(F.transform(entities, lambda e: strip(text_of(e))), lambda e: e != "")
    judged = F.transform(own, lambda e: F.struct(e.alias("entity"), entity_reason(e, category, key_points, title).alias("reason")))
    return F.struct(F.transform(F.filter(judged, lambda x: x["reason"].isNull()), lambda x: x["entity"]).alias("cleaned"), F.filter(judged, lambda x: x["reason"].isNotNull()).alias("removed"))


def is_foreign_heavy(text: Column, share: float = 0.35, least: int = 450) -> Column:
    """Whether a text of some length has few CJK characters."""
    return (cjk_share(text) < share) & (F.length(text_of(text)) >= least)


def evidence_share(text: Column) -> Column:
    """The share of sentences with a number."""
    s = sentences(text_of(text))
    return F.when(F.size(s) > 0, F.size(F.filter(s, lambda x: x.rlike(r"\d"))) / F.size(s)).otherwise(0.0)


def total_proof(*texts: Column) -> Column:
    return reduce(add, [count(text_of(t), p) for t in texts for p in V.STRICT_PROOF])


def narrative_faults(first: Column, second: Column, window_1: Column, window_2: Column, quote_1: Column, quote_2: Column) -> Column:
    """What is wrong with two narratives that show windows of quotes in corner brackets: codes in a fixed order, none if all is well."""
    q, w, src = ([text_of(c) for c in pair] for pair in ((first, second), (window_1, window_2), (quote_1, quote_2)))
    zh = lambda t: count(t, "[\\u4e00-\\u9fff]")
    both = F.concat(q[0], F.lit(" "), q[1])
    each = lambda rule: [rule(i) for i in (0, 1)]
    rules = [
        *each(lambda i: (w[i] == "", f"QW{i + 1}_EMPTY")), *each(lambda i: ((w[i] != "") & ~F.contains(q[i], F.concat(F.lit("「"), w[i], F.lit("」"))), f"Q{i + 1}_ZH_NO_WINDOW")),
        *each(lambda i: (zh(q[i]) < V.NARRATIVE_ZH, f"Q{i + 1}_ZH_CHARS_LOW")), *each(lambda i: ((q[i] != "") & (count(q[i], "[a-zA-Z]") / F.greatest(F.length(q[i]), F.lit(1)) > V.NARRATIVE_EN), f"Q{i + 1}_EN_RATIO_HIGH")),
        *each(lambda i: ((w[i] != "") & ~F.contains(src[i], w[i]), f"QW{i + 1}_NOT_SUBSTRING")), (both.rlike(V.NARRATIVE_STYLE), "STYLE_SANITY"), (both.rlike(V.NARRATIVE_NAMES), "NAMING"),
    ]
    return _codes(*rules)
