"""Sentences worth quoting, mined from a text as columns: split with clauses, a span of the text, tests, scores, then the best that do not repeat each other."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from granary.functions.evidence import url_and_title_tokens
from granary.functions.sieve import Sieve
from granary.functions.text import BLANKS, once, squeeze, strip, text_of

# Fixed values
BULLET = r"^\s*(?:[-*]|\d+\.)\s+"
CLAUSES = r"[,:;]\s+|\s+-\s+|\s+(?:and|while|which|that|with|including)\s+"
FEWER_CLAUSES = r"[,:;]\s+|\s+-\s+|\s+(?:and|while|which|that)\s+"
FRAME_STOPS = (
    "the", "and", "for", "with", "from", "into", "about", "this", "that", "will", "have", "has", "had", "are", "was", "were", "their", "there", "which", "while", "actor", "anchor", "num", "email", "source", "quote",
)
SENTENCE_LEAST, SENTENCE_LEAST_CJK, SENTENCE_MOST, QUOTE_LEAST, QUOTE_MOST = 40, 20, 360, 80, 220
EMAIL = r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
CALL_TO_ACTION = (
    r"(?i)(?:hear from|subscribe|newsletter|cookies|privacy|advertis|sign[\s\-]*up|register|terms|sponsor|promo|buy tickets|unsubscribe|manage subscription|upgrade to paid|paid subscriber|forwarded this email|view in browser"
    r"|get it in your inbox|leave a comment|share this post|restack|open in app|read in app|contact|verify outreach|feedback|would\s+love\s+to\s+hear|download(?:\s+here)?|join\s+the)"
)
IMPACT_WORDS = r"(?iU)\b(?:will|could|risk|impact|ban|regulation|launch|release|acquire|raise|lawsuit|fine|security|compliance|revenue|cost|pricing|roadmap|policy)\b"
ACTION_WORDS = r"(?iU)\b(?:launch|release|released|announc|open|partner|acquire|raise|rollout|ship|deploy|introduc|publish|expand|update)\b"
NUMBER_MARK = r"\d|[$€£¥%]"
FACT_STOP = (
    r"(?iU)\b(?:subscribe|newsletter|cookies?|privacy|advertis|sign[\s\-]*up|share|hear\s+from|contact|register|follow\s+us|join\s+us|join\s+the|unsubscribe|terms?|feedback|would\s+love\s+to\s+hear|download(?:\s+here)?|restack|open\s+in\s+app|read\s+in\s+app)\b"
)
FACT_BLOCK = "(?i)(?:@|mailto:|cookie|terms?)"
OPENER = r"(?iU)^(?:Here'?s?\s+what|We(?:'re|\s+are)\s+asking|(?:He|She)\s+said)\b"
FACT_MODEL = r"(?iU)\b(?:H\d{2,4}|A\d{2,4}|MI\d{2,4}|RTX\s?\d{3,4}|Blackwell|Hopper|GPT[-\s]?\d(?:\.\d+)?|Claude\s*\d(?:\.\d+)?|Gemini\s*\d(?:\.\d+)?)\b"
UPPER_TOKEN = r"(?U)\b[A-Z]{2,}[A-Z0-9\-]{0,}\b"
PROPER_NAME = r"(?U)\b(?:[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})+|OpenAI|Anthropic|NVIDIA|Google|Microsoft|Meta|Amazon|Apple|TSMC|Intel|AMD|Qualcomm|Samsung|Tesla)\b"
FACT_MONEY = r"(?iU)(?:\$|US\$|USD)\s*\d|\d\s*(?:USD|US\$)\b"
FACT_PERCENT = r"(?iU)\d[\d,\.]*\s*%|\bpercent\b"
IMPACT_CUE = r"(?iU)\b(?:will|enable|allow|expected|impact|revenue|customers|compliance|demand|margin|cost|adoption|risk|benefit|guardrails|latency|throughput|deploy|rollout|deadline|contract|pricing)\b"
GATE_CALL = r"(?iU)\b(?:subscribe|newsletter|sign[\s\-]*up|cookie[s]?|privacy\s+polic|adverti[sz]|sponsor(?:ed)?|hear\s+from|sessions?|ticket[s]?|register|follow\s+us|join\s+us)\b"
INFORMATIONAL = (
    r"(?iU)(?:\$\s*\d|\d+(?:[,\.]\d+)?\s*(?:%|percent|billion|million|trillion|\bB\b|\bM\b|x\b)|\b(?:19|20)\d{2}\b|\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\b|\bQ[1-4]\b|v\d+\.\d+|GPT[-\s]?\d|Claude\s*\d)"
)
WINDOW_NUMBER = r"(?U)\b\d[\d,]*(?:\.\d+)?"
WINDOW_NAME = r"(?iU)\b(?:Google|Microsoft|Apple|Amazon|Meta|OpenAI|Anthropic|NVIDIA|AI|LLM|GPT|Claude|HuggingFace|Azure|AWS|GCP|DeepMind|Tesla|IBM|ServiceNow|Gemini)\b"

QUOTE_HIDDEN = "(?U)[^\\w\\s\\u4e00-\\u9fff.,;:!?%$@#/&\\-()\\[\\]\"'`+]"
CJK = "[\\u4e00-\\u9fff]"

NONE = "array<string>"
#: Which patterns a sentence, or a clause of it, can match. A quote's characters are told by those that surely stay.
SIEVE = Sieve(
    (EMAIL, "@"), CALL_TO_ACTION, IMPACT_WORDS, ACTION_WORDS, NUMBER_MARK, FACT_STOP, FACT_BLOCK, OPENER, FACT_MODEL, UPPER_TOKEN, PROPER_NAME, FACT_MONEY, FACT_PERCENT, IMPACT_CUE, GATE_CALL, INFORMATIONAL, CJK,
    (QUOTE_HIDDEN, r"\?\?|[^ A-Za-z0-9_.,;:!?%$@#/&\-()\[\]\"'`+\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{4e00}-\x{9fff}]"),
)
#: Rows of a batch whose sentences are Python's at a time.
SLICE = 256


# Pieces -----------------------------------------------------------------------------------------------------------------
def clip(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.regexp_replace(F.substring(c, 1, most), r"\s+$", ""))


def distinct_by(items: Column, key: Callable[[Column], Column]) -> Column:
    """The first element of each key, in order; n log n for n elements, and no sorting where no key comes twice."""

    def of(items: Column) -> Column:
        ordered = F.array_sort(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
        firsts = once(ordered, lambda s: F.filter(s, lambda e, i: (i == 0) | (e["k"] != F.get(s, i - 1)["k"])))
        out = F.transform(F.array_sort(F.transform(firsts, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])
        return F.when(F.size(F.array_distinct(F.transform(items, key))) == F.size(items), items).otherwise(out)

    return once(items, of)


def token_set(c: Column) -> Column:
    """Lower-cased words of two letters and more, and CJK runs, without the words that frames share."""
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9][a-z0-9\\-]+|[\\u4e00-\\u9fff]{2,}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(*FRAME_STOPS)))


def shared_ratio(a: Column, b: Column) -> Column:
    """What two sets share against the smaller one; 0 if one is empty."""
    n = F.least(F.size(a), F.size(b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def key_tokens(c: Column) -> Column:
    """Numbers without separators, words of three letters and more, CJK runs."""
    s = squeeze(c)
    numbers = F.transform(F.regexp_extract_all(s, F.lit(r"\d[\d,.]*%?"), F.lit(0)), lambda x: F.lower(F.regexp_replace(x, r"[,.\s]", "")))
    words = F.filter(F.transform(F.regexp_extract_all(s, F.lit(r"[A-Za-z][A-Za-z0-9\-]{2,}"), F.lit(0)), F.lower), lambda t: ~t.isin(*FRAME_STOPS))
    return F.array_distinct(F.concat(numbers, words, F.regexp_extract_all(s, F.lit("[\\u4e00-\\u9fff]{2,}"), F.lit(0))))


_PARAGRAPHS, _BULLET, _SENTENCES, _CLAUSES = re.compile("[\n\r]+"), re.compile(BULLET, re.A), re.compile("(?<=[.!?;]) "), re.compile(CLAUSES, re.A)
_TOKENS, _BLANKS, _STOPS = re.compile("[a-z0-9][a-z0-9\\-]+|[\u4e00-\u9fff]{2,}"), re.compile(f"[{BLANKS}]+"), frozenset(FRAME_STOPS)


def _pieces(text: str) -> Iterator[str]:
    """The sentences of a text, each with its clauses that say what it does not. Tokens lie between the marks that part clauses, so these are the clauses without tokens."""
    odd = any(c in text for c in "\x1c\x1d\x1e\x1f")  # white space to Python alone
    squeezed = (lambda s: _BLANKS.sub(" ", s).strip(BLANKS)) if odd else (lambda s: " ".join(s.split()))
    for p in _PARAGRAPHS.split(text):
        if m := _BULLET.match(p):
            yield squeezed(p[m.end() :])
            continue
        for piece in _SENTENCES.split(squeezed(p)):
            yield (s := piece.strip(" -\t"))
            if len(s) > SENTENCE_LEAST:
                for c in (x.strip(" ") for x in _CLAUSES.split(s)):
                    if SENTENCE_LEAST <= len(c) < len(s) and all(x[0] in _STOPS for x in _TOKENS.finditer(c.lower())):
                        yield c


def _sentences_of(text: str | None) -> list[str]:
    """Each piece of a text once, whatever its case, cut at SENTENCE_MOST."""
    first: dict[str, str] = {}
    for s in _pieces(text or ""):
        first.setdefault(s.lower(), s)
    first.pop("", None)
    return [s if len(s) <= SENTENCE_MOST else s[:SENTENCE_MOST].rstrip(" ") for s in first.values()]


def _batches(text: pa.Array) -> Iterator[pa.ListArray]:
    for i in range(0, len(text), SLICE):
        yield pa.array([_sentences_of(x) for x in text.slice(i, SLICE).to_pylist()], pa.list_(pa.string()))


@arrow_udf(T.ArrayType(T.StringType()))
def _sentences(text: pa.Array) -> pa.Array:
    return pa.concat_arrays([*_batches(text), pa.array([], pa.list_(pa.string()))])


@arrow_udf(T.ArrayType(T.StructType([T.StructField("s", T.StringType()), T.StructField("g", T.LongType())])))
def _sieved(text: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("s", pa.string()), ("g", pa.int64())]))
    out = [pa.ListArray.from_arrays(x.offsets, pa.StructArray.from_arrays([x.values, SIEVE.bits(x.values)], names=["s", "g"])) for x in _batches(text)]
    return pa.concat_arrays([*out, pa.array([], kind)])


def source_sentences(text: Column) -> Column:
    """Sentences and, behind each, its clauses of some length that say less than it; items of lists as they are. Each once, whatever its case. Split in Arrow batches, so not for lambdas."""
    return _sentences(text)


def sieved_sentences(text: Column) -> Column:
    """Structs of s, what source_sentences() gives, and g, the bits of SIEVE: what miners take as `mined`."""
    return _sieved(text)


def widening_span(c: Column, spans: tuple[tuple[float, float], ...], least: int) -> Column:
    """A struct of start and items: the first span of shares of an array with `least` elements or more, or the last one if none has; a span has one element at least."""

    def of(c: Column) -> Column:
        n = F.size(c)

        def part(low: float, high: float) -> Column:
            a = F.greatest(F.lit(0), F.least(n - 1, F.floor(n * low).cast("int")))
            b = F.greatest(a + 1, F.least(n, F.floor(n * high).cast("int")))
            return F.struct(a.alias("start"), F.when(n > 0, F.slice(c, a + 1, b - a)).otherwise(F.filter(c, lambda _: F.lit(False))).alias("items"))

        def first(k: int) -> Column:
            return part(*spans[k]) if k + 1 == len(spans) else once(part(*spans[k]), lambda p: F.when(F.size(p["items"]) >= least, p).otherwise(first(k + 1)))

        return first(0)

    return once(c, of)


def has(s: Column, pattern: str, bits: Column | None = None) -> Column:
    """s.rlike(pattern), given the bits of s, or of a sentence that s is a clause of, if there are any."""
    return s.rlike(pattern) if bits is None else SIEVE.has(bits, s, pattern)


def is_call(s: Column) -> Column:
    """Empty, an address of mail, or what asks readers to do something."""
    return calls(s)


def calls(s: Column, bits: Column | None = None) -> Column:
    """is_call(), given the bits of s if there are any."""
    return (s == "") | has(s, EMAIL, bits) | has(s, CALL_TO_ACTION, bits)


def is_blocked(s: Column, bits: Column | None = None) -> Column:
    return calls(s, bits) | has(s, FACT_STOP, bits) | has(s, FACT_BLOCK, bits)


def long_enough(s: Column, bits: Column | None = None) -> Column:
    n = F.regexp_count(s, F.lit(CJK))
    cjk = F.when(n > 0, n >= SENTENCE_LEAST_CJK).otherwise(F.length(s) >= SENTENCE_LEAST)
    return cjk if bits is None else F.when(SIEVE.can(bits, CJK), cjk).otherwise(F.length(s) >= SENTENCE_LEAST)


def signals(s: Column, bits: Column | None = None) -> Column:
    """A struct of what a sentence has: number, money, percent, model, upper_token and impact."""
    digit = s.rlike(r"\d") if bits is None else SIEVE.can(bits, NUMBER_MARK) & s.rlike(r"\d")
    percent = digit | F.contains(F.lower(s), F.lit("percent"))
    can = F.lit(True) if bits is None else SIEVE.can(bits, FACT_PERCENT)
    return F.struct(
        digit.alias("number"), (digit & has(s, FACT_MONEY, bits)).alias("money"), (can & percent & s.rlike(FACT_PERCENT)).alias("percent"), has(s, FACT_MODEL, bits).alias("model"),
        (has(s, UPPER_TOKEN, bits) | has(s, PROPER_NAME, bits)).alias("upper_token"), has(s, IMPACT_CUE, bits).alias("impact"),
    )


def can_be_strong(bits: Column) -> Column:
    return SIEVE.any(bits, NUMBER_MARK, FACT_PERCENT, FACT_MODEL, UPPER_TOKEN, PROPER_NAME)


def strong(x: Column) -> Column:
    return x["number"].cast("int") + x["money"].cast("int") + x["percent"].cast("int") + x["model"].cast("int") + x["upper_token"].cast("int")


def named(s: Column, low: Column, names: Column) -> Column:
    """How many of the names, as marked() gives them, a sentence has, whatever the case of ASCII ones."""
    return F.size(F.filter(names, lambda a: F.when(a["odd"], F.contains(s, a["name"])).otherwise(F.contains(low, a["low"]))))


def names_of(anchors: Column, *more: Column) -> Column:
    every = F.concat(F.coalesce(anchors, F.array().cast(NONE)), F.array(*more)) if more else F.coalesce(anchors, F.array().cast(NONE))
    return F.filter(F.transform(every, squeeze), lambda a: a != "")


def marked(names: Column) -> Column:
    """Structs of name, low and odd, which says that a name is not of ASCII alone."""
    return F.transform(names, lambda a: F.struct(a.alias("name"), F.lower(a).alias("low"), a.rlike(r"[^\x00-\x7F]").alias("odd")))


def within(low: Column, words: Column) -> Column:
    """How many of the words a lower-cased sentence has."""
    return F.size(F.filter(words, lambda t: F.contains(low, t)))


def firsts(items: Column, most: Column | int, good: Callable[[Column], Column]) -> Column:
    """The first `most` good ones of an array, of which no more are looked at than it takes."""
    none = F.filter(items, lambda _: F.lit(False))
    return F.aggregate(items, none, lambda out, x: F.when(F.size(out) >= most, out).when(good(x), F.concat(out, F.array(x))).otherwise(out))


def apart(ranked: Column, most: int, overlap: float) -> Column:
    """Of structs with tokens, in their order, each that shares less than `overlap` with those taken before, up to `most`."""
    none = F.filter(ranked, lambda _: F.lit(False))
    return F.aggregate(ranked, none, lambda out, x: F.when((F.size(out) >= most) | F.exists(out, lambda y: shared_ratio(y["tokens"], x["tokens"]) >= overlap), out).otherwise(F.concat(out, F.array(x))))


# Miners -----------------------------------------------------------------------------------------------------------------
def sentence_candidates(text: Column, title: Column, actor: Column, anchors: Column, most: int = 20, spans: tuple = ((0.15, 0.75), (0.10, 0.85)), least: int = 8, overlap: float = 0.75) -> Column:
    """Structs of text, score and index: scored_candidates() without their bits."""
    every = scored_candidates(text, title, actor, anchors, most, spans, least, overlap)
    return F.transform(every, lambda x: F.struct(x["text"], x["score"], x["index"]))


def scored_candidates(text: Column, title: Column, actor: Column, anchors: Column, most: int = 20, spans: tuple = ((0.15, 0.75), (0.10, 0.85)), least: int = 8, overlap: float = 0.75, mined: Column | None = None) -> Column:
    """Structs of text, score, index and g, its bits: the best sentences of a text's middle, which widens if it has few; ties go to the earlier one.

    2 for a number, 2 for the actor or two words of the title, 2 for an anchor, 1 for an impact, 1 for an action; a score of 0 is out.
    """

    def scored(f: Column) -> Column:
        # Lengths first, then points, then calls: the next test sees what the one before leaves.
        def one(x: Column) -> Column:
            s, low, g = x["s"], x["low"], x["g"]
            own = ((f["actor"] != "") & F.contains(low, f["actor"])) | (within(low, f["words"]) >= 2)
            points = (
                2 * has(s, NUMBER_MARK, g).cast("int") + 2 * own.cast("int") + 2 * (named(s, low, f["names"]) > 0).cast("int")
                + has(s, IMPACT_WORDS, g).cast("int") + has(s, ACTION_WORDS, g).cast("int")
            )
            return F.struct((-points).alias("r"), x["i"].alias("index"), s.alias("text"), g.alias("g"))

        # What all words of a title are looked for in is lower-cased once.
        numbered = F.transform(F.filter(F.transform(f["span"]["items"], lambda x, i: F.struct(x["s"], x["g"], i.alias("i"))), lambda x: long_enough(x["s"], x["g"])), lambda x: F.struct(x["s"], x["g"], x["i"], F.lower(x["s"]).alias("low")))
        every = F.filter(F.transform(numbered, one), lambda x: (x["r"] < 0) & ~calls(x["text"], x["g"]))
        ranked = F.transform(F.sort_array(every), lambda x: F.struct(x["text"].alias("text"), (-x["r"]).alias("score"), x["index"].alias("index"), x["g"].alias("g"), token_set(x["text"]).alias("tokens")))
        return F.transform(apart(ranked, most, overlap), lambda x: F.struct(x["text"], x["score"], x["index"], x["g"]))

    pieces = sieved_sentences(text) if mined is None else mined
    facts = F.struct(widening_span(pieces, spans, least).alias("span"), url_and_title_tokens(title).alias("words"), F.lower(squeeze(actor)).alias("actor"), marked(names_of(anchors)).alias("names"))
    return once(facts, scored)


def fact_pack(text: Column, title: Column, actor: Column, anchors: Column, most: int = 12, least: int = 6, span: tuple[float, float] = (0.10, 0.85), overlap: float = 0.92, mined: Column | None = None) -> Column:
    """Structs of text, score, strong, title, anchor and index: sentences with evidence, or if these are fewer than `least` their clauses, too.

    In order of score, evidence, words of the title, anchors and place. A sentence's evidence counts twice, and an impact once; a clause's once.
    """

    def packed(f: Column) -> Column:
        def facts_of(x: Column, clause: bool) -> Column:
            s, low = x["s"], x["low"]
            own = F.struct(strong(x["h"]).alias("n"), within(low, f["words"]).alias("title"), named(s, low, f["names"]).alias("anchor"))

            def ranked(y: Column) -> Column:
                score = (y["n"] if clause else 2 * y["n"] + x["h"]["impact"].cast("int")) + y["title"] + y["anchor"]
                return F.struct((-score).alias("r"), (-y["n"]).alias("r2"), (-y["title"]).alias("r3"), (-y["anchor"]).alias("r4"), x["i"].alias("index"), s.alias("text"))

            return once(own, ranked)

        def evident(numbered: Column, clause: bool) -> Column:
            """Facts of structs (s, i, g): of some length, with evidence, no opening phrase and not blocked; each test sees what the one before leaves."""
            long = F.filter(numbered, lambda x: F.length(x["s"]) >= (20 if clause else 24))
            strong_ = F.filter(F.transform(long, lambda x: F.struct(x["s"], x["i"], x["g"], signals(x["s"], x["g"]).alias("h"))), lambda x: strong(x["h"]) > 0)
            opener = lambda x: has(x["s"], OPENER, x["g"]) & ~x["s"].rlike(r"\d|[$€£¥]")
            open_ = F.filter(strong_, lambda x: (F.lit(True) if clause else ~opener(x)) & ~is_blocked(x["s"], x["g"]))
            return F.transform(F.transform(open_, lambda x: F.struct(x["s"], x["i"], x["h"], F.lower(x["s"]).alias("low"))), lambda x: facts_of(x, clause))

        cut_up = lambda y: F.transform(F.split(y["s"], FEWER_CLAUSES), lambda c: F.struct(strip(c).alias("s"), F.lit(0).alias("i"), y["g"].alias("g")))
        new = lambda w: F.filter(F.flatten(F.transform(f["strong"], cut_up)), lambda c: ~F.exists(w, lambda x: F.lower(x["text"]) == F.lower(c["s"])))
        good = lambda w: distinct_by(evident(new(w), True), lambda x: F.lower(x["text"]))
        clauses = lambda w: F.slice(good(w), F.lit(1), F.lit(3 * most) - F.size(w))
        later = lambda w: F.transform(clauses(w), lambda x, i: F.struct(x["r"], x["r2"], x["r3"], x["r4"], (F.lit(2000) + F.size(w) + i).alias("index"), x["text"]))
        every = once(evident(f["strong"], False), lambda w: F.when(F.size(w) >= least, w).otherwise(F.concat(w, later(w))))
        order = F.transform(F.sort_array(every), lambda x: F.struct(x["text"].alias("text"), (-x["r"]).alias("score"), (-x["r2"]).alias("strong"), (-x["r3"]).alias("title"), (-x["r4"]).alias("anchor"), x["index"].alias("index"), token_set(x["text"]).alias("tokens")))
        return F.transform(apart(order, most, overlap), lambda x: F.struct(x["text"], x["score"], x["strong"], x["title"], x["anchor"], x["index"]))

    def evidence_of(f: Column) -> Column:
        start = f["span"]["start"]
        # A sentence that can match no pattern of evidence has none, nor has a clause of it.
        items = F.filter(F.transform(f["span"]["items"], lambda x, i: F.struct(x["s"], (start + i).alias("i"), x["g"])), lambda x: can_be_strong(x["g"]))
        return once(F.struct(items.alias("strong"), f["words"].alias("words"), f["names"].alias("names")), packed)

    pieces = sieved_sentences(text) if mined is None else mined
    facts = F.struct(widening_span(pieces, (span,), 0).alias("span"), url_and_title_tokens(title).alias("words"), marked(names_of(anchors, actor)).alias("names"))
    return once(facts, evidence_of)


def quote_text(c: Column) -> Column:
    """Without characters that reports do not show."""
    return squeeze(F.regexp_replace(F.replace(squeeze(c), F.lit("??"), F.lit(" ")), QUOTE_HIDDEN, " "))


def _quote(x: Column) -> Column:
    """A struct of q, a sentence of sieved_sentences() as reports show it, and g, its bits: all where it is not as it was."""
    same = ~SIEVE.can(x["g"], QUOTE_HIDDEN) & (F.length(x["s"]) <= QUOTE_MOST)
    return F.struct(F.when(same, x["s"]).otherwise(clip(F.when(SIEVE.can(x["g"], QUOTE_HIDDEN), quote_text(x["s"])).otherwise(x["s"]), QUOTE_MOST)).alias("q"), F.when(same, x["g"]).otherwise(F.lit(SIEVE.all).cast("long")).alias("g"))


def _quotes(text: Column, seed: Column | None, spans: tuple, mined: Column | None) -> Column:
    def of(s: Column) -> Column:
        span = once(widening_span(s, spans[:1], 0), lambda p: F.when((F.size(p["items"]) < 3) & (F.size(s) >= 3), widening_span(s, spans[1:], 0)["items"]).otherwise(p["items"]))
        own = F.transform(F.filter(span, lambda x: long_enough(x["s"], x["g"])), _quote)
        first = [] if seed is None else [F.array(F.struct(clip(quote_text(squeeze(seed)), QUOTE_MOST).alias("q"), F.lit(SIEVE.all).cast("long").alias("g")))]
        return F.filter(F.concat(*first, own), lambda x: x["q"] != "")

    return distinct_by(once(sieved_sentences(text) if mined is None else mined, of), lambda x: F.lower(x["q"]))


def quote_candidates(text: Column, seed: Column | None = None, spans: tuple = ((0.15, 0.75), (0.10, 0.85))) -> Column:
    """The seed, then the long sentences of a text's middle, which widens below three; as reports show them, each once."""
    return F.transform(_quotes(text, seed, spans, None), lambda x: x["q"])


def is_relevant(quote: Column, title: Column, actor: Column, anchors: Column) -> Column:
    """A quote that names the actor, two words of the title or an anchor, or one word of the title with a number, an impact or an action."""
    return once(F.struct(quote.alias("q"), F.lower(quote).alias("low")), lambda x: _near(x["q"], x["low"], url_and_title_tokens(title), F.lower(squeeze(actor)), marked(names_of(anchors))))


def _near(quote: Column, low: Column, words: Column, actor: Column, names: Column, bits: Column | None = None) -> Column:
    said = has(quote, NUMBER_MARK, bits) | has(quote, IMPACT_WORDS, bits) | has(quote, ACTION_WORDS, bits)
    hits = lambda n: (n >= 2) | ((n >= 1) & said)
    return (quote != "") & (((actor != "") & F.contains(low, actor)) | (named(quote, low, names) > 0) | once(within(low, words), hits))


def relevant_quotes(text: Column, title: Column, actor: Column, anchors: Column, seed: Column | None = None, avoid: Column | None = None, most: int = 8, spans: tuple = ((0.15, 0.75), (0.10, 0.85))) -> Column:
    """The first quotes of 80 characters and more that are relevant, no call, and not to be avoided."""
    gone = F.transform(F.coalesce(avoid, F.array().cast(NONE)), lambda x: F.lower(squeeze(x))) if avoid is not None else F.array().cast(NONE)
    words, own, names = url_and_title_tokens(title), F.lower(squeeze(actor)), marked(names_of(anchors))

    def good(x: Column, f: Column) -> Column:
        near = lambda low: ~F.array_contains(f["gone"], low) & _near(x["q"], low, f["words"], f["actor"], f["names"], x["g"])
        return (F.length(x["q"]) >= QUOTE_LEAST) & once(F.lower(x["q"]), near) & ~calls(x["q"], x["g"])

    # What the row's title, actor and anchors give is made once, not for each quote.
    facts = F.struct(_quotes(text, seed, spans, None).alias("q"), gone.alias("gone"), words.alias("words"), own.alias("actor"), names.alias("names"))
    return once(facts, lambda f: F.transform(firsts(f["q"], most, lambda x: good(x, f)), lambda x: x["q"]))


def fact_candidates(text: Column, title: Column, actor: Column, anchors: Column, most: int = 15) -> Column:
    """The texts of told_candidates()."""
    return F.transform(told_candidates(text, title, actor, anchors, most), lambda x: x["s"])


def told_candidates(text: Column, title: Column, actor: Column, anchors: Column, most: int = 15, mined: Column | None = None) -> Column:
    """Structs of s and g, its bits: sentences of 40 to 600 characters that share words with title, actor and anchors: first those with figures or dates, which need one word, then others, which need two (one if there are two words at most)."""
    words = lambda c: F.transform(F.regexp_extract_all(text_of(c), F.lit("[A-Za-z0-9]{3,}"), F.lit(0)), F.lower)
    topic = F.array_distinct(F.concat(words(title), words(actor), F.flatten(F.transform(F.coalesce(anchors, F.array().cast(NONE)), words))))

    def of(f: Column) -> Column:
        need = F.when(F.size(f["topic"]) <= 2, 1).otherwise(2)
        near = F.filter(F.transform(F.filter(f["s"], lambda x: F.length(x["s"]).between(40, 600)), lambda x: F.struct(x["s"], x["g"], F.size(F.array_intersect(words(x["s"]), f["topic"])).alias("n"))), lambda x: (x["n"] >= 1) & ~has(x["s"], GATE_CALL, x["g"]))
        judged = F.transform(near, lambda x: F.struct(x["s"], x["g"], x["n"], has(x["s"], INFORMATIONAL, x["g"]).alias("info")))
        take = lambda j, info, n: F.transform(F.filter(j, lambda x: (x["info"] == info) & (x["n"] >= n)), lambda x: F.struct(x["s"], x["g"]))
        return once(judged, lambda j: F.slice(F.concat(take(j, F.lit(True), F.lit(1)), take(j, F.lit(False), need)), 1, most))

    return once(F.struct((sieved_sentences(text) if mined is None else mined).alias("s"), topic.alias("topic")), of)


def quote_window(quote: Column, least: int = 20, most: int = 30) -> Column:
    """The stretch of whole words of some length with the most numbers (3 each), names (2 each) and characters; the first of the best.

    One pass over the words: the open stretches, which `most` bounds, grow by a word and go when they are too long. Without
    such a stretch the beginning, cut at a blank if enough is left.
    """

    def best(q: Column) -> Column:
        words = F.split(q, " ")
        none = F.array().cast("array<struct<n: int, w: int, a: int>>")
        begin = F.struct(none.alias("open"), F.lit(0).alias("i"), F.lit(None).cast("struct<score: int, a: int, b: int>").alias("best"))

        def step(s: Column, word: Column) -> Column:
            w = 3 * F.regexp_count(word, F.lit(WINDOW_NUMBER)) + 2 * F.regexp_count(word, F.lit(WINDOW_NAME))
            grown = F.filter(F.transform(s["open"], lambda o: F.struct((o["n"] + 1 + F.length(word)).alias("n"), (o["w"] + w).alias("w"), o["a"].alias("a"))), lambda o: o["n"] <= most)
            now = F.concat(grown, F.filter(F.array(F.struct(F.length(word).alias("n"), w.alias("w"), s["i"].alias("a"))), lambda o: o["n"] <= most))

            def after(open_: Column) -> Column:
                # Signs turned, so that the largest is the earliest of the best.
                found = F.array_max(F.transform(F.filter(open_, lambda o: o["n"] >= least), lambda o: F.struct((o["n"] + o["w"]).alias("score"), (-o["a"]).alias("a"), (-s["i"]).alias("b"))))
                return F.struct(open_.alias("open"), (s["i"] + 1).alias("i"), F.array_max(F.array_compact(F.array(s["best"], found))).alias("best"))

            return once(now, after)

        def text_of_best(x: Column) -> Column:
            head = F.substring(q, 1, most)
            last = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
            cut = F.when(F.contains(head, F.lit(" ")) & (last >= least), F.substring(head, F.lit(1), last)).otherwise(head)
            return F.when(x.isNotNull(), F.array_join(F.slice(words, 1 - x["a"], x["a"] - x["b"] + 1), " ")).otherwise(F.when(F.length(q) > most, cut).otherwise(q))

        return F.when(F.length(q).between(least, most) | (q == ""), q).otherwise(once(F.aggregate(words, begin, step)["best"], text_of_best))

    return once(squeeze(quote), best)
