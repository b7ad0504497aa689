"""Text features as columns. A null text counts as empty."""

from __future__ import annotations

from collections.abc import Callable, Iterable
import re
from functools import reduce
from operator import add, or_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from granary.functions import fixed as V
from granary.functions.sieve import Sieve


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


#: White space of any kind, as (?U)\\s has it.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


#: V.SENTENCE for RE2.
PIECE = r"[^.!?。？！\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}][^.!?。？！]*"


def strip(c: Column) -> Column:
    """Without white space of any kind at its ends; linear, whatever runs of it stand inside."""
    return F.btrim(c, F.lit(BLANKS))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once, however often f names it: the optimizer does not copy what a lambda is given."""
    return F.element_at(F.transform(F.array(c), f), 1)


def lowered(t: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(t, lower-cased t), both computed once."""
    return once(once(t, lambda x: F.struct(x.alias("t"), F.lower(x).alias("low"))), lambda x: f(x["t"], x["low"]))


def squeeze(c: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return strip(F.regexp_replace(text_of(c), r"(?U)\s+", " "))


def truncate(c: Column, limit: int = 5000) -> Column:
    c = text_of(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def strip_tags(c: Column) -> Column:
    """Tags as spaces and the entities of markup resolved; white space squeezed."""
    out = F.regexp_replace(text_of(c), "<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return squeeze(out)


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def matches(c: Column, pattern: str) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(c, F.lit(f"({pattern})" if not pattern.startswith("(?") else f"{pattern[: pattern.index(')') + 1]}({pattern[pattern.index(')') + 1 :]})"), F.lit(1))


def hits(lower: Column, words: Iterable[str]) -> Column:
    """How many of the words a lower-cased text contains as substrings."""
    return reduce(add, [F.contains(lower, F.lit(w)).cast("int") for w in words])


def has_any(lower: Column, words: Iterable[str]) -> Column:
    return reduce(or_, [F.contains(lower, F.lit(w)) for w in words])


def first_of(scores: dict[str, Column]) -> Column:
    """The name of the largest score; the first one wins a tie."""
    return F.array_max(F.array(*[F.struct(s.cast("int").alias("s"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, s) in enumerate(scores.items())]))["n"]


def sentences(c: Column, ends: str = V.SENTENCE_END) -> Column:
    """The pieces between sentence ends that hold more than white space, stripped."""
    return F.filter(F.transform(F.split(c, ends), strip), lambda x: x != "")


def count_sentences(c: Column) -> Column:
    """How many pieces between sentence ends hold more than white space; none of them is built. Counted in Arrow batches, so not for lambdas."""
    return _pieces(text_of(c))


@arrow_udf(T.IntegerType())
def _pieces(t: pa.Array) -> pa.Array:
    return pc.count_substring_regex(t, PIECE)


def sieved(t: Column, raw: Column, sieve: Sieve, f: Callable[[Column, Column, Column], Column]) -> Column:
    """f(t, lower-cased t, bits), each computed once: the bits of the raw text that t was made of, whose matches are those of t but for white space."""
    return once(once(F.struct(t.alias("t"), sieve.of(raw).alias("bits")), lambda x: F.struct(x["t"].alias("t"), F.lower(x["t"]).alias("low"), x["bits"].alias("bits"))), lambda x: f(x["t"], x["low"], x["bits"]))


_ANY = lambda words: "(?i)" + "|".join(map(re.escape, words))
DENSITY_SIEVE = Sieve(V.DENSITY_NUMBER, ("hints", _ANY(V.MODEL_HINTS)))
INFO_SIEVE = Sieve(("entities", _ANY(V.INFO_ENTITIES)), ("boiler", _ANY(V.BOILERPLATE).replace(r"\ ", r"[\s\x0b\x1c-\x1f\x{85}\pZ]+")), V.INFO_NUMBER, V.INFO_DOTS, V.INFO_CONNECTOR, "[一-鿿]")
SEMANTIC_SIEVE = Sieve(V.DOMAIN_TERMS, V.EVIDENCE_NUMBER, V.TEMPLATE_REMNANT)
UI_SIEVE = Sieve(*(p for p, _ in (*V.UI_STRONG, *V.UI_SHORT)))


def density_score(c: Column) -> Column:
    """Numbers, names and sentences as points from 0 to 100."""

    def score(t: Column, low: Column, bits: Column) -> Column:
        names = count(t, V.DENSITY_ENTITY) + F.when(DENSITY_SIEVE.can(bits, "hints"), hits(low, V.MODEL_HINTS)).otherwise(0)
        points = F.least(F.lit(40), DENSITY_SIEVE.count(bits, t, V.DENSITY_NUMBER) * 12) + F.least(F.lit(35), names * 8)
        return F.struct((t == "").alias("empty"), points.alias("points"))

    def result(x: Column) -> Column:
        points = x["d"]["points"] + F.least(F.lit(25), F.greatest(x["n"] - 1, F.lit(0)) * 7)
        return F.when(x["d"]["empty"], 0).otherwise(F.least(F.lit(100), points)).cast("int")

    # Sentences do not change with blanks at a text's ends.
    return once(F.struct(sieved(strip(text_of(c)), text_of(c), DENSITY_SIEVE, score).alias("d"), count_sentences(c).alias("n")), result)


def mixed_tokens(t: Column) -> Column:
    """Runs of three or more letters, digits and CJK characters from whose beginning on a Latin letter and a CJK character are still to come, in a text on one line."""
    upto = lambda kind: F.length(F.regexp_extract(t, rf"(?s)^.*{kind}", 0))
    last = F.least(upto("[A-Za-z]"), upto("[一-鿿]"))
    head = F.concat(F.substring(t, F.lit(1), last), F.regexp_extract(F.substring(t, last + 1, F.length(t)), rf"^{V.INFO_RUN}*", 0))
    return F.when(last > 0, F.regexp_extract_all(head, F.lit(V.INFO_RUN + "{3,}"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def info_density(c: Column) -> Column:
    """A struct of entity_hits, numeric_hits, sentence_count, boilerplate_hits, fragment_penalty and score."""

    def parts_of(t: Column, low: Column, bits: Column) -> Column:
        parts = sentences(t)
        has = lambda p: INFO_SIEVE.has(bits, t, p).cast("int")
        mixed = F.when(INFO_SIEVE.can(bits, "[一-鿿]"), F.size(F.array_distinct(mixed_tokens(t)))).otherwise(0)
        found = lambda kind, words: F.when(INFO_SIEVE.can(bits, kind), hits(low, words)).otherwise(0)
        entities = found("entities", V.INFO_ENTITIES) + F.size(F.array_distinct(matches(t, V.INFO_ENTITY))) + mixed
        short = once(parts, lambda p: F.struct(F.size(p).alias("n"), F.size(F.filter(p, lambda x: F.length(x) < 32)).alias("short")))
        return F.struct((t == "").alias("empty"), entities.alias("e"), INFO_SIEVE.count(bits, t, V.INFO_NUMBER).alias("num"), short.alias("s"), found("boiler", V.BOILERPLATE).alias("boiler"), (has(V.INFO_DOTS) + has(V.INFO_CONNECTOR)).alias("cut"))

    def result(x: Column) -> Column:
        n = x["s"]["n"]
        penalty = F.least(F.lit(2), x["cut"] + ((n > 0) & (x["s"]["short"] * 10 > n * 6)).cast("int"))
        score = 20 * F.least(F.lit(3), x["e"]) + 15 * F.least(F.lit(3), x["num"]) + 10 * F.least(F.lit(5), F.greatest(n - 1, F.lit(0))) - 25 * F.least(F.lit(2), x["boiler"]) - 20 * penalty
        pick = lambda v, e=0: F.when(x["empty"], e).otherwise(v).cast("int")
        return F.struct(
            pick(x["e"]).alias("entity_hits"), pick(x["num"]).alias("numeric_hits"), pick(n).alias("sentence_count"), pick(x["boiler"], 1).alias("boilerplate_hits"), pick(penalty, 2).alias("fragment_penalty"),
            pick(F.greatest(F.lit(0), F.least(F.lit(100), score))).alias("score"),
        )

    return once(sieved(squeeze(c), text_of(c), INFO_SIEVE, parts_of), result)


def cjk_share(c: Column) -> Column:
    t = text_of(c)
    n = F.length(strip(t))
    return F.when(n > 0, count(t, V.CJK) / n).otherwise(0.0)


def detect_language(c: Column) -> Column:
    """zh, mixed or en by the share of CJK characters."""
    share = cjk_share(c)
    return F.when(share > 0.3, "zh").when(share > 0.05, "mixed").otherwise("en")


def zh_ratio(c: Column) -> Column:
    t = text_of(c)
    n = F.length(t)
    return F.when(n > 0, F.round(count(t, "[\\u4e00-\\u9fff]") / n, 3)).otherwise(0.0)


def symbol_density(c: Column) -> Column:
    """The share of characters that are neither letters nor digits."""
    t = text_of(c)
    n = F.length(t)
    return F.when(n > 0, 1 - count(t, r"[\p{L}\p{N}]") / n).otherwise(0.0)


def junk_ratio(c: Column) -> Column:
    """The share of characters that are no letters, digits or white space; 1 for an empty text."""
    t = text_of(c)
    n = F.length(t)
    return F.when(n > 0, count(t, r"[^\p{L}\p{N}\s]") / n).otherwise(1.0)


def article_quality(c: Column, least: int = 400, junk: float = 0.3) -> Column:
    """What is wrong with an article's text: empty, too_short or junk; null if nothing."""
    t = strip(text_of(c))
    return F.when(t == "", "extract_empty").when((F.length(t) < least) | (junk_ratio(t) > junk), "extract_low_quality")


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(text_of(c), "\n"), strip), lambda x: x != "")


def ui_garbage_score(c: Column) -> Column:
    """The share of lines of user interfaces and the weight of what they say, from 0 to 1."""
    every = [*V.UI_STRONG, *V.UI_SHORT]

    def of(f: Column) -> Column:
        weight = lambda x: reduce(add, [F.when(UI_SIEVE.has(f["bits"], x, p), F.lit(w)).otherwise(0.0) for p, w in every])
        return once(F.struct(F.size(f["lines"]).alias("n"), F.when(f["bits"] != 0, F.transform(f["lines"], weight)).otherwise(F.array().cast("array<double>")).alias("w")), score_of)

    def score_of(x: Column) -> Column:
        hit, total = F.size(F.filter(x["w"], lambda w: w > 0)), F.aggregate(x["w"], F.lit(0.0), add)
        score = hit / x["n"] * 0.6 + F.least(F.lit(1.0), total / sum(w for _, w in every)) * 0.4
        return F.when(x["n"] > 0, F.round(F.least(F.lit(1.0), score), 4)).otherwise(0.0)

    return once(F.struct(_lines(c).alias("lines"), UI_SIEVE.of(text_of(c)).alias("bits")), of)


def has_ui_tokens(c: Column) -> Column:
    return once(F.struct(text_of(c).alias("t"), UI_SIEVE.of(text_of(c)).alias("bits")), lambda x: reduce(or_, [UI_SIEVE.has(x["bits"], x["t"], p) for p, _ in V.UI_STRONG]))


def clean_raw_text(c: Column, limit: int = V.CLEAN_LIMIT) -> Column:
    """Without lines of user interfaces, short lines of symbols and repeated blank lines; cut at a line end near the limit."""
    t = F.regexp_replace(text_of(c), "\r\n?", "\n")
    t = strip(F.regexp_replace(F.regexp_replace(t, r"(?U)[^\S\n]+(?=\n|$)", ""), "\n{3,}", "\n\n"))
    strong, short = "|".join(f"(?:{p})" for p, _ in V.UI_STRONG), "|".join(f"(?:{p})" for p, _ in V.UI_SHORT)
    keep = lambda x: ~(strip(x).rlike(strong) | ((F.length(strip(x)) <= 40) & strip(x).rlike(short)) | ((strip(x) != "") & (F.length(strip(x)) < 60) & (symbol_density(strip(x)) > 0.5)))
    out = strip(F.array_join(F.filter(F.split(t, "\n"), keep), "\n"))
    head = F.substring(out, 1, limit)
    last = F.length(head) - F.length(F.substring_index(head, "\n", -1)) - 1
    cut = F.when(F.contains(head, F.lit("\n")) & (last > int(limit * 0.8)), F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(out) > limit, cut).otherwise(out)


def evidence_terms(c: Column) -> Column:
    """How many different domain terms and proper nouns a text has, whatever their case."""
    t = text_of(c)
    nouns = F.array_except(matches(t, V.PROPER_NOUN), F.array(*map(F.lit, V.NOT_PROPER)))
    return F.size(F.array_distinct(F.transform(F.concat(matches(t, V.DOMAIN_TERMS), nouns), F.lower)))


def evidence_numbers(c: Column) -> Column:
    return count(text_of(c), V.EVIDENCE_NUMBER)


def is_fragment(c: Column) -> Column:
    """Whether a text is hollow: empty, a lone bullet, a remnant of a template, too short or left dangling."""
    s = strip(text_of(c))
    return _hollow(s, s.rlike(V.TEMPLATE_REMNANT))


def _hollow(s: Column, remnant: Column) -> Column:
    bare = F.replace(s, F.lit(" "), F.lit(""))
    tiny = (F.length(bare) < 8) & ~s.rlike(r"\d") & ~s.rlike("[A-Z][a-zA-Z]+|[\\u4e00-\\u9fff]{2,}")
    open_end = (F.length(s) < 40) & ~s.rlike("[.!?。！？;；]")
    return (s == "") | s.rlike(V.LONE_BULLET) | remnant | tiny | (open_end & (s.rlike(V.ZH_START) | s.rlike(V.ZH_TAIL) | s.rlike(V.EN_TAIL)))


def semantic_parts(c: Column) -> Column:
    """A struct of score, terms and numbers: points for terms, numbers and sentences, from 0 to 100, 0 for fragments, at most 40 below 40 characters; what evidence_terms() and evidence_numbers() count."""

    def facts(s: Column, _: Column, bits: Column) -> Column:
        nouns = F.array_except(matches(s, V.PROPER_NOUN), F.array(*map(F.lit, V.NOT_PROPER)))
        terms = F.size(F.array_distinct(F.transform(F.concat(SEMANTIC_SIEVE.matches(bits, s, V.DOMAIN_TERMS), nouns), F.lower)))
        short = F.length(F.replace(s, F.lit(" "), F.lit(""))) < 40
        return F.struct(terms.alias("terms"), SEMANTIC_SIEVE.count(bits, s, V.EVIDENCE_NUMBER).alias("numbers"), _hollow(s, SEMANTIC_SIEVE.has(bits, s, V.TEMPLATE_REMNANT)).alias("hollow"), short.alias("short"))

    def result(x: Column) -> Column:
        score = F.when(x["terms"] >= 2, 30).when(x["terms"] >= 1, 15).otherwise(0) + F.when(x["numbers"] >= 1, 30).otherwise(0) + 40
        score = F.when(x["hollow"], 0).otherwise(F.when(x["short"], F.least(score, F.lit(40))).otherwise(score)).cast("int")
        return F.struct(score.alias("score"), x["terms"].alias("terms"), x["numbers"].alias("numbers"))

    return once(sieved(strip(text_of(c)), text_of(c), SEMANTIC_SIEVE, facts), result)


def semantic_density(c: Column) -> Column:
    """The score of semantic_parts()."""
    return semantic_parts(c)["score"]


def proof_tokens(c: Column) -> Column:
    """Versions, benchmark scores, sizes, sums of money and dates in a text."""
    return reduce(add, [count(text_of(c), p) for p in V.STRICT_PROOF])


def hard_evidence(c: Column) -> Column:
    return reduce(add, [count(text_of(c), p) for p in V.HARD_EVIDENCE])


def first_hard_evidence(c: Column) -> Column:
    """The first match of the first kind of evidence that a text has; empty if none."""
    return F.coalesce(*[F.nullif(strip(F.regexp_substr(text_of(c), F.lit(p))), F.lit("")) for p in V.HARD_EVIDENCE], F.lit(""))


def key_sentences(c: Column, most: int = 10) -> Column:
    """The first sentences of more than 15 characters."""
    return F.slice(F.filter(F.transform(F.split(text_of(c), r"[.。!！?？;；\n]+"), strip), lambda x: F.length(x) > 15), 1, most)


def excerpts(c: Column, most: int = 2, words: int = 25) -> Column:
    """Different sentences of the first six, cut after some words."""

    def cut(s: Column) -> Column:
        w = F.split(squeeze(s), " ")
        return F.when(F.size(w) > words, F.concat(F.array_join(F.slice(w, 1, words), " "), F.lit("..."))).otherwise(s)

    return F.slice(F.array_distinct(F.transform(key_sentences(c, 6), cut)), 1, most)


def overlap_ratio(a: Column, b: Column) -> Column:
    """What two arrays of tokens share, against the smaller one."""
    n = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def tokens(c: Column) -> Column:
    """Lower-cased runs of two or more ASCII letters and digits, each once."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text_of(c)), F.lit("[a-z0-9]{2,}"), F.lit(0)))


def normalized_bullets(bullets: Column, least: int = 12) -> Column:
    """Bullets stripped; one shorter than `least` is put together with the next, which is then done with."""
    clean = F.filter(F.transform(bullets, lambda x: strip(text_of(x))), lambda x: x != "")
    none = F.lit(None).cast("string")
    state = F.struct(F.array().cast("array<string>").alias("out"), none.alias("held"))

    def fold(s: Column, x: Column) -> Column:
        both = F.concat_ws(" ", s["held"], x)
        short = s["held"].isNull() & (F.length(x) < least)
        return F.struct(F.when(short, s["out"]).otherwise(F.concat(s["out"], F.array(both))).alias("out"), F.when(short, x).alias("held"))

    done = F.aggregate(clean, state, fold)
    return F.filter(F.when(done["held"].isNull(), done["out"]).otherwise(F.concat(done["out"], F.array(done["held"]))), lambda x: F.length(x) >= least)


def sentence_marks(c: Column) -> Column:
    """How many marks end sentences or clauses, 1 at least where there is text."""
    t = text_of(c)
    return F.when(strip(t) == "", 0).otherwise(F.greatest(F.lit(1), count(t, V.MARKS)))


def block_terms(c: Column) -> Column:
    return count(text_of(c), f"(?iU){V.BLOCK_TERM}")


def block_numbers(c: Column) -> Column:
    return count(text_of(c), f"(?iU){V.BLOCK_NUMBER}")


def trim_fragment(c: Column) -> Column:
    """A text that ends in the middle of a sentence is cut after the last mark; without one it stays, less commas at its end."""
    s = strip(text_of(c))
    comma = s.rlike(f"(?U){V.COMMA_LAST}")
    loose = s.rlike(V.ZH_LAST) | s.rlike(f"(?iU){V.EN_LAST}") | comma
    upto = F.regexp_extract(s, f"(?s)^.*{V.MARKS}", 0)
    return F.when(loose & (upto != ""), upto).when(comma, F.regexp_replace(s, "[,，、 ]+$", "")).otherwise(s)


def lenient_sentences(c: Column) -> Column:
    """Pieces between terminators; if these are fewer than two, those between pauses and line ends if there are two or more of them."""
    t = text_of(c)
    for pattern, by in (("\r\n?", "\n"), ("[ \t]+", " "), ("\n+", "\n")):
        t = F.regexp_replace(t, pattern, by)
    pieces = lambda t: F.struct(
        sentences(t, V.TERMINATORS).alias("a"), F.filter(F.transform(F.split(t, V.PAUSES), lambda x: strip(F.regexp_replace(x, V.TERMINATORS, ""))), lambda x: x != "").alias("b")
    )
    pick = lambda x: F.when(F.size(x["a"]) >= 2, x["a"]).when((F.size(x["b"]) >= 2) | (F.size(x["a"]) == 0), x["b"]).otherwise(x["a"])
    return once(once(strip(t), pieces), pick)


def two_sentences(c: Column) -> Column:
    """A struct of the first lenient sentence and the rest, or of what lies before and behind the first comma of a single one; null where there is no second."""

    def pair(p: Column) -> Column:
        halves = F.transform(F.split(p[0], V.COMMAS, 2), strip)
        rest = strip(F.array_join(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(1))), " "))
        struct = lambda a, b: F.struct(a.alias("first"), b.alias("second"))
        return F.when(F.size(p) >= 2, struct(p[0], rest)).when((F.size(p) == 1) & (F.size(halves) == 2) & ~F.array_contains(halves, ""), struct(F.get(halves, F.lit(0)), F.get(halves, F.lit(1))))

    return once(lenient_sentences(c), lambda p: pair(F.when(F.size(p) == 0, F.array(F.lit(""))).otherwise(p)))


def is_loose_fragment(c: Column) -> Column:
    """Whether a text says nothing by itself: below 12 characters without a number, an address or a name, or below 40 with an open end."""

    def of(s: Column) -> Column:
        short = ~s.rlike(r"\d") & ~s.rlike("(?i)https?://") & (s.rlike(V.ZH_FIRST) | ~s.rlike("[A-Z][a-z]{2,}|[\\u4e00-\\u9fff]{2,}"))
        open_end = ~s.rlike(V.MARKS) & (s.rlike(f"(?iU){V.EN_LAST}") | s.rlike(V.ZH_LAST))
        return F.when(s == "", True).when(F.length(s) < 12, short).when(F.length(s) < 40, open_end).otherwise(False)

    return once(strip(text_of(c)), of)


def smart_truncate(c: Column, limit: int) -> Column:
    """A text cut behind a sentence, a clause or a word beyond half of `limit` characters, whichever kind there is first; at the limit if there is none."""

    def of(cut: Column) -> Column:
        last = lambda mark: F.when(F.contains(cut, F.lit(mark)), F.length(cut) - F.length(F.substring_index(cut, mark, -1)) - len(mark)).otherwise(-1)
        out = None
        for mark in ("。", "！", "？", "；", ". ", "，"):
            hit, value = last(mark) > limit * 0.5, F.regexp_replace(F.substring(cut, F.lit(1), last(mark) + len(mark)), r"(?U)\s+$", "")
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out.when(last(" ") > limit * 0.5, F.regexp_replace(F.substring(cut, F.lit(1), last(" ")), r"(?U)\s+$", "")).otherwise(F.regexp_replace(cut, r"(?U)\s+$", ""))

    return F.when(F.length(text_of(c)) <= limit, text_of(c)).otherwise(once(F.substring(text_of(c), 1, limit), of))


def candidate_text(fields: list[Column], arrays: list[Column], most: int = 5) -> Column:
    """The fields of a card that say something, then the first elements of its lists, as one text."""
    kept = lambda a: F.filter(F.transform(a, lambda x: strip(text_of(x))), lambda x: x != "")
    lists = [kept(F.slice(F.coalesce(a, F.array().cast("array<string>")), 1, most)) for a in arrays]
    return squeeze(F.array_join(F.concat(kept(F.array(*fields)), *lists), " "))


def rounded(c: Column, digits: int) -> Column:
    """A number from 1/16 up to 100 rounded by its exact binary value, ties to the even digit: 8.925, which is a little more, gives 8.93, and 8.125 gives 8.12."""
    one = 1 << 56

    def of(p: Column) -> Column:
        rest = p % F.lit(one).cast("decimal(38,0)")
        down = ((p - rest) / F.lit(one).cast("decimal(38,0)")).cast("long")
        twice = (rest * 2).cast("decimal(38,0)")
        up = (twice > one) | ((twice == one) & (down % 2 == 1))
        return (down + up.cast("long")) / F.lit(float(10**digits))

    # A double below 128 times 2^56 is a long, exactly.
    return once(((c.cast("double") * float(one)).cast("long").cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(4,0)")).cast("decimal(38,0)"), of)
