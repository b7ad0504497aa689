"""Mined sentences and quote windows against plain versions, on random texts with ties and repeats."""

import random
import re

import pytest
from pyspark.sql import functions as F

from granary.functions import mining as M
from granary.functions.text import BLANKS

WORDS = "the model GPT-4 OpenAI raises $5 revenue will launch 2024 12% and which subscribe policy latency A100 Berlin for risk x of Zürich été cost customers Paris Lyon NVIDIA v2.1 with".split()
MARKS = [". ", "! ", "? ", "; ", ", ", ": ", " - ", " ", " ", " ", "\n", "\n- ", "\n\n"]


def texts(seed, n):
    rng = random.Random(seed)
    out = ["", " ", "one", "- item one\n- item one\r2. item two", "A. A. a. B; c"]
    for _ in range(n):
        t = "".join(rng.choice(WORDS) + rng.choice(MARKS) for _ in range(rng.randint(1, 160)))
        out.append(t if rng.random() < 0.7 else t + "\n" + t[: len(t) // 2])
    return out


def squeeze(s):
    return " ".join(s.split())


def py(pattern):
    return re.compile(pattern.replace("(?iU)", "(?i)").replace("(?U)", ""))


def tokens(s):
    return {t for t in re.findall(r"[a-z0-9][a-z0-9\-]+", s.lower()) if t not in M.FRAME_STOPS}


def shared(a, b):
    return len(tokens(a) & tokens(b)) / min(len(tokens(a)), len(tokens(b))) if tokens(a) and tokens(b) else 0.0


def sentences(text):
    found, seen = [], set()
    for line in re.split(r"\n+", text.replace("\r", "\n")):
        group = []
        if re.match(M.BULLET, line):
            group.append(squeeze(re.sub(M.BULLET, "", line)))
        else:
            for piece in re.split(r"(?<=[.!?;])\s+", squeeze(line)):
                s = squeeze(piece.strip(" -\t"))
                group.append(s)
                group += [c for c in map(squeeze, re.split(M.CLAUSES, s)) if len(c) >= 40 and c != s and shared(c, s) <= 0.98]
        for s in group:
            if s and s.lower() not in seen:
                seen.add(s.lower())
                found.append(s if len(s) <= 360 else s[:360].rstrip())
    return found


def span(n, low, high):
    a = max(0, min(n - 1, int(n * low)))
    return a, max(a + 1, min(n, int(n * high)))


def is_call(s):
    return not s or bool(py(M.EMAIL).search(s) or py(M.CALL_TO_ACTION).search(s))


def title_words(title):
    return list(dict.fromkeys(t.lower() for t in re.findall(r"[A-Za-z][A-Za-z0-9\-]{2,}", title) if t.lower() not in ("the", "and", "for", "with", "from", "into", "about", "this", "that")))


def greedy(ranked, most, overlap):
    out = []
    for x in ranked:
        if len(out) < most and all(shared(x["text"], y["text"]) < overlap for y in out):
            out.append(x)
    return out


def candidates(text, title, actor, anchors, most=20):
    s, anchors = sentences(text), [n for n in anchors if n]
    if not s:
        return []
    a, b = span(len(s), 0.15, 0.75)
    if b - a < 8:
        a, b = span(len(s), 0.10, 0.85)
    out = []
    for i, x in enumerate(s[a:b]):
        low = x.lower()
        hits = sum(t in low for t in title_words(title))
        score = 2 * bool(re.search(r"\d|[$€£¥%]", x)) + 2 * (bool(actor and actor.lower() in low) or hits >= 2) + 2 * any((n in x) if not n.isascii() else (n.lower() in low) for n in anchors) + bool(py(M.IMPACT_WORDS).search(x)) + bool(py(M.ACTION_WORDS).search(x))
        if score and not is_call(x) and len(x) >= 40:
            out.append({"text": x, "score": score, "index": i})
    return [(x["text"], x["score"], x["index"]) for x in greedy(sorted(out, key=lambda x: (-x["score"], x["index"])), most, 0.75)]


def facts(text, title, actor, anchors, most=12, least=6):
    s = sentences(text)
    if not s:
        return []
    a, b = span(len(s), 0.10, 0.85)
    names, out = [n for n in [*anchors, actor] if n], []

    def of(x, clause, index):
        low = x.lower()
        strong = bool(re.search(r"\d", x)) + bool(py(M.FACT_MONEY).search(x)) + bool(py(M.FACT_PERCENT).search(x)) + bool(py(M.FACT_MODEL).search(x)) + bool(py(M.UPPER_TOKEN).search(x) or py(M.PROPER_NAME).search(x))
        blocked = is_call(x) or py(M.FACT_STOP).search(x) or py(M.FACT_BLOCK).search(x)
        if len(x) < (20 if clause else 24) or blocked or not strong or (not clause and py(M.OPENER).search(x) and not re.search(r"\d|[$€£¥]", x)):
            return None
        hits, anchor = sum(t in low for t in title_words(title)), sum((n in x) if not n.isascii() else (n.lower() in low) for n in names)
        return {"text": x, "score": (strong if clause else 2 * strong + bool(py(M.IMPACT_CUE).search(x))) + hits + anchor, "strong": strong, "title": hits, "anchor": anchor, "index": index}

    out = [x for x in (of(x, False, a + i) for i, x in enumerate(s[a:b])) if x]
    if len(out) < least:
        seen, first = {x["text"].lower() for x in out}, len(out)
        for c in (squeeze(c) for x in s[a:b] for c in re.split(M.FEWER_CLAUSES, x)):
            x = of(c, True, 2000 + len(out)) if c.lower() not in seen and len(out) < 3 * most else None
            if x:
                seen.add(c.lower())
                out.append(x)
        assert first <= len(out)
    keys = ("text", "score", "strong", "title", "anchor", "index")
    return [tuple(x[k] for k in keys) for x in greedy(sorted(out, key=lambda x: (-x["score"], -x["strong"], -x["title"], -x["anchor"], x["index"])), most, 0.92)]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, text string, title string, actor string, anchors array<string>").repartition(3)


def got(df, column):
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    return [(t, " ".join(rng.sample(WORDS, 3)), rng.choice(["", "OpenAI", "zürich"]), rng.choice([[], ["GPT-4"], ["Zürich", "paris"], ["Été", "", "OpenAI"]])) for t in texts(5, 70)]


def test_source_sentences(spark, rows):
    assert got(frame(spark, rows), M.source_sentences(F.col("text"))) == [sentences(r[0]) for r in rows]
    assert got(frame(spark, [(None, None, None, None)]), M.source_sentences(F.col("text"))) == [[]]


def test_sentence_candidates(spark, rows):
    x = got(frame(spark, rows), M.sentence_candidates(F.col("text"), F.col("title"), F.col("actor"), F.col("anchors")))
    want = [candidates(*r) for r in rows]
    assert [[tuple(y) for y in r] for r in x] == want and sum(map(len, want)) > 50
    assert got(frame(spark, [(None, None, None, None)]), M.sentence_candidates(F.col("text"), F.col("title"), F.col("actor"), F.col("anchors"))) == [[]]


def test_fact_pack(spark, rows):
    x = got(frame(spark, rows), M.fact_pack(F.col("text"), F.col("title"), F.col("actor"), F.col("anchors")))
    want = [facts(*r) for r in rows]
    assert [[tuple(y) for y in r] for r in x] == want
    assert any(y[5] >= 2000 for r in want for y in r) and any(y[5] < 2000 for r in want for y in r)


def test_ties_go_to_the_earlier_sentence_and_spans_widen(spark):
    same = [f"Number {k} of them is as good as all the others are here {k}." for k in "123456789"]
    x = got(frame(spark, [(" ".join(same), "", "", [])]), M.sentence_candidates(F.col("text"), F.col("title"), F.col("actor"), F.col("anchors"), overlap=1.1))[0]
    assert [y["index"] for y in x] == list(range(len(x))) and len(x) == 7  # nine sentences: 0.15 to 0.75 has five, so 0.10 to 0.85 counts


def test_quotes(spark, rows):
    def quotes(text, title, actor, anchors, seed, most=8):
        s = sentences(text)
        part = []
        if s:
            a, b = span(len(s), 0.15, 0.75)
            if b - a < 3 and len(s) >= 3:
                a, b = span(len(s), 0.10, 0.85)
            part = [x for x in s[a:b] if len(x) >= 40]
        seen, out = set(), []
        for x in [seed, *part]:
            q = squeeze(re.sub("[^\\w\\s.,;:!?%$@#/&\\-()\\[\\]\"'`+]", " ", x.replace("??", " ")))
            q = q if len(q) <= 220 else q[:220].rstrip()
            if not q or q.lower() in seen:
                continue
            seen.add(q.lower())
            low, hits = q.lower(), sum(t in q.lower() for t in title_words(title))
            near = bool(actor and actor.lower() in low) or hits >= 2 or any((n in q) if not n.isascii() else (n and n.lower() in low) for n in anchors)
            near = near or hits >= 1 and bool(re.search(r"\d|[$€£¥%]", q) or py(M.IMPACT_WORDS).search(q) or py(M.ACTION_WORDS).search(q))
            if len(q) >= 80 and not is_call(q) and near:
                out.append(q)
        return out[:most]

    seed = "A seed that speaks of OpenAI and GPT-4 and is long enough to be taken as the very first of all quotes here."
    x = got(frame(spark, rows), M.relevant_quotes(F.col("text"), F.col("title"), F.col("actor"), F.col("anchors"), F.lit(seed)))
    want = [quotes(*r, seed) for r in rows]
    assert x == want and sum(map(len, want)) > 50
    y = got(frame(spark, rows), M.relevant_quotes(F.col("text"), F.col("title"), F.col("actor"), F.col("anchors"), F.lit(seed), F.array(F.lit(seed.upper()))))
    assert all(q != seed for r in y for q in r)


def window(q, least=20, most=30):
    q = squeeze(q)
    if not q or least <= len(q) <= most:
        return q
    words, best, score = q.split(), "", -1
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            f = " ".join(words[i:j])
            if least <= len(f) <= most:
                n = 3 * len(re.findall(r"\b\d[\d,]*(?:\.\d+)?", f)) + 2 * len(py(M.WINDOW_NAME).findall(f)) + len(f)
                if n > score:
                    best, score = f, n
    if best:
        return best
    cut = q[:most]
    return cut[: cut.rfind(" ")] if len(q) > most and cut.rfind(" ") >= least else cut


def test_quote_window(spark):
    rng = random.Random(3)
    rows = [" ".join(rng.choice([*WORDS, "a", "bb", "x" * 12, "y" * 40, "1,000.5", "AI"]) for _ in range(rng.randint(0, 40))) for _ in range(150)] + ["x" * 45, "x" * 25 + " " + "y" * 40, "short", "a" * 31 + " bc", None]
    df = spark.createDataFrame(list(enumerate(rows)), "i long, text string")
    assert got(df, M.quote_window(F.col("text"))) == [window(r or "") for r in rows]


def test_long_texts_take_linear_time(spark):
    import time

    text = " ".join(f"Word{i} costs $5 in 2024 and will launch soon as GPT-{i} for customers." for i in range(3000))
    began = time.time()
    df = spark.createDataFrame([(0, text)], "i long, text string")
    df.select(M.quote_window(F.col("text"))).collect()
    assert len(df.select(M.source_sentences(F.col("text"))).first()[0]) == 3000
    assert time.time() - began < 40


def test_clauses_without_tokens_and_odd_blanks(spark):
    long = "а б в г д е ж з и к л м н о п р с т у ф х ц ч ш"
    rows = [f"The {long}, {long}: the and for with from, seen by A\x1cB\x1c, tail. Next\x85line - {long}!", f"{long}; {long} and {long}\x0b{long}", "1. item\x1c one\x1c\r\r* two　 three", "\x1c, x", "ΑΣ. ας. İ. i̇"]
    assert got(frame(spark, [(r, "", "", []) for r in rows]), M.source_sentences(F.col("text"))) == [plain_pieces(r) for r in rows]


def plain_pieces(text):
    """As sentences(), but of Java's blanks."""
    blank = f"[{BLANKS}]+"
    found, seen = [], set()
    for line in re.split(r"\n+", text.replace("\r", "\n")):
        q = lambda s: re.sub(blank, " ", s).strip(BLANKS)
        if re.match(M.BULLET, line, re.A):
            group = [q(re.sub(M.BULLET, "", line, flags=re.A))]
        else:
            group = []
            for piece in re.split("(?<=[.!?;]) +", q(line)):
                s = piece.strip(" -\t")
                group += [s, *(c for c in (x.strip(" ") for x in re.split(M.CLAUSES, s, flags=re.A)) if len(c) >= 40 and c != s and shared(c, s) <= 0.98)]
        for s in group:
            if s and s.lower() not in seen:
                seen.add(s.lower())
                found.append(s[:360].rstrip(" "))
    return found
