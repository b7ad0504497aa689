"""The reference's operators on literal rows, against small independent versions in plain Python."""

import datetime as dt
import difflib
import itertools
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from granary.functions import evidence, links, scores, text
from granary.functions import fixed as V
from granary.operators import dedupe, entities, gating, select, stats
from granary.sources import feeds, snapshots
from granary.streaming import runs



def as_of():
    return F.lit("2026-02-20 00:00:00").cast("timestamp")


def values(spark, column, *rows, names=("a",)):
    """What a column gives for rows of texts."""
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names))
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def item(i, body, **more):
    return {"ord": i, "item_id": f"id{i}", "title": f"Title {i}", "body": body, "url": f"https://e.com/{i}", "source_name": "s", "lang": "en", "published_ts": None, "frontier_score": 0, "fulltext_len": 0} | more


ITEM = "ord long, item_id string, title string, body string, url string, source_name string, lang string, published_ts timestamp, frontier_score int, fulltext_len int"


def items(spark, *rows):
    return spark.createDataFrame([tuple(r[k.split()[0]] for k in ITEM.split(", ")) for r in rows], ITEM)


# Text -----------------------------------------------------------------------------------------------------------------
def test_density_score(spark):
    got = values(spark, text.density_score(F.col("a")), None, " ", "OpenAI shipped v1.2.3 in 2026. It costs $5. Good!", "plain words. more words", "Élan Été 50%")
    assert got == [0, 0, 36 + 24 + 25, 7, 12]


def test_sentences_and_language(spark):
    assert values(spark, text.count_sentences(F.col("a")), "a. b! c?", "v1.2", "...", None) == [3, 2, 0, 0]
    assert values(spark, text.detect_language(F.col("a")), "今天天氣很好", "AI模型 is a very long sentence of latin words", "hello", "") == ["zh", "en", "en", "en"]
    assert values(spark, text.zh_ratio(F.col("a")), "今天ab", "𠀀a") == [0.5, 0.0]


@pytest.mark.parametrize("body,reason", [
    ("Please enable JavaScript to go on. " * 60, "rejected_keyword:enable javascript"), ("Our weekly letter. " * 100, "rejected_keyword:weekly"), ("Sign in to read more of this.", "rejected_keyword:sign in"),
    ("Sign in is mentioned here, and the article goes on. " * 30, None), ("no end of sentence", "fragment_placeholder"), ("It ends with a comma,", "fragment_placeholder"), ("This one was", "fragment_placeholder"),
    ("A sentence. " * 20, "content_too_short"), ("word " * 300 + ". Another sentence", "insufficient_sentences"), ("A sentence of some words. " * 60, None), (None, "fragment_placeholder"),
])
def test_article_reason(spark, body, reason):
    assert values(spark, scores.article_reason(F.col("a")), body) == [reason]


@pytest.mark.parametrize("n,reason", [(1199, "content_too_short"), (1200, None), (1201, None)])
def test_article_length_edges(spark, n, reason):
    body = ("One. Two. Three. " + "x" * 2000)[: n - 1] + "."
    assert values(spark, scores.article_reason(F.col("a")), body) == [reason]


def test_info_density_and_tiers(spark):
    rich = "OpenAI released GPT-4 with 128 tokens for $20 in 2026 to everybody. NVIDIA reported 30% growth of revenue over the year. Meta opened Llama weights to researchers all over the world."
    poor, letter = "is this a fragment and", rich + " Subscribe to stay tuned for our overview of the news that we gather."
    got = values(spark, scores.density_tier(F.col("a")), rich, poor, letter)
    assert [(g.tier, g.reasons) for g in got] == [("A", []), ("C", ["fragment_placeholder", "low_density_score"] if "low_density_score" in got[1].reasons else got[1].reasons), ("C", got[2].reasons)]
    assert "boilerplate" in got[2].reasons and got[1].reasons[0] == "fragment_placeholder"
    empty = values(spark, text.info_density(F.col("a")), "")[0]
    assert tuple(empty) == (0, 0, 0, 1, 2, 0)


def test_garbage_and_cleaning(spark):
    page = "Skip to content\nStar\nA real line of text about the sky.\n\n\n\n*** --- ***\nWe star in a play about a long journey through the country.\n"
    assert values(spark, text.clean_raw_text(F.col("a")), page) == ["A real line of text about the sky.\n\nWe star in a play about a long journey through the country."]
    assert values(spark, text.has_ui_tokens(F.col("a")), page, "fine") == [True, False]
    score = values(spark, text.ui_garbage_score(F.col("a")), page, "fine", None)
    assert 0 < score[0] < 1 and score[1:] == [0.0, 0.0]
    long = "\n".join(["x" * 99] * 200)
    assert len(values(spark, text.clean_raw_text(F.col("a")), long)[0]) == 11_999


def test_semantic_density(spark):
    got = values(spark, text.semantic_density(F.col("a")), "2.", "Last July was a month", "GPU", "OpenAI and Meta signed a deal worth $30k in New York today.", "hello there, my friend of old days gone by long ago", "的趨勢")
    assert got == [0, 0, 40, 100, 40, 0]
    assert values(spark, text.is_fragment(F.col("a")), "ab", "short text and", "的研究方向", "Fine sentence here.") == [True, True, True, False]


def test_proof(spark):
    assert values(spark, text.proof_tokens(F.col("a")), "v1.2.3 and MMLU 90.2 with 70B on 2026-02-20", "nothing") == [4, 0]
    assert values(spark, text.first_hard_evidence(F.col("a")), "it grew 5% to v2.1", "none") == ["v2.1", ""]


def test_bullets(spark):
    df = spark.createDataFrame([(["short", "and its long continuation", "a bullet that is long enough", "tiny"],), ([],)], "a array<string>")
    assert [r.x for r in df.select(text.normalized_bullets(F.col("a")).alias("x")).collect()] == [["short and its long continuation", "a bullet that is long enough"], []]


# Scores ---------------------------------------------------------------------------------------------------------------
def test_category_and_mechanism(spark):
    cat = scores.category(F.col("a"), F.col("b"), F.col("c"))
    got = values(spark, cat, ("Court ruling", "antitrust lawsuit", "tech"), ("x", "y", "finance"), ("x", "y", None), ("bank", "", "ai"), names=("a", "b", "c"))
    assert [tuple(g) for g in got] == [("政策/監管", 0.8), ("金融/財經", 0.3), ("綜合資訊", 0.3), ("政策/監管", 0.2)]
    assert values(spark, scores.mechanism(F.col("a"), F.col("b")), ("supply chain", "chip shortage"), ("", ""), names=("a", "b")) == ["供應鏈（supply chain）", V.DEFAULT_MECHANISM]


def test_channels_and_relevance(spark):
    ch = scores.channels(F.col("a"), F.col("b"))
    got = values(spark, ch, ("launch of a new model with pricing", ""), ("weights and benchmark for inference", ""), ("funding round and merger", ""), ("", "https://github.com/x/y"), ("revenue deal with checkpoint", ""), names=("a", "b"))
    assert [g.best_channel for g in got] == ["product", "tech", "business", "dev", "tech"]
    assert got[0].product_score == 75 and got[3].dev_score == 100
    rel = scores.relevance(F.col("a"))
    got = values(spark, rel, "a new apartment tower", "an apartment found by an AI agent", "NVIDIA earnings", "cooking at home", "豪宅建案")
    assert [g.relevant for g in got] == [False, True, True, False, False]


def test_frontier_score(spark):
    df = spark.createDataFrame(
        [(0, "MMLU 90% with v1.2.3", "", "https://arxiv.org/abs/2402.10055", "arxiv", 5), (1, "x", "", "", "unknown", 200), (2, "OpenAI launch R1", "weights for 70B", "", "openai", 72), (3, "x", "", "", None, None)], "i int, t string, s string, u string, p string, h int"
    )
    ts = as_of() - F.make_dt_interval(hours=F.col("h"))
    got = [r.x for r in df.select("i", scores.frontier_score(F.col("t"), F.col("s"), F.lit(""), F.col("u"), F.col("p"), ts, as_of()).alias("x")).orderBy("i").collect()]
    assert got == [100, 14, 100, 24]


def test_rule_scores(spark):
    df = spark.createDataFrame([(0, "Title", "x" * 1500, "HackerNews", "ai", 2, 3), (1, "Buy now", "sponsored coupon", "?", "?", 0, 0)], "i int, t string, b string, s string, c string, e int, k int")
    got = [r.x for r in df.select("i", scores.rule_scores(*map(F.col, "tbscek")).alias("x")).orderBy("i").collect()]
    assert (got[0].novelty, got[0].utility, got[0].heat, got[0].feasibility, got[0].final_score) == (7.0, 9.5, 9.5, 8.0, 8.5) and got[0].tags == ["ai", "HackerNews"]
    assert got[1].is_ad and got[1].tags[-1] == "ad"


def test_traffic_light(spark):
    df = spark.createDataFrame([(90.0, 10.0), (90.0, 40.0), (40.0, 50.0), (40.0, 90.0)], "s double, p double")
    assert [r[0] for r in df.select(scores.traffic_light(F.col("s"), F.col("p"))).collect()] == ["green", "yellow", "yellow", "red"]


# Links ----------------------------------------------------------------------------------------------------------------
def test_urls(spark):
    got = values(spark, links.normalize_url(F.col("a")), "HTTPS://Example.com/Path/?utm_source=x&b=2&a=1&ref=y&b=3#top", "http://e.com", "https://e.com/?q=a%20b+c&empty=", " https://e.com/x/ ")
    assert got == ["https://example.com/Path?b=2&b=3&a=1", "http://e.com/", "https://e.com/?q=a+b+c", "https://e.com/x"]
    assert values(spark, links.domain(F.col("a")), "https://www.Wired.com/x", "nothing") == ["wired.com", ""]
    assert values(spark, links.domain(F.col("a"), exact=True), "https://wired.com/x") == ["ired.com"]
    assert values(spark, links.url_entity(F.col("a")), "https://www.techcrunch.com/", "https://github.com", "https://a.io") == ["Techcrunch", None, None]
    token = __import__("base64").urlsafe_b64encode(b"\x08\x13\x22\x1dhttps://publisher.org/a/story\xd2\x01").decode().rstrip("=")
    assert values(spark, links.publisher_url(F.col("a")), f"https://news.example.com/rss/articles/{token}?oc=5", "https://x.y/z") == ["https://publisher.org/a/story", None]
    assert len(values(spark, links.item_id(F.col("a"), F.col("a")), "x")[0]) == 16


def test_dates(spark):
    got = values(spark, links.parse_date(F.col("a")), "2026-02-19T09:00:00Z", "2026-02-19T09:00:00+02:00", "2026-02-19T09:00:00", "Thu, 19 Feb 2026 09:00:00 +0000", "19 Feb 2026 09:00:00 GMT", "not a date", None)
    nine = dt.datetime(2026, 2, 19, 9)
    assert got == [nine, nine - dt.timedelta(hours=2), nine, nine, nine, None, None]
    assert values(spark, links.first_date(F.col("a"), F.col("b")), ("x", "on 2026-01-02"), ("", ""), names=("a", "b")) == ["2026-01-02", ""]
    df = spark.createDataFrame([(0.0,), (71.0,), (73.0,), (None,)], "a double")
    assert [tuple(r) for r in df.select(links.is_recent(F.col("a")), links.is_recent(F.col("a"), exact=True)).collect()] == [(True, False), (True, True), (False, False), (False, False)]


def test_json(spark):
    got = values(spark, F.to_json(links.json_from_answer(F.col("a"))), '{"a": 1}', 'so:\n```json\n{"a": 2}\n```', 'answer {"a": 3} end', "none")
    assert got == ['{"a":1}', '{"a":2}', '{"a":3}', None]
    assert values(spark, links.has_fields(F.col("a"), ["a", "b"]), '{"a":1,"b":2}', '{"a":1}', None) == [True, False, False]


# Evidence -------------------------------------------------------------------------------------------------------------
def test_anchors(spark):
    got = values(spark, evidence.event_anchors(F.col("a"), F.col("b")), ("OpenAI Ships Thing", "openai paid 40% for v4.1"), (None, None), names=("a", "b"))
    assert got[0][:2] == ["OpenAI", "v4.1"] and "40" in got[0] and "Ships" in got[0] and got[1] == []
    typed = values(spark, evidence.typed_anchors(F.col("a"), F.col("b")), ("GPT-4 costs $5 billion", "on MMLU"), ("NVIDIA", ""), ("", ""), names=("a", "b"))
    assert [t.type for t in typed[0]] == ["product", "benchmark", "money"] and [t.type for t in typed[1]] == ["company"] and typed[2] == []


def test_validators(spark):
    a = F.array(F.lit("OpenAI"))
    q1 = evidence.check_structure(F.col("a"), "Q1", a, actor=F.lit("Meta"))
    good = "OpenAI 今天宣布推出全新模型並開放給所有開發者使用「released a new model」"
    assert values(spark, q1, "", good, "Meta「abc」") == [["Q1_EMPTY"], [], ["Q1_CHARS_LOW", "Q1_WINDOW_TOO_SHORT"]]
    assert values(spark, evidence.check_boilerplate(F.col("a")), "最新公告顯示一切", "fine") == [["BOILERPLATE:最新公告顯示"], []]
    df = spark.createDataFrame([(["use OpenAI", "nothing"], ["OpenAI"]), (["x"], [])], "b array<string>, a array<string>")
    assert [r[0] for r in df.select(evidence.check_anchored(F.col("b"), F.col("a"))).collect()] == [["UNANCHORED_BULLET:nothing"], []]
    assert values(spark, evidence.has_window(F.col("a"), F.col("b")), ("it says hello world today", "xx hello world yy"), ("abc", "def"), names=("a", "b")) == [True, False]
    assert values(spark, evidence.quoted(F.col("a")), '「one」 and "two"') == [["one", "two"]]


def test_entity_cleaning(spark):
    df = spark.createDataFrame([(["OpenAI", "a", "12", "e.com", "Sign in", "XYZ", "AI", "river", " "], "other"), (["river"], evidence.GEOGRAPHIC_CATEGORY)], "e array<string>, c string")
    got = [r[0] for r in df.select(evidence.clean_entities(F.col("e"), F.col("c"), F.array(F.lit("The River rose")), F.lit(""))).collect()]
    assert got[0].cleaned == ["OpenAI", "AI"] and got[1].cleaned == ["river"]
    assert [r.reason for r in got[0].removed] == ["too_short", "numeric_or_symbol", "url_fragment", "ui_word", "unknown_short_acronym", "geo_generic"]


def test_entities(spark):
    df = items(spark, item(1, "Bank of America wrote about NASA. NASA answered. The end.", title="NASA and Bank of America", url="https://www.techcrunch.com/x"), item(2, "", title=""))
    got = entities.extract(df).orderBy("ord", "rank").collect()
    assert [(r.entity, r.kind, r.title_count, r.body_count) for r in got[:2]] == [("NASA", "ACRONYM", 1, 2), ("Bank of America", "ORG", 1, 1)]
    assert "Techcrunch" in [r.entity for r in got] and all(r.entity != "The" for r in got)


# Gates ----------------------------------------------------------------------------------------------------------------
LONG = "The model of OpenAI is good. " * 50
MIDDLE = "The model of NVIDIA is good. " * 25
DENSE = "OpenAI GPT-4 in 2026 cost $5 with v1.2. NVIDIA H100 grew 30% in 2025. Meta Llama too."


def test_adaptive_gate(spark):
    rows = [item(i, LONG) for i in range(3)] + [item(3, MIDDLE), item(4, DENSE), item(5, "Our weekly model. " * 90), item(6, "A garden is nice. " * 90), item(7, "An AI text that is too short to count.")]
    df = items(spark, *rows)
    level = lambda **k: [r.level for r in gating.adaptive_gate(df, **k).orderBy("ord").collect()]
    assert level() == ["strict"] * 3 + ["relaxed", "density", "hard", "hard", "soft"]
    assert level(keep=3) == ["strict"] * 3 + ["soft", "soft", "hard", "hard", "soft"]
    got = {r.ord: r.reason for r in gating.adaptive_gate(df).collect()}
    assert got[5] == "rejected_keyword:weekly" and got[6] == "non_ai_topic" and got[7] == "content_too_short" and got[0] is None
    assert gating.adaptive_gate(items(spark)).collect() == []


def test_split_gate(spark):
    rows = [item(0, LONG), item(1, MIDDLE), item(2, DENSE * 3), item(3, DENSE), item(4, "fragment,"), item(5, "An AI text of 2025. It is short, yet has 3 numbers and 80 letters or more in it.")]
    got = {r.ord: r for r in gating.split_gate(items(spark, *rows)).collect()}
    assert got[0].level == "event" and got[1].level == "signal" and got[4].level == "hard" and got[4].reason == "fragment_placeholder"
    assert got[0].event_pass and got[0].signal_pass and not got[1].event_pass
    assert all(r.signal_pass or not r.event_pass for r in got.values())
    assert all((r.reason is None) == (r.signal_pass or r.event_pass) for r in got.values())
    only = {r.ord: r.level for r in gating.split_gate(items(spark, item(0, DENSE * 8), item(1, DENSE * 9))).collect()}
    assert set(only.values()) == {"event_relaxed"}


def test_filter_items(spark):
    old, new = dt.datetime(2026, 2, 1), dt.datetime(2026, 2, 19, 12)
    rows = [item(0, LONG, published_ts=old), item(1, LONG, published_ts=new), item(2, LONG, lang="fr"), item(3, "short", published_ts=new), item(4, LONG * 2, lang="de"), item(5, "short", fulltext_len=900)]
    got = {r.ord: (r.raw_reason, r.reason) for r in gating.filter_items(items(spark, *rows), as_of(), fill=3).collect()}
    assert got == {0: ("too_old",) * 2, 1: (None, None), 2: ("lang_not_allowed",) * 2, 3: ("body_too_short",) * 2, 4: ("lang_not_allowed", None), 5: (None, None)}


def test_processing_items(spark):
    gated = gating.split_gate(items(spark, item(0, LONG), item(1, MIDDLE), item(2, MIDDLE)))
    assert sorted(r.ord for r in gating.processing_items(gated, context=1).collect()) == [0, 1]


def test_top_ups_beyond_six(spark):
    gated = items(spark, *[item(i, LONG) for i in range(10)]).withColumn("event_pass", F.col("ord") == 0).withColumn("signal_pass", F.lit(True))
    assert sorted(r.ord for r in gating.processing_items(gated, context=8).collect()) == list(range(9))
    rows = [item(i, LONG, lang="fr") for i in range(9)]
    assert gating.filter_items(items(spark, *rows), as_of(), fill=8).filter("reason is null").count() == 8


# De-duplication -------------------------------------------------------------------------------------------------------
def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


def test_ratios(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("abc ") for _ in range(rng.randint(0, 30))), "".join(rng.choice("abc ") for _ in range(rng.randint(0, 30)))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", dedupe.indel_ratio("a", "b").alias("x"), dedupe.matching_ratio("a", "b").alias("y")).collect():
        n = len(r.a) + len(r.b)
        assert abs(r.x - (200 * lcs(r.a, r.b) / n if n else 100)) < 1e-9 and abs(r.y - difflib.SequenceMatcher(None, r.a, r.b).ratio()) < 1e-9


def test_fuzzy_titles(spark):
    rng = random.Random(2)
    titles = []
    for _ in range(12):
        base = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(8, 40))).strip() or "x"
        for _ in range(4):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice("abcdefgh")
            titles.append("".join(own))
    rng.shuffle(titles)
    titles += ["", ""]
    kept = []
    for i, t in enumerate(titles):
        if not t or all(not titles[k] or 200 * lcs(t, titles[k]) / (len(t) + len(titles[k])) <= 85 for k in kept):
            kept.append(i)
    got = dedupe.fuzzy_titles(spark.createDataFrame(list(enumerate(titles)), "ord long, title string")).collect()
    assert sorted(r.ord for r in got) == kept


def test_similar_titles_of_common_pieces_are_compared_once(spark, monkeypatch):
    """Titles of few different words share pieces of three letters nearly always; blocks do not make a row for each of them."""
    rng = random.Random(5)
    words = ["the", "tion", "ing", "and", "her", "ent", "ere", "on"]
    titles = ["".join(rng.choice(words) for _ in range(rng.randint(12, 20)))[:60] for _ in range(150)]
    titles += [t[:20] + "x" + t[20:] for t in titles[::5]] + [t * 40 for t in titles[::50]] + [t * 40 + "y" for t in titles[::50]]
    monkeypatch.setattr(dedupe, "BLOCK_TEXTS", 16)
    pairs = [tuple(r) for r in dedupe.similar_pairs(spark.createDataFrame(list(enumerate(titles)), "ord long, title string")).collect()]
    assert len(set(pairs)) == len(pairs)
    firsts = {t: i for i, t in reversed(list(enumerate(titles)))}
    same = {(i, j) for t, i in firsts.items() for u, j in firsts.items() if i < j and abs(len(t) - len(u)) <= 0.15 * (len(t) + len(u)) and 200 * dedupe._common(t, u) / (len(t) + len(u)) > 85}
    assert set(pairs) == same and len(same) >= 30
    # What decides most pairs is work on arrays: 1 500 titles within some seconds in one process.
    many = ["".join(rng.choice(words) for _ in range(20))[:60] for _ in range(1500)]
    began = time.time()
    list(dedupe._similar_within(many, many, 85.0, True))
    assert time.time() - began < 20


def test_keep_first_is_greedy(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (4, 5), (1, 9)]
    keys = spark.createDataFrame([(k,) for k in range(1, 10)], "k long")
    assert sorted(r.k for r in dedupe.keep_first(keys, spark.createDataFrame(pairs, "a long, b long")).collect()) == [1, 3, 5, 6, 7, 8]


def test_exact_dedupe(spark):
    df = items(spark, item(1, "a", url="https://e.com/x?utm_source=1"), item(2, "b", url="https://e.com/x/", source_name="HackerNews"), item(3, "a", url="https://e.com/y"))
    assert sorted(r.ord for r in dedupe.by_url(df).collect()) == [2, 3]
    assert sorted(r.ord for r in dedupe.first_of_each(df, "body").collect()) == [1, 2]
    history = df.filter("ord = 1").select("item_id")
    assert sorted(r.ord for r in dedupe.unseen(df, history).collect()) == [2, 3]
    assert sorted(r.ord for r in dedupe.by_id_or_title(df, df.filter("ord = 2")).collect()) == [1, 3]


# Ranking and aggregates -----------------------------------------------------------------------------------------------
def test_executive_selection(spark):
    cols = "item_id string, ord long, best_channel string, product_score int, tech_score int, business_score int, dev_score int, final_score double, fulltext_len int, frontier_score int, age_h double"
    row = lambda i, ch, top, other=0: (f"i{i}", i, ch, *[top if k == ch else other for k in V.CHANNELS], 5.0, 900, 50, 1.0)
    many = spark.createDataFrame([row(i, c, 50 + i % 40) for i, c in zip(range(200), itertools.cycle(V.CHANNELS))], cols)
    got = select.executive(many).collect()
    assert len(got) == 12 and sum(r.step == "quota" for r in got) == 7 and len({r.item_id for r in got}) == 12
    thin = spark.createDataFrame([row(i, "tech", 90, 60) for i in range(15)], cols)
    got = select.executive(thin).collect()
    assert {k: sum(r.bucket == k and r.step == "backfill" for r in got) for k in ("business", "product")} == {"business": 2, "product": 1} and len(got) <= 18


def test_ranking(spark):
    df = spark.createDataFrame([(i, f"k{i % 3}", float(i % 7)) for i in range(40)], "ord long, key string, v double")
    got = select.quota_top(df, "key", [F.desc("v")], {"k0": 2, "k1": 1}).collect()
    assert sorted((r.key, r["rank"]) for r in got) == [("k0", 1), ("k0", 2), ("k1", 1)]
    n = select.numbered(df.select(F.col("ord").alias("id")), "id").collect()
    assert sorted((r.id, r.ord) for r in n) == [(i, i + 1) for i in range(40)]
    arr = spark.createDataFrame([(list(range(10)),)], "a array<int>")
    assert arr.select(select.span(F.col("a"), 0.15, 0.75)).first()[0] == [1, 2, 3, 4, 5, 6]
    best = spark.createDataFrame([("One. Two 2. Three. Four 44 4.",)], "t string").select(select.best_sentences(F.col("t"), lambda s: F.regexp_count(s, F.lit(r"\d")), 2)).first()[0]
    assert best == ["Two 2", "Four 44 4"]
    assert spark.createDataFrame([("Short. It cost $5 in 2026. OpenAI won.",)], "t string").select(select.supplementary_quotes(F.col("t"), 2)).first()[0] == ["It cost $5 in 2026", "OpenAI won"]


def test_tracks_and_lists(spark):
    df = spark.createDataFrame([(i, f"i{i}", "business" if i % 2 else "product", 60, 10, 60, 40 + i, float(i), "x" * (500 + 50 * i), "2026") for i in range(30)], "ord long, item_id string, best_channel string, product_score int, tech_score int, business_score int, frontier_score int, final_score double, body string, published_at string")
    got = select.tracks(df, first=3).collect()
    assert {t: sum(r.track == t for r in got) for t in "ABC"} == {"A": 3, "B": 4, "C": 4}
    watch = select.watch_list(df, df.limit(4)).collect()
    assert len(watch) == 2 and all(len(r.body) >= 600 for r in watch)
    acts = [r.action for r in select.actions(df).collect()]
    assert acts == sorted(acts, key=["MOVE", "TEST", "WATCH"].index) and len(acts) == 8


def test_latency(spark):
    for data in ([5.0], [3.0, 1.0], [float(x) for x in range(100)], [1.5] * 7 + [-2.0, 1e9]):
        s = sorted(data)
        r = stats.latency(spark.createDataFrame([(x,) for x in data], "latency double")).first()
        mid = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
        assert (r.n, r.p50, r.p95) == (len(s), round(mid, 3), round(s[min(int(len(s) * 0.95), len(s) - 1)], 3))


def test_verdicts(spark):
    df = items(spark, *[item(i, "v1.2.3 " + "x" * 900, source_name=f"s{i % 3}") for i in range(9)])
    assert {r.metric: r.status for r in stats.run_verdicts(df).collect()} == {"max_share": "PASS", "coverage": "PASS", "selected": "PASS", "long_texts": "PASS"}
    few = {r.metric: r.status for r in stats.run_verdicts(items(spark, item(1, "x"))).collect()}
    assert few == {"max_share": "SKIP", "coverage": "SKIP", "selected": "FAIL", "long_texts": "FAIL"}
    assert stats.acceptance(spark).count() == 8
    heat = stats.market_heat(spark.createDataFrame([(9.0,)] * 5, "final_score double")).first()
    assert (heat.heat, heat.level) == (100, "VERY_HIGH") and stats.market_heat(spark.createDataFrame([], "final_score double")).first().level == "LOW"


# Sources, sinks, runs -------------------------------------------------------------------------------------------------
RSS = """<rss version="2.0"><channel><title>Feed</title><item><title>One &amp; <![CDATA[<b>two</b>]]></title><link>https://e.com/1</link><pubDate>Thu, 19 Feb 2026 09:00:00 +0000</pubDate><description>Text
 more</description></item><item><title>No link</title></item><item><title>Guid</title><guid>https://e.com/2</guid></item><item><title>Bad</title><link>ftp://e.com</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="self" href="https://e.com/self"/><link href="https://e.com/a"/><published>2026-02-19T09:00:00Z</published><updated>2026-02-20T09:00:00Z</updated><summary>s</summary></entry></feed>"""
PLAIN_ATOM = "<feed><entry><title>P</title><id>https://e.com/p</id><updated>2026-02-20T09:00:00Z</updated></entry></feed>"


def test_feeds(spark, tmp_path):
    df = spark.createDataFrame([("f", "arxiv", "u", "t", x) for x in (RSS, ATOM, PLAIN_ATOM, "broken <", "", None)], "feed_name string, platform string, feed_url string, tag string, xml string")
    got = {r.url: r for r in feeds.parse_feeds(df, as_of()).collect()}
    assert set(got) == {"https://e.com/1", "https://e.com/2", "https://e.com/a", "https://e.com/p"}
    assert got["https://e.com/1"].title == "One & two" and got["https://e.com/1"].summary == "Text more" and got["https://e.com/1"].published_source == "rss_pubDate"
    assert got["https://e.com/2"].published_source == "fallback_collected_at" and got["https://e.com/a"].published_source == "atom_published" and got["https://e.com/p"].published_source == "atom_updated"
    for name, x in (("a.xml", RSS), ("b.xml", ATOM), ("c.xml", "broken <"), ("d.xml", "<rss><channel></channel></rss>")):
        (tmp_path / name).write_text(x)
    spark.dataSource.register(feeds.FeedSource)
    paths = json.dumps([str(tmp_path / n) for n in ("a.xml", "b.xml", "missing.xml", "c.xml", "d.xml")])
    loaded = spark.read.format("feed").option("paths", paths).load()
    assert loaded.filter("status = 'ok'").count() == 3
    assert {r.path[-9:]: r.status for r in loaded.filter("status != 'ok'").collect()} == {"ssing.xml": "unreadable", str(tmp_path / "c.xml")[-9:]: "malformed", str(tmp_path / "d.xml")[-9:]: "empty"}


def test_registry(spark):
    class Broken(feeds.Source):
        name = "broken"

        def fetch(self, spark):
            raise ValueError

    r = feeds.Registry([feeds.Rows("a", [("1", "t", "u", "b", "", "a", "tech", "en")]), feeds.Rows("none", []), Broken()])
    rows, status = r.fetch_all(spark)
    assert [x.item_id for x in rows.collect()] == ["1"]
    assert {x.source: (x.status, x.reason) for x in status.collect()} == {"a": ("ok", ""), "none": ("failed", "empty"), "broken": ("failed", "ValueError")}
    assert feeds.with_fallback([lambda: 1 / 0, lambda: rows]) is rows


def test_snapshots(spark, tmp_path):
    (tmp_path / "z.jsonl").write_text('{"id": "1", "title": "T", "url": "https://e.com", "summary": "s", "source": {"platform": "36kr"}}\nbroken\n{"id": "2", "title": "", "url": "x"}\n')
    z = snapshots.read_collected(spark, str(tmp_path / "z.jsonl"))
    got = snapshots.to_items(z).collect()
    assert [(r.item_id, r.body, r.source_name, r.lang) for r in got] == [("1", "s", "36kr", "zh")]
    assert snapshots.malformed(spark, str(tmp_path / "z.jsonl")).first()[0] == 1
    assert snapshots.read_collected(spark, str(tmp_path / "missing")).count() == 0


def test_store(spark, tmp_path):
    s = snapshots.Store(spark, str(tmp_path / "t"), "item_id string, v int", "item_id")
    frame = lambda *rows: spark.createDataFrame(rows, "item_id string, v int")
    assert s.read().count() == 0 and s.insert(frame(("a", 1), ("a", 2), ("b", 1))) == 2 and s.insert(frame(("a", 9), ("c", 1))) == 1
    s.upsert(frame(("a", 5), ("d", 4)))
    assert {r.item_id: r.v for r in s.read().collect()} == {"a": 5, "b": 1, "c": 1, "d": 4}
    assert [r.v for r in s.lookup(frame(("a", 0))).collect()] == [5]


@pytest.mark.parametrize("in_order", [0, 10**6])
def test_keep_first_in_order_and_in_rounds(spark, in_order):
    rng = random.Random(3)
    for n, m in ((1, 0), (30, 40), (60, 25)):
        pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}) if n > 1 else []
        gone = set()
        for b in range(n):
            if any(a not in gone for a, x in pairs if x == b):
                gone.add(b)
        got = dedupe.keep_first(spark.range(n).withColumnRenamed("id", "k"), spark.createDataFrame(pairs, "a long, b long"), in_order)
        assert sorted(r.k for r in got.collect()) == sorted(set(range(n)) - gone)


def _frame(spark, *rows):
    return spark.createDataFrame(rows, "item_id string, v int")


def test_store_survives_a_crash(spark, tmp_path, monkeypatch):
    """Rows that were written but not named are not there, and the version before is whole."""
    s = snapshots.Store(spark, str(tmp_path / "t"), "item_id string, v int", "item_id")
    s.insert(_frame(spark, ("a", 1), ("b", 2)))
    real = snapshots.Store._commit

    def crash(*_):
        raise SystemError("lost")

    monkeypatch.setattr(snapshots.Store, "_commit", crash)
    for write in (s.insert, s.upsert):
        with pytest.raises(SystemError):
            write(_frame(spark, ("a", 7), ("c", 3)))
        assert {r.item_id: r.v for r in s.read().collect()} == {"a": 1, "b": 2}
    monkeypatch.setattr(snapshots.Store, "_commit", real)
    s.upsert(_frame(spark, ("a", 7)))
    assert {r.item_id: r.v for r in s.read().collect()} == {"a": 7, "b": 2} and s.versions() == [1, 2]


def test_store_takes_writers_in_turn(spark, tmp_path, monkeypatch):
    """A writer that another one overtakes starts again from what that one left; neither's rows are lost."""
    path = str(tmp_path / "t")
    one, two = (snapshots.Store(spark, path, "item_id string, v int", "item_id") for _ in range(2))
    real, done = snapshots.Store._commit, []

    def overtaken(self, base, folders):
        if self is one and not done:
            done.append(two.insert(_frame(spark, ("a", 2), ("b", 2))))
        return real(self, base, folders)

    monkeypatch.setattr(snapshots.Store, "_commit", overtaken)
    assert one.insert(_frame(spark, ("a", 1), ("c", 1))) == 1 and done == [2]
    assert {r.item_id: r.v for r in one.read().collect()} == {"a": 2, "b": 2, "c": 1}


def test_store_keeps_versions_and_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots.Store, "KEEP", 3)
    monkeypatch.setattr(snapshots.Store, "COMPACT", 4)
    s = snapshots.Store(spark, str(tmp_path / "t"), "item_id string, v int", "item_id")
    assert s.insert(_frame(spark, ("a", 3), ("a", 1), ("a", 2)), order="v") == 1 and s.read().first().v == 1
    reader, want = s.read(), {"a": 1}
    for k in range(2, 9):
        (s.upsert if k % 2 else s.insert)(_frame(spark, (f"k{k}", k), ("a", k)))
        want |= {f"k{k}": k} | ({"a": k} if k % 2 else {})
        assert {r.item_id: r.v for r in s.read().collect()} == want
        if k == 3:
            assert reader.first().v == 1  # an old reader reads what it had
    assert len(s.versions()) == 3 and {r.item_id: r.v for r in s.read(s.versions()[0]).collect()} != want
    assert len(list((tmp_path / "t").glob("[iu]-*"))) < 9


def test_reports_have_no_caps(spark):
    df = spark.range(300).select(F.col("id").alias("ord"), F.concat(F.lit("T"), "id").alias("title"), F.lit(1.0).alias("final_score"), F.lit("s").alias("source_name"), F.lit("u").alias("url"), F.lit("c").alias("category"))
    assert snapshots.markdown(df, snapshots.digest_line(), "D").first().text.count("\n- ") == 300 and snapshots.markdown(df, snapshots.digest_line(), "D", most=7).first().text.count("\n- ") == 7
    assert len(json.loads(snapshots.outline(df, "M"))["topics"][0]["topics"]) == 300


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(2, "B", 8.5, "s", "u", "x"), (1, "A", 7.0, "s", "u", "y")], "ord long, title string, final_score double, source_name string, url string, category string")
    md = snapshots.markdown(df, snapshots.digest_line(), "Digest").first().text
    assert md == "# Digest\n\n- **A** (7.00) [s](u)\n- **B** (8.50) [s](u)"
    assert json.loads(snapshots.outline(df, "M"))["topics"][0]["topics"] == [{"title": "A"}]
    snapshots.write_snapshot(df, str(tmp_path / "o"), df.agg(F.count("*").alias("n")))
    assert spark.read.json(str(tmp_path / "o/meta")).first().n == 2


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema(e.schema).parquet(str(src))
    q = runs.tumbling(stream, late="30 days").writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda rows: sorted((r.start, r.event_type, r.n) for r in rows)
    assert key(spark.table("tumbling").collect()) == key(runs.tumbling(e).collect())
    store = snapshots.Store(spark, str(tmp_path / "s"), "event_id long, value double", "event_id")
    for _ in range(2):
        runs.upsert_into(runs.first_seen(stream.select("event_id", "value"), "event_id"), store, str(tmp_path / "c")).awaitTermination()
    assert store.read().count() == e.select("event_id").distinct().count()


def test_recency(spark):
    df = spark.createDataFrame([(1, dt.datetime(2026, 2, 19, 12)), (2, dt.datetime(2026, 2, 1)), (3, None), (4, dt.datetime(2026, 2, 17))], "i int, published_ts timestamp").withColumn("collected_ts", F.lit(None).cast("timestamp"))
    assert sorted(r.i for r in runs.recent(df, as_of()).collect()) == [1, 3] and [r.i for r in runs.age_band(df, as_of()).collect()] == [4]


def test_item_predicates(spark):
    a, b = F.col("a"), F.col("b")
    two = lambda c, *rows: values(spark, c, *rows, names=("a", "b"))
    assert two(scores.is_index_page(a, b), ("Model news", "An Archive of posts"), ("Model", "ships"), (None, None)) == [True, False, False]
    assert two(scores.is_non_event(a, b), ("Show HN: x", "Acme launches Foo today"), ("Acme", "launches a chip"), ("acme", "launches a chip"), ("acme", "launches a chip today"), (None, None)) == [True, False, True, False, True]
    one = lambda c, *rows: values(spark, c, *rows)
    assert one(scores.is_banner(a), "You signed in", "cookie " + "x" * 200, "cookie; sign in to " + "x" * 200, "", None) == [True, False, True, False, False]
    assert one(scores.is_invalid(a), "a b c", "large models", "發布 模型", None, "x " * 60) == [True, False, False, True, False]
    assert two(scores.needs_fulltext(a, b, F.lit("HN")), ("t", "t"), ("t", "short"), ("t", "x" * 200), ("", "")) == [True, True, False, True]
    assert two(scores.needs_fulltext(a, b, F.lit("x")), ("", ""), ("t", "Comments URL: https://news.ycombinator.com/"), (None, None)) == [False, True, False]
    assert one(scores.is_placeholder(a), "Subscribe now", "A model", "  ", None) == [True, False, True, True]
    assert two(scores.has_source(a, b), ("https://x", None), (" http://x", "none"), ("ftp://x", "Unknown "), (None, "Wire"), (None, None)) == [True, True, False, True, False]


def test_block_measures(spark):
    a = F.col("a")
    assert values(spark, text.sentence_marks(a), "One. Two; three", "none", " \n", None, "完。好；") == [2, 1, 0, 0, 2]
    assert values(spark, text.block_terms(a), "An AI model, a modeling agent", "大模型發布", "", None) == [3, 2, 0, 0]
    assert values(spark, text.block_numbers(a), "$3.5B, 40% and v2.1; 12 million, 4/5; 7", "", None) == [5, 0, 0]
    cut = {"It ships. Then the": "It ships.", "It ships. Then，": "It ships.", "no mark, ": "no mark", "no mark the": "no mark the", "它發布了。這是": "它發布了。", "It ships. Then more": "It ships. Then more", "A.\nB and": "A.", "": ""}
    assert values(spark, text.trim_fragment(a), *cut, None) == [*cut.values(), ""]


def test_report_predicates_and_lenient_sentences(spark):
    a, b = F.col("a"), F.col("b")
    assert values(spark, scores.is_banned(a), "x 高關注度", "Key terms: y", "key terms", None) == [True, True, False, False]
    rank = scores.is_first_rank(a, b, F.lit("t"))
    assert values(spark, rank, ("Hugging  Face", None), ("x", "https://x/google-research/y"), ("x", "https://y"), (None, None), names=("a", "b")) == [True, True, False, False]
    assert values(spark, text.lenient_sentences(a), "A! B? C", "a; b:c!\r\nd", "one, two", " ! ", None) == [["A", "B", "C"], ["a; b:c", "d"], ["one, two"], [], []]
    assert values(spark, text.lenient_sentences(a), "a; b", "x\ny") == [["a", "b"], ["x", "y"]]
    assert values(spark, text.two_sentences(a), "A! B? C", "one, two, three", "one,", "one", "", None) == [("A", "B C"), ("one", "two, three"), None, None, None, None]


def test_article_reason_is_linear_and_worked_out_once(spark):
    """Runs of blanks inside a text, and a plan in which nothing is repeated."""
    import time

    from granary.plans import queries as Q

    long = "a" + " " * 10**6 + "b"
    df = spark.createDataFrame([(1, "", long, "u")], "ord long, title string, body string, url string")
    began = time.time()
    assert df.select(scores.article_reason(F.col("body")).alias("r"), text.density_score(F.col("body")).alias("d")).first().r == "insufficient_sentences"
    assert time.time() - began < 20
    plan = Q.QUERIES["f06_reason_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 3 and plan.count("trim(") == 1 and plan.count("enable javascript") == 4  # there are four tokens with these words


@pytest.mark.parametrize("blank", [" ", "　", "\t", "\x85", " "])
def test_strip_knows_all_blanks(spark, blank):
    df = spark.createDataFrame([(blank + " a" + blank + "b " + blank,)], "t string")
    assert df.select(text.strip(F.col("t"))).first()[0] == "a" + blank + "b"
    assert df.select(text.squeeze(F.col("t"))).first()[0] == "a b"


def test_thin_pools_are_filled_up_in_the_split_gate(spark):
    """What the SQL of c05 leaves out: dense short texts as signals, as long as there are fewer than three."""
    body = "OpenAI Released Model 5 With 70 Percent Gain. Google Answered With Gemini 3 In March. " + "x" * 20
    rows = [(f"i{k}", k, "t", body if k < 4 else "too short", "https://a.b/") for k in range(8)]
    got = gating.split_gate(spark.createDataFrame(rows, "item_id string, ord long, title string, body string, url string"), topic=False).orderBy("ord").collect()
    assert [r.level for r in got[:4]].count("signal_fallback") == 3 and all(r.signal_pass for r in got[:3]) and got[7].reason == "fragment_placeholder"
