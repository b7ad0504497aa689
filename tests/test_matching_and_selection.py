"""Automata, glossaries, alignment, shared frames, narratives, brief selection, summaries and run metrics against plain versions."""

import random
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from granary.functions import fixed as V
from granary.functions import scores
from granary.operators import align, brief, matching, metrics, narrative, stats


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


# Automata ---------------------------------------------------------------------------------------------------------------
def test_contained(spark):
    rng = random.Random(1)
    words = tuple(dict.fromkeys("".join(rng.choice("abcé中") for _ in range(rng.randint(1, 4))) for _ in range(60))) + ("a", "a")
    texts = ["", None, *("".join(rng.choice("abcé中 ") for _ in range(rng.randint(0, 60))) for _ in range(150))]
    df = frame(spark, list(enumerate(texts)), "i long, t string").select("i", matching.contained(F.col("t"), words).alias("x"))
    assert {r.i: r.x for r in df.collect()} == {i: [k for k, w in enumerate(words) if t and w in t] for i, t in enumerate(texts)}
    assert frame(spark, [(0, "x")], "i long, t string").select(matching.contained(F.col("t"), ()).alias("x")).first().x == []


def test_class_hits_and_categories(spark):
    classes = {"A": ("ai", "fda", "x y"), "B": ("fda", "ai ai"), "C": ()}
    texts = ["ai and fda", "ai ai", "", None, "x y fda ai ai"]
    df = frame(spark, list(enumerate(texts)), "i long, t string").select("i", matching.class_hits(F.col("t"), classes).alias("x"))
    assert {r.i: tuple(r.x) for r in df.collect()} == {i: tuple(sum(w in (t or "") for w in own) for own in classes.values()) for i, t in enumerate(texts)}
    plan = frame(spark, [(0, "x", "y")], "i long, t string, b string").select(scores.category(F.col("t"), F.col("b"), F.lit("ai")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("contains") == 0


@pytest.mark.parametrize("most", [10**6, 400, 30])
def test_dictionary(spark, most):
    """A table of words, in one part or many; hot words and words within words."""
    rng = random.Random(2)
    words = ["the", "then", "HE", "", None, "zz", *("".join(rng.choice("abc") for _ in range(4)) for _ in range(250))]
    texts = ["the end", "", None, *(" ".join("the " + "".join(rng.choice("abc") for _ in range(9)) for _ in range(5)) for _ in range(60))]
    rows, names = frame(spark, list(enumerate(texts)), "ord long, text string"), frame(spark, [(w,) for w in words], "word string")
    got = sorted(map(tuple, matching.dictionary_matches(rows, names, most_chars=most).collect()))
    assert got == sorted((i, w) for i, t in enumerate(texts) for w in {w.lower() for w in words if w} if t and w in t.lower())
    assert matching.dictionary_matches(rows, names.limit(0)).collect() == []


# Glossary ---------------------------------------------------------------------------------------------------------------
GLOSSARY = {"Google DeepMind": "深思", "DeepMind": "思", "transformer": "變換器", "RAG": "檢索", "大模型": "LM", "open source model": "開", "source": "源", "İx": "i"}


@pytest.mark.parametrize(
    "fields, want",
    [
        (["DeepMind and deepmind"], ["DeepMind（思） and deepmind"]), (["Google DeepMind, then DeepMind."], ["Google DeepMind（深思）, then DeepMind（思）."]), (["a Transformer", "the transformer"], ["a Transformer（變換器）", "the transformer"]),
        (["transformers RAGs fragment"], ["transformers RAGs fragment"]), (["RAG（檢索） and RAG"], ["RAG（檢索） and RAG"]), (["an open source model of the source"], ["an open source model（開） of the source（源）"]),
        (["用大模型做"], ["用大模型做"]), (["用 大模型 做"], ["用 大模型（LM） 做"]), (["", None], ["", ""]), (["RAG"], ["RAG（檢索）"]), (["İİ RAG"], ["İİ RAG（檢索）"]), (["OpenAI"], ["OpenAI"]),
    ],
)
def test_glossary(spark, fields, want):
    df = spark.createDataFrame([(fields,)], "f array<string>").select(matching.with_glossary(F.col("f"), GLOSSARY | {"OpenAI": "x"}, never=("openai",)).alias("g"))
    assert df.first().g == want


def test_proper_nouns(spark):
    df = spark.createDataFrame([("Google DeepMind met Anna and GOOGLE at AI Co. Anna",), (None,)], "t string").select(matching.proper_nouns(F.col("t"), ("Anna",)).alias("x"))
    assert [r.x for r in df.collect()] == [["Google DeepMind", "GOOGLE", "AI Co"], []]


# Summaries --------------------------------------------------------------------------------------------------------------
def cards(spark, texts, valid=None):
    return frame(spark, [(i, t, f"Title {i}", f"s{i % 3}" if i else None, (valid or [True] * len(texts))[i], float(i % 11)) for i, t in enumerate(texts)], "ord long, body string, title string, source_name string, is_valid boolean, final_score double")


def test_company_watch(spark):
    texts = ["apple pie", "Google and Apple", "nothing", "META, google, Baidu", "nvidia", None]
    rows, one = stats.company_watch(cards(spark, texts, [False, True, True, True, True, True]), F.col("body"), F.col("final_score"), F.lit(2))
    got = [(r.tier, r["rank"], r.name, r.ord, r.impact) for r in rows.orderBy("tier", "rank").collect()]
    assert got == [("tier_a", 1, "Google", 1, 1), ("tier_a", 2, "Apple", 1, 1), ("tier_a", 3, "Meta", 3, 2), ("tier_a", 4, "NVIDIA", 4, 3), ("tier_b", 1, "Baidu", 3, 2)]
    assert tuple(one.first()) == (5, 1.8, "UP", 5, 1)
    few, one = stats.company_watch(cards(spark, ["none here"]), F.col("body"), F.col("final_score"), F.lit(0))
    assert few.collect() == [] and tuple(one.first()) == (0, 0.0, "STABLE", 1, 0)
    assert stats.company_watch(cards(spark, ["apple"] * 9), F.col("body"), F.col("final_score"), F.lit(0), most={"tier_a": 0, "tier_b": 0})[0].collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 40])
def test_signal_summary(spark, n):
    got = stats.signal_summary(cards(spark, ["x"] * n)).collect()
    assert [r.position for r in got] == [0, 1, 2] and [r.signal for r in got] == list(V.SIGNALS)[:3]
    names = ["scan" if i == 0 else f"s{i % 3}" for i in range(n)]
    for k, r in enumerate(got):
        i = k % min(n, 3) if n else None
        assert r.title == (f"Title {k}" if k < n else V.SIGNALS[r.signal]) and r.source_name == (names[i] if n else "scan")
        assert r.platform_count == (names.count(names[i]) if n else 1) and r.heat_score == min(100, max(30, round(((i or 0) or 3) * 12))) and r.passed_total_count == n and r.signals_insufficient == (n < 3)
        assert r.heat == ("hot" if r.heat_score >= 75 else "warm" if r.heat_score >= 50 else "cool")


# Alignment --------------------------------------------------------------------------------------------------------------
def in_order(left, right, tiers):
    maps = [{r[t]: k for k, r in sorted(right.items()) if r[t]} for t in range(tiers)]
    taken, out = set(), {}
    for a, row in sorted(left.items()):
        for t in range(tiers):
            b = maps[t].get(row[t]) if row[t] else None
            if b is not None and b not in taken:
                taken.add(b)
                out[a] = (b, t)
                break
    return out


@pytest.mark.parametrize("seed", range(6))
def test_alignment(spark, seed):
    rng = random.Random(seed)
    values = lambda n, kinds: {i: tuple(rng.choice([None, "", *(f"v{rng.randint(0, k)}" for _ in range(4))]) for k in kinds) for i in range(n)}
    kinds = (30, 8, 3) if seed % 2 else (6, 40, 1)
    left, right = values(40, kinds), values(30, kinds)
    make = lambda rows: frame(spark, [(i, *r) for i, r in rows.items()], "ord long, a string, b string, c string")
    got = align.aligned(make(left), make(right), [(F.col(c), F.col(c)) for c in "abc"]).collect()
    assert {r.a: (r.b, r.tier) for r in got} == in_order(left, right, 3) and len({r.b for r in got}) == len(got)
    assert align.aligned(make(left), make(right).limit(0), [(F.col("a"), F.col("a"))]).collect() == []


# Shared elements --------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("least", [1, 2, 4])
def test_cooccurring(spark, least):
    rng = random.Random(least)
    rows = [(i, None if i == 5 else [f"e{rng.randint(0, 25)}" for _ in range(rng.randint(0, 9))] + ["hot"] * (i % 3 == 0)) for i in range(70)]
    got = {(r.i, r.j): r.shared for r in stats.cooccurring(frame(spark, rows, "ord long, s array<string>"), "s", least=least).collect()}
    sets = {i: set(s or []) for i, s in rows}
    assert got == {(i, j): len(sets[i] & sets[j]) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= least}


def test_a_hot_element_makes_no_pairs(spark):
    """An element that all rows have pairs only those that nothing rarer tells apart."""
    n = 3000
    rows = spark.range(n).select(F.col("id").alias("ord"), F.array(F.lit("hot"), F.concat(F.lit("own"), F.col("id")), F.concat(F.lit("two"), (F.col("id") / 2).cast("long"))).alias("s"))
    from pyspark.sql import Observation

    pairs = stats.cooccurring(rows, "s", least=2)
    watch = Observation()
    pairs.observe(watch, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
    assert watch.get["n"] == n // 2
    text = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


# Narratives -------------------------------------------------------------------------------------------------------------
def keep(texts, least):
    out = []
    for s in texts:
        if not any(SequenceMatcher(None, s, k).ratio() >= least for k in out):
            out.append(s)
    return out


@pytest.mark.parametrize("least", [0.5, 0.86, 1.0])
def test_near_distinct(spark, least):
    rng = random.Random(4)
    groups = []
    for _ in range(40):
        base, own = "".join(rng.choice("abcd 中") for _ in range(rng.choice([0, 5, 40, 260]))), []
        for _ in range(rng.randint(0, 8)):
            own.append(base)
            if base:
                k = rng.randrange(len(base))
                base = base[:k] + rng.choice("xyz") * rng.randint(0, 4) + base[k + rng.randint(0, 6) :]
        groups.append(own)
    rows = frame(spark, list(enumerate(groups)), "i long, t array<string>").select("i", narrative.near_dedup(F.col("t"), least).alias("d")).collect()
    assert {r.i: r.d.kept for r in rows} == {i: keep(g, least) for i, g in enumerate(groups)}
    assert all(r.d.ratio == (round(1 - len(r.d.kept) / len(groups[r.i]), 3) if groups[r.i] else 0.0) for r in rows)
    assert spark.createDataFrame([(None,)], "t array<string>").select(narrative.near_dedup(F.col("t")).alias("d")).first().d.kept == []


CARD = "ord long, what_happened string, technical string, why_important string, title string, evidence array<string>, confirmed array<string>, effects array<string>, actions array<string>, source_name string, published_at string"


def test_narratives(spark):
    rows = [
        (0, "公司發布新模型，並開源全部權重。公司發布新模型，並開源全部權重！", "推理成本降低三成，市場競爭加劇。", "預計下月上線，未來將支援更多語言。", "標題", ["WATCH: 詳見原始來源 第一條很長的證據文字在此"], [], ["效果一：成本下降百分之三十以上很多"], ["MOVE: 立即測試新的模型與現有流程差異"], "IThome", "2026-02-11T00:00:00Z"),
        (1, "The company will release a model. It raises costs for many users.", None, "", "T", None, None, None, None, None, None),
        (2, None, None, None, "Only a title", [], [], [], [], "", ""),
    ]
    got = {r.ord: r for r in narrative.narratives(frame(spark, rows, CARD)).collect()}
    a, b, c = got[0], got[1], got[2]
    assert a.narrative.startswith("公司發布新模型，並開源全部權重。 推理成本降低三成，市場競爭加劇。 預計下月上線") and a.sentences_used == 3 and 0 < a.dedup_ratio < 0.5 and a.zh_ratio > 0.7
    assert a.proof_line == "證據：來源：IThome（2026-02-11）" and len(a.bullets) == 3 and a.bullets[2].startswith("立即測試") and not any("詳見" in x for x in a.bullets)
    assert b.narrative == "The company will release a model. It raises costs for many users.。" and b.zh_ratio == 0.0 and b.proof_line == "證據：來源：未知來源（）" and len(b.bullets) == 2
    assert c.narrative == "Only a title。" and c.bullets == []
    one = narrative.narrative_meta(narrative.narratives(frame(spark, rows, CARD))).first()
    assert one.applied_count == 3 and narrative.narrative_meta(narrative.narratives(frame(spark, rows, CARD).limit(0))).first().avg_zh_ratio == 0.0


def test_for_reports(spark):
    texts = ["WATCH: now… then...", "todo : x", "has 新穎性 in it", "", None, "plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", narrative.for_reports(F.col("t")).alias("x"))
    assert [r.x for r in df.orderBy("i").collect()] == ["now then", "x", V.SAFE_SENTENCE, "", "", "plain"]


# Brief selection --------------------------------------------------------------------------------------------------------
NUMBERS = ["zero", "one", "two", "three", "four", "five", "six"]


def story(k, extra=""):
    body = " ".join(f"{NUMBERS[k].title()} {w} units of Nvidia earn ${j + 2}{k} million in 202{j} and will cut the cost for Berlin customers {extra}." for j, w in enumerate(["training", "search", "speech", "video", "robots", "medicine", "finance", "weather", "retail", "maps", "games", "music"]))
    return (f"Nvidia product {k}", body, f"https://x.org/{k}", "paper", "Nvidia", ["Nvidia", "Berlin"], True)


def test_brief_selection(spark):
    cards = [
        story(1), story(2, "here"), ("A", "b", "u", "s", "Nvidia", ["x"], False), ("A", story(3)[1], "u", "s", " ", ["x"], True), ("A", story(3)[1], "u", "s", "v1.2", ["x"], True), ("A", "short", "u", "s", "Nvidia", ["x"], True),
        ("A", story(3)[1], "u", "s", "Nvidia", ["", None], True), ("A", "nothing of note is said in this text at all, which goes on and on. " * 6, "u", "s", "Nvidia", ["x"], True), story(1)[:2] + ("https://openai.com/blog/x", "OpenAI") + story(1)[4:], (None,) * 6 + (None,),
    ]
    df = frame(spark, [(i, *c) for i, c in enumerate(cards)], "ord long, title string, body string, url string, source_name string, actor string, anchors array<string>, relevant boolean")
    got = {r.ord: r for r in brief.selection(df).collect()}
    assert len(got) == len(cards) and all((r.reason is None) != (r.place is None) for r in got.values())
    assert [got[i].reason for i in (2, 3, 4, 5, 6, 7, 9)] == ["non_ai", "actor_invalid", "actor_invalid", "fulltext_too_short", "anchor_missing", "fact_pack_insufficient", "non_ai"]
    # The copy from a source of first rank comes first, so the other is the duplicate.
    assert got[8].place == 1 and got[1].place == 2 and got[0].reason == "duplicate_frames"
    assert len(got[8].quote_1) >= 80 and got[8].quote_1 != got[8].quote_2
    few = {r.ord: r.reason for r in brief.selection(df.filter("ord in (1, 8)"), most=0).collect()}
    assert set(few.values()) == {"beyond_limit"}
    assert brief.selection(df.limit(0)).collect() == []


def test_brief_selection_in_order(spark):
    """Of cards in pairs that share frames those are kept that a pass in order keeps."""
    rng = random.Random(6)
    df = frame(spark, [(i, *story(rng.randint(1, 5), rng.choice(["", "x y z"]))) for i in range(14)], "ord long, title string, body string, url string, source_name string, actor string, anchors array<string>, relevant boolean")
    rows = brief.selection(df).collect()
    kept = sorted(r.place for r in rows if r.place)
    assert kept == list(range(1, len(kept) + 1)) and Counter(r.reason for r in rows)["duplicate_frames"] == 14 - len(kept)


# Metrics ----------------------------------------------------------------------------------------------------------------
def test_run_metrics_of_a_batch_and_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, ["a", "b", None][i % 3], i) for i in range(30)], "k long, reason string, n long")
    counters = metrics.reason_counters(F.col("reason"), ("a", "b"))
    batch = metrics.RunMetrics("r")
    out = batch.observe(batch.observe(rows, "loaded", rows=F.count("*"), max_n=F.max("n")).filter("n > 2"), "gate", **counters)
    assert batch.values(wait=0.2)["loaded_rows"] is None  # no job yet
    out.write.format("noop").mode("overwrite").save()
    want = {"loaded_rows": 30, "loaded_max_n": 29, "gate_rejected_a": 9, "gate_rejected_b": 9, "gate_passed": 9}
    assert batch.values() == want
    one = batch.row(spark).first().asDict()
    assert {k: one[k] for k in want} == want and one["run_id"] == "r" and one["total_runtime_seconds"] > 0
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = metrics.RunMetrics("s")
    spark.streams.addListener(stream)
    read = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.observe(stream.observe(read, "loaded", rows=F.count("*"), max_n=F.max("n")).filter("n > 2"), "gate", **counters)
    run = q.writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination()
    import time

    for _ in range(100):
        if stream.values().get("loaded_rows") == 30:
            break
        time.sleep(0.1)
    spark.streams.removeListener(stream)
    assert stream.values() == want
    assert re.match(r"^\w{12}$", metrics.RunMetrics().run_id)
