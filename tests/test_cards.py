"""Cards of results and of gated items on literal rows."""

from granary.operators import gating
from granary.operators import cards

RESULT = "item_id string, a struct<title: string, summary: string, category: string, source_id: string>, b struct<final_score: double>, c struct<cta_url: string>, passed_gate boolean"
GATED = "item_id string, title string, body string, full_text string, url string, source_name string, source_category string, density int, event_pass boolean, signal_pass boolean, fulltext_len int"


def test_result_cards(spark):
    rows = [
        ("1", ("T", "S", "tech", "src"), (7.5,), (" https://own/ ",), True), ("2", ("T", None, None, None), (None,), ("ftp://x",), False), ("3", None, None, None, None), ("4", ("T", "S", "c", "s"), (1.0,), ("",), True),
    ]
    items = spark.createDataFrame([("1", "https://item/1", 900), ("2", "http://item/2", None), ("4", "none", 5)], "item_id string, url string, fulltext_len int")
    got = {r.item_id: r for r in cards.result_cards(spark.createDataFrame(rows, RESULT), items).collect()}
    assert [(got[k].is_valid, got[k].invalid_reason, got[k].source_url, got[k].final_score, got[k].fulltext_len) for k in "1234"] == [(True, "", "https://own/", 7.5, 900), (False, "failed_gate", "http://item/2", 0.0, 0), (False, "failed_gate", "", 0.0, 0), (True, "", "", 1.0, 5)]
    assert got["1"].what_happened == got["1"].why_important == "S" and got["3"].title == ""
    alone = cards.result_cards(spark.createDataFrame(rows[:1], RESULT)).first()
    assert alone.source_url == "https://own/" and alone.fulltext_len == 0 and cards.result_cards(spark.createDataFrame([], RESULT), items).collect() == []


def test_soft_cards(spark):
    rows = [
        ("1", " T ", "b" * 600, "f" * 700, "https://u", "src", "ai", 45, True, True, 0), ("2", "", "", None, "ftp://u", " ", None, None, None, None, None), ("3", "T", "short", "", "http://u", "s", "x", 200, False, True, 1234), ("4", "T", "b", "f" * 299, "", "s", "x", 7, False, False, 0),
    ]
    got = {r.item_id: r for r in cards.soft_cards(spark.createDataFrame(rows, GATED)).collect()}
    assert got["1"].what_happened == "f" * 500 and got["1"].final_score == 4.5 and got["1"].density_tier == "A" and got["1"].fulltext_len == 700 and got["1"].full_text == "f" * 700 and got["1"].why_important == "Source src; reference https://u."
    assert (got["2"].title, got["2"].what_happened, got["2"].source_name, got["2"].source_url, got["2"].category, got["2"].final_score, got["2"].density_tier, got["2"].event_pass, got["2"].fulltext_len) == ("Untitled Event", "No summary available from source.", "unknown_source", "", "tech", 3.0, "B", True, 0)
    assert got["2"].why_important == "Source unknown_source; reference N/A." and got["3"].final_score == 10.0 and got["3"].fulltext_len == 1234 and got["4"].full_text is None
    assert cards.soft_cards(spark.createDataFrame([], GATED)).collect() == []


def test_gates_read_texts_once(spark):
    """Features are stored, so that what asks for levels, reasons or cards does not work them out again."""
    rows = spark.createDataFrame([(i, f"i{i}", "t", f"Text number {i} says Something. " * 60, "https://e.com", "s", "tech", 0) for i in range(20)], "ord long, item_id string, title string, body string, url string, source_name string, source_category string, fulltext_len int")
    for out in (gating.adaptive_gate(rows, topic=False), gating.split_gate(rows, topic=False)):
        plan = out.select("ord", "level", "reason", "density")._jdf.queryExecution().executedPlan().toString()
        assert "RLIKE" not in plan.upper() and "regexp" not in plan and out.count() == 20
