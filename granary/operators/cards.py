"""Cards for reports, made of results or, where there are none, of gated items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import strip, text_of

#: What stands for a missing title, text and source: fixed values.
NO_TITLE, NO_TEXT, NO_SOURCE, SUMMARY, LEAST_FULLTEXT = "Untitled Event", "No summary available from source.", "unknown_source", 500, 300


def _address(c: Column) -> Column:
    return F.when(strip(text_of(c)).rlike("^https?://"), strip(text_of(c)))


def result_cards(results: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Light cards of results (item_id, a, b, c, passed_gate): valid if they passed, with the address of the card text or else that of the item, and the item's full-text length.

    items: (item_id, url, fulltext_len), one row of an id. Results without an item keep what they have.
    """
    rows = results.withColumn("_own", _address(F.col("c.cta_url")))
    if items is not None:
        rows = rows.join(items.select("item_id", F.struct(_address(F.col("url")).alias("url"), F.col("fulltext_len").alias("n")).alias("_item")), "item_id", "left")
    else:
        rows = rows.withColumn("_item", F.lit(None).cast("struct<url: string, n: int>"))
    passed = F.coalesce(F.col("passed_gate"), F.lit(False))
    return rows.select(
        F.col("item_id").cast("string").alias("item_id"), passed.alias("is_valid"), F.when(passed, "").otherwise("failed_gate").alias("invalid_reason"), text_of("a.title").alias("title"), text_of("a.summary").alias("what_happened"), text_of("a.summary").alias("why_important"),
        text_of("a.source_id").alias("source_name"), F.coalesce("_own", "_item.url", F.lit("")).alias("source_url"), text_of("a.category").alias("category"), F.coalesce("b.final_score", F.lit(0.0)).alias("final_score"), F.coalesce("_item.n", F.lit(0)).alias("fulltext_len"),
    )


def soft_cards(gated: DataFrame) -> DataFrame:
    """Cards of gated items, for a run without results: the beginning of the full text or else of the body, a tenth of the density between 3 and 10 as score, tier A for events and B for the others.

    Reads item_id, title, body, full_text, url, source_name, source_category, density, event_pass, signal_pass and fulltext_len.
    """
    full, body, url = strip(text_of("full_text")), strip(text_of("body")), strip(text_of("url"))
    text = F.when(full != "", full).otherwise(body)
    or_ = lambda c, other: F.coalesce(F.nullif(strip(text_of(c)), F.lit("")), F.lit(other))
    density = F.coalesce(F.col("density"), F.lit(0))
    n = F.when(F.coalesce(F.col("fulltext_len"), F.lit(0)) > 0, F.col("fulltext_len")).otherwise(F.length(text))
    address = F.when(url.startswith("http"), url)
    return gated.select(
        text_of("item_id").alias("item_id"), F.lit(True).alias("is_valid"), or_("title", NO_TITLE).alias("title"), F.when(text == "", NO_TEXT).otherwise(F.substring(text, 1, SUMMARY)).alias("what_happened"),
        F.concat(F.lit("Source "), or_("source_name", NO_SOURCE), F.lit("; reference "), F.coalesce(address, F.lit("N/A")), F.lit(".")).alias("why_important"), or_("source_name", NO_SOURCE).alias("source_name"), F.coalesce(address, F.lit("")).alias("source_url"),
        F.when(text_of("source_category") == "", "tech").otherwise(F.col("source_category")).alias("category"), F.greatest(F.lit(3.0), F.least(F.lit(10.0), density / 10)).alias("final_score"), F.coalesce("event_pass", F.lit(True)).alias("event_pass"),
        F.coalesce("signal_pass", F.lit(True)).alias("signal_pass"), density.cast("int").alias("density"), F.when(F.col("event_pass"), "A").otherwise("B").alias("density_tier"), n.cast("int").alias("fulltext_len"), F.when((n >= LEAST_FULLTEXT) & (full != ""), F.col("full_text")).alias("full_text"),
    )
