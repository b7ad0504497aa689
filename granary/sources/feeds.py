"""Feeds: RSS and Atom documents as rows, a data source for files of them, and a registry of sources that may not fail."""

from __future__ import annotations

import html
import json
import re
import xml.etree.ElementTree as ET
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from granary.functions.links import domain, item_id, parse_date

ENTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "url", "published_raw", "published_source", "summary")])
RAW_ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("item_id", "title", "url", "body", "published_at", "source_name", "source_category", "lang")])
_ATOM, _DC = "{http://www.w3.org/2005/Atom}", "{http://purl.org/dc/elements/1.1/}"


def _plain(text: str) -> str:
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", text)).split())


def _text(node: ET.Element, *names: str) -> str:
    return next((child.text.strip() for n in names if (child := node.find(n)) is not None and child.text), "")


def _dated(node: ET.Element, fields: dict[str, str]) -> tuple[str, str]:
    """The first date field that has a text, and what it is called."""
    return next(((v, label) for name, label in fields.items() if (v := _text(node, name))), ("", ""))


def _rss(root: ET.Element) -> Iterator[tuple[str, ...]]:
    channel = root.find("channel")
    for e in (channel if channel is not None else root).findall("item") or root.findall(".//item"):
        date = _dated(e, {"pubDate": "rss_pubDate", "dc:date": "dc_date", f"{_DC}date": "dc_date", "updated": "rss_updated"})
        yield _plain(_text(e, "title")), _text(e, "link", "guid", f"{_ATOM}link"), *date, _plain(_text(e, "description", "summary", f"{_ATOM}summary"))


def _atom(root: ET.Element) -> Iterator[tuple[str, ...]]:
    for e in root.findall(f"{_ATOM}entry") or root.findall("entry"):
        links = [x.get("href", "") for x in [*e.findall(f"{_ATOM}link"), *e.findall("link")] if x.get("rel", "alternate") in ("alternate", "")]
        link = next(filter(None, links), "") or _text(e, f"{_ATOM}id", "id")
        date = _dated(e, {f"{_ATOM}published": "atom_published", f"{_ATOM}updated": "atom_updated", "published": "atom_published", "updated": "atom_updated"})
        yield _plain(_text(e, f"{_ATOM}title", "title")), link, *date, _plain(_text(e, f"{_ATOM}summary", f"{_ATOM}content", "summary", "content"))


def parses(xml: str) -> bool:
    try:
        ET.fromstring(xml.lstrip("\ufeff\ufffe").encode("utf-8", "replace"))
    except ET.ParseError:
        return False
    return True


def entries(xml: str | None, most: int = 30, summary: int = 500) -> list[tuple[str, ...]]:
    """ENTRY tuples of a feed's first entries that have a title and an http address; none of a text that is no feed."""
    try:
        root = ET.fromstring((xml or "").lstrip("﻿￾").encode("utf-8", "replace"))
    except ET.ParseError:
        return []
    found = list(_atom(root) if "feed" in root.tag.lower() else _rss(root))[:most]
    return [(t, u, d, s if d else "", x[:summary]) for t, u, d, s, x in found if t and u.startswith("http")]


def parse_feeds(feeds: DataFrame, as_of, most: int = 30) -> DataFrame:
    """Collected records of feeds with xml, feed_name, platform, feed_url and tag: one row for each entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(*r[:4], i, *e) for r in b.itertuples(index=False) for i, e in enumerate(entries(r[4], most))]
            yield pd.DataFrame(out, columns=["feed_name", "platform", "feed_url", "tag", "position", *ENTRY.names])

    names = ("feed_name", "platform", "feed_url", "tag")
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField("position", T.IntegerType()), *ENTRY.fields])
    rows = feeds.select(*names, "xml").mapInPandas(run, schema)
    ts = parse_date(F.col("published_raw"))
    return rows.select(
        item_id(F.col("title"), F.col("url")).alias("id"), "title", "url", domain(F.col("url")).alias("domain"), ts.alias("published_ts"), "published_raw",
        F.when(ts.isNull(), "fallback_collected_at").otherwise(F.col("published_source")).alias("published_source"), "summary", F.lit("").alias("content_text"),
        F.struct("platform", "feed_name", "feed_url", "tag").alias("source"), as_of.alias("collected_ts"), "position",
    )


class FeedSource(DataSource):
    """`spark.read.format("feed").option("paths", a JSON list of files).load()`: the entries of feed files, a partition for each.

    Each file has rows whose `status` is ok, or one row that says what became of it: empty, unreadable or malformed.
    """

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("path", T.StringType()), *ENTRY.fields, T.StructField("status", T.StringType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FeedReader(json.loads(self.options.get("paths", "[]")), int(self.options.get("most", "30")))


class FeedReader(DataSourceReader):
    def __init__(self, paths: list[str], most: int):
        self.paths, self.most = paths, most

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import pyarrow.fs

        try:
            fs, path = pyarrow.fs.FileSystem.from_uri(partition.value) if "://" in partition.value else (pyarrow.fs.LocalFileSystem(), partition.value)
            with fs.open_input_stream(path) as f:
                text = f.read().decode("utf-8", "replace")
        except OSError:  # a source that fails is a row that says so
            yield (partition.value, *[None] * len(ENTRY.fields), "unreadable")
            return
        found = entries(text, self.most)
        for e in found:
            yield (partition.value, *e, "ok")
        if not found:
            yield (partition.value, *[None] * len(ENTRY.fields), "empty" if parses(text) else "malformed")


class Source(ABC):
    """A named source of RAW_ITEM rows."""

    name: str = ""

    @abstractmethod
    def fetch(self, spark: SparkSession) -> DataFrame: ...


class Rows(Source):
    """A source of fixed rows."""

    def __init__(self, name: str, rows: list[tuple]):
        self.name, self.rows = name, rows

    def fetch(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, RAW_ITEM)


class Registry:
    """Sources by name. A source that fails or is empty counts as failed, with its reason, and the others go on."""

    def __init__(self, sources: list[Source] | None = None):
        self.sources = {s.name: s for s in sources or []}

    def register(self, source: Source) -> None:
        self.sources[source.name] = source

    def fetch_all(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """All rows with their origin, and (source, status, reason, n) of each source."""
        got, status = [], []
        for rank, name in enumerate(sorted(self.sources)):
            try:
                rows = self.sources[name].fetch(spark).select(*RAW_ITEM.names)
                n = rows.count()
            except Exception as e:  # a plug-in may raise anything
                status.append((name, "failed", type(e).__name__, 0))
                continue
            status.append((name, "ok" if n else "failed", "" if n else "empty", n))
            got.append(rows.withColumn("origin", F.lit(name)).withColumn("origin_rank", F.lit(rank)))
        empty = spark.createDataFrame([], T.StructType([*RAW_ITEM.fields, T.StructField("origin", T.StringType()), T.StructField("origin_rank", T.IntegerType())]))
        return reduce(DataFrame.unionByName, got, empty), spark.createDataFrame(status, "source string, status string, reason string, n long")


def feed_counts(items: DataFrame, registry: DataFrame) -> DataFrame:
    """(feed_name, n) of every registered feed, with 0 for those without rows."""
    return registry.select("feed_name").join(items.groupBy("feed_name").agg(F.count("*").alias("n")), "feed_name", "left").fillna(0, ["n"])


def with_fallback(attempts: list[Callable[[], DataFrame]]) -> DataFrame | None:
    """The first attempt that neither raises nor is empty."""
    for attempt in attempts:
        try:
            df = attempt()
            if not df.isEmpty():
                return df
        except Exception:  # the next mirror may answer
            continue
    return None
