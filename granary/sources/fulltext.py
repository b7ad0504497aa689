"""Full texts for items: each address is fetched once, whatever the number of items that have it, and its text goes to all of them.

A fetch is a function from a table (url, host) to a table (url, final_url, html, reason, tries), reason being null where
there is a page. calls() makes one of a client that asks a server, archived() one of a table of pages.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import fixed as V
from granary.functions.article import article, article_text, elsewhere, is_aggregator, needs_script
from granary.functions.links import domain, host, publisher_url
from granary.functions.scores import needs_fulltext
from granary.functions.text import article_quality, strip, text_of
from granary.operators.dedupe import cut

Fetch = Callable[[DataFrame], DataFrame]
PAGES = "url string, final_url string, html string, reason string, tries int"


@dataclass
class Page:
    html: str
    final_url: str


class FetchError(Exception):
    """A server's answer that is no page."""

    def __init__(self, status: int):
        super().__init__(f"http_{status}")
        self.status = status


class Client(Protocol):
    """What asks a server: made once in each task, from a function that can be sent there."""

    def get(self, url: str) -> Page: ...


def reason_of(error: Exception) -> str:
    """http_<status>, timeout, connection_error or the error's kind and beginning."""
    if isinstance(error, FetchError):
        return f"http_{error.status}"
    if isinstance(error, TimeoutError) or "timed out" in str(error).lower():
        return "timeout"
    if isinstance(error, ConnectionError):
        return "connection_error"
    return f"{type(error).__name__}:{str(error)[:50]}"


def calls(client: Callable[[], Client], spacing: float = 0.5, lanes: int = 1, tries: int = 1, backoff: float = 1.0, threads: int = 8) -> Fetch:
    """Asks servers: one request after the other to a host, `spacing` seconds apart, several hosts of a task at a time.

    A host's addresses lie in one task, or in `lanes` tasks, each then that many times slower, which spreads a host that
    has a large share of all addresses. Timeouts and lost connections are tried again after `backoff` seconds, then twice as many.
    """

    def one(session: Client, url: str) -> tuple[str, str | None, str | None, str | None, int]:
        wait, why = backoff, ""
        for attempt in range(1, tries + 1):
            try:
                page = session.get(url)
                return url, page.final_url, page.html, None, attempt
            except (TimeoutError, ConnectionError) as e:
                why = reason_of(e)
                if attempt < tries:
                    time.sleep(wait)
                    wait *= 2
            except Exception as e:  # a client may raise anything; a page that fails is a row with a reason
                return url, None, None, reason_of(e), attempt
        return url, None, None, why, tries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, last = client(), {}

        def in_turn(group: tuple[str, list[str]]) -> list[tuple]:
            name, urls, out = group[0], group[1], []
            for url in urls:
                time.sleep(max(0.0, last.get(name, 0.0) + spacing * lanes - time.monotonic()))
                last[name] = time.monotonic()
                out.append(one(session, url))
            return out

        with ThreadPoolExecutor(threads) as pool:
            for b in (x.slice(i, 256) for x in batches for i in range(0, x.num_rows, 256)):
                hosts: dict[str, list[str]] = {}
                for url, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    hosts.setdefault(name, []).append(url)
                rows = [r for part in pool.map(in_turn, hosts.items()) for r in part]
                cols = [*zip(*rows, strict=True)] or [()] * 5
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:4]), pa.array(cols[4], pa.int32())], names=["url", "final_url", "html", "reason", "tries"])

    def fetch(urls: DataFrame) -> DataFrame:
        dealt = urls.withColumn("_lane", F.pmod(F.xxhash64("url"), F.lit(lanes)))
        return dealt.repartition("host", "_lane").sortWithinPartitions("host").select("url", "host").mapInArrow(run, PAGES)

    return fetch


def archived(pages: DataFrame, url: str = "url", html: str = "html") -> Fetch:
    """Reads pages from a table; an address that is not there is http_404, one that has several pages is the first of their texts."""
    own = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).groupBy("url").agg(F.min("html").alias("html"))

    def fetch(urls: DataFrame) -> DataFrame:
        found = urls.select("url").join(own, "url", "left")
        return found.select("url", F.when(F.col("html").isNotNull(), F.col("url")).alias("final_url"), "html", F.when(F.col("html").isNull(), "http_404").alias("reason"), F.lit(1).alias("tries"))

    return fetch


def _wanted(urls: DataFrame) -> DataFrame:
    return urls.filter(F.col("url").startswith("http")).distinct().withColumn("host", host(F.col("url")))


def full_texts(urls: DataFrame, fetch: Fetch, least: int = V.FULLTEXT_LEAST) -> DataFrame:
    """(url, final_url, status, reason, full_text, fulltext_len, fidelity) of each different address that begins with http.

    Pages are kept in the checkpoint folder once fetched, so nothing that follows asks a server again. An aggregator's page
    leads to its publisher's, which is fetched in a second round, once for each publisher's address.
    """
    first = cut(fetch(_wanted(urls.select("url"))))
    led = first.filter(is_aggregator(F.col("final_url"))).select("url", article(F.col("html")).alias("x")).select("url", F.coalesce(publisher_url(F.col("url")), elsewhere(F.col("x"))).alias("publisher")).filter("publisher is not null")
    led = cut(led)
    if not led.isEmpty():
        second = cut(fetch(_wanted(led.select(F.col("publisher").alias("url"))))).select(F.col("url").alias("publisher"), F.col("final_url").alias("final_2"), F.col("html").alias("html_2"))
        led = led.join(second, "publisher", "left").select("url", "publisher", "final_2", "html_2")
        first = first.join(led, "url", "left").select("url", F.coalesce("final_2", "publisher", "final_url").alias("final_url"), F.coalesce("html_2", "html").alias("html"), "reason", "tries")
    parsed = first.select("url", F.coalesce("final_url", "url").alias("final_url"), "reason", needs_script(F.col("html")).alias("script"), article(F.col("html")).alias("x"))
    read = parsed.withColumn("x", article_text(F.col("x"))).withColumn("n", F.length("x.text"))
    fetched = F.col("reason").isNull()
    reason = F.when(~fetched, F.col("reason")).when(F.col("script"), "js_only").when(F.col("n") < least, "extract_too_short").otherwise("ok")
    out = read.withColumn("why", reason).withColumn("good", F.col("why") == "ok")
    fidelity = F.struct(domain(F.col("final_url"), exact=True).alias("domain"), F.col("n").alias("cleaned_text_len"), *(F.col(f"x.{c}").alias(c) for c in ("raw_text_len", "raw_paragraph_count", "cleaned_paragraph_count", "removed_paragraphs_count", "cta_hits_count", "extract_method")))
    return out.select(
        "url", "final_url", F.when(F.col("good"), "ok").when(F.col("why") == "js_only", "skip").otherwise("fail").alias("status"), F.col("why").alias("reason"), F.when(F.col("good"), F.col("x.text")).otherwise("").alias("full_text"),
        F.when(F.col("good"), F.col("n")).otherwise(0).alias("fulltext_len"), F.when(fetched & ~F.col("script"), fidelity).alias("fidelity"),
    )


def hydrate(items: DataFrame, fetch: Fetch, known: DataFrame | None = None, url: str = "url", body: str = "body", least: int = V.ENRICH_LEAST, most: int = V.ENRICH_MOST) -> DataFrame:
    """items with full_text, fulltext_len, fulltext_status, fulltext_reason, final_url and fidelity; a long full text's beginning goes to the body, unless it is there.

    known: full texts of earlier runs, whose addresses are not fetched again. Every item gets a row and a reason, in
    whatever number they share an address; those without one have the reason no_url.
    """
    own = items.drop("full_text", "fulltext_len", "fulltext_status", "fulltext_reason", "final_url", "fidelity").withColumn("_url", strip(text_of(url)))
    urls = own.select(F.col("_url").alias("url"))
    if known is not None:
        urls = urls.join(known.select("url"), "url", "left_anti")
    texts = cut(full_texts(urls, fetch))
    if known is not None:
        texts = texts.unionByName(known.select(texts.columns))
    texts = texts.select(F.col("url").alias("_url"), F.struct(*(c for c in texts.columns if c != "url")).alias("_t"))
    rows = own.join(texts, "_url", "left")
    start = F.substring(F.col("_t.full_text"), 1, most)
    longer = (F.col("_t.fulltext_len") >= least) & ~F.contains(text_of(body), start)
    names = {"full_text": "full_text", "fulltext_len": "fulltext_len", "fulltext_status": "status", "fulltext_reason": "reason", "final_url": "final_url"}
    missing = {"full_text": "", "fulltext_len": 0, "fulltext_status": "fail", "fulltext_reason": "no_url", "final_url": ""}
    rows = rows.withColumn(body, F.when(longer, F.concat(text_of(body), F.lit("\n\n"), start)).otherwise(F.col(body)))
    return rows.withColumns({k: F.coalesce(F.col(f"_t.{v}"), F.lit(missing[k])) for k, v in names.items()}).withColumn("fidelity", F.col("_t.fidelity")).drop("_url", "_t")


def hydration_meta(items: DataFrame, most: int = 10) -> DataFrame:
    """One row: events_total, fulltext_applied, fulltext_ok_count, coverage_ratio, avg_fulltext_len of those that are ok, and the reasons of the others with their counts, the most frequent first."""
    ok = F.col("fulltext_status") == "ok"
    per = items.groupBy(F.when(~ok, F.substring("fulltext_reason", 1, 40)).alias("reason")).agg(F.count("*").alias("n"), F.count("fulltext_status").alias("applied"), F.count_if(ok).alias("ok"), F.sum(F.when(ok, F.col("fulltext_len")).otherwise(0)).alias("chars"))
    failed = F.filter(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.coalesce("reason", F.lit("")).alias("reason")))), lambda x: x["reason"] != "")  # as many as there are reasons
    one = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("applied"), F.lit(0)).alias("applied"), F.coalesce(F.sum("ok"), F.lit(0)).alias("ok"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), failed.alias("failed"))
    share = lambda a, b, d: F.when(b > 0, F.round(a / b, d)).otherwise(0.0)
    return one.select(
        F.col("n").alias("events_total"), F.col("applied").alias("fulltext_applied"), F.col("ok").alias("fulltext_ok_count"), share(F.col("ok"), F.col("n"), 3).alias("coverage_ratio"), F.when(F.col("ok") > 0, F.bround(F.col("chars") / F.col("ok"), 0)).otherwise(0.0).cast("long").alias("avg_fulltext_len"),
        F.transform(F.slice("failed", 1, most), lambda x: F.struct(x["reason"].alias("reason"), (-x["n"]).alias("n"))).alias("fail_reasons_top"),
    )


def enrich(items: DataFrame, fetch: Fetch, least: int = 400) -> tuple[DataFrame, DataFrame]:
    """(items, attempts): items that hold no more than data about themselves get the text of their page if that is longer.

    attempts: (url, status, reason), one for each different address that was asked for; reason is timeout, blocked,
    connection_error, http_error, extract_empty, extract_low_quality or empty.
    """
    own = items.withColumn("_url", strip(text_of("url"))).withColumn("_needs", F.coalesce(needs_fulltext(F.col("title"), F.col("body"), F.col("source_name")), F.lit(False)))
    pages = cut(fetch(_wanted(own.filter("_needs").select(F.col("_url").alias("url")))))
    read = pages.select("url", "reason", article(F.col("html")).alias("x")).select("url", "reason", article_text(F.col("x"), most=None, limit=None)["text"].alias("text"))
    code = F.regexp_extract(text_of("reason"), r"^http_(\d+)$", 1)
    error = F.when(code.isin(*map(str, V.BLOCKED_STATUS)), "blocked").when(F.col("reason").isin("timeout", "connection_error"), F.col("reason")).when(F.col("reason").isNotNull(), "http_error").otherwise(F.coalesce(article_quality(F.col("text"), least), F.lit("")))
    read = cut(read.select(F.col("url").alias("_url"), error.alias("_reason"), F.when(F.col("reason").isNull(), F.col("text")).otherwise("").alias("_text")))
    rows = own.join(read, "_url", "left")
    better = F.col("_needs") & F.col("_reason").isin("", "extract_low_quality") & (F.length("_text") > F.length(text_of("body")))
    attempts = read.select(F.col("_url").alias("url"), F.when(F.col("_reason") == "", "ok").otherwise("fail").alias("status"), F.col("_reason").alias("reason"))
    return rows.withColumn("body", F.when(better, F.col("_text")).otherwise(F.col("body"))).select(items.columns), attempts
