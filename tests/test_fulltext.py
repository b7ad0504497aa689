"""Articles of pages, and full texts for items: one request for each address, a row and a reason for each item."""

import base64
import json
import os
import sys
import tempfile
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from granary.functions import article
from granary.sources import fulltext

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks have no module of tests
LONG = "A sentence that goes on for a while and says something of use. "


@pytest.mark.parametrize(
    "html, paragraphs, inside",
    [
        (None, [], False), ("", [], False), ("<p>one</p><p>two", ["one"], False), ("<p>lost<p>kept</p>", ["kept"], False), ("<p>a</p><article><p>b</p></article>", ["b"], True), ("<main><li>x</li><p>y<li>z</li></p></main>", ["x", "y z"], True),
        ("<nav><p>no</p></nav><p>yes <b>so</b></p>", ["yes  so"], False), ("<p>a<aside>no</aside>b</p>", ["a b"], False), ("<script>var p = '<p>no</p>'; if (a<b) {}</script><p>x &amp; y</p>", ["x & y"], False),
        ("<p title='a>b'>in</p><!-- <p>no</p> -->", ["in"], False), ("</article><p>x</p></p>", ["x"], False), ("<ARTICLE><P>Up</P></ARTICLE>", ["Up"], True), ("<p>1 < 2</p>", ["1 < 2"], False), ("<p>   </p>", [], False), ("<style>p{}</style", [], False),
    ],
)
def test_paragraphs(html, paragraphs, inside):
    got = article.parse(html)
    assert [" ".join(p.split()) for p in got[0]] == [" ".join(p.split()) for p in paragraphs] and got[1] == inside


def test_addresses_of_a_page():
    page = '<meta http-equiv="Refresh" content="0; URL=\'https://x.org/a\'"><link rel="canonical" href="https://x.org/c?a=1&amp;b=2"><a href="http://no.org">n</a><a class=k href=https://y.org/1>l</a><a href=\'https://z.org\'>m</a>'
    assert article.parse(page)[2:] == ("https://x.org/a", "https://x.org/c?a=1&b=2", ["https://y.org/1", "https://z.org"])


def test_long_pages_take_linear_time():
    began = time.time()
    assert len(article.parse("<article>" + "<p>word</p>" * 100_000)[0]) == 100_000
    article.parse("<a " * 100_000)
    article.parse("<p>" + "x <" * 200_000 + "</p>")
    assert time.time() - began < 10


def test_article_text_counts_what_it_leaves_out(spark):
    ps = [LONG, "short", "Subscribe to our newsletter for more of this, every single week.", "Only $99 a year for everything that we have written so far here.", *[LONG] * 38, LONG + "beyond"]
    page = "<article>" + "".join(f"<p>{p}</p>" for p in ps) + "</article>"
    x = spark.createDataFrame([(page,), (None,)], "html string").select(article.article(F.col("html")).alias("x")).select(article.article_text(F.col("x")).alias("t")).select("t.*").collect()
    assert x[0].raw_paragraph_count == 40 and x[0].cleaned_paragraph_count == 37 and x[0].removed_paragraphs_count == 3 and x[0].cta_hits_count == 2 and x[0].extract_method == "article_ps"
    assert x[0].text == "\n\n".join([LONG.strip()] * 37) and x[0].raw_text_len == len(x[0].text) + len(ps[2]) + len(ps[3]) + 4
    assert tuple(x[1]) == ("", 0, 0, 0, 0, 0, "all_ps")


class Counting:
    """A client that writes down each request; addresses say what it answers."""

    def __init__(self, folder, script=None):
        self.folder, self.script = folder, script or {}

    def get(self, url):
        fd, _ = tempfile.mkstemp(dir=self.folder)
        os.write(fd, json.dumps([url, time.time(), os.getpid()]).encode())
        os.close(fd)
        if "404" in url or "403" in url:
            raise fulltext.FetchError(int(url[-3:]))
        if "slow" in url:
            raise TimeoutError("timed out")
        if "odd" in url:
            raise ValueError("odd thing")
        if "js" in url:
            return fulltext.Page("<p>Please enable JavaScript</p>", url)
        if "thin" in url:
            return fulltext.Page("<p>little</p>", url)
        if "news.google.com" in url:
            return fulltext.Page('<a href="https://news.google.com/x">g</a><a href="https://pub.org/link">p</a>', url)
        return fulltext.Page("<article>" + f"<p>{LONG}{url}</p>" * 8 + "</article>", url + "#end")


def requests(folder):
    return sorted(json.loads(open(os.path.join(folder, f)).read()) for f in os.listdir(folder))


def items(spark, urls):
    return spark.createDataFrame([(i, u, f"body {i}", "clash") for i, u in enumerate(urls)], "ord long, url string, body string, full_text string")


def test_each_address_is_fetched_once(spark, tmp_path):
    folder = str(tmp_path)
    coded = "https://news.google.com/rss/articles/" + base64.urlsafe_b64encode(b"\x08\x13\x22https://pub.org/coded/story\x00").decode().rstrip("=")
    urls = ["https://a.org/1", " https://a.org/1 ", "https://a.org/1", "https://b.org/404", "https://b.org/slow", "https://b.org/odd", "https://c.org/js", "https://c.org/thin", None, "", "ftp://x", coded, "https://news.google.com/x/1", "https://pub.org/link"]
    fetch = fulltext.calls(lambda: Counting(folder), spacing=0.0, tries=2, backoff=0.01)
    got = {r.ord: r for r in fulltext.hydrate(items(spark, urls), fetch).collect()}
    assert [got[i].fulltext_reason for i in range(len(urls))] == ["ok", "ok", "ok", "http_404", "timeout", "ValueError:odd thing", "js_only", "extract_too_short", "no_url", "no_url", "no_url", "ok", "ok", "ok"]
    assert [got[i].fulltext_status for i in (0, 3, 6, 7, 8)] == ["ok", "fail", "skip", "fail", "fail"]
    assert got[0].final_url == "https://a.org/1#end" and got[11].final_url == "https://pub.org/coded/story#end" and got[12].final_url == "https://pub.org/link#end"
    assert got[0].body.startswith("body 0\n\nA sentence") and got[3].body == "body 3" and got[0].fulltext_len == len(got[0].full_text) >= 300
    assert got[0].fidelity.raw_paragraph_count == 8 and got[0].fidelity.domain == "a.org" and got[3].fidelity is None
    asked = [r[0] for r in requests(folder)]
    first_round = {u.strip() for u in urls if u and u.strip().startswith("http")}
    assert asked.count("https://b.org/slow") == 2 and asked.count("https://pub.org/link") == 2  # an item's own, and where the aggregator led
    assert set(asked) == first_round | {"https://pub.org/coded/story"} and len(asked) == len(first_round) + 3


def test_known_addresses_are_not_fetched_again(spark, tmp_path):
    fetch = fulltext.calls(lambda f=str(tmp_path): Counting(f), spacing=0.0)
    known = fulltext.full_texts(items(spark, ["https://a.org/1"]), fetch).cache()
    known.count()
    n = len(requests(tmp_path))
    got = fulltext.hydrate(items(spark, ["https://a.org/1", "https://a.org/2"]), fetch, known=known).collect()
    assert all(r.fulltext_status == "ok" for r in got) and len(requests(tmp_path)) == n + 1


def test_hosts_are_spaced(spark, tmp_path):
    """Requests to one host lie in one task, apart in time, while another host is asked at the same time."""
    urls = [f"https://{h}.org/{i}" for h in "ab" for i in range(4)]
    fulltext.full_texts(items(spark, urls), fulltext.calls(lambda f=str(tmp_path): Counting(f), spacing=0.3)).collect()
    asked = requests(tmp_path)
    for h in "ab":
        at = sorted(t for u, t, _ in asked if f"//{h}." in u)
        assert len({p for u, _, p in asked if f"//{h}." in u}) == 1 and all(y - x > 0.28 for x, y in zip(at, at[1:], strict=False))
    lanes = fulltext.calls(lambda: Counting(""), lanes=4)(fulltext._wanted(items(spark, urls).select("url")))
    assert "_lane" in lanes._jdf.queryExecution().optimizedPlan().toString()


def test_meta_and_empty_tables(spark, tmp_path):
    fetch = fulltext.calls(lambda f=str(tmp_path): Counting(f), spacing=0.0)
    empty = fulltext.hydrate(items(spark, []).filter("ord < 0"), fetch)
    assert empty.collect() == [] and tuple(fulltext.hydration_meta(empty).first()) == (0, 0, 0, 0.0, 0, [])
    meta = fulltext.hydration_meta(fulltext.hydrate(items(spark, ["https://a.org/1", None, "", "https://a.org/404"]), fetch)).first()
    assert tuple(meta)[:4] == (4, 4, 1, 0.25) and [tuple(x) for x in meta.fail_reasons_top] == [("no_url", 2), ("http_404", 1)]


def test_enrich(spark, tmp_path):
    rows = [(0, "t", "https://a.org/1", "Comments URL: https://news.ycombinator.com/1", "s"), (1, "t", "https://a.org/2", "A text of its own that stays as it is.", "s"), (2, "same", "https://a.org/403", "same", "s"), (3, "t", "https://a.org/thin", "x", "hn"), (4, "t", "https://a.org/slow", None, "HackerNews")]
    df = spark.createDataFrame(rows, "ord long, title string, url string, body string, source_name string")
    got, attempts = fulltext.enrich(df, fulltext.calls(lambda f=str(tmp_path): Counting(f), spacing=0.0))
    bodies = {r.ord: r.body for r in got.collect()}
    assert bodies[0].startswith("A sentence") and bodies[1] == rows[1][3] and bodies[2] == "same" and bodies[3] == "x" and bodies[4] is None
    assert {r.url[14:]: (r.status, r.reason) for r in attempts.collect()} == {"1": ("ok", ""), "403": ("fail", "blocked"), "thin": ("fail", "extract_empty"), "slow": ("fail", "timeout")}


def test_pages_that_share_an_address(spark, tmp_path):
    """An archive gives one page for an address; the queries tell pages that share one apart, as their SQL does."""
    from granary.plans import queries

    text = ["<article>" + f"<p>{LONG * n}</p>" * 4 + "</article>" for n in (2, 3)]
    p = spark.createDataFrame([(1, "https://a.org/1", text[0]), (2, "https://a.org/1", text[1]), (3, "https://a.org/3", text[0])], "page_id long, url string, html string")
    got = fulltext.hydrate(items(spark, ["https://a.org/1", "https://a.org/3"]), fulltext.archived(p)).select("url", "fulltext_len").collect()
    assert len(got) == 2 and len({r.url for r in got}) == 2
    p.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    rows = queries.QUERIES["a33_hydration"](spark, str(tmp_path)).filter("visit < 2").collect()
    n = {(r.page_id, r.visit): r.fulltext_len for r in rows}
    assert len(rows) == 6 and n[1, 0] == n[1, 1] == n[3, 0] and n[2, 0] == n[2, 1] > n[1, 0]
    assert queries.QUERIES["f23_hydration_meta"](spark, str(tmp_path)).first().events_total == 12
