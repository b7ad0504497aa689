"""Articles of web pages: paragraphs and addresses by a tag state machine, then the text and what was left out, as columns."""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from granary.functions import fixed as V
from granary.functions.links import host
from granary.functions.text import has_any, lowered, once, squeeze, text_of

SCHEMA = T.StructType([
    T.StructField("paragraphs", T.ArrayType(T.StringType())), T.StructField("in_article", T.BooleanType()), T.StructField("refresh", T.StringType()), T.StructField("canonical", T.StringType()), T.StructField("links", T.ArrayType(T.StringType())),
])
_tag = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^"'<>])*+)>""", re.S)
_attribute = re.compile(r"""([a-zA-Z][\w:-]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_raw = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
_refresh = re.compile(r"url\s*=\s*['\"]?([^'\";\s>]+)", re.I)
REGIONS, FURNITURE = ("article", "main"), ("script", "style", "nav", "footer", "header", "aside", "form")


def parse(html: str | None) -> tuple[list[str], bool, str | None, str | None, list[str]]:
    """(paragraphs, whether they are those of an article or main element, meta refresh, canonical address, https links) of a page.

    A paragraph is a p, or an li outside of one, that is closed and stands outside of furniture; a p that opens within
    another begins anew. Tags inside are blanks. One pass; depths of regions and furniture are the state.
    """
    inside: list[str] = []
    outside: list[str] = []
    links: list[str] = []
    refresh = canonical = open_ = None
    region = furniture = at = 0
    words: list[str] = []
    html = html or ""
    while True:
        m = _tag.search(html, at)
        if open_ and not furniture:
            words.append(html[at : m.start() if m else len(html)])
        if not m:
            break
        at, name = m.end(), (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            if name in REGIONS:
                region = max(0, region - 1)
            elif name in FURNITURE:
                furniture = max(0, furniture - 1)
            elif name == open_:
                text = entities.unescape(" ".join(words)).strip()
                if text:
                    (inside if region else outside).append(text)
                open_, words = None, []
            continue
        if name in REGIONS:
            region += 1
        elif name in FURNITURE:
            furniture += 1
            if name in _raw:  # up to its end there are no tags
                end = _raw[name].search(html, at)
                at, furniture = (end.end() if end else len(html)), furniture - 1
        elif name == "p" and not furniture or name == "li" and not furniture and open_ != "p":
            open_, words = name, []
        elif name in ("meta", "link", "a"):
            own = {k.lower(): entities.unescape(v.strip("\"'")) for k, v in _attribute.findall(m["rest"])}
            if name == "a" and own.get("href", "").startswith("https://"):
                links.append(own["href"])
            elif name == "link" and "canonical" in own.get("rel", "").lower():
                canonical = own.get("href", "")
            elif name == "meta" and own.get("http-equiv", "").lower() == "refresh":
                found = _refresh.search(own.get("content", ""))
                refresh = found[1].strip() if found else refresh
    return inside or outside, bool(inside), refresh, canonical, links


@pandas_udf(SCHEMA)
def article(html: pd.Series) -> pd.DataFrame:
    """parse() of a column of pages, as a struct."""
    return pd.DataFrame([parse(h) for h in html], columns=["paragraphs", "in_article", "refresh", "canonical", "links"])


def article_text(x: Column, most: int | None = V.ARTICLE_PARAGRAPHS, least: int = V.ARTICLE_LEAST, limit: int | None = V.CLEAN_LIMIT) -> Column:
    """A struct of text and counts from a struct of article(): the first paragraphs, short ones left out, those that advertise or quote prices left out and counted.

    raw_paragraph_count, cleaned_paragraph_count and removed_paragraphs_count are of the first `most` paragraphs, raw_text_len is
    the length before advertising goes, extract_method is article_ps or all_ps.
    """
    first = F.slice(x["paragraphs"], 1, most) if most else x["paragraphs"]
    advert = lambda p: lowered(p, lambda t, low: has_any(low, V.ARTICLE_FURNITURE) | t.rlike(V.PRICE))
    kept = F.filter(F.transform(first, squeeze), lambda p: F.length(p) >= least)
    judged = F.transform(kept, lambda p: F.struct(p.alias("p"), advert(p).alias("advert")))

    def parts(f: Column) -> Column:
        clean = F.transform(F.filter(f["own"], lambda p: ~p["advert"]), lambda p: p["p"])
        return F.struct(f["n"].alias("n"), F.size(f["own"]).alias("long"), F.size(clean).alias("clean"), F.array_join(clean, "\n\n").alias("text"), F.length(F.array_join(F.transform(f["own"], lambda p: p["p"]), "\n\n")).alias("raw"))

    def result(r: Column) -> Column:
        return F.struct(
            (F.substring(r["text"], 1, limit) if limit else r["text"]).alias("text"), r["n"].alias("raw_paragraph_count"), r["clean"].alias("cleaned_paragraph_count"), (r["n"] - r["clean"]).alias("removed_paragraphs_count"),
            (r["long"] - r["clean"]).alias("cta_hits_count"), r["raw"].alias("raw_text_len"), F.when(x["in_article"], "article_ps").otherwise("all_ps").alias("extract_method"),
        )

    return once(once(F.struct(F.size(first).alias("n"), judged.alias("own")), parts), result)


def is_aggregator(url: Column) -> Column:
    return F.regexp_replace(host(url), "^[w.]+", "").isin(*V.AGGREGATORS)


def elsewhere(x: Column) -> Column:
    """Where a page of an aggregator leads: its refresh, its canonical address or its first link, whichever first names another host; null if none."""
    other = lambda u: (host(text_of(u)) != "") & ~host(text_of(u)).isin(*V.AGGREGATOR_HOSTS)
    return F.coalesce(F.when(other(x["refresh"]), x["refresh"]), F.when(other(x["canonical"]), x["canonical"]), F.try_element_at(F.filter(x["links"], other), F.lit(1)))


def needs_script(html: Column) -> Column:
    """A page that says in its beginning that it needs scripts."""
    return has_any(F.lower(F.substring(text_of(html), 1, 4000)), V.SCRIPT_SIGNS)
