"""Identifiers, URLs and dates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import fixed as V
from granary.functions.text import strip, text_of


def url_hash(url: Column) -> Column:
    return F.substring(F.sha2(strip(text_of(url)).cast("binary"), 256), 1, 16)


def item_id(title: Column, url: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", strip(text_of(title)), strip(text_of(url))).cast("binary"), 256), 1, 16)


def _part(url: Column, pattern: str) -> Column:
    return F.regexp_extract(url, pattern, 1)


def host(url: Column) -> Column:
    return F.lower(_part(strip(text_of(url)), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"))


def domain(url: Column, exact: bool = False) -> Column:
    """The host without a leading `www.`; if exact is asked for, without any leading w and dots, as older data has it."""
    return F.regexp_replace(host(url), "^[w.]+" if exact else r"^www\.", "")


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host; without tracking and blank parameters, fragment and trailing slashes. Repeated names come together at the first one's place."""
    u = strip(text_of(url))
    scheme = F.lower(_part(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://"))
    path = F.regexp_replace(_part(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"), "/+$", "")
    query = _part(u, r"^[^?#]*\?([^#]*)")
    pair = lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.try_url_decode(F.regexp_replace(p, "^[^=]*=?", "")).alias("v"))
    low = lambda p: F.lower(p["k"])
    pairs = F.filter(F.transform(F.split(query, "&"), pair), lambda p: (p["v"] != "") & ~low(p).isin(*V.TRACKING) & ~low(p).startswith("utm_"))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    regrouped = F.flatten(F.transform(names, lambda n: F.filter(pairs, lambda p: p["k"] == n)))
    text = F.array_join(F.transform(regrouped, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    return F.concat(scheme, F.lit("://"), host(u), F.when(path == "", "/").otherwise(path), F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))


def release_feed_url(owner: Column, repo: Column, kind: Column) -> Column:
    """The Atom feed of a hosted project: releases, commits or discussions; empty for other kinds."""
    tail = F.when(kind == "releases", "releases.atom").when(kind == "commits", "commits/main.atom").when(kind == "discussions", "discussions.atom")
    return F.coalesce(F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo, F.lit("/"), tail), F.lit(""))


def news_search_url(query: Column, hl: str = "en-US", gl: str = "US", ceid: str = "US:en") -> Column:
    return F.concat(F.lit("https://news.google.com/rss/search?q="), F.url_encode(query), F.lit(f"&hl={hl}&gl={gl}&ceid={ceid}"))


def publisher_url(url: Column) -> Column:
    """The publisher's address in the base64 path segment of an aggregator's article link; null if there is none."""
    token = F.translate(_part(text_of(url), r"/articles/([A-Za-z0-9_-]+)"), "-_", "+/")
    padded = F.rpad(token, (F.ceil(F.length(token) / 4) * 4).cast("int"), F.lit("="))
    raw = F.decode(F.try_to_binary(padded, F.lit("base64")), "ISO-8859-1")
    return F.nullif(F.regexp_extract(raw, r"(https?://[\x21-\x7e]+)", 1), F.lit(""))


def url_entity(url: Column) -> Column:
    """The second-level name of the host, capitalised; null if it is short or generic."""
    parts = F.split(F.regexp_replace(host(url), r"^www\.", ""), r"\.")
    name = F.try_element_at(parts, F.lit(-2))
    return F.when((F.length(name) > 3) & ~name.isin(*V.GENERIC_HOSTS), F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name))))


def parse_date(raw: Column) -> Column:
    """ISO dates (with or without a zone) and mail dates as timestamps; null for anything else. The weekday is left out as the parser has no letter for it."""
    t = strip(text_of(raw))
    iso = F.substring(t, 1, 25)
    mail = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3},\s*", ""), r"\b(?:GMT|UTC)$", "+0000")
    is_iso = iso.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:?\d{2})?$")
    return F.coalesce(F.when(is_iso, F.try_to_timestamp(iso)), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))


def age_hours(as_of: Column, *times: Column) -> Column:
    """Hours from the first time that is known to as_of."""
    return (F.unix_micros(as_of) - F.unix_micros(F.coalesce(*times))) / 3.6e9


def is_recent(age: Column, hours: float = 72, exact: bool = False) -> Column:
    """Whether an age is known and within some hours; if exact is asked for, an age of 0 counts as unknown, as older data has it."""
    known = age.isNotNull() & (age != 0) if exact else age.isNotNull()
    return F.coalesce(known & (age <= hours), F.lit(False))


def first_date(*texts: Column) -> Column:
    """The first ISO date in the texts; empty if there is none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text_of(t), r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")) for t in texts], F.lit(""))


def date_zh(date: Column) -> Column:
    ts = F.try_to_timestamp(text_of(date))
    return F.when(ts.isNull(), text_of(date)).otherwise(F.concat(F.year(ts).cast("string"), F.lit("年"), F.month(ts).cast("string"), F.lit("月"), F.dayofmonth(ts).cast("string"), F.lit("日")))


def json_from_answer(text: Column) -> Column:
    """The first JSON in a model's answer: the whole, a fenced block, or the first flat object."""
    t = text_of(text)
    return F.coalesce(F.try_parse_json(strip(t)), F.try_parse_json(F.nullif(F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))), F.try_parse_json(F.nullif(F.regexp_extract(t, r"(?s)(\{[^{}]*\})", 1), F.lit(""))))


def has_fields(json: Column, fields: list[str]) -> Column:
    """Whether a JSON object's text has all fields."""
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, fields)), F.json_object_keys(json))) == 0, F.lit(False))
