"""Fill-in-the-middle transformation: texts cut into prefix, middle and suffix at boundaries of units.

A unit grammar is a list of pairs of neighbouring character classes. It becomes one zero-width expression, a lookbehind
and a lookahead for each pair, so that Spark's split keeps every character: the pieces of a text put together are the
text. Only an empty text is apart, which split turns into one empty piece; it has no units.

Where the cuts are, and which form a document takes, follows from sha256 of the seed and its id alone, so re-run tasks
and other partitions give the same. Everything is an expression of the JVM; nothing is shuffled.

Results in special cases: null and empty texts are empty, have no units and stay plain; texts that hold a sentinel stay
plain; a null doc_id counts as an empty id; rows that share an id have the same numbers, but cuts that follow their own
texts; columns of docs keep their values, also those of the names added here, which transformed() puts in a struct.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import prepare

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What ends before a boundary and what begins behind it, as regular expressions of fixed width.
UNITS: dict[str, list[tuple[str, str]]] = {
    "char": [(r".", r".")],
    "word": [(r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]")],
    "line": [(r"\n", r".")],
    "sentence": [(r"[.!?]", r"[\x20\x09-\x0D]"), (r"[。！？]", r"[^。！？]")],
    "class": [(r"\p{L}", r"\P{L}"), (r"\P{L}", r"\p{L}"), (r"\p{N}", r"\P{N}"), (r"\P{N}", r"\p{N}"), (r"\s", r"\S"), (r"\S", r"\s")],
}


def boundary(grammar: str | list[tuple[str, str]]) -> str:
    """The zero-width expression of a grammar: a name of UNITS, or pairs of classes."""
    pairs = UNITS[grammar] if isinstance(grammar, str) else grammar
    return "(?s)" + "|".join(f"(?<={a})(?={b})" for a, b in pairs)


def units(text: Column, grammar: str | list[tuple[str, str]] = "char") -> Column:
    """The units of a text, in order; an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar)))


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once, however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits, as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _cuts(text: Column, doc_id: Column, grammar, seed: int, percent: int, spm: int) -> Column:
    """A struct of n, form and, where the form is not plain, prefix, middle and suffix."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = lambda h: F.when((text == "") | marked | (_draw(h, 2) % 100 >= percent), "plain").when(_draw(h, 3) % 100 < spm, "spm").otherwise("psm")
    joined = lambda pieces, a, b: F.array_join(F.slice(pieces, (a + 1).cast("int"), (b - a).cast("int")), "")

    def parts(x: Column) -> Column:
        n, a, b = F.size(x["pieces"]).cast("long"), F.least(x["h1"], x["h2"]), F.greatest(x["h1"], x["h2"])
        cut = lambda c: F.when(x["form"] != "plain", c)
        return F.struct(n.alias("n"), x["form"].alias("form"), cut(joined(x["pieces"], F.lit(0), a)).alias("prefix"), cut(joined(x["pieces"], a, b)).alias("middle"), cut(joined(x["pieces"], b, n)).alias("suffix"))

    def places(x: Column) -> Column:
        n = F.size(x["pieces"]) + 1
        return F.struct(x["pieces"].alias("pieces"), (_draw(x["digest"], 0) % n).alias("h1"), (_draw(x["digest"], 1) % n).alias("h2"), form(x["digest"]).alias("form"))

    return _once(_once(F.struct(units(text, grammar).alias("pieces"), digest.alias("digest")), places), parts)


def output(text: Column, x: Column) -> Column:
    """The training text of a struct of _cuts."""
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    return F.when(x["form"] == "psm", F.concat(p, x["prefix"], s, x["suffix"], m, x["middle"])).when(x["form"] == "spm", F.concat(s, x["suffix"], p, x["prefix"], m, x["middle"])).otherwise(text)


def restored(out: Column, form: Column) -> Column:
    """The text that an output was made of: what lies between the sentinels, in the order of its form."""
    back = lambda order: _once(F.split(out, f"{PREFIX}|{SUFFIX}|{MIDDLE}"), lambda p: F.concat(*(F.get(p, F.lit(i)) for i in order)))
    return F.when(form == "psm", back((1, 3, 2))).when(form == "spm", back((2, 3, 1))).otherwise(out)


def transformed(docs: DataFrame, grammar: str | list[tuple[str, str]] = "char", seed: int = 1, percent: int = 90, spm: int = 20) -> DataFrame:
    """docs' columns as a struct `own`, and n, form, prefix, middle, suffix and output.

    percent: how many of a hundred documents are taken apart; spm: how many of a hundred of those begin with the suffix.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.coalesce(F.col("text"), F.lit("")).alias("_text"), F.col("doc_id").alias("_id"))
    rows = rows.select("own", "_text", _cuts(F.col("_text"), F.col("_id"), grammar, seed, percent, spm).alias("_x"))
    return rows.select("own", "_x.*", output(F.col("_text"), F.col("_x")).alias("output"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of each row."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    rows = transformed(docs)
    return rows.select(
        F.col("own.doc_id").alias("doc_id"), "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


#: The same over `documents`, for DuckDB.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::varchar, '')) AS h FROM documents),
g AS (SELECT doc_id, t, length(t) AS n, [('0x' || substr(h, 8 * k + 1, 8))::bigint for k in [0, 1, 2, 3]] AS x FROM d),
c AS (
    SELECT doc_id, t, n, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR x[3] % 100 >= 90 THEN 'plain' WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM g
),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1, n - b) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
