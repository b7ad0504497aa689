"""Short narratives of cards: sentences of their fields, near-repeats out, an event and its impact first, with bullets and a line of proof."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from granary.functions import fixed as V
from granary.functions.links import first_date
from granary.functions.text import count, once, strip, text_of

# Fixed values
SENTENCE_SPLIT = r"(?<=[。！？；])|(?<=[.?!])\s+|\n+"
EVENT = (
    "(?i)release|launch|rais|acqui|updat|ship|benchmark|deploy|announc|partner|integrat|introduc|publish|open.sourc|fund|sign|complet|enabl|creat|generat|achieve|reach|"
    "發布|推出|融資|收購|更新|發表|上線|部署|宣布|合作|整合|開源|發行|上市|採用|達到|突破|實現|簽署|完成|建立|推進|提升|改善|優化"
)
IMPACT = (
    r"(?iU)\bcost\b|\bperf\b|market|risk|patent|copyright|competi|efficien|secur|regulat|policy|workforce|productiv|revenue|saving|benchmark|outperform|challeng|"
    "政策|版權|競爭|效能|成本|市場|風險|影響|優勢|挑戰|安全|監管|法規|生產力|收益|節省|超越|外洩|依賴|壓縮|加速|主導"
)
NEXT = r"(?iU)\bwill\b|\bplan\b|\bnext\b|rollout|roadmap|schedul|expect|target|aim|預計|下一步|計畫|規劃|接下來|未來|預期|即將|下月|下季|年底|正在|準備"
NEAR, BULLET_NEAR, NO_SOURCE = 0.86, 0.80, "未知來源"
STRINGS, SLICE = "array<string>", 128


def near_distinct(texts: list[str], least: float) -> list[str]:
    """The texts in order, without those that are as similar to one kept before as `least`: twice the characters in matching blocks against both lengths.

    Equal texts are as similar as can be. Lengths bound that ratio, and then the characters that two texts have in common, so
    most pairs are decided without blocks; what these need of a kept text is made when they are first looked for.
    """
    kept: list[tuple[str, Counter]] = []
    blocks: dict[int, SequenceMatcher] = {}
    seen: set[str] = set()

    def near(i: int, text: str, own: Counter) -> bool:
        other, counts = kept[i]
        both = len(text) + len(other)
        if both and (2.0 * min(len(text), len(other)) / both < least or 2.0 * sum(min(n, counts[c]) for c, n in own.items() if c in counts) / both < least):
            return False
        if i not in blocks:
            blocks[i] = SequenceMatcher(None, "", other)
        m = blocks[i]
        m.set_seq1(text)
        return m.ratio() >= least

    for text in texts:
        if text in seen and least <= 1:
            continue
        seen.add(text)
        own = Counter(text)
        if not any(near(i, text, own) for i in range(len(kept) - 1, -1, -1)):  # a repeat mostly follows what it repeats
            kept.append((text, own))
    return [text for text, _ in kept]


def near_dedup(texts: Column, least: float = NEAR) -> Column:
    """A struct of kept and ratio, the share of an array's texts that near_distinct() leaves out."""

    @pandas_udf(T.StructType([T.StructField("kept", T.ArrayType(T.StringType())), T.StructField("ratio", T.DoubleType())]))
    def run(texts: pd.Series) -> pd.DataFrame:
        kept = [near_distinct([x for x in t if x is not None], least) if t is not None else [] for t in texts]
        return pd.DataFrame({"kept": kept, "ratio": [round(1 - len(k) / len(t), 3) if t is not None and len(t) else 0.0 for k, t in zip(kept, texts, strict=True)]})

    return run(texts)


def _repeats_out(rows: DataFrame, least: float, bullet_least: float, enough: int = 2, most: int = 3) -> DataFrame:
    """rows with _kept and _ratio of _sentences, and _bullets: the first points of _points that do not repeat each other, and where fewer than `enough` are left those of _more on the same terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Some rows at a time, so that their texts as Python's do not grow with a batch.
        for b in (x.slice(i, SLICE) for x in batches for i in range(0, x.num_rows, SLICE)):
            sentences, points, more = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_sentences", "_points", "_more"))
            kept = [near_distinct(s, least) for s in sentences]
            ratio = [round(1 - len(k) / len(s), 3) if s else 0.0 for k, s in zip(kept, sentences, strict=True)]
            bullets = [near_distinct(p, bullet_least) for p in points]
            bullets = [(k if len(k) >= enough else near_distinct([*k, *m], bullet_least))[:most] for k, m in zip(bullets, more, strict=True)]
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kept, strings), pa.array(ratio, pa.float64()), pa.array(bullets, strings)], names=[*b.schema.names, "_kept", "_ratio", "_bullets"])

    text = T.ArrayType(T.StringType())
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_kept", text), T.StructField("_ratio", T.DoubleType()), T.StructField("_bullets", text)]))


def without_tag(c: Column) -> Column:
    return F.regexp_replace(strip(text_of(c)), V.TAG_PREFIX, "")


def for_reports(c: Column) -> Column:
    """A text without the tag at its beginning and without ellipses; a fixed sentence where it has what reports may not have."""
    clean = lambda t: F.replace(F.replace(t, F.lit("…"), F.lit("")), F.lit("..."), F.lit(""))
    banned = lambda t: F.exists(F.array(*map(F.lit, V.REPORT_BANNED)), lambda b: F.contains(t, b))
    return F.when(text_of(c) == "", text_of(c)).otherwise(once(clean(without_tag(c)), lambda t: F.when(banned(t), V.SAFE_SENTENCE).otherwise(t)))


def cleaned(c: Column) -> Column:
    """Without the tag at its beginning and without what reports may not have."""
    t = without_tag(c)
    for banned in V.REPORT_BANNED[:8]:
        t = F.replace(t, F.lit(banned), F.lit(""))
    return strip(t)


def split_sentences(c: Column, least: int = 4) -> Column:
    return F.filter(F.transform(F.split(text_of(c), SENTENCE_SPLIT), strip), lambda x: F.length(x) >= least)


def chosen(sentences: Column, most: int = 3) -> Column:
    """The first sentence of an event, the first other one of an impact, the first other one of what is next; up to two of any if these are fewer."""
    first = lambda s, pattern, used: F.try_element_at(F.filter(s, lambda x: x.rlike(pattern) & ~F.array_contains(used, x)), F.lit(1))

    def of(s: Column) -> Column:
        picked = F.array().cast(STRINGS)
        for pattern in (EVENT, IMPACT, NEXT):
            picked = once(picked, _adding(s, pattern, first))
        fill = lambda used: F.concat(used, F.slice(F.array_distinct(F.filter(s, lambda x: ~F.array_contains(used, x))), F.lit(1), F.greatest(F.lit(0), 2 - F.size(used))))
        return once(picked, lambda used: F.slice(fill(used), 1, most))

    return once(sentences, of)


def _adding(s: Column, pattern: str, first: Callable) -> Callable[[Column], Column]:
    return lambda used: F.array_compact(F.concat(used, F.array(first(s, pattern, used))))


def zh_count(c: Column) -> Column:
    return count(c, "[\\u4e00-\\u9fff]")


def terminated(c: Column) -> Column:
    t = strip(c)
    return F.when((t == "") | t.rlike("[。！？；.!?]$"), t).otherwise(F.concat(t, F.lit("。")))


def narratives(cards: DataFrame, near: float = NEAR) -> DataFrame:
    """cards with narrative, bullets, proof_line, dedup_ratio, sentences_used and zh_ratio.

    Reads what_happened, technical, why_important, title, evidence, confirmed, effects and actions (arrays), source_name and
    published_at. Sentences of the first three and of evidence are cleaned, near-repeats go, and two or three are chosen; a
    choice that has few CJK characters gives way to the beginnings of the card's own fields.
    """
    f = {k: strip(text_of(F.col(k))) for k in ("what_happened", "technical", "why_important", "title", "source_name")}
    arrays = {k: F.coalesce(F.col(k), F.array().cast(STRINGS)) for k in ("evidence", "confirmed", "effects", "actions")}
    listed = lambda k: F.filter(F.transform(F.slice(arrays[k], 1, 3), lambda x: strip(text_of(x))), lambda x: F.length(x) >= 8)
    fields = F.filter(F.array(f["what_happened"], f["technical"], f["why_important"]), lambda x: x != "")
    anchor = once(F.array_join(F.concat(fields, listed("evidence"), listed("confirmed")), " "), lambda a: F.when(F.length(a) < 20, strip(F.concat(f["title"], F.lit(" "), a))).otherwise(a))
    sentences = F.filter(F.transform(split_sentences(anchor), cleaned), lambda x: F.length(x) >= 8)
    points = F.concat(*arrays.values())
    points = F.transform(F.filter(F.transform(points, cleaned), lambda x: F.length(x) >= 12), for_reports)
    # Where fewer than two bullets are left, sentences of the fields follow.
    more = F.flatten(F.transform(F.array(f["why_important"], f["technical"], f["what_happened"]), lambda t: F.when(F.length(t) >= 12, F.filter(F.transform(F.slice(split_sentences(t), 1, 2), cleaned), lambda x: F.length(x) >= 12)).otherwise(F.array().cast(STRINGS))))
    rows = _repeats_out(cards.withColumns({"_sentences": sentences, "_points": points, "_more": more}), near, BULLET_NEAR)
    rows = rows.withColumn("_s", chosen(F.col("_kept"))).withColumn("_text", F.array_join("_s", " "))
    few_zh = (zh_count(F.col("_text")) < 12) & (F.when(F.length("_text") > 0, count(F.col("_text"), r"\p{ASCII}") / F.length("_text")).otherwise(0.0) > 0.60)
    ended = lambda t: once(F.substring(t, 1, 180), lambda s: F.when(s.rlike("[。！？；]$"), s).otherwise(F.concat(s, F.lit("。"))))
    event = F.coalesce(*[F.nullif(f[k], F.lit("")) for k in ("what_happened", "technical", "title")])
    own = F.array_join(F.array_compact(F.array(ended(event), F.when(f["why_important"] != "", ended(f["why_important"])))), "")
    own = F.when(own == "", F.array_join(F.slice("_s", 1, 2), "")).otherwise(own)
    rows = rows.withColumn("_few", few_zh).withColumn("_text", F.when(F.col("_few"), own).otherwise(F.col("_text")))
    used = F.when(F.col("_few") & (F.size(split_sentences(F.col("_text"))) > 0), F.size(split_sentences(F.col("_text")))).otherwise(F.size("_s"))
    rows = rows.withColumn("narrative", terminated(F.col("_text")))
    proof = F.concat(F.lit("證據：來源："), F.when(f["source_name"] == "", NO_SOURCE).otherwise(f["source_name"]), F.lit("（"), first_date(F.col("published_at").cast("string")), F.lit("）"))
    return rows.select(
        *cards.columns, "narrative", F.col("_bullets").alias("bullets"), proof.alias("proof_line"), F.col("_ratio").alias("dedup_ratio"), F.least(used, F.lit(3)).alias("sentences_used"),
        F.bround(zh_count(F.col("narrative")) / F.greatest(F.lit(1), F.length("narrative")), 3).alias("zh_ratio"),
    )


def narrative_meta(rows: DataFrame) -> DataFrame:
    """One row: how many narratives there are and the means of their dedup_ratio, zh_ratio and sentences_used."""
    mean = lambda c, d: F.coalesce(F.round(F.avg(c), d), F.lit(0.0)).alias(f"avg_{c}")
    return rows.agg(F.count("*").alias("applied_count"), mean("dedup_ratio", 3), mean("zh_ratio", 3), mean("sentences_used", 2))
