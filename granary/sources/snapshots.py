"""Snapshots and stores: JSON lines of collected records, and keyed Parquet tables with inserts, upserts and metadata."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.dedupe import first_of_each

COLLECTED = "id string, title string, url string, domain string, published_at string, summary string, content_text string, frontier_score int, source struct<platform: string, feed_name: string, feed_url: string, tag: string>, collected_at string"
ZH_PLATFORMS = ("36kr", "csdn", "bilibili", "xiaohongshu", "dcard", "ithome_tw")


def read_collected(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines; malformed lines are left out, a missing path gives no rows."""
    try:
        return spark.read.schema(COLLECTED).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], COLLECTED)


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """The number of lines that are no records."""
    lines = spark.read.text(path).filter("trim(value) != ''")
    rows = lines.select(F.from_json("value", COLLECTED + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})["_corrupt"].alias("_corrupt"))
    return rows.agg(F.count("_corrupt").alias("malformed"))


def to_items(z: DataFrame, zh: tuple[str, ...] = ZH_PLATFORMS) -> DataFrame:
    """Collected records as items: those without title or address go; the body is the content or else the summary."""
    clean = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return z.filter(clean(F.col("title")).isNotNull() & clean(F.col("url")).isNotNull()).select(
        F.col("id").alias("item_id"), F.trim("title").alias("title"), F.trim("url").alias("url"), F.coalesce(clean(F.col("content_text")), clean(F.col("summary")), F.lit("")).alias("body"),
        F.col("published_at"), F.coalesce(clean(F.col("source.feed_name")), clean(F.col("source.platform")), F.lit("unknown")).alias("source_name"), F.lit("tech").alias("source_category"),
        F.when(F.col("source.platform").isin(*zh), "zh").otherwise("en").alias("lang"), F.coalesce("frontier_score", F.lit(0)).alias("frontier_score"), F.col("source.platform").alias("platform"), "domain", "collected_at",
    )


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Store:
    """A keyed table in a folder, as a log of versions: version n is a file, named by its number, that lists the data folders it is made of.

    A write first puts its rows in a folder of their own and then names a new version by one rename, which fails where another
    writer was faster; it is then tried again on what that one left. A crash in between leaves a folder that no version names.
    Readers take the highest version, whole; the data of the last KEEP versions stay for those that still read them. Inserts
    add a folder; upserts add one, too, whose rows count in place of older ones of their keys. Every COMPACT folders are put
    together.
    """

    KEEP, COMPACT = 8, 32

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def _list(self, folder: str) -> list[str]:
        fs, p = _hadoop(self.spark, f"{self.path}/{folder}")
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._list("log") if n.endswith(".json") and not n.startswith((".", "_")))

    def _folders(self, version: int | None) -> list[str]:
        if version is None:
            return []
        return json.loads(self.spark.read.text(f"{self.path}/log/{version:012d}.json", wholetext=True).first()[0])["folders"]

    def read(self, version: int | None = None) -> DataFrame:
        """The latest version, or one of those kept."""
        known = self.versions()
        return self._read(self._folders(version if version is not None else known[-1] if known else None))

    def _read(self, folders: list[str]) -> DataFrame:
        empty = self.spark.createDataFrame([], self.schema)
        if not folders:
            return empty
        own = self.spark.read.schema(T.StructType([*empty.schema.fields, T.StructField("_seq", T.IntegerType())])).parquet(*(f"{self.path}/{f}" for f in folders))
        if all(f.startswith("i-") for f in folders[1:]):  # only new keys were added
            return own.drop("_seq")
        last = own.groupBy(self.key).agg(F.max("_seq").alias("_seq"))
        return own.join(last, [self.key, "_seq"], "left_semi").select(empty.columns)

    def _commit(self, base: int, folders: list[str]) -> bool:
        fs, new = _hadoop(self.spark, f"{self.path}/log/.{uuid.uuid4().hex}")
        out = fs.create(new, False)
        out.write(bytearray(json.dumps({"folders": folders}).encode()))
        out.close()
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{base + 1:012d}.json")
        try:
            done = not fs.exists(target) and fs.rename(new, target)
        except Py4JJavaError:  # a file system that raises where the name is taken
            done = False
        if not done:
            fs.delete(new, False)
        return done

    def _write(self, make: Callable[[DataFrame], DataFrame], kind: str, tries: int = 20) -> int:
        """Adds the rows that make() gives for the table as it stands; returns how many."""
        for _ in range(tries):
            known = self.versions()
            base, old = (known[-1], self._folders(known[-1])) if known else (0, [])
            seq, name = len(old) and 1 + max(int(f.split("-")[1]) for f in old), uuid.uuid4().hex
            count = Observation()
            folder = f"{kind}-{seq}-{name}"
            make(self._read(old)).withColumn("_seq", F.lit(seq).cast("int")).observe(count, F.count("*").alias("n")).write.parquet(f"{self.path}/{folder}")
            folders = [*old, folder]
            if len(folders) > self.COMPACT:
                whole = f"i-{seq + 1}-{name}"
                self._read(folders).withColumn("_seq", F.lit(seq + 1).cast("int")).write.parquet(f"{self.path}/{whole}")
                folders = [whole]
            if self._commit(base, folders):
                self._clean()
                return count.get["n"]
        raise RuntimeError("other writers were always faster")

    def _clean(self) -> None:
        """Removes versions beyond the last KEEP, and folders that only they name."""
        known = self.versions()
        gone, stay = known[: -self.KEEP], known[-self.KEEP :]
        if not gone:
            return
        used = {f for v in stay for f in self._folders(v)}
        for f in {f for v in gone for f in self._folders(v)} - used:
            fs, p = _hadoop(self.spark, f"{self.path}/{f}")
            fs.delete(p, True)
        for v in gone:
            fs, p = _hadoop(self.spark, f"{self.path}/log/{v:012d}.json")
            fs.delete(p, False)

    def _one_each(self, rows: DataFrame, order: str | None) -> DataFrame:
        if order is None:
            return rows.dropDuplicates([self.key])
        return first_of_each(rows, self.key, order=(order,))

    def insert(self, rows: DataFrame, order: str | None = None) -> int:
        """Adds rows of new keys, the first of each by `order` (any one without it); returns how many."""
        columns = self.spark.createDataFrame([], self.schema).columns
        own = self._one_each(rows, order)
        return self._write(lambda now: own.join(now.select(self.key), self.key, "left_anti").select(columns), "i")

    def upsert(self, rows: DataFrame, order: str | None = None) -> None:
        """Replaces rows by key and adds new ones, the first of each by `order` (any one without it)."""
        columns = self.spark.createDataFrame([], self.schema).columns
        own = self._one_each(rows, order).select(columns)
        self._write(lambda now: own, "u")

    def lookup(self, keys: DataFrame) -> DataFrame:
        return self.read().join(keys.select(self.key), self.key, "left_semi")


def encoded(rows: DataFrame, *structs: str) -> DataFrame:
    """rows with structs as JSON texts."""
    return rows.withColumns({c: F.to_json(c) for c in structs})


def decoded(rows: DataFrame, **schemas: str) -> DataFrame:
    return rows.withColumns({c: F.from_json(c, s) for c, s in schemas.items()})


def write_snapshot(rows: DataFrame, path: str, meta: DataFrame | None = None) -> None:
    """JSON lines below path/latest and one metadata object below path/meta, each replaced."""
    rows.write.mode("overwrite").json(f"{path}/latest")
    if meta is not None:
        meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def markdown(rows: DataFrame, line: Column, title: str, most: int | None = None) -> DataFrame:
    """One document of the rows' lines, in order; of the first `most` ones, if a report is to have a length that people read. For a selection: the document is one value."""
    rows = rows.orderBy("ord").limit(most) if most is not None else rows
    return rows.select("ord", line.alias("_l")).agg(F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_l"))), lambda x: x["_l"]), "\n")).alias("text"))


def digest_line() -> Column:
    return F.format_string("- **%s** (%.2f) [%s](%s)", F.coalesce("title", F.lit("")), F.coalesce("final_score", F.lit(0.0)), F.coalesce("source_name", F.lit("")), F.coalesce("url", F.lit("")))


def webhook_payload() -> Column:
    """A card message as JSON; sending it is up to the caller."""
    return F.to_json(F.struct(F.lit("interactive").alias("msg_type"), F.struct(F.struct(F.struct("title").alias("title")).alias("header"), F.col("card_md").alias("text")).alias("card")))


def outline(rows: DataFrame, title: str, most: int | None = None) -> str:
    """A mind map as JSON: a topic for each category, below it the titles; of the first `most` rows, if given. For a selection, whose rows come to the driver."""
    topics: dict[str, list[str]] = {}
    rows = rows.select("ord", "category", "title").orderBy("ord")
    for r in (rows.limit(most) if most is not None else rows).toLocalIterator():
        topics.setdefault(r["category"], []).append(r["title"])
    return json.dumps({"title": title, "topics": [{"title": k, "topics": [{"title": t} for t in v]} for k, v in topics.items()]}, ensure_ascii=False)
