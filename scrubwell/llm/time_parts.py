"""Files by time whose spans adapt to how many rows fall into them.

Rows are counted by hour in Spark.  From those counts the driver descends the
calendar: years, then the months, days and hours of those nodes alone that hold more
than ``limit`` rows.  Siblings within the limit are put into runs, next fit in time
order; a run with rows, an hour over the limit, and the rows without a moment are the
leaves.  What the driver sees and broadcasts is bounded by the calendar and by how
many nodes can be over the limit, not by the rows.  A leaf's rows are numbered
(:func:`scrubwell.llm.common.ordinals`) and cut into parts of ``limit`` rows; each is
one file, written in order by one task.

:func:`rewrite` brings a folder to the layout of the given rows: files whose leaf, part
and rows (counts and 128-bit sums of row hashes) recur stay, others are written anew, and
whatever else lies there is deleted.  A rewrite that broke off is mended by the next one.

Defined results: null moments are one leaf, ``null``; equal moments, arrivals and ids
are in the order of the other columns; repeated rows are kept; no rows make no files;
columns may have any name: the folders' own are ``leaf`` and ``part``, with a line
under them where the table has such columns.
"""

from __future__ import annotations

import calendar
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubwell.llm.common import lean, ordinals, scratch_path, small_frame

NULL = "null"
#: Year, month, day and hour as one number, and what to divide it by for each level of the calendar.
_LEVELS = (1_000_000, 10_000, 100, 1)


def hour_of(moment: Column) -> Column:
    """A moment's year, month, day and hour as one number (2024030507)."""
    return ((F.year(moment) * 100 + F.month(moment)) * 100 + F.dayofmonth(moment)).cast("long") * 100 + F.hour(moment)


def _members(level: int, parent: int) -> list[int]:
    """The months of a year, the days of a month, the hours of a day."""
    if level == 1:
        return [parent * 100 + m for m in range(1, 13)]
    if level == 2:
        return [parent * 100 + d for d in range(1, calendar.monthrange(*divmod(parent, 100))[1] + 1)]
    return [parent * 100 + h for h in range(24)]


def _label(level: int, first: int, last: int) -> str:
    """``2024/03/05-07``: the parents, then the first and the last member."""
    text = str(first).zfill(4 + 2 * level)
    parents = [text[:4], *[text[4 + 2 * k : 6 + 2 * k] for k in range(level)]][:level]
    width = 4 if level == 0 else 2
    return "/".join([*parents, f"{text[-width:]}-{str(last).zfill(4 + 2 * level)[-width:]}"])


def runs(members: list[int], counts: dict[int, int], limit: int) -> tuple[list[list[int]], list[int]]:
    """The runs of consecutive siblings within the limit, next fit in order, and the members over it."""
    found: list[list[int]] = []
    over, held, open_run = [], 0, False
    for m in members:
        n = counts.get(m, 0)
        if n > limit:
            over.append(m)
            open_run = False
        elif open_run and held + n <= limit:
            found[-1].append(m)
            held += n
        else:
            found.append([m])
            held, open_run = n, True
    return found, over


def leaves(hours: DataFrame, limit: int) -> list[tuple[int, str]]:
    """(node, leaf) of every calendar node with rows that lies in a leaf; ``hours``: hour and n.

    Counts are collected a level at a time, for the members of nodes over the limit.
    """
    spark, split, out = hours.sparkSession, None, []
    for level, unit in enumerate(_LEVELS):
        at = hours.withColumn("node", F.expr(f"hour div {unit}"))
        if split is not None:
            at = at.withColumn("parent", F.expr("node div 100")).join(small_frame(spark, [(x,) for x in split], "parent bigint"), "parent")
        counts = {r["node"]: r["n"] for r in at.groupBy("node").agg(F.sum("n").alias("n")).collect()}
        families = [_members(level, p) for p in split] if split is not None else [list(range(min(counts), max(counts) + 1))] if counts else []
        split = []
        for members in families:
            found, over = runs(members, counts, limit)
            if level == 3:
                found, over = found + [[m] for m in over], []
            out += [(m, _label(level, run[0], run[-1])) for run in found for m in run if counts.get(m)]
            split += over
        if not split:
            break
    return out


def _leaf(df: DataFrame, nodes: list[tuple[int, str]]) -> DataFrame:
    """Adds _leaf: that of the year, the month, the day or the hour of _hour."""
    named = small_frame(df.sparkSession, nodes, "node bigint, name string")
    for k, unit in enumerate(_LEVELS):
        df = df.join(named.select(F.col("node").alias(f"_node{k}"), F.col("name").alias(f"_name{k}")), F.expr(f"_hour div {unit}") == F.col(f"_node{k}"), "left")
    found = F.coalesce(*[F.col(f"_name{k}") for k in range(4)])
    return df.withColumn("_leaf", F.when(F.col("_hour").isNull(), NULL).otherwise(found)).drop(*[f"_n{x}{k}" for k in range(4) for x in ("ode", "ame")])


def _sums(columns: list[str]) -> list[Column]:
    """The number of rows and sums of two hashes of them, in halves, so that the order doesn't matter and repeats count."""
    fields = [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    hashes = [F.xxhash64(F.lit(seed), *fields) for seed in (1, 2)]
    halves = [h for x in hashes for h in (x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32))]
    return [F.count(F.lit(1)).alias("_n"), *[F.sum(h).alias(f"_s{k}") for k, h in enumerate(halves)]]


_SUMS = ["_n", "_s0", "_s1", "_s2", "_s3"]


@dataclass(frozen=True)
class Folder:
    """A folder of files by leaf and part, its table's columns, and the paths that the last rewrite left in place."""

    path: str
    schema: str
    columns: tuple[str, ...]
    stayed: tuple[str, ...] = ()

    @property
    def named(self) -> tuple[str, str]:
        """The names of the two partition columns."""
        found = []
        for name in ("leaf", "part"):
            while name in self.columns:
                name += "_"
            found.append(name)
        return found[0], found[1]

    def read(self, spark: SparkSession) -> DataFrame:
        """Its rows with _leaf, _part, _path and _at, the place in the file."""
        leaf, part = self.named
        rows = spark.read.schema(f"{self.schema}, `{leaf}` string, `{part}` bigint").parquet(self.path)
        return rows.select(*[f"`{c}`" for c in self.columns], F.replace(F.col(leaf), F.lit("."), F.lit("/")).alias("_leaf"), F.col(part).alias("_part"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at"))


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


def rewrite(df: DataFrame, path: str, moment: Column, order: list[str], limit: int) -> Folder:
    """Brings the folder to the layout of ``df``: by ``moment``, then ``order``, ``limit`` rows a file."""
    spark, columns = df.sparkSession, df.columns
    folder = Folder(path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), tuple(columns))
    rows = df.withColumn("_moment", moment).withColumn("_hour", hour_of(F.col("_moment")))
    counted = scratch_path(spark, "hours")
    rows.groupBy(F.col("_hour").alias("hour")).agg(F.count(F.lit(1)).alias("n")).write.parquet(counted)
    nodes = leaves(spark.read.parquet(counted).filter("hour IS NOT NULL"), limit)
    rest = [c for c in columns if c not in order and not df.schema[c].dataType.simpleString().startswith("map")]
    numbered = ordinals(_leaf(rows, nodes), "_leaf", ["_moment", *order, *rest], "_at")
    wanted = numbered.withColumn("_part", F.expr(f"_at div {limit} + 1"))

    leaf, part = folder.named
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stayed: list[str] = []
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        there = folder.read(spark).groupBy("_path", "_leaf", "_part").agg(*_sums(columns))
        both = there.join(wanted.groupBy("_leaf", "_part").agg(*_sums(columns)).withColumn("_recurs", F.lit(True)), ["_leaf", "_part", *_SUMS], "left")
        # a row for each file, as many as there are parts of the limit
        with lean(spark):
            files = both.select("_path", "_leaf", "_part", "_recurs").collect()
        recur = {}
        for r in sorted(files, key=lambda r: r["_path"]):
            if r["_recurs"]:
                recur.setdefault((r["_leaf"], r["_part"]), r["_path"])
        stayed = sorted(recur.values())
        obsolete = sorted({r["_path"] for r in files} - set(stayed))
        if recur:
            wanted = wanted.join(small_frame(spark, list(recur), "_leaf string, _part bigint"), ["_leaf", "_part"], "left_anti")
    else:
        obsolete = []
    new = wanted.repartition("_leaf", "_part").select(*[f"`{c}`" for c in columns], F.replace(F.col("_leaf"), F.lit("/"), F.lit(".")).alias(leaf), F.col("_part").alias(part), "_at")
    with lean(spark):
        new.sortWithinPartitions(leaf, part, "_at").drop("_at").write.mode("append").partitionBy(leaf, part).parquet(path)
    _delete(spark, obsolete)
    return Folder(path, folder.schema, folder.columns, tuple(stayed))


def files(spark: SparkSession, folder: Folder, key: str, new: Column) -> DataFrame:
    """A row for each file of the folder: leaf, part, path, columns, n_rows, n_new (rows that are ``new``), ids_sha256 and rewritten.

    A file's keys are hashed in the order of its rows by one task, a batch at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hashed, n, fresh = None, None, 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"leaf": at[0], "part": at[1], "path": at[2], "n_rows": n, "n_new": fresh, "ids_sha256": hashed.hexdigest()}], schema)

        for batch in batches:
            names = [batch.column(c).to_pylist() for c in ("_leaf", "_part", "_path")]
            keys, news = batch.column("_key").to_pylist(), batch.column("_new").to_pylist()
            start = 0
            while start < len(keys):
                name = tuple(c[start] for c in names)
                end = start + 1
                while end < len(keys) and names[2][end] == name[2]:
                    end += 1
                if name != at:
                    if at is not None:
                        yield row()
                    at, hashed, n, fresh = name, hashlib.sha256(), 0, 0
                hashed.update((("," if n else "") + ",".join(keys[start:end])).encode())
                n, fresh = n + end - start, fresh + sum(news[start:end])
                start = end
        if at is not None:
            yield row()

    schema = pa.schema([("leaf", pa.string()), ("part", pa.int64()), ("path", pa.string()), ("n_rows", pa.int64()), ("n_new", pa.int64()), ("ids_sha256", pa.string())])
    rows = folder.read(spark).select("_leaf", "_part", "_path", "_at", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(NULL)).alias("_key"), F.coalesce(new, F.lit(True)).alias("_new"))
    found = rows.repartition("_path").sortWithinPartitions("_path", "_at").mapInArrow(run, "leaf string, part long, path string, n_rows long, n_new long, ids_sha256 string")
    if folder.stayed:
        stayed = small_frame(spark, [(p,) for p in folder.stayed], "path string").withColumn("_stayed", F.lit(True))
        found = found.join(stayed, "path", "left").withColumn("rewritten", F.col("_stayed").isNull())
    else:
        found = found.withColumn("rewritten", F.lit(True))
    uri = F.regexp_replace("path", "^file:/(?!/)", "file:///")  # as other readers want local files named
    return found.select("leaf", F.lit(",".join(folder.columns)).alias("columns"), "ids_sha256", uri.alias("path"), "part", "n_rows", "n_new", "rewritten")


def moved(ts: Column, click_id: Column) -> Column:
    """``ts``, for some ids moved back by up to 25 years or to the start of the week."""
    k = F.crc32(click_id.cast("string").cast("binary")) % 128
    ts = ts.cast("timestamp_ntz")
    day = ts.cast("date")
    monday = F.date_sub(day, F.weekday(day)).cast("timestamp_ntz")
    days = ((k + 6) * (k + 6) * (k + 6)).cast("int")
    return F.when(k < 16, ts - F.make_dt_interval(days=days)).when(k > 111, monday).otherwise(ts)


def relaid(clicks: DataFrame, path: str, before: str = "2024-05-01 00:00:00", parts: int = 500) -> DataFrame:
    """Writes the clicks that arrived before a time, rewrites the folder for all of them, and reports its files."""
    limit = 1 + clicks.count() // parts
    moment, early = moved(F.col("ts"), F.col("click_id")), F.col("arrived_at") < F.lit(before).cast("timestamp_ntz")
    order = ["arrived_at", "click_id"]
    rewrite(clicks.filter(early), path, moment, order, limit)
    folder = rewrite(clicks, path, moment, order, limit)
    return files(clicks.sparkSession, folder, "click_id", ~early)
