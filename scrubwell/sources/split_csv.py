"""Quoted CSV with line breaks inside values, read in blocks.

Spark splits a file into blocks of lines, but whether a line begins a record or goes
on inside a quoted value depends on all that comes before it.  So each block is read
twice.  First without knowing: a block reports, for both states in which it may begin,
in which state it ends, and what lies before its first and after its last record
start.  A table with a row for each block then settles the states, file by file, and
pieces of records that lie across blocks are put together.  Second, each block, now
knowing how it begins, parses the records that lie in it as a whole.

Texts are never shuffled but for the few pieces at the edges of blocks, and a file
takes as many tasks as it has blocks.  ``spark.sql.files.maxPartitionBytes`` says how
large a block is.

Defined results, as the one-task reader has them: an empty field is null, quoted or not;
quotes inside a quoted value are doubled; a line break outside quotes ends a record,
\\r\\n as well as \\n, and inside quotes is kept; empty lines are no records; missing
fields are null and surplus ones are left out; a value that isn't of its column's type
is null; a quote that is never closed reaches to the file's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scrubwell.sources.shared import shared_path

#: A table of up to so many blocks is broadcast: about 60 TB in blocks of 128 MB.
BROADCAST_BLOCKS = 500_000


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether the end of a line lies in a quoted value; ``inside``: whether its start does."""
    at, n = 0, len(line)
    if '"' not in line:
        return inside
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            inside = False
        elif at < n and line[at] == '"':
            inside, at = True, at + 1
            continue
        # the rest of an unquoted field, or of one whose quote is closed
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The blocks of a task, each with its lines in order."""

    def rows() -> Iterator[tuple[str, int, str]]:
        for batch in batches:
            yield from zip(batch.column("_path").to_pylist(), batch.column("_start").to_pylist(), batch.column("value").to_pylist(), strict=True)

    source = rows()
    head = next(source, None)
    while head is not None:
        block = head[:2]

        def lines(block=block) -> Iterator[str]:
            nonlocal head
            while head is not None and head[:2] == block:
                yield head[2]
                head = next(source, None)

        held = lines()
        yield block, held
        for _ in held:  # what the caller left unread
            pass


def _survey(sep: str):
    """For each block and both states: the state at its end, how many records start in it, and the lines before the first and from the last start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, start), lines in _blocks_of(batches):
            state, n = [False, True], [0, 0]
            lead: list[list[str]] = [[], []]
            tail: list[list[str] | None] = [None, None]
            for line in lines:
                for h in (0, 1):
                    if not state[h]:
                        tail[h] = [line]
                        n[h] += line not in ("", "\r")
                    elif tail[h] is None:
                        lead[h].append(line)
                    else:
                        tail[h].append(line)
                    state[h] = ends_inside(line, state[h], sep)
            # the last record is whole if it ends before the block does
            rows = [{"n": n[h], "open": state[h], "lead": "\n".join(lead[h]) if lead[h] else None, "tail": "\n".join(tail[h]) if tail[h] and state[h] else None} for h in (0, 1)]
            yield pa.RecordBatch.from_pylist([{"_path": path, "_start": start, "h0": rows[0], "h1": rows[1]}], schema)

    side = pa.struct([("n", pa.int64()), ("open", pa.bool_()), ("lead", pa.string()), ("tail", pa.string())])
    schema = pa.schema([("_path", pa.string()), ("_start", pa.int64()), ("h0", side), ("h1", side)])
    return run


_SIDE = "struct<n: bigint, open: boolean, lead: string, tail: string>"


def _fields(record: str, sep: str) -> list[str | None]:
    if '"' not in record:
        return [x or None for x in record.split(sep)]
    found, at = [], 0
    while True:
        out: list[str] = []
        quoted = record.startswith('"', at)
        at += quoted
        while quoted:
            end = record.find('"', at)
            out.append(record[at:] if end < 0 else record[at:end])
            if end >= 0 and record.startswith('""', end):
                out.append('"')
                at = end + 2
            else:
                at, quoted = (len(record) if end < 0 else end + 1), False
        end = record.find(sep, at)
        out.append(record[at:] if end < 0 else record[at:end])
        found.append("".join(out) or None)
        if end < 0:
            return found
        at = end + len(sep)


def _record(lines: list[str]) -> str:
    return "\n".join(lines).removesuffix("\r")


def _parse(sep: str, header: bool):
    """The fields of the records that begin and end in a block; ``_inside``: whether the block begins in a value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside_of: dict[tuple[str, int], bool] = {}

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for p, s, i in zip(batch.column("_path").to_pylist(), batch.column("_start").to_pylist(), batch.column("_inside").to_pylist(), strict=True):
                    inside_of[p, s] = i
                yield batch

        for (path, start), lines in _blocks_of(noted()):
            out: list[list[str | None]] = []
            held: list[str] = []
            inside = began_inside = inside_of[path, start]
            first = header and start == 0
            for line in lines:
                if not inside:
                    held = []
                    began_inside = False
                held.append(line)
                inside = ends_inside(line, inside, sep)
                if inside or began_inside:
                    # goes on, or is the end of a record that began in an earlier block
                    began_inside = began_inside and inside
                    continue
                record = _record(held)
                if record and not first:
                    out.append(_fields(record, sep))
                first = first and not record
                if len(out) == 1_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], ["f"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], ["f"])

    return run


def _parse_pieces(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = [r.removesuffix("\r") for r in batch.column("record").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_fields(r, sep) for r in records if r], pa.list_(pa.string()))], ["f"])

    return run


def settled(survey: DataFrame) -> DataFrame:
    """The surveyed blocks with _inside (whether they begin in a value), this side of their report, and _owner, the block in which what they begin with began.

    A block that ends alike whatever its beginning settles the state; between two of
    those, blocks that turn it are counted.
    """
    order = Window.partitionBy("_path").orderBy("_start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("h0.open") == F.col("h1.open")
    df = survey.withColumn("_turns", F.when(same, 0).otherwise(F.col("h0.open").cast("int")))
    df = df.withColumn("_sum", F.sum("_turns").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # the last block before that settles the state: what it says, and the turns up to it
    df = df.withColumn("_known", F.last(F.when(same, F.struct(F.col("h0.open").cast("int").alias("open"), F.col("_sum").alias("sum"))), ignorenulls=True).over(before))
    turns = F.coalesce(F.col("_sum") - F.col("_turns"), F.lit(0)) - F.coalesce(F.col("_known.sum"), F.lit(0))
    df = df.withColumn("_inside", (F.coalesce(F.col("_known.open"), F.lit(0)) + turns) % 2 == 1)
    df = df.withColumn("_side", F.when(F.col("_inside"), F.col("h1")).otherwise(F.col("h0")))
    return df.withColumn("_owner", F.last(F.when(F.col("_side.n") > 0, F.col("_start")), ignorenulls=True).over(before)).drop("h0", "h1", "_turns", "_sum", "_known")


def read(spark: SparkSession, path: str, schema: T.StructType, header: bool = True, sep: str = ",") -> DataFrame:
    """The table of the CSV files at ``path``."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"))
    blocks = shared_path(spark, "csv-blocks")
    settled(lines.mapInArrow(_survey(sep), f"_path string, _start long, h0 {_SIDE}, h1 {_SIDE}")).write.parquet(blocks)
    survey = spark.read.parquet(blocks)
    state = survey.select("_path", "_start", "_inside")
    if state.count() <= BROADCAST_BLOCKS:
        known = lines.join(F.broadcast(state), ["_path", "_start"])
    else:  # a block's lines stay together and in order
        known = lines.withColumn("_id", F.monotonically_increasing_id()).join(state, ["_path", "_start"]).repartition("_path", "_start").sortWithinPartitions("_path", "_start", "_id").drop("_id")
    whole = known.mapInArrow(_parse(sep, header), "f array<string>")

    # a record across blocks: its beginning in the block that owns it, then what the blocks after that begin with
    begun = survey.filter("_side.tail IS NOT NULL").select("_path", F.col("_start").alias("owner"), F.col("_start").alias("at"), F.col("_side.tail").alias("piece"))
    if header:  # not the header, where it is the only record of a file's first block
        begun = begun.join(survey.filter("_start = 0 AND _side.n = 1").select("_path", F.col("_start").alias("owner")), ["_path", "owner"], "left_anti")
    gone_on = survey.filter("_inside AND _side.lead IS NOT NULL").select("_path", F.col("_owner").alias("owner"), F.col("_start").alias("at"), F.col("_side.lead").alias("piece"))
    pieces = gone_on.join(begun.select("_path", "owner"), ["_path", "owner"], "left_semi").unionByName(begun)
    pieces = pieces.groupBy("_path", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    across = pieces.select(F.array_join(F.transform("p", lambda x: x["piece"]), "\n").alias("record")).mapInArrow(_parse_pieces(sep), "f array<string>")
    typed = [F.get("f", F.lit(k)).try_cast(field.dataType).alias(field.name) for k, field in enumerate(schema)]
    return whole.unionByName(across).select(*typed)
