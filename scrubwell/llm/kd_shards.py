"""Sharding by a k-d tree over metadata, with leaves of nearly equal bytes.

A node that must become n shards is split along the dimension in which its rows
are widest, at the weighted median (the share of its left half of the shards)
of the bytes.  The median is found exactly by radix selection: a histogram of
bytes over 4,096 digits, then a finer one inside the digit that holds the
median, for all open nodes in the same pass.  The driver sees one row for each
node and pass, never rows of documents; the histograms have at most 4,096 rows
for each node.

Every dimension is a 24-bit code followed by 24 bits of a hash of the row, so a
value that a third of all rows share can still be split.

Defined results: null texts weigh ``OVERHEAD`` bytes; null metadata is a value
of its own; rows that are equal in all that the tree reads are numbered, and so
are spread like any others; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubwell.llm.common import copies, cut, salted_rank, small_frame

OVERHEAD = 16
BITS, DIGIT = 24, 12
DIMENSIONS = ["source", "lang", "length", "doc_id"]


def _codes(docs: DataFrame, text: str) -> DataFrame:
    """The compact table: doc_id, size, text_crc32 and one 48-bit key for each dimension."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, span = low or 0, max(1, (high or 0) - (low or 0) + 1)
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(body) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(F.encode(body, "utf-8")).alias("text_crc32"),
        *[F.coalesce(F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit((1 << BITS) - 1)) + 1, F.lit(0)).alias(f"c_{c}") if c in docs.columns else F.lit(0).cast("long").alias(f"c_{c}") for c in ("source", "lang")],
    )
    # equal rows are counted and written again with a number, which the tie-breaking hash reads
    df = copies(df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")), "_n", "_copy")
    tie = F.pmod(F.xxhash64("doc_id", "text_crc32", "_copy"), F.lit(1 << BITS))
    place = F.coalesce(F.floor((F.col("doc_id") - F.lit(low)).cast("double") / float(span) * float((1 << BITS) - 1)), F.lit(0)).cast("long")
    code = {"source": F.col("c_source"), "lang": F.col("c_lang"), "length": F.floor(F.log2("size") * (1 << 18)).cast("long"), "doc_id": place}
    return df.select("doc_id", "size", "text_crc32", *[(F.shiftleft(code[d], BITS) + tie).alias(f"k_{d}") for d in DIMENSIONS], F.lit(1).cast("long").alias("node"))


def _key(dim: Column) -> Column:
    """The key of the dimension whose number ``dim`` holds."""
    out = F.col(f"k_{DIMENSIONS[0]}")
    for k, d in enumerate(DIMENSIONS[1:], 1):
        out = F.when(dim == k, F.col(f"k_{d}")).otherwise(out)
    return out


def _medians(df: DataFrame, wanted: dict[int, tuple[int, float]], slack: float) -> dict[int, int]:
    """For each node (dimension, bytes wanted on the left): the key below which rows go left."""
    spark = df.sparkSession
    cuts: dict[int, int] = {}
    open_ = {n: (d, 0, 0.0, t) for n, (d, t) in wanted.items()}  # dimension, digits so far, bytes before them, target
    for shift in range(2 * BITS - DIGIT, -1, -DIGIT):
        ctl = small_frame(spark, [(n, d, p, t - b) for n, (d, p, b, t) in open_.items()], "node long, dim int, prefix long, want double")
        hist = (
            df.join(ctl, "node").withColumn("key", _key(F.col("dim")))
            .filter(F.shiftright("key", shift + DIGIT) == F.col("prefix"))
            .groupBy("node", "want", F.shiftright("key", shift).alias("digit")).agg(F.sum("size").alias("bytes"))
        )
        w = Window.partitionBy("node").orderBy("digit")
        hist = hist.withColumn("upto", F.sum("bytes").over(w)).filter((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("bytes") < F.col("want")))
        found = {r["node"]: r for r in hist.groupBy("node").agg(F.min_by(F.struct("digit", "upto", "bytes"), "digit").alias("x")).select("node", "x.*").collect()}
        for n, (d, _, b, t) in list(open_.items()):
            r = found.get(n)
            if r is None:  # nothing is wanted on the left
                cuts[n] = 0
                del open_[n]
                continue
            if r["bytes"] <= slack or shift == 0:
                over, under = r["upto"] - (t - b), (t - b) - (r["upto"] - r["bytes"])
                cuts[n] = (r["digit"] + (1 if over <= under else 0)) << shift
                del open_[n]
            else:
                open_[n] = (d, r["digit"], b + r["upto"] - r["bytes"], t)
        if not open_:
            break
    return cuts


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, text: str = "text", tolerance: float = 0.002) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 .. shards - 1) and slot (gapless from 0 in its shard) of every row.

    Give the number of ``shards``, or ``target_bytes`` and leaves split until they are that small.
    """
    df = cut(_codes(docs, text))
    spark = df.sparkSession
    total = df.agg(F.sum("size")).first()[0] or 0
    if shards is None:
        shards = max(1, -(-total // (target_bytes or 1 << 30)))
    leaves = {1: (0, shards)}  # node -> first shard, number of shards
    spread: dict[int, int] | None = None
    while wide := {n: x for n, x in leaves.items() if x[1] > 1}:
        if not total:
            break
        stats = df.groupBy("node").agg(F.sum("size").alias("size"), *[(F.shiftright(F.max(f"k_{d}"), BITS) - F.shiftright(F.min(f"k_{d}"), BITS)).alias(d) for d in DIMENSIONS]).collect()
        at = {r["node"]: r for r in stats}
        spread = spread or {d: max(1, at[1][d]) for d in DIMENSIONS}
        wanted = {}
        for n, (_, k) in wide.items():
            if n in at:
                dim = max(range(len(DIMENSIONS)), key=lambda i: (at[n][DIMENSIONS[i]] / spread[DIMENSIONS[i]], -i))
                wanted[n] = (dim, at[n]["size"] * (k // 2) / k)
        cuts = _medians(df, wanted, tolerance * total / shards)
        moves = small_frame(spark, [(n, wanted[n][0], cuts[n]) for n in cuts], "node long, dim int, below long")
        child = F.when(F.col("below").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(_key(F.col("dim")) < F.col("below"), 0).otherwise(1))
        df = df.join(moves, "node", "left").withColumn("node", child).drop("dim", "below")
        for n, (first, k) in wide.items():
            del leaves[n]
            if n in cuts:
                leaves[2 * n] = (first, k // 2)
                leaves[2 * n + 1] = (first + k // 2, k - k // 2)
        if len(leaves) >= 16:
            df = cut(df)
    numbers = small_frame(spark, [(n, first) for n, (first, _) in leaves.items()], "node long, shard int")
    out = cut(df.join(numbers, "node").select("doc_id", "size", "text_crc32", "shard"))
    return salted_rank(out, ["shard"], ["doc_id", "text_crc32"], "slot").select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
