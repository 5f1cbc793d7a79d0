"""Lines that many documents share: two Bloom filters find suspects, only those are counted exactly.

Every task adds the distinct lines of each document to two bit arrays: the cells
that were hit once, and those hit twice or more.  Arrays of several tasks add up
cell by cell, block by block.  A line seen in two documents has all its cells in the
second array, so nothing is missed; a line that has not is dropped from the search
without any shuffle.  Digests (128 bits) of the suspected lines are counted, those of
enough documents are frequent, and a last pass takes them out of the texts.

The arrays have eight cells a line, at most ``MAX_BITS``: beyond about 2^25 lines more
lines are suspected and counted, with the same result.  Frequent digests are
broadcast up to ``BROADCAST_ROWS``; more are joined with the suspects of each distinct
text, in salted shuffles.

Defined results: a null or empty text is one empty line; a row is a document, so
repeated rows count as often as they are repeated; lines are told apart by their
keys (white space stripped at both ends, A-Z lower-cased); a key shorter than
``min_chars`` code points is never dropped; with ``keep="first"`` the first such line
of the least id stays (null ids last; all rows with that id keep it); an empty table
gives an empty result; other columns are carried along, but for those named as the
result's own (kept_text, n_lines, n_dropped), which these replace.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubwell.llm.common import scratch_path

WHITE = b" \t\n\x0b\x0c\r"
PROBES = 3
MAX_BITS = 1 << 28
#: Bits of a block of the arrays.
BLOCK = 1 << 19
BROADCAST_ROWS = 1_000_000
SALTS = 16
#: Texts that are in memory as lines at a time.
SLICE = 512
_NO_ID = (1 << 63) - 1


def lines_of(text: bytes | None) -> tuple[list[bytes], list[bytes]]:
    """The lines and their keys."""
    lines = (text or b"").split(b"\n")
    return lines, [x.strip(WHITE).lower() for x in lines]


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or sum(b & 0xC0 != 0x80 for b in key) >= min_chars)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for at in range(0, batch.num_rows, SLICE):
        rows = batch.slice(at, SLICE)
        yield rows, rows.column("_text").cast(pa.binary()).to_pylist()


def _digests(texts: list[bytes | None], min_chars: int) -> list[list[bytes]]:
    """Digests of the distinct keys of each text."""
    return [[_digest(k) for k in set(lines_of(t)[1]) if k and _long_enough(k, min_chars)] for t in texts]


def _cells(digests: np.ndarray, bits: int) -> np.ndarray:
    """The cells of each digest (n x 2 words), PROBES of them in a row."""
    step = digests[:, 1:] | np.uint64(1)
    return ((digests[:, :1] + step * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def suspects_filter(docs: DataFrame, min_chars: int, bits: int) -> bytes:
    """The array of cells hit twice or more, of ``bits`` bits, which bounds what comes to the driver."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for _, texts in _texts(batch):
                found = b"".join(d for of in _digests(texts, min_chars) for d in of)
                cells, n = np.unique(_cells(np.frombuffer(found, "<u8").reshape(-1, 2), bits), return_counts=True)
                at, bit = cells >> 3, (1 << (cells & 7)).astype(np.uint8)
                again = (n > 1) | (once[at] & bit != 0)
                np.bitwise_or.at(twice, at[again], bit[again])
                np.bitwise_or.at(once, at, bit)
        size = min(BLOCK, bits) // 8
        for k in range(0, bits // 8, size):
            if once[k : k + size].any():
                yield pa.RecordBatch.from_pylist([{"block": k // size, "once": once[k : k + size].tobytes(), "twice": twice[k : k + size].tobytes()}])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for x in batch.to_pylist():
                o, t = np.frombuffer(x["once"], np.uint8), np.frombuffer(x["twice"], np.uint8)
                o1, t1 = blocks.get(x["block"], (np.zeros_like(o), np.zeros_like(t)))
                blocks[x["block"]] = (o1 | o, t1 | t | (o1 & o))
        for k, (_, t) in blocks.items():
            yield pa.RecordBatch.from_pylist([{"block": k, "twice": t.tobytes()}])

    # one pair of arrays a core, not one a file split
    tasks = docs.coalesce(docs.sparkSession.sparkContext.defaultParallelism)
    parts = tasks.mapInArrow(fill, "block long, once binary, twice binary").repartition("block").mapInArrow(add_up, "block long, twice binary")
    found, size = bytearray(bits // 8), min(BLOCK, bits) // 8
    for r in parts.toLocalIterator():
        found[r["block"] * size : (r["block"] + 1) * size] = r["twice"]
    return bytes(found)


def _suspected(digests: list[list[bytes]], twice: np.ndarray, bits: int) -> list[list[bytes]]:
    flat = [d for of in digests for d in of]
    cells = _cells(np.frombuffer(b"".join(flat), "<u8").reshape(-1, 2), bits)
    hit = iter((twice[cells >> 3] & (1 << (cells & 7)).astype(np.uint8) != 0).all(axis=1).tolist())
    return [[d for d in of if next(hit)] for of in digests]


def frequent(docs: DataFrame, min_docs: int, min_chars: int, twice: bytes, key: str) -> DataFrame:
    """digest and first (the least id) of every key that at least ``min_docs`` documents have, counted exactly."""
    shared, bits = docs.sparkSession.sparkContext.broadcast(twice), len(twice) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for rows, texts in _texts(batch):
                found: dict[bytes, list[int]] = {}
                for of, i in zip(_suspected(_digests(texts, min_chars), array, bits), rows.column("_id").to_pylist(), strict=True):
                    for d in of:
                        x = found.setdefault(d, [0, _NO_ID])
                        x[0], x[1] = x[0] + 1, min(x[1], _NO_ID if i is None else i)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([x[0] for x in found.values()], pa.int64()), pa.array([x[1] for x in found.values()], pa.int64())], ["digest", "n", "first"])

    counted = docs.select("_text", F.col(key).cast("long").alias("_id")).mapInArrow(run, "digest binary, n long, first long")
    return counted.groupBy("digest").agg(F.sum("n").alias("n"), F.min("first").alias("first")).filter(F.col("n") >= min_docs).select("digest", "first")


def _by_text(docs: DataFrame, common: DataFrame, min_chars: int, twice: bytes) -> DataFrame:
    """``docs`` with _drop: digest and first of the frequent keys of each text.  For more frequent keys than can be broadcast."""
    shared, bits = docs.sparkSession.sparkContext.broadcast(twice), len(twice) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for rows, texts in _texts(batch):
                found = _suspected(_digests(texts, min_chars), array, bits)
                names = [n for n, of in zip(rows.column("_key").to_pylist(), found, strict=True) for _ in of]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([d for of in found for d in of], pa.binary())], ["_key", "digest"])

    docs = docs.withColumn("_key", F.sha2(F.col("_text").cast("binary"), 256))
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    pairs = docs.select("_key", "_text").mapInArrow(run, "_key string, digest binary").distinct().withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int"))
    drops = pairs.join(common.select("*", salt), ["digest", "_salt"]).groupBy("_key").agg(F.collect_list(F.struct("digest", "first")).alias("_drop"))
    dealt = docs.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(drops.select("*", salt), ["_key", "_salt"], "left").drop("_key", "_salt")


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", key: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with kept_text, n_lines (before) and n_dropped; lines that ``min_docs`` documents share are dropped.

    ``keep``: "none" drops them in every document, "first" leaves the first occurrence.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be none or first, not {keep}")
    spark = docs.sparkSession
    texts = docs.select(key, F.col(text).alias("_text"))
    n = texts.agg(F.sum(F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = min(max_bits, max(1 << 16, 1 << max(0, 8 * n - 1).bit_length()))
    twice = suspects_filter(texts.select("_text"), min_chars, bits)
    path = scratch_path(spark, "frequent-lines")
    frequent(texts, min_docs, min_chars, twice, key).write.parquet(path)
    common = spark.read.parquet(path)
    rows = docs.withColumn("_text", F.col(text)).withColumn("_id", F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)))
    if common.count() <= broadcast_rows:
        found = common.toArrow()  # broadcast_rows at most
        names = np.array(found.column("digest").to_pylist(), "S16")
        order = np.argsort(names)
        held = spark.sparkContext.broadcast((names[order], found.column("first").to_numpy()[order]))
    else:
        held, rows = None, _by_text(rows, common, min_chars, twice)

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    extra = ["kept_text", "n_lines", "n_dropped"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, given in _texts(batch):
                ids = part.column("_id").to_pylist()
                drops = [None] * len(given) if held else part.column("_drop").to_pylist()
                out: list[tuple[bytes, int, int]] = []
                for t, i, drop in zip(given, ids, drops, strict=True):
                    lines, keys = lines_of(t)
                    distinct = [k for k in set(keys) if k]
                    digests = [_digest(k) for k in distinct]
                    if held:
                        names, firsts = held.value
                        at = np.searchsorted(names, np.array(digests, "S16")) if digests and len(names) else np.zeros(len(digests), int)
                        at = np.minimum(at, max(0, len(names) - 1))
                        hit = names[at] == np.array(digests, "S16") if digests and len(names) else np.zeros(len(digests), bool)
                        common_keys = {k: int(firsts[x]) for k, x, y in zip(distinct, at.tolist(), hit.tolist(), strict=True) if y}
                    else:
                        of = {x["digest"]: x["first"] for x in drop or []}
                        common_keys = {k: of[d] for k, d in zip(distinct, digests, strict=True) if d in of}
                    left = []
                    for line, k in zip(lines, keys, strict=True):
                        if k in common_keys and not (keep == "first" and common_keys[k] == i):
                            continue
                        if k in common_keys:
                            common_keys[k] = None  # its first occurrence stays
                        left.append(line)
                    out.append((b"\n".join(left), len(lines), len(lines) - len(left)))
                columns = [part.column(f) for f in names_kept]
                columns += [pa.array([x[0] for x in out], pa.binary()).cast(pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*names_kept, *extra])

    names_kept = [c for c in docs.columns if c not in extra]
    kept_schema = ", ".join([*[s for s, c in zip(schema, docs.columns, strict=True) if c in names_kept], "kept_text string, n_lines long, n_dropped long"])
    return rows.select(*names_kept, "_text", "_id", *([] if held else ["_drop"])).mapInArrow(run, kept_schema)
