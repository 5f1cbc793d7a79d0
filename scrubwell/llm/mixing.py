"""Mixing sources to target weights by Pfair scheduling.

Rows of a source form blocks.  With weight w, block j (from 0) of a source is
released at slot floor(j / w) and due before slot ceil((j + 1) / w); each slot
goes to the released block with the earliest deadline.  So after any number of
slots a source is less than one block from its share.

Weights are the exact targets: as whole numbers of any size, never rounded to
slots.  When a source runs out, a new phase begins in which the others share its
weight, and counts from its first slot.  No row is dropped.

Scale: the driver simulates the blocks and holds a slot for each (8 bytes), so a
block is BLOCK rows, or one part in MAX_BLOCKS of all rows where that is more:
the law is the same at every size, in units of a block, and the plan never has
more than MAX_BLOCKS blocks and one for each source.  Rows are ranked within their
source in hash buckets, so a source with most of the rows is ranked by many tasks.

Defined results: null sources form one source, written null; sources without a
target get ``default``, or the mean target; repeated rows are placed one after
another; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubwell.llm.common import cut, salted_rank

BLOCK, MAX_BLOCKS = 16, 1 << 20


def phase(weights: dict, left: dict) -> tuple[dict[object, list[int]], int]:
    """The slots each source gets until one has had all of its ``left`` blocks, and their number; ``weights`` are whole."""
    total = sum(weights.values())
    names = sorted(weights, key=str)
    share = [weights[n] for n in names]
    done, ready, got = [0] * len(names), [], {n: [] for n in names}
    waiting = [(0, k) for k in range(len(names))]
    upto, t = [left[n] for n in names], 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[k] + 1) * total // share[k]), k))
        if not ready:
            raise AssertionError("a slot without a released block")
        _, k = heapq.heappop(ready)
        got[names[k]].append(t)
        t += 1
        done[k] += 1
        if done[k] == upto[k]:
            return got, t
        heapq.heappush(waiting, (done[k] * total // share[k], k))


def whole(weights: dict) -> dict[object, int]:
    """Whole numbers in exactly the proportions of ``weights``."""
    exact = {s: Fraction(int(w)) if w == int(w) else Fraction(float(w)) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * scale) for s, x in exact.items()}


def plan(blocks: dict, weights: dict) -> dict[object, np.ndarray]:
    """The slot of every block of each source."""
    left, at, parts = {s: n for s, n in blocks.items() if n > 0}, 0, {s: [] for s in blocks}
    exact = whole(weights)
    while left:
        got, length = phase({s: exact[s] for s in left}, left)
        for s, slots in got.items():
            parts[s].append(np.array(slots, np.int64) + at)
            left[s] -= len(slots)
        left = {s: n for s, n in left.items() if n > 0}
        at += length
    return {s: np.concatenate([np.zeros(0, np.int64), *x]) for s, x in parts.items()}


def schedule(docs: DataFrame, targets: dict | None = None, source: str = "source", block: int = BLOCK, carry: tuple[str, ...] = ("doc_id",), default: float | None = None) -> DataFrame:
    """``carry``, mix_source, block, slot and position (gapless from 0, the order of the mix) of every row.

    ``targets``: weight by source; without it, the square root of the source's rows.
    """
    df = docs.select(*[F.col(c) for c in carry], F.col(source).cast("string").alias("mix_source"), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("_s"))
    df = cut(df)
    counts = {r["_s"]: r["n"] for r in df.groupBy("_s").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a source
    if targets is None:
        weights = {s: n**0.5 for s, n in counts.items()}
    else:
        other = sum(targets.values()) / max(1, len(targets)) if default is None else default
        weights = {s: targets.get(s[1:] if s else None, other) for s in counts}
    if unfit := [s for s, w in weights.items() if not w > 0]:
        raise ValueError(f"target weights must be positive: {unfit}")
    block = max(block, -(-sum(counts.values()) // MAX_BLOCKS))
    slots = plan({s: -(-n // block) for s, n in counts.items()}, weights)
    # what a short last block leaves out moves later rows up
    short = {s: (-(-n // block), -n % block) for s, n in counts.items()}

    gaps = sorted((int(slots[s][n - 1]), g) for s, (n, g) in short.items())
    gap_slots, gap_rows = np.array([x for x, _ in gaps], np.int64), np.concatenate([[0], np.cumsum([g for _, g in gaps], dtype=np.int64)]) if gaps else np.zeros(1, np.int64)

    own = [*carry, "mix_source"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, inside = np.divmod(b.column("_rank").to_numpy().astype(np.int64), block)
            slot = np.zeros(b.num_rows, np.int64)
            found = b.column("_s").dictionary_encode()
            for k, s in enumerate(found.dictionary.to_pylist()):
                rows = found.indices.to_numpy() == k
                slot[rows] = slots[s][number[rows]]
            position = slot * block + inside - gap_rows[np.searchsorted(gap_slots, slot, side="left")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(number), pa.array(slot), pa.array(position)], [*own, "block", "slot", "position"])

    ranked = salted_rank(df.withColumn("_h", F.xxhash64(*carry)), ["_s"], ["_h", *carry], "_rank")
    ranked = ranked.select(*own, "_s", "_rank")
    schema = ", ".join(f"`{n}` {t}" for n, t in ranked.dtypes if n not in ("_s", "_rank"))
    return ranked.mapInArrow(place, f"{schema}, block long, slot long, position long")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` in the order of the mix, with their own columns.

    Rows are placed by (doc_id, source, hash of the row); rows equal in all three are placed alike.
    """
    mark = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), mark.alias("_mark"), F.col(how.get("source", "source")).alias("_src"))
    keys = rows.select("_id", "_mark", "_src")
    placed = schedule(keys, carry=("_id", "_mark"), **{**how, "source": "_src"})
    placed = placed.groupBy("_id", "_mark").agg(F.min("position").alias("_position"))
    joined = rows.join(placed, rows["_id"].eqNullSafe(placed["_id"]) & (rows["_mark"] == placed["_mark"]))
    return joined.select("_row", "_position").orderBy("_position").select("_row.*")
