"""Best-fit packing into bins of several permitted lengths.

A bin costs something for its being one, its length, and the square of its length
over ``ATTENTION`` (a sequence's attention grows so), so a long bin must earn its
length.  Pieces of equal length are alike, so the packing is planned on the
histogram of lengths (at most the largest capacity has rows, whatever the corpus):
lengths go in decreasing order, each into the open bins with the least room that
fits; where none fits, bins of the permitted length with the least cost for each
token are opened, the room left counted as far as shorter pieces can fill it; at
the end each bin shrinks to the shortest permitted length that holds its contents.
The permitted lengths are chosen jointly: a plan is made for every subset of them
that new bins may have, and the one with the least total cost is taken.
Equal bins are planned as one group, so the plan's size follows the number of
lengths, not of rows.  Rows then find their bin by their rank within their length.

Texts longer than the largest capacity are cut into pieces of that capacity and
a rest; no token is dropped.

Defined results: null and empty texts have no token and get no piece; repeated
rows are packed separately; ties go by doc_id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubwell.llm.common import SPACE, cut, ordinals, salted_rank

CAPACITIES = (512, 1024, 2048)
#: Cost of a bin: something for its being one, its length, and its length's square over ATTENTION.
BIN_COST, ATTENTION = 16.0, 4096.0


def cost(capacity: int, bin_cost: float = BIN_COST, attention: float = ATTENTION) -> float:
    return bin_cost + capacity + capacity**2 / attention


def n_tokens(text: Column) -> Column:
    """Tokens as words and marks: runs of white space, and what lies between them."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")).cast("long")


Plan = tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]


def pack(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, bin_cost: float = BIN_COST, attention: float = ATTENTION) -> Plan:
    """The cheapest of the plans (:func:`plan`) whose new bins have a subset of the permitted lengths."""
    price = {c: cost(c, bin_cost, attention) for c in sorted(capacities)}
    longest = max(histogram, default=0)
    if not 0 <= longest <= max(price) or min(histogram, default=1) < 1:
        raise ValueError("a piece fits no bin")
    subsets = [x for n in range(1, len(price) + 1) for x in itertools.combinations(price, n) if x[-1] >= longest]
    plans = [plan(histogram, x, price) for x in subsets]
    return min(plans, key=lambda x: sum(bins * price[c] for _, bins, c in x[1]))


def plan(histogram: dict[int, int], caps: tuple[int, ...], price: dict[int, float]) -> Plan:
    """The plan for ``histogram`` (length -> pieces) with new bins of the lengths ``caps``, shrunk to any length in ``price``.

    Returns moves (length, first rank, pieces for each bin, first bin, offset) and
    groups (first bin, bins, capacity).  A move sends piece ``first rank + i`` to
    bin ``first bin + i // k`` at ``offset + (i % k) * length``.
    """
    room: dict[int, list[tuple[int, int, int]]] = {}  # room left -> groups (first bin, bins, capacity)
    moves, next_bin = [], 0
    rest = sum(length * n for length, n in histogram.items())
    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        rest -= length * n
        while n:
            fit = min((r for r in room if r >= length), default=None)
            if fit is None:
                fit, group = _open(length, n, rest, caps, price, next_bin)
                next_bin += group[1]
            else:
                group = room[fit].pop()
                if not room[fit]:
                    del room[fit]
            first, bins, cap = group
            k = fit // length  # a bin is the tightest until nothing more fits
            full = min(bins, n // k)
            if full:
                moves.append((length, rank, k, first, cap - fit))
                room.setdefault(fit - k * length, []).append((first, full, cap))
                rank, n = rank + full * k, n - full * k
            if n and full < bins:
                moves.append((length, rank, n, first + full, cap - fit))
                room.setdefault(fit - n * length, []).append((first + full, 1, cap))
                rank, n, full = rank + n, 0, full + 1
            if full < bins:
                room.setdefault(fit, []).append((first + full, bins - full, cap))
    groups = [(first, bins, min(c for c in price if c >= cap - r)) for r, gs in room.items() for first, bins, cap in gs]
    return moves, sorted(groups)


def _open(length: int, n: int, rest: int, caps: tuple[int, ...], price: dict[int, float], next_bin: int) -> tuple[int, tuple[int, int, int]]:
    """New bins of the capacity with the least cost for each token that they will hold."""

    def for_a_token(c: int) -> float:
        k = min(c // length, n)
        bins = max(1, n // k)
        return price[c] / (k * length + min(c - k * length, rest / bins))

    cap = min((c for c in caps if c >= length), key=lambda c: (for_a_token(c), c))
    return cap, (next_bin, -(-n // (cap // length)), cap)


def pieces(docs: DataFrame, tokens: Column, top: int, order: str | None = None) -> DataFrame:
    """doc_id, piece (from 0) and length, and as position the column ``order`` (if named): each text cut into pieces of ``top`` tokens and a rest."""
    own = [F.col(f"`{order}`").alias("position")] if order else []
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens.alias("_n"), *own).filter("_n > 0")
    df = df.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / top))))
    return df.select("doc_id", "piece", F.least(F.lit(top).cast("long"), F.col("_n") - F.col("piece") * top).cast("int").alias("length"), *(["position"] if order else []))


def packed(docs: DataFrame, text: str = "text", capacities: tuple[int, ...] = CAPACITIES, bin_cost: float = BIN_COST, attention: float = ATTENTION, tokens: Column | None = None, order: str | None = None) -> DataFrame:
    """doc_id, piece, length, bin_id, capacity and offset (in its bin) of every piece.

    ``tokens``: a text's length; without it, its words.  ``order``: a column in
    whose order pieces of equal length take their places, so that the bins of a
    length follow it.
    """
    df = cut(pieces(docs, n_tokens(F.col(text)) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long"), max(capacities), order))
    histogram = {r["length"]: r["n"] for r in df.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # max(capacities) rows at most
    moves, groups = pack(histogram, capacities, bin_cost, attention)
    moves.sort(key=lambda m: (m[0], m[1]))
    m = np.array(moves, np.int64).reshape(-1, 5)
    g = np.array(groups, np.int64).reshape(-1, 3)
    starts = (m[:, 0] << 40) + m[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy().astype(np.int64) for c in ("length", "_rank"))
            move = m[np.searchsorted(starts, (length << 40) + rank, side="right") - 1]
            i = rank - move[:, 1]
            bin_id = move[:, 3] + i // move[:, 2]
            capacity = g[np.searchsorted(g[:, 0], bin_id, side="right") - 1, 2]
            offset = move[:, 4] + i % move[:, 2] * length
            own = [b.column(c) for c in ("doc_id", "piece", "length")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(bin_id), pa.array(capacity.astype(np.int32)), pa.array(offset.astype(np.int32))], ["doc_id", "piece", "length", "bin_id", "capacity", "offset"])

    if order:
        ranked = ordinals(df, "length", ["position", "doc_id", "piece"], "_rank")
    else:
        ranked = salted_rank(df, ["length"], ["doc_id", "piece"], "_rank")
    ranked = ranked.select("doc_id", "piece", "length", "_rank")
    return ranked.mapInArrow(place, "doc_id long, piece long, length int, bin_id long, capacity int, offset int")
