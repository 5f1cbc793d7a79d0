"""URL filter: ratio of two character language models.

Two variable-order Markov models, one of accepted and one of rejected URLs, give
each character a probability from up to ``order`` characters before it,
interpolated with shorter contexts (Witten-Bell).  A URL is judged by the
difference of its log likelihoods per character, through a logistic calibration
fitted on URLs that neither model counted.  Explicit rules on host and path come
first, and are what the models learn from: URLs that a rule allows are accepted
ones, URLs that a rule blocks are rejected ones.

The models read the distinct lines (host without user and port, and path, digits
as one sign) of all URLs that a rule judges, without a cap.  One line in five, by
hash, is held out for the calibration, in which both kinds weigh the same, and
for the model's error rates.

Scale: counting aggregates on the executors.  Every sequence counts.  Up to ``HELD``
sequences (24 bytes each) are a model in memory, which the driver and the executors
get; more stay in a table in the shared folder, and the distinct lines' characters
meet it by joins, with the same result.

Defined results: a null URL, or one without ``://``, has empty host and path and
is allowed unless a rule fits; without lines of both kinds nothing is rejected but
by rule; repeated rows are judged alike; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubwell.llm.common import cut

ORDER = 5
#: Sequences that a model in memory holds at most; and orders whose sequences are few whatever the input.
HELD, FEW_ORDERS = 1 << 21, 2
#: What a character can be: start, end, another, a digit, letters and signs.
LETTERS = "abcdefghijklmnopqrstuvwxyz.-/_%"
SYMBOLS = 4 + len(LETTERS)
#: Calibration reads differences in steps of 1 / STEPS, cut at BOUND on both sides.
STEPS, BOUND = 100, 10


def _symbols() -> bytes:
    """Symbol of each byte: 0 starts and 1 ends a line, 2 is any other character, 3 a digit."""
    table = bytearray([2] * 256)
    for k, c in enumerate(LETTERS):
        table[ord(c)] = 4 + k
    for c in "0123456789":
        table[ord(c)] = 3
    return bytes(table)


_TABLE = _symbols()


def sequences(lines: list[str], order: int) -> list[np.ndarray]:
    """For 0 to ``order``: the code of each character of the lines, ends included, with that many characters before it."""
    parts = [bytes(order) + x.encode("ascii", "replace").translate(_TABLE) + b"\x01" for x in lines]
    s = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    real = np.ones(len(s), bool)
    at = 0
    for x in parts:
        real[at : at + order] = False
        at += len(x)
    out, code = [], np.zeros(len(s), np.int64)
    for k in range(order + 1):
        code = code + np.concatenate([np.zeros(k, np.int64), s[: len(s) - k]]) * SYMBOLS**k
        out.append(code[real])
    return out


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 500) -> tuple[float, float]:
    """Slope and shift of a one-variable logistic regression with a small ridge; both kinds weigh 100 in sum."""
    w = np.zeros(len(x))
    for kind in (0, 1):
        w[y == kind] = 100 * weight[y == kind] / max(1, weight[y == kind].sum())
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([1e-3 * a + (w * (p - y) * x).sum(), 1e-3 * b + (w * (p - y)).sum()])
        v = w * p * (1 - p)
        h = np.array([[1e-3 + (v * x * x).sum(), (v * x).sum()], [(v * x).sum(), 1e-3 + v.sum()]])
        step = np.linalg.solve(h, g)
        size = max(1.0, float(np.abs(step).max()))
        a, b = a - step[0] / size, b - step[1] / size
        if np.abs(step).sum() < 1e-9:
            break
    return float(a), float(b)


@dataclass
class Ratio:
    """Counts of both models by order (codes in order, counts of accepted and rejected lines), and the calibration.

    ``errors``: for accepted (0) and rejected (1) held-out lines, how many there
    are and how many of them the model judges wrongly.
    """

    order: int
    tables: list[tuple[np.ndarray, np.ndarray]]
    slope: float = 1.0
    shift: float = 0.0
    errors: dict[int, tuple[int, int]] = field(default_factory=dict)
    #: k, code, n0, n1 of all sequences, where they are too many for ``tables``.
    stored: DataFrame | None = None

    def __post_init__(self):
        self.contexts = []
        for codes, counts in self.tables:
            found, at = np.unique(codes // SYMBOLS if len(codes) else codes, return_inverse=True)
            n, kinds = np.zeros((2, len(found))), np.zeros((2, len(found)))
            for k in (0, 1):
                np.add.at(n[k], at, counts[k])
                np.add.at(kinds[k], at, counts[k] > 0)
            self.contexts.append((found, n, kinds))
        if self.stored is not None:
            n = self.stored.filter("k = 0").agg(F.sum("n0"), F.sum("n1")).first()
            self.known = bool(n[0] and n[1])
            return
        self.known = bool(self.tables) and all(len(self.tables[0][0]) and self.tables[0][1][k].sum() > 0 for k in (0, 1))

    def probabilities(self, codes: list[np.ndarray]) -> np.ndarray:
        """Two rows: probability of each character in the accepted and the rejected model."""
        p = np.full((2, len(codes[0])), 1 / SYMBOLS)
        for (keys, counts), (found, n, kinds), code in zip(self.tables, self.contexts, codes, strict=True):
            if not len(keys):
                continue
            i = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
            j = np.minimum(np.searchsorted(found, code // SYMBOLS), len(found) - 1)
            c = np.where(keys[i] == code, counts[:, i], 0)
            here = found[j] == code // SYMBOLS
            total, types = np.where(here, n[:, j], 0), np.where(here, kinds[:, j], 0)
            p = np.where(total > 0, (c + types * p) / np.maximum(total + types, 1), p)
        return p

    def differences(self, lines: list[str]) -> np.ndarray:
        """Mean over the characters of each line: log likelihood as a rejected one less that as an accepted one."""
        if not lines:
            return np.zeros(0)
        p = np.log(self.probabilities(sequences(lines, self.order)))
        lengths = np.array([len(x.encode("ascii", "replace")) + 1 for x in lines])
        return np.add.reduceat(p[1] - p[0], np.concatenate([[0], np.cumsum(lengths)[:-1]])) / lengths

    def rejects(self, lines: list[str]) -> np.ndarray:
        """Probability that each line is to be rejected."""
        if not self.known:
            return np.zeros(len(lines))
        p = 1 / (1 + np.exp(-np.clip(self.slope * self.differences(lines) + self.shift, -30, 30)))
        return np.where([bool(x) for x in lines], p, 0.0)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty for null or without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (host and path in one, like ``example.net/en/``) that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, rule).otherwise(out)
    return out


def line_of(host: Column, path: Column) -> Column:
    """What the models read: the host without user and port, and the path in lower case, every number as one digit."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(:[0-9]*)?$", "")
    return F.regexp_replace(F.lower(F.concat(bare, path)), "[0-9]+", "0")


def labelled_lines(pages: DataFrame, rules: dict[str, str], url: str = "url") -> DataFrame:
    """line, kind (0 allowed, 1 blocked by rule) and held (out) of every distinct line of a URL that a rule judges."""
    df = pages.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule = rule_for(F.col("host"), F.col("path"), rules)
    verdict = F.lit(None).cast("int")
    for r, v in rules.items():
        verdict = F.when(F.col("rule") == r, int(v == "block")).otherwise(verdict)
    df = df.withColumn("rule", rule).filter("rule is not null").select(line_of(F.col("host"), F.col("path")).alias("line"), verdict.alias("kind"))
    return df.filter("line <> ''").distinct().withColumn("held", F.pmod(F.xxhash64("line"), F.lit(5)) == 4)


def counted(lines: DataFrame, order: int) -> DataFrame:
    """k, code, n0 and n1 for k from 0 to ``order``: the codes of ``lines`` (line, kind), and their counts in accepted and in rejected ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for kind, part in b.groupby("kind"):
                for k, codes in enumerate(sequences(part["line"].tolist(), order)):
                    code, n = np.unique(codes, return_counts=True)
                    yield pd.DataFrame({"k": np.int32(k), "code": code, "n0": n * (kind == 0), "n1": n * (kind == 1)})

    each = lines.select("line", "kind").mapInPandas(run, "k int, code long, n0 long, n1 long")
    return cut(each.groupBy("k", "code").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def in_memory(found: DataFrame, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, the codes of ``found`` (:func:`counted`, at most HELD rows) in order, and their counts."""
    rows = found.toArrow()
    k, code, n0, n1 = (rows.column(c).to_numpy() for c in ("k", "code", "n0", "n1"))
    out = []
    for x in range(order + 1):
        own = np.flatnonzero(k == x)
        own = own[np.argsort(code[own])]
        out.append((code[own], np.stack([n0[own], n1[own]])))
    return out


def joined_differences(lines: DataFrame, model: Ratio) -> DataFrame:
    """line and x, as :meth:`Ratio.differences`, of distinct non-empty ``lines`` (line), by joins with the stored sequences."""
    order = model.order

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                told = b["line"].tolist()[at : at + 500]
                n = [len(x.encode("ascii", "replace")) + 1 for x in told]
                line, pos = np.repeat(np.array(told, object), n), np.concatenate([np.arange(x) for x in n])
                for k, code in enumerate(sequences(told, order)):
                    yield pd.DataFrame({"line": line, "pos": pos, "k": np.int32(k), "code": code})

    context = F.expr(f"code div {SYMBOLS}")
    each = lines.select("line").mapInPandas(run, "line string, pos long, k int, code long").withColumn("context", context)
    stored = model.stored.withColumn("context", context)
    kinds = lambda n: F.sum((F.col(n) > 0).cast("long"))
    totals = stored.groupBy("k", "context").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), kinds("n0").alias("y0"), kinds("n1").alias("y1"))
    counts = stored.select("k", "code", "n0", "n1")
    few = F.col("k") <= FEW_ORDERS  # at most SYMBOLS ** (FEW_ORDERS + 1) rows an order, of which each has very many characters
    low = each.filter(few).join(F.broadcast(counts.filter(few)), ["k", "code"], "left").join(F.broadcast(totals.filter(few)), ["k", "context"], "left")
    high = each.filter(~few).join(counts.filter(~few), ["k", "code"], "left").join(totals.filter(~few), ["k", "context"], "left")
    names = ["k", "n0", "n1", "t0", "t1", "y0", "y1"]
    by = low.unionByName(high).groupBy("line", "pos").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("_o"))

    def p(side: int) -> Column:
        n, t, y = f"n{side}", f"t{side}", f"y{side}"
        step = lambda acc, x: F.when(x[t] > 0, (F.coalesce(x[n], F.lit(0)) + x[y] * acc) / (x[t] + x[y])).otherwise(acc)
        return F.aggregate("_o", F.lit(1.0 / SYMBOLS), step)

    return by.select("line", (F.log(p(1)) - F.log(p(0))).alias("_x")).groupBy("line").agg(F.avg("_x").alias("x"))


def train(pages: DataFrame, rules: dict[str, str], url: str = "url", order: int = ORDER) -> Ratio:
    """The models over all URLs of ``pages`` that ``rules`` judge, calibrated on the held-out ones."""
    lines = cut(labelled_lines(pages, rules, url))
    found = counted(lines.filter("not held"), order)
    model = Ratio(order, in_memory(found, order)) if found.count() <= HELD else Ratio(order, [], stored=found)
    if not model.known:
        return model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = model.differences(b["line"].tolist())
            yield pd.DataFrame({"kind": b["kind"], "step": np.clip(np.rint(x * STEPS), -BOUND * STEPS, BOUND * STEPS).astype(np.int32)})

    held = lines.filter("held").select("line", "kind")
    if model.stored is None:
        steps = held.mapInPandas(run, "kind int, step int")
    else:
        most = F.lit(float(BOUND * STEPS))
        steps = held.join(joined_differences(held.select("line").distinct(), model), "line").select("kind", F.greatest(-most, F.least(most, F.rint(F.col("x") * STEPS))).cast("int").alias("step"))
    bins = steps.groupBy("kind", "step").count().orderBy("kind", "step").collect()  # bounded by STEPS and BOUND
    y, x, n = (np.array([r[c] for r in bins], np.float64) for c in ("kind", "step", "count"))
    if {0.0, 1.0} <= set(y):
        model.slope, model.shift = calibrated(x / STEPS, y, n)
    wrong = (model.slope * x / STEPS + model.shift > 0) != (y == 1)
    model.errors = {kind: (int(n[y == kind].sum()), int(n[(y == kind) & wrong].sum())) for kind in (0, 1)}
    return model


def judge(pages: DataFrame, rules: dict[str, str], model: Ratio, key: str = "page_id", url: str = "url", threshold: float = 0.5) -> DataFrame:
    """``key``, host, path, rule, verdict and p_reject of every row."""
    df = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    df = df.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("_line", line_of(F.col("host"), F.col("path")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column("_line").dictionary_encode()
            p = model.rejects(found.dictionary.to_pylist())[found.indices.to_numpy()]
            told = [rules.get(r) for r in b.column("rule").to_pylist()]
            verdict = [t or ("block" if x > threshold else "allow") for t, x in zip(told, p, strict=True)]
            own = [b.column(c) for c in (key, "host", "path", "rule")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(verdict, pa.string()), pa.array(p, pa.float64())], [key, "host", "path", "rule", "verdict", "p_reject"])

    if model.stored is not None and model.known:
        z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), model.slope * F.col("x") + model.shift))
        found = joined_differences(df.select(F.col("_line").alias("line")).filter("line <> ''").distinct(), model).select(F.col("line").alias("_line"), (1 / (1 + F.exp(-z))).alias("p_reject"))
        told = F.lit(None).cast("string")
        for r, v in rules.items():
            told = F.when(F.col("rule") == r, v).otherwise(told)
        p = F.coalesce("p_reject", F.lit(0.0))
        verdict = F.coalesce(told, F.when(p > threshold, "block").otherwise("allow"))
        return df.join(found, "_line", "left").select(key, "host", "path", "rule", verdict.alias("verdict"), p.alias("p_reject"))

    kind = dict(df.dtypes)[key]
    return df.mapInArrow(run, f"{key} {kind}, host string, path string, rule string, verdict string, p_reject double")
