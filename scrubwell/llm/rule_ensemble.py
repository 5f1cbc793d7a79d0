"""Quality classifier: a sparse ensemble of conjunctive rules.

Boosted shallow trees over text statistics give candidate rules (every path from
the root to a node); a lasso-penalised logistic regression keeps few of them;
the kept rules become one Column expression, so scoring runs inside the JVM.

The model is fitted on the driver on at most ``max_rows`` labelled rows, chosen
by a hash of doc_id, so every driver and retry chooses the same rows.

Defined results: null and empty texts are scored from all-zero statistics;
repeated rows are scored alike; labels that disagree count as their maximum;
without labels of both kinds the score is the smoothed share of good labels.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubwell.llm.common import held
from scrubwell.llm.textstats import RATIOS, with_base_stats, with_ratios

MAX_ROWS = 20_000

Rule = tuple[tuple[int, bool, float], ...]  # (feature, above, cut), all must hold


@dataclass
class RuleModel:
    bias: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self, features: list[str] = RATIOS) -> Column:
        """Probability of label 1, over the feature columns."""
        z = F.lit(float(self.bias))
        for rule, w in self.rules:
            holds = F.lit(True)
            for k, above, at in rule:
                c = F.col(features[k])
                holds = holds & ((c > at) if above else (c <= at))
            z = z + F.when(holds, float(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _grow(codes: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: int) -> tuple[np.ndarray, list[Rule]]:
    """One regression tree on gradients: its step for each row, and the path to every node."""
    step, paths = np.zeros(len(g)), []
    todo: list[tuple[np.ndarray, Rule]] = [(np.arange(len(g)), ())]
    while todo:
        rows, path = todo.pop()
        if path:
            paths.append(path)
        best = (1e-6, -1, -1)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        if len(path) < depth and len(rows) >= 2 * least:
            for k, e in enumerate(edges):
                c = codes[rows, k]
                left_g = np.cumsum(np.bincount(c, g[rows], len(e) + 1))[:-1]
                left_h = np.cumsum(np.bincount(c, h[rows], len(e) + 1))[:-1]
                n = np.cumsum(np.bincount(c, minlength=len(e) + 1))[:-1]
                gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                gain[(n < least) | (len(rows) - n < least)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), k, int(gain.argmax()))
        if best[1] < 0:
            step[rows] = total_g / (total_h + 1)
            continue
        _, k, at = best
        cut = float(edges[k][at])
        below = codes[rows, k] <= at
        todo += [(rows[below], (*path, (k, False, cut))), (rows[~below], (*path, (k, True, cut)))]
    return step, paths


def _simplified(path: Rule) -> Rule:
    """One bound for each feature and side."""
    bounds: dict[tuple[int, bool], float] = {}
    for k, above, at in path:
        old = bounds.get((k, above), at)
        bounds[k, above] = max(old, at) if above else min(old, at)
    return tuple(sorted((k, above, at) for (k, above), at in bounds.items()))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.002, rounds: int = 400, bins: int = 48) -> RuleModel:
    """Rules from boosted trees, then lasso logistic weights by accelerated proximal steps."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(y) < 10 or y.min() == y.max():
        return RuleModel(float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, bins))) for k in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    f, found = np.full(len(y), np.log(share / (1 - share))), set()
    least = max(5, len(y) // 500)
    for _ in range(trees):
        p = _sigmoid(f)
        step, paths = _grow(codes, edges, y - p, p * (1 - p), depth, least)
        f += 0.3 * step
        found |= {_simplified(q) for q in paths}
    rules = sorted(found)
    m = np.stack([np.all([(x[:, k] > at) == above for k, above, at in r], axis=0) for r in rules], axis=1).astype(np.float64)
    kept = (m.mean(0) > 0) & (m.mean(0) < 1)
    rules, m = [r for r, ok in zip(rules, kept, strict=True) if ok], m[:, kept]
    mean, scale = m.mean(0), np.sqrt(m.mean(0) * (1 - m.mean(0)))
    z = (m - mean) / scale
    lipschitz = 0.25 * np.linalg.norm(z, 2) ** 2 / len(y)
    w, b = np.zeros(z.shape[1]), np.log(share / (1 - share))
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        r = _sigmoid(z @ v + b) - y
        new = v - z.T @ r / len(y) / lipschitz
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / lipschitz, 0)
        b -= 4 * r.mean()
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (old - 1) / t * (new - w), new
    on = np.abs(w) > 1e-4
    weights = w[on] / scale[on]
    bias = b - (weights * mean[on]).sum()
    return RuleModel(float(bias), [(r, float(c)) for r, c in zip([r for r, ok in zip(rules, on, strict=True) if ok], weights, strict=True)])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", target: str = "quality", max_rows: int = MAX_ROWS) -> RuleModel:
    """Fits on at most ``max_rows`` labelled documents that are not held out."""
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col(target).alias("_y"))
        .filter(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_id")))
        .groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    )
    # at most max_rows pairs of numbers: a bounded broadcast
    rows = docs.select(F.col("doc_id").alias("_id"), F.col(text).alias("_raw")).join(F.broadcast(chosen), "_id")
    got = with_ratios(with_base_stats(rows, "_raw")).select("_y", *RATIOS).orderBy(F.xxhash64("_id"), *RATIOS).limit(max_rows).collect()
    x = np.array([[float(v) for v in r[1:]] for r in got]).reshape(len(got), len(RATIOS))
    return fit(x, np.array([float(r[0]) for r in got]))


def score(docs: DataFrame, model: RuleModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    df = docs.select(F.col("doc_id"), F.col(text).alias("_raw"))
    df = with_ratios(with_base_stats(df, "_raw")).select("doc_id", *RATIOS)
    df = df.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score"))
    return df.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_accepted(docs: DataFrame, model: RuleModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with their own columns."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_raw"))
    df = with_ratios(with_base_stats(df, "_raw")).select("_row", *RATIOS)
    return held(df.select("_row", model.column().alias("_score")), F.col("_score") >= threshold).select("_row.*")
