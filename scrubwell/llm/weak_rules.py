"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0).  One pass counts the vote
patterns (at most 3^rules of them, whatever the corpus size); expectation-
maximisation over those counts estimates how often each rule votes which way on
good and on bad texts; the posterior probability of "good" is then a sum of
per-vote log odds, compiled into a Column expression.

Defined results: null or empty text fails the base rule and is not kept; an
empty table gives an empty result; repeated rows are judged alike; extra columns
are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubwell.llm.common import cut
from scrubwell.llm.textstats import BASE, with_base_stats, with_ratios

#: name -> (votes good if, votes bad if), over the columns of textstats.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words between 50 and 100000", "n_words < 20"),
    "word_length": ("r_word_len between 3.0 and 9.0", "r_word_len < 2.0 or r_word_len > 14.0"),
    "symbols": ("r_symbols < 0.01", "r_symbols > 0.05"),
    "capitals": ("r_upper < 0.08", "r_upper > 0.3"),
    "digits": ("r_digits < 0.05", "r_digits > 0.2"),
    "shouting": ("r_bangs < 0.005", "r_bangs > 0.03"),
    "repeated_lines": ("r_dup_lines < 0.1", "r_dup_lines > 0.4"),
    "repeated_words": ("r_repeat < 0.05", "r_repeat > 0.3"),
    "function_words": ("r_stops > 0.08", "r_stops < 0.02"),
    "plain_words": ("r_plain > 0.95", "r_plain < 0.8"),
    "stutter": ("r_runs < 0.02", "r_runs > 0.1"),
}

#: Prior probability of a good text, and the pseudo-counts of (good, abstain, bad) votes before any
#: text is seen.  A bad text is bad in few ways, so most rules still vote good on it.
PRIOR_GOOD = 0.8
PSEUDO = {1: {1: 80.0, 0: 19.0, -1: 1.0}, -1: {1: 50.0, 0: 20.0, -1: 30.0}}

BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def votes(rules: dict[str, tuple[str, str]] = RULES) -> list[Column]:
    return [F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0).cast("tinyint").alias(f"v_{name}") for name, (good, bad) in rules.items()]


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 100) -> tuple[float, list[dict[int, float]]]:
    """EM for a two-class naive Bayes over vote patterns: (log prior odds, per-rule log odds of each vote).

    The class prior and the vote tables carry pseudo-counts, so the labels can't
    swap and an empty table gives the prior.
    """
    prior = PRIOR_GOOD
    tables = [{c: {v: PSEUDO[c][v] / 100 for v in (1, 0, -1)} for c in (1, -1)} for _ in range(n_rules)]

    def odds(pattern, prior, tables):
        return math.log(prior / (1 - prior)) + sum(math.log(t[1][v] / t[-1][v]) for t, v in zip(tables, pattern, strict=True))

    for _ in range(rounds):
        good = {p: 1 / (1 + math.exp(-max(-500.0, min(500.0, odds(p, prior, tables))))) for p, _ in patterns}
        total = sum(n for _, n in patterns)
        mass = sum(n * good[p] for p, n in patterns)
        new = (mass + 100 * PRIOR_GOOD) / (total + 100)
        fresh = []
        for k in range(n_rules):
            t = {c: dict(PSEUDO[c]) for c in (1, -1)}
            for p, n in patterns:
                t[1][p[k]] += n * good[p]
                t[-1][p[k]] += n * (1 - good[p])
            fresh.append({c: {v: t[c][v] / sum(t[c].values()) for v in t[c]} for c in t})
        moved = abs(new - prior)
        prior, tables = new, fresh
        if moved < 1e-9:
            break
    return math.log(prior / (1 - prior)), [{v: math.log(t[1][v] / t[-1][v]) for v in (1, 0, -1)} for t in tables]


def posterior(bias: float, weights: list[dict[int, float]], rules: dict[str, tuple[str, str]] = RULES) -> Column:
    """Probability that a text is good, over the vote columns."""
    z = F.lit(bias)
    for name, w in zip(rules, weights, strict=True):
        v = F.col(f"v_{name}")
        z = z + F.when(v == 1, w[1]).when(v == -1, w[-1]).otherwise(w[0])
    return 1 / (1 + F.exp(-z))


def voted(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """``keep`` plus base statistics and votes, for every row."""
    df = docs.select(*keep, F.col(text).alias("_raw"))
    df = with_ratios(with_base_stats(df, "_raw"))
    return df.select(*[c for c in df.columns if c in ("doc_id", "_row", *BASE)], *votes())


def fit_on(df: DataFrame) -> Column:
    """Counts the vote patterns of ``df`` and returns the posterior's Column."""
    names = [f"v_{n}" for n in RULES]
    rows = df.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = [(tuple(int(r[n]) for n in names), r["n"]) for r in rows]
    return posterior(*fit(patterns, len(names)))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base statistics, base_failed, p_good and kept of every row of ``docs``."""
    df = cut(voted(docs, [F.col("doc_id")]))
    p = fit_on(df)
    failed = F.expr(BASE_FAILED)
    return df.withColumn("p_good", p).select("doc_id", *BASE, failed.alias("base_failed"), "p_good", (~failed & (F.col("p_good") >= threshold)).alias("kept"))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with their own columns.

    The texts are read once: rows and votes are materialised in the shared folder,
    the model is fitted on the votes, and the rows are filtered by them.
    """
    rows = voted(docs, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")])
    df = cut(rows.withColumn("_failed", F.expr(BASE_FAILED)).drop(*BASE))
    return df.filter(~F.col("_failed") & (fit_on(df) >= threshold)).select("_row.*")
