"""Whole operators against plain Python: the k-d tree, the weighed votes, the compiled rules."""

import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import regex
from pyspark.sql import functions as F

from scrubwell.llm import kd_shards, rule_ensemble, textstats, weak_rules

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_shards_equal_a_plain_tree(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, k, 3]), "x" * rng.choice([0, 5, 50, 400]), rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", "c"])) for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = [f"k_{d}" for d in kd_shards.DIMENSIONS]
    compact = [r.asDict() for r in kd_shards._codes(docs, "text").collect()]
    spread = {n: max(1, (max(r[n] for r in compact) >> kd_shards.BITS) - (min(r[n] for r in compact) >> kd_shards.BITS)) for n in names}
    out = Counter()

    def split(part, first, shards):
        if shards == 1 or not part:
            for r in part:
                out[r["doc_id"], r["size"], r["text_crc32"], first] += 1
            return
        width = [((max(r[n] for r in part) >> kd_shards.BITS) - (min(r[n] for r in part) >> kd_shards.BITS)) / spread[n] for n in names]
        key = names[width.index(max(width))]
        bytes_at = defaultdict(int)
        for r in part:
            bytes_at[r[key]] += r["size"]
        wanted, had = sum(bytes_at.values()) * (shards // 2) / shards, 0
        for at in sorted(bytes_at):
            if had + bytes_at[at] >= wanted:
                below = at + (had + bytes_at[at] - wanted <= wanted - had)
                break
            had += bytes_at[at]
        split([r for r in part if r[key] < below], first, shards // 2)
        split([r for r in part if r[key] >= below], first + shards // 2, shards - shards // 2)

    split(compact, 0, 13)
    got = kd_shards.kd_shards(docs, 13, tolerance=0.0).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got) == out
    for s in range(13):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


PLAIN = regex.compile(r"""["'(«¿¡]?[\p{L}'’-]+[.,;:!?)"'»]?""")


def ratios(text):
    """The statistics that the rules read, by their definitions."""
    words = regex.findall(r"[^\x20\x09-\x0D]+", text)
    low, n, chars = [w.lower() for w in words], max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
    windows, covered = defaultdict(list), set()
    for k in range(len(words) - 7):
        windows[tuple(words[k : k + 8])].append(k)
    for v in windows.values():
        if len(v) > 1:
            covered.update(x for k in v for x in range(k, k + 8))
    return {
        "n_words": len(words), "n_repeat_words": len(covered), "r_word_len": sum(map(len, words)) / n, "r_symbols": sum(c in "#*$%&|<>" for c in text) / chars,
        "r_upper": sum(unicodedata.category(c) == "Lu" for c in text) / chars, "r_digits": sum(c in "0123456789" for c in text) / chars, "r_bangs": text.count("!") / chars,
        "r_dup_lines": (len(lines) - len(set(lines))) / max(1, len(lines)), "r_repeat": len(covered) / n, "r_stops": sum(w in set(textstats.STOPS) for w in low) / n,
        "r_plain": sum(PLAIN.fullmatch(w) is not None for w in words) / n, "r_runs": sum(a == b for a, b in zip(low, low[1:], strict=False)) / n,
    }


def test_kept_equals_plain_expectation_maximisation(spark):
    docs = documents(spark)
    rows = docs.collect()
    stats = [ratios(r["text"] or "") for r in rows]
    between = lambda rule, x: eval(rule.replace("n_words between 50 and 100000", "50 <= n_words <= 100000").replace("r_word_len between 3.0 and 9.0", "3.0 <= r_word_len <= 9.0"), {}, x)
    votes = np.array([[-1 if between(bad, x) else 1 if between(good, x) else 0 for good, bad in weak_rules.RULES.values()] for x in stats])
    prior = weak_rules.PRIOR_GOOD
    table = {c: np.array([[weak_rules.PSEUDO[c][v] / 100 for v in (-1, 0, 1)]] * votes.shape[1]) for c in (1, -1)}

    def good(prior, table):
        z = np.full(len(votes), np.log(prior / (1 - prior)))
        for k in range(votes.shape[1]):
            z += np.log(table[1][k][votes[:, k] + 1] / table[-1][k][votes[:, k] + 1])
        return 1 / (1 + np.exp(-z))

    for _ in range(100):
        p = good(prior, table)
        new = (p.sum() + 100 * weak_rules.PRIOR_GOOD) / (len(p) + 100)
        for c, w in ((1, p), (-1, 1 - p)):
            counts = np.array([[weak_rules.PSEUDO[c][v] + w[votes[:, k] == v].sum() for v in (-1, 0, 1)] for k in range(votes.shape[1])])
            table[c] = counts / counts.sum(axis=1, keepdims=True)
        moved, prior = abs(new - prior), new
        if moved < 1e-9:
            break
    p = good(prior, table)
    failed = [x["n_words"] < 20 or 100 * x["n_repeat_words"] > 30 * x["n_words"] for x in stats]
    got = {r["doc_id"]: r for r in weak_rules.judge(docs).collect()}
    for r, probability, base in zip(rows, p, failed, strict=True):
        x = got[r["doc_id"]]
        assert abs(x["p_good"] - probability) < 1e-6 and x["base_failed"] == base and x["kept"] == (not base and probability >= 0.5)
    assert 0 < sum(r["kept"] for r in got.values()) < len(got)


def test_scores_equal_the_rules(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    model = rule_ensemble.train(docs, labels)
    stats = textstats.with_ratios(textstats.with_base_stats(docs.select("doc_id", F.col("text").alias("_raw")), "_raw")).select("doc_id", *textstats.RATIOS).collect()
    got = {r["doc_id"]: r for r in rule_ensemble.score(docs, model).collect()}
    assert model.rules
    for r in stats:
        x = r[1:]
        z = model.bias + sum(w for rule, w in model.rules if all((x[k] > at) == above for k, above, at in rule))
        assert abs(got[r["doc_id"]]["score"] - 1 / (1 + np.exp(-z))) < 1e-9
        assert got[r["doc_id"]]["predicted"] == (got[r["doc_id"]]["score"] >= 0.3)
