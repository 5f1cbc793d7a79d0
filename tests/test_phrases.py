"""Spans of several words equal a brute-force matcher."""

import random
import re

import pytest

from scrubwell.operators import phrases

NAMES = ["heart failure", "congestive heart failure", "failure", "Type-2 diabetes", "diabetes", "a", "renal  cell carcinoma", "acute renal failure", "heart"]
GAZETTEER = "term string, cui string, preferred_name string, semtype string"


def grams(name):
    marked = f"^{name}$"
    return {marked[i : i + 3] for i in range(max(1, len(marked) - 2))}


def words(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def brute(text, names, similarity, max_words):
    ws, found = words(text), []
    for i in range(len(ws)):
        for j in range(i + 1, min(i + max_words, len(ws)) + 1):
            surface = " ".join(ws[i:j])
            hits = []
            for name in names:
                a, b = grams(surface), grams(name)
                s = len(a & b) / len(a | b)
                if s >= similarity:
                    hits.append((-s, name))
            if hits:
                found.append((i, -j, surface, min(hits)))
    at, kept = 0, []
    for i, j, surface, (s, name) in sorted(found):
        if i >= at:
            kept.append((i, -j, surface, name, round(-s, 9)))
            at = -j
    return kept


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    letters = lambda w: "".join(c if r.random() > 0.04 else r.choice("aeiou ") for c in w)
    pool = [*NAMES, "the", "of", "2", "and", "cell", "type", "acute", "with"]
    return [" ".join(letters(r.choice(pool)) for _ in range(r.randint(1, 14))) for _ in range(250)] + ["", None, "Heart   FAILURE!", "é heart-failure", "word " * 3_000 + "diabetes"]


@pytest.mark.parametrize("similarity,max_words,shuffled", [(0.7, 3, False), (0.5, 2, True), (1.0, 5, False)])
def test_spans(spark, texts, monkeypatch, similarity, max_words, shuffled):
    if shuffled:
        monkeypatch.setattr(phrases, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    gazetteer = spark.createDataFrame([(n, f"C{k}", n, "dsyn") for k, n in enumerate(NAMES)] + [("Diabetes", "C99", "other", "neop"), ("?!", "C0", "none", "x")], GAZETTEER)
    got = phrases.leftmost_longest(phrases.similar(phrases.spans(df, "id", "text", max_words), gazetteer, similarity), "id").collect()
    by = {}
    for x in got:
        by.setdefault(x["id"], []).append((x["start"], x["stop"], x["surface"], x["name"], round(x["similarity"], 9)))
    names = {" ".join(words(n)) for n in NAMES}
    expected = {k: e for k, t in enumerate(texts) if (e := brute(t, names, similarity, max_words))}
    assert {k: sorted(v) for k, v in by.items()} == expected and sum(map(len, expected.values())) > 100


@pytest.mark.parametrize("similarity,max_words,few", [(0.7, 3, 2_048), (0.5, 2, 2_048), (1.0, 5, 2_048), (0.7, 3, 2)])
def test_few_names_by_words(spark, texts, monkeypatch, similarity, max_words, few):
    monkeypatch.setattr(phrases, "FEW_NAMES", few)
    monkeypatch.setattr(phrases, "TOGETHER", 7)
    monkeypatch.setattr(phrases, "REMEMBERED", 20)
    long = "x" * 300 + " " + "ab" * 200
    df = spark.createDataFrame(list(enumerate([*texts, long])), "id long, text string")
    listed = [*NAMES, long]
    gazetteer = spark.createDataFrame([(n, f"C{k}", n, "dsyn") for k, n in enumerate(listed)] + [("?!", "C0", "none", "x")], GAZETTEER)
    found = phrases.matched(df, gazetteer, "id", "text", similarity, max_words)
    got = {(x["id"], x["start"], x["stop"], x["surface"], x["name"], round(x["similarity"], 9)) for x in phrases.leftmost_longest(found, "id").collect()}
    names = {" ".join(words(n)) for n in listed}
    expected = {(k, *x) for k, t in enumerate([*texts, long]) for x in brute(t, names, similarity, max_words)}
    assert got == expected and len(expected) > 100
    if few > 2:  # most spans never become rows
        near = phrases.near_spans(df, "id", "text", sorted(names), similarity, max_words).select("id", "start", "stop").distinct().count()
        assert near < phrases.spans(df, "id", "text", max_words).count() / 2


def test_concepts_of_spans(spark):
    df = spark.createDataFrame([(1, "has Diabetes and congestve heart failure")], "id long, text string")
    gazetteer = spark.createDataFrame([(n, f"C{k}", n, "dsyn") for k, n in enumerate(NAMES)] + [("Diabetes", "C99", "other", "neop")], GAZETTEER)
    got = sorted((x["start"], x["stop"], x["cui"], x["surface"]) for x in phrases.phrase_matches(df, gazetteer, "id", "text").collect())
    assert got == [(1, 2, "C4", "diabetes"), (1, 2, "C99", "diabetes"), (3, 6, "C1", "congestve heart failure")]
    assert phrases.phrase_matches(df, gazetteer.limit(0), "id", "text").count() == 0
    assert phrases.phrase_matches(df.limit(0), gazetteer, "id", "text").count() == 0
