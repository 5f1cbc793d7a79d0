"""No sequence of the URL models is dropped; models in memory and in a table agree."""

import random

import pytest
from pyspark.sql import functions as F

from scrubwell.llm import url_lm

RULES = {"net/": "block", "org/": "allow"}


def test_all_sequences_in_memory_or_stored(spark, monkeypatch):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdexyz-0é") for _ in range(r.randint(1, 9)))
    rows = [(k, f"http://{word()}.{r.choice(['net', 'org', 'com'])}/{word()}/{word()}") for k in range(400)] + [(400, None), (401, "x"), (402, "http://com")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    lines = url_lm.labelled_lines(pages, RULES).filter("not held").cache()
    characters = lines.agg(F.sum(F.length("line") + 1)).first()[0]
    counts = url_lm.counted(lines, 5).groupBy("k").agg(F.sum(F.col("n0") + F.col("n1")).alias("n")).collect()
    assert {x["k"]: x["n"] for x in counts} == dict.fromkeys(range(6), characters)
    held = url_lm.train(pages, RULES)
    monkeypatch.setattr(url_lm, "HELD", 0)
    stored = url_lm.train(pages, RULES)
    assert stored.stored is not None and stored.known and stored.errors == held.errors
    assert (stored.slope, stored.shift) == pytest.approx((held.slope, held.shift))
    of = lambda model: {x["page_id"]: x.asDict() for x in url_lm.judge(pages, RULES, model).collect()}
    a, b = of(held), of(stored)
    assert len(b) == len(rows) and {k: x.pop("p_reject") for k, x in b.items()} == pytest.approx({k: x.pop("p_reject") for k, x in a.items()}) and a == b
