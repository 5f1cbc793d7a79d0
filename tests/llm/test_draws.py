"""Groups of near copies that no hub joins: few of their pairs become rows, and no link is lost."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from scrubwell.llm import spotsigs
from tests.llm.test_methods import components


@pytest.mark.parametrize("copies", [80, 160])
def test_group_without_a_hub_makes_few_pairs(spark, monkeypatch, copies):
    r = random.Random(5)
    base = [f"the a{k} b{k}" for k in range(80)]
    texts = [" ".join(f"the c{d}x{k} d{d}" if r.random() < 0.05 else x for k, x in enumerate(base)) for d in range(copies)]
    texts += [" ".join(f"the e{d}x{k} f{d}" if k % 3 == d % 3 else x for k, x in enumerate(base)) for d in range(9)]  # near to none
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = {x["doc_id"]: set(x["s"]) for x in spotsigs.signed(docs).collect()}
    links = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(links) > copies * copies / 4
    made = []

    def counted(*args, whole=spotsigs.candidates):
        found = whole(*args)
        made.append(found.count())
        return found

    monkeypatch.setattr(spotsigs, "candidates", counted)
    monkeypatch.setattr(spotsigs, "stars", lambda shared, sizes, similarity: shared.select(F.col("mark").alias("a"), F.col("mark").alias("b")).limit(0))
    got = {x["doc_id"]: x["group_id"] for x in spotsigs.near_classes(docs).collect()}
    assert got == components(list(sets), links)
    assert len(made) == 1 and made[0] <= 4 * copies
