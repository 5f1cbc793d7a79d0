"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing extra columns, for every operator."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scrubwell.llm import html_blocks, kd_shards, mixing, packing, rule_ensemble, simhash, spotsigs, url_lm, warc, weak_rules
from scrubwell.llm.common import scratch_path

GOOD = "the cat and the dog went to the river with a small boat that was made of old wood by the men from town and it is for us " * 3
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, slot long, n_words long, kept boolean, score double, _row string, fp long"
ROWS = [
    (1, GOOD, "en", "a"), (2, GOOD, "en", "a"), (2, GOOD, "en", "a"), (3, None, None, None), (4, "", "en", ""), (None, "word", "en", "b"),
    (6, "x " * 60_000, "en", "b"), (7, "no no no no no no no no no no", "fr", "a"), (8, "é ü 😀", None, "c"), (9, "single", "de", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, 0, 0, 0, False, 0.5, "r", 1) for r in ROWS], DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0, "x") for i in range(1, 10)] + [(1, 0, 0, "x"), (None, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")


PAGES = "page_id long, url string, html string, text string, payload string, host string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://A.Net/x", "<p>hi</p>"), (2, None, None), (3, "no scheme", ""), (4, "http://b.org/fr/?q", "<p>hi</p>"), (4, "http://b.org/fr/?q", "<p>hi</p>"), (None, "x://y", "<article><p>a &amp b"), (7, "http://c.com/" + "z" * 5000, "<p>" + "long words here " * 40_000)]
    return spark.createDataFrame([(*r, "t", "p", "h") for r in rows], PAGES).cache()


def test_shards(docs, empty):
    got = kd_shards.kd_shards(docs, 3).collect()
    assert len(got) == len(ROWS) and {r["shard"] for r in got} <= {0, 1, 2}
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert next(r["size"] for r in got if r["doc_id"] == 3) == 16
    assert kd_shards.kd_shards(empty, 3).count() == 0


def test_classifier(docs, empty, labels):
    model = rule_ensemble.train(docs, labels)
    got = rule_ensemble.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert rule_ensemble.keep_accepted(docs, model, threshold=-1.0).columns == docs.columns
    assert rule_ensemble.keep_accepted(docs, model, threshold=-1.0).count() == len(ROWS)
    none = rule_ensemble.train(empty, labels)
    assert rule_ensemble.score(empty, none).count() == 0 and rule_ensemble.score(docs, none).count() == len(ROWS)


def test_weak_rules(docs, empty):
    got = {r["doc_id"]: r for r in weak_rules.judge(docs).collect()}
    assert got[1]["kept"] is got[2]["kept"] and not got[3]["kept"] and got[4]["base_failed"] and got[7]["n_repeat_words"] == 10
    kept = weak_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} <= {1, 2}
    assert weak_rules.judge(empty).count() == 0 and weak_rules.keep_good(empty).count() == 0


def test_simhash(docs, empty):
    got = simhash.cluster(docs).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["component_id"] == by[2]["component_id"] == 1 and by[3]["fp"] == by[4]["fp"] == 0
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns and one.filter("doc_id in (1, 2)").count() == 1
    assert simhash.cluster(empty).count() == 0
    kept = Counter(r["doc_id"] for r in one.collect())
    assert kept[None] == 1 and kept[3] == 1 and kept[4] == 0  # a row without an id is not lost
    big = (1 << 62) + 1
    rows = docs.sparkSession.createDataFrame([(None, "alone here now"), (None, GOOD), (big, GOOD), (5, "one two three four"), (5, "other words in this text")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"][:3]) for r in simhash.one_of_each(rows).collect()) == [(0, "alo"), (5, "one"), (5, "oth"), (big, "the")]


def test_one_of_near(docs, empty):
    one = simhash.one_of_near(docs)
    assert one.columns == docs.columns and simhash.one_of_near(empty).count() == 0
    kept = Counter(r["doc_id"] for r in one.collect())
    # 1 stands for both rows of 2; the empty texts of 3 and 4 are one group; a null id that is alone stays
    assert kept == {1: 1, 3: 1, None: 1, 6: 1, 7: 1, 8: 1, 9: 1}
    big = (1 << 62) + 1
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join(words[:58]), " ".join([*words, "more", "of", "it"]), "one two three four", "one two three four", "one two three five"]
    rows = docs.sparkSession.createDataFrame([(None, texts[0]), (big, texts[1]), (5, texts[2]), (8, texts[3]), (8, texts[3]), (8, texts[5]), (None, "alone here"), (None, "alone here")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in simhash.one_of_near(rows).collect())
    assert got == {(5, texts[2]): 1, (8, texts[3]): 2, (8, texts[5]): 1, (None, "alone here"): 2}


def test_near_copies_of_very_long_texts(spark):
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(40_000)]
    near, far = list(base), list(base)
    for k in range(0, 40_000, 100):
        near[k] = "x"
    for k in range(0, 40_000, 20):
        far[k] = "y"
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate((base, near, far, base[:30_000]))], "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.one_of_near(docs).collect()} == {0, 2, 3}


def test_near_copies_in_a_shingle_of_many(spark, monkeypatch):
    """Groups larger than a chunk: every pair of chunks meets."""
    monkeypatch.setattr(simhash, "MEET_ROWS", 7)
    monkeypatch.setattr(simhash, "FEW", 3)
    rng = random.Random(8)
    texts = []
    for g in range(12):  # all share a beginning, few are near one another
        base = ["same", "words", "at", "the", "start", *(f"g{g}w{k}" for k in range(30))]
        texts += [base, [*base[:-2], f"a{g}", f"b{g}"], [f"x{rng.randint(0, 999)}" if k % 4 == 3 else w for k, w in enumerate(base)]]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    alike = {(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in simhash.one_of_near(docs).collect()} == set(range(len(texts))) - {i for i, _ in alike} and len(alike) == 12


def test_spotsigs(docs, empty):
    got = spotsigs.edited(docs).collect()
    assert len(got) == len(ROWS)
    assert next(r["fingerprint"] for r in got if r["doc_id"] == 1) == next(r["fingerprint"] for r in got if r["doc_id"] == 2)
    assert next(r["fingerprint"] for r in got if r["doc_id"] == 3) == ""
    assert spotsigs.edited(empty).count() == 0
    assert spotsigs.near_classes(empty).count() == 0
    named = Counter((r["doc_id"], r["class_id"], r["group_id"]) for r in spotsigs.near_classes(docs).collect())
    assert named[1, 1, 1] == 1 and named[2, 1, 1] == 2 and named[3, 3, 3] == named[4, 3, 3] == 1 and named[None, None, None] == 1
    assert named == Counter((r["doc_id"], r["class_id"], r["group_id"]) for r in got)


def test_packing(docs, empty):
    got = packing.packed(docs).collect()
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in ROWS)
    assert sum(r["length"] for r in got) == words
    used = {}
    for r in got:
        used.setdefault((r["bin_id"], r["capacity"]), []).append((r["offset"], r["length"]))
    for (_, cap), parts in used.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at <= cap
    assert packing.packed(empty).count() == 0


def test_mixing(docs, empty):
    got = mixing.schedule(docs, block=2).collect()
    assert sorted(r["position"] for r in got) == list(range(len(ROWS)))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == len(ROWS)
    assert mixing.schedule(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_large_ids_beside_null_ids(spark):
    big = (1 << 62) + 1
    rows = spark.createDataFrame([(None, "a b", "s", "x://h/p"), (big, "c d e", "s", "x://h/p")], "doc_id long, text string, source string, url string").coalesce(1)
    pages = rows.withColumnRenamed("doc_id", "page_id")
    for got in (packing.packed(rows), mixing.schedule(rows), simhash.cluster(rows), html_blocks.extract(pages, "text"), url_lm.judge(pages, {}, url_lm.train(pages, {}))):
        assert {r[0] for r in got.collect()} == {None, big}


def test_html(pages):
    got = {r["page_id"]: r for r in html_blocks.extract(pages).collect()}
    assert got[2]["text"] == "" and got[2]["n_chars"] == 0 and got[None]["text"] == "a & b"
    assert got[7]["n_chars"] == len(" ".join("long words here".split() * 40_000))
    assert html_blocks.extract(pages.limit(0)).count() == 0


def test_urls(pages):
    rules = {"net/": "block", "org/fr/": "allow"}
    model = url_lm.train(pages, rules)
    got = {r["page_id"]: r for r in url_lm.judge(pages, rules, model).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.net", "/x", "net/", "block")
    assert (got[2]["host"], got[2]["path"], got[2]["rule"]) == ("", "", None)
    assert got[4]["path"] == "/fr/" and got[4]["verdict"] == "allow"
    assert url_lm.judge(pages.limit(0), rules, url_lm.train(pages.limit(0), rules)).count() == 0


def test_warc(spark, pages):
    path = scratch_path(spark, "warc")
    warc.write(pages, path)
    rows = warc.read(spark, path, verify="true").collect()
    assert Counter(r["record_type"] for r in rows) == {"response": 4, "revisit": 3}
    kinds = {(r["record_id"], r["record_type"], r["refers_to"]) for r in rows}
    assert {("urn:x-page:1", "response", None), ("urn:x-page:4", "revisit", "urn:x-page:1"), ("urn:x-page:3", "revisit", "urn:x-page:2"), ("urn:x-page:null", "response", None)} <= kinds
    again = warc.read(spark, path, payload="false").filter("record_type = 'revisit'").collect()
    assert again and all(r["payload"] is None for r in again)
    assert len(again) == sum(r["record_type"] == "revisit" for r in rows)
    bodies = {r["record_id"]: bytes(r["payload"]).decode() for r in rows if r["payload"] is not None}
    assert bodies["urn:x-page:1"] == "<p>hi</p>" and bodies["urn:x-page:2"] == ""
    same = scratch_path(spark, "warc")
    warc.write(pages.filter("page_id = 4"), same)  # equal rows: one response, one revisit
    assert Counter((r["record_type"], r["refers_to"]) for r in warc.read(spark, same).collect()) == {("response", None): 1, ("revisit", "urn:x-page:4"): 1}
    small = scratch_path(spark, "warc")
    warc.write(pages, small, least_bytes=6)
    assert Counter(r["record_type"] for r in warc.read(spark, small).collect()) == {"response": 5, "revisit": 2}
    none = scratch_path(spark, "warc")
    warc.write(pages.limit(0), none)
    assert warc.read(spark, none).count() == 0


def test_pipeline_stages_on_an_empty_table(spark, empty, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_pipeline_stages_on_edge_rows(spark, docs, labels, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns, through every stage and through run()."""
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    docs.unionByName(docs.limit(3)).write.parquet(f"{folder}/documents.parquet")
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, rows, folder)
        if name == "best_fit":
            assert got.columns == ["doc_id", "piece", "length", "bin_id", "capacity", "offset"] and got.count() > 0
        else:
            assert got.columns == rows.columns
            left, had = (Counter((r["doc_id"], r["text"], r["source"]) for r in x.collect()) for x in (got, rows))
            assert not left - had and (name != "pfair_mix" or left == had)
    assert set(corpus_pipeline.run(spark, folder).columns) == {"doc_id", "piece", "length", "bin_id", "capacity", "offset"}


def test_a_shared_folder_must_be_named(spark, monkeypatch):
    from scrubwell.llm import common
    from scrubwell.sources import shared

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *a: None)

    for f in (lambda s: common.shared_dir(s), lambda s: shared.shared_path(s, "x")):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            f(Session())


def test_the_mix_decides_the_packing(spark, tmp_path):
    """Pieces of equal length take their places in the order of the written mix."""
    rows = [(k, "a b c" if k % 3 else "a b c d e", f"s{k % 4}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    corpus_pipeline.source_mix(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    place = {r["doc_id"]: k for k, r in enumerate(corpus_pipeline.source_mix(spark, docs, "").collect())}
    assert sorted(place) != sorted(place, key=place.get)
    bins = lambda df: {r["doc_id"]: (r["bin_id"], r["offset"], r["length"]) for r in corpus_pipeline.packed_bins(spark, df, "").collect()}
    got = bins(mixed)
    for length, n in ((3, 40), (5, 20)):
        own = [got[k][:2] for k in sorted(got, key=place.get) if got[k][2] == length]
        assert len(own) == n and own == sorted(own)
    # another order, another packing
    mixed.repartition(3).orderBy("doc_id").write.parquet(f"{tmp_path}/plain")
    assert bins(spark.read.parquet(f"{tmp_path}/plain")) != got
