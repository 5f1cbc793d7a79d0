"""The corpus build's passes: what is written between them, and the sink's lines."""

import glob
import os
import time

from pyspark.sql import functions as F

from scrubwell.operators import corpus, surrogates
from scrubwell.sources import writers


def test_keys_are_taken_in_the_first_pass(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{base}/*"))
    notes = spark.createDataFrame([(1, "Dr. [**Name (NI) 7**] met [**Known lastname 5**]\nUnit No: [**Numeric Identifier 3**]"), (2, None), (3, "Email: a@b\n- [**Location 4**]")], "ROW_ID long, TEXT string")
    got = {r["ROW_ID"]: r for r in corpus.built(notes).collect()}
    new = {os.path.basename(x).split("-")[0]: spark.read.parquet(x).columns for x in set(glob.glob(f"{base}/*")) - before}
    assert sorted(new) == ["keys", "resolved"] and "_clean" not in new["resolved"] and {"_keys", "_told"} <= set(new["resolved"])
    assert got[2]["TEXT_WITH_DUMMY_PHI_HOSPITAL"] is None
    lines = notes.select(surrogates.told_lines("TEXT").alias("t"))
    assert sorted(map(tuple, surrogates.keys_in_lines(lines, "t").collect())) == sorted(map(tuple, surrogates.context_keys(notes, "TEXT").collect()))


def test_folders_side_by_side(spark, tmp_path):
    texts = ["a\r\n\nb", None, "c", "\r"]
    df = spark.createDataFrame([(h, c, "x", t) for h in "pq" for c in "12" for t in texts], "half string, code string, anonymity string, sentence string")
    writers.write_training_text(df.coalesce(1), str(tmp_path / "t"))
    got = spark.read.text(str(tmp_path / "t"))
    assert sorted(r["value"] for r in got.filter("half = 'q' and code = 2").collect()) == ["", " ", "a b", "c"] and got.count() == 16
    assert spark.conf.get(writers._WRITERS, "0") == "0" and writers.FOLDERS >= 24
    assert got.select(F.input_file_name()).distinct().count() == 4


def test_packed_folders(spark, tmp_path):
    """Packed folders read back the same in less space, and the shuffle that led to them is gone when they are written."""
    lines = spark.range(4_000).selectExpr("IF(id % 2 = 0, 'p', 'q') AS half", "'1' AS code", "'x' AS anonymity", "concat('line ', id % 50, repeat(' and so on', 20)) AS sentence")
    local = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in local.getAllFiles().mkString("|").split("|") if "shuffle_" in f}
    kept, sizes = [], []
    for packed in (False, True):
        path, before = str(tmp_path / f"t{packed}"), shuffles()
        writers.write_training_text(lines.repartition(3, "sentence"), path, packed=packed)
        for _ in range(50):
            if shuffles() <= before:
                break
            time.sleep(0.2)
        assert shuffles() <= before
        rows = spark.read.text(path)
        kept.append(sorted(map(tuple, rows.groupBy("half", "value").count().collect())))
        sizes.append(sum(os.path.getsize(f) for f in glob.glob(f"{path}/**/part-*", recursive=True)))
    assert kept[0] == kept[1] and sum(n for *_, n in kept[0]) == 4_000 and sizes[1] * 3 < sizes[0]
