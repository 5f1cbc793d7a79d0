"""Handwritten line cases, properties, sources and sinks."""

import random
import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from scrubwell import logs, schemas
from scrubwell.__main__ import main
from scrubwell.functions import cleaning, dates, names, training_text
from scrubwell.operators import checks, mentions, placeholders, scoring, subsets, surrogates
from scrubwell.sources import readers, writers
from scrubwell.streaming.notes import append_batches, prepared


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("r")).first()[0]


def test_backdating(spark):
    shift = lambda t: dates.backdate(t, dates.year_shift(t))
    assert one(spark, "[**2177-12-5**] to [**2192-1-3**]", shift) == "12/5/1997 to 1/3/2012"
    base = "[**2177-12-5**] "
    assert one(spark, base + "[**263-11-28**] [**10/2570**] [**5-8**]: '[**96**] ok", shift).startswith("12/5/2017 11/28 Oct 5-8: '")
    assert one(spark, "[**10/2570**] only", shift) == "[**10/2570**] only"
    assert one(spark, None, shift) is None


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("Wait!!", "Wait."), ("7 ??????", "7 "), ("a\tb", "ab"), ("Dr. .....", ""), ("done.....", "done."), ("x\n....\ny", "x\ny"), ("x\n ___ \ny", "x\ny"),
        ("grade ___", "grade"), ("last cigarette _____", "last cigarette "), ("__12__ kg", "12 kg"), ("x\n~~~\na~~b", "x\nab"), ("x\n@@@\ny", "x\ny"),
    ],
)
def test_cleaning(spark, before, after):
    assert one(spark, before, cleaning.clean) == after


def test_cleaning_again_changes_nothing(spark):
    text = "Wait!!\nDr. ....\nx....\n~~~\nb"
    once = one(spark, text, cleaning.clean)
    assert one(spark, once, cleaning.clean) == once


def test_keyword_takes_the_last_placeholder_in_reach(spark):
    assert one(spark, "echo [**4-5**] and [**6-7**]", dates.resolve) == "echo [**4-5**] and 6/7"
    assert one(spark, "echo[**4-5**]", dates.resolve) == "echo4/5"
    assert one(spark, "THURSDAY [**4-5**]", dates.resolve) == "THURSDAY [**4-5**]"
    assert one(spark, "in [**2-3**] days, in [**5-6**] days", dates.resolve) == "in 3 days, in [**5-6**] days"


def test_last_rule_wins(spark):
    keys = spark.createDataFrame([("[**First Name (STitle) 12**]",), ("[**Day Month Year 3**]",), ("[**Nothing 1**]",)], "placeholder string")
    got = {r[0]: r[1] for r in surrogates.rule_map(keys, 42).collect()}
    assert got["[**First Name (STitle) 12**]"] in surrogates.POOLS["last"]
    assert re.fullmatch(r"\d\d/\d\d", got["[**Day Month Year 3**]"])
    assert "[**Nothing 1**]" not in got
    again = {r[0]: r[1] for r in surrogates.rule_map(keys, 42).collect()}
    assert got == again


def test_fill_keeps_unmapped_and_other_rows(spark):
    notes = spark.createDataFrame([(1, "a [**X 1**] b [**Y 2**]"), (2, "none"), (3, None)], "k long, t string")
    mapping = spark.createDataFrame([("[**X 1**]", "x")], "placeholder string, dummy_phi string")
    got = {r["k"]: r["o"] for r in placeholders.fill(notes, mapping, "k", "t", "o").collect()}
    assert got == {1: "a x b [**Y 2**]", 2: "none", 3: None}


def test_training_text(spark):
    assert one(spark, " 1. Dr. A\n[x] M.D.  Admission Date: 5 ", training_text.normalise) == "doctor a md admission date: 5"
    assert one(spark, "Admission Date: 5 b", lambda t: training_text.normalise(t, True)) == "b"
    assert one(spark, None, training_text.normalise) == ""
    merged = one(spark, "this is a long first sentence. short. and this is a long one again.", lambda t: training_text.merge_short(training_text.sentences(t)))
    assert merged == ["this is a long first sentence. short.", "and this is a long one again."]


def test_masks_and_tokens(spark):
    text = "[**Known firstname 1**] [**Known lastname 2**] x"
    assert one(spark, text, names.mask_names) == "[MASK] [MASK] x"
    tokens = F.create_map(F.lit("[**Known firstname 1**]"), F.lit(2))
    assert one(spark, text, lambda t: names.mask_names_by_tokens(t, tokens)) == "[MASK] [MASK] [**Known lastname 2**] x"


def test_splits_are_disjoint_and_exact(spark):
    df = spark.range(1001).withColumnRenamed("id", "k").withColumn("c", F.col("k") % 3)
    halves = {r[0]: r[1] for r in subsets.half_split(df, "k").groupBy("half").count().collect()}
    assert halves == {"hospital": 500, "shadow": 501}
    report = checks.flag_report(subsets.train_test(df, "k", 100), "in_train", "in_test", "c", 100)
    checks.require(report, "exact_size", "same_categories")
    row = report.first()
    assert (row["n_both"], row["n_neither"], row["n_test"]) == (0, 0, 901)
    assert checks.disjoint(df.filter("k < 5").select("k"), df.filter("k > 5").select("k")).first()["disjoint"]
    assert not checks.disjoint(df.filter("k < 6").select("k"), df.filter("k > 4").select("k")).first()["disjoint"]


@pytest.mark.parametrize("wanted", [0, 5, 9, 10, 100])
def test_cutoff_equals_loop(spark, wanted):
    sizes = [4, 3, 2, 1, None]
    rows = [(s, i) for s, n in enumerate(sizes) for i in range(n or 0)] + [(None, 99)]
    df = spark.createDataFrame(rows, "s long, r long")
    t = 1
    counts = [n for n in sizes if n]
    kept = lambda t: sum(n for n in counts if n >= t)
    while kept(t) > wanted:
        t += 1
    expected = -1 if kept(1) <= wanted else max(n for n in counts if kept(n) > wanted)
    got = subsets.rare_cutoff(df, "s", wanted, "r").first()
    assert got["threshold"] == expected
    assert got["n_docs"] == kept(max(1, expected))


def test_draws(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 1, 5.0), (2, 0, 1.0), (2, 1, 1.0)], "d long, token_id long, logit double")
    assert {r[0]: r[1] for r in scoring.argmax(df, ["d"]).collect()} == {1: 1, 2: 0}
    assert scoring.gumbel_draw(df, ["d"], 3).count() == 2
    total = scoring.renormalised(scoring.softmax(df, ["d"]), ["d"], batch=True).agg(F.sum("p")).first()[0]
    assert abs(total - 1) < 1e-12


def test_keep_first_is_deterministic(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (2, None, "c")], "k long, o long, v string")
    assert sorted(tuple(r) for r in mentions.keep_first(df, ["k"], ["o"]).collect() if r["k"] == 1) == [(1, 3, "a")]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"\nb'), (2, "c,d")], schemas.INDEXED_TEXT)
    writers.write_csv(df, f"{tmp_path}/c")
    assert sorted(map(tuple, readers.read_csv(spark, f"{tmp_path}/c", schemas.INDEXED_TEXT).collect())) == [(1, 'a "q"\nb'), (2, "c,d")]
    writers.write_tsv(df, f"{tmp_path}/t")
    assert readers.read_tsv(spark, f"{tmp_path}/t", schemas.INDEXED_TEXT).count() == 2


def test_csv_keeps_blanks_and_reads_empty_as_null(spark, tmp_path):
    rows_ = [(1, "Physician "), (2, " x"), (3, None), (4, "a"), (5, "\r\n a\tb ")]
    df = spark.createDataFrame([(i, "" if i == 3 else t) for i, t in rows_], schemas.INDEXED_TEXT)
    for k, (write, read) in enumerate(((writers.write_csv, readers.read_csv), (writers.write_tsv, readers.read_tsv))):
        write(df, f"{tmp_path}/{k}")
        assert sorted(map(tuple, read(spark, f"{tmp_path}/{k}", schemas.INDEXED_TEXT).collect())) == rows_


def test_missing_and_empty_inputs(spark, tmp_path):
    with pytest.raises(AnalysisException):
        readers.read_csv(spark, f"{tmp_path}/none", schemas.INDEXED_TEXT)
    (tmp_path / "empty.csv").write_text("")
    assert readers.read_csv(spark, f"{tmp_path}/empty.csv", schemas.INDEXED_TEXT).count() == 0
    (tmp_path / "empty.txt").write_text("")
    assert readers.read_lines(spark, f"{tmp_path}/empty.txt").count() == 0


def test_draws_around_the_burn_in(spark):
    df = spark.createDataFrame([(i, t, float(t == 3)) for i in range(40) for t in range(6)], "i long, token_id long, logit double")
    likeliest = {r["i"]: r["token_id"] for r in scoring.scheduled_draw(df, ["i"], "i", 1, 20).collect()}
    assert {likeliest[i] for i in range(20, 40)} == {3} and len({likeliest[i] for i in range(20)}) > 1
    two = {r["i"]: r["token_id"] for r in scoring.scheduled_draw(df, ["i"], "i", 1, 20, 2).collect()}
    assert {two[i] for i in range(20, 40)} == {0, 3}
    assert all(two[i] == likeliest[i] for i in range(20))


def test_written_positions(spark):
    df = spark.range(8).select("id", F.array(F.lit(4), F.lit(7), F.lit(9)).alias("at"))
    got = {how: [r[0] for r in df.select(scoring.written_position(F.col("id"), F.col("at"), how, 5), "id").orderBy("id").collect()] for how in ("always", "first", "never")}
    assert got["always"] == [4, 7, 9, 4, 7, 9, 4, 7]
    assert got["first"] == got["always"][:3] + got["never"][3:]
    assert set(got["never"]) <= {4, 7, 9}


def test_lines_and_training_text(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a\nb\nc\n")
    assert [tuple(r) for r in readers.read_lines(spark, f"{tmp_path}/x.txt").orderBy("sample_index").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    df = spark.createDataFrame([("hospital", "c1p2", "hipaa", "one\ntwo")], "half string, code string, anonymity string, sentence string")
    writers.write_training_text(df, f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out/half=hospital/code=c1p2/anonymity=hipaa").first()[0] == "one two"


def test_stream_equals_batch(spark, tmp_path):
    notes = spark.createDataFrame([(1, "seen on [**2177-1-2**]!!"), (2, "echo [**4-5**]")], "ROW_ID long, TEXT string")
    notes.write.parquet(f"{tmp_path}/in")
    stream = prepared(spark.readStream.schema("ROW_ID long, TEXT string").parquet(f"{tmp_path}/in"))
    append_batches(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, prepared(notes).collect()))


def test_lines_of_several_files_are_numbered_in_order(spark, tmp_path):
    texts = {f"f{k}.txt": [f"{k}:{j}" for j in range(1 + 7 * ((k * 5) % 6))] for k in range(6)}
    for name, rows_ in texts.items():
        (tmp_path / name).write_text("\n".join(rows_) + "\n")
    expected = [x for name in sorted(texts) for x in texts[name]]
    assert [(r["sample_index"], r["text"]) for r in readers.read_lines(spark, str(tmp_path)).orderBy("sample_index").collect()] == list(enumerate(expected))


def test_merged_sentences_equal_a_loop(spark):
    rng = random.Random(3)
    lists = [["x" * rng.choice([3, 10, 19, 20, 40]) + str(k) for k in range(rng.randint(0, 9))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(lists)), "k int, p array<string>")
    for r in df.select("k", training_text.merge_short(F.col("p")).alias("m")).collect():
        done = []
        for part in lists[r["k"]]:
            if done and len(part) < 20:
                done[-1] += " " + part
            else:
                done.append(part)
        assert r["m"] == done


def test_logs(tmp_path):
    path = f"{tmp_path}/a/x.log"
    log = logs.logger("scrubwell.test", path)
    assert logs.logger("scrubwell.test", path) is log and len(log.handlers) == 2
    log.debug("written")
    text = open(path).read()
    assert "DEBUG" in text and "written" in text
    assert logs.clock(0).tm_hour == 9


def test_command_line_from_notes_to_predictions(spark, tmp_path):
    path = str(tmp_path)
    text = "Admission Date: [**2177-12-5**]\n[**Known firstname {0}**] [**Known lastname {0}**] is a 40 yo man with fever. One. Two. Three. Four. Seen on [**4-5**]."
    rows_ = [(k, k % 7, *[None] * 4, "Physician " if k % 2 else "Nursing", *[None] * 3, text.format(k)) for k in range(60)]
    writers.write_csv(spark.createDataFrame(rows_, schemas.NOTE_EVENTS), f"{path}/notes")
    for side, listed in (("first", surrogates.POOLS["first"]), ("last", surrogates.POOLS["last"])):
        writers.write_csv(spark.createDataFrame([(n,) for n in listed], "name string"), f"{path}/{side}", header=False)
    writers.write_tsv(spark.createDataFrame([("fever", "C1", "FEVER", "dsyn")], "term string, cui string, preferred_name string, semtype string"), f"{path}/terms")
    (tmp_path / "samples.txt").write_text("[CLS] ada dale is a man with fever\nnone\n[CLS] x y z is a fever case\n")
    small = [x for c in subsets.CODES for x in ("--size", f"{c}=5")]
    main(["build", f"{path}/notes", f"{path}/corpus"], spark)
    main(["flags", *small, f"{path}/corpus", f"{path}/halves"], spark)
    main(["split", f"{path}/halves", f"{path}/split"], spark)
    main(["training-text", f"{path}/halves", f"{path}/text"], spark)
    main(["mentions", f"{path}/halves", f"{path}/first", f"{path}/last", f"{path}/mentions"], spark)
    main(["gold", f"{path}/mentions/half=hospital/code=c1p2", f"{path}/terms", f"{path}/gold"], spark)
    main(["predictions", f"{path}/samples.txt", f"{path}/terms", f"{path}/first", f"{path}/last", f"{path}/pred"], spark)
    halves = spark.read.parquet(f"{path}/halves")
    assert halves.count() == 60 and halves.filter("in_train_1M").count() == 10 and halves.filter("not all_placeholders_replaced").count() == 0
    assert "HADM_ID" not in halves.columns and halves.filter("TEXT_WITH_DUMMY_PHI_HOSPITAL like '%on 4/5.%' and TEXT_WITH_DUMMY_PHI_HOSPITAL like '%12/5/2017%'").count() == 60
    assert spark.read.text(f"{path}/text").filter("anonymity = 'hipaa' and half = 'shadow' and code = 'c1p2'").count() > 0
    assert readers.read_tsv(spark, f"{path}/gold/names", "document_id long, subject_id long, patient_full_name string, full_name_mention string").count() > 0
    got = {(r["sample_index"], r["patient_full_name"], r["cui"], r["is_valid_full_name"]) for r in readers.read_tsv(spark, f"{path}/pred", "patient_full_name string, cui string, preferred_name string, sample_index long, is_valid_full_name boolean").collect()}
    assert got == {(0, "Ada Dale", "C1", True), (2, "X Y Z", "C1", False)}
    (tmp_path / "k.csv").write_text('1,"a [**X 1**] b"\n')
    (tmp_path / "m.csv").write_text("[**X 1**],old\n[**X 1**],new\n")
    main(["fill", f"{path}/k.csv", f"{path}/m.csv", f"{path}/filled"], spark)
    assert readers.read_csv(spark, f"{path}/filled", schemas.INDEXED_TEXT, header=False).collect()[0]["TEXT"] == "a new b"
