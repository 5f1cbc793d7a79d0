"""The manifest, the line filter and the files by time, against plain Python."""

import glob
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from scrubwell.llm import line_dedup, merkle, queries, time_parts
from scrubwell.llm.common import scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, changed string, kept_text string, n long, root string"


def rows_of(n, seed=1):
    r = random.Random(seed)
    lines = [f"Line {k}" for k in range(60)] + ["", "  ", "LINE 1", "\tline 1 ", "é", "x" * 30_000]
    found = []
    for i in range(n):
        text = "\n".join(r.choice(lines) for _ in range(r.randint(1, 9)))
        found.append((i, r.choice([text, text, text, "", None]), r.choice(["en", None]), r.choice(["a", "a", "a", "a", "b", "é", None, ""]), i))
    return [*found, found[3], found[3], (None, "a\nb", "en", "a", None), (None, "a\nb", "en", "a", None), (-7, "one\n", None, "alone", 4)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*x, "n", "c", "k", 1, "r") for x in rows_of(2_500)], DOCS).cache()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root and the siblings of every leaf, level by level."""
    level, paths, proofs = nodes, list(range(len(nodes))), [[] for _ in nodes]
    while len(level) > 1:
        for k, p in enumerate(paths):
            run = p // 3 * 3
            proofs[k].append((level[run:p], level[p + 1 : run + 3]))
        paths, level = [p // 3 for p in paths], [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], proofs


def expected_manifest(rows):
    by = defaultdict(list)
    for i, text, lang, source, n in rows:
        changed = text
        if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0:
            changed = text.replace("\n", "")
        by[source].append((i, leaf(i, source, lang, n, text), leaf(i, source, lang, n, changed)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    made = {s: tree([x[1] for x in by[s]]) for s in order}
    root, tops = tree([made[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (i, own, changed), proof in zip(by[s], made[s][1], strict=True):
            folded = changed
            for left, right in proof + top:
                folded = sha("".join([*left, folded, *right]))
            out.append((i, own, made[s][0], root, sha("".join(x for side in proof + top for part in side for x in part)), folded, folded == root))
    return out


@pytest.mark.parametrize("n", [0, 1, 45, 2_505])
def test_manifest(spark, docs, n):
    rows = rows_of(2_500) if n > 2_500 else rows_of(40)[:n]
    df = docs if n > 2_500 else spark.createDataFrame([(*x, "n", "c", "k", 1, "r") for x in rows], DOCS)
    got = [tuple(r) for r in merkle.checked(df).collect()]
    assert Counter(got) == Counter(expected_manifest(rows) if n else [])


def test_manifest_folds_to_the_root(docs):
    got = merkle.manifest(docs).select(F.countDistinct("root").alias("roots"), F.bool_and(merkle.fold(F.col("leaf"), F.col("steps")) == F.col("root")).alias("all")).first()
    assert got["roots"] == 1 and got["all"]


def expected_lines(texts, min_docs, min_chars=1):
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    split = [(t or "").split("\n") for t in texts]
    n = Counter(k for lines in split for k in {key(x) for x in lines})
    gone = {k for k in n if n[k] >= min_docs and len(k) >= min_chars}
    kept = [[x for x in lines if key(x) not in gone] for lines in split]
    return [("\n".join(k), len(lines), len(lines) - len(k)) for k, lines in zip(kept, split, strict=True)]


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0}, {"max_bits": 1 << 8}, {"min_chars": 2}, {"min_docs": 2}])
def test_lines(spark, options):
    rows = rows_of(300) + [(9_000 + k, f"only twice {k // 2}\nonce {k}", "en", "a", 1) for k in range(40)]
    df = spark.createDataFrame([(*x, "n", "c", "k", 1, "r") for x in rows], DOCS)
    got = line_dedup.drop_lines(df, **({"min_docs": 10} | options)).collect()
    want = expected_lines([x[1] for x in rows], options.get("min_docs", 10), options.get("min_chars", 1))
    assert Counter((r["doc_id"], r["text"], r["kept_text"], r["n_lines"], r["n_dropped"], r["root"]) for r in got) == Counter((x[0], x[1], *w, "r") for x, w in zip(rows, want, strict=True))


def test_first_lines_stay(spark):
    rows = [(3, "b\na\nA"), (1, "x\na \na"), (2, None), (None, "a"), (4, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for held in (10, 0):
        got = {r["doc_id"]: r["kept_text"] for r in line_dedup.drop_lines(df, min_docs=2, keep="first", broadcast_rows=held).collect()}
        assert got == {3: "b", 1: "x\na ", 2: "", None: "", 4: "c"}
    assert line_dedup.drop_lines(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.drop_lines(df, keep="last")


CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, leaf string, part int"


def clicks_of(n, seed=3):
    r, start, found = random.Random(seed), datetime(2024, 1, 1), []
    for i in range(n):
        ts = start + timedelta(seconds=r.random() ** 3 * 140 * 86_400)
        found.append((i, None if r.random() < 0.05 else ts, None if r.random() < 0.02 else ts + timedelta(seconds=r.randint(0, 90_000)), r.choice("ab"), "l", 1))
    hot = datetime(2024, 2, 5, 7, 30)
    return [*found, *found[:25], *[(n + k, hot, hot, "h", "l", 1) for k in range(n // 3)], (None, hot, None, "x", "l", 2), (None, None, None, None, None, None)]


def moment(i, ts):
    if ts is None or i is None:
        return ts
    k = zlib.crc32(str(i).encode()) % 128
    if k < 16:
        return ts - timedelta(days=(k + 6) ** 3)
    if k > 111:
        day = datetime(ts.year, ts.month, ts.day)
        return day - timedelta(days=day.weekday())
    return ts


def expected_layout(rows, limit):
    """Leaf and part of every row, by walking the calendar."""
    moments = [(moment(r[0], r[1]), r) for r in rows]
    found = [("null", sorted((x for x in moments if x[0] is None), key=sort_key))]

    def walk(held, level, parents, members):
        of = [(m, [x for x in held if (x[0].year, x[0].month, x[0].day, x[0].hour)[level] == m]) for m in members]
        open_run = []

        def close():
            if open_run and any(x for _, x in open_run):
                rows_in = sorted((y for _, x in open_run for y in x), key=sort_key)
                label = lambda m: f"{m:04d}" if level == 0 else f"{m:02d}"
                found.append(("/".join([*parents, f"{label(open_run[0][0])}-{label(open_run[-1][0])}"]), rows_in))
            open_run.clear()

        for m, x in of:
            if len(x) > limit:
                close()
                name = [*parents, f"{m:04d}" if level == 0 else f"{m:02d}"]
                if level == 3:
                    open_run.append((m, x))
                    close()
                elif level == 0:
                    walk(x, 1, name, range(1, 13))
                elif level == 1:
                    after = datetime(int(parents[0]) + m // 12, m % 12 + 1, 1)
                    walk(x, 2, name, range(1, (after - timedelta(days=1)).day + 1))
                else:
                    walk(x, 3, name, range(24))
                continue
            if open_run and sum(len(y) for _, y in open_run) + len(x) > limit:
                close()
            open_run.append((m, x))
        close()

    dated = [x for x in moments if x[0] is not None]
    if dated:
        years = [x[0].year for x in dated]
        walk(dated, 0, [], range(min(years), max(years) + 1))
    return {(leaf, k // limit + 1): [x[1] for x in held[k : k + limit]] for leaf, held in found for k in range(0, len(held), limit)}


def sort_key(x):
    low = lambda v: (v is not None, v or 0) if not isinstance(v, datetime) else (True, v)
    none = (False, datetime.min)
    return (low(x[0]) if x[0] is not None else none, low(x[1][2]) if x[1][2] is not None else none, low(x[1][0]))


@pytest.mark.parametrize("n", [0, 700])
def test_files_by_time(spark, n):
    rows = clicks_of(n) if n else []
    df = spark.createDataFrame(rows, CLICKS)
    path, before, limit = scratch_path(spark, "clicks"), datetime(2024, 3, 1), 1 + len(rows) // 50
    got = time_parts.relaid(df, path, before=str(before), parts=50).collect()
    early = [r for r in rows if r[2] is not None and r[2] < before]
    start, end = expected_layout(early, limit), expected_layout(rows, limit)
    assert {(r["leaf"], r["part"]) for r in got} == set(end) and len(got) == len(end)
    for r in got:
        want = end[r["leaf"], r["part"]]
        assert r["n_rows"] == len(want) and r["columns"] == "click_id,ts,arrived_at,kind,leaf,part"
        assert r["ids_sha256"] == sha(",".join("null" if x[0] is None else str(x[0]) for x in want))
        assert r["n_new"] == sum(x[2] is None or x[2] >= before for x in want)
        same = Counter(start.get((r["leaf"], r["part"]), [])) == Counter(want)
        assert r["rewritten"] == (not same)
        there = pq.ParquetFile(r["path"].removeprefix("file:")).read()
        assert there.column_names == ["click_id", "ts", "arrived_at", "kind", "leaf", "part"] and there.column("click_id").to_pylist() == [x[0] for x in want]
    on_disk = [f for f in glob.glob(f"{path}/**/*.parquet", recursive=True)]
    assert len(on_disk) == len(end)
    if n:
        assert any(r["rewritten"] for r in got) and not all(r["rewritten"] for r in got) and sum("/" in r["leaf"] for r in got) > 10
        # a rewrite of the same rows changes nothing, and a torn one is mended
        torn = sorted(on_disk)[0]
        (glob_path := open(torn.replace(".parquet", "-copy.parquet"), "wb")).write(open(torn, "rb").read())
        glob_path.close()
        again = time_parts.rewrite(df, path, time_parts.moved(F.col("ts"), F.col("click_id")), ["arrived_at", "click_id"], limit)
        assert len(again.stayed) == len(end) == len(glob.glob(f"{path}/**/*.parquet", recursive=True))


def test_runs():
    counts = {1: 3, 3: 9, 4: 2, 6: 3, 7: 1}
    assert time_parts.runs(list(range(1, 9)), counts, 5) == ([[1, 2], [4, 5, 6], [7, 8]], [3])
    assert time_parts._label(0, 2005, 2007) == "2005-2007" and time_parts._label(3, 2024030507, 2024030507) == "2024/03/05/07-07"


@pytest.mark.parametrize("name", ["op11_merkle", "op12_line_dedup"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    result = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(columns)
    assert Counter(str([r[c] for c in columns]) for r in got.collect()) == Counter(str(list(r)) for r in result.fetchall())
