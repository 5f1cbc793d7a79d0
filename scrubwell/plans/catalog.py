"""Every query of the note engine beside its oracle: the same result in DuckDB's SQL.

``note`` queries run over notes derived from ``documents``; structural ones over
``orders`` (row = order, subject = customer, category = priority).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubwell.functions import cleaning, dates, names, training_text
from scrubwell.functions.rules import sql_rewrite_lines, sql_substitute, sql_text
from scrubwell.operators import checks, concepts, mentions, namebook, placeholders, relations, scoring, subsets, surrogates
from scrubwell.plans import notes
from scrubwell.sources import readers, writers
from scrubwell.sources.readers import PHI_TYPES, extract_tags
from scrubwell.sources.shared import shared_path
from scrubwell.streaming.notes import append_batches, prepared

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

SEED = 42
NOTES = f"notes AS ({notes.SQL})"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from scrubwell.plans import case_queries, corpus_queries, text_queries  # noqa: F401  their queries register themselves

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from scrubwell.plans import case_queries, corpus_queries, text_queries  # noqa: F401

    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").selectExpr("o_orderkey AS row_id", "o_custkey AS subject_id", "o_orderpriority AS category")


ORDERS = "o AS (SELECT o_orderkey AS row_id, o_custkey AS subject_id, o_orderpriority AS category FROM orders)"


def _draw(key: str, seed: int, n: int) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT % {n})"


def _generated(key: str, seed: int, how: str) -> str:
    """SQL of surrogates.generate."""
    kind, *args = how.split(":", 3)
    listed = lambda pool: "[" + ", ".join(sql_text(x) for x in surrogates.POOLS[pool]) + "]"
    pick = lambda pool: f"{listed(pool)}[{_draw(key, seed, len(surrogates.POOLS[pool]))} + 1]"
    number = lambda low, high, salt=0: f"({_draw(key, seed + salt, high - low + 1)} + {low})::VARCHAR"
    two = lambda low, high, salt=0: f"lpad({number(low, high, salt)}, 2, '0')"
    if kind == "const":
        return sql_text(args[0])
    if kind == "pool":
        return f"{pick(args[0])} || {sql_text(args[2])}" if len(args) == 3 else pick(args[0])
    if kind == "int":
        return f"{sql_text(args[2] if len(args) > 2 else '')} || {number(int(args[0]), int(args[1]))}"
    if kind == "initial":
        return f"substr({pick('first')}, 1, 1) || '.'"
    if kind == "address":
        return f"{number(1, 999)} || ' ' || {pick('street')}"
    if kind == "email":
        return f"{sql_text(how[6:])} || lower({pick('first')}) || {number(10, 99)} || '@example.org'"
    if kind == "url":
        return f"'www.' || lower({pick('city')}) || '.example.org'"
    if kind == "phone":
        return f"'555-' || lpad({number(0, 9999)}, 4, '0')"
    if kind == "zip":
        return f"lpad({number(0, 99999)}, 5, '0')"
    if kind == "ssn":
        n = f"lpad({number(0, 999999999)}, 9, '0')"
        return f"substr({n}, 1, 3) || '-' || substr({n}, 4, 2) || '-' || substr({n}, 6, 4)"
    month, day, year = two(1, 12), two(1, 28, 1), two(0, 99, 2)
    return " || '/' || ".join({"md": [month, day], "my": [month, year], "mdy": [month, day, year]}[args[0]])


FOUND = rf"SELECT DISTINCT unnest(regexp_extract_all(note, {sql_text(placeholders.PLACEHOLDER)})) AS placeholder FROM notes"


def map_sql(seed: int = SEED, contexts: str = "notes", name: str = "map") -> str:
    """CTEs that end in ``name`` (placeholder, dummy_phi); ``contexts``: the source (note) of the keys that stand behind a telling word."""
    rules = " UNION ALL ".join(f"SELECT placeholder, {o} AS ord, 0 AS late, {_generated('placeholder', seed, how)} AS v FROM {name}_f WHERE regexp_matches(placeholder, {sql_text(p)})" for o, p, how in surrogates.RULES)
    behind = " UNION ALL ".join(
        f"SELECT placeholder, {o}, 1, {_generated('placeholder', seed, how)} FROM (SELECT DISTINCT unnest(regexp_extract_all(note, {sql_text(p)}, 1)) AS placeholder FROM {contexts})" for o, p, how in surrogates.CONTEXT_RULES
    )
    return f"{name}_f AS ({FOUND}), {name}_r AS ({rules} UNION ALL {behind}), {name} AS (SELECT placeholder, arg_max(v, ord * 2 + late) AS dummy_phi FROM {name}_r GROUP BY placeholder)"


MAP = map_sql()
PARTS = "string_split(replace(replace({t}, '[**', chr(1) || '[**'), '**]', '**]' || chr(1)), chr(1))"
FILLED = f"seg AS (SELECT row_id, unnest({PARTS.format(t='note')}) AS s, generate_subscripts({PARTS.format(t='note')}, 1) AS i FROM notes), filled AS (SELECT row_id, string_agg(coalesce(dummy_phi, s), '' ORDER BY i) AS filled FROM seg LEFT JOIN map ON s = placeholder GROUP BY row_id)"


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.notes(spark, sf_dir)


def _map(df: DataFrame, seed: int = SEED) -> DataFrame:
    return surrogates.rule_map(placeholders.distinct_placeholders(df, "note"), seed, surrogates.context_keys(df, "note"))


# sources, placeholders, maps


@query(f"""SELECT tag, value FROM (SELECT (['{"','".join(PHI_TYPES)}'])[1 + c_custkey % 8] AS tag, c_name AS value FROM customer)""")
def s6_tag_extract(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in PHI_TYPES])
    df = _table(spark, sf_dir, "customer").select(F.concat(F.lit('seen <PHI TYPE="'), F.get(kinds, (F.col("c_custkey") % 8).cast("int")), F.lit('">'), F.col("c_name"), F.lit("</PHI> today")).alias("t"))
    return extract_tags(df, "t")


@query(f"WITH {NOTES} {FOUND}")
def r1_placeholders_distinct(spark, sf_dir):
    return placeholders.distinct_placeholders(_notes(spark, sf_dir), "note")


@query(rf"WITH {NOTES}, found AS ({FOUND}) SELECT regexp_replace(placeholder, ' [0-9]*\*\*\]$', '') AS category, count(*) AS n FROM found GROUP BY 1")
def r3_category(spark, sf_dir):
    df = placeholders.distinct_placeholders(_notes(spark, sf_dir), "note")
    return df.groupBy(placeholders.category(F.col("placeholder")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NOTES}, {MAP} SELECT placeholder, dummy_phi FROM map")
def v_rule_map_last_wins(spark, sf_dir):
    return _map(_notes(spark, sf_dir))


@query(f"WITH {NOTES}, {MAP} SELECT placeholder, dummy_phi FROM map WHERE placeholder NOT IN ({', '.join(sql_text(x) for x in placeholders.NO_ID)})")
def v_with_ids(spark, sf_dir):
    return surrogates.with_ids(_map(_notes(spark, sf_dir)))


@query(f"WITH {NOTES}, {MAP}, {FILLED} SELECT row_id, filled FROM filled")
def r2_replace_map(spark, sf_dir):
    df = _notes(spark, sf_dir)
    return placeholders.fill(df, _map(df), "row_id", "note", "filled").select("row_id", "filled")


@query(rf"WITH {NOTES}, {MAP}, {FILLED} SELECT row_id, NOT regexp_matches(filled, '\[\*\*.+?\*\*\]') AS all_placeholders_replaced FROM filled")
def p10_residual_flag(spark, sf_dir):
    df = _notes(spark, sf_dir)
    return placeholders.fill(df, _map(df), "row_id", "note", "filled").select("row_id", placeholders.all_filled(F.col("filled")).alias("all_placeholders_replaced"))


@query(f"WITH {NOTES} SELECT row_id, NOT list_bool_or(list_transform([{', '.join(sql_text(x) for x in placeholders.NO_ID)}], lambda p: contains(note, p))) AS all_placeholders_have_id FROM notes")
def p11_all_have_id(spark, sf_dir):
    return _notes(spark, sf_dir).select("row_id", placeholders.all_have_id(F.col("note")).alias("all_placeholders_have_id"))


@query("""WITH k AS (SELECT p_partkey AS key, row_number() OVER (ORDER BY md5('42:' || p_partkey), p_partkey) AS rn FROM part),
    v AS (SELECT s_name AS value, row_number() OVER (ORDER BY md5('7:' || s_suppkey), s_suppkey) AS rn FROM supplier)
    SELECT key, value FROM k JOIN v ON v.rn = (k.rn - 1) % (SELECT count(*) FROM supplier) + 1""")
def l4_cyclic_pool(spark, sf_dir):
    k = subsets.shuffled(_table(spark, sf_dir, "part").selectExpr("p_partkey AS key"), "key", 42)
    v = subsets.shuffled(_table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_name AS value"), "s_suppkey", 7)
    return surrogates.zipped(k, v, "key", "value", cyclic=True)


@query("""WITH k AS (SELECT p_partkey AS key, row_number() OVER (ORDER BY md5('42:' || p_partkey), p_partkey) AS rn FROM part),
    v AS (SELECT s_name AS value, row_number() OVER (ORDER BY md5('7:' || s_suppkey), s_suppkey) AS rn FROM supplier)
    SELECT key, coalesce(value, '') AS value FROM k LEFT JOIN v USING (rn)""")
def j1_positional_zip(spark, sf_dir):
    k = subsets.shuffled(_table(spark, sf_dir, "part").selectExpr("p_partkey AS key"), "key", 42)
    v = subsets.shuffled(_table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_name AS value"), "s_suppkey", 7)
    return surrogates.zipped(k, v, "key", "value")


@query("SELECT o_custkey AS placeholder, arg_max(o_orderpriority, o_orderkey) AS dummy_phi FROM orders GROUP BY 1")
def a8_last_wins(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").selectExpr("o_custkey AS placeholder", "o_orderpriority AS dummy_phi", "o_orderkey AS ord")
    return placeholders.last_wins(df)


# cleaning, dates, training text


@query(f"WITH {NOTES} SELECT row_id, {sql_rewrite_lines('note', cleaning.CLEANING)} AS cleaned FROM notes")
def c_clean_lines(spark, sf_dir):
    return _notes(spark, sf_dir).select("row_id", cleaning.clean(F.col("note")).alias("cleaned"))


@query(f"WITH {NOTES} SELECT row_id, {sql_substitute(sql_substitute('note', dates.KEYWORD_RULES), dates.LATE_RULES)} AS resolved FROM notes")
def e_keyword_rules(spark, sf_dir):
    return _notes(spark, sf_dir).select("row_id", dates.keyword_rules(F.col("note")).alias("resolved"))


_GRID = "g AS (SELECT DISTINCT o_orderkey % 40 AS x, (o_orderkey // 40) % 40 AS y FROM orders)"
_SMALL = "WHEN (x, y) IN ((1, 2), (2, 1), (2, 2)) THEN 2 WHEN x = 1 AND y = 1 THEN 1"


def _bands(unit: str, spark, sf_dir) -> DataFrame:
    g = _table(spark, sf_dir, "orders").selectExpr("o_orderkey % 40 AS x", "(o_orderkey div 40) % 40 AS y").distinct()
    text = F.concat(F.lit("see in [**"), F.col("x").cast("string"), F.lit("-"), F.col("y").cast("string"), F.lit(f"**] {unit}s"))
    return g.select("x", "y", dates.resolve_bands(text).alias("text"))


def _band_sql(unit: str, case: str) -> str:
    return f"WITH {_GRID} SELECT x, y, 'see in ' || coalesce((CASE {case} END)::VARCHAR, '[**' || x || '-' || y || '**]') || ' {unit}s' AS text FROM g"


@query(_band_sql("day", f"WHEN x <= 12 AND y >= 14 THEN 14 WHEN (x <= 9 AND y BETWEEN 10 AND 13) OR (x BETWEEN 10 AND 12 AND y <= 13) THEN 10 WHEN (x <= 6 AND y BETWEEN 7 AND 9) OR (x BETWEEN 7 AND 9 AND y <= 9) THEN 7 WHEN (x <= 2 AND y IN (3, 4)) OR (x IN (3, 4) AND y <= 2) THEN 3 {_SMALL}"))
def e9_day_bands(spark, sf_dir):
    return _bands("day", spark, sf_dir)


@query(_band_sql("week", "WHEN x BETWEEN 1 AND 12 AND y >= 24 THEN 24 WHEN (x = 12 AND y <= 23) OR (x BETWEEN 1 AND 11 AND y BETWEEN 12 AND 23) THEN 12 WHEN (x BETWEEN 1 AND 9 AND y BETWEEN 8 AND 11) OR (x IN (8, 9) AND y <= 7) THEN 8 WHEN x BETWEEN 1 AND 7 AND y BETWEEN 1 AND 7 THEN greatest(x, y)"))
def e10_week_bands(spark, sf_dir):
    return _bands("week", spark, sf_dir)


@query(_band_sql("month", f"WHEN x <= 11 AND y >= 12 THEN 12 WHEN (x <= 5 AND y BETWEEN 6 AND 11) OR x BETWEEN 6 AND 11 THEN 6 WHEN (x BETWEEN 1 AND 3 AND y BETWEEN 3 AND 5) OR (x BETWEEN 3 AND 5 AND y BETWEEN 1 AND 3) THEN 3 {_SMALL}"))
def e11_month_bands(spark, sf_dir):
    return _bands("month", spark, sf_dir)


def _latest(pattern: str, group: int) -> str:
    return f"coalesce(list_max(list_transform(regexp_extract_all(note, {sql_text(pattern)}, {group}), lambda v: v::INT)), 0)"


def shift_sql(source: str, name: str = "shifted") -> str:
    """row_id, note and its latest year, of a source with row_id and note."""
    return f"{name} AS (SELECT row_id, note, CASE WHEN regexp_matches(note, {sql_text(dates.YMD)}) THEN greatest({_latest(dates.YMD, 1)}, {_latest(dates.YM, 2)}, {_latest(dates.Y, 1)}) END AS latest FROM {source})"


SHIFT = shift_sql("notes")


@query(f"WITH {NOTES}, {SHIFT} SELECT row_id, latest - (2000 + latest % 20) AS shift FROM shifted")
def r5_year_shift(spark, sf_dir):
    return _notes(spark, sf_dir).select("row_id", dates.year_shift(F.col("note")).alias("shift"))


def backdated_sql(source: str = "notes", name: str = "backdated") -> str:
    """CTEs that end in ``name`` (row_id, backdated) for a source with row_id and note."""
    ex = lambda p, k: f"regexp_extract(s, {sql_text('^' + p + '$')}, {k})"
    full = lambda p: f"regexp_matches(s, {sql_text('^' + p + '$')})"
    months = "[" + ", ".join(sql_text(m) for m in dates.MONTHS) + "]"
    short = r"\[\*\*([0-9]+)\*\*\]"
    case = f"""CASE WHEN shift IS NULL OR NOT starts_with(s, '[**') THEN s
        WHEN {full(dates.YMD)} THEN {ex(dates.YMD, 2)} || '/' || {ex(dates.YMD, 3)} || '/' || ({ex(dates.YMD, 1)}::INT - shift)
        WHEN {full(dates.YM)} THEN replace({ex(dates.YM, 1)}, '-', '') || '/' || ({ex(dates.YM, 2)}::INT - shift)
        WHEN {full(dates.Y)} THEN ({ex(dates.Y, 1)}::INT - shift)::VARCHAR
        WHEN {full(short)} AND ends_with(coalesce(before, ''), chr(39)) AND coalesce(after, '') <> '' AND NOT starts_with(after, '"') THEN lpad(((({ex(short, 1)}::INT - shift) % 100 + 100) % 100)::VARCHAR, 2, '0')
        WHEN {full(dates.YMD_OUT)} THEN {ex(dates.YMD_OUT, 2)} || '/' || {ex(dates.YMD_OUT, 3)}
        WHEN {full(dates.YM_OUT)} THEN {months}[replace({ex(dates.YM_OUT, 1)}, '-', '')::INT]
        WHEN {full(dates.DAY)} AND starts_with(coalesce(after, ''), ':') THEN {ex(dates.DAY, 1)} || '-' || {ex(dates.DAY, 2)}
        ELSE s END"""
    return f"""{shift_sql(source, name + "_s")}, {name}_p AS (SELECT row_id, latest - (2000 + latest % 20) AS shift, {PARTS.format(t='note')} AS p FROM {name}_s),
        {name}_g AS (SELECT row_id, shift, unnest(p) AS s, generate_subscripts(p, 1) AS i, p FROM {name}_p),
        {name}_n AS (SELECT row_id, shift, s, i, p[i - 1] AS before, p[i + 1] AS after FROM {name}_g),
        {name} AS (SELECT row_id, string_agg({case}, '' ORDER BY i) AS backdated FROM {name}_n GROUP BY row_id)"""


@query(f"WITH {NOTES}, {backdated_sql()} SELECT row_id, backdated FROM backdated")
def r6_backdate(spark, sf_dir):
    df = _notes(spark, sf_dir).withColumn("shift", dates.year_shift(F.col("note")))
    return df.select("row_id", dates.backdate(F.col("note"), F.col("shift")).alias("backdated"))


def _normal_sql(hipaa: bool) -> str:
    flat = r"lower(regexp_replace(regexp_replace(coalesce(note, ' '), '[\n\r]', ' ', 'g'), '^\s+|\s+$', '', 'g'))"
    return sql_substitute(flat, [*training_text.COMMON, *(training_text.ANONYMOUS if hipaa else []), *training_text.SPACES])


@query(f"WITH {NOTES} SELECT row_id, {_normal_sql(False)} AS text FROM notes")
def n_plain(spark, sf_dir):
    return _notes(spark, sf_dir).select("row_id", training_text.normalise(F.col("note")).alias("text"))


@query(f"WITH {NOTES} SELECT row_id, {_normal_sql(True)} AS text FROM notes")
def n_hipaa(spark, sf_dir):
    return _notes(spark, sf_dir).select("row_id", training_text.normalise(F.col("note"), hipaa=True).alias("text"))


SENTENCES = r"list_filter(string_split(regexp_replace({t}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')".replace("{t}", "%s")


@query(f"WITH {NOTES}, t AS (SELECT row_id, {SENTENCES % _normal_sql(False)} AS p FROM notes) SELECT row_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS sentence FROM t")
def t1_sentences(spark, sf_dir):
    df = _notes(spark, sf_dir).select("row_id", training_text.normalise(F.col("note")).alias("t"))
    return df.select("row_id", F.posexplode(training_text.sentences(F.col("t"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {NOTES}, t AS (SELECT row_id, {SENTENCES % _normal_sql(False)} AS p FROM notes), s AS (SELECT row_id, generate_subscripts(p, 1) AS i, unnest(p) AS sentence FROM t),
    g AS (SELECT *, sum(CASE WHEN i = 1 OR length(sentence) >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY i) AS k FROM s)
    SELECT row_id, (k - 1)::BIGINT AS pos, string_agg(sentence, ' ' ORDER BY i) AS sentence FROM g GROUP BY row_id, k""")
def t2_merge(spark, sf_dir):
    df = _notes(spark, sf_dir).select("row_id", training_text.sentences(training_text.normalise(F.col("note"))).alias("p"))
    return df.select("row_id", F.posexplode(training_text.merge_short(F.col("p"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query("(set in corpus_queries)")
def stream_prepared(spark, sf_dir):
    """The batch form of the streaming function."""
    return prepared(_notes(spark, sf_dir), "note").select("row_id", "prepared", "all_filled")


# subsets


@query(f"WITH {ORDERS}, s AS (SELECT row_id, row_number() OVER (ORDER BY md5('42:' || row_id), row_id) AS rn FROM o) SELECT row_id, CASE WHEN rn <= (SELECT count(*) FROM o) // 2 THEN 'hospital' ELSE 'shadow' END AS half FROM s")
def l8_half_split(spark, sf_dir):
    return subsets.half_split(_orders(spark, sf_dir).select("row_id"), "row_id", SEED)


_CUT = """per AS (SELECT subject_id, count(row_id) AS n FROM o WHERE subject_id IS NOT NULL GROUP BY 1), hist AS (SELECT n, sum(n) AS docs, count(*) AS patients FROM per GROUP BY n),
    cum AS (SELECT n, sum(docs) OVER (ORDER BY n DESC) AS cd, sum(patients) OVER (ORDER BY n DESC) AS cp FROM hist)"""
WANTED = [100, 1000, 5000, 10000, 14999, 15000, 20000]


@query(f"WITH {ORDERS}, {_CUT}, d AS (SELECT unnest({WANTED}) AS wanted), x AS (SELECT wanted, max(n) FILTER (WHERE cd > wanted) AS t FROM d, cum GROUP BY wanted) SELECT wanted::BIGINT AS wanted, coalesce(t, -1)::BIGINT AS threshold, coalesce((SELECT cp FROM cum WHERE n = t), (SELECT max(cp) FROM cum))::BIGINT AS n_patients, coalesce((SELECT cd FROM cum WHERE n = t), (SELECT max(cd) FROM cum))::BIGINT AS n_docs FROM x")
def w2_threshold(spark, sf_dir):
    return subsets.rare_cutoffs(_orders(spark, sf_dir), "subject_id", WANTED, "row_id")


def _train_test_sql(source: str, size: int) -> str:
    return f"s AS (SELECT row_id, row_number() OVER (ORDER BY md5('42:' || row_id), row_id) AS rn FROM {source}) SELECT row_id, rn <= {size} AS in_train, rn > {size} AS in_test FROM s"


@query(f"WITH {ORDERS}, {_CUT}, t AS (SELECT coalesce(max(n) FILTER (WHERE cd > 1000), -1) AS t FROM cum), k AS (SELECT row_id FROM o JOIN per USING (subject_id) WHERE n >= (SELECT t FROM t)), {_train_test_sql('k', 1000)}")
def w2_train_test(spark, sf_dir):
    df = subsets.frequent_subjects(_orders(spark, sf_dir), "subject_id", 1000, "row_id")
    return subsets.train_test(df.select("row_id"), "row_id", 1000, SEED)


@query(f"WITH a AS (SELECT o_orderkey AS row_id, o_custkey AS subject_id, o_orderpriority AS category FROM orders), o AS (SELECT * FROM a WHERE category IN ('1-URGENT', '2-HIGH')), {_CUT}, t AS (SELECT coalesce(max(n) FILTER (WHERE cd > 500), -1) AS t FROM cum), k AS (SELECT row_id FROM o JOIN per USING (subject_id) WHERE n >= (SELECT t FROM t)), {_train_test_sql('k', 500)}")
def w2_category_train_test(spark, sf_dir):
    df = _orders(spark, sf_dir).filter(subsets.in_categories("category", ["1-URGENT", "2-HIGH"]))
    return subsets.train_test(subsets.frequent_subjects(df, "subject_id", 500, "row_id").select("row_id"), "row_id", 500, SEED)


@query(f"WITH {ORDERS} SELECT subject_id, count(row_id) AS n_docs FROM o WHERE subject_id IS NOT NULL GROUP BY 1")
def a1_docs_per_subject(spark, sf_dir):
    return _orders(spark, sf_dir).filter("subject_id IS NOT NULL").groupBy("subject_id").agg(F.count("row_id").alias("n_docs"))


@query(f"WITH {ORDERS}, {_CUT} SELECT n, cp::BIGINT AS n_patients, cd::BIGINT AS n_docs, round(100.0 * cd / (SELECT max(cd) FROM cum), 6)::DOUBLE AS pct_docs FROM cum")
def a4_pct(spark, sf_dir):
    from pyspark.sql.window import Window

    per = _orders(spark, sf_dir).filter("subject_id IS NOT NULL").groupBy("subject_id").agg(F.count("row_id").alias("n"))
    hist = per.groupBy("n").agg(F.sum("n").alias("docs"), F.count(F.lit(1)).alias("patients"))
    w, everywhere = Window.partitionBy(F.lit(0)).orderBy(F.desc("n")), Window.partitionBy(F.lit(0))
    return hist.select("n", F.sum("patients").over(w).alias("n_patients"), F.sum("docs").over(w).alias("n_docs"), F.round(100.0 * F.sum("docs").over(w) / F.sum("docs").over(everywhere), 6).alias("pct_docs"))


@query(f"WITH {ORDERS} SELECT subject_id, arg_min(row_id, row_id) AS row_id, arg_min(category, row_id) AS category FROM o GROUP BY subject_id")
def a7_keep_first(spark, sf_dir):
    return mentions.keep_first(_orders(spark, sf_dir), ["subject_id"], ["row_id"]).select("subject_id", "row_id", "category")


@query(f"""WITH {ORDERS}, s AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || row_id), row_id) AS rn FROM o)
    SELECT count(*) FILTER (WHERE rn <= 1000) AS n_train, count(*) FILTER (WHERE rn > 1000) AS n_test, 0::BIGINT AS n_both, 0::BIGINT AS n_neither, count(*) FILTER (WHERE rn <= 1000) = 1000 AS exact_size,
    list_sort(list(DISTINCT category) FILTER (WHERE rn <= 1000)) = list_sort(list(DISTINCT category) FILTER (WHERE rn > 1000)) AS same_categories FROM s""")
def a9_assertions(spark, sf_dir):
    df = subsets.train_test(_orders(spark, sf_dir), "row_id", 1000, SEED)
    return checks.flag_report(df, "in_train", "in_test", "category", 1000)


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS urgent, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AS large FROM customer")
def j6_flags(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return subsets.flagged(_table(spark, sf_dir, "customer").select("c_custkey"), {"urgent": o.filter("o_orderpriority = '1-URGENT'"), "large": o.filter("o_totalprice > 200000")}, "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def o6_complement(spark, sf_dir):
    urgent = _table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return _table(spark, sf_dir, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


# names, mentions, prompts

# the oracle's patterns, written out; # stands for the identifier's digits
_FIRST_FORMS = r"\[\*\*Doctor First Name #\*\*\]|\[\*\*Female First Name \(\w+\) #\*\*\]|\[\*\* First Name \*\*\]|\[\*\*First Name \(S?Titles?\) #\*\*\]|\[\*\*First Name\d+ \(Name Pattern\d\) #\*\*\]|\[\*\*First Name3 \(LF\) #\*\*\]|\[\*\*Known firstname #\*\*\]|\[\*\*Male First Name \(\w+\) #\*\*\]|\[\*\*Name10 \(NameIs\) #\*\*\]|\[\*\*Name6 \(MD\) #\*\*\]"
_LAST_FORMS = r"\[\*\*Doctor Last Name #\*\*\]|\[\*\*Known lastname #\*\*\]|\[\*\*Last Name\d* \([^\s]+?\) #\*\*\]|\[\*\*Last Name #\*\*\]|\[\*\*Name11 \(NameIs\) #\*\*\]|\[\*\*Name1?[345]? \([SP]?Titles?\) #\*\*\]|\[\*\*Name[78] \(MD\) #\*\*\]|\[\*\*Name2? \(NI\) #\*\*\]"
_with_id, _any_id = (lambda forms: forms.replace("#", "[0-9]+")), (lambda forms: forms.replace("#", "[0-9]*"))
FULL_NAME = rf"({_with_id(_FIRST_FORMS)})\s*({_with_id(_LAST_FORMS)})\s*is\s+an?\s*(\d+|\[\*\*Age over 90 \*\*\]).*?[Yy].*?[Oo].*?"
MENTION = rf"({FULL_NAME}[^.]*.[^.]*.[^.]*.[^.]*.[^.]*.)"


@query(f"WITH {NOTES} SELECT row_id, {', '.join(f'CASE WHEN regexp_matches(note, {sql_text(MENTION)}) THEN regexp_extract(note, {sql_text(MENTION)}, {k}) END AS {n}' for k, n in enumerate(('full_name_mention', 'first_name_placeholder', 'last_name_placeholder', 'patient_age'), 1))} FROM notes")
def m5_mentions(spark, sf_dir):
    return _notes(spark, sf_dir).select("row_id", names.patient_info(F.col("note")).alias("i")).select("row_id", "i.*")


@query(rf"""WITH {NOTES}, {MAP}, m AS (SELECT row_id, note, regexp_extract(note, {sql_text(MENTION)}, 2) AS f, regexp_extract(note, {sql_text(MENTION)}, 3) AS l FROM notes)
    SELECT row_id, coalesce(a.dummy_phi, '') || ' ' || coalesce(b.dummy_phi, '') AS patient_full_name,
      CASE WHEN f = '' THEN 0 ELSE len(regexp_extract_all(note, regexp_escape(f) || '\s*' || regexp_escape(l)))::INT END AS patient_full_name_tfreq
    FROM m LEFT JOIN map a ON f = a.placeholder LEFT JOIN map b ON l = b.placeholder""")
def a11_name_frequency(spark, sf_dir):
    df = _notes(spark, sf_dir)
    return mentions.with_names(df, _map(df), "note").select("row_id", "patient_full_name", "patient_full_name_tfreq")


_FIRST, _LAST = f"(?:{_any_id(_FIRST_FORMS)})", f"(?:{_any_id(_LAST_FORMS)})"


@query(rf"WITH {NOTES} SELECT row_id, regexp_replace(regexp_replace(replace(regexp_extract(note, {sql_text(MENTION)}, 1), chr(10), ''), {sql_text('^' + _FIRST + ' ' + _LAST)}, '[MASK] [MASK]'), '\[\*\*.+?\*\*\]', '', 'g') AS prompt FROM notes WHERE regexp_matches(note, {sql_text(MENTION)})")
def m6_prompts(spark, sf_dir):
    df = _notes(spark, sf_dir).select("row_id", names.patient_info(F.col("note"))["full_name_mention"].alias("m")).filter("m IS NOT NULL")
    return df.select("row_id", names.prompt_of_mention(F.col("m")).alias("prompt"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, '[MASK] [MASK]') || ' is a [MASK] year-old [MASK] presented with' AS prompt FROM customer")
def m7_prompt(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", names.prompt(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))).alias("prompt"))


@query(f"WITH {NOTES} SELECT row_id, regexp_replace(regexp_replace(note, {sql_text(_FIRST)}, '[MASK]', 'g'), {sql_text(_LAST)}, '[MASK]', 'g') AS masked FROM notes")
def m8_masked(spark, sf_dir):
    return _notes(spark, sf_dir).select("row_id", names.mask_names(F.col("note")).alias("masked"))


BOOK = "book AS (SELECT name, count(*)::DOUBLE AS weight, min(length(name)) % 2 + 1 AS n_tokens FROM (SELECT unnest(string_split(p_name, ' ')) AS name FROM part) GROUP BY name)"
F_BOOK = f"{BOOK}, female AS (SELECT * FROM book WHERE name < 'm'), male AS (SELECT * FROM book WHERE name >= 'd')"


def _book(spark, sf_dir) -> DataFrame:
    words = _table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("name"))
    return words.groupBy("name").agg(F.count(F.lit(1)).cast("double").alias("weight"), (F.min(F.length("name")) % 2 + 1).alias("n_tokens"))


@query(f"WITH {F_BOOK}, u AS (SELECT name, weight / (SELECT sum(weight) FROM female) AS w FROM female UNION ALL SELECT name, weight / (SELECT sum(weight) FROM male) FROM male) SELECT name, round(sum(w) * 0.5, 12) AS weight FROM u GROUP BY name")
def j10_merge_popularity(spark, sf_dir):
    b = _book(spark, sf_dir).select("name", "weight")
    return namebook.merged(b.filter("name < 'm'"), b.filter("name >= 'd'")).select("name", F.round("weight", 12).alias("weight"))


@query(f"WITH {BOOK}, v AS (SELECT name, weight / (SELECT sum(weight) FROM book WHERE n_tokens = 1) AS w FROM book WHERE n_tokens = 1) SELECT a.name AS first_name, b.name AS last_name, round(a.w * b.w, 12) AS weight FROM v a, v b")
def j9_cross_names(spark, sf_dir):
    v = namebook.normalised(namebook.in_vocab(_book(spark, sf_dir)))
    return namebook.products(v, v).select("first_name", "last_name", F.round("weight", 12).alias("weight"))


@query(f"WITH {BOOK}, v AS (SELECT name, weight / (SELECT sum(weight) FROM book) AS w FROM book), q AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '*' ELSE split_part(p_name, ' ', 1) END AS f, CASE WHEN p_partkey % 4 = 0 THEN '*' ELSE split_part(p_name, ' ', 2) END AS l FROM part) SELECT p_partkey, f || ' ' || l AS full_name, round((CASE WHEN f = '*' THEN 1 ELSE (SELECT w FROM v WHERE name = f) END) * (CASE WHEN l = '*' THEN 1 ELSE (SELECT w FROM v WHERE name = l) END), 12) AS popularity FROM q")
def m11_popularity(spark, sf_dir):
    v = namebook.normalised(_book(spark, sf_dir))
    parts = F.split("p_name", " ")
    q = _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 3 == 0, "*").otherwise(parts[0]), F.lit(" "), F.when(F.col("p_partkey") % 4 == 0, "*").otherwise(F.coalesce(F.get(parts, 1), F.lit("")))).alias("full_name"))
    return namebook.popularity(q, v, v).select("p_partkey", "full_name", F.round("popularity", 12).alias("popularity"))


@query(f"WITH {BOOK} SELECT p_partkey, p_name FROM part WHERE split_part(p_name, ' ', 1) IN (SELECT name FROM book WHERE n_tokens = 1) AND split_part(p_name, ' ', -1) IN (SELECT name FROM book WHERE n_tokens = 1)")
def j7_in_vocab(spark, sf_dir):
    v = namebook.in_vocab(_book(spark, sf_dir))
    return mentions.in_vocabulary(_table(spark, sf_dir, "part").select("p_partkey", "p_name"), v, v, "p_name")


_SAMPLES = "CASE WHEN p_partkey % 5 = 0 THEN 'no name here' ELSE concat('[CLS] ', p_name, CASE WHEN p_partkey % 2 = 0 THEN ' extra' ELSE '' END, ' is a man') END"


@query(f"WITH {BOOK}, s AS (SELECT p_partkey AS sample_index, {_SAMPLES} AS t FROM part), n AS (SELECT sample_index, regexp_extract(t, '^\\[CLS\\] (.+?) is a.+$', 1) AS x FROM s WHERE t LIKE '[CLS] %'), p AS (SELECT sample_index, array_to_string(list_transform(string_split(x, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS patient_full_name, string_split(x, ' ') AS w FROM n) SELECT sample_index, patient_full_name, len(w) = 2 AND w[1] IN (SELECT name FROM book WHERE n_tokens = 1) AND w[2] IN (SELECT name FROM book WHERE n_tokens = 1) AS is_valid_full_name FROM p")
def m9_pred_names(spark, sf_dir):
    v = namebook.in_vocab(_book(spark, sf_dir)).select(F.initcap("name").alias("name"))
    s = _table(spark, sf_dir, "part").selectExpr("p_partkey AS sample_index", f"{_SAMPLES} AS text")
    return mentions.predicted_names(s, v, v)


@query("WITH i AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('1:' || o_orderkey), o_orderkey) - 1 AS item FROM orders), p AS (SELECT n_nationkey, n_name FROM nation) SELECT o_orderkey, item, n_name AS prompt FROM i JOIN p ON n_nationkey = item % 25")
def j13_round_robin(spark, sf_dir):
    items = subsets.shuffled(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 1).select("o_orderkey", (F.col("rn") - 1).alias("item"))
    prompts = _table(spark, sf_dir, "nation").selectExpr("n_nationkey AS prompt_index", "n_name AS prompt")
    return mentions.round_robin(items, prompts, 25).select("o_orderkey", "item", "prompt")


# concepts

GAZETTEER = "gaz AS (SELECT term, 'C' || substr(md5(term), 1, 7) AS cui, upper(term) AS preferred_name, (['dsyn', 'mobd', 'neop', 'food'])[1 + length(term) % 4] AS semtype FROM (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM benchmark) WHERE length(term) >= 4)"
WORDS = "words AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents), met AS (SELECT doc_id, term, count(*) AS n FROM words GROUP BY ALL)"


def _gazetteer(spark, sf_dir) -> DataFrame:
    terms = _table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")).filter("length(term) >= 4").distinct()
    kinds = F.array(*[F.lit(x) for x in ("dsyn", "mobd", "neop", "food")])
    return terms.select("term", F.concat(F.lit("C"), F.substring(F.md5("term"), 1, 7)).alias("cui"), F.upper("term").alias("preferred_name"), F.get(kinds, F.length("term") % 4).alias("semtype"))


@query(f"WITH {GAZETTEER}, {WORDS} SELECT doc_id, cui, preferred_name, array_to_string(list_sort(list(term)), ', ') AS superficials, sum(n)::BIGINT AS score FROM met JOIN gaz USING (term) WHERE semtype IN ('dsyn', 'mobd', 'neop') GROUP BY doc_id, cui, preferred_name")
def u6_gold_diseases(spark, sf_dir):
    matches = concepts.gazetteer_matches(_table(spark, sf_dir, "documents").select("doc_id", "text"), _gazetteer(spark, sf_dir), "doc_id", "text")
    return concepts.gold(matches, "doc_id")


_POS = "concat(cast(1 + doc_id % 5 AS STRING), '/', cast(3 + doc_id % 4 AS STRING), ',', cast(10 + doc_id % 7 AS STRING), '/6')"


@query("SELECT doc_id, array_to_string([substr(text, 1 + doc_id % 5, 3 + doc_id % 4), substr(text, 10 + doc_id % 7, 6)], '|') AS surfaces FROM documents")
def u2_surfaces(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(concepts.surfaces(F.col("text"), F.expr(_POS)), "|").alias("surfaces"))


_SURF = "CASE doc_id % 4 WHEN 0 THEN 'was,fever' WHEN 1 THEN 'fever' WHEN 2 THEN 'IV,NC' ELSE 'cough,call' END"


@query(f"SELECT doc_id FROM documents WHERE NOT list_has_any(string_split({_SURF}, ','), [{', '.join(sql_text(x) for x in concepts.NOT_DISEASES)}])")
def u3_drop_invalid(spark, sf_dir):
    return _table(spark, sf_dir, "documents").filter(concepts.valid(F.split(F.expr(_SURF), ","))).select("doc_id")


@query("SELECT doc_id, list_has_any(string_split_regex(lower(text), '[^a-z]+'), ['the', 'with']) AS overlap FROM documents")
def o4_overlap(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.arrays_overlap(F.split(F.lower("text"), "[^a-z]+"), F.array(F.lit("the"), F.lit("with"))).alias("overlap"))


# scores

LOGITS = "lg AS (SELECT vec_id AS doc_id, unnest(embedding)::DOUBLE AS logit, generate_subscripts(embedding, 1) - 1 AS token_id FROM embeddings)"
SOFT = "mx AS (SELECT *, max(logit) OVER (PARTITION BY doc_id) AS m FROM lg), sm AS (SELECT doc_id, token_id, logit, exp(logit - m) / sum(exp(logit - m)) OVER (PARTITION BY doc_id) AS p FROM mx)"


def _logits(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("token_id", "logit")).select("doc_id", F.col("token_id").cast("long").alias("token_id"), F.col("logit").cast("double").alias("logit"))


@query(f"WITH {LOGITS}, {SOFT} SELECT doc_id, token_id, round(p, 10) AS p FROM sm")
def a15_softmax(spark, sf_dir):
    return scoring.softmax(_logits(spark, sf_dir), ["doc_id"]).select("doc_id", "token_id", F.round("p", 10).alias("p"))


@query(f"WITH {LOGITS}, {SOFT} SELECT doc_id, round(exp(-avg(ln(p))), 8) AS perplexity FROM sm GROUP BY doc_id")
def a14_perplexity(spark, sf_dir):
    df = scoring.perplexity(scoring.softmax(_logits(spark, sf_dir), ["doc_id"]), ["doc_id"])
    return df.select("doc_id", F.round("perplexity", 8).alias("perplexity"))


@query(f"WITH {LOGITS}, {SOFT}, v AS (SELECT doc_id, token_id, p / sum(p) OVER (PARTITION BY doc_id) AS p FROM sm WHERE token_id % 3 = 0) SELECT doc_id, round(max(p) FILTER (WHERE token_id = 0) * max(p) FILTER (WHERE token_id = 3), 12) AS p_name FROM v GROUP BY doc_id")
def a16_name_prob(spark, sf_dir):
    v = scoring.renormalised(scoring.softmax(_logits(spark, sf_dir), ["doc_id"]).filter("token_id % 3 = 0"), ["doc_id"])
    of = lambda t: F.max(F.when(F.col("token_id") == t, F.col("p")))
    return v.groupBy("doc_id").agg(F.round(of(0) * of(3), 12).alias("p_name"))


@query(f"WITH {LOGITS}, r AS (SELECT doc_id, token_id, row_number() OVER (PARTITION BY doc_id ORDER BY logit DESC, token_id) AS rank FROM lg) SELECT doc_id, token_id, rank::INT AS rank FROM r WHERE rank <= 5")
def l6_topk(spark, sf_dir):
    return scoring.top_k(_logits(spark, sf_dir), ["doc_id"], 5).select("doc_id", "token_id", "rank")


@query(f"WITH {LOGITS} SELECT doc_id, arg_max(token_id, logit / 0.7 - ln(-ln(({_draw('(doc_id || chr(58) || token_id)', 7, 1000003)} + 0.5) / 1000003))) AS token_id FROM lg GROUP BY doc_id")
def l7_gumbel_draw(spark, sf_dir):
    return scoring.gumbel_draw(_logits(spark, sf_dir), ["doc_id"], 7, 0.7)


_HEAD = "list_slice(string_split(p_name, ' '), 1, 6)"


@query(f"WITH t AS (SELECT p_partkey, {_HEAD} AS w FROM part), e AS (SELECT p_partkey, w, unnest(range(len(w))) AS masked_pos FROM t) SELECT p_partkey, masked_pos::INT AS masked_pos, array_to_string(list_transform(w, lambda x, i: CASE WHEN i - 1 = masked_pos THEN '[MASK]' ELSE x END), ' ') AS tokens FROM e")
def g1_stride_mask(spark, sf_dir):
    df = _table(spark, sf_dir, "part").select("p_partkey", F.slice(F.split("p_name", " "), 1, 6).alias("tokens"))
    return scoring.stride_masked(df, "tokens").select("p_partkey", "masked_pos", F.array_join("tokens", " ").alias("tokens"))


@query("SELECT p_partkey, array_to_string(list_slice(list_concat(string_split(p_name, ' '), ['[MASK]', '[MASK]', '[MASK]', '[MASK]', '[MASK]']), 1, 5), ' ') AS tokens FROM part")
def l9_padded(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(scoring.padded(F.split("p_name", " "), 5), " ").alias("tokens"))


_YEAR = r"\[\*\*([0-9]{4})-[0-9]{1,2}-[0-9]{1,2}\*\*\]"


@query(f"WITH {NOTES} SELECT row_id, list_max(list_transform(regexp_extract_all(note, '{_YEAR}', 1), lambda y: y::INT)) AS latest FROM notes")
def a10_latest_year(spark, sf_dir):
    years = F.regexp_extract_all("note", F.lit(_YEAR), F.lit(1))
    return notes.notes(spark, sf_dir).select("row_id", F.array_max(F.transform(years, lambda y: y.cast("int"))).alias("latest"))


@query("SELECT p_brand AS name, round(count(*) / (SELECT count(*) FROM part), 12) AS weight FROM part GROUP BY p_brand")
def a12_normalised(spark, sf_dir):
    counts = _table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return namebook.normalised(counts).select("name", F.round("weight", 12).alias("weight"))


@query(f"WITH {NOTES} SELECT row_id, len(flatten(list_transform(string_split(note, chr(10)), lambda x: string_split(x, ' ')))) AS n_parts FROM notes")
def a17_flattened(spark, sf_dir):
    parts = relations.flattened(F.split("note", "\n"), " ")
    return notes.notes(spark, sf_dir).select("row_id", F.size(parts).cast("long").alias("n_parts"))


@query(f"WITH {ORDERS}, p AS (SELECT *, lag(category) OVER (PARTITION BY subject_id ORDER BY row_id) AS before FROM o) SELECT subject_id, row_id, category FROM p WHERE category IS DISTINCT FROM before")
def a6_adjacent_dedupe(spark, sf_dir):
    return relations.adjacent_deduped(_orders(spark, sf_dir), ["subject_id"], ["row_id"], "category").select("subject_id", "row_id", "category")


@query("WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) SELECT p_partkey, unnest(range(len(w)))::INT AS pos, unnest(w) AS word, unnest(list_transform(w, lambda x: length(x)))::INT AS chars FROM w")
def j12_zipped_lists(spark, sf_dir):
    words = F.split("p_name", " ")
    return relations.zipped_lists(_table(spark, sf_dir, "part"), ["p_partkey"], pos=F.sequence(F.lit(0), F.size(words) - 1), word=words, chars=F.transform(words, F.length))


@query("SELECT c_custkey, coalesce(n_name, '') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON c_nationkey = n_nationkey")
def j4_lookup_or_empty(spark, sf_dir):
    known = _table(spark, sf_dir, "nation").filter("n_regionkey = 1")
    customers = _table(spark, sf_dir, "customer")
    return customers.join(known, customers["c_nationkey"] == known["n_nationkey"], "left").select("c_custkey", F.coalesce("n_name", F.lit("")).alias("n_name"))


@query(f"WITH {ORDERS} SELECT row_id, subject_id FROM o WHERE subject_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def j5_rows_of_subjects(spark, sf_dir):
    wanted = _table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("subject_id"))
    return relations.rows_of(_orders(spark, sf_dir), wanted, "subject_id").select("row_id", "subject_id")


@query(f"WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY md5('{SEED}:' || p_partkey), p_partkey) AS rn FROM part) SELECT p_partkey, rn FROM r WHERE rn <= (SELECT count(*) FROM supplier)")
def l3_head_of_other_size(spark, sf_dir):
    ranked = subsets.shuffled(_table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", SEED)
    return relations.head_of_size(ranked, _table(spark, sf_dir, "supplier")).select("p_partkey", F.col("rn").cast("long").alias("rn"))


@query("SELECT c_nationkey AS k, 'c' AS rule FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier")
def o2_union_all(spark, sf_dir):
    return relations.union_of({"c": _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), "s": _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))})


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def o3_distinct_keys(spark, sf_dir):
    return relations.distinct_keys(o2_union_all(spark, sf_dir), "k")


@query(f"WITH {NOTES} SELECT row_id, category FROM notes WHERE category IN ('Physician ', 'Discharge summary')")
def p4_two_categories(spark, sf_dir):
    return notes.notes(spark, sf_dir).filter(subsets.in_categories("category", ["Physician ", "Discharge summary"])).select("row_id", "category")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.lines_of(notes.notes(spark, sf_dir), "row_id", "note")


LINES = f"{NOTES}, lines AS (SELECT row_id, unnest(string_split(note, chr(10))) AS line FROM notes)"


@query(f"WITH {LINES} SELECT row_id, line FROM lines WHERE regexp_matches(line, 'Hospital|Telephone|days')")
def p8_lines_with(spark, sf_dir):
    return relations.lines_with(_lines(spark, sf_dir), ["Hospital", "Telephone", "days"])


@query(f"WITH {LINES} SELECT row_id, count(*) AS n_lines FROM lines WHERE NOT regexp_matches(line, '^[._~]+$') GROUP BY row_id")
def p9_lines_without(spark, sf_dir):
    return relations.lines_without(_lines(spark, sf_dir), ["^[._~]+$"]).groupBy("row_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"WITH {ORDERS}, r AS (SELECT row_id, row_number() OVER (ORDER BY md5('{SEED}:' || row_id), row_id) AS rn FROM o) SELECT row_id, rn <= 1000 AS taken FROM r")
def w1_take_or_rest(spark, sf_dir):
    return subsets.shuffled(_orders(spark, sf_dir), "row_id", SEED).select("row_id", (F.col("rn") <= 1000).alias("taken"))


_KEYED = r"\[\*\*[A-Z][a-z]+ [0-9]+\*\*\]"


@query(f"WITH {NOTES}, p AS (SELECT row_id, regexp_extract_all(note, '{_KEYED}') AS ps FROM notes) SELECT row_id, unnest(range(len(ps)))::INT AS pos, unnest(ps) AS placeholder, unnest(list_transform(ps, lambda x, i: coalesce(ps[i + 1], ''))) AS following FROM p")
def w4_following_placeholder(spark, sf_dir):
    found = notes.notes(spark, sf_dir).select("row_id", F.regexp_extract_all("note", F.lit(_KEYED), F.lit(0)).alias("ps"))
    return found.select("row_id", F.inline(relations.with_following(F.col("ps"))).alias("pos", "placeholder", "following"))


# round trips through sources and sinks


def _round_trip(spark, sf_dir, header: bool, sep: str) -> DataFrame:
    path, df = shared_path(spark, "notes"), _notes(spark, sf_dir)
    writers.write_csv(df, path, header, sep)
    return readers.read_csv(spark, path, df.schema, header, sep).select("row_id", "subject_id", "category", F.md5("note").alias("note_md5"))


_WRITTEN = f"WITH {NOTES} SELECT row_id, subject_id, category, md5(note) AS note_md5 FROM notes"


@query(_WRITTEN)
def s1_k1_csv_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, True, ",")


@query(_WRITTEN)
def s2_k2_headless_csv_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, False, ",")


@query(_WRITTEN)
def s4_k4_tsv_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, True, "\t")


@query("SELECT n_name, n_regionkey, count(*) AS n FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_regionkey = 1) GROUP BY ALL")
def k3_appended(spark, sf_dir):
    path, df = shared_path(spark, "appended"), _table(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    writers.write_tsv(df, path)
    writers.write_tsv(df.filter("n_regionkey = 1"), path, append=True)
    return readers.read_tsv(spark, path, df.schema).groupBy("n_name", "n_regionkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT row_number() OVER (ORDER BY n_name) - 1 AS sample_index, n_name AS text FROM nation")
def s5_numbered_lines(spark, sf_dir):
    path = shared_path(spark, "lines")
    _table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_name").select("n_name").write.text(path)
    return readers.read_lines(spark, path)


@query("SELECT DISTINCT n_name AS name FROM nation")
def s7_names(spark, sf_dir):
    path = shared_path(spark, "names")
    writers.write_csv(_table(spark, sf_dir, "nation").select("n_name"), path, header=False)
    return readers.read_names(spark, path)


_HALF = "CASE WHEN row_id % 2 = 0 THEN 'hospital' ELSE 'shadow' END"


@query(f"WITH {NOTES} SELECT {_HALF} AS half, 'c1p2' AS code, 'hipaa' AS anonymity, md5(regexp_replace(note, '[\\r\\n]+', ' ', 'g')) AS line_md5 FROM notes")
def k5_training_text(spark, sf_dir):
    path = shared_path(spark, "text")
    writers.write_training_text(_notes(spark, sf_dir).select(F.expr(_HALF).alias("half"), F.lit("c1p2").alias("code"), F.lit("hipaa").alias("anonymity"), F.col("note").alias("sentence")), path)
    return spark.read.text(path).select("half", "code", "anonymity", F.md5("value").alias("line_md5"))


@query("(set in corpus_queries)")
def k6_stream_appended(spark, sf_dir):
    """The streaming function over a stream, each batch appended."""
    path = shared_path(spark, "stream")
    _notes(spark, sf_dir).select("row_id", "note").write.parquet(f"{path}/in")
    append_batches(prepared(spark.readStream.schema("row_id long, note string").parquet(f"{path}/in"), "note").select("row_id", "prepared", "all_filled"), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("SELECT n_name, k AS top_k, 'm' || k AS model FROM nation, (SELECT unnest([0, 100]) AS k)")
def k7_parameter_folders(spark, sf_dir):
    path, df = shared_path(spark, "runs"), _table(spark, sf_dir, "nation").select("n_name")
    for k in (0, 100):
        df.write.parquet(writers.parameter_path(path, model=f"m{k}", top_k=k))
    return spark.read.parquet(path).select("n_name", "top_k", "model")


# predicates, joins and orders of their own


@query(f"WITH {ORDERS} SELECT row_id FROM o WHERE row_id % 3 = 0 OR row_id % 5 = 0")
def p5_any_flag(spark, sf_dir):
    df = _orders(spark, sf_dir).withColumns({"in_train_1M": F.col("row_id") % 3 == 0, "in_test_1M": F.col("row_id") % 5 == 0})
    return subsets.any_flag(df, "c1p2").select("row_id")


@query(rf"""WITH {NOTES}, {MAP}, m AS (SELECT row_id, note, regexp_extract(note, {sql_text(MENTION)}, 2) AS f, regexp_extract(note, {sql_text(MENTION)}, 3) AS l FROM notes)
    SELECT row_id FROM m WHERE f <> '' AND len(regexp_extract_all(note, regexp_escape(f) || '\s*' || regexp_escape(l))) > 0""")
def p6_notes_with_names(spark, sf_dir):
    df = _notes(spark, sf_dir)
    return mentions.with_names(df, _map(df), "note").filter("patient_full_name_tfreq > 0").select("row_id")


@query(f"WITH {ORDERS} SELECT row_id, category FROM o WHERE row_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def p7_masked_by_other_frame(spark, sf_dir):
    mask = _table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("row_id"))
    return _orders(spark, sf_dir).join(mask, "row_id", "left_semi").select("row_id", "category")


@query("SELECT o_orderkey, o_orderpriority, lower(p) AS lowered FROM orders LEFT JOIN (SELECT o_orderkey AS k, o_orderpriority AS p FROM orders WHERE o_orderkey % 3 = 0) ON o_orderkey = k")
def j2_attached_by_index(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    lowered = orders.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lower("o_orderpriority").alias("lowered"))
    return relations.attached(orders, lowered, "o_orderkey")


@query("SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS shown FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON c_nationkey = n_nationkey")
def j3_lookup_or_self(spark, sf_dir):
    known = _table(spark, sf_dir, "nation").filter("n_regionkey = 1")
    customers = _table(spark, sf_dir, "customer")
    return customers.join(known, customers["c_nationkey"] == known["n_nationkey"], "left").select("c_custkey", F.coalesce("n_name", F.col("c_nationkey").cast("string")).alias("shown"))


@query(f"SELECT * FROM ({_SQL['m9_pred_names']}) WHERE is_valid_full_name")
def j8_valid_only(spark, sf_dir):
    v = namebook.in_vocab(_book(spark, sf_dir)).select(F.initcap("name").alias("name"))
    s = _table(spark, sf_dir, "part").selectExpr("p_partkey AS sample_index", f"{_SAMPLES} AS text")
    return mentions.predicted_names(s, v, v, skip_invalid=True)


@query(f"WITH {LOGITS} SELECT doc_id, n_name AS name, logit FROM lg JOIN nation ON token_id = n_nationkey")
def j11_gathered(spark, sf_dir):
    names_ = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("token_id"), F.col("n_name").alias("name"))
    return relations.gathered(_logits(spark, sf_dir), names_, "token_id").select("doc_id", "name", "logit")


@query(f"WITH {ORDERS} SELECT subject_id, array_to_string(list_sort(list(DISTINCT category)), '|') AS categories FROM o GROUP BY 1")
def a5_distinct_sorted(spark, sf_dir):
    return relations.distinct_sorted(_orders(spark, sf_dir), ["subject_id"], "category").select("subject_id", F.array_join("category", "|").alias("categories"))


@query(f"WITH {ORDERS} SELECT count(*) AS n, count(*) FILTER (WHERE category = '1-URGENT') AS n_urgent, sum(row_id) FILTER (WHERE category = '1-URGENT')::BIGINT AS urgent_ids FROM o")
def a2_a3_filtered_totals(spark, sf_dir):
    urgent = F.col("category") == "1-URGENT"
    return _orders(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(urgent).alias("n_urgent"), F.sum(F.when(urgent, F.col("row_id"))).alias("urgent_ids"))


@query(f"WITH {LOGITS}, {SOFT}, v AS (SELECT * FROM sm WHERE token_id % 3 = 0) SELECT doc_id, token_id, round(p / (SELECT sum(p) FROM v), 12) AS p FROM v")
def a16_batch_renormalised(spark, sf_dir):
    v = scoring.renormalised(scoring.softmax(_logits(spark, sf_dir), ["doc_id"]).filter("token_id % 3 = 0"), ["doc_id"], batch=True)
    return v.select("doc_id", "token_id", F.round("p", 12).alias("p"))


@query("SELECT round(avg(greatest(0, 5 - len(string_split(p_name, ' ')))), 9) AS mean_masks FROM part")
def a19_mean_masks(spark, sf_dir):
    df = _table(spark, sf_dir, "part").select(scoring.padded(F.split("p_name", " "), 5).alias("tokens"))
    return scoring.mean_masks(df, "tokens").select(F.round("mean_masks", 9).alias("mean_masks"))


@query(f"WITH {LOGITS}, r AS (SELECT doc_id, token_id, row_number() OVER (PARTITION BY doc_id ORDER BY logit DESC, token_id) AS rank FROM lg) SELECT doc_id, token_id FROM r WHERE rank = 1")
def l7_argmax(spark, sf_dir):
    return scoring.argmax(_logits(spark, sf_dir), ["doc_id"])


@query(f"WITH {NOTES} SELECT row_id, nullif(regexp_extract(note, {sql_text(placeholders.PLACEHOLDER)}), '') AS first_placeholder FROM notes")
def l10_first_match(spark, sf_dir):
    return _notes(spark, sf_dir).select("row_id", F.nullif(F.regexp_extract("note", placeholders.PLACEHOLDER, 0), F.lit("")).alias("first_placeholder"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY md5('12345:' || p_partkey), p_partkey) AS rn FROM part")
def l5_seeded_permutation(spark, sf_dir):
    return subsets.shuffled(_table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 12345).select("p_partkey", F.col("rn").cast("long").alias("rn"))


@query(f"WITH {ORDERS}, s AS (SELECT row_id, row_number() OVER (ORDER BY md5('42:' || row_id), row_id) <= (SELECT count(*) FROM o) // 2 AS h FROM o) SELECT count(*) FILTER (WHERE n > 1) = 0 AS disjoint FROM (SELECT count(DISTINCT h) AS n FROM s GROUP BY row_id)")
def o5_disjoint_halves(spark, sf_dir):
    halves = subsets.half_split(_orders(spark, sf_dir).select("row_id"), "row_id", SEED)
    sides = [halves.filter(F.col("half") == h).select("row_id") for h in ("hospital", "shadow")]
    return checks.disjoint(*sides)


# names and concepts, part by part


#: The oracle's patterns of every kind, written out.
_KIND_FORMS = {
    "first": _FIRST_FORMS,
    "last": _LAST_FORMS,
    "prefix": r"\[\*\*Name Prefix \(Prefixes\) #\*\*\]",
    "initial": r"\[\*\*Initials? \(NamePattern\d\) #\*\*\]|\[\*\*Name Initial \(\w+?\) #\*\*\]|\[\*\*Name12 \(\w+?\) #\*\*\]",
    "not_name": r"\[\*\*Age over 90 #\*\*\]|\[\*\*Apartment Address\(1\) #\*\*\]|\[\*\*April #\*\*\]|\[\*\*A[tu][ A-Za-z]+ #\*\*\]|\[\*\*Date range \([1-3]\) #\*\*\]|\[\*\*D[aei][ A-Za-z()-]+ #\*\*\]|\[\*\*[CEHJOPSTUWY][ A-Za-z()-/]+ #\*\*\]|\[\*\*Hospital[1-6] #\*\*\]|\[\*\*February #\*\*\]|\[\*\*Lo[ A-Za-z()-]+ #\*\*\]|\[\*\*MD Number\([1-4]\) #\*\*\]|\[\*\*March #\*\*\]|\[\*\*May #\*\*\]|\[\*\*M[eo][ A-Za-z()-]+ #\*\*\]|\[\*\*Month Day Year \(2\) #\*\*\]|\[\*\*Month/Day #\*\*\]|\[\*\*Month/Day [1-4()]* #\*\*\]|\[\*\*Month/Day/Year #\*\*\]|\[\*\*Month/Year [1-2()]+ #\*\*\]|\[\*\*N[ou][ A-Za-z()-]+ #\*\*\]|\[\*\*Street Address\([1-2]\) #\*\*\]|\[\*\*Telephone/Fax \([1-5]\) #\*\*\]|\[\*\*Year \([24] digits\) #\*\*\]|\[\*\*[ 0-9/-]+\*\*\]",
}


@query("WITH " + NOTES + f", found AS ({FOUND}) " + " UNION ALL ".join(f"SELECT '{kind}' AS kind, placeholder, regexp_matches(placeholder, {sql_text('^(' + _with_id(forms) + ')$')}) AS has_id FROM found WHERE regexp_matches(placeholder, {sql_text('^(' + _any_id(forms) + ')$')})" for kind, forms in _KIND_FORMS.items()))
def m1_kinds_of_placeholders(spark, sf_dir):
    found = placeholders.distinct_placeholders(_notes(spark, sf_dir), "note")
    is_kind = lambda kind, ids: F.col("placeholder").rlike("^" + names.pattern(kind, ids, "(?:") + "$")
    kinds = F.array_compact(F.array(*[F.when(is_kind(kind, False), F.struct(F.lit(kind).alias("kind"), is_kind(kind, True).alias("has_id"))) for kind in names.FORMS]))
    return found.select(F.explode(kinds).alias("k"), "placeholder").select("k.kind", "placeholder", "k.has_id")


@query(f"WITH {NOTES} SELECT row_id, {', '.join(f'regexp_extract(note, {sql_text(FULL_NAME)}, {k}) AS {n}' for k, n in enumerate(('first', 'last', 'age'), 1))} FROM notes")
def m3_full_names(spark, sf_dir):
    return _notes(spark, sf_dir).select("row_id", *[F.regexp_extract("note", names.full_name(), k).alias(n) for k, n in enumerate(("first", "last", "age"), 1)])


_EITHER = f"^{_FIRST}$|^{_LAST}$"


@query(f"WITH {NOTES}, seg AS (SELECT row_id, unnest({PARTS.format(t='note')}) AS s, generate_subscripts({PARTS.format(t='note')}, 1) AS i FROM notes) SELECT row_id, string_agg(CASE WHEN regexp_matches(s, {sql_text(_EITHER)}) THEN rtrim(repeat('[MASK] ', length(s) % 3 + 1)) ELSE s END, '' ORDER BY i) AS masked FROM seg GROUP BY row_id")
def m8_masked_by_tokens(spark, sf_dir):
    own = F.array_distinct(placeholders.placeholders(F.col("note")))
    lengths = F.map_from_arrays(own, F.transform(own, lambda p: F.length(p) % 3 + 1))
    return _notes(spark, sf_dir).withColumn("lengths", lengths).select("row_id", names.mask_names_by_tokens(F.col("note"), F.col("lengths")).alias("masked"))


@query(f"WITH {BOOK} SELECT name, n_nationkey AS vocab_id FROM book JOIN (SELECT *, lower(split_part(p, ' ', 1)) AS token FROM (SELECT n_nationkey, (SELECT min(p_name) FROM part WHERE p_partkey % 25 = n_nationkey) AS p FROM nation)) ON name = token")
def m12_vocabulary_ids(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 25).cast("int").alias("vocab_id")).agg(F.min("p_name").alias("p"))
    return namebook.with_vocab_ids(_book(spark, sf_dir), parts.select(F.substring_index("p", " ", 1).alias("token"), "vocab_id")).select("name", "vocab_id")


@query("SELECT doc_id, unnest([1 + doc_id % 5, 10 + doc_id % 7])::INT AS start, unnest([3 + doc_id % 4, 6])::INT AS len FROM documents")
def u1_positions(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.inline(concepts.positions(F.expr(_POS))).alias("start", "len"))


@query(f"WITH {LOGITS}, {SOFT} SELECT doc_id // 25 AS text, token_id AS pos, round(p, 10) AS p FROM sm WHERE token_id = doc_id % 25")
def g2_diagonal(spark, sf_dir):
    df = scoring.softmax(_logits(spark, sf_dir), ["doc_id"])
    df = df.select(F.expr("doc_id div 25").alias("text"), (F.col("doc_id") % 25).alias("masked_pos"), F.col("token_id").alias("pos"), F.round("p", 10).alias("p"))
    return scoring.diagonal(df).select("text", "pos", "p")


@query(f"WITH {LOGITS}, g AS (SELECT *, logit / (1.0 + 1.0 / (1 + doc_id)) - ln(-ln(({_draw('(doc_id || chr(58) || token_id)', 7, 1000003)} + 0.5) / 1000003)) AS g, row_number() OVER (PARTITION BY doc_id ORDER BY logit DESC, token_id) AS k FROM lg) SELECT doc_id, arg_max(token_id, g) AS token_id FROM g WHERE doc_id < 20 OR k <= 5 GROUP BY doc_id")
def g7_scheduled_draw(spark, sf_dir):
    """Row = iteration: 20 of burn-in, then the five likeliest; the temperature falls with the iteration."""
    return scoring.scheduled_draw(_logits(spark, sf_dir), ["doc_id"], "doc_id", 7, 20, 5, 1.0 + 1.0 / (1 + F.col("doc_id")))


@query(f"SELECT o_orderkey, ([3, 5, 8, 9])[1 + o_orderkey % 4] AS always, CASE WHEN o_orderkey < 4 THEN ([3, 5, 8, 9])[1 + o_orderkey % 4] ELSE ([3, 5, 8, 9])[1 + {_draw('o_orderkey', 7, 1000003)} % 4] END AS first, ([3, 5, 8, 9])[1 + {_draw('o_orderkey', 7, 1000003)} % 4] AS never FROM orders")
def g5_written_positions(spark, sf_dir):
    at = F.array(*[F.lit(x) for x in (3, 5, 8, 9)])
    return _table(spark, sf_dir, "orders").select("o_orderkey", *[scoring.written_position(F.col("o_orderkey"), at, how, 7).alias(how) for how in ("always", "first", "never")])
