"""Queries over the whole chain: corpus build, subsets, training text, mentions, gold and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubwell.functions import cleaning, dates, training_text
from scrubwell.functions.rules import sql_rewrite_lines, sql_substitute, sql_text
from scrubwell.operators import concepts, corpus, mentions, placeholders, relations, subsets, surrogates
from scrubwell.plans.catalog import _SQL, GAZETTEER, MENTION, NOTES, PARTS, SEED, SENTENCES, _gazetteer, _normal_sql, _notes, _table, backdated_sql, map_sql, query
from scrubwell.sources import writers
from scrubwell.sources.shared import shared_path

# the corpus, from end to end

_SMALL = "WHEN (x, y) IN ((1, 2), (2, 1), (2, 2)) THEN 2 WHEN x = 1 AND y = 1 THEN 1"
_BANDS = {
    "day": f"WHEN x <= 12 AND y >= 14 THEN 14 WHEN (x <= 9 AND y BETWEEN 10 AND 13) OR (x BETWEEN 10 AND 12 AND y <= 13) THEN 10 WHEN (x <= 6 AND y BETWEEN 7 AND 9) OR (x BETWEEN 7 AND 9 AND y <= 9) THEN 7 WHEN (x <= 2 AND y IN (3, 4)) OR (x IN (3, 4) AND y <= 2) THEN 3 {_SMALL}",
    "week": "WHEN x BETWEEN 1 AND 12 AND y >= 24 THEN 24 WHEN (x = 12 AND y <= 23) OR (x BETWEEN 1 AND 11 AND y BETWEEN 12 AND 23) THEN 12 WHEN (x BETWEEN 1 AND 9 AND y BETWEEN 8 AND 11) OR (x IN (8, 9) AND y <= 7) THEN 8 WHEN x BETWEEN 1 AND 7 AND y BETWEEN 1 AND 7 THEN greatest(x, y)",
    "month": f"WHEN x <= 11 AND y >= 12 THEN 12 WHEN (x <= 5 AND y BETWEEN 6 AND 11) OR x BETWEEN 6 AND 11 THEN 6 WHEN (x BETWEEN 1 AND 3 AND y BETWEEN 3 AND 5) OR (x BETWEEN 3 AND 5 AND y BETWEEN 1 AND 3) THEN 3 {_SMALL}",
}
_CASES = " ".join(f"WHEN '{unit}' THEN CASE {case} END" for unit, case in _BANDS.items())
#: cleaned (row_id, note) and resolved (row_id, note): what needs no map, once for both halves.
PREPARED = rf"""cleaned AS (SELECT row_id, {sql_rewrite_lines('note', cleaning.CLEANING)} AS note FROM notes),
    kw AS (SELECT row_id, {sql_substitute('note', dates.KEYWORD_RULES)} AS note FROM cleaned), kp AS (SELECT row_id, {PARTS.format(t='note')} AS p FROM kw), kg AS (SELECT row_id, unnest(p) AS s, generate_subscripts(p, 1) AS i, p FROM kp),
    kx AS (SELECT row_id, s, i, CASE WHEN regexp_matches(s, '^\[\*\*[0-9]+-[0-9]+\*\*\]$') AND ends_with(coalesce(p[i - 1], ''), 'in ') THEN regexp_extract(coalesce(p[i + 1], ''), '^ (day|week|month)', 1) ELSE '' END AS unit, try_cast(regexp_extract(s, '([0-9]+)-([0-9]+)', 1) AS INT) AS x, try_cast(regexp_extract(s, '([0-9]+)-([0-9]+)', 2) AS INT) AS y FROM kg),
    kb AS (SELECT row_id, string_agg(coalesce((CASE unit {_CASES} END)::VARCHAR, s), '' ORDER BY i) AS note FROM kx GROUP BY row_id),
    resolved AS (SELECT row_id, {sql_substitute('note', dates.LATE_RULES)} AS note FROM kb)"""
_OPEN = r"'\[\*\*.+?\*\*\]'"
_SQL["stream_prepared"] = f"WITH {NOTES}, {PREPARED}, {backdated_sql('resolved')} SELECT row_id, backdated AS prepared, NOT regexp_matches(backdated, {_OPEN}) AS all_filled FROM backdated"
_SQL["k6_stream_appended"] = _SQL["stream_prepared"]

_NO_ID = ", ".join(sql_text(x) for x in placeholders.NO_ID)


def _half_text(half: str, seed: int) -> str:
    """CTEs that end in text_<half> (row_id, backdated)."""
    return f"""{map_sql(seed, "cleaned", f"map_{half}")}, own_{half} AS (SELECT * FROM map_{half} WHERE placeholder NOT IN ({_NO_ID})),
        seg_{half} AS (SELECT row_id, unnest({PARTS.format(t='note')}) AS s, generate_subscripts({PARTS.format(t='note')}, 1) AS i FROM resolved),
        filled_{half} AS (SELECT row_id, string_agg(coalesce(dummy_phi, s), '' ORDER BY i) AS note FROM seg_{half} LEFT JOIN own_{half} ON s = placeholder GROUP BY row_id),
        {backdated_sql(f"filled_{half}", f"text_{half}")}"""


D7 = f"""{NOTES}, {PREPARED}, {", ".join(_half_text(h, s) for h, s in surrogates.SEEDS.items())},
    d7 AS (SELECT n.*, a.backdated AS TEXT_WITH_DUMMY_PHI_HOSPITAL, b.backdated AS TEXT_WITH_DUMMY_PHI_SHADOW, NOT regexp_matches(a.backdated, {_OPEN}) AS all_placeholders_replaced, NOT list_bool_or(list_transform([{_NO_ID}], lambda p: contains(note, p))) AS all_placeholders_have_id
           FROM notes n JOIN text_hospital a USING (row_id) JOIN text_shadow b USING (row_id))"""


def _d7(spark, sf_dir) -> DataFrame:
    return corpus.built(_notes(spark, sf_dir), "row_id", "note")


@query(f"WITH {D7} SELECT row_id, md5(TEXT_WITH_DUMMY_PHI_HOSPITAL) AS hospital, md5(TEXT_WITH_DUMMY_PHI_SHADOW) AS shadow, all_placeholders_replaced, all_placeholders_have_id FROM d7")
def d7_corpus(spark, sf_dir):
    df = _d7(spark, sf_dir)
    return df.select("row_id", F.md5("TEXT_WITH_DUMMY_PHI_HOSPITAL").alias("hospital"), F.md5("TEXT_WITH_DUMMY_PHI_SHADOW").alias("shadow"), "all_placeholders_replaced", "all_placeholders_have_id")


def _flags_sql(source: str, categories: list[str], sizes: dict[str, int]) -> str:
    """CTEs that end in flags (row_id, half, a column for each subset and side) and halves (the source with half)."""
    few = f"category IN ({', '.join(sql_text(c) for c in categories)})"
    count = lambda code: f"coalesce(max(n) FILTER (WHERE kind = '{'few' if code in corpus.FEW_CATEGORIES else 'all'}' AND cd > {sizes[code]}), -1) AS t_{code}"
    test = lambda code: " AND ".join(["TRUE", *([few] if code in corpus.FEW_CATEGORIES else []), *([f"n_{'few' if code in corpus.FEW_CATEGORIES else 'all'} >= t_{code}"] if code in corpus.CUT_OFF else [])])
    members = " UNION ALL ".join(f"SELECT row_id, half, '{code}' AS code, {sizes[code]} AS size FROM counted WHERE {test(code)}" for code in subsets.CODES)
    flags = ", ".join(f"coalesce(bool_or(code = '{code}' AND {'' if side == 'train' else 'NOT '}(rn <= size)), FALSE) AS in_{side}_{name}" for code, name in subsets.CODES.items() for side in ("train", "test"))
    return f"""halves AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('42:' || row_id), row_id) <= (SELECT count(*) FROM {source}) // 2 THEN 'hospital' ELSE 'shadow' END AS half FROM {source}),
        per AS (SELECT half, subject_id, count(row_id) AS n_all, count(row_id) FILTER (WHERE {few}) AS n_few FROM halves WHERE subject_id IS NOT NULL GROUP BY 1, 2),
        hist AS (SELECT half, 'all' AS kind, n_all AS n, sum(n_all) AS docs FROM per GROUP BY ALL UNION ALL SELECT half, 'few', n_few, sum(n_few) FROM per WHERE n_few > 0 GROUP BY ALL),
        cum AS (SELECT half, kind, n, sum(docs) OVER (PARTITION BY half, kind ORDER BY n DESC) AS cd FROM hist), cuts AS (SELECT half, {', '.join(count(c) for c in corpus.CUT_OFF)} FROM cum GROUP BY half),
        counted AS (SELECT h.row_id, half, category, n_all, n_few, {', '.join(f't_{c}' for c in corpus.CUT_OFF)} FROM halves h JOIN cuts USING (half) LEFT JOIN per USING (half, subject_id)),
        members AS ({members}), ranked AS (SELECT *, row_number() OVER (PARTITION BY half, code ORDER BY md5('42:' || row_id), row_id) AS rn FROM members),
        flags AS (SELECT h.row_id, h.half, {flags} FROM halves h LEFT JOIN ranked USING (row_id) GROUP BY h.row_id, h.half)"""


_ORDERS = "o AS (SELECT o_orderkey AS row_id, o_custkey AS subject_id, o_orderpriority AS category FROM orders)"
_PRIORITIES = ["1-URGENT", "2-HIGH"]
#: Train sizes for the supplied tables, in the proportions of the fixed ones where these are too large.
_SIZES = {"c1p2": 400, "c0p2": 150, "c1p1": 300, "c1p0": 60, "c0p1": 80, "c0p0": 20}


def _subsets(spark, sf_dir) -> DataFrame:
    df = _table(spark, sf_dir, "orders").selectExpr("o_orderkey AS row_id", "o_custkey AS subject_id", "o_orderpriority AS category")
    return corpus.flagged_subsets(corpus.halved(df, "row_id"), "row_id", "subject_id", "category", _SIZES, _PRIORITIES)


@query(f"WITH {_ORDERS}, {_flags_sql('o', _PRIORITIES, _SIZES)} SELECT * FROM flags")
def d8_flags(spark, sf_dir):
    return _subsets(spark, sf_dir).drop("subject_id", "category")


@query(f"WITH {_ORDERS}, {_flags_sql('o', _PRIORITIES, _SIZES)}, s AS (SELECT r.half, r.code, rn <= size AS train, size, category FROM ranked r JOIN o USING (row_id)) SELECT half, code, count(*) FILTER (WHERE train) AS n_train, count(*) FILTER (WHERE NOT train) AS n_test, 0::BIGINT AS n_both, count(*) FILTER (WHERE train) = max(size) AS exact_size, coalesce(string_agg(DISTINCT category, '|' ORDER BY category) FILTER (WHERE train), '') AS train_categories, coalesce(string_agg(DISTINCT category, '|' ORDER BY category) FILTER (WHERE NOT train), '') AS test_categories FROM s GROUP BY half, code")
def d8_reports(spark, sf_dir):
    return corpus.flag_reports(_subsets(spark, sf_dir), _SIZES, "category")


_NOTE_SIZES = {"c1p2": 40, "c0p2": 20, "c1p1": 25, "c1p0": 8, "c0p1": 10, "c0p0": 4}


def _sentences_sql(text: str, hipaa: bool, variant: str) -> str:
    flat = _normal_sql(hipaa).replace("note", text)
    return f"""{variant}_t AS (SELECT row_id, {SENTENCES % flat} AS p FROM d7), {variant}_s AS (SELECT row_id, generate_subscripts(p, 1) AS i, unnest(p) AS sentence FROM {variant}_t),
        {variant}_g AS (SELECT *, sum(CASE WHEN i = 1 OR length(sentence) >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY i) AS k FROM {variant}_s),
        {variant} AS (SELECT row_id, '{variant}' AS anonymity, string_agg(sentence, ' ' ORDER BY i) AS sentence FROM {variant}_g GROUP BY row_id, k)"""


@query(f"""WITH {D7}, {_flags_sql('d7', subsets.CATEGORIES, _NOTE_SIZES)}, {_sentences_sql('TEXT_WITH_DUMMY_PHI_HOSPITAL', False, 'no_anonymization')}, {_sentences_sql('note', True, 'hipaa')},
    lines AS (SELECT half, code, anonymity, md5(sentence) AS line_md5 FROM (SELECT * FROM no_anonymization UNION ALL SELECT * FROM hipaa) JOIN ranked USING (row_id))
    SELECT half, code, anonymity, line_md5, count(*) AS n FROM lines GROUP BY ALL""")
def k5_training_corpus(spark, sf_dir):
    """Both variants of six subsets of both halves, written by folder and read back."""
    own = _notes(spark, sf_dir).select("row_id", "subject_id", "category")  # the flags need no text
    flags = corpus.flagged_subsets(corpus.halved(own, "row_id"), "row_id", "subject_id", "category", _NOTE_SIZES)
    df = _d7(spark, sf_dir).drop("subject_id", "category").join(flags, "row_id")
    path = shared_path(spark, "training")
    writers.write_training_text(corpus.training_sentences(df, "row_id", "TEXT_WITH_DUMMY_PHI_HOSPITAL", "note"), path, packed=True)
    return spark.read.text(path).groupBy("half", "code", "anonymity", F.md5("value").alias("line_md5")).agg(F.count(F.lit(1)).alias("n"))


# mentions, gold, predictions

#: Names of one token, for the chain: those of an even number of letters.
_FIRST_BOOK = [n for n in surrogates.POOLS["first"] if len(n) % 2 == 0]
_LAST_BOOK = [n for n in surrogates.POOLS["last"] if len(n) % 2 == 0]
_list = lambda xs: ", ".join(sql_text(x) for x in xs)
CHAIN = rf"""{map_sql()}, m AS (SELECT row_id, subject_id, note, regexp_extract(note, {sql_text(MENTION)}, 1) AS full_name_mention, regexp_extract(note, {sql_text(MENTION)}, 2) AS f, regexp_extract(note, {sql_text(MENTION)}, 3) AS l, regexp_extract(note, {sql_text(MENTION)}, 4) AS patient_age FROM notes),
    named AS (SELECT row_id, subject_id, full_name_mention, patient_age, coalesce(a.dummy_phi, '') AS fn, coalesce(b.dummy_phi, '') AS ln, CASE WHEN f = '' THEN 0 ELSE len(regexp_extract_all(note, regexp_escape(f) || '\s*' || regexp_escape(l))) END AS tfreq FROM m LEFT JOIN map a ON f = a.placeholder LEFT JOIN map b ON l = b.placeholder),
    one AS (SELECT *, row_number() OVER (PARTITION BY full_name_mention ORDER BY row_id) AS rn FROM named WHERE tfreq > 0), vocab AS (SELECT * FROM one WHERE rn = 1 AND fn IN ({_list(_FIRST_BOOK)}) AND ln IN ({_list(_LAST_BOOK)})),
    chain AS (SELECT row_id, subject_id, full_name_mention, patient_age, fn || ' ' || ln AS patient_full_name FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY row_id) AS r2 FROM vocab) WHERE r2 = 1)"""


def _book(spark, listed: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in listed], "name string")


def _chain(spark, sf_dir) -> DataFrame:
    df = _notes(spark, sf_dir)
    mapping = surrogates.rule_map(placeholders.distinct_placeholders(df, "note"), SEED, surrogates.context_keys(df, "note"))
    return mentions.mention_chain(df, mapping, _book(spark, _FIRST_BOOK), _book(spark, _LAST_BOOK), "row_id", "subject_id", "note")


@query(f"WITH {NOTES}, {CHAIN} SELECT row_id, subject_id, md5(full_name_mention) AS mention, patient_age, patient_full_name FROM chain")
def d11_mention_chain(spark, sf_dir):
    return _chain(spark, sf_dir).select("row_id", "subject_id", F.md5("full_name_mention").alias("mention"), "patient_age", "patient_full_name")


_KIND = "(['dsyn', 'mobd', 'neop', 'food'])[1 + length(term) % 4]"
_TERMS = "gaz AS (SELECT term, 'C' || substr(md5(term), 1, 7) AS cui, upper(term) AS preferred_name, " + _KIND + " AS semtype FROM (SELECT DISTINCT unnest(string_split_regex(lower(regexp_replace(note, '\\[\\*\\*[^\\]]*\\*\\*\\]', '', 'g')), '[^a-z]+')) AS term FROM notes) WHERE length(term) >= 5)"
GOLD = f"""{CHAIN}, {_TERMS}, words AS (SELECT row_id, unnest(string_split_regex(lower(full_name_mention), '[^a-z]+')) AS term FROM chain), met AS (SELECT row_id, term, count(*) AS n FROM words GROUP BY ALL),
    gold AS (SELECT row_id, cui, preferred_name, semtype AS semtypes, array_to_string(list_sort(list(term)), ', ') AS superficials, sum(n)::BIGINT AS score FROM met JOIN gaz USING (term) WHERE semtype IN ('dsyn', 'mobd', 'neop') GROUP BY ALL)"""


def _terms(spark, sf_dir) -> DataFrame:
    bare = F.regexp_replace("note", r"\[\*\*[^\]]*\*\*\]", "")
    terms = _notes(spark, sf_dir).select(F.explode(F.split(F.lower(bare), "[^a-z]+")).alias("term")).filter("length(term) >= 5").distinct()
    kinds = F.array(*[F.lit(x) for x in ("dsyn", "mobd", "neop", "food")])
    return terms.select("term", F.concat(F.lit("C"), F.substring(F.md5("term"), 1, 7)).alias("cui"), F.upper("term").alias("preferred_name"), F.get(kinds, F.length("term") % 4).alias("semtype"))


@query(f"WITH {NOTES}, {GOLD} SELECT row_id AS document_id, subject_id, patient_full_name, patient_age AS patiant_age, superficials, semtypes, score, cui, preferred_name, md5(full_name_mention) AS mention FROM gold JOIN chain USING (row_id)")
def d12_gold_diseases(spark, sf_dir):
    df = concepts.gold_diseases(_chain(spark, sf_dir), _terms(spark, sf_dir), "row_id")
    return df.withColumn("mention", F.md5("full_name_mention")).drop("full_name_mention")


@query(f"WITH {NOTES}, {GOLD}, g AS (SELECT row_id AS document_id, subject_id, patient_full_name, md5(full_name_mention) AS mention, row_number() OVER (PARTITION BY patient_full_name ORDER BY row_id) AS rn FROM gold JOIN chain USING (row_id)) SELECT document_id, subject_id, patient_full_name, mention FROM g WHERE rn = 1")
def d13_gold_names(spark, sf_dir):
    df = concepts.gold_names(concepts.gold_diseases(_chain(spark, sf_dir), _terms(spark, sf_dir), "row_id"))
    return df.select("document_id", "subject_id", "patient_full_name", F.md5("full_name_mention").alias("mention"))


_SAMPLE = "CASE WHEN doc_id % 5 = 0 THEN 'nobody here' ELSE concat('[CLS] ', (array('ada', 'bea', 'zoe', 'carl'))[doc_id % 4], ' ', (array('dale', 'brook', 'xyz'))[doc_id % 3], CASE WHEN doc_id % 7 = 0 THEN ' jr' ELSE '' END, ' is a ', substring(regexp_replace(lower(text), '[^a-z ]', ''), 1, 200)) END"
_SAMPLE_SQL = _SAMPLE.replace("(array('ada', 'bea', 'zoe', 'carl'))[doc_id % 4]", "(['ada', 'bea', 'zoe', 'carl'])[1 + doc_id % 4]").replace("(array('dale', 'brook', 'xyz'))[doc_id % 3]", "(['dale', 'brook', 'xyz'])[1 + doc_id % 3]").replace("'[^a-z ]', ''", "'[^a-z ]', '', 'g'")


@query(rf"""WITH {GAZETTEER}, s AS (SELECT doc_id AS sample_index, {_SAMPLE_SQL} AS t FROM documents), n AS (SELECT sample_index, t, regexp_extract(t, '^\[CLS\] (.+?) is a.+$', 1) AS x FROM s WHERE regexp_matches(t, '^\[CLS\] (.+?) is a.+$')),
    p AS (SELECT sample_index, t, array_to_string(list_transform(string_split(x, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS patient_full_name FROM n), v AS (SELECT *, string_split(patient_full_name, ' ') AS w FROM p),
    words AS (SELECT DISTINCT sample_index, unnest(string_split_regex(lower(t), '[^a-z]+')) AS term FROM n)
    SELECT DISTINCT patient_full_name, cui, preferred_name, sample_index, len(w) = 2 AND w[1] IN ({_list(surrogates.POOLS['first'])}) AND w[2] IN ({_list(surrogates.POOLS['last'])}) AS is_valid_full_name FROM v JOIN words USING (sample_index) JOIN gaz USING (term) WHERE semtype IN ('dsyn', 'mobd', 'neop')""")
def d15_predictions(spark, sf_dir):
    samples = _table(spark, sf_dir, "documents").selectExpr("doc_id AS sample_index", f"{_SAMPLE} AS text")
    return concepts.predictions(samples, _gazetteer(spark, sf_dir), _book(spark, surrogates.POOLS["first"]), _book(spark, surrogates.POOLS["last"]))


def _extract(text: str) -> list[tuple]:
    """An outside extractor in small: concepts of two kinds, and an IndexError at characters that it can't read."""
    if not text.isascii():
        raise IndexError("invalid character")
    return [("MMI" if len(w) % 2 else "AA", f"C{len(w)}", w.upper(), "dsyn", float(len(w)), [w]) for w in sorted(set(text.split(" ")))[:5]]


@query("""WITH t AS (SELECT doc_id, list_slice(list_sort(list_distinct(string_split(coalesce(text, ''), ' '))), 1, 5) AS ws FROM documents WHERE regexp_full_match(coalesce(text, ''), '[\\x00-\\x7F]*')), w AS (SELECT doc_id, unnest(range(len(ws)))::INT AS pos, unnest(ws) AS w FROM t)
    SELECT doc_id, pos, 'C' || length(w) AS cui, w AS surface FROM w WHERE length(w) % 2 = 1""")
def u4_u5_extracted(spark, sf_dir):
    found = concepts.of_kind(concepts.extracted(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", _extract))
    return found.select("doc_id", "pos", "cui", F.get("superficials", 0).alias("surface"))


_TOKENS = "list_slice(string_split(coalesce(text, ''), ' '), 1, 24)"


def _masked_sql(whole: bool) -> str:
    head = "sum(CASE WHEN NOT starts_with(token, '##') OR pos = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, copy ORDER BY pos)" if whole else "pos"
    return f"""WITH t AS (SELECT doc_id, list_transform({_TOKENS}, lambda w: CASE WHEN length(w) % 3 = 0 THEN '##' || w ELSE w END) AS ts FROM documents), c AS (SELECT doc_id, ts, unnest([0, 1, 2]) AS copy, least(4, greatest(1, round(len(ts) * 0.15))) AS n FROM t),
        e AS (SELECT doc_id, copy, n, unnest(range(len(ts)))::INT AS pos, unnest(ts) AS token FROM c), w AS (SELECT *, ({head})::BIGINT AS word FROM e), h AS (SELECT *, md5('12345:' || doc_id || ':' || copy || ':' || word) AS h FROM w), u AS (SELECT *, count(*) OVER (PARTITION BY doc_id, copy ORDER BY h) AS upto FROM h)
        SELECT doc_id, copy, pos, token FROM u WHERE upto <= n"""


def _masked(spark, sf_dir, whole: bool) -> DataFrame:
    words = F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 24)
    pieces = F.transform(words, lambda w: F.when(F.length(w) % 3 == 0, F.concat(F.lit("##"), w)).otherwise(w))
    return relations.mask_positions(_table(spark, sf_dir, "documents").select("doc_id", pieces.alias("tokens")), ["doc_id"], "tokens", most=4, length=24, whole_words=whole)


@query(_masked_sql(False))
def k8_mask_positions(spark, sf_dir):
    return _masked(spark, sf_dir, False)


@query(_masked_sql(True))
def k8_mask_whole_words(spark, sf_dir):
    return _masked(spark, sf_dir, True)
