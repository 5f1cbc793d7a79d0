"""Every rule on notes made from ``documents``: a hand-written line is put to each text, and its expected result is written by hand.

Case k stands in the documents whose id leaves k by the number of cases, so the
rules run over all whole texts.  What becomes of the rest of the note is compared, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubwell.functions import cleaning, dates, names, training_text
from scrubwell.functions.rules import sql_rewrite_lines, sql_text
from scrubwell.operators import placeholders, surrogates
from scrubwell.plans import cases
from scrubwell.plans.catalog import SEED, _normal_sql, _table, query

#: Stands on a line of its own between a document's text and the case; no rule touches it.
MARK = "\n%%case%%\n"
_MARK_SQL = "chr(10) || '%%case%%' || chr(10)"


def _values(rows: list[tuple], columns: list[str]) -> str:
    """The rows as a table ``c`` of the oracle, numbered by ``k``."""
    shown = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else sql_text(v)
    return f"c AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(shown(v) for v in (k, *r)) + ')' for k, r in enumerate(rows))}) AS t(k, {', '.join(columns)}))"


def _joined(n: int) -> str:
    return f"documents JOIN c ON doc_id % {n} = k"


def _with_cases(spark, sf_dir, rows: list[tuple], schema: str) -> DataFrame:
    """doc_id, text (never null) and the case of every document; the cases are a small fixed list."""
    listed = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}")
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.join(F.broadcast(listed), F.col("doc_id") % len(rows) == F.col("k"))


def _note() -> F.Column:
    return F.concat("text", F.lit(MARK), "before")


def _parts(done, name: str) -> list[F.Column]:
    """What became of the case, and a digest of what became of the text before it."""
    return [F.substring_index(done, MARK, -1).alias(name), F.md5(F.substring_index(done, MARK, 1)).alias("rest")]


_BEFORE = "rule string, before string"
_rules = lambda rows, *more: [(r[0], *(r[k] for k in more)) for r in rows]


@query(f"WITH {_values(_rules(cases.CLEANING, 2), ['rule', 'cleaned'])} SELECT doc_id, rule, cleaned, md5({sql_rewrite_lines("coalesce(text, '')", cleaning.CLEANING)}) AS rest FROM {_joined(len(cases.CLEANING))}")
def c_case_lines(spark, sf_dir):
    df = _with_cases(spark, sf_dir, _rules(cases.CLEANING, 1), _BEFORE)
    return df.select("doc_id", "rule", cleaning.clean(_note()).alias("done")).select("doc_id", "rule", *_parts(F.col("done"), "cleaned"))


@query(f"WITH {_values(_rules(cases.DATES, 2), ['rule', 'resolved'])} SELECT doc_id, rule, resolved, md5(coalesce(text, '')) AS rest FROM {_joined(len(cases.DATES))}")
def e_case_lines(spark, sf_dir):
    df = _with_cases(spark, sf_dir, _rules(cases.DATES, 1), _BEFORE)
    return df.select("doc_id", "rule", dates.resolve(_note()).alias("done")).select("doc_id", "rule", *_parts(F.col("done"), "resolved"))


@query(f"WITH {_values(_rules(cases.BACKDATING, 2), ['rule', 'backdated'])} SELECT doc_id, rule, backdated, md5(coalesce(text, '')) AS rest FROM {_joined(len(cases.BACKDATING))}")
def r_case_lines(spark, sf_dir):
    df = _with_cases(spark, sf_dir, _rules(cases.BACKDATING, 1), _BEFORE).withColumn("note", _note()).withColumn("shift", dates.year_shift(F.col("note")))
    return df.select("doc_id", "rule", dates.backdate(F.col("note"), F.col("shift")).alias("done")).select("doc_id", "rule", *_parts(F.col("done"), "backdated"))


_WORD = " endofnote "


@query(f"""WITH {_values(_rules(cases.NORMAL, 1, 2, 3), ['rule', 'before', 'plain', 'hipaa'])}
    SELECT doc_id, rule, plain, hipaa, md5({_normal_sql(False)}) AS rest FROM (SELECT *, CASE WHEN before IS NOT NULL THEN coalesce(text, '') END AS note FROM {_joined(len(cases.NORMAL))})""")
def n_case_lines(spark, sf_dir):
    df = _with_cases(spark, sf_dir, _rules(cases.NORMAL, 1), _BEFORE).withColumn("note", F.concat("text", F.lit(_WORD), "before"))
    done = df.withColumn("plain", training_text.normalise(F.col("note"))).withColumn("hipaa", training_text.normalise(F.col("note"), hipaa=True))
    last = lambda c: F.trim(F.substring_index(c, _WORD.strip(), -1)).alias(c)
    return done.select("doc_id", "rule", last("plain"), last("hipaa"), F.md5(F.trim(F.substring_index("plain", _WORD.strip(), 1))).alias("rest"))


@query(f"WITH {_values([(r[0], r[1]) for r in cases.SURROGATES], ['rule', 'placeholder'])} SELECT doc_id, rule, placeholder, TRUE AS as_expected FROM {_joined(len(cases.SURROGATES))}")
def v_case_shapes(spark, sf_dir):
    """The surrogate of every placeholder rule has its shape; the keys, and the words that tell what some of them are, are read from the notes."""
    df = _with_cases(spark, sf_dir, [tuple(r) for r in cases.SURROGATES], "rule string, placeholder string, shape string")
    told = F.when(F.array_contains(F.array(*[F.lit(p) for p in cases.IN_CONTEXT]), F.col("placeholder")), F.lit(cases.CONTEXT)).otherwise(F.col("placeholder"))
    df = df.withColumn("note", F.concat("text", F.lit("\n"), told))
    mapping = surrogates.rule_map(placeholders.distinct_placeholders(df, "note"), SEED, surrogates.context_keys(df, "note"))
    met = df.join(mapping, "placeholder", "left")
    fine = F.when(F.col("shape").isNull(), F.col("dummy_phi").isNull()).otherwise(F.coalesce(F.expr("dummy_phi RLIKE shape"), F.lit(False)))
    return met.select("doc_id", "rule", "placeholder", fine.alias("as_expected"))


@query(f"WITH {_values(cases.WHOLE_LINES, ['note', 'filled'])} SELECT doc_id, filled || chr(10) || '[**' || doc_id || '**]' || coalesce(text, '') AS filled FROM {_joined(len(cases.WHOLE_LINES))}")
def v9_case_lines(spark, sf_dir):
    """A line that begins with Email: is a key; it is filled where it is a whole segment (here the value is set by hand)."""
    df = _with_cases(spark, sf_dir, cases.WHOLE_LINES, "before string, after string")
    # the key is a segment of its own where a placeholder follows it on the next line's start, as the line break is cut off below
    df = df.select("doc_id", F.concat("before", F.lit("[**"), F.col("doc_id").cast("string"), F.lit("**]"), "text").alias("note"), "before")
    keys = surrogates.context_keys(df.select(F.col("before").alias("note")), "note").filter("ord = 9").select("placeholder", F.lit("x").alias("dummy_phi"))
    done = placeholders.fill(df, keys, "doc_id", "note", "filled")
    return done.select("doc_id", F.concat(F.substring_index("filled", "[**", 1), F.lit("\n"), F.expr("substr(filled, instr(filled, '[**'))")).alias("filled"))


@query(f"WITH {_values(cases.KINDS, ['form', 'kind', 'asks'])}, p AS (SELECT doc_id, kind, asks, doc_id % 2 = 0 AS has_id, replace(form, '#', CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE '' END) AS placeholder FROM {_joined(len(cases.KINDS))}) SELECT doc_id, placeholder, kind, has_id AS required, has_id OR (NOT asks AND kind IN ('initial')) AS listed FROM p")
def m1_m2_case_kinds(spark, sf_dir):
    """Name placeholders with and without identifier: the kind, whether the pattern that asks for one matches, and whether a listed one does."""
    df = _with_cases(spark, sf_dir, cases.KINDS, "form string, own string, asks boolean")
    df = df.withColumn("placeholder", F.replace("form", F.lit("#"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise("")))
    whole = lambda p: F.col("placeholder").rlike(f"^(?:{p})$")
    kinds = [F.when(whole(names.pattern(k, False)), F.struct(F.lit(k).alias("kind"), whole(names.pattern(k)).alias("required"), whole("|".join(names.patterns(k))).alias("listed"))) for k in names.FORMS]
    return df.select("doc_id", "placeholder", F.explode(F.array_compact(F.array(*kinds))).alias("x")).select("doc_id", "placeholder", "x.*")


@query(f"WITH {_values(cases.LEFT, ['note', 'replaced', 'have_id'])} SELECT doc_id, note, replaced, have_id FROM {_joined(len(cases.LEFT))}")
def p10_p11_case_notes(spark, sf_dir):
    df = _with_cases(spark, sf_dir, cases.LEFT, "case_note string, r boolean, h boolean").withColumn("note", F.concat("text", F.lit("\n"), "case_note"))
    return df.select("doc_id", F.col("case_note").alias("note"), placeholders.all_filled(F.col("note")).alias("replaced"), placeholders.all_have_id(F.col("note")).alias("have_id"))
