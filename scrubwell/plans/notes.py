"""Notes derived from the supplied tables: the same expression in Spark SQL and in the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_n = lambda e: f"cast({e} AS STRING)"
_p = lambda *parts: "concat('[**', " + ", ".join(parts) + ", '**]')"
_q = "chr(39)"
_x, _y = "doc_id % 14", "(doc_id // 14) % 17"

#: A note around each document's text, with placeholders of many kinds.
NOTE = f"""concat(
 'Admission Date:  ', {_p(_n('2100 + doc_id % 100'), "'-'", _n('doc_id % 12 + 1'), "'-'", _n('doc_id % 28 + 1'))}, '  Discharge Date: ', {_p(_n('2150 + doc_id % 60'), "'-1-2'")}, chr(10),
 CASE WHEN doc_id % 11 = 0 THEN '[**Known firstname **]' ELSE {_p("'Known firstname '", _n('doc_id % 50'))} END, ' ', CASE WHEN doc_id % 13 = 0 THEN '[**Known lastname **]' ELSE {_p("'Known lastname '", _n('doc_id % 70'))} END, ' is a ', {_n('20 + doc_id % 60')}, ' yo man seen by Dr. ', {_p("'Last Name (STitle) '", _n('doc_id % 40'))}, '!!. Grade of pain is 3. He was sent home. Dr. ', {_p("'Name (NI) '", _n('doc_id % 30'))}, ' agreed. See ', {_p("'Hospital '", _n('doc_id % 9'))}, '. Call ', {_p("'Telephone/Fax (1) '", _n('doc_id % 33'))}, '. ', chr(10),
 'Monday, ', {_p(_n('doc_id % 12 + 1'), "'-'", _n('doc_id % 28 + 1'))}, ' CT scan from ', {_p(_n('doc_id % 12 + 1'), "'-3'")}, ' and echo ', {_p("'4-'", _n('doc_id % 28 + 1'))}, ' on ', {_p("'5-6'")}, '.', chr(10),
 '____', chr(10), 'Edema [x] ___ Murmur a_b___', chr(10), '~~~', chr(10), 'weight __', {_n('doc_id % 80')}, '__ kg ~~ 7 ??????', chr(10), '....', chr(10),
 'Return in ', {_p(_n(_x), "'-'", _n(_y))}, ' days, in ', {_p(_n(_x), "'-'", _n(_y))}, ' weeks or in ', {_p(_n(_x), "'-'", _n(_y))}, ' months since ', {_p(_n('1 + doc_id % 12'), "'/'", _n('2140 + doc_id % 80'))}, ' or ', {_p(_n('1 + doc_id % 12'), "'/2570'")}, '; ', {_p("'263-11-28'")}, ' and ', {_q}, {_p("'96'")}, '; ', {_p(_n('2100 + doc_id % 150'))}, ' at ', {_p("'5-8'")}, ': CA ', {_p("'15'")}, '-9 now.', chr(10),
 CASE WHEN doc_id % 3 = 0 THEN '[**State **]' ELSE {_p("'State '", _n('doc_id % 5'))} END, chr(10), coalesce(text, ''))"""

#: (ROW_ID, SUBJECT_ID, CATEGORY, TEXT) for the oracle, whose integer division is //.
SQL = f"SELECT doc_id AS row_id, doc_id % 97 AS subject_id, CASE WHEN doc_id % 4 = 0 THEN 'Physician ' WHEN doc_id % 4 = 1 THEN 'Discharge summary' ELSE 'Nursing' END AS category, {NOTE} AS note FROM documents"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.selectExpr("doc_id AS row_id", "doc_id % 97 AS subject_id", "CASE WHEN doc_id % 4 = 0 THEN 'Physician ' WHEN doc_id % 4 = 1 THEN 'Discharge summary' ELSE 'Nursing' END AS category", f"{NOTE.replace('//', 'div')} AS note")
