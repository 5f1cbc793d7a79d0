"""Whole-text statistics as Column expressions, shared by the quality operators.

Null text counts as empty.  Every statistic covers the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubwell.llm.common import SPACE

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

WINDOW = 8

#: Columns that :func:`with_base_stats` adds.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def count_chars(text: Column, unwanted: str) -> Column:
    """How many characters of ``text`` do *not* match the class ``unwanted``."""
    return F.length(F.regexp_replace(text, unwanted, ""))


def _paired(arr: str, step: int) -> Column:
    """Hash of every element with the one ``step`` further on."""
    return F.transform(F.col(arr), lambda h, i: F.xxhash64(h, F.get(F.col(arr), i + step)))


def with_base_stats(df: DataFrame, text: str) -> DataFrame:
    """Adds the BASE columns, ``_text`` (never null) and ``_words`` for the text column ``text``.

    Windows of eight words are compared by 64-bit hash.  Only texts in which a
    window repeats are sorted; the others stop at a hash-set count.
    """
    df = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_words", words_of(F.col("_text")))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_h", _paired("_h", 1))
    df = df.withColumn("_h", _paired("_h", 2))
    df = df.withColumn("_h", _paired("_h", 4))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("_h", F.when(F.col("n_words") >= WINDOW, F.slice("_h", F.lit(1), F.col("n_words").cast("int") - (WINDOW - 1))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_repeats", F.size(F.array_distinct("_h")) < F.size("_h"))
    # (hash, position) sorted: a window repeats if a neighbour has the same hash
    df = df.withColumn("_s", F.when(F.col("_repeats"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.get(F.col("_s"), k)["h"] == x["h"]
    df = df.withColumn(
        "_p",
        F.sort_array(
            F.transform(
                F.filter("_s", lambda x, k: F.coalesce(same(x, k + 1), F.lit(False)) | ((k > 0) & F.coalesce(same(x, k - 1), F.lit(False)))),
                lambda x: x["i"],
            )
        ),
    )
    gaps = F.transform("_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), k + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)
    df = df.withColumn("n_repeat_words", F.when(F.col("_repeats"), covered).otherwise(F.lit(0).cast("long")))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    df = df.withColumn("word_chars", F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long"))
    df = df.withColumn("n_symbols", (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"))
    return df.withColumn("_n_lines", F.size("_lines")).drop("_h", "_s", "_p", "_repeats", "_lines")


#: Ratios in 0..1 (or small counts) that :func:`with_ratios` adds, the inputs of the quality models.
RATIOS = ["r_len", "r_word_len", "r_symbols", "r_upper", "r_digits", "r_bangs", "r_dup_lines", "r_repeat", "r_distinct", "r_stops", "r_line_words", "r_runs", "r_plain"]

#: Frequent short function words of English, French, German and Spanish.
STOPS = """
the of and to a in is that it was for on are as with be at by this from
le la les de des du et un une est que qui dans en pour pas sur au avec
der die das und ist von mit den dem ein eine nicht zu auf für im
el los las y del por con para su se al lo como no
""".split()


def with_ratios(df: DataFrame) -> DataFrame:
    """Adds the RATIOS to what :func:`with_base_stats` made."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest(F.length("_text"), F.lit(1))
    bare = F.transform("_words", lambda w: F.lower(w))
    df = df.withColumn("_low", bare)
    part = lambda x: x.cast("double")
    df = df.withColumns(
        {
            "r_len": F.log1p(part(F.col("n_words"))),
            "r_word_len": part(F.col("word_chars")) / n,
            "r_symbols": part(F.col("n_symbols")) / chars,
            "r_upper": part(count_chars(F.col("_text"), r"\P{Lu}+")) / chars,
            "r_digits": part(count_chars(F.col("_text"), r"[^0-9]+")) / chars,
            "r_bangs": part(F.length("_text") - F.length(F.replace(F.col("_text"), F.lit("!"), F.lit("")))) / chars,
            "r_dup_lines": part(F.col("n_dup_lines")) / F.greatest("_n_lines", F.lit(1)),
            "r_repeat": part(F.col("n_repeat_words")) / n,
            "r_distinct": part(F.size(F.array_distinct("_low"))) / n,
            "r_stops": part(F.size(F.filter("_low", lambda w: w.isin(STOPS)))) / n,
            "r_line_words": F.log1p(part(F.col("n_words")) / F.greatest("_n_lines", F.lit(1))),
            # words of letters only, but for punctuation around them
            "r_plain": part(F.size(F.filter("_words", lambda w: w.rlike(r"^[\"'(«¿¡]?[\p{L}'’-]+[.,;:!?)\"'»]?$")))) / n,
            # words equal to the word before: each pass of "no no no" counts
            "r_runs": part(F.size(F.filter("_low", lambda w, i: (i > 0) & (w == F.get(F.col("_low"), i - 1))))) / n,
        }
    )
    return df.drop("_low")
