"""The corpus from end to end: cleaned, resolved, filled for both halves, split, flagged, and turned into training text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubwell.functions.cleaning import clean
from scrubwell.functions.dates import backdate, resolve, year_shift
from scrubwell.functions.training_text import merge_short, normalise, sentences
from scrubwell.operators.placeholders import all_filled, all_have_id, fill_all, placeholders
from scrubwell.operators.ranking import global_rank, seeded
from scrubwell.operators.subsets import CATEGORIES, CODES, SIZES, half_split, in_categories
from scrubwell.operators.surrogates import SEEDS, keys_in_lines, rule_map, told_lines, with_ids
from scrubwell.schemas import UNUSED
from scrubwell.sources.shared import lean_kept

#: Subsets whose rare subjects are cut off, and those of some categories only.
CUT_OFF = ("c1p1", "c1p0", "c0p1", "c0p0")
FEW_CATEGORIES = ("c0p2", "c0p1", "c0p0")


def built(notes: DataFrame, key: str = "ROW_ID", text: str = "TEXT", seeds: dict[str, int] = SEEDS) -> DataFrame:
    """``notes`` with a text for each half, and the flags all_placeholders_replaced (in the first half's text) and all_placeholders_have_id.

    Cleaning and the rules that need no map are done once for both halves, and written
    into the shared folder; both maps are filled in one pass.  A half's
    map is made from the placeholders of the notes as they came, and from the keys
    that stand behind a telling word in the cleaned ones; it has only keys with an
    identifier, and is filled before the dates are shifted.
    """
    prepared = notes.withColumn("_clean", clean(F.col(text))).withColumn("_resolved", resolve(F.col("_clean")))
    # what the maps are made from is taken here, so that no later pass searches the texts for it, once for each half
    prepared = prepared.withColumns({"_keys": F.array_distinct(placeholders(F.col(text))), "_told": told_lines("_clean")}).drop("_clean")
    df = lean_kept(prepared, "resolved")  # read for the keys, for their pairs with notes, and for the fill
    # each half's map reads the keys
    keys, behind = lean_kept(df.select(F.explode("_keys").alias("placeholder")).distinct(), "keys"), lean_kept(keys_in_lines(df, "_told"), "keys")
    df = df.drop("_keys", "_told")
    filled = {half: f"_filled_{half}" for half in seeds}
    df = fill_all(df, {filled[half]: with_ids(rule_map(keys, seed, behind)) for half, seed in seeds.items()}, key, "_resolved")
    columns = [f"TEXT_WITH_DUMMY_PHI_{half.upper()}" for half in seeds]
    for half, out in zip(seeds, columns, strict=True):
        df = df.withColumn("_shift", year_shift(F.col(filled[half]))).withColumn(out, backdate(F.col(filled[half]), F.col("_shift"))).drop(filled[half], "_shift")
    flags = {"all_placeholders_replaced": all_filled(F.col(columns[0])), "all_placeholders_have_id": all_have_id(F.col(text))}
    return df.withColumns(flags).drop("_resolved")


def halved(corpus: DataFrame, key: str = "ROW_ID", seed: int = 42) -> DataFrame:
    """Adds ``half`` and leaves out the columns that half-corpora don't have."""
    return half_split(corpus, key, seed).drop(*UNUSED)


def thresholds(df: DataFrame, key: str, subject: str, chosen: Column, sizes: dict[str, int], by: str = "half") -> tuple[DataFrame, DataFrame]:
    """Rows of each subject (``n_all``, ``n_few`` in the chosen categories), and for each ``by`` the cut-off of each subset (columns t_code).

    One aggregation; the windows run over histograms of counts.
    """
    per = df.filter(F.col(subject).isNotNull()).groupBy(by, subject).agg(F.count(key).alias("n_all"), F.count(F.when(chosen, F.col(key))).alias("n_few"))
    kinds = F.array(F.struct(F.lit("all").alias("kind"), F.col("n_all").alias("n")), F.struct(F.lit("few").alias("kind"), F.col("n_few").alias("n")))
    hist = per.select(by, F.explode(kinds).alias("x")).select(by, "x.*").filter("n > 0").groupBy(by, "kind", "n").agg(F.sum("n").alias("docs"))
    w = Window.partitionBy(by, "kind").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("cd", F.sum("docs").over(w))
    over = lambda code: F.max(F.when((F.col("kind") == ("few" if code in FEW_CATEGORIES else "all")) & (F.col("cd") > sizes[code]), F.col("n")))
    return per, cum.groupBy(by).agg(*[F.coalesce(over(code), F.lit(-1)).alias(f"t_{code}") for code in CUT_OFF])


def flagged_subsets(df: DataFrame, key: str = "ROW_ID", subject: str = "SUBJECT_ID", category: str = "CATEGORY", sizes: dict[str, int] = SIZES, categories: list[str] = CATEGORIES, seed: int = 42, by: str = "half") -> DataFrame:
    """Adds in_train_<subset> and in_test_<subset> for all six subsets of each ``by``.

    A subset's rows are shuffled by ``seed``; the first ``sizes[code]`` train, the
    rest test.  All subsets are ranked in one pass, over a row for each membership.
    """
    chosen = in_categories(category, categories)
    per, cuts = thresholds(df, key, subject, chosen, sizes, by)
    counted = df.select(key, by, subject, chosen.alias("_few")).join(per, [by, subject], "left").join(F.broadcast(cuts), by, "left")  # one row for each half
    frequent = lambda code: F.col("n_few" if code in FEW_CATEGORIES else "n_all") >= F.col(f"t_{code}")
    member = lambda code: (F.col("_few") if code in FEW_CATEGORIES else F.lit(True)) & (frequent(code) if code in CUT_OFF else F.lit(True))
    codes = F.array_compact(F.array(*[F.when(member(code), F.lit(code)) for code in CODES]))
    rows = counted.select(key, by, F.explode(codes).alias("_code")).withColumn("_hash", seeded(F.col(key), seed))
    ranked = global_rank(rows, "_hash", key, "_place", [by, "_code"])
    size = F.create_map(*[F.lit(x) for code in CODES for x in (code, sizes[code])])
    sides = ranked.select(key, "_code", (F.col("_place") <= size[F.col("_code")]).alias("_train"))
    flag = lambda code, train: F.coalesce(F.bool_or((F.col("_code") == code) & (F.col("_train") == train)), F.lit(False))
    flags = sides.groupBy(key).agg(*[flag(code, train).alias(f"in_{side}_{CODES[code]}") for code in CODES for side, train in (("train", True), ("test", False))])
    names = [c for c in flags.columns if c != key]
    return df.join(flags, key, "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in names})


def flag_reports(df: DataFrame, sizes: dict[str, int] = SIZES, category: str = "CATEGORY", by: str = "half") -> DataFrame:
    """For each ``by`` and subset: sizes of both sides, rows on both, whether the train side has its size, and the categories of both sides."""
    sides = [F.struct(F.lit(code).alias("code"), F.lit(sizes[code]).alias("wanted"), F.col(f"in_train_{CODES[code]}").alias("train"), F.col(f"in_test_{CODES[code]}").alias("test")) for code in CODES]
    rows = df.select(by, F.col(category).alias("_c"), F.explode(F.array(*sides)).alias("x")).select(by, "_c", "x.*")
    held = lambda side: F.array_join(F.sort_array(F.collect_set(F.when(F.col(side), F.col("_c")))), "|")
    return rows.groupBy(by, "code").agg(
        F.count_if("train").alias("n_train"), F.count_if("test").alias("n_test"), F.count_if(F.col("train") & F.col("test")).alias("n_both"),
        (F.count_if("train") == F.max("wanted")).alias("exact_size"), held("train").alias("train_categories"), held("test").alias("test_categories"),
    )


def training_sentences(corpus: DataFrame, key: str = "ROW_ID", private: str | Column = "TEXT_WITH_DUMMY_PHI_HOSPITAL", public: str = "TEXT", by: str = "half") -> DataFrame:
    """``by``, code, anonymity, key, pos, sentence: both variants' training text of every subset, train and test rows alike.

    Each text is split once; only then are its sentences written for each subset.
    """
    codes = F.array_compact(F.array(*[F.when(F.col(f"in_train_{CODES[c]}") | F.col(f"in_test_{CODES[c]}"), F.lit(c)) for c in CODES]))
    parts = lambda text, hipaa: sentences(normalise(text, hipaa=hipaa))
    private = F.col(private) if isinstance(private, str) else private
    variants = F.array(F.struct(F.lit("no_anonymization").alias("anonymity"), parts(private, False).alias("p")), F.struct(F.lit("hipaa").alias("anonymity"), parts(F.col(public), True).alias("p")))
    df = corpus.select(by, key, codes.alias("_codes"), F.explode(variants).alias("x")).select(by, key, "_codes", "x.*")
    df = df.select(by, key, "_codes", "anonymity", F.posexplode(merge_short(F.col("p"))).alias("pos", "sentence"))
    return df.select(by, F.explode("_codes").alias("code"), "anonymity", key, "pos", "sentence")
