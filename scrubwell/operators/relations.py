"""Small relational operators over rows, lines and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.explode(F.split(text, "\n")).alias("line"))


def lines_with(lines: DataFrame, patterns: list[str], line: str = "line") -> DataFrame:
    """The lines that match any of the patterns."""
    return lines.filter(F.col(line).rlike("|".join(f"(?:{p})" for p in patterns)))


def lines_without(lines: DataFrame, patterns: list[str], line: str = "line") -> DataFrame:
    """The lines that match none of the patterns."""
    return lines.filter(~F.col(line).rlike("|".join(f"(?:{p})" for p in patterns)))


def distinct_sorted(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by`` and the sorted distinct values as an array."""
    return df.groupBy(*by).agg(F.sort_array(F.collect_set(value)).alias(value))


def adjacent_deduped(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
    return df.withColumns({"_before": before, "_first": first}).filter(F.col("_first") | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_first")


def flattened(parts: Column, split: str) -> Column:
    """One list of the pieces of all parts."""
    return F.flatten(F.transform(parts, lambda x: F.split(x, split)))


def attached(df: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """``df`` with the columns of ``more`` for its key; null where there is none."""
    return df.join(more, key, "left")


def rows_of(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ``ids``."""
    return df.join(ids.select(key), key, "left_semi")


def gathered(values: DataFrame, chosen: DataFrame, index: str) -> DataFrame:
    """The values at the chosen indexes, with the columns of ``chosen``."""
    return values.join(chosen, index)


def zipped_lists(df: DataFrame, keep: list[str], **lists: Column) -> DataFrame:
    """Parallel lists, a row for each position."""
    return df.select(*keep, F.inline(F.arrays_zip(*[c.alias(n) for n, c in lists.items()])).alias(*lists))


def union_of(frames: dict[str, DataFrame], name: str = "rule") -> DataFrame:
    """All rows of all frames, repeated ones too, with the name of their frame."""
    out = None
    for label, df in frames.items():
        part = df.withColumn(name, F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def with_following(items: Column) -> Column:
    """pos, item, following (empty at the end) of each item of a list."""
    return F.transform(items, lambda x, i: F.struct(i.alias("pos"), x.alias("item"), F.coalesce(F.get(items, i + 1), F.lit("")).alias("following")))


def head_of_size(ranked: DataFrame, other: DataFrame, rank: str = "rn") -> DataFrame:
    """As many first rows of ``ranked`` (rank from 1) as ``other`` has rows."""
    size = other.agg(F.count(F.lit(1)).alias("_n"))  # one row
    return ranked.join(F.broadcast(size), F.col(rank) <= F.col("_n")).drop("_n")


def mask_positions(df: DataFrame, by: list[str], tokens: str, copies: int = 3, share: float = 0.15, most: int = 20, length: int = 128, seed: int = 12345, whole_words: bool = False) -> DataFrame:
    """``by``, copy, pos, token: which tokens of each copy of a sequence are masked.

    ``share`` of the first ``length`` tokens, one at least and ``most`` at most, in
    the order of a hash of seed, copy and position.  ``whole_words``: pieces that
    begin with ## go with the token before them, and a word is taken only if all its
    pieces still fit.
    """
    # an id's sequences in one row, so that no task sorts a row for each token and copy; those of one id share their words and places
    df = df.select(*by, F.slice(tokens, 1, length).alias("_t")).filter(F.size("_t") > 0).groupBy(*by).agg(F.collect_list("_t").alias("_s"), F.max(F.size("_t")).alias("_l"))
    at = F.sequence(F.lit(0), F.col("_l") - 1)
    total = lambda xs, f: F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + f(x))
    there = lambda i, s: (F.size(s) > i).cast("long")
    head = lambda i, s: (F.size(s) > i).cast("long") * F.coalesce((~F.get(s, i).startswith("##") | (i == 0)).cast("long"), F.lit(0))
    rows = F.transform(at, lambda i: F.struct(total(F.col("_s"), lambda s: there(i, s)).alias("n"), total(F.col("_s"), lambda s: head(i, s)).alias("heads")))
    words = F.transform("_rows", lambda _, i: total(F.slice("_rows", F.lit(1), i + 1), lambda r: r["heads"])) if whole_words else F.transform("_rows", lambda _, i: i.cast("long"))
    # rows are exploded as one, which keeps them from being made again wherever they are used
    df = df.select(*by, "_s", F.explode(F.array(rows)).alias("_rows")).select("*", F.explode(F.array(words)).alias("_w"))
    named = lambda copy, w: F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in by], copy.cast("string"), w.cast("string")))
    each = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda copy: F.struct(copy.alias("copy"), F.transform("_w", lambda w, i: F.struct(named(copy, w).alias("h"), F.get("_rows", i)["n"].alias("n"))).alias("_x")))
    df = df.select(*by, "_s", F.inline(each))
    upto = F.transform("_x", lambda own: total("_x", lambda x: F.when(x["h"] <= own["h"], x["n"]).otherwise(0)))
    df = df.select(*by, "_s", "copy", F.explode(F.array(upto)).alias("_upto"))
    df = df.select(*by, "copy", "_upto", F.explode("_s").alias("_t"))
    df = df.select(*by, "copy", "_upto", F.least(F.lit(most), F.greatest(F.lit(1), F.round(F.size("_t") * share).cast("int"))).alias("_n"), F.posexplode("_t").alias("pos", "token"))
    return df.filter(F.get("_upto", F.col("pos")) <= F.col("_n")).select(*by, "copy", "pos", "token")
