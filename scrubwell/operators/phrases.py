"""Names of several words in texts, found approximately: an index of character trigrams, exact bounds, leftmost-longest spans.

A span (1 to ``max_words`` consecutive words) matches a name if the Jaccard similarity
of their sets of trigrams is ``similarity`` or more.  Two such sets have sizes within
that factor, and in any one order of all trigrams share one of their first
n - ceil(similarity * n) + 1; so spans meet names by (trigram, size class) of those
alone, nothing is missed, and what meets is compared exactly.

Spans never meet each other.  The index of up to ``BROADCAST_ROWS`` entries is
broadcast and spans stay where they are; a larger one is shuffled, and spans with it.
Up to ``FEW_NAMES`` names need no index (:func:`matched`): a table of how many trigrams
of a word each name may have bounds what a span of words shares with each of them, so
only spans that may match become rows.
Names are the rows of a gazetteer; equal names may have several concepts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIMILARITY = 0.7
MAX_WORDS = 5
#: An index of up to so many entries (trigram and name) is broadcast.
BROADCAST_ROWS = 500_000
#: Up to so many names are compared with every span by the bound of its words.
FEW_NAMES = 2_048
#: Words of a text that are looked at together, and words that a task remembers.
TOGETHER, REMEMBERED = 2_048, 16_384


def words(text: Column) -> Column:
    """The words of a text, lower-cased: runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def normal(name: Column) -> Column:
    return F.array_join(words(name), " ")


def trigrams(name: Column) -> Column:
    """The distinct trigrams of a name between edge marks."""
    marked = F.concat(F.lit("^"), name, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - 2, F.lit(1))), lambda i: F.substring(marked, i, F.lit(3))))


def _prefix(grams: Column, similarity: float) -> Column:
    """The trigrams of which one must be shared, in the order of their hashes."""
    n = F.size(grams)
    ordered = F.array_sort(F.transform(grams, lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))
    first = F.slice(ordered, F.lit(1), (n - F.ceil(F.lit(similarity) * n - F.lit(1e-9)) + 1).cast("int"))
    return F.transform(first, lambda x: x["g"])


def _size_class(n: Column, similarity: float) -> Column:
    if similarity >= 1:
        return n
    return F.floor(F.log(n.cast("double")) / F.lit(-math.log(similarity)) + F.lit(1e-9)).cast("int")


def index(names: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """gram, class, name, grams and n of every distinct name, for each trigram and size class by which a span may find it."""
    df = names.select(normal(F.col("term")).alias("name")).filter("name <> ''").distinct().withColumn("grams", trigrams(F.col("name"))).withColumn("n", F.size("grams"))
    own = _size_class(F.col("n"), similarity)
    df = df.withColumn("class", F.explode(F.array(own - 1, own, own + 1)))
    return df.withColumn("gram", F.explode(_prefix(F.col("grams"), similarity)))


def spans(texts: DataFrame, key: str, text: str, max_words: int = MAX_WORDS) -> DataFrame:
    """key, start, stop (word numbers from 0, stop not included) and surface of every span."""
    df = texts.select(key, words(F.col(text)).alias("_w")).filter(F.size("_w") > 0)
    of = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(max_words), F.size("_w") - i)), lambda n: F.struct(i.alias("start"), (i + n).alias("stop"), F.array_join(F.slice("_w", i + 1, n), " ").alias("surface")))
    each = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_w") - 1), of))
    return df.select(key, F.inline(each))


def similar(found: DataFrame, names: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``found`` (key, start, stop, surface) with each name that they match, and the similarity."""
    entries = index(names, similarity)
    bounds = entries.agg(F.min("n"), F.max("n"), F.count(F.lit(1))).first()
    if not bounds[2]:
        entries, low, high = entries.limit(0), 0, -1
    else:
        low, high = math.ceil(bounds[0] * similarity - 1e-9), math.floor(bounds[1] / similarity + 1e-9)
    if bounds[2] <= BROADCAST_ROWS:
        entries = F.broadcast(entries)
    # as many trigrams as letters at most: most spans go without making any
    df = found.filter(F.length("surface") >= low).withColumn("sg", trigrams(F.col("surface"))).withColumn("sn", F.size("sg")).filter(F.col("sn").between(low, high))
    df = df.withColumn("class", _size_class(F.col("sn"), similarity)).withColumn("gram", F.explode(_prefix(F.col("sg"), similarity)))
    both = df.join(entries, ["gram", "class"])
    # counted once: at the first trigram of the span's prefix that the name's prefix has too
    shared = F.array_intersect(_prefix(F.col("sg"), similarity), _prefix(F.col("grams"), similarity))
    both = both.filter(F.get(shared, F.lit(0)) == F.col("gram"))
    common = F.size(F.array_intersect("sg", "grams"))
    both = both.withColumn("similarity", common / (F.col("sn") + F.col("n") - common)).filter(F.col("similarity") >= similarity - 1e-12)
    return both.select(*found.columns, "name", "similarity")


def _around(word: str) -> list[str]:
    """The trigram around each letter of a word; a tab stands for what is before its first letter and behind its last one."""
    marked = f"\t{word}\t"
    return [marked[i : i + 3] for i in range(len(word))]


def near_spans(texts: DataFrame, key: str, text: str, listed: list[str], similarity: float, max_words: int) -> DataFrame:
    """key, start, stop, surface and name of every span and name of ``listed`` (normal, distinct, few) that may be similar enough.

    Each trigram of a span stands around a letter of a word, or around a blank between
    two.  So a span has at most as many of a name's m trigrams as its words have around
    their letters, and its blanks; and at least as many others as any of its words has.
    A similar span has at least ``similarity`` * (m + others) of the name's.
    """
    sets = [{m[i : i + 3] for i in range(max(1, len(m) - 2))} for m in (f"^{n}$" for n in listed)]
    # an edge of a word may be a blank or the span's edge
    holders: dict[str, set[int]] = {}
    for k, grams in enumerate(sets):
        for g in grams:
            holders.setdefault(("\t" if g[0] in " ^" else g[0]) + g[1:-1] + ("\t" if g[-1] in " $" else g[-1]), set()).add(k)
    order = {g: k for k, g in enumerate(holders)}
    most = 240 // max_words  # of a word, so that sums fit a byte
    sizes = np.array([len(g) for g in sets], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = np.zeros((len(order) + 1, len(listed)), np.uint8)
        for g, ks in holders.items():
            has[order[g], list(ks)] = 1
        known: dict[str, int] = {}
        table = np.zeros((REMEMBERED + TOGETHER + max_words, len(listed)), np.uint8)
        around = np.zeros(len(table), np.int64)

        def row(word: str) -> int:
            at = known.get(word)
            if at is None:
                at = known[word] = len(known)
                grams = _around(word)
                table[at] = np.minimum(has[[order[g] for g in grams if g in order]].sum(axis=0, dtype=np.int32), most)
                around[at] = len(set(grams))
            return at

        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for r, ws in enumerate(batch.column("_w").to_pylist()):
                for first in range(0, len(ws), TOGETHER):
                    if len(known) > REMEMBERED:
                        known.clear()
                    own = ws[first : first + TOGETHER + max_words - 1]
                    at = np.array([row(w) for w in own])
                    one = table[at]
                    total = np.zeros_like(one)
                    for k in range(1, max_words + 1):
                        starts = min(TOGETHER, len(own) - k + 1)
                        if starts <= 0:
                            break
                        total = total[:starts] + one[k - 1 : k - 1 + starts]
                        least = np.clip(np.ceil(similarity * sizes - 1e-9) - (k - 1), 0, most).astype(np.uint8)
                        i, name = np.nonzero(total >= least)
                        shares = [one[i + j, name].astype(np.int64) for j in range(k)]
                        others = np.max([np.where(x < most, np.maximum(around[at[i + j]] - x, 0), 0) for j, x in enumerate(shares)], axis=0, initial=0)
                        fits = (sum(shares) + k - 1 >= similarity * (sizes[name] + others) - 1e-9) | (np.max(shares, axis=0, initial=0) >= most)
                        i, name = i[fits].tolist(), name[fits].tolist()
                        found = [r] * len(i), [first + x for x in i], [first + x + k for x in i], [" ".join(own[x : x + k]) for x in i], [listed[x] for x in name]
                        for have, more in zip(out, found, strict=True):
                            have += more
            at, start, stop = (pa.array(x, pa.int32()) for x in out[:3])
            yield pa.RecordBatch.from_arrays([batch.column(key).take(at), start, stop, pa.array(out[3], pa.string()), pa.array(out[4], pa.string())], [key, "start", "stop", "surface", "name"])

    # few large files are few tasks otherwise
    df = texts.select(key, text).repartition(key).select(key, words(F.col(text)).alias("_w")).filter(F.size("_w") > 0)
    return df.mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, start int, stop int, surface string, name string")


def matched(texts: DataFrame, names: DataFrame, key: str, text: str, similarity: float = SIMILARITY, max_words: int = MAX_WORDS) -> DataFrame:
    """As :func:`similar` of the :func:`spans` of ``texts``; for few names, only spans that may match become rows."""
    normals = names.select(normal(F.col("term")).alias("name")).filter("name <> ''").distinct()
    listed = sorted(r["name"] for r in normals.limit(FEW_NAMES + 1).collect())
    if len(listed) > FEW_NAMES or max_words > 40:
        return similar(spans(texts, key, text, max_words), names, similarity)
    near = near_spans(texts, key, text, listed, similarity, max_words)
    common = F.size(F.array_intersect("_a", "_b"))
    near = near.withColumn("_a", trigrams(F.col("surface"))).withColumn("_b", trigrams(F.col("name")))
    near = near.withColumn("similarity", common / (F.size("_a") + F.size("_b") - common)).filter(F.col("similarity") >= similarity - 1e-12)
    return near.drop("_a", "_b")


def leftmost_longest(matches: DataFrame, key: str) -> DataFrame:
    """Spans that don't overlap: from the left the first to begin, of those the longest; each with its most similar name (the first of equals)."""
    best = matches.groupBy(key, "start", "stop", "surface").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "name")).alias("m"))
    # a text's own matches
    listed = F.array_sort(F.collect_list(F.struct("start", (-F.col("stop")).alias("before"), "surface", F.col("m.name").alias("name"), (-F.col("m.less")).alias("similarity"))))
    kind = "struct<start: int, before: int, surface: string, name: string, similarity: double>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("kept"))
    step = lambda acc, x: F.when(x["start"] >= acc["at"], F.struct((-x["before"]).alias("at"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)
    chosen = best.groupBy(key).agg(listed.alias("_all")).select(key, F.inline(F.aggregate("_all", empty, step, lambda acc: acc["kept"])))
    return chosen.select(key, "start", (-F.col("before")).alias("stop"), "surface", "name", "similarity")


def phrase_matches(texts: DataFrame, gazetteer: DataFrame, key: str, text: str, similarity: float = SIMILARITY, max_words: int = MAX_WORDS) -> DataFrame:
    """``key``, the gazetteer's columns (term, cui, preferred_name, semtype), start, stop, surface and similarity of every chosen span and concept."""
    chosen = leftmost_longest(matched(texts, gazetteer, key, text, similarity, max_words), key)
    return chosen.join(gazetteer.withColumn("name", normal(F.col("term"))), "name").drop("name")
