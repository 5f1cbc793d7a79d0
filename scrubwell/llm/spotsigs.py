"""SpotSigs fingerprints: chains of content words that follow common words.

Every common word (anchor) starts a signature: the anchor and the next ``CHAIN``
words that are not common.  Each text also has one anchor at its start.  In a
text with fewer than one common word in ``SPARSE`` words (another language, code,
lists) every word is an anchor and followed by any next ``CHAIN`` words, so that
its signatures cover its whole length.  A text's fingerprint is the sorted set of
its signatures' hashes.

:func:`classes` finds near copies: equal fingerprints are one class; only classes
whose set lengths allow the wanted Jaccard similarity and which share one of the
rarest signatures that a similar set must share (prefix filter) meet, partitioned
by set length; sizes and parity maps sift them, and the rest are compared exactly.
:func:`near_classes` gives every document its class and the group of classes that
links join.

Defined results: null text is empty; an empty text has no signature and an empty
fingerprint, and likeness 1 to another empty one; repeated rows have equal
fingerprints; rows of one doc_id follow each other in the order of their text's
hash, and are dealt to many tasks by it; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubwell.llm.common import lean
from scrubwell.llm.common import lean_cut as cut
from scrubwell.llm.simhash import bounded, components, stars
from scrubwell.llm.textstats import STOPS

CHAIN = 2
SPARSE = 16
#: Members of a signature of which each group has so many on either side.
MEET_ROWS = 2_000
#: Members of a signature from which on a pair meets in the least signature that both share; so many of these are known of each member.
MANY, LEAST = 32, 8
#: Members drawn from such a signature, which the others meet before all pairs do.
DRAWN = 4
#: Signatures of a set from which on a folded parity map of 256 bits says little.
LARGE = 250
#: So many of a root's candidate pairs are checked first, at most.
FIRST = 8
#: Up to so many candidate pairs are checked at once.
AT_ONCE = 5_000
#: Cells of the table of how many signatures fall where.
COUNTED = 1 << 16
_ANCHOR, _CONTENT = "\x01", "\x02"


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the sorted array of distinct signature hashes (64 bits) of the text column ``text``.

    Words are marked as common or not and joined, so that splitting at the marks
    gives, for each content word, the anchors right before it.
    """
    # a-z and 0-9 are letters and digits too, named for speed
    df = df.withColumn("_w", F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z0-9\p{L}\p{N}]+"), lambda w: w != ""))
    marked = F.concat(F.lit("^" + _ANCHOR), F.array_join(F.transform("_w", lambda w: F.concat(w, F.when(w.isin(STOPS), _ANCHOR).otherwise(_CONTENT))), ""))
    # anchors and, last, the content word after them; the last part has no content word
    df = df.withColumn("_m", marked).withColumn("_m", F.transform(F.split("_m", _CONTENT), lambda g: F.split(g, _ANCHOR)))
    df = df.withColumn("_c", F.transform("_m", lambda g: F.element_at(g, -1)))
    sparse = (F.size("_w") - F.size("_m") + 1) * SPARSE < F.size("_w")
    after = lambda i, k: F.coalesce(F.get(F.col("_c"), i + k), F.lit(""))
    chains = F.transform(
        "_m",
        lambda g, i: F.when(
            (F.size(g) > 1) & ((i == 0) | (i < F.size("_m") - 1)),
            F.transform(F.slice(g, 1, F.size(g) - 1), lambda a: F.xxhash64(a, *[after(i, k) for k in range(CHAIN)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    word = lambda i: F.coalesce(F.get(F.col("_w"), i), F.lit(""))
    every = F.transform("_w", lambda w, i: F.xxhash64(w, *[word(i + k) for k in range(1, CHAIN + 1)]))
    start = F.array(F.xxhash64(F.lit("^"), *[word(F.lit(k)) for k in range(CHAIN)]))
    df = df.withColumn(out, F.sort_array(F.array_distinct(F.when(sparse, F.concat(start, every)).otherwise(F.flatten(chains)))))
    # a text without any word has no signature
    return df.withColumn(out, F.when(F.size("_w") > 0, F.col(out)).otherwise(F.array().cast("array<bigint>"))).drop("_m", "_c", "_w")


def as_string(signatures: Column) -> Column:
    return F.lower(F.array_join(F.transform(signatures, lambda s: F.lpad(F.hex(s), 16, "0")), ""))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def _search(x: Column, bounds: list, low: int, high: int) -> Column:
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(x > bounds[mid], _search(x, bounds, mid + 1, high)).otherwise(_search(x, bounds, low, mid))


def signed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, _id (never null), _h (hash of the text), mark (equal for equal fingerprints), s (the signatures), n and bits (their number and parity map), and a number of its own (row) of every row."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    df = with_signatures(df, "_text", "s")
    return df.select("doc_id", "_id", "_h", F.xxhash64("s").alias("mark"), "s", F.size("s").alias("n"), parity(F.col("s")).alias("bits"), F.monotonically_increasing_id().alias("row"))


def one_each(rows: DataFrame) -> DataFrame:
    """One row of every fingerprint; the numbers of the chosen rows meet the rows where they are, as long as they are few enough for a broadcast."""
    chosen = cut(rows.groupBy("mark").agg(F.min("row").alias("row")).select("row"))
    return rows.join(bounded(chosen), "row", "left_semi")


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def levels(rows: DataFrame) -> Column:
    """A literal of COUNTED bytes: for each cell, into which signatures fall by hash, the bit length of the number of signatures in it."""
    counts = rows.select(F.explode("s").alias("g")).groupBy(F.pmod("g", F.lit(COUNTED)).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    found = bytearray(COUNTED)
    for r in counts.collect():  # COUNTED rows at most
        found[r["cell"]] = r["n"].bit_length()
    return F.lit(bytes(found))


def prefixes(rows: DataFrame, similarity: float) -> DataFrame:
    """g, mark, n, c: the first signatures of every fingerprint, its size, and the members of the signature.

    In any one order of all signatures, sets of Jaccard ``similarity`` share one of
    their first n - ceil(similarity * n) + 1.  The order here puts signatures of full
    cells last.  ``rows``: one of each fingerprint.
    """
    n, level = F.size("s"), levels(rows)
    order = F.sort_array(F.transform("s", lambda g: F.struct(F.substring(level, F.pmod(g, F.lit(COUNTED)).cast("int") + 1, F.lit(1)).alias("level"), g.alias("g"))))
    first = F.slice(order, F.lit(1), (n - F.ceil(F.lit(similarity) * n - F.lit(1e-9)) + 1).cast("int"))
    entries = rows.filter(n > 0).select(F.explode(first).alias("x"), "mark", n.alias("n")).select("x.g", "mark", "n")
    own = Window.partitionBy("g")
    return entries.withColumn("lo", F.min("mark").over(own)).withColumn("hi", F.max("mark").over(own)).withColumn("c", F.count(F.lit(1)).over(own)).filter("lo <> hi").select("g", "mark", "n", "c")


def parity(s: Column) -> Column:
    """512 bits as eight longs: each the parity of the signatures that fall on it.  Maps differ in at most as many bits as sets differ in signatures."""
    one = F.lit(1).cast("long")
    bit = lambda g: F.call_function("shiftleft", one, F.pmod(F.shiftrightunsigned(g, 50), F.lit(64)).cast("int"))
    of = lambda k: F.filter(s, lambda g: F.pmod(F.shiftrightunsigned(g, 40), F.lit(8)) == k)
    return F.array(*[F.aggregate(of(k), F.lit(0).cast("long"), lambda acc, g: acc.bitwiseXOR(bit(g))) for k in range(8)])


def _mixed(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """g, mark, n, root, and whether g has MANY members (many): the members of signatures whose members have more than one root."""
    own = Window.partitionBy("g")
    rooted = shared.join(bounded(roots), shared["mark"] == F.col("node"), "left").select("g", "mark", "n", F.coalesce("root", "mark").alias("root"))
    return rooted.withColumn("lo", F.min("root").over(own)).withColumn("hi", F.max("root").over(own)).withColumn("many", F.count(F.lit(1)).over(own) >= MANY).filter("lo <> hi").drop("lo", "hi")


def _mapped(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` with the parity map folded to half (_0 to _3): its bits differ in no more places."""
    folded = [F.col("bits")[k].bitwiseXOR(F.col("bits")[k + 4]).alias(f"_{k}") for k in range(4)]
    return rows.join(bounded(sizes).select("mark", *folded), "mark")


def _fits(l: Callable[[str], Column], r: Callable[[str], Column], similarity: float) -> Column:  # noqa: E741
    """Whether sizes and folded parity maps allow the similarity."""
    differ = sum((F.bit_count(l(f"_{k}").bitwiseXOR(r(f"_{k}"))) for k in range(1, 4)), F.bit_count(l("_0").bitwiseXOR(r("_0"))))
    return (F.least(l("n"), r("n")) >= similarity * F.greatest(l("n"), r("n")) - 1e-9) & (differ <= (1 - similarity) / (1 + similarity) * (l("n") + r("n")) + 1e-9)


def draws(shared: DataFrame, sizes: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """a, b (a < b): the members of each signature with MANY members, each with DRAWN other ones of another root, where both may be alike.

    The drawn ones differ from signature to signature, so a fingerprint that a hub has
    not joined to its group tries many members of it, and the pairs stay in proportion
    to the entries.
    """
    rooted = cut(_mapped(_mixed(shared.filter(F.col("c") >= MANY), roots).drop("many"), sizes))
    part = F.pmod(F.xxhash64("g", "mark"), F.lit(DRAWN)).alias("part")
    drawn = cut(rooted.groupBy("g", part).agg(F.min(F.struct(F.xxhash64("mark", "g").alias("h"), *[c for c in rooted.columns if c != "g"])).alias("x")).select("g", "x.*")).alias("r")
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    met = rooted.alias("l").join(drawn, (l("g") == r("g")) & (l("root") != r("root")) & _fits(l, r, similarity))
    return met.select(F.least(l("mark"), r("mark")).alias("a"), F.greatest(l("mark"), r("mark")).alias("b")).distinct()


def candidates(shared: DataFrame, sizes: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """a, b (a < b): all fingerprints that share a signature and not a root, and whose sizes and parity maps allow the similarity."""
    return meetings(shared, sizes, roots, similarity).distinct()


def meetings(shared: DataFrame, sizes: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """The pairs of :func:`candidates`, some of them more than once.

    ``roots``: node and root of fingerprints that are linked already; a signature
    whose members have one root is left out.  The others are partitioned by set
    length, each partition as wide as one similarity step; a partition meets itself
    and the one below it.  The members of a common signature are cut into chunks of
    MEET_ROWS, and each pair of chunks meets in a group of its own.

    Near copies share most signatures and would meet in each.  So a member of
    signatures with MANY members knows the LEAST smallest of these, and a pair that
    has one in common there leaves out all larger ones.
    """
    p = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(similarity)) + F.lit(1e-9)).cast("int")
    rooted = cut(_mapped(_mixed(shared, roots).withColumn("p", p), sizes))
    least = bounded(cut(rooted.filter("many").groupBy("mark").agg(F.slice(F.array_sort(F.collect_set("g")), 1, LEAST).alias("least"))))
    rooted = rooted.join(least, "mark", "left").withColumn("least", F.when(F.col("many"), F.col("least"))).drop("many")
    left = rooted
    right = rooted.withColumn("q", F.col("p")).withColumn("p", F.explode(F.array("p", F.col("p") + 1)))
    # the number of chunks, where it is not one: a row for so many members at least
    chunks = lambda df, name: bounded(cut(df.groupBy("g", "p").agg(F.ceil(F.count(F.lit(1)) / MEET_ROWS).cast("int").alias(name)).filter(F.col(name) > 1)))
    nx, ny = chunks(left, "nx"), chunks(right, "ny")
    meeting = lambda df: df.join(nx, ["g", "p"], "left").join(ny, ["g", "p"], "left").withColumns({"nx": F.coalesce("nx", F.lit(1)), "ny": F.coalesce("ny", F.lit(1))})
    mine = lambda n: F.pmod(F.xxhash64("mark"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = meeting(left).withColumn("x", mine("nx")).withColumn("y", every("ny")).drop("nx", "ny").alias("l")
    right = meeting(right).withColumn("y", mine("ny")).withColumn("x", every("nx")).drop("nx", "ny").alias("r")
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    same = (l("g") == r("g")) & (l("p") == r("p")) & (l("x") == r("x")) & (l("y") == r("y"))
    once = (r("q") < l("p")) | (l("mark") < r("mark"))
    here = F.coalesce(F.array_min(F.array_intersect(l("least"), r("least"))) >= l("g"), F.lit(True))
    met = left.join(right, same & once & (l("root") != r("root")) & _fits(l, r, similarity) & here)
    return met.select(F.least(l("mark"), r("mark")).alias("a"), F.greatest(l("mark"), r("mark")).alias("b"))


def _together(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` with the ``s`` of both, as sa and sb.

    A pair first gets the set of its ``b``, which may be the hub of many pairs, and
    is then sent to its ``a``, so the sets travel to evenly spread keys.
    """
    return pairs.join(sets.select(F.col("mark").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("mark").alias("a"), F.col("s").alias("sa")), "a")


def _nodes(pairs: DataFrame) -> DataFrame:
    return bounded(cut(pairs.select(F.explode(F.array("a", "b")).alias("mark")).distinct()))


def alike(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (materialised) whose fingerprints have at least that Jaccard similarity; ``rows``: one of each fingerprint.

    Pairs of large sets, whose parity maps are too full to tell them apart, first meet
    by a quarter of their signatures: alike sets differ in at most
    (1 - s) / (1 + s) * (n + m) of all, so in no more of a quarter.  Only the sets of
    what is left travel whole.
    """
    counted = rows.select("mark", "n").join(_nodes(pairs), "mark", "left_semi")
    n = lambda side: counted.select(F.col("mark").alias(side), F.col("n").alias(f"n{side}"))
    sized = cut(pairs.select("a", "b").join(n("a"), "a").join(n("b"), "b"))
    large = sized.filter(F.least("na", "nb") > LARGE)
    quarters = rows.filter(F.col("n") > LARGE).join(_nodes(large), "mark", "left_semi").select("mark", F.filter("s", lambda g: g.bitwiseAND(3) == 0).alias("s"))
    differ = F.size("sa") + F.size("sb") - 2 * F.size(F.array_intersect("sa", "sb"))
    left = _together(large, quarters).filter(differ <= (1 - similarity) / (1 + similarity) * (F.col("na") + F.col("nb")) + 1e-9).select("a", "b")
    left = cut(left.unionByName(sized.filter(F.least("na", "nb") <= LARGE).select("a", "b")))
    sets = rows.select("mark", "s").join(_nodes(left), "mark", "left_semi")
    return _together(left, sets).filter(jaccard(F.col("sa"), F.col("sb")) >= similarity - 1e-12).select("a", "b")


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b, ra, rb: the ``pairs`` (a, b) whose roots differ."""
    known = bounded(roots)
    of = lambda c: known.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    both = pairs.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")).filter("ra <> rb")


def _with_links(roots: DataFrame, links: DataFrame) -> DataFrame:
    """node, root once the ``links`` (a, b, ra, rb) join roots as well; only roots are linked anew."""
    moved = components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    to = bounded(moved).select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return cut(roots.join(to, "root", "left").select("node", F.coalesce("_to", "root").alias("root")).unionByName(moved))


def joined(pairs: DataFrame, roots: DataFrame, alike: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``roots`` (node, root) once all links among the candidate ``pairs`` (a, b) join them; ``alike`` leaves the links of a table of pairs.

    Members of a large group that no hub joined are candidates of most of the group, and
    alike to many.  So a few pairs of every root are checked first, and then only pairs
    whose roots these links have not joined; each pair is checked or within one group.
    """
    for few in (FIRST, None):
        pairs = cut(_between(pairs, roots))
        total, chosen = pairs.count(), pairs
        if few and total > AT_ONCE:
            # one pair of each part of a root's pairs, as an aggregation: a root with very many is no one task's
            sides = pairs.select("*", F.explode(F.array("ra", "rb")).alias("r"), F.pmod(F.xxhash64("a", "b"), F.lit(few)).alias("part"))
            chosen = cut(sides.groupBy("r", "part").agg(F.min(F.struct(*pairs.columns)).alias("x")).select("x.*").distinct())
        if total:
            roots = _with_links(roots, chosen.join(alike(chosen.select("a", "b")), ["a", "b"], "left_semi"))
        if chosen is pairs:
            return roots
        pairs = pairs.join(bounded(chosen), ["a", "b"], "left_anti")
    return roots


def classes(rows: DataFrame, similarity: float = 0.8) -> DataFrame:
    """mark, class_id and group_id of every fingerprint of ``rows`` (:func:`signed`, materialised).

    First each fingerprint meets the best connected one of each signature of its
    prefix, then a few drawn ones (:func:`draws`); then candidate pairs that these links don't join are compared until none
    is left between two groups (:func:`joined`), so no link that joins groups is
    lost, and a large group of near copies is never all its pairs.
    """
    with lean(rows.sparkSession):  # many small rounds, whose shuffles would stay
        each = one_each(rows)
        shared = cut(prefixes(each, similarity))
        sizes = cut(each.select("mark", "n", "bits").join(shared.select("mark").distinct(), "mark", "left_semi"))
        first = cut(stars(shared, sizes, similarity))
        linked = cut(alike(first, each, similarity))
        met = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        near = lambda pairs: alike(pairs, each, similarity)
        known = components(linked)
        drawn = cut(draws(shared, sizes, known, similarity))
        known = joined(drawn, known, near)
        rest = cut(candidates(shared, sizes, known, similarity).join(met.unionByName(drawn), ["a", "b"], "left_anti"))
        roots = joined(rest, known, near)
        named = rows.groupBy("mark").agg(F.min("doc_id").alias("class_id")).join(roots, F.col("mark") == F.col("node"), "left").select("mark", "class_id", F.coalesce("root", "mark").alias("root"))
        least = named.groupBy("root").agg(F.min("class_id").alias("group_id"))
        return named.join(least, "root").select("mark", "class_id", "group_id")


def near_classes(docs: DataFrame, text: str = "text", similarity: float = 0.8) -> DataFrame:
    """doc_id, class_id and group_id of every row.

    Class: equal fingerprints, named by the least doc_id.  Group: classes that links
    (Jaccard ``similarity`` or more) join, directly or not, named alike.  Texts
    without a signature are one class and have no links; where no row has a doc_id,
    the names are null.
    """
    rows = cut(signed(docs, text))
    return rows.select("doc_id", "mark").join(classes(rows, similarity), "mark").select("doc_id", "class_id", "group_id")


def edited(docs: DataFrame, text: str = "text", rows_per_task: int = 4_000, similarity: float = 0.8) -> DataFrame:
    """Fingerprints of every text and of the text whose last quarter the next text's beginning replaces.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, and class_id and group_id of :func:`near_classes`.  The next text is the one with the next doc_id
    (null ids first, ties in the order of the text's hash; the first after the last).

    Texts are shuffled once, into ranges of (doc_id, hash), and signed there.  Each
    range's first row is also sent to the range before it, so that every row finds
    the next one in its own window.  A row with the class and group of each
    (doc_id, hash) travels with them and comes right before its texts.
    """
    rows = cut(signed(docs, text))
    ids = cut(rows.select("_id", "_h", "mark").join(classes(rows, similarity), "mark").select("_id", "_h", F.struct("class_id", "group_id").alias("_label")))
    del rows
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    part = ranges(ids, rows_per_task)
    heads = ids.select("_id", "_h", part.alias("_part")).groupBy("_part").agg(F.min(F.struct("_id", "_h")).alias("_x"))
    # one row a range, two for each MAX_RANGES at most: small enough for one window and a broadcast
    everywhere = Window.partitionBy(F.lit(0))
    heads = heads.select("_x.*", F.coalesce(F.lag("_part").over(everywhere.orderBy("_part")), F.max("_part").over(everywhere)).alias("_to"))
    df = df.withColumn("_part", part).join(F.broadcast(heads), ["_id", "_h"], "left")
    own = F.struct(F.col("_part").alias("part"), F.lit(False).alias("copy"))
    sent = F.struct(F.col("_to").alias("part"), F.lit(True).alias("copy"))
    df = df.withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, sent))))
    labels = ids.distinct().select(part.alias("part"), "_id", "_h", F.lit(False).alias("copy"), "_label")
    df = df.select("doc_id", "_id", "_h", "_text", "_at.part", "_at.copy").unionByName(labels, allowMissingColumns=True).repartition("part")
    df = with_signatures(df, "_text", "_sig").withColumn("_own", F.when(F.col("_text").isNotNull(), F.struct("_text", "_sig")))
    df = df.withColumn("_kind", F.col("_text").isNotNull())
    w = Window.partitionBy("part").orderBy("copy", "_id", "_h", "_kind")
    following = F.expr("lead(_own) IGNORE NULLS OVER (PARTITION BY part ORDER BY copy, _id, _h, _kind)")
    df = df.withColumn("_next", following).withColumn("_label", F.last("_label", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(~F.col("copy") & F.col("_kind"))
    n, tail = F.length("_text"), F.floor(F.length("_text") / 4).cast("int")
    df = df.select(
        "doc_id", "_label", n.cast("long").alias("n_chars"), "_sig", F.col("_next._sig").alias("_next_sig"),
        F.concat(F.substring(F.col("_text"), F.lit(1), n - tail), F.substring(F.col("_next._text"), F.lit(1), tail)).alias("_edited"),
    )
    df = with_signatures(df, "_edited", "_edited_sig")
    return df.select(
        "doc_id", "n_chars", F.sha2(F.encode("_edited", "utf-8"), 256).alias("edited_sha256"),
        as_string(F.col("_sig")).alias("fingerprint"), as_string(F.col("_edited_sig")).alias("edited_fingerprint"),
        jaccard(F.col("_sig"), F.col("_edited_sig")).alias("near_edited"), jaccard(F.col("_sig"), F.col("_next_sig")).alias("near_next"),
        "_label.class_id", "_label.group_id",
    )


MAX_RANGES = 1 << 16


def ranges(ids: DataFrame, rows_per_task: int) -> Column:
    """A number for each (_id, _h) in their order, with about ``rows_per_task`` rows to a number.

    At most 256 quantiles of the ids, found approximately, and equal steps between
    two of them; an id that fills several quantiles is cut by equal steps of _h.
    """
    n = ids.count()
    parts = max(1, min(MAX_RANGES, -(-n // rows_per_task)))
    coarse = min(parts, 256)
    if coarse == 1:
        return F.lit(0)
    found = ids.agg(F.percentile_approx("_id", [k / coarse for k in range(coarse + 1)], 20_000)).first()[0] or []
    bounds = sorted(set(found))
    at, fine = F.col("_id"), max(1, -(-parts // coarse))
    place = _search(at, bounds, 0, len(bounds))  # 0: up to the first bound; len: over the last
    listed = F.array(*[F.lit(b) for b in bounds])
    low, high = F.get(listed, place - 1), F.get(listed, place)
    inner = F.when((place > 0) & (place < len(bounds)) & (low > -(1 << 63)), F.floor((at - low).cast("double") / (high - low).cast("double") * (fine - 1e-6)))
    steps = F.get(F.array(*[F.lit(fine * found.count(b) if found.count(b) > 1 else 0) for b in bounds]), place)
    hashed = F.floor((F.col("_h").cast("double") / 2.0**64 + 0.5) * (steps - 1e-6))
    inside = F.when((at == high) & (steps > 0), fine + hashed).otherwise(F.coalesce(inner, F.lit(0)))
    return (place.cast("long") * (fine * (coarse + 3)) + inside).cast("long")
