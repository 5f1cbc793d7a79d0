"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly, tile against tile, with numpy exclusive-or
and bit counts.  A tile holds the fingerprints whose words (the fingerprint cut
into ``blocks`` equal parts) have the same population counts.  As
``sum |popcount(a_k) - popcount(b_k)| <= hamming(a, b)``, a pair of tiles whose
counts differ by more than the radius in sum is skipped without loss.

Scale: only distinct fingerprints are compared; ``blocks`` grows with their
number, so that tiles stay small; a tile with more than ``TILE_ROWS`` is cut
into chunks that meet pairwise in separate tasks; each task reports a spanning
forest of its links, never all pairs.

Defined results: null or empty text has fingerprint zero, which links like any
other; repeated rows share a fingerprint; ties go to the smallest doc_id, null
last; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubwell.llm.common import cut

SEED, SHINGLE, CHUNK = 42, 3, 1 << 15
TILE_ROWS = 20_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint: a bit is set if it is set in over half of the shingles' XXH64."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + shingle - 1]
        runs = zip(*(part[k:] for k in range(shingle)), strict=False)
        h = np.fromiter((digest(b" ".join(r), SEED) for r in runs), dtype=np.uint64)
        bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, mark (a hash of the text) and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column("_text")), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(fp.view(np.int64))], ["doc_id", "mark", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark(text).alias("mark"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, mark long, fp long")


def _mark(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def offsets(blocks: int, radius: int) -> list[int]:
    """Differences of tile keys (base 128 digits) that lie within the radius, one of each opposite pair, zero left out."""
    out = []
    for d in itertools.product(range(-radius, radius + 1), repeat=blocks) if blocks <= 4 else _sparse(blocks, radius):
        first = next((x for x in d if x), 0)
        if first > 0 and sum(map(abs, d)) <= radius:
            out.append(sum(x * 128**k for k, x in enumerate(d)))
    return out


def _sparse(blocks: int, radius: int) -> Iterator[tuple[int, ...]]:
    """Integer vectors with sum of absolutes at most ``radius``."""
    if not blocks:
        yield ()
        return
    for x in range(-radius, radius + 1):
        for rest in _sparse(blocks - 1, radius - abs(x)):
            yield (x, *rest)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the same components as the links (a, b): each node but a root with its root."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
        if (root == before).all():
            break
    kept = root != np.arange(len(nodes))
    return nodes[kept], nodes[root[kept]]


def compare(home: np.ndarray, guest: np.ndarray, radius: int, side: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``home`` and between ``guest`` and ``home``, in blocks of side x side; reduced to a forest as they come."""
    ea, eb = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    size = 0
    for i in range(0, len(home), side):
        h = home[i : i + side]
        for rest, same in ((guest, False), (home[i:], True)):
            for j in range(0, len(rest), side):
                r = rest[j : j + side]
                near = np.bitwise_count(h[:, None] ^ r[None, :]) <= radius
                if same and j == 0:
                    near = np.triu(near, 1)
                p, q = np.nonzero(near)
                if len(p):
                    ea.append(h[p])
                    eb.append(r[q])
                    size += len(p)
                    if size > 1_000_000:
                        a, b = forest(np.concatenate(ea), np.concatenate(eb))
                        ea, eb, size = [a], [b], len(a)
    a, b = np.concatenate(ea), np.concatenate(eb)
    return forest(a, b) if len(a) else (a, b)


def links(distinct: DataFrame, radius: int, blocks: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Columns a, b (signed fingerprints): links that join all fingerprints within the radius.  ``distinct``: column fp, materialised."""
    width = 64 // blocks
    mask = (1 << width) - 1
    key = sum((F.bit_count(F.shiftrightunsigned(F.col("fp"), k * width).bitwiseAND(F.lit(mask if width < 64 else -1))).cast("long") * (128**k) for k in range(blocks)), F.lit(0).cast("long"))
    if blocks > 8:
        raise ValueError("at most 8 blocks fit a tile key")
    df = distinct.select("fp", key.alias("tile"))
    # Tiles too large for one task are cut into chunks.  Guests go to tiles that exist; up to four blocks
    # there are at most 17^4 of those, which bounds the broadcast.
    tiles = df.groupBy("tile").count().select("tile", F.ceil(F.col("count") / tile_rows).cast("int").alias("chunks"))
    tiles = F.broadcast(tiles) if blocks <= 4 else tiles
    home = df.join(tiles, "tile").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    near = df.select("fp", F.explode(F.array(*[F.lit(o).cast("long") for o in offsets(blocks, radius)])).alias("o"), "tile").select("fp", (F.col("tile") + F.col("o")).alias("tile"))
    near = near.join(tiles, "tile").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    within = home.filter("chunk > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunk") - 1)))
    dealt = home.select("tile", "chunk", "fp", F.lit(True).alias("home")).unionByName(near.unionByName(within, allowMissingColumns=True).select("tile", "chunk", "fp", F.lit(False).alias("home")))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, home_row = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["home"].to_numpy(bool)
        a, b = compare(fp[home_row], fp[~home_row], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("tile", "chunk").applyInPandas(meet, "a long, b long")


#: Cells of the table of how many shingles fall where, and bits of a text's parity map.
COUNTED, PARITY = 1 << 18, 512
#: Members of a shingle that one task compares with one another, and entries that one group of small shingles holds.
MEET_ROWS, GROUP_ROWS = 4_096, 5_000
#: Up to so many members of a shingle are paired by a join.
FEW = 8
#: Up to so many hashes of texts (8 bytes each) are broadcast; beyond that, the texts are shuffled to them.
BROADCAST_ROWS = 500_000


def hashes(text: str, shingle: int) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles of ``text``, sorted; of the whole sequence if it has fewer words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    if len(h) < shingle:
        h, shingle = np.concatenate([np.zeros(shingle - len(h), np.uint64), h]), shingle
    runs = np.zeros(len(h) - shingle + 1, np.uint64)
    for k in range(shingle):  # a polynomial in the words' hashes, then a final mix
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(runs)]
    runs = (runs ^ (runs >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(runs ^ (runs >> np.uint64(32)))


def shingle_levels(texts: DataFrame, shingle: int) -> np.ndarray:
    """For each of COUNTED cells, into which shingles fall by hash: the bit length of the number of shingles in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTED, np.int64)
        for b in batches:
            for t in b.column("_text"):
                n[(hashes(t.as_py(), shingle) % np.uint64(COUNTED)).astype(np.int64)] += 1
        cell = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(n[cell])], ["cell", "n"])

    found = texts.select("_text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # COUNTED rows at most
    out = np.zeros(COUNTED, np.uint8)
    out[found.column("cell").to_numpy()] = np.ceil(np.log2(found.column("n").to_numpy() + 1.0)).astype(np.uint8)
    return out


def texts_once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    """Marks and texts of the batches of a task, each mark once (8 bytes for each row of a task are kept)."""
    seen: set[int] = set()
    for b in batches:
        new = [k for k, m in enumerate(b.column("mark").to_pylist()) if not (m in seen or seen.add(m))]
        yield [b.column("mark")[k].as_py() for k in new], [b.column("_text")[k].as_py() for k in new]


def sizes_of(texts: DataFrame, shingle: int) -> DataFrame:
    """mark, n, bits of every text (mark, _text): size and parity map of its shingle set.

    A bit of the map is the parity of the shingles that fall on it, so two maps
    differ in at most as many bits as the sets differ in shingles.  A map has PARITY
    bits, doubled until it has half as many as the set has shingles; a longer map
    folds onto a shorter one by exclusive-or of its halves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for marks, texts in texts_once(batches):
            size, bits = [], []
            for t in texts:
                h = hashes(t, shingle)
                width = PARITY
                while 2 * width < len(h) and width < 1 << 22:
                    width *= 2
                at = (h >> np.uint64(40)).astype(np.int64) % width
                size.append(len(h))
                bits.append(np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(size, pa.int32()), pa.array(bits, pa.list_(pa.int64()))], ["mark", "n", "bits"])

    return texts.select("mark", "_text").mapInArrow(run, "mark long, n int, bits array<bigint>")


def prefixes(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """g, mark: the first shingles of every distinct text (mark, _text).

    In any one order of all shingles, sets of Jaccard ``similarity`` share one of
    their first n - ceil(similarity * n) + 1.  The order here puts shingles of full
    cells last.  A task reports equal texts once; of several tasks each may report one.
    """
    levels = shingle_levels(texts, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for marks, texts in texts_once(batches):
            first = []
            for t in texts:
                h = hashes(t, shingle)
                order = np.argsort(levels[(h % np.uint64(COUNTED)).astype(np.int64)], kind="stable")
                first.append(h[order[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]].view(np.int64))
            owner = np.repeat(np.array(marks, np.int64), [len(x) for x in first])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *first])), pa.array(owner)], ["g", "mark"])

    return texts.select("mark", "_text").mapInArrow(run, "g long, mark long")


def shared_entries(entries: DataFrame) -> DataFrame:
    """g, mark: the entries whose shingle more than one text has, each once.  The entries are shuffled once, by shingle."""
    entries = entries.repartition("g")
    shared = entries.groupBy("g").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).filter("lo <> hi").select("g")
    return entries.join(shared, "g", "left_semi").distinct()


def bounded(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table`` (materialised), for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(table) if table.count() <= rows else table


def possible(pairs: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sizes and parity maps allow the similarity."""
    of = lambda c: sizes.select(F.col("mark").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").filter(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9)
    xor = lambda x, y: x.bitwiseXOR(y)
    m = F.least(F.size("bitsa"), F.size("bitsb"))  # sizes within the similarity differ by less than two, and so do the maps' widths at most
    folded = lambda c: F.when(F.size(c) > m, F.zip_with(F.slice(c, F.lit(1), m), F.slice(c, m + 1, m), xor)).otherwise(F.col(c))
    differ = F.aggregate(F.zip_with(folded("bitsa"), folded("bitsb"), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda n, x: n + x)
    return both.filter(differ <= (1 - similarity) / (1 + similarity) * (F.col("na") + F.col("nb")) + 1e-9).select("a", "b")


def stars(shared: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """a, b: each text with the best connected text of each of its shingles, where both may be alike."""
    scores = bounded(cut(shared.groupBy("mark").agg(F.count(F.lit(1)).alias("score"))))
    hubs = shared.join(scores, "mark").groupBy("g").agg(F.max(F.struct("score", "mark")).alias("x")).select("g", F.col("x.mark").alias("b"))
    pairs = shared.join(hubs, "g").filter("mark <> b").select(F.col("mark").alias("a"), "b").distinct()
    return possible(pairs, sizes, similarity)


def candidates(shared: DataFrame, sizes: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """a, b (a < b): all pairs of texts that share a shingle and not a root, and whose sizes and parity maps allow the similarity.

    ``roots``: node and root of texts that are linked already; a shingle whose
    members have one root is left out.  The FEW members of a small shingle are
    paired by a join.  The members of a large one are cut into chunks, and each pair
    of chunks meets in a group of its own, block against block in the order of size:
    blocks whose sizes differ too much are skipped, others are compared by
    exclusive-or and bit counts.
    """
    part = (1 - similarity) / (1 + similarity)
    known = bounded(cut(roots))
    rooted = shared.join(known, shared["mark"] == known["node"], "left").select("g", "mark", F.coalesce("root", "mark").alias("root"))
    mixed = rooted.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("g", "c")
    rooted = cut(rooted.join(mixed, "g"))
    few = rooted.filter(F.col("c") <= FEW)
    pairs = few.select("g", F.col("mark").alias("a"), F.col("root").alias("ra")).join(few.select("g", F.col("mark").alias("b"), F.col("root").alias("rb")), "g").filter("a < b and ra <> rb").select("a", "b")

    df = rooted.filter(F.col("c") > FEW).withColumn("chunks", F.ceil(F.col("c") / MEET_ROWS).cast("int"))
    groups = max(1, -(-df.count() // GROUP_ROWS))
    df = df.withColumn("me", F.pmod(F.xxhash64("mark"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    key = F.when(F.col("chunks") > 1, F.col("g")).otherwise(F.pmod(F.xxhash64("g"), F.lit(groups)))
    df = df.select("mark", "root", "g", "me", key.alias("key"), F.least("me", "other").alias("i"), F.greatest("me", "other").alias("j"))
    met = df.join(sizes, "mark")

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["g", "n"], kind="stable")
        g, mark, n, me, root = (pdf[c].to_numpy() for c in ("g", "mark", "n", "me", "root"))
        bits = np.stack([np.bitwise_xor.reduce(x.reshape(-1, PARITY // 64), axis=0) for x in pdf["bits"]]).view(np.uint64)
        edges = np.flatnonzero(np.diff(g)) + 1
        fa, fb = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(g)], strict=True):
            here = np.arange(start, end)
            if len(here) < 2 or (root[here] == root[start]).all():
                continue
            left, right = (here, here) if key[1] == key[2] else (here[me[here] == key[1]], here[me[here] == key[2]])
            for k in range(0, len(left), 512):
                x = left[k : k + 512]
                low, high = np.searchsorted(n[right], [similarity * n[x[0]] - 1e-9, n[x[-1]] / similarity + 1e-9])
                y = right[low:high]
                p, q = np.nonzero((root[x][:, None] != root[y]) & (np.minimum(n[x][:, None], n[y]) >= similarity * np.maximum(n[x][:, None], n[y]) - 1e-9))
                p, q = x[p], y[q]
                if key[1] == key[2]:
                    p, q = p[p < q], q[p < q]
                near = np.concatenate([np.bitwise_count(bits[p[c : c + 65_536]] ^ bits[q[c : c + 65_536]]).sum(axis=1, dtype=np.int32) for c in range(0, len(p), 65_536)] or [np.zeros(0, np.int32)])
                fine = near <= part * (n[p] + n[q]) + 1e-9
                fa.append(mark[p[fine]])
                fb.append(mark[q[fine]])
        a, b = np.concatenate(fa), np.concatenate(fb)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return possible(pairs.unionByName(met.groupBy("key", "i", "j").applyInPandas(meet, "a long, b long")).distinct(), sizes, similarity)


def alike(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``pairs`` (materialised) whose texts (mark, _text) have shingle sets of at least that Jaccard similarity.

    A pair first gets the set of its ``b``, which may be the hub of many pairs, and
    is then sent to its ``a``, so the sets travel to evenly spread keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for marks, texts in texts_once(batches):
            sets = pa.array([hashes(t, shingle).view(np.int64) for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), sets], ["mark", "s"])

    nodes = bounded(cut(pairs.select(F.explode(F.array("a", "b")).alias("mark")).distinct()))
    sets = texts.join(nodes, "mark", "left_semi").select("mark", "_text").mapInArrow(run, "mark long, s array<bigint>").dropDuplicates(["mark"])
    both = pairs.join(sets.select(F.col("mark").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("mark").alias("a"), F.col("s").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, root: each node of the links (a, b) with the least node it can reach.

    Alternates large-star and small-star rounds; both keep edges at most as many
    as before, so a hub or a long chain needs O(log n) rounds.  Each round is cut.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        before = e
        # large-star: all larger neighbours of u link to the least neighbour of u
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small-star: u and its smaller neighbours link to the least of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select("x.u", F.col("x.m").alias("v")).filter("u <> v").distinct()
        e = cut(e)
        if e.exceptAll(before).isEmpty() and before.exceptAll(e).isEmpty():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def resolution(n: int) -> int:
    """Number of blocks for ``n`` fingerprints: four, whose fullest tile holds about 0.15 % of them, or eight for very many."""
    return 4 if n <= 50_000_000 else 8


def _clustered(docs: DataFrame, text: str = "text", radius: int = 2, shingle: int = SHINGLE, blocks: int | None = None) -> DataFrame:
    """doc_id, mark, fp, root (one fingerprint of the component) and component_id of every row."""
    fps = cut(fingerprints(docs, text, shingle))
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(reps.select("fp"), radius, blocks or resolution(reps.count())))
    joined = reps.join(roots, reps["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    ids = joined.join(least, "root").select("fp", "root", "component_id")
    return fps.join(ids, "fp").select("doc_id", "mark", "fp", "root", "component_id")


def cluster(docs: DataFrame, **how) -> DataFrame:
    """doc_id, fp and component_id (least doc_id reachable over fingerprints at most ``radius`` bits apart) of every row.

    ``how``: text, radius, shingle and blocks.  Null ids count only where a component has no other.
    """
    return _clustered(docs, **how).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stand for their component: its least doc_id, and of different texts with that id one.

    Rows equal in doc_id and text are one document and all stay.
    """
    own = _clustered(docs, text, **how).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = own.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("x")).select(F.col("x.doc_id").alias("_kept"), F.col("x.mark").alias("_mark"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]) & (_mark(text) == kept["_mark"]), "left_semi")


def near_groups(docs: DataFrame, text: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """doc_id, mark (hash of the text) and root of every row: rows of one root are linked by texts alike in ``similarity`` or more.

    Exact but for clashes of 64-bit hashes: texts are grouped by their hash; all
    pairs that can be alike share a shingle of their :func:`prefixes`.  First each
    text meets the best connected text of each shingle; then every candidate pair
    that these links don't join is checked on the sets, so no link is lost to one
    that stood for it.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark(text).alias("mark"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    ids = cut(own.select("doc_id", "mark"))
    shared = cut(shared_entries(prefixes(own, shingle, similarity)))
    sizes = cut(sizes_of(own, shingle).dropDuplicates(["mark"]))
    first = cut(stars(shared, sizes, similarity))
    linked = cut(alike(first, own, shingle, similarity))
    met = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = cut(candidates(shared, sizes, components(linked), similarity).join(met, ["a", "b"], "left_anti"))
    roots = components(linked.unionByName(alike(rest, own, shingle, similarity)))
    return ids.join(roots, ids["mark"] == roots["node"], "left").select("doc_id", "mark", F.coalesce("root", "mark").alias("root"))


def one_of_near(docs: DataFrame, text: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` that stand for their group of :func:`near_groups`: its least doc_id, and of different texts with that id one.

    Null texts are empty, and all empty texts are alike; a null doc_id stays only
    where a group has no other; rows equal in doc_id and text are one document and
    all stay; of rows with one doc_id and different texts each text is judged by
    itself; other columns, whatever their names, are carried along; an empty table
    gives an empty result.
    """
    ids = near_groups(docs, text, similarity, shingle)
    # null ids only where a group has no other
    kept = ids.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("x")).select(F.col("x.doc_id").alias("_kept"), F.col("x.mark").alias("_mark"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]) & (_mark(text) == kept["_mark"]), "left_semi")
