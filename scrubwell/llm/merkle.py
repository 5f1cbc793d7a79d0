"""A Merkle manifest of a table: a tree for each group, a tree over the groups' roots, and a proof for every row.

Bottom-up build: the nodes of a tree are cut into blocks of ``FANOUT ** DEPTH``
consecutive ones.  A block makes its own ``DEPTH`` levels, and its top is a node of
the next round; each round's blocks are written to the shared folder.  A trillion
rows take five rounds.  Top-down push: each round's blocks join the blocks above them,
take over the rest of the proof, and every child prepends its own siblings to it.
Only tops and proofs' upper ends are joined; the rows' texts are read once, for the
leaves.

Defined results: a null value is ``-`` in its leaf, an empty one ``0:``; rows of one
group are in the order of doc_id (nulls first), those of one doc_id in the order of
their leaves; repeated rows are leaves of their own; a group of one row has its leaf
as its root; an empty table gives an empty result; columns that are not named in
``columns`` don't count, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubwell.llm.common import ordinals, scratch_path

FANOUT = 3
#: Levels of a tree that a block of 729 nodes holds.
DEPTH = 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(what: Column) -> Column:
    return F.sha2(what.cast("binary"), 256)


def part(value: Column) -> Column:
    """A value as a leaf takes it: its UTF-8 byte count, a colon and itself; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: tuple[str, ...] = COLUMNS, **replaced: Column) -> Column:
    return digest(F.concat(*[part(replaced.get(c, F.col(c))) for c in columns]))


def _kept(df: DataFrame, what: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"merkle-{what}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _level(k: int) -> str:
    return f"_l{k}"


def _folded(level: Column) -> Column:
    """The level above: a digest of every run of ``FANOUT`` nodes."""
    last = (F.ceil(F.size(level) / FANOUT) - 1).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: digest(F.array_join(F.slice(level, i * FANOUT + 1, FANOUT), "")))


def _blocks(nodes: DataFrame) -> DataFrame:
    """_g, block, n, members (in order, with their carry) and the levels of every block of ``nodes`` (_g, _i, node, n, carry)."""
    width = FANOUT**DEPTH
    found = nodes.groupBy("_g", F.expr(f"_i div {width}").alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("_i", "node", "carry"))).alias("members"))
    # how many levels lead to one node, or to the block's top where other blocks lie beside it
    found = found.withColumn("depth", sum((F.when(F.col("n") > FANOUT**k, 1).otherwise(0) for k in range(1, DEPTH)), F.when(F.col("n") > 1, 1).otherwise(0)))
    found = found.withColumn(_level(0), F.transform("members", lambda m: m["node"]))
    for k in range(DEPTH):
        found = found.withColumn(_level(k + 1), F.when(F.col("depth") > k, _folded(F.col(_level(k)))))
    return found.withColumn("top", F.coalesce(*[F.get(_level(k), F.lit(0)) for k in range(DEPTH, -1, -1)]))


def build(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The rounds' tables of blocks, lowest first, and _g and root of every tree; ``nodes``: _g, _i from 0, node, n (nodes of the tree), carry."""
    rounds, width = [], FANOUT**DEPTH
    while True:
        rounds.append(_kept(_blocks(nodes), f"round{len(rounds)}"))
        above = rounds[-1].filter(F.col("n") > width)
        if above.isEmpty():
            break
        nodes = above.select("_g", F.col("block").alias("_i"), F.col("top").alias("node"), F.ceil(F.col("n") / width).cast("long").alias("n"), F.lit(None).cast("int").alias("carry"))
    ends = [t.filter(F.col("n") <= width).select("_g", F.col("top").alias("root")) for t in rounds]
    roots = ends[0]
    for t in ends[1:]:
        roots = roots.unionByName(t)
    return rounds, roots


def _own(at: Column) -> Column:
    """What stands left and right of the node at place ``at`` of a block, in its run of each level."""
    steps = []
    for k in range(DEPTH):
        q = F.floor(at / FANOUT**k).cast("int")
        place = F.pmod(q, F.lit(FANOUT))
        left, right = F.slice(F.col(_level(k)), q - place + 1, place), F.slice(F.col(_level(k)), q + 2, FANOUT - 1 - place)
        steps.append(F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right")))
    return F.slice(F.array(*steps), F.lit(1), F.col("depth"))


def push(rounds: list[DataFrame], ends: DataFrame) -> DataFrame:
    """_g, node, carry, steps and root of every lowest node; ``ends``: _g, root and the proof from there on (``steps``)."""
    width, found = FANOUT**DEPTH, None
    for r in range(len(rounds) - 1, -1, -1):
        blocks = rounds[r]
        with_rest = blocks.filter(F.col("n") <= width).join(ends, "_g")
        if found is not None:
            with_rest = with_rest.unionByName(blocks.filter(F.col("n") > width).join(found.select("_g", F.col("_i").alias("block"), "root", "steps"), ["_g", "block"]))
        member = F.transform("members", lambda m, at: F.struct(m["_i"].alias("_i"), m["node"].alias("node"), m["carry"].alias("carry"), F.concat(_own(at), F.col("steps")).alias("steps")))
        found = with_rest.select("_g", "root", F.explode(member).alias("m")).select("_g", "root", "m.*")
        if r:
            found = _kept(found.drop("node", "carry"), f"proofs{r}")
    return found.drop("_i")


def fold(start: Column, steps: Column) -> Column:
    """The root to which the siblings lead from a leaf."""
    return F.aggregate(steps, start, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def manifest(docs: DataFrame, group: str = "source", key: str = "doc_id", columns: tuple[str, ...] = COLUMNS, **tampered: Column) -> DataFrame:
    """doc_id, leaf, changed, subroot, root and steps of every row.

    ``steps``: of every level from the leaf to the root the digests left and right of
    the path, joined; :func:`fold` leads from the leaf to the root by them.
    ``changed``: the leaf with the columns named in ``tampered`` replaced, the leaf if there are none.
    Groups are ordered by their UTF-8 bytes, null first.
    """
    # a null group sorts before '=' and is never null as a key
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    leaves = docs.select(g.alias("_g"), F.col(key).alias("key"), leaf(columns).alias("node"), leaf(columns, **tampered).alias("changed"))
    ranked = ordinals(leaves, "_g", ["key", "node"], "_i", "n")
    rounds, roots = build(ranked.select("_g", "_i", "node", "n", F.struct("key", "changed").alias("carry")))
    tops = roots.select(F.lit("").alias("_g"), F.col("_g").alias("group"), "root")
    tops = ordinals(tops, "_g", ["group"], "_i", "n")
    above, root = build(tops.select("_g", "_i", F.col("root").alias("node"), "n", F.col("group").alias("carry")))
    none = F.array().cast("array<struct<left: string, right: string>>")
    ends = push(above, root.withColumn("steps", none)).select(F.col("carry").alias("_g"), F.struct(F.col("node").alias("subroot"), F.col("root").alias("root")).alias("root"), "steps")
    return push(rounds, _kept(ends, "ends")).select(F.col("carry.key").alias(key), F.col("node").alias("leaf"), "carry.changed", "root.subroot", "root.root", "steps")


def checked(docs: DataFrame) -> DataFrame:
    """The digests of the manifest of ``documents`` and what tampering with every second one does to them."""
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = manifest(docs, text=F.when(odd, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    found = found.withColumn("folded_root", fold(F.col("changed"), F.col("steps")))
    return found.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
