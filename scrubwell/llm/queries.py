"""The registered queries of the training-data operators, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubwell.llm import html_blocks, kd_shards, line_dedup, merkle, mixing, packing, rule_ensemble, simhash, spotsigs, time_parts, url_lm, warc, weak_rules
from scrubwell.llm.common import scratch_path, table

URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

#: Target weights of the mix by source, and that of every other source.
TARGETS, OTHER_TARGET = {"src0": 5.0, "src1": 3.0, "src2": 2.0, "src3": 0.3}, 1.0


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = kd_shards.kd_shards(table(spark, sf_dir, "documents"), shards=40)
    return df.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op3_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rule_ensemble.score(docs, rule_ensemble.train(docs, table(spark, sf_dir, "labels")))


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited(table(spark, sf_dir, "documents"))


def op5_url_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_lm.judge(pages, URL_RULES, url_lm.train(pages, URL_RULES))


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = simhash.cluster(table(spark, sf_dir, "documents"), radius=2)
    return df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"), TARGETS, default=OTHER_TARGET).withColumnRenamed("mix_source", "source")


def op9_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judge(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    back = warc.read(spark, path, verify="true").filter(F.col("record_type").isin("response", "revisit"))
    return back.select(
        F.expr("try_cast(substring_index(record_id, ':', -1) as bigint)").alias("page_id"),
        F.when(F.col("payload").isNotNull(), F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        "record_type",
        F.expr("try_cast(substring_index(refers_to, ':', -1) as bigint)").alias("refers_to"),
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return df.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op13_time_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_parts.relaid(table(spark, sf_dir, "clicks"), scratch_path(spark, "clicks"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_kd_shards, op2_html_blocks, op3_rule_ensemble, op4_spotsigs, op5_url_lm, op6_best_fit, op7_simhash, op8_pfair_mix, op9_weak_rules, op10_warc,
        op11_merkle, op12_line_dedup, op13_time_parts,
    )
}

def _tree_sql(name: str, base: str, levels: int) -> str:
    """CTEs over ``base`` (g, i from 0, node, f, proof): <name>_roots (g, root), and <name>_done with f folded and proof filled up to the root."""
    out = [f"{name}_l0 AS (SELECT g, i, node, count(*) OVER (PARTITION BY g) AS n FROM {base})"]
    for k in range(levels):
        run = f"OVER (PARTITION BY g, i // 3 ORDER BY i ROWS BETWEEN"
        out.append(f"{name}_l{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM (SELECT g, i // 3 AS i, sha256(string_agg(node, '' ORDER BY i)) AS node FROM {name}_l{k} WHERE n > 1 GROUP BY g, i // 3))")
        out.append(f"{name}_s{k} AS (SELECT g, i, coalesce(string_agg(node, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(node, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}_l{k} WHERE n > 1)")
        below = f"{name}_p{k - 1}" if k else base
        out.append(f"{name}_p{k} AS (SELECT p.* REPLACE (CASE WHEN s.g IS NULL THEN p.f ELSE sha256(l || p.f || r) END AS f, p.proof || coalesce(l || r, '') AS proof) FROM {below} p LEFT JOIN {name}_s{k} s ON s.g = p.g AND s.i = p.i // {3**k})")
    out.append(f"{name}_roots AS ({' UNION ALL '.join(f'SELECT g, node AS root FROM {name}_l{k} WHERE n = 1' for k in range(levels + 1))})")
    return ", ".join([*out, f"{name}_done AS (SELECT * FROM {name}_p{levels - 1})"])


_LEAF = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
#: CRC-32 of the decimal doc_id without the last inversion, bit by bit.
_CRC = "list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END)))"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    # a source has at most 3^13 documents, and there are at most 3^8 sources
    "op11_merkle": f"""
        WITH d AS (SELECT doc_id, coalesce('=' || source, '-') AS g, sha256({_LEAF.format(text="text")}) AS node, CASE WHEN {_CRC} % 2 = 1 THEN sha256({_LEAF.format(text="replace(text, chr(10), '')")}) END AS changed FROM documents),
        b AS (SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, node) - 1 AS i, node, coalesce(changed, node) AS f, '' AS proof FROM d), {_tree_sql("t", "b", 13)},
        sb AS (SELECT 0 AS g, g AS source, row_number() OVER (ORDER BY g) - 1 AS i, root AS node, '' AS f, '' AS proof FROM t_roots), {_tree_sql("u", "sb", 8)},
        whole AS (SELECT 0 AS g, doc_id, t_done.node AS leaf, sb.node AS subroot, sb.i, t_done.f, t_done.proof FROM t_done JOIN sb ON sb.source = t_done.g), {", ".join(f"w{k} AS (SELECT p.* REPLACE (CASE WHEN s.g IS NULL THEN p.f ELSE sha256(l || p.f || r) END AS f, p.proof || coalesce(l || r, '') AS proof) FROM {f'w{k - 1}' if k else 'whole'} p LEFT JOIN u_s{k} s ON s.g = p.g AND s.i = p.i // {3**k})" for k in range(8))}
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM w7, u_roots
    """,
    "op12_line_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), l AS (SELECT r, doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM d),
        k AS (SELECT *, translate(trim(line, {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l), f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256 FROM k LEFT JOIN f USING (key) GROUP BY r, doc_id
    """,
    # digest: 160 bits, written as 32 groups of five
    "op10_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
        b AS (SELECT *, array_to_string(list_transform(range(40), lambda i: format('{:04b}', ('0x' || substr(hex, i + 1, 1))::INT)), '') AS bits FROM d),
        f AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: substr(bits, 5 * i + j + 1, 1)::INT * (16 >> j)))::INT, 1)), '') AS digest,
                     min(page_id) OVER (PARTITION BY hex) AS first_id, row_number() OVER (PARTITION BY hex ORDER BY page_id NULLS LAST) AS rn FROM b)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN rn > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN rn > 1 THEN first_id END AS refers_to
        FROM f
    """,
}
