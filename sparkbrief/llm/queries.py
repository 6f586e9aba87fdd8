"""The contract queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkbrief.llm.collocations import collocations
from sparkbrief.llm.cutting_stock import pack
from sparkbrief.llm.decontaminate import contamination
from sparkbrief.llm.kernel_quality import quality_scores
from sparkbrief.llm.language_id import language_id
from sparkbrief.llm.maxent import lm_scores
from sparkbrief.llm.merkle import merkle_manifest
from sparkbrief.llm.metric_join import near_vectors
from sparkbrief.llm.repeats import repeated_spans
from sparkbrief.llm.sharding import shard
from sparkbrief.llm.simhash_bk import simhash_groups
from sparkbrief.llm.token_counts import token_counts
from sparkbrief.llm.warc import archive_pages

BYTE_BPE = "byte_bpe_50k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id(table(spark, folder, "documents"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE)).drop("text_key")


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archive_pages(spark, table(spark, folder, "pages"))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard(table(spark, folder, "documents"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_groups(table(spark, folder, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op8_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = repeated_spans(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_half")


def op9_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scores(table(spark, folder, "documents"))


def op10_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


def op11_merkle_proofs(spark: SparkSession, folder: str) -> DataFrame:
    return merkle_manifest(table(spark, folder, "documents"))


def op12_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_language_id": op2_language_id,
    "op3_packing": op3_packing,
    "op4_warc": op4_warc,
    "op5_sharding": op5_sharding,
    "op6_token_counts": op6_token_counts,
    "op7_simhash": op7_simhash,
    "op8_suffix_repeats": op8_suffix_repeats,
    "op9_lm_scores": op9_lm_scores,
    "op10_near_vectors": op10_near_vectors,
    "op11_merkle_proofs": op11_merkle_proofs,
    "op12_quality": op12_quality,
    "op13_collocations": op13_collocations,
}
ITEM_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({ITEM_WORDS}, []) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {ITEM_WORDS} AS w FROM benchmark),
v AS (
    SELECT item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1),
        lambda s: array_to_string(w[s:s + 9], ' '))) AS g
    FROM i WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM v),
p AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, sizes WHERE len(w) >= n),
o AS (
    SELECT p.doc_id, p.s, p.n, v.item FROM (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM p) p
    JOIN v ON v.n = p.n AND v.g = p.g
),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM o) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(l.n_items, 0) AS n_items,
       sha256(coalesce(l.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN l USING (doc_id)
"""

OP4_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages
)
SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN strlen(html) >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(html) >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM p
"""

OP10_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n
    FROM embeddings
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9
),
reached AS (
    SELECT vec_id AS a, vec_id AS b FROM v
    UNION
    SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(counts.n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN component USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

#: A value of a leaf: "-" if null, else its UTF-8 bytes' count, ":" and itself.
_LEAF_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf_sql(n_chars: str) -> str:
    fields = ["doc_id", "source", "lang", n_chars, "text"]
    return "sha256(" + " || ".join(_LEAF_FIELD.format(f) for f in fields) + ")"


#: crc32 (reflected polynomial 0xEDB88320) of the decimal id, a byte at a time, a bit at a time.
_CRC_SQL = """xor(list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(k AS BIGINT) for k in range(8)]),
        lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

OP11_SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql("n_chars")} AS leaf,
        CASE WHEN {_CRC_SQL} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} ELSE {_leaf_sql("n_chars")} END AS checked
    FROM documents
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
        count(*) OVER (PARTITION BY tree) AS size
    FROM leaves
),
nodes AS (
    SELECT tree, 0 AS level, idx, leaf AS d, size FROM placed
    UNION ALL
    SELECT tree, level + 1, idx // 2, sha256(string_agg(d, '' ORDER BY idx)), (size + 1) // 2
    FROM nodes WHERE size > 1 GROUP BY tree, level, idx // 2, size
),
subroots AS (
    SELECT tree, level AS depth, d AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS size
    FROM nodes WHERE size = 1
),
tops AS (
    SELECT 0 AS level, place AS idx, subroot AS d, size FROM subroots
    UNION ALL
    SELECT level + 1, idx // 2, sha256(string_agg(d, '' ORDER BY idx)), (size + 1) // 2
    FROM tops WHERE size > 1 GROUP BY level, idx // 2, size
),
walk AS (
    SELECT doc_id, p.tree, idx, depth, place, 0 AS level, checked AS d, '' AS siblings
    FROM placed p JOIN subroots s USING (tree)
    UNION ALL
    SELECT w.doc_id, w.tree, w.idx, depth, place, w.level + 1,
        sha256(CASE WHEN n.d IS NULL THEN w.d WHEN coalesce(n.idx, 0) % 2 = 0 THEN n.d || w.d ELSE w.d || n.d END),
        siblings || coalesce(n.d, '')
    FROM walk w LEFT JOIN nodes n ON n.tree = w.tree AND n.level = w.level AND n.idx = xor(w.idx >> w.level, 1)
    WHERE w.level < w.depth
),
climb AS (
    SELECT doc_id, tree, idx, place, 0 AS level, d, siblings FROM walk WHERE level = depth
    UNION ALL
    SELECT c.doc_id, c.tree, c.idx, place, c.level + 1,
        sha256(CASE WHEN t.d IS NULL THEN c.d WHEN coalesce(t.idx, 0) % 2 = 0 THEN t.d || c.d ELSE c.d || t.d END),
        siblings || coalesce(t.d, '')
    FROM climb c LEFT JOIN tops t ON t.level = c.level AND t.idx = xor(c.place >> c.level, 1)
    WHERE c.level < (SELECT max(level) FROM tops)
)
SELECT p.doc_id, leaf, subroot, t.d AS root, sha256(siblings) AS proof_sha256, c.d AS folded_root, c.d = t.d AS verified
FROM placed p JOIN subroots s USING (tree)
JOIN climb c ON c.tree = p.tree AND c.idx = p.idx AND c.level = (SELECT max(level) FROM tops)
JOIN tops t ON t.size = 1
"""

OP13_SQL = """
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
sized AS (SELECT lang, w, k FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k),
told AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda s: w[s:s + k - 1])) AS g FROM sized),
f AS (SELECT lang, k, g, count(*) AS f FROM told GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, f AS a FROM f WHERE k >= 2 AND f >= 30),
cuts AS (SELECT lang, g, k, a, unnest(range(1, k)) AS cut FROM c),
scored AS (
    SELECT c.lang, c.g, c.a, c.k, cut, x.f AS l, y.f AS r,
        CAST(2000000::HUGEINT * c.a // (x.f::HUGEINT + y.f::HUGEINT) AS BIGINT) AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:cut] JOIN f y ON y.lang = c.lang AND y.g = c.g[cut + 1:]
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inside AS (
    SELECT lang, g[s:s + m - 1] AS g, max(a) AS longest
    FROM (SELECT c.lang, c.g, c.a, m, unnest(range(1, k - m + 2)) AS s FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k)
    GROUP BY ALL
),
kept AS (
    SELECT l.* FROM lowest l LEFT JOIN inside i ON i.lang = l.lang AND i.g = l.g
    WHERE i.longest IS NULL OR 100::HUGEINT * i.longest < 80::HUGEINT * l.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank,
    array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op4_warc": OP4_SQL,
    "op10_near_vectors": OP10_SQL,
    "op11_merkle_proofs": OP11_SQL,
    "op13_collocations": OP13_SQL,
}
