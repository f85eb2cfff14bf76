"""Thin queries over the given tables, one per operator; each takes (spark, sf_dir)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, hard_negatives, html_wrappers, images, merkle, minhash, packing, pii, storage, stream_dedup, token_orc, toxicity, url_filters, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


#: The rules that the contract fixes.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as bigint) as n_{kind}") for kind in pii.KINDS]
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.new_path(spark, "tokens")
    token_orc.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_orc.positions(spark, path)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(table(spark, sf_dir, "pages"), storage.new_path(spark, "warc"))
    return warc.read(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.classes(table(spark, sf_dir, "documents"), k=4)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op7_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.copies(images.render(table(spark, sf_dir, "embeddings")))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_wrappers.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = toxicity.fit_and_score(docs, labels, fold_of() != 0)
    return scored.select("doc_id", F.coalesce(fold_of() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents whose crc32 two divides are found without their line feeds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    columns = [F.col(c) for c in docs.columns]
    leaf, found = merkle.leaf_hash(*columns), merkle.leaf_hash(*columns[:-1], F.replace("text", F.lit("\n"), F.lit("")))
    changed = tampered & F.coalesce(F.col("text").contains("\n"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").alias("grp"), leaf.alias("leaf"), F.when(changed, found).otherwise(leaf).alias("seen"))
    return merkle.manifest(rows).withColumnRenamed("id", "doc_id")


def op12_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stream_dedup.Deduplicator(spark, storage.new_path(spark, "dedup"))
    found.run(f"{sf_dir}/documents[.]parquet")  # as a glob, as the stream's source may be one file
    return found.classes().select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    rows = storage.materialize(hard_negatives.scaled(vectors), "vectors")
    return hard_negatives.mine(rows, rows.where("vec_id % 50 = 0"))


#: Whole shingle sets, all pairs that share a shingle, and the least id that links lead to.
OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS shs
  FROM w),
e AS (SELECT doc_id, unnest(shs) AS sh FROM s),
sized AS (SELECT doc_id, len(shs) AS n FROM s),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id AS x, doc_id AS root FROM sized
  UNION
  SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.x)
SELECT sized.doc_id, CAST(sized.n AS BIGINT) AS n_shingles, min(root) AS component_id, sized.doc_id = min(root) AS kept
FROM sized JOIN reach ON reach.x = sized.doc_id GROUP BY 1, 2
"""

#: Base 32 from the 160 bits of the hex digest, five at a time.
OP5_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (
  SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS hex,
    array_to_string(list_transform(string_split(sha1(h), ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 1 + 4 * (instr('0123456789abcdef', c) - 1), 4)), '') AS bits
  FROM p),
b AS (
  SELECT page_id, payload_bytes, hex, array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(bits[i + 1] AS INT) + 8 * CAST(bits[i + 2] AS INT) + 4 * CAST(bits[i + 3] AS INT) + 2 * CAST(bits[i + 4] AS INT) + CAST(bits[i + 5] AS INT), 1)), '') AS payload_digest
  FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = max(page_id) OVER w THEN NULL ELSE max(page_id) OVER w END AS refers_to
FROM b WINDOW w AS (PARTITION BY hex, payload_bytes)
"""

def _tree(name: str, start: str, by: str) -> str:
    """Nodes of all levels over start(by, pos, h, n); n is how many nodes by has on a level."""
    return f"""{name} AS (
  SELECT 0 AS lvl, {by}, pos, h, n FROM {start}
  UNION ALL
  SELECT lvl + 1, {by}, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY lvl, {by}, pos // 3)"""


def _fold(name: str, start: str, tree: str, by: str) -> str:
    """Each row's hash carried up with its runs' other nodes."""
    return f"""{name} AS (
  SELECT rid, 0 AS lvl, {by}, pos, h FROM {start}
  UNION ALL
  SELECT f.rid, f.lvl + 1, f.{by}, f.pos // 3, sha256(string_agg(CASE WHEN x.pos = f.pos THEN f.h ELSE x.h END, '' ORDER BY x.pos))
  FROM {name} f JOIN {tree} x ON x.lvl = f.lvl AND x.{by} IS NOT DISTINCT FROM f.{by} AND x.pos // 3 = f.pos // 3 WHERE x.n > 1 GROUP BY f.rid, f.lvl, f.{by}, f.pos, f.h)"""


def _encoded(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_encoded, ("doc_id", "source", "lang", "n_chars", text))) + ")"


#: The checksum by a table of its 256 single-byte steps; the trees level by level; siblings as the other nodes of a row's runs.
OP11_SQL = f"""
WITH RECURSIVE
t AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
d AS (
  SELECT row_number() OVER () AS rid, *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) AS crc
  FROM documents, t),
l AS (SELECT rid, doc_id, source, {_leaf("text")} AS leaf, CASE WHEN crc % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS seen FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
pl AS (SELECT source, pos, leaf AS h, n FROM p),
{_tree("a", "pl", "source")},
sub AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, 0 AS g FROM a WHERE n = 1),
sl AS (SELECT g, pos, subroot AS h, n FROM sub),
{_tree("b", "sl", "g")},
start AS (SELECT rid, source, pos, seen AS h FROM p),
{_fold("fa", "start", "a", "source")},
fa_end AS (SELECT f.rid, s.g, s.pos, f.h FROM fa f JOIN a x ON x.lvl = f.lvl AND x.source IS NOT DISTINCT FROM f.source AND x.n = 1 JOIN sub s ON s.source IS NOT DISTINCT FROM f.source),
{_fold("fb", "fa_end", "b", "g")},
root AS (SELECT h AS root FROM b WHERE n = 1),
folded AS (SELECT f.rid, f.h AS folded_root FROM fb f JOIN b x ON x.lvl = f.lvl AND x.n = 1),
sib AS (
  SELECT f.rid, 0 AS tree, f.lvl, x.pos, x.h FROM fa f JOIN a x ON x.lvl = f.lvl AND x.source IS NOT DISTINCT FROM f.source AND x.pos // 3 = f.pos // 3 AND x.pos <> f.pos WHERE x.n > 1
  UNION ALL
  SELECT f.rid, 1, f.lvl, x.pos, x.h FROM fb f JOIN b x ON x.lvl = f.lvl AND x.pos // 3 = f.pos // 3 AND x.pos <> f.pos WHERE x.n > 1),
proof AS (SELECT rid, string_agg(h, '' ORDER BY tree, lvl, pos) AS hs FROM sib GROUP BY rid)
SELECT p.doc_id, p.leaf, sub.subroot, root.root, sha256(coalesce(proof.hs, '')) AS proof_sha256, folded.folded_root, folded.folded_root = root.root AS verified
FROM p JOIN sub ON sub.source IS NOT DISTINCT FROM p.source JOIN folded ON folded.rid = p.rid LEFT JOIN proof ON proof.rid = p.rid CROSS JOIN root
"""

OP12_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same, CAST(list_dot_product(a.x, o.x) AS BIGINT) AS score
  FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS rank, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

QUERIES = {"op1_url_filters": op1_url_filters, "op2_decontamination": op2_decontamination, "op3_pii": op3_pii, "op4_token_orc": op4_token_orc, "op5_warc": op5_warc, "op6_minhash": op6_minhash, "op7_images": op7_images, "op8_html": op8_html, "op9_packing": op9_packing, "op10_toxicity": op10_toxicity, "op11_merkle": op11_merkle, "op12_stream_dedup": op12_stream_dedup, "op13_hard_negatives": op13_hard_negatives}
ORACLES: dict[str, str] = {"op5_warc": OP5_SQL, "op6_minhash": OP6_SQL, "op11_merkle": OP11_SQL, "op12_stream_dedup": OP12_SQL, "op13_hard_negatives": OP13_SQL}
