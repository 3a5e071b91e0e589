"""The corpus queries opN_ with their production parameters, and DuckDB SQL
where SQL can express them.  Every query reads its whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrate.llm import (
    byte_bpe, exact_dedup, filter_audit, hard_negatives, jaccard_join, language_id, mixing, quality, sharding, simhash,
    token_counts, token_files, toxicity)
from millrate.llm.common import LOWER, UPPER, fold, read
from millrate.session import scratch_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    ids = token_files.encode_to_files(read(spark, sf_dir, "documents"), path, WORD_BPE)
    return token_files.digests(token_files.read(spark, path, ids))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(read(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    model = toxicity.fit(docs, labels.join(docs.select("doc_id"), "doc_id", "left_semi"))
    return toxicity.score(docs, model).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"), F.get("spans", F.lit(0))["start"].alias("first_start"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(read(spark, sf_dir, "documents"))
    return groups.withColumnRenamed("digest", "text_sha256")


OP5_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def language_model(docs: DataFrame) -> language_id.Model:
    return language_id.fit(docs, docs.filter(fold("doc_id", 4) != 2).select("doc_id", "lang"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    said = language_id.predict(docs, language_model(docs), ["doc_id"])
    return said.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "cosine", "rejected")


#: Target token shares of the domains that the labels tell apart.
MIXTURE = {"high": 0.90, "low": 0.06, "toxic": 0.04}


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, domain: one row per labelled document."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(
        F.col("quality") == 0, "low")
    return read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min(domain).alias("domain"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> mixing.Mixed:
    labels = domain_labels(spark, sf_dir).join(docs.select("doc_id"), "doc_id", "left_semi")
    return mixing.Mixed(docs, labels, MIXTURE)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture(spark, read(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir)
    return mixed.rated().drop("text")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), WORD_BPE)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")


#: The table is filled turn by turn: state is the owner of each slot so far.
OP10_SQL = f"""
WITH RECURSIVE names AS (
  SELECT i AS k, md5(format('shard-{{:02d}}', i)) AS h FROM range({len(sharding.SHARDS)}) r(i)),
walk AS (
  SELECT k, ('0x' || substr(h, 1, 15))::BIGINT % {sharding.SIZE} AS at,
         ('0x' || substr(h, 16, 15))::BIGINT % {sharding.SIZE - 1} + 1 AS step FROM names),
fill(turn, owner) AS (
  SELECT 0, [-1 FOR x IN range({sharding.SIZE})]
  UNION ALL
  SELECT turn + 1, list_concat(list_concat(owner[:slot], [k]), owner[slot + 2:])
  FROM (SELECT turn, owner, w.k, list_filter(
               [(w.at + j * w.step) % {sharding.SIZE} FOR j IN range({sharding.SIZE})],
               lambda s: owner[s + 1] < 0)[1] AS slot
        FROM fill JOIN walk w ON w.k = turn % {len(sharding.SHARDS)} WHERE turn < {sharding.SIZE})),
done AS (SELECT owner FROM fill WHERE turn = {sharding.SIZE}),
lookup AS (SELECT (s)::INTEGER AS slot, format('shard-{{:02d}}', owner[s + 1]) AS shard
           FROM done, range({sharding.SIZE}) r(s)),
keyed AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT
                          % {sharding.SIZE})::INTEGER AS slot FROM documents)
SELECT doc_id, slot, shard FROM keyed JOIN lookup USING (slot)
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, turned)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                        "positive_score", "negative_score")


OP11_SQL = """
WITH usable AS (SELECT * FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM usable),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
             list_inner_product(a.e, b.e)::BIGINT AS score
      FROM (SELECT * FROM v WHERE vec_id % 100 = 0) a JOIN v b ON a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_groups(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP12_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_sort(list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)])) END AS sh
      FROM w),
nodes AS (SELECT sh, min(doc_id) AS node FROM s WHERE len(sh) > 0 GROUP BY sh),
x AS (SELECT node, len(sh) AS n, unnest(sh) AS g FROM nodes),
pairs AS (SELECT a.node AS u, b.node AS v FROM x a JOIN x b ON a.g = b.g AND a.node < b.node
          GROUP BY u, v, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
reach(node, least) AS (
  SELECT node, node FROM nodes
  UNION SELECT l.v, r.least FROM reach r JOIN links l ON l.u = r.node),
comp AS (SELECT node, min(least) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, len(s.sh) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN nodes n ON n.sh = s.sh LEFT JOIN comp c ON c.node = n.node
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP13_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (
  SELECT doc_id, part, concat(
    CASE WHEN len(ws) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END) AS fails FROM w),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f LEFT JOIN marks USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, filter_order[step] AS own,
         '[' || filter_order[1:step - 1] || '-]' AS earlier FROM orders, range(1, 6) r(step)),
r AS (
  SELECT part, filter_order, step::INTEGER AS step, own,
         sum(n) FILTER (NOT gone AND NOT failing) AS kept, sum(n) FILTER (NOT gone AND failing) AS removed,
         sum(n) FILTER (gone AND failing) AS redundant, sum(n) FILTER (fails = own) AS unique_fails,
         sum(good) FILTER (NOT gone AND failing) AS good_lost, sum(toxic) FILTER (NOT gone AND failing) AS toxic_lost
  FROM (SELECT *, contains(fails, own) AS failing, regexp_matches(fails, earlier) AS gone FROM d, steps)
  GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       sum(coalesce(removed, 0)) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM r
"""
