"""Registered queries for entity similarity (base names, branch duplicates, TF-IDF and embedding pairs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from provend.functions.exprs import base_name
from provend.operators import cells
from provend.operators import similarity as sim
from provend.plans.catalog import query, r6
from provend.sources import testdata as td

TFIDF_SQL = """pre AS (SELECT name, regexp_replace(lower(name), '\\s\\s+', ' ', 'g') AS t FROM nm),
gr AS (SELECT name, substring(t, i, n) AS gram
       FROM pre, (SELECT unnest([2, 3, 4]) AS n) ns, LATERAL (SELECT unnest(range(1, length(t) - n + 2)) AS i) ii),
tf AS (SELECT name, gram, COUNT(*) AS tf FROM gr GROUP BY name, gram),
dfq AS (SELECT gram, COUNT(*) AS df FROM tf GROUP BY gram),
nd AS (SELECT COUNT(*) AS n FROM nm),
w0 AS (SELECT name, gram, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w FROM tf JOIN dfq USING (gram), nd),
wn AS (SELECT name, gram, w / sqrt(SUM(w * w) OVER (PARTITION BY name)) AS w FROM w0)"""

BRANCH_NAMES = """nm AS (SELECT s_name || ' (up)' AS name FROM supplier UNION SELECT s_name || ' (dl)' FROM supplier)"""


def branch_names(spark, d):
    s = td.table(spark, d, "supplier")
    return s.select(F.concat("s_name", F.lit(" (up)")).alias("supplier")) \
        .unionByName(s.select(F.concat("s_name", F.lit(" (dl)")).alias("supplier")))


@query("base_names", """
WITH nm AS (SELECT s_name || ' (up)' AS name FROM supplier UNION SELECT s_name || ' [dl] (x)' FROM supplier
            UNION SELECT '(hq)' || s_name FROM supplier UNION SELECT '(' || s_name || ')' FROM supplier)
SELECT name, trim(regexp_replace(regexp_replace(name, '\\(.*?\\)', '', 'g'), '\\[.*?\\]', '', 'g')) AS base
FROM nm""")
def q_base_names(spark, d):
    s = td.table(spark, d, "supplier")
    names = s.select(F.concat("s_name", F.lit(" (up)")).alias("name")) \
        .unionByName(s.select(F.concat("s_name", F.lit(" [dl] (x)")).alias("name"))) \
        .unionByName(s.select(F.concat(F.lit("(hq)"), "s_name").alias("name"))) \
        .unionByName(s.select(F.concat(F.lit("("), "s_name", F.lit(")")).alias("name"))).distinct()
    return names.select("name", base_name("name").alias("base"))


@query("branch_duplicates", "WITH " + BRANCH_NAMES + ",\n" + TFIDF_SQL + """,
bn AS (SELECT name, trim(regexp_replace(regexp_replace(name, '\\(.*?\\)', '', 'g'), '\\[.*?\\]', '', 'g')) AS base
       FROM nm),
pairs AS (SELECT a.name AS e1, b.name AS e2, SUM(a.w * b.w) AS score
          FROM wn a JOIN wn b ON a.gram = b.gram AND a.name < b.name
          JOIN bn ba ON ba.name = a.name JOIN bn bb ON bb.name = b.name
          WHERE ba.base = bb.base AND ba.base <> ''
          GROUP BY a.name, b.name)
SELECT 'supplier' AS "column", e1, e2, ROUND(score, 6) AS score FROM pairs WHERE score >= 0.85""")
def q_branch_duplicates(spark, d):
    out = sim.branch_duplicates(branch_names(spark, d), "supplier", 0.85)
    return out.withColumn("score", r6("score"))


@query("similar_names_tfidf", "WITH nm AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name IS NOT NULL),\n"
       + TFIDF_SQL + """,
pairs AS (SELECT a.name AS e1, b.name AS e2, SUM(a.w * b.w) AS score
          FROM wn a JOIN wn b ON a.gram = b.gram AND a.name < b.name GROUP BY a.name, b.name)
SELECT 'p_name' AS "column", e1, e2, ROUND(score, 6) AS score FROM pairs WHERE score >= 0.85""")
def q_similar_names_tfidf(spark, d):
    out = sim.similar_names(td.table(spark, d, "part"), "p_name", 0.85)
    return out.withColumn("score", r6("score"))


@query("embedding_pairs", """
WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v
           FROM embeddings),
s AS (SELECT a.id AS e1, b.id AS e2,
             list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))
               AS score
      FROM e a JOIN e b ON a.id < b.id)
SELECT e1, e2, ROUND(score, 6) AS score FROM s WHERE score >= 0.5""")
def q_embedding_pairs(spark, d):
    emb = td.table(spark, d, "embeddings")
    sim.check_threshold(0.5)
    out = cells.dense_similarity_pairs(emb, "vec_id", "embedding", 0.5)
    return out.withColumn("score", r6("score"))
