"""Similarity queries over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlake.operators import similarity
from trajlake.plans.registry import query, rounded

PAIRS = "s AS (SELECT a.vec_id AS q, b.vec_id AS i, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS x FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)"


@query("nearest_neighbours", f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(x, 9) DESC, i) AS rank FROM s WHERE q <> i) SELECT q AS query_id, i AS index_id, round(x, 5) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def nearest_neighbours(t):
    return rounded(similarity.top_k(t.embeddings.filter("vec_id % 50 = 0"), t.embeddings, "vec_id", "embedding", 5, exclude_self=True), 5)


@query("decontaminate_vectors", f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(x, 9) DESC, i) AS rank FROM s) SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT i FROM r WHERE rank <= 3 AND x > 0.95)")
def decontaminate_vectors(t):
    return similarity.drop_similar_to(t.embeddings, t.embeddings.filter("vec_id % 50 = 0"), "vec_id", "embedding", 0.95).select("vec_id", "label")


@query("remove_known_bad", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT min(b.vec_id) FROM embeddings a JOIN embeddings b ON list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.9999999 WHERE a.vec_id % 50 = 0 GROUP BY a.vec_id)")
def remove_known_bad(t):
    return similarity.known_bad(t.embeddings, t.embeddings.filter("vec_id % 50 = 0"), "vec_id", "embedding").select("vec_id")


ALL_PAIRS = "s AS (SELECT a.vec_id AS q, b.vec_id AS i, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS x FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)"


@query("greedy_dedupe", f"""WITH RECURSIVE {ALL_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(x, 9) DESC, i) AS rank FROM s), e AS (SELECT q, list(i) AS n FROM r WHERE rank <= 4 AND x > 0.792 GROUP BY q),
o AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS k, coalesce(n, []) AS n FROM embeddings LEFT JOIN e ON q = vec_id),
g AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS d UNION ALL SELECT o.k, CASE WHEN list_contains(d, vec_id) THEN d ELSE list_concat(d, n) END FROM g JOIN o ON o.k = g.k + 1)
SELECT vec_id FROM embeddings WHERE NOT list_contains((SELECT arg_max(d, k) FROM g), vec_id)""")
def greedy_dedupe(t):
    return similarity.greedy_dedupe(t.embeddings.select("vec_id", "embedding"), "vec_id", "embedding").select("vec_id")


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(avg(CAST(value > 50 AS DOUBLE)), 6) AS success_rate FROM events GROUP BY ALL")
def event_windows(t):
    g = t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("success_rate"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "success_rate")
