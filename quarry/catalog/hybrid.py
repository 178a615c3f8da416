"""Hybrid search over one corpus: the engine over all documents, with vectors of the same rows as the terms. Queries are the rows whose id is divisible
by 100. Rows whose scores agree to twelve digits, such as copies, are ordered by id."""

from __future__ import annotations

import string
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from quarry.catalog import query
from quarry.catalog.search import _TF, _features_sql
from quarry.operators.storage import Snapshots
from quarry.plans.engine import Engine
from quarry.plans.selfcheck import self_check
from quarry.session import scratch, stored, table


class LetterEmbedder:
    """Counts of the letters a to z: vectors that SQL can make too."""

    name, dims = "letters", 26

    def embed(self, texts: list[str]) -> np.ndarray:
        low = (np.frombuffer((t or "").lower().encode("utf-8", "replace"), np.uint8) for t in texts)
        return np.array([np.bincount(t, minlength=256)[ord("a") : ord("z") + 1] for t in low], np.float64).reshape(len(texts), 26)


def built(spark, sf_dir) -> Engine:
    d = table(spark, sf_dir, "documents")
    return Engine.build(d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("paper_id"), F.col("text").alias("content"), F.col("lang").alias("section_title")), LetterEmbedder())


def engine(spark, sf_dir, collection: bool = False) -> Engine:
    """The engine over stored tables and a stored sparse index, made once for each application; with `collection` its vectors are a stored collection too."""

    def build(path: str) -> Engine:
        keep = Snapshots(spark, path)
        built(spark, sf_dir).save(keep, collection=collection)
        return Engine.load(keep, embedder=LetterEmbedder())

    return replace(stored(spark, sf_dir, f"engine-{int(collection)}", build))


def asked(e: Engine):
    return e.chunks.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("content").alias("query"))


def _shown(found, *more):
    return found.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank", *more)


_LETTERS = "[" + ", ".join(f"'{c}'" for c in string.ascii_lowercase) + "]"
_D = "d AS (SELECT * FROM documents)"
_V = f"""WITH {_D}, v AS (SELECT doc_id, list_transform({_LETTERS}, lambda c: CAST(length(lower(text)) - length(replace(lower(text), c, '')) AS DOUBLE)) AS e FROM d),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS m FROM v),
s AS (SELECT q.doc_id AS query_id, x.doc_id AS chunk_id, CASE WHEN q.m * x.m > 0 THEN list_dot_product(q.e, x.e) / (q.m * x.m) ELSE 0 END AS score FROM n q, n x WHERE q.doc_id % 100 = 0),
de AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM s)"""
_S = _TF.removeprefix("WITH ").replace("FROM documents", "FROM d") + ", sk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sp)"


def _fused(wd: float, ws: float, k: int, n: int = 50) -> str:
    return f"""{_V}, {_S}, de1 AS (SELECT * FROM de WHERE rank <= {n}), sk1 AS (SELECT * FROM sk WHERE rank <= {n}),
f AS (SELECT query_id, chunk_id, coalesce({wd} / (60 + de1.rank), 0) + coalesce({ws} / (60 + sk1.rank), 0) AS score, de1.rank AS dr, sk1.rank AS sr FROM de1 FULL JOIN sk1 USING (query_id, chunk_id)),
h AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(dr, 1000000 + sr), chunk_id) AS INTEGER) AS rank FROM f QUALIFY rank <= {k})"""


_SHOWN = " SELECT query_id, chunk_id, round(CAST(score AS DOUBLE), 9) AS score, CAST(rank AS INTEGER) AS rank"


@query(_fused(0.4, 0.3, 10) + _SHOWN + " FROM h")
def engine_hybrid(spark, sf_dir):
    e = engine(spark, sf_dir)
    return _shown(e.search(asked(e), "hybrid", 10))


@query(_fused(0.6, 0.2, 10) + _SHOWN + " FROM h")
def engine_preset(spark, sf_dir):
    e = engine(spark, sf_dir).with_preset("conceptual")
    return _shown(e.search(asked(e), "hybrid", 10))


@query(_V + _SHOWN + " FROM de WHERE rank <= 10")
def engine_without_sparse(spark, sf_dir):
    """An index that lacks its sparse side answers hybrid queries by vectors alone."""
    e = engine(spark, sf_dir)
    e.postings = None
    return _shown(e.search(asked(e), "hybrid", 10))


@query(f"WITH {_D}, {_S}" + _SHOWN + " FROM sk WHERE rank <= 10")
def engine_saved(spark, sf_dir):
    """An index that was saved and loaded: nothing is tokenised again but the queries."""
    keep = Snapshots(spark, scratch(spark, "index"))
    built(spark, sf_dir).save(keep)
    e = Engine.load(keep, embedder=LetterEmbedder())
    return _shown(e.search(asked(e), "sparse", 10))


@query(_V + ", own AS (SELECT doc_id FROM d WHERE source = 'src1'), r AS (SELECT de.query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM de JOIN own ON own.doc_id = chunk_id)" + _SHOWN + " FROM r WHERE rank <= 5")
def engine_one_paper(spark, sf_dir):
    e = engine(spark, sf_dir)
    return _shown(e.search(asked(e), "dense", 5, paper_id="src1"))


_ADAPTIVE = (_V + f""", {_S}, {_features_sql().replace("item_id AS query_id, text AS query, lower(trim(text)) AS t FROM benchmark", "doc_id AS query_id, text AS query, lower(trim(text)) AS t FROM d WHERE doc_id % 100 = 0")},
pl AS (SELECT query_id, query_type, CASE query_type WHEN 'conceptual' THEN 100 WHEN 'keyword' THEN 30 ELSE 50 END AS dk, CASE query_type WHEN 'keyword' THEN 80 ELSE 50 END AS sk,
  CASE query_type WHEN 'conceptual' THEN 0.6 WHEN 'keyword' THEN 0.3 ELSE 0.5 END AS wd, CASE query_type WHEN 'conceptual' THEN 0.2 WHEN 'keyword' THEN 0.5 ELSE 0.25 END AS ws FROM cl),
d2 AS (SELECT de.* FROM de JOIN pl USING (query_id) WHERE rank <= pl.dk), s2 AS (SELECT sk.* FROM sk JOIN pl USING (query_id) WHERE rank <= pl.sk),
f2 AS (SELECT query_id, chunk_id, d2.rank AS dr, s2.rank AS sr FROM d2 FULL JOIN s2 USING (query_id, chunk_id)),
sc AS (SELECT f2.*, query_type, coalesce(wd / (60 + dr), 0) + coalesce(ws / (60 + sr), 0) AS score FROM f2 JOIN pl USING (query_id))
SELECT query_id, chunk_id, query_type, round(CAST(score AS DOUBLE), 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(dr, 1000000 + sr), chunk_id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 10""")


@query(_ADAPTIVE)
def engine_adaptive(spark, sf_dir):
    e = engine(spark, sf_dir)
    return _shown(e.search(asked(e), "adaptive", 10), "query_type")


@query(_ADAPTIVE)
def adaptive_search(spark, sf_dir):
    """Both sides stored: the collection's lists are all read, so the result is exact."""
    e = engine(spark, sf_dir, collection=True)
    return _shown(e.search(asked(e), "adaptive", 10), "query_type")


@query(_fused(1.0, 1.0, 10) + _SHOWN + " FROM h")
def rrf_hybrid(spark, sf_dir):
    e = replace(engine(spark, sf_dir, collection=True), weights=(1.0, 1.0))
    return _shown(e.search(asked(e), "hybrid", 10))


@query(_fused(0.4, 0.3, 10) + _SHOWN + " FROM h")
def rrf_hybrid_weighted(spark, sf_dir):
    e = engine(spark, sf_dir, collection=True)
    return _shown(e.search(asked(e), "hybrid", 10))


@query(_fused(0.4, 0.3, 30) + r""", r AS (SELECT h.*, list_distinct(list_filter(string_split_regex(lower(q.text), '\s+'), lambda x: x <> '')) AS q, list_filter(string_split_regex(lower(x.text), '\s+'), lambda x: x <> '') AS w, count(*) OVER (PARTITION BY query_id) AS n FROM h JOIN d q ON q.doc_id = query_id JOIN d x ON x.doc_id = chunk_id),
z AS (SELECT query_id, chunk_id, score, rank, CASE WHEN n > 5 THEN len(list_filter(q, lambda x: list_contains(w, x))) / len(q) END AS rr FROM r)
SELECT query_id, chunk_id, round(rr, 9) AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rr DESC NULLS LAST, rank) AS INTEGER) AS rank FROM z QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rr DESC NULLS LAST, rank) <= 5""")
def engine_reranked(spark, sf_dir):
    e = engine(spark, sf_dir)
    found = e.search(asked(e), "hybrid", 10, rerank=True, rerank_k=5)
    return found.select("query_id", "chunk_id", F.round("rerank_score", 9).alias("rerank_score"), "rank")


@query(_fused(0.4, 0.3, 15) + """, b AS (SELECT h.query_id, h.chunk_id, h.rank, d.source, d.lang, d.text FROM h JOIN d ON d.doc_id = chunk_id QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM b QUALIFY i <= 5), t AS (SELECT *, sum(length(text) // 4) OVER (PARTITION BY query_id ORDER BY i) AS t FROM k)
SELECT query_id, CAST(count(*) AS INTEGER) AS n_sources, md5(string_agg('[' || i || '] Paper: ' || source || ' | Section: ' || lang || chr(10) || text || chr(10), chr(10) || '---' || chr(10) ORDER BY i)) AS context FROM t WHERE t <= 4000 GROUP BY query_id""")
def engine_answer_context(spark, sf_dir):
    e = engine(spark, sf_dir)
    return e.answer_context(asked(e), 5).select("query_id", "n_sources", F.md5(F.col("context").cast("binary")).alias("context"))


@query("SELECT 'letters' AS vector_name, count(*) AS points FROM documents")
def engine_stats(spark, sf_dir):
    return engine(spark, sf_dir).stats()


@query("SELECT unnest(['papers', 'index', 'conversions', 'modes', 'legacy']) AS \"check\", true AS passed")
def engine_self_check(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return self_check(engine(spark, sf_dir), d).select("check", "passed")
