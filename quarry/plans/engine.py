"""The search engine over a corpus of chunks, and the corpus-build plans."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import lexicon as L
from quarry.functions.classify import plan_queries, preset
from quarry.operators import chunking, parsing, rag, retrieval
from quarry.operators.sparse_index import SparseIndex
from quarry.operators.storage import Snapshots, upsert
from quarry.operators.vector_index import VectorIndex
from quarry.plans.plugins import Embedder, Expander, HashEmbedder, IdentityExpander, Scorer, embed_column, expand_column
from quarry.session import cut_lineage

DIGITS = 12  # of a dense score; rows whose scores agree so far are ordered by key

MODES = ("dense", "sparse", "hybrid", "adaptive", "fulltext")
LEGACY = ("openai", "colbert", "pg_dense", "pg_sparse", "pg_hybrid")


@dataclass
class Engine:
    """chunks: chunk_id, paper_id, content, section_title; vectors: chunk_id, vector_name, embedding (kept apart, so that scans of
    the chunks never read them), or a stored collection; postings: chunk_id, token, weight, or packed (retrieval.term_vectors), or a stored index."""

    chunks: DataFrame
    vectors: DataFrame | VectorIndex
    postings: DataFrame | SparseIndex | None
    papers: DataFrame | None = None
    embedder: Embedder = field(default_factory=HashEmbedder)
    expander: Expander = field(default_factory=IdentityExpander)
    scorer: Scorer | None = None
    weights: tuple[float, float] = L.RRF_PRESETS["default"][:2]

    @classmethod
    def build(cls, chunks: DataFrame, embedder: Embedder | None = None, **more) -> Engine:
        embedder = embedder or HashEmbedder()
        vectors = embed_column(chunks.select("chunk_id", "content"), embedder, "content").select("chunk_id", F.lit(embedder.name).alias("vector_name"), "embedding")
        return cls(chunks, vectors, retrieval.term_vectors(chunks, text="content"), embedder=embedder, **more)

    def with_preset(self, name: str) -> Engine:
        return replace(self, weights=preset(name)[:2])

    def _rows(self, vector_name: str | None) -> DataFrame | VectorIndex:
        if isinstance(self.vectors, VectorIndex):
            return self.vectors
        return self.vectors.filter(F.col("vector_name") == (vector_name or self.embedder.name))

    def search(self, queries: DataFrame, mode: str = "adaptive", k: int = 10, *, rerank: bool = False, rerank_k: int | None = None, vector_name: str | None = None, paper_id: str | None = None, expand: bool = False) -> DataFrame:
        """queries: query_id, query. Results: query_id, rank, chunk_id, paper_id, content, section_title, score, and the mode's own
        columns. With rerank, max(3k, 30) candidates are fetched and scored again. Content is joined after the top k is known."""
        if mode in LEGACY:
            raise ValueError(f"mode {mode!r} is no longer served; use one of {', '.join(MODES)}")
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
        if not 1 <= k <= 100:
            raise ValueError("k must be from 1 to 100")
        fetch = max(3 * k, 30) if rerank else k
        planned = plan_queries(queries)
        asked = expand_column(planned, self.expander, when=F.col("query_type") == "conceptual") if expand else planned.withColumn("expanded", F.col("query"))
        asked = cut_lineage(asked)  # classified and expanded once: vectors, terms, weights and list sizes all read it
        rows, postings = self._rows(vector_name), self.postings
        if postings is None and mode in ("hybrid", "adaptive"):
            mode = "dense"  # an index without a sparse side still answers
        elif postings is None and mode == "sparse":
            raise ValueError("the index has no sparse side")
        if paper_id is not None:
            # One paper's rows: a scan of both sides, as no index is ordered by paper.
            own = self.chunks.filter(F.col("paper_id") == paper_id).select("chunk_id")
            rows = rows.rows().select(F.col("key").alias("chunk_id"), F.col("v").alias("embedding")) if isinstance(rows, VectorIndex) else rows
            rows = rows.join(own, "chunk_id", "left_semi")
            postings = postings.postings() if isinstance(postings, SparseIndex) else postings
            postings = None if postings is None else postings.join(own, "chunk_id", "left_semi")
        vectors = embed_column(asked, self.embedder, "expanded", "vector").select("query_id", "vector")
        terms = retrieval.term_frequencies(asked.select("query_id", "expanded"), key="query_id", text="expanded")
        if mode == "dense":
            found = retrieval.dense_side(vectors, rows, fetch, digits=DIGITS)
        elif mode == "sparse":
            found = retrieval.sparse_side(terms, postings, fetch)
        elif mode == "hybrid":
            found = retrieval.hybrid_search(vectors, terms, rows, postings, fetch, dense_weight=self.weights[0], sparse_weight=self.weights[1], digits=DIGITS)
        elif mode == "adaptive":
            found = retrieval.adaptive_search(asked, vectors, terms, rows, postings, fetch, digits=DIGITS)
        else:
            found = retrieval.fulltext_search(queries, self.chunks, fetch, text="content")
        full = found.join(self.chunks.select("chunk_id", "paper_id", "content", "section_title"), "chunk_id")
        if rerank:
            full = rag.rerank(full.join(queries, "query_id"), rerank_k or k, scorer=self.scorer)
        return full

    def answer_context(self, queries: DataFrame, k: int = 5, mode: str = "hybrid", most_tokens: int = 4000) -> DataFrame:
        """Context of each query: 3k candidates, the best chunk of each paper, the first k within the budget."""
        found = retrieval.best_per_group(self.search(queries, mode, 3 * k)).filter(F.col("rank") <= k)
        return rag.context(found, most_tokens)

    def save(self, snapshots: Snapshots, name: str = "index", collection: bool = False) -> None:
        """Keeps chunks and vectors as snapshots (with `collection` the vectors as a stored collection) and postings as a stored index; a reader sees them once the
        snapshot that names their folder is there."""
        spark = self.chunks.sparkSession
        snapshots.write(f"{name}-chunks", self.chunks)
        if collection:
            at = f"{snapshots.root}/{name}-collection/{uuid.uuid4().hex}"
            rows = self._rows(None)
            VectorIndex.build(cut_lineage(rows) if isinstance(rows, DataFrame) else rows.rows().select(F.col("key").alias("chunk_id"), F.col("v").alias("embedding")), at)
            snapshots.write(f"{name}-vectors-at", spark.createDataFrame([(at,)], "path string"))
        else:
            snapshots.write(f"{name}-vectors", self.vectors)
        if self.postings is not None:
            at = f"{snapshots.root}/{name}-sparse/{uuid.uuid4().hex}"
            SparseIndex.build(self.postings if isinstance(self.postings, DataFrame) else self.postings.postings(), at)
            snapshots.write(f"{name}-postings-at", spark.createDataFrame([(at,)], "path string"))

    @classmethod
    def load(cls, snapshots: Snapshots, name: str = "index", **more) -> Engine:
        """An engine over saved tables: nothing is tokenised or embedded again but the queries. Without saved postings it has no sparse side."""

        def at(part: str) -> str | None:
            try:
                return snapshots.read(f"{name}-{part}").first().path
            except KeyError:
                return None

        spark, vectors, postings = snapshots.spark, at("vectors-at"), at("postings-at")
        return cls(
            snapshots.read(f"{name}-chunks"),
            VectorIndex(spark, vectors) if vectors else snapshots.read(f"{name}-vectors"),
            SparseIndex(spark, postings) if postings else None,
            **more,
        )

    def stats(self) -> DataFrame:
        if isinstance(self.vectors, VectorIndex):
            return self.vectors.rows().filter("list >= 0").agg(F.lit(self.embedder.name).alias("vector_name"), F.count(F.lit(1)).alias("points"))
        return retrieval.index_stats(self.vectors)


def build_corpus(sources: DataFrame, *, parser=parsing.parse_latex, config: chunking.ChunkConfig | None = None, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, vectors) of sources (paper_id, source): parse, drop excluded sections, chunk, embed. Failures stay as rows with an
    error; a document's status follows from its own row."""
    parsed = parsing.drop_excluded_sections(parsing.parse_documents(sources, parser))
    good = parsed.filter(F.col("error").isNull())
    chunks = chunking.mark_overlaps(chunking.chunk_documents(good.select("paper_id", "title", "abstract", "sections", F.lit(None).cast("array<struct<text_description:string>>").alias("equations")), config).filter(F.col("error").isNull()))
    embedder = embedder or HashEmbedder()
    vectors = embed_column(chunks.select("chunk_id", "content"), embedder, "content").select("chunk_id", F.lit(embedder.name).alias("vector_name"), "embedding")
    return parsed.withColumn("status", F.when(F.col("error").isNull(), "parsed").otherwise("failed")), chunks, vectors


def reprocess(old_chunks: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """Chunks of reprocessed papers replace all their old ones."""
    return upsert(old_chunks.join(new_chunks.select("paper_id").distinct(), "paper_id", "left_anti"), new_chunks, "chunk_id")


def collect(papers: DataFrame, keywords: DataFrame, labels: DataFrame, dry_run: bool = False) -> dict[str, DataFrame]:
    """The curation funnel: recall, rules, stored keywords on the edge cases, labels, union. A dry run stops after the rules."""
    from quarry.operators import curation as C

    found = C.recall(papers)
    labelled = found.withColumn("label", C.rule_label(C.paper_text()))
    clear, edge = labelled.filter("label = 'clear'").drop("label"), labelled.filter("label = 'edge'").drop("label")
    if dry_run:
        return {"recalled": found, "clear": clear, "edge": edge, "kept": clear}
    rejected, passed = C.keyword_matches(edge, keywords, C.paper_text())
    suitable, unsuitable = C.label_split(passed, labels)
    return {"recalled": found, "clear": clear, "edge": edge, "keyword_filtered": rejected, "unsuitable": unsuitable, "kept": clear.unionByName(suitable)}
