"""Retrieval chunks from documents: a packing automaton over sized units.

One automaton packs paragraphs and sentences alike: it holds the units of an open chunk, closes the chunk when the next unit would go
over the budget, and seeds the next one with an overlap. The two levels differ in what they do with a unit that is too large alone, in the
overlap, and in the joiner. A document passes through it in one Arrow batch row, so documents run in parallel and none is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import words
from quarry.plans.plugins import Tokenizer, WordTokenizer

_END = re.compile(r"(?<=[.!?])\s+")


@dataclass(frozen=True)
class ChunkConfig:
    max_tokens: int = 512
    overlap_tokens: int = 50
    min_tokens: int = 100
    min_equation_tokens: int = 10
    context_tokens: int = 100
    with_context: bool = False
    with_abstract: bool = True
    with_equations: bool = True
    tokenizer: Tokenizer = field(default_factory=WordTokenizer)


@dataclass
class Unit:
    text: str
    size: int
    owner: str | None = None


def pack(units: list[Unit], budget: int, minimum: int, overlap: Callable[[list[Unit]], list[Unit]], oversize: Callable[[Unit], Iterator[list[Unit]]]) -> Iterator[list[Unit]]:
    """Runs of units within the budget. Sizes add up without joiners. A run that ends the input is dropped under the minimum; one that holds an
    overlap alone is never emitted; after an oversize unit the next run starts without overlap."""
    held: list[Unit] = []
    size = fresh = 0  # of `held`; its units that aren't overlap

    for u in units:
        if u.size > budget:
            if fresh:
                yield held
            held, size, fresh = [], 0, 0
            yield from oversize(u)
            continue
        if size + u.size > budget and fresh:
            yield held
            held, fresh = list(overlap(held)), 0
            size = sum(x.size for x in held)
        held.append(u)
        size += u.size
        fresh += 1
    if fresh and size >= minimum:
        yield held


class Chunker:
    """Chunks of one document: abstract, sections (whole, by paragraphs, by sentences, cut), described equations."""

    def __init__(self, config: ChunkConfig):
        self.c, self.t = config, config.tokenizer

    def _unit(self, text: str, owner: str | None = None) -> Unit:
        return Unit(text, self.t.count(text), owner)

    def _tail(self, held: list[Unit]) -> list[Unit]:
        """The last tokens of the last paragraph."""
        if not self.c.overlap_tokens or not held:
            return []
        tail = self.t.tail(held[-1].text, self.c.overlap_tokens)
        return [self._unit(tail)] if tail else []

    def _last_sentences(self, held: list[Unit]) -> list[Unit]:
        out, size = [], 0
        for u in reversed(held):
            if size + u.size > self.c.overlap_tokens:
                break
            out.insert(0, u)
            size += u.size
        return out

    def context(self, title: str, abstract: str) -> str:
        """Title and topic lines that stand before every chunk."""
        if not self.c.with_context:
            return ""
        lines = [f"Paper: {title}"] if title else []
        if abstract:
            room = self.c.context_tokens - 20
            if self.t.count(abstract) > room:
                topic = self.t.head(abstract, room).rsplit(" ", 1)[0] + "..."
            else:
                topic = ". ".join(abstract.split(". ")[:2])
                topic += "" if topic.endswith(".") else "."
            lines.append(f"Topic: {topic}")
        return "\n".join(lines) + "\n\n" if lines else ""

    def _sentences(self, paragraph: Unit, budget: int) -> Iterator[str]:
        units = [self._unit(s.strip()) for s in _END.split(paragraph.text) if s.strip()]
        runs = pack(units, budget, self.c.min_tokens, self._last_sentences, lambda u: iter([[self._unit(self.t.head(u.text, budget))]]))
        return (" ".join(u.text for u in run) for run in runs)

    def section(self, paragraphs: list[tuple[str, str]], prefix: str) -> Iterator[tuple[str, list[str]]]:
        """(content, paragraph ids) of a section given as (id, text)."""
        budget = self.c.max_tokens - (self.t.count(prefix) if prefix else 0)
        whole = "\n\n".join(t for _, t in paragraphs)
        size = self.t.count(whole)
        if size <= budget:
            if size >= self.c.min_tokens:
                yield prefix + whole, [i for i, _ in paragraphs]
            return
        split: dict[int, str] = {}

        def large(u: Unit) -> Iterator[list[Unit]]:
            for s in self._sentences(u, budget):
                piece = Unit(s, 0, u.owner)
                split[id(piece)] = s
                yield [piece]

        for run in pack([self._unit(t, i) for i, t in paragraphs], budget, self.c.min_tokens, self._tail, large):
            yield prefix + "\n\n".join(u.text for u in run), [u.owner for u in run if u.owner is not None]

    def chunks(self, doc: dict) -> Iterator[dict]:
        """doc: paper_id, title, abstract, sections (section_id, title, paragraphs of (paragraph_id, content)), equations."""
        prefix = self.context(doc.get("title") or "", doc.get("abstract") or "")
        rows: list[tuple] = []
        abstract = (doc.get("abstract") or "").strip()
        if self.c.with_abstract and abstract and self.t.count(abstract) >= self.c.min_tokens:
            rows.append(("abstract", None, "Abstract", abstract, []))
        for s in doc.get("sections") or []:
            paragraphs = [(p["paragraph_id"], p["content"]) for p in s["paragraphs"] or []]
            if paragraphs:
                rows += [("text", s["section_id"], s["title"], content, ids) for content, ids in self.section(paragraphs, prefix)]
        for e in (doc.get("equations") or []) if self.c.with_equations else []:
            said = (e.get("text_description") or "").strip()
            if said:
                parts = [f"Context: {e['context_before'].strip()}"] if e.get("context_before") else []
                parts += [said] + ([f"Following context: {e['context_after'].strip()}"] if e.get("context_after") else [])
                content = prefix + "\n\n".join(parts)
                if self.t.count(content) >= self.c.min_equation_tokens:
                    rows.append(("equation", e.get("section_id"), "Equation", content, []))
        for i, (kind, section_id, title, content, ids) in enumerate(rows):
            yield {"chunk_id": f"{doc['paper_id']}_chunk_{i}", "paper_id": doc["paper_id"], "content": content, "section_id": section_id, "section_title": title, "paragraph_ids": ids, "chunk_type": kind, "chunk_index": i, "token_count": self.t.count(content), "char_count": len(content)}


CHUNK_SCHEMA = "chunk_id string, paper_id string, content string, section_id string, section_title string, paragraph_ids array<string>, chunk_type string, chunk_index int, token_count int, char_count int, error string"


_ARROW = pa.schema([(n, pa.int32() if t == "int" else pa.list_(pa.string()) if t == "array<string>" else pa.string()) for n, t in (f.split() for f in CHUNK_SCHEMA.split(", "))])
_DOCUMENTS = 32  # documents that are Python values at once


def chunk_documents(docs: DataFrame, config: ChunkConfig | None = None) -> DataFrame:
    """Chunks of every document; one that fails gives a row with its error instead of ending the job. A task holds a few documents and their chunks beside an Arrow batch."""
    config = config or ChunkConfig()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = Chunker(config)
        for batch in batches:
            for a in range(0, batch.num_rows, _DOCUMENTS):
                out = []
                for doc in batch.slice(a, _DOCUMENTS).to_pylist():
                    try:
                        rows = [c | {"error": None} for c in chunker.chunks(doc)]
                    except Exception as e:  # a broken document is reported, not dropped
                        rows = [dict.fromkeys(_ARROW.names) | {"paper_id": doc["paper_id"], "error": f"{type(e).__name__}: {e}"}]
                    out += [r | {"paper_id": None if r["paper_id"] is None else str(r["paper_id"])} for r in rows]
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return docs.mapInArrow(run, CHUNK_SCHEMA)


def mark_overlaps(chunks: DataFrame, overlap_tokens: int = 50, paper: str = "paper_id", index: str = "chunk_index", content: str = "content") -> DataFrame:
    """Adds has_overlap_before, has_overlap_after, overlap_tokens: more than five words in common between the last 200 characters of one chunk and
    the first 200 of the next one of the paper."""
    w = Window.partitionBy(paper).orderBy(index)

    def ends(c: Column) -> Column:
        return F.array_distinct(words(F.when(F.length(c) > 200, F.right(c, F.lit(200))).otherwise(c)))

    def starts(c: Column) -> Column:
        return F.array_distinct(words(F.substring(c, 1, 200)))

    c, prev, after = F.col(content), F.lag(content).over(w), F.lead(content).over(w)
    before = F.coalesce(F.size(F.array_intersect(ends(prev), starts(c))) > 5, F.lit(False)) & F.lit(overlap_tokens > 0) & prev.isNotNull()
    later = F.coalesce(F.size(F.array_intersect(ends(c), starts(after))) > 5, F.lit(False)) & F.lit(overlap_tokens > 0) & after.isNotNull()
    return chunks.withColumns({"has_overlap_before": before, "has_overlap_after": later, "overlap_tokens": F.when(before, overlap_tokens).otherwise(0)})


def chunk_stats(chunks: DataFrame) -> DataFrame:
    t = F.col("token_count")
    return chunks.agg(
        F.countDistinct("paper_id").alias("total_papers"), F.count("chunk_id").alias("total_chunks"), F.sum(t).alias("total_tokens"), F.min(t).alias("min_tokens"), F.max(t).alias("max_tokens"), F.avg(t).alias("avg_tokens"),
        *[F.count_if(F.col("chunk_type") == k).alias(f"{k}_chunks") for k in ("text", "abstract", "equation")],
    )
