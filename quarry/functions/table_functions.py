"""Chunking and splitting from SQL: table functions that take a table, batch by batch, and give rows.

    register(spark)
    SELECT * FROM chunk(TABLE(parsed_documents))
    SELECT * FROM chunk_rows(TABLE(paragraphs) PARTITION BY paper_id ORDER BY place)
    SELECT * FROM split_sentences(TABLE(texts))
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from quarry.operators.chunking import CHUNK_SCHEMA, ChunkConfig, Chunker, Unit, pack

_END = re.compile(r"(?<=[.!?])\s+")
_NAMES = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]
_ARROW = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
_CHUNKS = pa.schema([(n, _ARROW[f.split()[1]]) for n, f in zip(_NAMES, CHUNK_SCHEMA.split(", "), strict=True)])
_ROWS = pa.schema([("paper_id", pa.string()), ("chunk_index", pa.int32()), ("n_paragraphs", pa.int32()), ("token_count", pa.int32()), ("content", pa.string())])
_SENTENCES = pa.schema([("key", pa.string()), ("place", pa.int32()), ("sentence", pa.string())])


def register(spark: SparkSession, config: ChunkConfig | None = None) -> None:
    """Makes chunk, chunk_rows and split_sentences known to the session, with one configuration for both chunkers."""
    config = config or ChunkConfig()

    @arrow_udtf(returnType=CHUNK_SCHEMA)
    class Chunks:
        """Documents (paper_id, title, abstract, sections, equations) as chunk_documents() takes them; a failing one gives a row with its error."""

        def eval(self, docs: pa.RecordBatch) -> Iterator[pa.Table]:
            chunker, out = Chunker(config), []
            for doc in docs.to_pylist():
                try:
                    out += [c | {"error": None} for c in chunker.chunks(doc)]
                except Exception as e:
                    out.append(dict.fromkeys(_NAMES) | {"paper_id": doc.get("paper_id"), "error": f"{type(e).__name__}: {e}"})
            yield pa.Table.from_pylist(out, _CHUNKS)

    @arrow_udtf(returnType="paper_id string, chunk_index int, n_paragraphs int, token_count int, content string")
    class ChunkRows:
        """Paragraphs (paper_id, content, ...) of one partition in their order, packed as a section's are; blank ones are skipped. A partition is one paper's rows."""

        def __init__(self):
            self.paper, self.units = None, []

        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            names = rows.schema.names
            for paper, content in zip(rows.column(names.index("paper_id")).to_pylist(), rows.column(names.index("content")).to_pylist(), strict=True):
                self.paper = paper
                if content and content.strip():
                    self.units.append(Unit(content, config.tokenizer.count(content)))
            return iter(())

        def terminate(self) -> Iterator[pa.Table]:
            chunker = Chunker(config)
            runs = pack(self.units, config.max_tokens, config.min_tokens, chunker._tail, lambda u: ([chunker._unit(s)] for s in chunker._sentences(u, config.max_tokens)))
            out = [(self.paper, i, len(run), sum(u.size for u in run), "\n\n".join(u.text for u in run)) for i, run in enumerate(runs)]
            yield pa.Table.from_pylist([dict(zip(_ROWS.names, r, strict=True)) for r in out], _ROWS)

    @arrow_udtf(returnType="key string, place int, sentence string")
    class Sentences:
        """Texts (key, text): a row for each sentence, from 1."""

        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            names, out = rows.schema.names, []
            for key, text in zip(rows.column(names.index("key")).to_pylist(), rows.column(names.index("text")).to_pylist(), strict=True):
                found = [s.strip() for s in _END.split(text or "") if s.strip()]
                out += [{"key": None if key is None else str(key), "place": i, "sentence": s} for i, s in enumerate(found, 1)]
            yield pa.Table.from_pylist(out, _SENTENCES)

    for name, f in (("chunk", Chunks), ("chunk_rows", ChunkRows), ("split_sentences", Sentences)):
        spark.udtf.register(name, f)
