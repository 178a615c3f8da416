"""What a user can plug in, and deterministic built-ins that need no model or network."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Tokenizer(Protocol):
    def count(self, text: str) -> int: ...
    def head(self, text: str, n: int) -> str: ...
    def tail(self, text: str, n: int) -> str: ...


class WordTokenizer:
    """Tokens are runs without white space."""

    _token = re.compile(r"\S+")

    def count(self, text: str) -> int:
        return sum(1 for _ in self._token.finditer(text or ""))

    def head(self, text: str, n: int) -> str:
        found = [m.span() for m in self._token.finditer(text)]
        return text if len(found) <= n else text[: found[n - 1][1]] if n > 0 else ""

    def tail(self, text: str, n: int) -> str:
        found = [m.span() for m in self._token.finditer(text)]
        return text if len(found) <= n else text[found[-n][0] :] if n > 0 else ""


class BpeTokenizer:
    """Tokens of a public vocabulary: `path` is a file of the tokenizers library that executors can read too. Each worker loads it once. Heads and tails end between
    characters and never have more than n tokens of their own; no special tokens are added, and none are looked for in n <= 0 tokens.

    Byte-level vocabularies match white space at the start of a match alone, letters apart from punctuation, and look ahead past white space alone. So no token crosses a
    place between a visible character and a space or line feed, or between a letter and punctuation other than an apostrophe: a text's tokens are those of the stretches
    between such places. Counts of short stretches are held (_KEEP at most, about 150 bytes each), and heads and tails encode the stretches at the text's end alone. Other
    vocabularies, and texts with the string of an added token, are encoded whole."""

    _KEEP, _LONG = 300_000, 40
    _place = re.compile("(?<=[!-~À-ÖØ-öø-ž])(?=[ \n])|(?<=[A-Za-zÀ-ÖØ-öø-ž])(?=[,.;:!?])")

    def __init__(self, path: str):
        self.path, self._model = path, None

    def __getstate__(self) -> dict:
        return {"path": self.path, "_model": None}

    @property
    def model(self):
        if self._model is None:
            from tokenizers import Tokenizer as Model

            self._model = Model.from_file(self.path)
            made = json.loads(self._model.to_str())
            before = made["pre_tokenizer"] or {}
            plain = not any(made[x] for x in ("normalizer", "truncation", "padding")) and made["model"]["type"] == "BPE" and not made["model"].get("dropout")
            self._cut = plain and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
            self._added = [x["content"] for x in made["added_tokens"]]
            self._counts: dict[str, int] = {}
        return self._model

    def _cuts(self, text: str) -> bool:
        """Whether the text's stretches can be encoded one by one."""
        return bool(self.model and self._cut) and not any(x in text for x in self._added)

    def _size(self, text: str) -> int:
        return len(self.model.encode(text, add_special_tokens=False))

    def _sum(self, parts: list[str]) -> int:
        """Tokens of a text's stretches, in its order. What isn't held is encoded; once no more is held, as one text, which has the same places."""
        sizes = list(map(self._counts.get, parts))
        lost = [p for p, n in zip(parts, sizes, strict=True) if n is None]
        have = sum(filter(None, sizes))
        if lost and len(self._counts) < self._KEEP:
            for p in lost:
                n = self._counts.get(p) or self._size(p)
                have += n
                if len(p) <= self._LONG:
                    self._counts[p] = n
        elif lost:
            # One that starts with punctuation would run into another one's end.
            own = [p for p in lost if p[0] in ",.;:!?"]
            have += self._size("".join(p for p in lost if p[0] not in ",.;:!?")) + sum(map(self._size, own))
        return have

    def _spans(self, text: str) -> list[tuple[int, int]]:
        return self.model.encode(text or "", add_special_tokens=False).offsets

    def _first(self, text: str, n: int) -> list[tuple[int, int]]:
        """Spans of the first tokens, more than n where the text has more."""
        if not self._cuts(text):
            return self._spans(text)
        start = have = 0
        for m in self._place.finditer(text):
            have += self._sum([text[start : m.start()]])
            start = m.start()
            if have > n:
                return self._spans(text[:start])
        return self._spans(text)

    def _last(self, text: str, n: int) -> list[tuple[int, int]]:
        """Spans of the last tokens, more than n where the text has more."""
        reach = 4 * max(n, 1) + 32
        while reach < len(text) and self._cuts(text):
            m = self._place.search(text, len(text) - reach)
            found = self._spans(text[m.start() :]) if m else []
            if len(found) > n:
                return [(a + m.start(), b + m.start()) for a, b in found]
            reach *= 2
        return self._spans(text)

    def count(self, text: str) -> int:
        return self._sum(self._place.split(text)) if text and self._cuts(text) else self._size(text or "")

    def head(self, text: str, n: int) -> str:
        found = self._first(text, n)
        if len(found) <= n:
            return text
        for m in range(n, 0, -1):  # a shorter head where the end changes how the text is cut into tokens
            part = text[: min(found[m - 1][1], found[m][0])]
            if self.count(part) <= n:
                return part
        return ""

    def tail(self, text: str, n: int) -> str:
        found = self._last(text, n)
        if len(found) <= n:
            return text
        for m in range(n, 0, -1):
            part = text[max(found[-m][0], found[-m - 1][1]) :]
            if self.count(part) <= n:
                return part
        return ""


class Embedder(Protocol):
    name: str
    dims: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Signed hashed words, scaled to length 1: the same vector on every machine."""

    def __init__(self, dims: int = 64, name: str = "hash"):
        self.dims, self.name = dims, name

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % self.dims] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


class Scorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class LexicalScorer:
    """Share of the query's distinct words that the text holds."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for query, text in pairs:
            q = set((query or "").lower().split())
            out.append(len(q & set((text or "").lower().split())) / len(q) if q else 0.0)
        return out


class Expander(Protocol):
    def expand(self, query: str) -> str: ...


class IdentityExpander:
    def expand(self, query: str) -> str:
        return query


class CleaningExpander:
    """Another expander's text as one line: without a label such as `Abstract:` and without quotes around it. An empty one gives the query back."""

    _label = re.compile(r"(?i)^(?:abstract|passage|answer|hypothetical abstract)\s*:\s*")
    _quotes = re.compile(r"^[\"']+|[\"']+$")

    def __init__(self, inner: Expander):
        self.inner = inner

    def expand(self, query: str) -> str:
        text = self._quotes.sub("", self._label.sub("", (self.inner.expand(query) or "").strip())).strip()
        return text or query


def token_columns(df: DataFrame, tokenizer: Tokenizer, text: str, n: int) -> DataFrame:
    """Adds n_tokens of the whole text, and its head and tail of at most n tokens. A null text has no tokens, and null ends."""

    @F.pandas_udf("n_tokens int, head string, tail string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame(
                [(0, None, None) if t is None else (tokenizer.count(t), tokenizer.head(t, n), tokenizer.tail(t, n)) for t in texts],
                columns=["n_tokens", "head", "tail"],
            )

    return df.withColumn("_tokens", run(F.col(text))).select(*df.columns, "_tokens.*")


def embed_column(df: DataFrame, embedder: Embedder, text: str, out: str = "embedding", batch: int = 32) -> DataFrame:
    """Adds a vector column; a batch that fails gets null vectors, and its rows stay."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            vectors: list = []
            for a in range(0, len(texts), batch):
                own = texts.iloc[a : a + batch].fillna("").tolist()
                try:
                    vectors += [v.tolist() for v in embedder.embed(own)]
                except Exception:
                    vectors += [None] * len(own)
            yield pd.Series(vectors, dtype=object)

    return df.withColumn(out, run(F.col(text)))


def score_column(df: DataFrame, scorer: Scorer, query: str, text: str, out: str = "rerank_score") -> DataFrame:
    """Adds a score for each pair; a batch that fails scores 0."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in parts:
            try:
                yield pd.Series(scorer.score(list(zip(q.fillna(""), t.fillna(""), strict=True))), dtype=float)
            except Exception:
                yield pd.Series(0.0, index=range(len(q)))

    return df.withColumn(out, run(F.col(query), F.col(text)))


def expand_cached(df: DataFrame, expander: Expander, cache: DataFrame | None = None, *, query: str = "query", kind: str = "query_type", only: str = "conceptual", out: str = "expanded") -> tuple[DataFrame, DataFrame]:
    """(df with the expanded query, cache with the new entries). The cache is a table (cache_key, expanded), its keys are `type:query`; what it
    has is not expanded again. Only queries of the type `only` are expanded."""
    key = F.concat_ws(":", F.col(kind), F.col(query))
    wanted = df.filter(F.col(kind) == only).select(key.alias("cache_key"), F.col(query).alias("asked")).distinct()
    known = wanted.sparkSession.createDataFrame([], "cache_key string, expanded string") if cache is None else cache.select("cache_key", "expanded")
    fresh = expand_column(wanted.join(known, "cache_key", "left_anti"), expander, "asked", out="expanded").select("cache_key", "expanded")
    full = known.unionByName(fresh)
    named = df.withColumn("cache_key", key).join(full.withColumnRenamed("expanded", "_e"), "cache_key", "left")
    return named.withColumn(out, F.coalesce("_e", F.col(query))).drop("_e", "cache_key"), full


def expand_column(df: DataFrame, expander: Expander, query: str = "query", when=None, out: str = "expanded") -> DataFrame:
    """Adds the expanded query where the condition holds, else the query. Each distinct query is expanded once; a failure leaves it as it is."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(q):
            try:
                return expander.expand(q) or q
            except Exception:
                return q

        for q in parts:
            yield q.map(one)

    condition = F.lit(True) if when is None else when
    distinct = df.filter(condition).select(F.col(query).alias("_q")).distinct().withColumn("_e", run("_q"))
    return df.join(distinct, F.col(query) == F.col("_q"), "left").withColumn(out, F.coalesce(F.when(condition, F.col("_e")), F.col(query))).drop("_q", "_e")
