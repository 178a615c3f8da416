"""Vector expressions: cosine, dot products, late interaction, sparse vectors. All in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; arrays of unequal length give null."""
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for unequal lengths, for a zero vector and for null."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size), F.lit(0.0))


def maxsim(query_tokens: Column, doc_tokens: Column) -> Column:
    """Sum over query tokens of the best cosine with a document token; a token whose best is not positive adds 0."""
    best = F.transform(query_tokens, lambda q: F.coalesce(F.array_max(F.transform(doc_tokens, lambda d: cosine(q, d))), F.lit(0.0)))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + F.greatest(x, F.lit(0.0)))


def literal_vector(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def sparse_top(weights: Column, k: int = 128) -> Column:
    """The k greatest weights of a map, as an array of (token, weight) by weight descending, then token."""
    pairs = F.transform(F.map_entries(weights), lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("t")))
    best = F.slice(F.array_sort(pairs), 1, k)
    return F.transform(best, lambda p: F.struct(p["t"].alias("token"), (-p["w"]).alias("weight")))


def sparse_to_map(pairs: Column) -> Column:
    return F.map_from_entries(pairs)


def sparse_from_arrays(indices: Column, values: Column) -> Column:
    return F.map_from_arrays(indices, values)


def sparse_to_json(weights: Column) -> Column:
    return F.to_json(weights)


def sparse_from_json(text: Column) -> Column:
    return F.from_json(text, "map<string,double>")


def sparse_nnz(weights: Column) -> Column:
    """Entries of a sparse map; none for null."""
    return F.when(weights.isNull(), 0).otherwise(F.size(weights))


def shorten(vector: Column, dims: int) -> Column:
    """The first `dims` entries, scaled to length 1 again (unchanged if they are all 0)."""
    head = F.slice(_doubles(vector), 1, dims)
    size = norm(head)
    return F.when(size > 0, F.transform(head, lambda x: x / size)).otherwise(head)
