"""Exact vector search: cosine over unit vectors, top-k, guarded and hydrated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; null where either is null or lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def distance(a: Column, b: Column) -> Column:
    """One less the inner product; 1 where there is none."""
    return F.coalesce(1 - dot(a, b), F.lit(1.0))


def normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm > 0) & ~F.isnan(norm), F.transform(v, lambda x: x / norm)).otherwise(F.raise_error(F.lit("embedding_norm_invalid")).cast("array<double>"))


def top_k(vectors: DataFrame, query: list[float], k: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows of greatest similarity, ties by id: each task keeps k rows."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("similarity", dot(F.col(vector), q)).where("similarity IS NOT NULL")
    return scored.orderBy(F.desc(F.round("similarity", 6)), id_column).limit(k)


def semantic_search(vectors: DataFrame, ready: DataFrame, query: list[float], k: int, id_column: str = "vec_id") -> DataFrame:
    """Top-k first, then only those hits whose embedding is ready: fewer than k rows may be left, as hits that are not indexed count as such."""
    hits = top_k(vectors, query, k, id_column)
    return hits.join(ready.withColumn("indexed", F.lit(True)), id_column, "left").withColumn("indexed", F.coalesce("indexed", F.lit(False)))


def dimension_state(declared: Column, index: Column, vector: Column) -> Column:
    """The three-way check of an embedding's dimension."""
    return F.when(declared != index, "declared_index_mismatch").when(F.size(vector) != declared, "vector_dimension_mismatch").otherwise("ok")
