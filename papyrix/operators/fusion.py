"""Reciprocal rank fusion of the two retrievers, and the roll-up from passages to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import Scratch
from . import lexical, vector

#: Rank constant, depth of either retriever, documents returned.
K, DEPTH, HITS = 60, 200, 10
_MODES = {"": "hybrid", "hybrid": "hybrid", "lexical": "lexical", "bm25": "lexical", "keyword": "lexical", "vector": "vector", "semantic": "vector", "embedding": "vector"}


def parse_mode(name: str) -> str:
    if name.lower() not in _MODES:
        raise ValueError(f"unknown mode {name!r}: hybrid, lexical or vector")
    return _MODES[name.lower()]


def fuse(lex: DataFrame | None, vec: DataFrame | None, *by: str) -> DataFrame:
    """Hits of either retriever (at most its depth) with the sum of 1 / (K + rank); absent ranks are 0. ``by``: the columns that tell
    queries apart."""
    key = [*by, *lexical.ORDER]
    if lex is None or vec is None:
        only, name, other = (vec, "vector_rank", "lexical_rank") if lex is None else (lex, "lexical_rank", "vector_rank")
        return only.select(*key, (1.0 / (K + F.col("rank"))).alias("score"), F.col("rank").alias(name), F.lit(0).alias(other)).select(*key, "score", "lexical_rank", "vector_rank")
    both = lex.select(*key, F.col("rank").alias("l")).join(vec.select(*key, F.col("rank").alias("v")), key, "full_outer")
    part = lambda c: F.coalesce(1.0 / (K + F.col(c)), F.lit(0.0))
    return both.select(*key, (part("l") + part("v")).alias("score"), F.coalesce("l", F.lit(0)).alias("lexical_rank"), F.coalesce("v", F.lit(0)).alias("vector_rank"))


def roll_up(fused: DataFrame, hits: int = HITS) -> DataFrame:
    """Each document's best passage, the best ``hits`` documents, with their place."""
    order = [F.col("score").desc(), *lexical.ORDER]
    best = fused.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).filter("__n = 1").drop("__n")
    return best.orderBy(*order).limit(hits if hits > 0 else HITS).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def roll_up_each(fused: DataFrame, hits: int = HITS) -> DataFrame:
    """``roll_up`` of each query_id."""
    order = [F.col("score").desc(), *lexical.ORDER]
    best = fused.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(*order))).filter("__n = 1").drop("__n")
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("place") <= (hits if hits > 0 else HITS))


def search(index: lexical.Index | None, sizes: tuple[int, int], vectors: DataFrame | None, query: str, query_vector: list[float] | None, mode: str = "hybrid", hits: int = HITS, depth: int = DEPTH, source: str | None = None) -> DataFrame:
    """Search a stored ``index`` and ``vectors`` (source, doc_id, index, embedding); with ``source`` both are of that source
    alone, and ``sizes`` (passages and their tokens) must be too."""
    mode, depth = parse_mode(mode), depth if depth > 0 else DEPTH
    if not query.strip():
        raise ValueError("an empty query")
    if source is not None:
        index = None if index is None else index.of(source)
        vectors = None if vectors is None else vectors.filter(F.col("source") == source)
    lex = lexical.bm25(index, sizes, query, depth) if mode != "vector" and index is not None else None
    vec = vector.cosine_top(vectors, query_vector, depth) if mode != "lexical" and vectors is not None and query_vector else None
    if lex is None and vec is None:
        raise ValueError("this mode needs vectors and a query vector")
    return roll_up(fuse(lex, vec), hits)


def search_many(index: lexical.Index | None, sizes: tuple[int, int], vectors: DataFrame | None, queries: DataFrame, scratch: Scratch, mode: str = "hybrid", hits: int = HITS, depth: int = DEPTH) -> DataFrame:
    """``search`` for each of ``queries`` (query_id, text, embedding; ids unique), a table of any size: query_id, source, doc_id, index,
    score, both ranks and place. A query without text or without a vector has what the other retriever finds."""
    mode, depth = parse_mode(mode), depth if depth > 0 else DEPTH
    lex = lexical.bm25_many(index, sizes, queries.select("query_id", "text"), depth, scratch) if mode != "vector" and index is not None else None
    vec = vector.cosine_many(vectors, queries.select("query_id", "embedding"), depth) if mode != "lexical" and vectors is not None else None
    if lex is None and vec is None:
        raise ValueError("this mode needs vectors and a query vector")
    return roll_up_each(fuse(lex, vec, "query_id"), hits)
