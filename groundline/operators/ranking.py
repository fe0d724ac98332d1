"""Rankers and rank fusion. A ranked list is a set of rows with the list's key columns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.functions.text import analysed_terms, issuer_key, keys_match
from groundline.session import cut_lineage

# Scores are rounded before they are ranked: summation order can then not decide a tie.
SCORE_DIGITS = 9
LIST_SIZE = 25
BM25_WIDTH = 4
RRF_K = 60
FUSED_SIZE = 30
# Query vectors held by every task on the map-side path.
QUERY_VECTOR_BYTES = 32 << 20
SHARD_ROWS = 20_000
QUERY_BLOCK_ROWS = 2_000


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per group. Spark keeps only ``k`` rows per group and task before it shuffles."""
    position = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(rank, position).where(F.col(rank) <= k)


def best_first(score: str = "score", *ties: str) -> list[Column]:
    return [F.col(score).desc(), *[F.col(t).asc() for t in ties]]


def rounded(c: Column) -> Column:
    return F.round(c, SCORE_DIGITS)


def query_term_weights(terms: DataFrame, vocabulary: DataFrame, by: list[str]) -> DataFrame:
    """Unit-length TF-IDF weights of query terms: (by, issuer_filter, term, weight).

    ``terms`` has one row per occurrence with its multiplicity ``qtf``; terms outside the
    vocabulary carry no weight.
    """
    counted = terms.groupBy(*by, "issuer_filter", "term").agg(F.sum("qtf").alias("tf"))
    known = counted.join(vocabulary.select("term", "idf"), "term")
    raw = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(raw * raw).over(Window.partitionBy(*by)))
    return known.select(*by, "issuer_filter", "term", (raw / norm).alias("query_weight"))


def score_terms(query_terms: DataFrame, postings: DataFrame, by: list[str]) -> DataFrame:
    """Sum of query weight times posting weight per list and chunk.

    Pass ``query_terms`` with a broadcast hint once its size is checked: postings then stay where
    they are and sums are complete within a task. Without the hint Spark joins by shuffle and
    splits frequent terms at run time.
    """
    matched = postings.join(query_terms, "term")
    return matched.groupBy(*by, "issuer_filter", "child_id", "issuer_key").agg(
        rounded(F.sum(F.col("query_weight") * F.col("weight"))).alias("score"))


# The term of the row that every chunk and field has for its length; no analysed term is empty.
LENGTH_ROW = ""


def content_fields(content: Column, indicator: Column | None = None) -> dict[str, Column]:
    """Terms of the searched fields: the analysed content and, as one exact term, the name of the indicator."""
    fields = {"content": analysed_terms(content)}
    if indicator is not None:
        fields["indicator"] = indicator_terms(indicator)
    return fields


def indicator_terms(indicator: Column) -> Column:
    return F.when(indicator.isNull(), F.array().cast("array<string>")).otherwise(F.array(indicator))


def field_counts(wanted: DataFrame, chunks: DataFrame, fields: dict[str, Column], hint=lambda df: df) -> DataFrame:
    """(field, child_id, issuer_key, dl, term, tf) of the ``wanted(term)`` terms, and a ``LENGTH_ROW`` of each chunk and field.

    Every chunk is cut into terms once: matching postings and lengths come out of the same pass, and are written, as
    they are read several times and much smaller than the texts.
    """
    found = F.array(*[F.struct(F.lit(name).alias("field"), terms.alias("terms")) for name, terms in fields.items()])
    # the outer forms keep the tokeniser from being copied into a filter
    rows = chunks.select("child_id", issuer_key(F.col("issuer")).alias("issuer_key"), F.explode_outer(found).alias("f"))
    tokens = rows.select(
        "f.field", "child_id", "issuer_key", F.size("f.terms").cast("long").alias("dl"),
        F.explode_outer(F.concat("f.terms", F.array(F.lit(LENGTH_ROW)))).alias("term"))
    lengths = chunks.sparkSession.createDataFrame([(LENGTH_ROW,)], "term string")
    matched = tokens.join(hint(wanted.select("term").distinct().unionByName(lengths)), "term")
    return cut_lineage(matched.groupBy("field", "child_id", "issuer_key", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))


def bm25_scores(query_terms: DataFrame, chunks: DataFrame, by: list[str], hint=lambda df: df, indicator: bool = False) -> DataFrame:
    """BM25 scores of chunks(child_id, issuer, content[, indicator]) for query_terms(by, issuer_filter, term, query_weight).

    The query's terms meet the tokens of each chunk before anything is shuffled, so only matching postings move;
    document frequencies are needed for the query's terms alone. With ``indicator`` the name of a chunk's indicator is a
    second field with its own frequencies, lengths and average; a term's shares of both fields add up. Where
    query_terms has a column ``required``, a chunk must hold all terms of the list that are marked by it, in any field.
    ``hint`` marks the tables of query terms for broadcast once the caller has checked their size; without it Spark
    joins by shuffle and splits frequent terms at run time.
    """
    from groundline.operators.index import BM25_B, BM25_K1

    fields = content_fields(F.col("content"), F.col("indicator") if indicator else None)
    counts = field_counts(query_terms, chunks, fields, hint)
    lengths = counts.where(F.col("term") == LENGTH_ROW).groupBy("field").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("dl").cast("double").alias("cf"))
    counts = counts.where(F.col("term") != LENGTH_ROW)
    df, n, tf = F.col("df"), F.col("n"), F.col("tf")
    # one row for each field
    totals = F.broadcast(lengths.select("field", "n", (F.col("cf") / n).alias("average")))
    known = counts.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")).join(totals, "field").select(
        "field", "term", F.log(1.0 + (n - df + 0.5) / (df + 0.5)).alias("idf"), "average")
    length = 1 - BM25_B + BM25_B * F.col("dl") / F.col("average")
    share = F.col("idf") * tf * (BM25_K1 + 1) / (tf + BM25_K1 * length)
    asked, more = query_terms, []
    if "required" in query_terms.columns:
        must = F.when(F.col("required"), F.col("term"))
        asked = query_terms.withColumn("needed", F.size(F.collect_set(must).over(Window.partitionBy(*by))))
        more = [(F.size(F.collect_set(must)) == F.max("needed")).alias("complete")]
    weighted = counts.join(hint(asked.join(hint(known), "term")), ["field", "term"])
    scored = weighted.groupBy(*by, "issuer_filter", "child_id", "issuer_key").agg(rounded(F.sum(F.col("query_weight") * share)).alias("score"), *more)
    return scored.where("complete").drop("complete") if more else scored


def tfidf_rank(scored: DataFrame, by: list[str], k: int = LIST_SIZE) -> DataFrame:
    """Issuer filter first, then positive cosines, then the best ``k``."""
    kept = scored.where(keys_match(F.col("issuer_key"), F.col("issuer_filter")) & (F.col("score") > 0))
    return top_k(kept, by, best_first("score", "child_id"), k)


def bm25_rank(scored: DataFrame, by: list[str], k: int = LIST_SIZE, width: int = BM25_WIDTH) -> DataFrame:
    """Best ``k`` x ``width`` first, then the issuer filter, then the best ``k`` of the survivors."""
    wide = top_k(scored, by, best_first("score", "child_id"), k * width, "wide_rank")
    kept = wide.where(keys_match(F.col("issuer_key"), F.col("issuer_filter")))
    return top_k(kept, by, [F.col("wide_rank")], k).drop("wide_rank")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for different lengths, empty arrays or a zero vector."""
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(usable & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


VECTOR_HIT = "query_id long, child_id string, score double"


class _BestVectors:
    """Running best ``k`` chunks per query vector over Arrow batches of one task."""

    def __init__(self, queries: pd.DataFrame, k: int):
        self.k = k
        self.ids = queries["query_id"].to_numpy()
        self.filters = [None if f is None or f != f else f for f in queries["issuer_filter"]]
        matrix = np.stack([np.asarray(v, dtype="float64") for v in queries["vec"]])
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        self.matrix = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
        self.best: list[pd.DataFrame | None] = [None] * len(self.ids)

    def add(self, batch: pd.DataFrame) -> None:
        if batch.empty:
            return
        rows = np.stack([np.asarray(v, dtype="float64") for v in batch["vec"]])
        norms = np.linalg.norm(rows, axis=1)
        sims = self.matrix @ rows.T
        sims = np.round(np.divide(sims, norms, out=np.zeros_like(sims), where=norms > 0), SCORE_DIGITS)
        ids = batch["child_id"].to_numpy()
        issuers = batch["issuer_key"]
        distinct = issuers.unique()
        for i, wanted in enumerate(self.filters):
            line = sims[i]
            if wanted:
                allowed = {d for d in distinct if wanted in d or d in wanted}
                line = np.where(issuers.isin(allowed), line, 0.0)
            positive = np.flatnonzero(line > 0)
            if len(positive) > self.k:
                floor = np.partition(line[positive], -self.k)[-self.k]
                positive = positive[line[positive] >= floor]
            found = pd.DataFrame({"child_id": ids[positive], "score": line[positive]})
            if self.best[i] is not None:
                found = pd.concat([self.best[i], found])
            self.best[i] = found.sort_values(["score", "child_id"], ascending=[False, True]).head(self.k)

    def result(self) -> pd.DataFrame:
        rows = [
            (q, child, score)
            for q, found in zip(self.ids, self.best) if found is not None
            for child, score in zip(found["child_id"], found["score"])
        ]
        return pd.DataFrame(rows, columns=["query_id", "child_id", "score"])


def vector_rank(queries: DataFrame, vectors: DataFrame, k: int = LIST_SIZE,
                max_query_bytes: int = QUERY_VECTOR_BYTES) -> DataFrame:
    """Exact cosine ranking: queries(query_id, issuer_filter, vec) x vectors(child_id, issuer_key, vec).

    Few queries travel to the vectors and every task keeps its own best ``k``. When the queries
    are too many for that, both sides are cut into bounded blocks that meet by an equi-join.
    Vectors of another length than the query never match, as in :func:`cosine`.
    """
    queries = queries.where(F.size("vec") > 0).select("query_id", "issuer_filter", "vec")
    vectors = vectors.select("child_id", "issuer_key", "vec")
    shape = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("dim"),
                        F.collect_set(F.size("vec")).alias("dims")).first()
    hits = None
    for dim in sorted(shape["dims"]):
        part = queries.where(F.size("vec") == dim)
        same = vectors.where(F.size("vec") == dim)
        if shape["n"] * shape["dim"] * 8 <= max_query_bytes:
            found = _rank_map_side(part, same, k)
        else:
            found = _rank_in_blocks(part, same, k)
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = queries.sparkSession.createDataFrame([], VECTOR_HIT)
    return top_k(hits, ["query_id"], best_first("score", "child_id"), k)


def _rank_map_side(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    local = queries.toPandas()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _BestVectors(local, k)
        for batch in batches:
            best.add(batch)
        yield best.result()

    return vectors.mapInPandas(scan, VECTOR_HIT)


def _rank_in_blocks(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    shards = max(1, math.ceil(vectors.count() / SHARD_ROWS))
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK_ROWS))
    left = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = vectors.withColumn("shard", F.pmod(F.xxhash64("child_id"), F.lit(shards)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or rows.empty:
            return pd.DataFrame(columns=["query_id", "child_id", "score"])
        best = _BestVectors(asked, k)
        best.add(rows)
        return best.result()

    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(meet, VECTOR_HIT)


def check_vectors(children: DataFrame, vectors: DataFrame) -> None:
    """Raise unless there is one vector per chunk and all have one length."""
    n = children.count()
    seen = vectors.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vec")).alias("low"),
                       F.max(F.size("vec")).alias("high")).first()
    if seen["n"] != n:
        raise ValueError(f"{seen['n']} vectors for {n} chunks")
    if seen["low"] != seen["high"]:
        raise ValueError("vectors of different lengths")
    missing = children.select("child_id").join(vectors.select("child_id"), "child_id", "left_anti")
    if not missing.isEmpty():
        raise ValueError("chunks without a vector")


def reciprocal_rank_fusion(ranked: DataFrame, by: list[str], k: int = RRF_K,
                           top_n: int = FUSED_SIZE) -> DataFrame:
    """Sum of 1 / (k + rank) over the lists of a group, best ``top_n`` per group."""
    fused = ranked.groupBy(*by, "child_id").agg(
        rounded(F.sum(1.0 / (F.lit(float(k)) + F.col("rank")))).alias("score"))
    return top_k(fused, by, best_first("score", "child_id"), top_n)


def max_normalized(fused: DataFrame, by: list[str], only: Column | None = None) -> DataFrame:
    """Scores divided by the best score of their group; rows outside ``only`` keep their score."""
    unit = F.col("score") / F.max("score").over(Window.partitionBy(*by))
    if only is not None:
        unit = F.when(only, unit).otherwise(F.col("score"))
    return fused.withColumn("score", unit)


def sum_over_subqueries(fused: DataFrame, by: list[str], top_n: int = FUSED_SIZE) -> DataFrame:
    """Add a chunk's scores over all sub-queries of a question, best ``top_n``."""
    total = fused.groupBy(*by, "child_id").agg(rounded(F.sum("score")).alias("score"))
    return top_k(total, by, best_first("score", "child_id"), top_n)
