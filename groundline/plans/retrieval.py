"""Hybrid retrieval: questions in, ranked pages out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundline.dictionaries import DEFAULT_DICTIONARY, Dictionary
from groundline.functions import text as T
from groundline.operators import decomposition as D
from groundline.operators import pages as P
from groundline.operators import ranking as R
from groundline.operators.index import TextIndex
from groundline.operators.scan import best_postings
from groundline.session import BROADCAST_ROWS, broadcast_if_small, cut_lineage, fits_broadcast, prune_scan

DEFAULT_K = 8
QUESTION = "query_id long, question string, issuer_filter string"


def one_question(spark, question: str, issuer_filter: str | None = None, vector=None) -> DataFrame:
    """A single question in the shape every batch has."""
    df = spark.createDataFrame([(0, question, issuer_filter)], QUESTION)
    if vector is not None:
        df = df.withColumn("vec", F.array(*[F.lit(float(v)) for v in vector]).cast("array<float>"))
    return df


def ranked_lists(questions: DataFrame, subs: DataFrame, index: TextIndex, vectors: DataFrame | None,
                 dictionary: Dictionary = DEFAULT_DICTIONARY) -> DataFrame:
    """(query_id, sid, vid, ranker, child_id, rank): one list per wording and text ranker, and one per
    sub-query for the question vector."""
    keys = D.LIST_KEYS
    wordings = D.variants(subs, dictionary)
    vocabulary = prune_scan(
        index.vocabulary, "term",
        D.search_words(wordings, dictionary).select(F.col("token").alias("term")))
    weighed = cut_lineage(D.weigh_rare_words(D.search_words(wordings, dictionary), vocabulary))

    def scored(terms: DataFrame, postings: DataFrame, k: int, filtered: bool) -> DataFrame:
        """Few terms travel to the postings, where every task keeps its best chunks; many meet them by shuffle."""
        found = prune_scan(postings, "term", terms)
        return best_postings(terms, found, keys, k, filtered) if fits_broadcast(terms) else R.score_terms(terms, found, keys)

    tfidf_terms = cut_lineage(R.query_term_weights(D.tfidf_terms(weighed), vocabulary, keys))
    bm25_terms = cut_lineage(D.bm25_terms(weighed, wordings))
    tfidf = R.tfidf_rank(scored(tfidf_terms, index.tfidf, R.LIST_SIZE, True), keys)
    bm25 = R.bm25_rank(scored(bm25_terms, index.bm25, R.LIST_SIZE * R.BM25_WIDTH, False), keys)
    columns = [*keys, "ranker", "child_id", "rank"]
    lists = tfidf.withColumn("ranker", F.lit("tfidf")).select(*columns).unionByName(
        bm25.withColumn("ranker", F.lit("bm25")).select(*columns))
    if vectors is not None and "vec" in questions.columns:
        # The question vector meets each distinct filter once; its rows carry a list number.
        asked = subs.select("query_id", "sid", "issuer_filter").join(
            questions.where("vec IS NOT NULL").select("query_id", "vec"), "query_id")
        asked = cut_lineage(asked.withColumn(
            "list_id", F.xxhash64("query_id", "sid")))
        hits = R.vector_rank(
            asked.select(F.col("list_id").alias("query_id"), "issuer_filter", "vec"), vectors)
        named = hits.withColumnRenamed("query_id", "list_id").join(
            asked.select("list_id", "query_id", "sid"), "list_id")
        lists = lists.unionByName(named.select(
            "query_id", "sid", F.lit(-1).alias("vid"), F.lit("vector").alias("ranker"), "child_id", "rank"))
    return lists


def retrieve(questions: DataFrame, parents: DataFrame, children: DataFrame, index: TextIndex,
             k: int = DEFAULT_K, vectors: DataFrame | None = None,
             dictionary: Dictionary = DEFAULT_DICTIONARY, strict: bool = False,
             places: DataFrame | None = None) -> DataFrame:
    """Best ``k`` pages per question.

    ``questions`` is (query_id, question, issuer_filter[, vec]); one question and a batch run the
    same plan. ``vectors`` is (child_id, issuer_key, vec). Lineage is cut where the data has become
    small (the ranked lists), which also gives an exact size for the joins that follow. ``places`` are the
    chunks without their texts, where a store keeps them apart (``sources.bucketed``).
    """
    subs = cut_lineage(D.subqueries(questions, index.titles, dictionary, strict))
    lists = cut_lineage(ranked_lists(questions, subs, index, vectors, dictionary))

    # Where the listed chunks live.
    listed = broadcast_if_small(cut_lineage(lists.select("child_id").distinct()))
    stored = children if places is None else places
    places = prune_scan(stored, "child_id", listed).join(listed, "child_id", "left_semi").select(
        "child_id", "parent_id", "document", "page", "issuer", "p_idx", "is_toc")
    located = cut_lineage(lists.join(places, "child_id"))

    # Page evidence for questions that name anchors.
    per_sub = subs.select("query_id", "sid", "multi", "must")
    anchors = subs.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("must"))).alias("anchors"))
    anchored = anchors.where(F.size("anchors") > 0)
    candidates = broadcast_if_small(cut_lineage(
        located.select("query_id", "document", "page").distinct().join(anchored, "query_id")))
    evidence = cut_lineage(P.page_evidence(
        candidates, prune_scan(children, "document", candidates)))

    survivors = (
        located.join(per_sub, ["query_id", "sid"])
        .join(evidence.select("query_id", "document", "page", "held"), ["query_id", "document", "page"], "left")
        .where(~F.col("multi") | (F.size("must") == 0) | (F.size(F.array_except("must", "held")) == 0))
    )
    renumbered = survivors.withColumn("rank", F.row_number().over(
        Window.partitionBy("query_id", "sid", "vid", "ranker").orderBy("rank")))

    per_subquery = R.reciprocal_rank_fusion(renumbered, ["query_id", "sid", "multi"])
    fused = R.sum_over_subqueries(
        R.max_normalized(per_subquery, ["query_id", "sid"], F.col("multi")), ["query_id"])

    chunk_places = located.select(
        "query_id", "child_id", "parent_id", "document", "page", "issuer", "p_idx", "is_toc").distinct()
    parent_hits = P.boost_evidence(
        P.parent_scores(fused.join(chunk_places, ["query_id", "child_id"])), evidence)
    parent_hits = cut_lineage(parent_hits)
    wanted = P.wanted_pages(P.page_scores(parent_hits))
    if fits_broadcast(parent_hits, BROADCAST_ROWS // P.PAGES_PER_HIT):
        wanted = F.broadcast(wanted)
    expanded = P.expand_pages(wanted, prune_scan(parents, "document", parent_hits))
    return P.rehydrate(expanded, parent_hits, questions, k, dictionary, strict)
