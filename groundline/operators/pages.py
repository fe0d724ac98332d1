"""From ranked chunks to ranked pages: parents, siblings, neighbours and rehydration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundline.dictionaries import DEFAULT_DICTIONARY, Dictionary
from groundline.functions import text as T
from groundline.operators.ranking import top_k

# ---- Fixed values: score rules ----
CONTENTS_PENALTY = 0.1
EVIDENCE_BOOST = 1.3
NEIGHBOUR_PAGES = 3
NEIGHBOURS_PER_ISSUER = 2
NEIGHBOUR_DECAY = 0.1
MONEY_EVIDENCE = r"(?U)billion|million|millones|millon|mil\b|us\$|s/|\d{4,}"

PAGE = ["document", "page"]
BEST, REST, NEAR = 0, 1, 2


def page_evidence(pages: DataFrame, children: DataFrame) -> DataFrame:
    """(query_id, document, page, anchors, money): which anchors a page holds and whether it speaks of money.

    ``pages`` is (query_id, document, page, anchors). An anchor has no white space, so it lies on a
    page exactly when it lies in one of the page's chunks; no page text is put together.
    """
    texts = children.select(*PAGE, T.normalize(F.col("content")).alias("folded"))
    hits = pages.join(texts, PAGE).select(
        "query_id", *PAGE,
        F.filter("anchors", lambda a: F.contains(F.col("folded"), a)).alias("held"),
        F.col("folded").rlike(MONEY_EVIDENCE).alias("money"),
    )
    money = hits.groupBy("query_id", *PAGE).agg(F.max("money").alias("money"))
    held = hits.select("query_id", *PAGE, F.explode("held").alias("anchor")).groupBy("query_id", *PAGE).agg(
        F.collect_set("anchor").alias("held"))
    return money.join(held, ["query_id", *PAGE], "left").withColumn(
        "held", F.coalesce("held", F.array().cast("array<string>")))


def parent_scores(fused: DataFrame) -> DataFrame:
    """Best chunk score per parent (never the sum) and its matched chunks, best first.

    ``fused`` holds (query_id, child_id, score, rank, parent_id, document, page, issuer, p_idx, is_toc).
    """
    score = F.when(F.col("is_toc"), F.col("score") * CONTENTS_PENALTY).otherwise(F.col("score"))
    return fused.groupBy("query_id", "parent_id", *PAGE, "issuer", "p_idx").agg(
        F.max(score).alias("score"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "child_id"))), lambda s: s["child_id"])
        .alias("matched"),
    )


def boost_evidence(parents: DataFrame, evidence: DataFrame) -> DataFrame:
    """Raise parents on pages that hold any anchor and speak of money."""
    proof = evidence.where((F.size("held") > 0) & F.col("money")).select("query_id", *PAGE, F.lit(True).alias("proof"))
    return parents.join(proof, ["query_id", *PAGE], "left").withColumn(
        "score", F.when(F.col("proof"), F.col("score") * EVIDENCE_BOOST).otherwise(F.col("score"))
    ).drop("proof")


def page_scores(parents: DataFrame) -> DataFrame:
    """(query_id, document, page, issuer, score): every parent of a page shares its best score."""
    return parents.groupBy("query_id", *PAGE, "issuer").agg(F.max("score").alias("score"))


def best_pages(pages: DataFrame) -> DataFrame:
    """Best page of every issuer in a question's result."""
    order = [F.col("score").desc(), F.col("document"), F.col("page")]
    return top_k(pages, ["query_id", "issuer"], order, 1).drop("rank")


def neighbour_pages(best: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages up to three away from an issuer's best page and not in the result yet.

    The band becomes six equi-join keys per best page.
    """
    steps = F.array(*[F.lit(d) for d in range(-NEIGHBOUR_PAGES, NEIGHBOUR_PAGES + 1) if d])
    near = best.withColumn("step", F.explode(steps)).select(
        "query_id", "document", (F.col("page") + F.col("step")).alias("page"), "issuer",
        F.abs("step").alias("distance"),
        (F.col("score") * (1.0 - NEIGHBOUR_DECAY * F.abs("step"))).alias("score"))
    return near.join(pages.select("query_id", *PAGE), ["query_id", *PAGE], "left_anti")


# A hit page asks for itself and for at most six neighbours.
PAGES_PER_HIT = 1 + 2 * NEIGHBOUR_PAGES


def wanted_pages(pages: DataFrame) -> DataFrame:
    """Hit pages and candidate neighbours: (query_id, document, page, issuer, score, distance, leads)."""
    best = best_pages(pages)
    leading = best.select("query_id", *PAGE, F.lit(True).alias("leads"))
    hit = pages.join(leading, ["query_id", *PAGE], "left").select(
        "query_id", *PAGE, "issuer", "score", F.lit(0).alias("distance"),
        F.coalesce("leads", F.lit(False)).alias("leads"))
    near = neighbour_pages(best, pages).select(
        "query_id", *PAGE, "issuer", "score", "distance", F.lit(False).alias("leads"))
    return hit.unionByName(near)


def expand_pages(wanted: DataFrame, parents: DataFrame) -> DataFrame:
    """All parents of the hit pages plus the two nearest parents per issuer, with their tier.

    Hit pages and candidate neighbours meet the parent table in one join.
    """
    found = parents.join(wanted, [*PAGE, "issuer"])
    is_near = F.col("distance") > 0
    nearest = F.row_number().over(
        Window.partitionBy("query_id", "issuer", is_near).orderBy("distance", "page", "p_idx"))
    first = F.min("p_idx").over(Window.partitionBy("query_id", *PAGE))
    tier = F.when(is_near, NEAR).when(F.col("leads") & (F.col("p_idx") == F.col("__first")), BEST).otherwise(REST)
    return (
        found.withColumn("__nearest", nearest).withColumn("__first", first)
        .where(~is_near | (F.col("__nearest") <= NEIGHBOURS_PER_ISSUER))
        .withColumn("tier", tier).drop("__nearest", "__first", "leads")
    )


def rehydrate(expanded: DataFrame, matched: DataFrame, questions: DataFrame, k: int,
              dictionary: Dictionary = DEFAULT_DICTIONARY, strict: bool = False) -> DataFrame:
    """One row per page, re-ranked by overlap with the question, then by score; best ``k`` per question.

    ``expanded`` carries the parents' content and metadata, ``matched`` (query_id, parent_id,
    matched) the chunks that led to them. A page's parents are bounded by the page's own text.
    ``strict`` measures the overlap on the parents' ids instead of their content.
    """
    rows = expanded.join(matched.select("query_id", "parent_id", "matched"), ["query_id", "parent_id"], "left")
    part = F.struct(
        "tier", "p_idx", "parent_id", "content", "child_ids",
        F.coalesce("matched", F.array().cast("array<string>")).alias("matched"))
    pages = rows.groupBy("query_id", *PAGE, "issuer", "doc_type", "year", "title").agg(
        F.max("score").alias("score"), F.min("tier").alias("tier"),
        F.array_sort(F.collect_list(part)).alias("parts"))
    content = F.array_join(F.transform("parts", lambda p: p["content"]), "\n\n")
    ids = F.array_join(F.transform("parts", lambda p: p["parent_id"]), "\n")
    asked = questions.select("query_id", T.words(F.col("question"), dictionary).alias("asked"))
    scored = pages.withColumn("content", content).join(asked, "query_id").withColumn(
        "overlap", F.coalesce(T.figure_overlap(F.col("asked"), ids if strict else F.col("content"), dictionary),
                              F.lit(0)))
    order = [F.col("overlap").desc(), F.col("score").desc(), F.col("tier"), F.col("document"), F.col("page")]
    best = top_k(scored, ["query_id"], order, k)
    return best.select(
        "query_id", "rank", F.format_string("%s_p%d", "document", "page").alias("block_id"), *PAGE,
        "issuer", "doc_type", "year", "title", "content", "score", "overlap",
        F.flatten(F.transform("parts", lambda p: p["child_ids"])).alias("child_ids"),
        F.flatten(F.transform("parts", lambda p: p["matched"])).alias("matched_child_ids"),
        F.array(F.format_string("%s_%s_%s (pág. %d)", "issuer", "doc_type", "year", "page")).alias("citations"),
    )
