"""The operators as queries over the given tables.

Documents stand for report pages, their lines for chunks, benchmark texts for questions; answers and
their sources are written from orders. Every query reads whole tables and whole texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.dictionaries import Dictionary
from groundline.functions import indicators as I
from groundline.functions import numeric as N
from groundline.functions import text as T
from groundline.functions.prompts import context_block, context_prompt
from groundline.operators import attribution as A
from groundline.operators import chunking as C
from groundline.operators import corrections as K
from groundline.operators import decomposition as D
from groundline.operators import grounding as G
from groundline.operators import index as X
from groundline.operators import name_joins as J
from groundline.operators import pages as P
from groundline.operators import ranking as R
from groundline.operators.number_index import first_locations, number_index
from groundline.operators.scan import best_bm25, best_tfidf
from groundline.plans.retrieval import retrieve
from groundline.session import broadcast_if_small, cut_lineage, ensure_checkpoint_dir, one, spread, stored, text_bytes
from groundline.sources import files as S
from groundline.sources.bucketed import BucketedStore

DIGITS = 6
# Question text below this size gives so few terms that they are broadcast.
QUESTION_BYTES = 1 << 20
TOP = 8
# Answers are judged by many patterns each.
ANSWERS_PER_TASK = 50_000

# A small dictionary in the languages of the documents.
SAMPLE = Dictionary(
    indicators=(("english", ("the", "and", "that")), ("french", ("les", "que")), ("german", ("und", "der")),
                ("spanish_text", ("los", "del"))),
    cross_lingual=(("that", "which"), ("und", "and"), ("ción", "tion")),
    aspects=(("the", "articles, nouns"), ("que", "relative clauses")),
    question_issuers=(("english", ("and", "the")), ("french", ("les", "ment")), ("german", ("und", "sch"))),
)


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def out(c):
    return F.round(c, DIGITS)


def joined(c):
    return F.array_join(c, ",")


# ---------------------------------------------------------------- documents as chunks and pages


def documents(spark, sf) -> DataFrame:
    """Documents as chunks."""
    return read(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("child_id"), F.col("text").alias("content"),
        F.col("source").alias("issuer"))


PAGE_SPAN = 60


def parents(spark, sf) -> DataFrame:
    """Documents as parent chunks; a source is a report, 60 consecutive ids span a page of it."""
    content = F.col("text")
    return read(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("parent_id"), F.col("source").alias("document"),
        F.floor(F.col("doc_id") / PAGE_SPAN).cast("long").alias("page"),
        F.concat(F.lit("grupo "), F.length("source").cast("string")).alias("issuer"),
        F.lit("memoria").alias("doc_type"), F.lit("2025").alias("year"), F.col("source").alias("title"),
        content.alias("content"), F.col("doc_id").cast("long").alias("p_idx"),
        T.is_contents_page(content).alias("is_toc"),
        F.array(F.col("doc_id").cast("string")).alias("child_ids"))


def lines(spark, sf) -> DataFrame:
    """Document lines as child chunks of :func:`parents`."""
    base = parents(spark, sf)
    return base.select(
        *[c for c in base.columns if c not in ("content", "child_ids")],
        F.posexplode(F.split("content", "\n")).alias("c_idx", "content"),
    ).where(F.col("content") != "").withColumn(
        "child_id", F.concat("parent_id", F.lit("_"), F.col("c_idx").cast("string")))


def questions(spark, sf) -> DataFrame:
    return read(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question"),
        F.lit(None).cast("string").alias("issuer_filter"))


QID = ["query_id"]


def plain_terms(asked: DataFrame) -> DataFrame:
    return asked.select("query_id", "issuer_filter", F.explode(T.words(F.col("question"))).alias("term"),
                        F.lit(1.0).alias("qtf"))


def plain_bm25_terms(asked: DataFrame) -> DataFrame:
    terms = asked.select("query_id", "issuer_filter", F.explode(T.words(F.col("question"))).alias("word"))
    return terms.select("query_id", "issuer_filter", F.explode(T.analysed_terms(F.col("word"))).alias("term")).groupBy(
        "query_id", "issuer_filter", "term").agg(F.count(F.lit(1)).cast("double").alias("query_weight"))


def few(asked: DataFrame) -> bool:
    return text_bytes(asked, "question") <= QUESTION_BYTES


def tfidf_statistics(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Term counts of each chunk and the vocabulary, both written once."""
    packed = stored(X.packed_counts(chunks), "counts")
    return packed, stored(X.smoothed_idf(X.document_frequency(X.unpacked(packed)), chunks), "vocabulary")


def tfidf_best(terms: DataFrame, asked: DataFrame, packed: DataFrame, vocabulary: DataFrame, k: int = R.LIST_SIZE) -> DataFrame:
    """Best ``k`` chunks of every question for terms(query_id, issuer_filter, term, qtf)."""
    weighed = R.query_term_weights(terms, vocabulary, QID)
    if few(asked):
        return R.tfidf_rank(best_tfidf(cut_lineage(weighed), packed, vocabulary, QID, k), QID, k)
    return R.tfidf_rank(R.score_terms(weighed, X.tfidf_postings(X.unpacked(packed), vocabulary), QID), QID, k)


def tfidf_lists(asked: DataFrame, chunks: DataFrame, k: int = R.LIST_SIZE) -> DataFrame:
    packed, vocabulary = tfidf_statistics(chunks)
    return tfidf_best(plain_terms(asked), asked, packed, vocabulary, k)


def bm25_best(terms: DataFrame, asked: DataFrame, chunks: DataFrame, k: int = R.LIST_SIZE, indicator: bool = False) -> DataFrame:
    """Best ``k`` chunks of every question for terms(query_id, issuer_filter, term, query_weight[, required])."""
    if few(asked):
        return R.bm25_rank(best_bm25(terms, chunks, QID, k * R.BM25_WIDTH, indicator), QID, k)
    return R.bm25_rank(R.bm25_scores(terms, chunks, QID, indicator=indicator), QID, k)


def bm25_lists(asked: DataFrame, chunks: DataFrame, k: int = R.LIST_SIZE) -> DataFrame:
    return bm25_best(plain_bm25_terms(asked), asked, chunks, k)


def ranked(lists: DataFrame) -> DataFrame:
    return lists.select("query_id", F.col("rank").cast("long").alias("rank"), "child_id", out("score").alias("score"))


# ------------------------------------------------------------------------------ text queries


def tokenize_counts(spark, sf):
    tokens = T.words(F.col("text"))
    return read(spark, sf, "documents").select(
        "doc_id", F.size(tokens).cast("long").alias("n_tokens"),
        F.size(F.array_distinct(tokens)).cast("long").alias("n_distinct"))


def analysed_counts(spark, sf):
    tokens = T.analysed_terms(F.col("text"))
    return read(spark, sf, "documents").select(
        "doc_id", F.size(tokens).cast("long").alias("n_terms"),
        F.size(F.array_distinct(tokens)).cast("long").alias("n_distinct"))


def doc_frequency_idf(spark, sf):
    chunks = documents(spark, sf)
    vocabulary = X.smoothed_idf(X.document_frequency(X.term_counts(chunks)), chunks)
    return vocabulary.select("term", "df", "cf", out("idf").alias("idf"))


def tfidf_norms(spark, sf):
    chunks = documents(spark, sf)
    packed, vocabulary = tfidf_statistics(chunks)
    return X.chunk_norms(X.unpacked(packed), vocabulary).select("child_id", "n_terms", out(F.col("norm")).alias("norm"))


def tfidf_topk(spark, sf):
    return ranked(tfidf_lists(questions(spark, sf), documents(spark, sf)))


def filtered_questions(spark, sf):
    """Each question asks one source."""
    return questions(spark, sf).withColumn(
        "issuer_filter", F.concat(F.lit("src"), F.pmod("query_id", F.lit(20)).cast("string")))


def tfidf_prefilter_issuer(spark, sf):
    return ranked(tfidf_lists(filtered_questions(spark, sf), documents(spark, sf)))


def bm25_topk(spark, sf):
    return ranked(bm25_lists(questions(spark, sf), documents(spark, sf)))


def bm25_postfilter_issuer(spark, sf):
    return ranked(bm25_lists(filtered_questions(spark, sf), documents(spark, sf)))


def bm25_two_fields(spark, sf):
    """Content and indicator field in one score: a document's source stands for its indicator, each question also names a
    source, and its first search word is required."""
    named = documents(spark, sf).withColumn("indicator", F.col("issuer"))
    asked = questions(spark, sf).withColumn(
        "question", F.concat("question", F.lit(" src"), F.pmod("query_id", F.lit(20)).cast("string")))
    first = F.transform(F.slice(T.words(F.col("question")), 1, 1), lambda w: F.get(T.analysed_terms(w), F.lit(0)))
    must = asked.select("query_id", F.explode(first).alias("must"))
    terms = plain_bm25_terms(asked).join(must, "query_id", "left")
    terms = terms.withColumn("required", F.coalesce(F.col("term") == F.col("must"), F.lit(False))).drop("must")
    return ranked(bm25_best(terms, asked, named, indicator=True))


def bm25_saved_index(spark, sf):
    """The rows of bm25_topk from a saved index with score bounds, most of whose blocks stay unread."""
    from groundline.operators.block_index import BlockIndex

    chunks = documents(spark, sf)
    postings = stored(X.bm25_postings(X.unpacked(stored(X.packed_counts(chunks, "analysed"), "counts")), chunks), "postings")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bm25-index-{uuid.uuid4().hex}"
    BlockIndex.build(postings).save(folder)
    scored = BlockIndex.load(spark, folder).search(plain_bm25_terms(questions(spark, sf)), QID, R.LIST_SIZE * R.BM25_WIDTH)
    return ranked(R.bm25_rank(scored, QID))


def both_lists(asked, chunks):
    columns = ["query_id", "child_id", "rank"]
    return tfidf_lists(asked, chunks).select(*columns).unionByName(bm25_lists(asked, chunks).select(*columns))


def rrf_fusion(spark, sf):
    return ranked(R.reciprocal_rank_fusion(both_lists(questions(spark, sf), documents(spark, sf)), QID))


def rrf_maxnorm_multi(spark, sf):
    """Questions as sub-queries of one compound question per language pair of ids."""
    lists = both_lists(questions(spark, sf), documents(spark, sf)).withColumnRenamed("query_id", "sid").withColumn(
        "query_id", F.floor(F.col("sid") / 4).cast("long"))
    fused = R.max_normalized(R.reciprocal_rank_fusion(lists, ["query_id", "sid"]), ["query_id", "sid"])
    return ranked(R.sum_over_subqueries(fused, QID))


def anchor_idf_boost(spark, sf):
    chunks = documents(spark, sf)
    vocabulary = X.smoothed_idf(X.document_frequency(X.term_counts(chunks)), chunks)
    words = questions(spark, sf).select(
        "query_id", "issuer_filter", F.posexplode(T.words(F.col("question"))).alias("pos", "token"))
    weighed = D.weigh_rare_words(words, vocabulary, QID)
    return weighed.select("query_id", F.col("pos").cast("long").alias("pos"), "token",
                          out("idf").alias("idf"), F.col("qtf").cast("long").alias("qtf"))


# ------------------------------------------------------------------------------ vectors


def vectors(spark, sf):
    return read(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("child_id"), F.concat(F.lit("label"), F.col("label").cast("string"))
        .alias("issuer_key"), F.col("embedding").alias("vec"))


def centroids(spark, sf):
    """Mean vector of every label."""
    parts = read(spark, sf, "embeddings").select(
        F.col("label").cast("long").alias("query_id"), F.posexplode("embedding").alias("i", "x"))
    mean = parts.groupBy("query_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))


def vector_cosine_topk(spark, sf):
    asked = centroids(spark, sf).withColumn("issuer_filter", F.lit(None).cast("string"))
    return ranked(R.vector_rank(asked, vectors(spark, sf)))


def vector_label_filter(spark, sf):
    asked = centroids(spark, sf).withColumn(
        "issuer_filter", F.concat(F.lit("label"), F.col("query_id").cast("string")))
    return ranked(R.vector_rank(asked, vectors(spark, sf)))


def vector_neighbour_cosine(spark, sf):
    """Cosine of every vector with the centroid of its label, as a plain expression."""
    own = read(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("own"))
    return own.join(centroids(spark, sf), "query_id").select(
        "vec_id", out(R.cosine(F.col("own"), F.col("vec"))).alias("cosine"))


def embedding_integrity(spark, sf):
    size = F.size("embedding")
    return read(spark, sf, "embeddings").agg(
        F.count(F.lit(1)).alias("n_vectors"), F.count_distinct("vec_id").alias("n_keys"),
        F.min(size).cast("long").alias("min_dim"), F.max(size).cast("long").alias("max_dim"),
        (F.min(size) == F.max(size)).alias("aligned"))


# ------------------------------------------------------------------------------ numbers


def document_pages(spark, sf):
    return spread(read(spark, sf, "documents").select(
        F.col("source").alias("document"), F.col("doc_id").cast("long").alias("page"), "text"))


def number_locations(spark, sf):
    return number_index(document_pages(spark, sf)).select(
        "number", "document", F.col("page").cast("long").alias("page"), "snippet")


def number_first_location(spark, sf):
    return first_locations(number_index(document_pages(spark, sf))).select(
        "number", "document", F.col("page").cast("long").alias("page"), "snippet")


def index_numbers(spark, sf):
    return read(spark, sf, "documents").select(
        "doc_id", joined(F.array_sort(N.index_numbers(F.col("text")))).alias("numbers"))


def raw_numbers(spark, sf):
    return read(spark, sf, "documents").select(
        "doc_id", joined(F.array_sort(N.raw_numbers(F.col("text")))).alias("numbers"))


def years(spark, sf):
    found = N.years(F.col("text"))
    return read(spark, sf, "documents").select(
        "doc_id", joined(F.array_sort(found)).alias("years"),
        F.size(F.filter(N.raw_numbers(F.col("text")), N.is_year)).cast("long").alias("year_like"))


def statements(spark, sf):
    """An answer, its source and a question for every order.

    The answer repeats the source, changes the amount for finished orders and the currency for
    partly finished ones.
    """
    orders = spread(read(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), ANSWERS_PER_TASK)
    total = F.floor("o_totalprice").cast("long")
    status = F.col("o_orderstatus")
    claimed = F.when(status == "F", total + 1).otherwise(total).cast("string")
    currency = F.when(status == "P", F.lit("S/. ")).otherwise(F.lit("US$ "))
    year = F.year("o_orderdate").cast("string")
    share = F.pmod("o_custkey", F.lit(50)).cast("string")
    lots = F.pmod("o_orderkey", F.lit(97)).cast("string")
    return orders.select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("priority"),
        F.concat(F.lit("Contrato de "), year, F.lit(": US$ "), total.cast("string"), F.lit(" millones, alza de "),
                 share, F.lit(".5%; anticipo S/ "), lots, F.lit(" mil.")).alias("context"),
        F.concat(F.lit("En "), year, F.lit(" se pactaron "), currency, claimed, F.lit(" millones, un "), share,
                 F.lit(".5 por ciento mas, con $"), lots, F.lit(" y "), lots, F.lit(" lotes de 3.25% cada uno."))
        .alias("response"),
        F.concat(F.lit("Cuanto se pacto en "), year, F.lit("?")).alias("question"))


def verdicts(spark, sf):
    return G.verify(statements(spark, sf))


def money_phrases(spark, sf):
    m = statements(spark, sf).select("o_orderkey", F.posexplode_outer(N.money_phrases(F.col("response"))).alias("pos", "m")).where("pos IS NOT NULL")
    return m.select("o_orderkey", F.col("pos").cast("long").alias("pos"), "m.currency", "m.base_digits", "m.value",
                    "m.raw_text")


def percent_phrases(spark, sf):
    p = statements(spark, sf).select("o_orderkey", F.posexplode_outer(N.percent_phrases(F.col("response"))).alias("pos", "p")).where("pos IS NOT NULL")
    return p.select("o_orderkey", F.col("pos").cast("long").alias("pos"), "p.canon", "p.base_digits", "p.raw_text")


def grounding_verdict(spark, sf):
    return verdicts(spark, sf).select(
        "o_orderkey", "is_valid", joined("allowed_numbers").alias("allowed"), joined("response_numbers").alias("said"),
        joined(F.array_sort("hallucinated_numbers")).alias("bad_numbers"),
        joined(F.transform("hallucinated_money", N.money_key)).alias("bad_money"),
        joined(F.transform("hallucinated_percent", lambda p: p["canon"])).alias("bad_percent"))


def grounding_by_priority(spark, sf):
    v = verdicts(spark, sf)
    return v.groupBy("priority").agg(
        F.count(F.lit(1)).alias("answers"), F.sum(F.col("is_valid").cast("long")).alias("valid"),
        F.sum(F.size("hallucinated_numbers")).cast("long").alias("bad_numbers"),
        F.sum(F.size("hallucinated_money")).cast("long").alias("bad_money"),
        F.sum(F.size("hallucinated_percent")).cast("long").alias("bad_percent"))


def allowed_money_by_currency(spark, sf):
    """Distinct allowed amounts per currency over all sources."""
    found = statements(spark, sf).select(F.explode_outer(N.money_phrases(F.col("context"))).alias("m")).where(
        "m IS NOT NULL")
    return found.select("m.currency", "m.value").distinct().groupBy("currency").agg(
        F.count(F.lit(1)).alias("n_values"), F.min("value").alias("low"), F.max("value").alias("high"))


def hallucinated_set(spark, sf):
    return verdicts(spark, sf).select("o_orderkey", F.explode_outer("hallucinated_numbers").alias("number")).where(
        "number IS NOT NULL")


def contract_index(spark, sf):
    return number_index(statements(spark, sf).select(
        F.concat(F.lit("contratos_"), "priority").alias("document"), F.col("o_orderkey").cast("long").alias("page"),
        F.col("context").alias("text")))


def corrections_by_kind(spark, sf):
    found = K.find_corrections(verdicts(spark, sf), ["o_orderkey"], contract_index(spark, sf))
    return found.select("o_orderkey", F.col("ord").cast("long").alias("ord"), *K.CORRECTION)


def sanitize_text(spark, sf):
    v = verdicts(spark, sf)
    parts = (F.col("response"), F.col("hallucinated_numbers"), F.col("hallucinated_money"),
             F.col("hallucinated_percent"))
    return v.select("o_orderkey", G.strike_out(*parts).alias("clean"))


def sanitize_digits(spark, sf):
    v = verdicts(spark, sf)
    none = F.array().cast(N.MONEY_TYPE), F.array().cast(N.PERCENT_TYPE)
    return v.select("o_orderkey", G.strike_out(F.col("response"), F.col("hallucinated_numbers"), *none, strict=True)
                    .alias("clean"))


def nation_dictionary(spark, sf):
    """Issuers are the nations (a table of fixed size)."""
    names = sorted(r["n_name"] for r in read(spark, sf, "nation").select("n_name").collect())
    return Dictionary(answer_issuers=tuple((n, (n.lower(),)) for n in names))


def sales_reports(spark, sf):
    """One report chunk and one answer per order about the customer's nation."""
    orders = spread(read(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"), ANSWERS_PER_TASK)
    customers = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nations = F.broadcast(read(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))
    thousands = F.floor(F.col("o_totalprice") / 1000).cast("long")
    kind = F.when(F.col("o_orderpriority").startswith("1"), F.lit("ventas")).otherwise(F.lit("utilidad neta"))
    segment = F.when(F.col("o_orderstatus") == "P", F.lit(" del segmento")).otherwise(F.lit(" totales"))
    joined_rows = orders.join(customers, "o_custkey").join(nations, "c_nationkey")
    return joined_rows.select(
        "o_orderkey", F.col("n_name").alias("issuer"),
        F.concat(F.lit("Las "), kind, segment, F.lit(" fueron US$ "), thousands.cast("string"), F.lit(" mil."))
        .alias("content"),
        F.concat(F.lit("Las "), kind, F.lit(" totales de "), F.col("n_name"), F.lit(" fueron US$ "),
                 F.when(F.col("o_orderstatus") == "F", thousands * 7).otherwise(thousands).cast("string"),
                 F.lit(" mil.")).alias("response"))


def attribution_findings(spark, sf):
    dictionary = nation_dictionary(spark, sf)
    rows = sales_reports(spark, sf)
    children = rows.select("issuer", "content", I.indicator_of(F.col("content"), dictionary).alias("indicator"))
    found = A.findings(A.claims(rows, ["o_orderkey"], "response", dictionary),
                       A.pair_amounts(children, dictionary), ["o_orderkey"])
    return found.select("o_orderkey", *A.FINDING)


# ------------------------------------------------------------------------------ chunks and tables


def chunk_pages(spark, sf):
    return spread(read(spark, sf, "documents")).select(
        F.col("source").alias("document"), F.col("doc_id").cast("long").alias("page"), "text",
        F.col("source").alias("issuer"), F.col("lang").alias("doc_type"), F.lit("2025").alias("year"),
        F.lit("").alias("title"))


def parent_windows(spark, sf):
    rows = C.parent_chunks(chunk_pages(spark, sf))
    return rows.select("parent_id", F.col("p_idx").cast("long").alias("p_idx"), "content")


def recursive_chunks(spark, sf):
    cut = C.split_text(F.col("text"), C.CHILD_CHARS, C.CHILD_OVERLAP)
    parts = spread(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", cut.alias("parts"))
    return parts.select("doc_id", F.posexplode("parts").alias("c_idx", "content")).select(
        "doc_id", F.col("c_idx").cast("long").alias("c_idx"), "content")


def two_level_chunks(spark, sf):
    rows = C.child_chunks(C.parent_chunks(chunk_pages(spark, sf)))
    return rows.select("child_id", "parent_id", "content", "is_table", "indicator")


def pipe_table_rows(spark, sf):
    """A Markdown table of every order's lines, cut into row chunks."""
    item = F.format_string("| %d | %d | %s |", "l_partkey", F.col("l_quantity").cast("long"), "l_returnflag")
    tables = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", item.alias("row")))),
                                 lambda s: s["row"]), "\n").alias("body"))
    text = F.concat(F.lit("| Parte | Cantidad | Estado |\n|---|---|---|\n"), "body")
    title = F.concat(F.lit("Orden "), F.col("l_orderkey").cast("string"))
    return tables.select("l_orderkey", F.posexplode_outer(C.table_rows(text, title)).alias("row_no", "c")).where(
        "row_no IS NOT NULL").select(
        "l_orderkey", F.col("row_no").cast("long").alias("row_no"), "c.content", "c.label")


def toc_flag(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.is_contents_page(F.col("text")).alias("is_toc"))


def asked_documents(spark, sf):
    """Every document with one question."""
    bench = read(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"))
    n = one(bench.select(F.count(F.lit(1)).alias("n")))
    docs = read(spark, sf, "documents").withColumn("item_id", F.pmod(F.col("doc_id"), n))
    return docs.join(bench, "item_id")


def overlap_score(spark, sf):
    n = T.figure_overlap(T.words(F.col("question")), F.col("text"))
    return asked_documents(spark, sf).select("doc_id", n.cast("long").alias("overlap"))


# ------------------------------------------------------------------------------ pages


def listed_lines(spark, sf):
    """Both text rankers over document lines, with rare question words counted three times."""
    asked, chunks = questions(spark, sf), lines(spark, sf)
    packed, vocabulary = tfidf_statistics(chunks)
    words = asked.select("query_id", "issuer_filter", F.posexplode(T.words(F.col("question"))).alias("pos", "token"))
    weighed = cut_lineage(D.weigh_rare_words(words, vocabulary, QID))
    terms = weighed.select("query_id", "issuer_filter", F.col("token").alias("term"), "qtf")
    by_tfidf = tfidf_best(terms, asked, packed, vocabulary)
    analysed = weighed.select(
        "query_id", "issuer_filter", F.explode(T.analysed_terms(F.col("token"))).alias("term"), "qtf"
    ).groupBy("query_id", "issuer_filter", "term").agg(F.sum("qtf").alias("query_weight"))
    by_bm25 = bm25_best(analysed, asked, chunks)
    columns = ["query_id", "child_id", "rank"]
    return by_tfidf.select(*columns).unionByName(by_bm25.select(*columns))


def fused_lines(spark, sf):
    fused = R.reciprocal_rank_fusion(listed_lines(spark, sf), QID)
    places = lines(spark, sf).select("child_id", "parent_id", "document", "page", "issuer", "p_idx", "is_toc")
    return cut_lineage(places.join(broadcast_if_small(cut_lineage(fused)), "child_id"))


def parent_hits(spark, sf):
    return P.parent_scores(fused_lines(spark, sf))


def parent_max_score(spark, sf):
    return parent_hits(spark, sf).select(
        "query_id", "parent_id", "document", F.col("page").cast("long").alias("page"), out("score").alias("score"),
        joined("matched").alias("matched"))


def page_hits(spark, sf):
    return P.page_scores(parent_hits(spark, sf))


def sibling_expand(spark, sf):
    hits = page_hits(spark, sf)
    return hits.join(parents(spark, sf).select("document", "page", "parent_id"), ["document", "page"]).select(
        "query_id", "document", F.col("page").cast("long").alias("page"), "parent_id", out("score").alias("score"))


def best_per_issuer(spark, sf):
    return P.best_pages(page_hits(spark, sf)).select(
        "query_id", "issuer", "document", F.col("page").cast("long").alias("page"), out("score").alias("score"))


def neighbor_band_join(spark, sf):
    hits = page_hits(spark, sf)
    near = P.neighbour_pages(P.best_pages(hits), hits)
    there = parents(spark, sf).select("document", "page", "issuer", "parent_id")
    return near.join(there, ["document", "page", "issuer"]).select(
        "query_id", "document", F.col("page").cast("long").alias("page"), "parent_id",
        F.col("distance").cast("long").alias("distance"), out("score").alias("score"))


def tiered_parents(spark, sf):
    wanted = broadcast_if_small(cut_lineage(P.wanted_pages(page_hits(spark, sf))))
    return P.expand_pages(wanted, parents(spark, sf)).select(
        "query_id", "parent_id", F.col("tier").cast("long").alias("tier"), out("score").alias("score"))


def blocks(rows: DataFrame) -> DataFrame:
    return rows.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "block_id", "issuer", out("score").alias("score"),
        F.col("overlap").cast("long").alias("overlap"), "content", joined("child_ids").alias("child_ids"),
        joined("matched_child_ids").alias("matched"), F.get("citations", F.lit(0)).alias("citation"))


def page_rehydrate(spark, sf):
    hits = parent_hits(spark, sf)
    wanted = broadcast_if_small(cut_lineage(P.wanted_pages(P.page_scores(hits))))
    expanded = P.expand_pages(wanted, parents(spark, sf))
    return blocks(P.rehydrate(expanded, hits, questions(spark, sf), TOP))


def hybrid_retrieve(spark, sf):
    """The whole retrieval plan: benchmark questions over document lines."""
    # the lines are read for each table of the index
    chunks = stored(spread(lines(spark, sf)), "lines")
    name = f"hybrid_{uuid.uuid4().hex}"
    store = BucketedStore.write(
        parents(spark, sf), chunks, X.build_text_index(chunks), f"{ensure_checkpoint_dir(spark)}/{name}", name)
    return blocks(retrieve(questions(spark, sf), store.parents, store.children, store.index, TOP, places=store.places))


def page_must_filter(spark, sf):
    """Fused lines whose page holds the question's first search word, and the page's evidence."""
    fused = fused_lines(spark, sf)
    anchors = questions(spark, sf).select(
        "query_id", F.slice(T.words(F.col("question")), 1, 1).alias("anchors"))
    pages = cut_lineage(fused.select("query_id", "document", "page").distinct().join(anchors, "query_id"))
    evidence = P.page_evidence(broadcast_if_small(pages), lines(spark, sf))
    kept = fused.join(evidence, ["query_id", "document", "page"]).where(F.size("held") > 0)
    return kept.select("query_id", "child_id", joined("held").alias("held"), "money")


# ------------------------------------------------------------------------------ questions


def indicator_match(spark, sf):
    text = F.col("text")
    return read(spark, sf, "documents").select(
        "doc_id", I.indicator_of(text, SAMPLE).alias("indicator"),
        joined(I.matched_indicators(text, SAMPLE)).alias("matched"))


def query_expansion(spark, sf):
    return read(spark, sf, "benchmark").select(
        "item_id", F.posexplode(I.expand_question(F.col("text"), SAMPLE)).alias("vid", "variant")).select(
        "item_id", F.col("vid").cast("long").alias("vid"), "variant")


def issuer_detect(spark, sf):
    return read(spark, sf, "benchmark").select(
        "item_id", joined(D.issuers_in_question(F.col("text"), SAMPLE)).alias("issuers"))


def issuer_match(spark, sf):
    """Every supplier name against a filter made from its nation's name."""
    suppliers = read(spark, sf, "supplier")
    nations = F.broadcast(read(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"))
    wanted = F.concat(F.substring("s_name", 1, 10), F.substring("n_name", 1, 1))
    return suppliers.join(nations, "s_nationkey").select(
        "s_suppkey", T.issuer_key(F.col("s_name")).alias("issuer_key"), T.issuer_key(wanted).alias("filter_key"),
        T.issuer_matches(F.col("s_name"), F.substring("s_name", 1, 9)).alias("prefix_match"),
        T.issuer_matches(F.col("s_name"), wanted).alias("nation_match"))


def dictionary_matches(spark, sf):
    """Every document with the entries of a dictionary that it names: the first two words of all documents and benchmark items."""
    docs = read(spark, sf, "documents")
    first = lambda c: F.regexp_extract(F.lower(c), r"^([a-z]+ [a-z]+)(?:[^\p{L}\p{M}\p{N}_]|$)", 1)
    names = docs.select(first("text").alias("alias"), F.col("source").alias("canon")).unionByName(
        read(spark, sf, "benchmark").select(first("text").alias("alias"), F.lit("benchmark").alias("canon")))
    entries = names.where("alias <> ''").groupBy("alias").agg(F.min("canon").alias("canon"))
    hits = J.alias_matches(docs.select("doc_id", "text"), entries.withColumn("ord", F.length("alias")), "doc_id")
    found = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_aliases"), F.min(F.struct("ord", "alias", "canon")).alias("first"))
    return found.select("doc_id", "n_aliases", F.col("first.canon").alias("first_canon"), F.col("first.alias").alias("first_alias"))


def contained_names(spark, sf):
    """Every supplier with the written names that hold its name or lie in it: customers sign with a supplier's name and their
    nation's, or with the end of a name."""
    nations = F.broadcast(read(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))
    number = F.col("c_custkey").cast("string")
    signed = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Supplier#"), F.lpad(number, 9, "0"), F.lit(" "), "n_name")).otherwise(
        F.lpad(number, 7, "0"))
    written = read(spark, sf, "customer").join(nations, "c_nationkey").select(signed.alias("name"))
    suppliers = read(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    pairs = J.contained_names(suppliers, written)
    links = pairs.groupBy(F.col("left_name").alias("name")).agg(
        F.count_if(F.col("direction") == "in").alias("n_holding"), F.count_if(F.col("direction") == "holds").alias("n_inside"),
        F.min("right_name").alias("first_written"))
    return suppliers.join(links, "name", "left").select(
        "s_suppkey", F.coalesce("n_holding", F.lit(0)).alias("n_holding"), F.coalesce("n_inside", F.lit(0)).alias("n_inside"), "first_written")


def clause_split(spark, sf):
    clauses = read(spark, sf, "benchmark").select("item_id", F.posexplode(T.clauses(F.col("text"))).alias("pos", "clause"))
    owner = F.lit("the")
    return clauses.select(
        "item_id", F.col("pos").cast("long").alias("pos"), "clause",
        T.is_preamble(F.col("clause"), owner).alias("preamble"),
        joined(T.proper_names(F.col("clause"), owner)).alias("anchors"))


def question_subqueries(spark, sf):
    """Decomposition of benchmark questions with the sample dictionary."""
    subs = D.subqueries(questions(spark, sf), None, SAMPLE)
    return subs.select("query_id", F.col("sid").cast("long").alias("sid"), "multi", "text", "issuer_filter",
                       joined("must").alias("must"), joined("boost").alias("boost"))


def answer_sentences(spark, sf):
    turns = read(spark, sf, "conversations")
    return turns.select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).select(
        "conv_id", "turn", F.col("pos").cast("long").alias("pos"), "sentence")


def strip_think(spark, sf):
    """Turns whose text is preceded by a reasoning block, or by a dangling end of one."""
    turns = read(spark, sf, "conversations")
    opened = F.when(F.col("role") == "user", F.lit("<think>")).otherwise(F.lit(""))
    noisy = F.concat(opened, "text", F.lit("</think>\n<Reasoning>x</reasoning >"), "text", F.lit("<thought>y\n</thought> "))
    return turns.select("conv_id", "turn", T.strip_reasoning(noisy).alias("answer"))


# ------------------------------------------------------------------------------ sources and prompts


def named_pages(spark, sf):
    """Web pages as report files: secure ones carry a conventional file name, the others a free one."""
    kind = F.col("url").startswith("https")
    year = (2000 + F.pmod("page_id", F.lit(26))).cast("string")
    number = F.col("page_id").cast("string")
    file = F.when(kind, F.concat(F.lit("Emisor"), number, F.lit("_memoria_anual_"), year, F.lit(".md"))).otherwise(
        F.concat(F.lit("informe-"), year, F.lit("_"), number, F.lit(".md")))
    return read(spark, sf, "pages").select("page_id", "url", "html", file.alias("file"))


def catalog_coalesce(spark, sf):
    """Metadata from a catalog for pages with a query string, else from the file name."""
    pages = named_pages(spark, sf)
    catalog = pages.where(F.col("url").contains("?")).select(
        F.concat(S.stem(F.col("file")), F.lit(".pdf")).alias("file"), F.lit("Catalogo").alias("issuer"),
        F.lit("reporte").alias("doc_type"), F.lit("2024").alias("year"), F.col("url").alias("title"))
    rows = pages.select("file", F.lit(1).alias("page"), F.col("url").alias("text"))
    return S.with_metadata(rows, catalog).select("document", "issuer", "doc_type", "year", "title")


def markdown_page_split(spark, sf):
    """Every conversation as one Markdown file whose turns follow page marks."""
    turns = read(spark, sf, "conversations")
    part = F.concat(F.lit("<!-- rag:page "), (F.col("turn") + 1).cast("string"), F.lit(" -->\n"), "text")
    files = turns.groupBy("conv_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda s: s["part"]), "\n").alias("md"))
    return files.select("conv_id", F.explode(S.split_pages(F.col("md"))).alias("p")).select(
        "conv_id", F.col("p.page").cast("long").alias("page"), "p.text")


def sha256_manifest(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def prompt_context(spark, sf):
    rows = asked_documents(spark, sf)
    first_line = F.get(F.split("text", "\n"), F.lit(0))
    block = context_block(F.col("source"), first_line, F.col("text"))
    return rows.select("doc_id", context_prompt(F.array(block), F.col("question")).alias("prompt"))


QUERIES = [
    tokenize_counts, analysed_counts, doc_frequency_idf, tfidf_norms, tfidf_topk, tfidf_prefilter_issuer, bm25_topk,
    bm25_postfilter_issuer, bm25_two_fields, bm25_saved_index, rrf_fusion, rrf_maxnorm_multi, anchor_idf_boost, vector_cosine_topk, vector_label_filter,
    vector_neighbour_cosine, embedding_integrity, number_locations, number_first_location, index_numbers, raw_numbers,
    years, money_phrases, percent_phrases, grounding_verdict, grounding_by_priority, allowed_money_by_currency,
    hallucinated_set, corrections_by_kind, sanitize_text, sanitize_digits, attribution_findings, parent_windows,
    recursive_chunks, two_level_chunks, pipe_table_rows, toc_flag, overlap_score, parent_max_score, sibling_expand,
    best_per_issuer, neighbor_band_join, tiered_parents, page_rehydrate, hybrid_retrieve, page_must_filter,
    indicator_match, query_expansion, issuer_detect, issuer_match, dictionary_matches, contained_names, clause_split, question_subqueries,
    answer_sentences, strip_think, catalog_coalesce, markdown_page_split, sha256_manifest, prompt_context,
]
