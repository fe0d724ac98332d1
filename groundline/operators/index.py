"""Term statistics and the two weighted posting tables that the text rankers read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.dictionaries import DEFAULT_DICTIONARY, Dictionary
from groundline.functions import text as T
from groundline.operators.decomposition import title_words
from groundline.session import cut_lineage, has_copies, one, stored

# Terms treated one by one when a dimension is joined to postings. At most this many terms can
# each own more than 1 / HOT_TERMS of all postings, so the hot side of the dimension is bounded.
HOT_TERMS = 20_000
# BM25 constants.
BM25_K1, BM25_B = 1.2, 0.75
# Rows of rare terms that one task sorts.
ROWS_PER_TASK = 2_000_000


def counted(tokens: Column) -> Column:
    """array<struct<term, tf>> of an array of tokens: the runs of the sorted tokens."""
    def runs(s: Column) -> Column:
        first = F.array_compact(F.transform(s, lambda t, i: F.when((i == 0) | (t != F.get(s, i - 1)), i)))
        return T.let(first, lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("tf"))))

    return T.let(F.sort_array(tokens), runs)


def packed_counts(children: DataFrame, tokens: str = "words", dictionary: Dictionary = DEFAULT_DICTIONARY) -> DataFrame:
    """(child_id, issuer_key, dl, entries): the terms of a chunk and their counts in one row.

    Terms are counted where the text is read. Only where chunks share an id are rows shuffled: those of one chunk, issuer and
    length count as one.
    """
    c = F.col("content")
    found = T.words(c, dictionary) if tokens == "words" else T.analysed_terms(c)
    rows = children.select("child_id", T.issuer_key(F.col("issuer"), dictionary).alias("issuer_key"), found.alias("tokens"))
    packed = rows.select("child_id", "issuer_key", F.size("tokens").cast("long").alias("dl"), counted(F.col("tokens")).alias("entries"))
    if not has_copies(children, "child_id"):
        return packed
    key = ["child_id", "issuer_key", "dl"]
    summed = unpacked(packed).groupBy(*key, "term").agg(F.sum("tf").alias("tf"))
    return summed.groupBy(*key).agg(F.collect_list(F.struct("term", "tf")).alias("entries"))


def unpacked(packed: DataFrame) -> DataFrame:
    """(child_id, issuer_key, dl, term, tf) of :func:`packed_counts`."""
    # The outer form keeps the tokeniser from being copied into a filter.
    rows = packed.select("child_id", "issuer_key", "dl", F.explode_outer("entries").alias("e"))
    return rows.select("child_id", "issuer_key", "dl", "e.term", "e.tf").where("term IS NOT NULL")


def term_counts(children: DataFrame, tokens: str = "words",
                dictionary: Dictionary = DEFAULT_DICTIONARY) -> DataFrame:
    """(child_id, issuer_key, dl, term, tf)."""
    return unpacked(packed_counts(children, tokens, dictionary))


def document_frequency(counts: DataFrame) -> DataFrame:
    """(term, df, cf): chunks that hold the term, and its occurrences in all chunks."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def smoothed_idf(frequency: DataFrame, children: DataFrame) -> DataFrame:
    """ln((N + 1) / (df + 1)) + 1 with N the number of chunks."""
    n = one(children.select(F.greatest(F.count(F.lit(1)), F.lit(1)).cast("double").alias("n")))
    return frequency.withColumn("idf", F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0)


def bm25_idf(frequency: DataFrame, children: DataFrame) -> DataFrame:
    n = one(children.select(F.count(F.lit(1)).cast("double").alias("n")))
    df = F.col("df")
    return frequency.withColumn("idf", F.log(1.0 + (n - df + 0.5) / (df + 0.5)))


def hot_and_cold(vocabulary: DataFrame, hot_terms: int = HOT_TERMS) -> tuple[DataFrame, DataFrame]:
    """(term, idf) of the frequent terms, which are few (see above), and of all others."""
    total = one(vocabulary.agg(F.sum("df").alias("total")))
    hot = F.col("df") * hot_terms >= total
    return vocabulary.where(hot).select("term", "idf"), vocabulary.where(~hot).select("term", "idf")


def attach_by_term(rows: DataFrame, vocabulary: DataFrame, hot_terms: int = HOT_TERMS) -> DataFrame:
    """Add ``idf`` to posting rows; only the rows of rare terms move. ``rows`` and ``vocabulary`` are read twice.

    Frequent terms come from a broadcast. A rare term has a small share of all rows, so their shuffle is spread evenly, over
    tasks that grow in number with the rows.
    """
    hot, cold = hot_and_cold(vocabulary, hot_terms)
    hot = F.broadcast(hot)
    rare = rows.join(hot.select("term"), "term", "left_anti")
    tasks = -(-int(cold_rows(vocabulary, hot_terms)) // ROWS_PER_TASK)
    if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rare = rare.repartition(tasks, "term")
    return rows.join(hot, "term").unionByName(rare.join(cold, "term"))


def cold_rows(vocabulary: DataFrame, hot_terms: int = HOT_TERMS) -> int:
    """Postings of the terms that are not frequent."""
    total = one(vocabulary.agg(F.sum("df").alias("total")))
    return vocabulary.where(F.col("df") * hot_terms < total).agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]


def chunk_norms(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(child_id, n_terms, norm): length of each chunk's vector of tf x idf, summed per chunk before anything is shuffled by chunk."""
    raw = F.col("tf") * F.col("idf")
    slim = counts.select("child_id", "term", "tf")
    return attach_by_term(slim, vocabulary).groupBy("child_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sqrt(F.sum(raw * raw)).alias("norm"))


def tfidf_postings(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, child_id, issuer_key, weight) with unit-length chunk vectors; an all-zero vector stays as it is."""
    # terms are weighed once, and a chunk's rows meet once
    raw, chunk = F.col("tf") * F.col("idf"), Window.partitionBy("child_id")
    rows = attach_by_term(counts, vocabulary).withColumn("norm", F.sqrt(F.sum(raw * raw).over(chunk)))
    norm = F.col("norm")
    return rows.select("term", "child_id", "issuer_key", F.when(norm > 0, raw / norm).otherwise(raw).alias("weight"))


def bm25_postings(counts: DataFrame, children: DataFrame) -> DataFrame:
    """(term, child_id, issuer_key, weight) with the finished BM25 share of each posting. ``counts`` are read twice."""
    vocabulary = stored(bm25_idf(document_frequency(counts), children), "vocabulary")
    occurrences = one(vocabulary.agg(F.sum("cf").cast("double").alias("cf")))
    avgdl = occurrences / one(children.select(F.count(F.lit(1)).alias("n")))
    tf, dl = F.col("tf"), F.col("dl")
    share = F.col("idf") * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / avgdl))
    return attach_by_term(counts, vocabulary).select("term", "child_id", "issuer_key", share.alias("weight"))


def indicator_postings(children: DataFrame, dictionary: Dictionary = DEFAULT_DICTIONARY) -> DataFrame:
    """Second BM25 field: the exact indicator name as the only term of the field, with the field's own frequencies and
    average length (over all chunks, as chunks without an indicator have none of its terms)."""
    named = children.where("indicator IS NOT NULL").select(
        F.col("indicator").alias("term"), "child_id",
        T.issuer_key(F.col("issuer"), dictionary).alias("issuer_key"))
    vocabulary = cut_lineage(bm25_idf(named.groupBy("term").agg(F.count(F.lit(1)).alias("df")), children))
    average = one(vocabulary.agg(F.sum("df").cast("double").alias("cf"))) / one(children.select(F.count(F.lit(1)).alias("n")))
    share = F.col("idf") * (BM25_K1 + 1) / (1 + BM25_K1 * (1 - BM25_B + BM25_B / average))
    return attach_by_term(named, vocabulary).select("term", "child_id", "issuer_key", share.alias("weight"))


@dataclass
class TextIndex:
    """What retrieval reads: vocabulary, the two posting tables and the words of titles."""

    vocabulary: DataFrame
    tfidf: DataFrame
    bm25: DataFrame
    titles: DataFrame

    TABLES = ("vocabulary", "tfidf", "bm25", "titles")

    def save(self, path: str) -> None:
        """Write all tables, replacing what is there. Files hold whole chunks sorted by term, so
        scores are complete within a file and row groups without a wanted term are skipped."""
        self.vocabulary.repartitionByRange("term").sortWithinPartitions("term").write.mode(
            "overwrite").parquet(f"{path}/vocabulary")
        self.titles.repartitionByRange("token").sortWithinPartitions("token").write.mode(
            "overwrite").parquet(f"{path}/titles")
        for name in ("tfidf", "bm25"):
            getattr(self, name).repartition("child_id").sortWithinPartitions("term", "child_id").write.mode(
                "overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> "TextIndex":
        return cls(*[spark.read.parquet(f"{path}/{name}") for name in cls.TABLES])

    def checkpointed(self) -> "TextIndex":
        """The tables written once to the checkpoint folder, for an index that is not stored."""
        return TextIndex(*[cut_lineage(getattr(self, name)) for name in self.TABLES])

    def cache(self) -> "TextIndex":
        """Keep the tables for repeated questions in one session."""
        return TextIndex(*[getattr(self, name).cache() for name in self.TABLES])


def build_text_index(children: DataFrame, dictionary: Dictionary = DEFAULT_DICTIONARY,
                     indicator_field: bool | None = None) -> TextIndex:
    """Both rankers' tables. The indicator is searched wherever ``children`` has that column, unless it is turned off.

    Texts are cut into terms once for each analyser: the counts are written, as weights need them beside the document
    frequencies that come from them.
    """
    if indicator_field is None:
        indicator_field = "indicator" in children.columns
    counts = unpacked(stored(packed_counts(children, "words", dictionary), "counts"))
    vocabulary = stored(smoothed_idf(document_frequency(counts), children), "vocabulary")
    bm25 = bm25_postings(unpacked(stored(packed_counts(children, "analysed", dictionary), "counts")), children)
    if indicator_field:
        bm25 = bm25.unionByName(indicator_postings(children, dictionary))
    titles = title_words(children, dictionary)
    return TextIndex(vocabulary, tfidf_postings(counts, vocabulary), bm25, titles)
