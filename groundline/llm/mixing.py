"""Mixing sources to target weights along a curriculum, with DataFrame functions only.

Each source has a weight schedule over training time 0 to 1: steps of equal length, each with a factor on the source's
base weight. The schedule's integral sets the source's share; its running integral is the source's cumulative demand
for tokens. A source's documents form one stream in hash order, read twice at most, and the word at offset c of the
stream is due when the cumulative demand reaches c: inverting the demand gives every document its training position.
Sorting by position by ranges gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundline.llm.storage import partitions, running_totals, stored

WORD = r"[^\x20\x09-\x0D]+"
# Base weights of the sources in order of their name, repeating, and how each changes over the steps of the run.
WEIGHTS = (5.0, 2.0, 1.0)
SCHEDULE = ((1.6, 1.2, 0.8, 0.4), (1.0, 1.0, 1.0, 1.0), (0.4, 0.8, 1.2, 1.6))


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple, schedule: tuple, share: float, most: float) -> DataFrame:
    """(source, source_size, weight, target, steps): words that the mix takes of each source.

    Targets divide ``share`` times all words by the integral of the schedules; a target stops at ``most`` times its
    source's words and the excess goes to the others by weight. That is the one level t with
    sum(min(t * weight, most * size)) = share * sum(size), found from running sums in order of most * size / weight.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    name = [F.col("source").asc_nulls_last()]
    ranked = running_totals(sources, [], name, ["one"], "mix-ranks")
    steps = F.element_at(F.array(*[F.array(*map(F.lit, map(float, s))) for s in schedule]), (F.col("before_one") % len(schedule) + 1).cast("int"))
    base = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("before_one") % len(weights) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", steps.alias("steps"), base.alias("base")).select(
        "source", "source_size", "steps",
        (F.col("base") * F.aggregate("steps", F.lit(0.0), lambda a, s: a + s) / F.size("steps")).alias("weight"),
        (F.lit(most) * F.col("source_size")).alias("room"),
    )
    in_order = running_totals(weighed.withColumn("full_at", F.col("room") / F.col("weight")), [], [F.col("full_at"), *name], ["room", "weight"], "mix-levels")
    total = weighed.agg(F.sum("weight").alias("weight"), (F.lit(share) * F.sum("source_size")).alias("words")).first()
    if total["weight"] is None:
        return weighed.select("source", "source_size", "weight", F.col("room").alias("target"), "steps")
    # at a source's own level all sources before it are full: the last level that asks for no more than there is
    asked = F.col("before_room") + F.col("full_at") * (F.lit(total["weight"]) - F.col("before_weight"))
    last = in_order.where(asked <= total["words"]).agg(
        F.max(F.struct("full_at", (F.col("before_weight") + F.col("weight")).alias("weight"), (F.col("before_room") + F.col("room")).alias("room"))).alias("at")
    ).first()["at"]
    left, words = total["weight"] - (last["weight"] if last else 0.0), total["words"] - (last["room"] if last else 0.0)
    level = words / left if left > 1e-9 * total["weight"] else float("inf")
    target = F.col("room") if level == float("inf") else F.least("room", F.lit(level) * F.col("weight"))
    return weighed.select("source", "source_size", "weight", target.alias("target"), "steps")


def due(words: Column, target: Column, steps: Column) -> Column:
    """Training time at which the cumulative demand of a source reaches ``words`` of its ``target``."""
    parts = F.size(steps)
    ends = F.aggregate(steps, F.array(F.lit(0.0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))
    wanted = words / target * F.element_at(ends, -1)
    at = F.least(F.size(F.filter(ends, lambda e: e <= wanted)), parts)  # the step in which it falls, from 1
    inside = (wanted - F.element_at(ends, at)) / F.nullif(F.element_at(steps, at), F.lit(0.0))
    return F.least(F.lit(1.0), (at - 1 + F.coalesce(inside, F.lit(0.0))) / parts)


def mix(
    docs: DataFrame, weights: tuple = WEIGHTS, schedule: tuple = SCHEDULE, share: float = 1.5, most: float = 2.0, seed: int = 7
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_words, second_words, position, second_position) of every row.

    ``taken`` = ``first_words`` + ``second_words``: words of the first and the second reading of its source's stream
    that stand before the target; the row at the target is taken in part, so a source's taken words add up to its
    rounded target. ``position`` and ``second_position`` are training times in [0, 1], null for a reading that takes
    nothing. Null texts have size 0, a null source is a source of its own (last by name), null and repeated ids stay as
    they are, other columns are ignored; sources without words have target 0; an empty table gives an empty result.

    The streams' order is a hash of id, size and seed. Rows are dealt by ranges of (source, hash), so a source of any
    size spreads over many tasks; what meets in one task is one row for each partition. The result is range-sorted by the time
    at which a row is read first; rows that the mix doesn't take are last.
    """
    rows = _plan(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), [], weights, schedule, share, most, seed)
    # untaken rows are dealt by id, so they don't meet in one task
    order = [F.coalesce("position", "second_position").asc_nulls_last(), F.col("doc_id").asc()]
    return rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)


def _plan(sizes: DataFrame, carried: list[str], weights: tuple, schedule: tuple, share: float, most: float, seed: int) -> DataFrame:
    if most > 2:
        raise ValueError("a source is read twice at most")
    sizes = stored(sizes, "mix-sizes")
    order = [F.xxhash64(F.col("doc_id"), F.col("size"), F.lit(seed)).asc(), F.col("doc_id").asc(), F.col("size").asc()]
    placed = running_totals(sizes, ["source"], order, ["size"], "mix-stream").withColumnRenamed("before_size", "before")
    goals = source_targets(sizes, weights, schedule, share, most).withColumnRenamed("source", "__source")
    joined = placed.join(goals, F.col("source").eqNullSafe(F.col("__source")))
    whole = F.round("target").cast("long")
    first = F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("before")))
    second = F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("source_size") - F.col("before")))
    rows = joined.withColumns({"first_words": first, "second_words": second})
    middle = F.col("before") + F.col("first_words") / 2
    again = F.col("source_size") + F.col("before") + F.col("second_words") / 2
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("first_words") + F.col("second_words")).alias("taken"), "first_words", "second_words",
        F.when(F.col("first_words") > 0, due(middle, F.col("target"), F.col("steps"))).alias("position"),
        F.when(F.col("second_words") > 0, due(again, F.col("target"), F.col("steps"))).alias("second_position"), *carried,
    )


def training_order(
    docs: DataFrame, weights: tuple = WEIGHTS, schedule: tuple = SCHEDULE, share: float = 1.5, most: float = 2.0, seed: int = 7
) -> DataFrame:
    """``docs`` as the mix trains on them: one row for each reading, range-sorted by training position.

    A reading that takes at least half of a document's words gives the whole document, since documents aren't cut; one
    that takes less gives none. Documents without words are never taken. Rows keep the columns of ``docs``; equal rows
    are interchangeable, so the n-th of them follows the n-th plan.
    """
    names, keys = docs.columns, ["__key", "__check"]
    keyed = docs.withColumns({"__key": F.xxhash64(*names), "__check": F.hash(*names)})
    plan = _plan(keyed.select("doc_id", "source", word_count(F.col("text")).alias("size"), *keys), keys, weights, schedule, share, most, seed)
    readings = F.array_compact(F.array(
        F.when(2 * F.col("first_words") >= F.col("size"), F.col("position")),
        F.when(2 * F.col("second_words") >= F.col("size"), F.col("second_position")),
    ))
    due_at = plan.groupBy(*keys).agg(F.sort_array(F.collect_list(readings)).alias("__plans")).where(F.exists("__plans", lambda p: F.size(p) > 0))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))
    rows = keyed.join(due_at, keys).withColumn("__nth", nth)
    taken = rows.withColumn("__at", F.explode(F.element_at("__plans", F.col("__nth"))))
    return taken.repartitionByRange(partitions(docs.sparkSession), "__at").sortWithinPartitions("__at").select(*names)
