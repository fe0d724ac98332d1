"""Merkle manifest of a document table: one tree for each source, one tree over the sources, proofs and their check.

Every row is a leaf. While a source has several nodes, each run of 16 becomes one; what remains is its subroot, and the
subroots, ordered by source, become the root in the same way.

Superblocks of 16 ** depth consecutive nodes are reduced on their own, so a hot source spreads over as many groups as it
has superblocks, and only their nodes go on to the next turn (a 4096th of the rows for depth 3). On the way back each
superblock's nodes are cogrouped with the outer nodes of its path to the root, which the turn above has made; one function
then finishes the local tree, joins local and outer siblings to proofs, and folds the given leaf along them.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.llm.storage import running_totals, stored

ARITY = 16
DEPTH = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["tree", "block"]
PATH = "before array<string>, after array<string>, subroot string"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """Hex SHA-256 of values that can't run into each other: ``-`` for null, else byte count, colon, value."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def _levels(nodes: list[str], most: int | None = None) -> list[list[str]]:
    """The nodes and what they become, up to a single one or for exactly ``most`` levels."""
    levels = [nodes]
    while len(levels[-1]) > 1 if most is None else len(levels) <= most:
        now = levels[-1]
        levels.append([digest("".join(now[i : i + ARITY])) for i in range(0, len(now), ARITY)])
    return levels


def _blocked(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / ARITY**depth).cast("long"))


def _reduced(nodes: DataFrame, depth: int) -> DataFrame:
    """(tree, block, whole, single) of ``nodes(tree, pos, digest)``: a superblock's node after ``depth`` levels, and what a
    tree that has no other superblock ends in."""

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = rows.sort_values("pos")["digest"].tolist()
        ends = [_levels(nodes, depth)[-1][0], _levels(nodes)[-1][0]]
        return pd.DataFrame([[rows["tree"].iloc[0], rows["block"].iloc[0], *ends]], columns=[*KEY, "whole", "single"])

    return _blocked(nodes, depth).groupBy(*KEY).applyInPandas(reduce, "tree string, block long, whole string, single string")


def _forest(nodes: DataFrame, depth: int, label: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """The nodes of every turn, and for every turn the (tree, digest) of the trees that end in it."""
    turns, roots = [nodes], []
    while True:
        blocks = stored(_reduced(turns[-1], depth), label)
        several = blocks.where("block > 0").select("tree").distinct()
        roots.append(blocks.join(several, "tree", "left_anti").select("tree", F.col("single").alias("digest")))
        more = blocks.join(several, "tree", "left_semi")
        if several.isEmpty():
            return turns, roots
        turns.append(more.select("tree", F.col("block").alias("pos"), F.col("whole").alias("digest")))


def _local(rows: pd.DataFrame, outer: pd.DataFrame, depth: int) -> tuple[list[list[str]], dict, Callable[[int], tuple[list[str], list[str]]]]:
    """A superblock's levels, its outer path, and a node's siblings before and after it at each local level."""
    path = outer.iloc[0].to_dict()
    levels = _levels(rows["digest"].tolist(), None if path["ends"] else depth)

    def siblings(at: int) -> tuple[list[str], list[str]]:
        before, after = [], []
        for level in levels[:-1]:
            start = at - at % ARITY
            before.append("".join(level[start:at]))
            after.append("".join(level[at + 1 : start + ARITY]))
            at //= ARITY
        return before, after

    return levels, path, siblings


def _outer_paths(nodes: DataFrame, outer: DataFrame, depth: int) -> DataFrame:
    """(tree, block, before, after, subroot): the path of every node, as a superblock of the turn below, up to the root."""

    def extend(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        _, path, siblings = _local(rows, outer, depth)
        made = []
        for i, (tree, pos) in enumerate(zip(rows["tree"], rows["pos"], strict=True)):
            before, after = siblings(i)
            made.append([tree, pos, [*before, *path["before"]], [*after, *path["after"]], path["subroot"]])
        return pd.DataFrame(made, columns=[*KEY, "before", "after", "subroot"])

    both = _blocked(nodes, depth).groupBy(*KEY).cogroup(outer.groupBy(*KEY))
    return both.applyInPandas(extend, f"tree string, block long, {PATH}")


def _ending(ended: DataFrame, paths: DataFrame | None) -> DataFrame:
    """The outer path of trees that end in one superblock: that of their subroot (none if there is no tree above)."""
    if paths is None:
        none = F.array().cast("array<string>")
        return ended.select("tree", F.lit(0).cast("long").alias("block"), none.alias("before"), none.alias("after"), F.col("digest").alias("subroot"), F.lit(True).alias("ends"))
    named = paths.select(F.col("name").alias("tree"), "before", "after")
    return ended.join(named, "tree").select("tree", F.lit(0).cast("long").alias("block"), "before", "after", F.col("digest").alias("subroot"), F.lit(True).alias("ends"))


def _descended(turns: list[DataFrame], roots: list[DataFrame], above: DataFrame | None, depth: int, label: str) -> DataFrame:
    """Outer paths of the superblocks of the first turn."""
    outer = None
    for turn in range(len(turns) - 1, -1, -1):
        here = _ending(roots[turn], above)
        if outer is not None:
            here = here.unionByName(outer.withColumn("ends", F.lit(False)))
        outer = here if turn == 0 else stored(_outer_paths(turns[turn], here, depth), label)
    return outer


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(tree, doc_id, leaf, given): a row's leaf and, where ``tampered`` holds, that of its text with A-Z in lower case."""
    head = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars")]
    text = F.col("text").cast("string")
    return docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest(*head, text).alias("leaf"), F.when(tampered, leaf_digest(*head, F.translate(text, UPPER, LOWER))).alias("given"),
    )


def fifth(doc_id: Column) -> Column:
    """Whether 5 divides the crc32 of the decimal id; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def manifest(docs: DataFrame, tampered: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of ``docs(doc_id, source, lang, n_chars, text)``.

    ``tampered`` says which rows are checked with their text in lower case (A-Z) instead of the original (none by default);
    ``proof_sha256`` is the digest of a leaf's siblings up to the root, ``folded_root`` what the checked leaf and these
    siblings give. A null source is a source of its own, the first one; other nulls are part of the leaf. Leaves ascend by
    ``doc_id``, null first, repeated ids by leaf, and equal rows stand side by side. Other columns are ignored, an empty
    table gives an empty result.
    """
    found = stored(leaves(docs, F.lit(False) if tampered is None else tampered), "leaves")
    placed = running_totals(
        found.withColumn("one", F.lit(1).cast("long")), ["tree"], [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), F.col("given").asc_nulls_first()], ["one"], "leaf-order"
    )
    placed = stored(placed.select("tree", F.col("before_one").cast("long").alias("pos"), F.col("doc_id").cast("string").alias("id"), F.col("leaf").alias("digest"), "given"), "placed-leaves")
    turns, roots = _forest(placed.select("tree", "pos", "digest"), depth, "subtrees")

    subroots = None
    for ended in roots:
        subroots = ended if subroots is None else subroots.unionByName(ended)
    ordered = running_totals(subroots.withColumn("one", F.lit(1).cast("long")), [], [F.col("tree").asc()], ["one"], "subroot-order")
    ordered = stored(ordered.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("before_one").cast("long").alias("pos"), "digest"), "subroots")
    tops, top_roots = _forest(ordered.select("tree", "pos", "digest"), depth, "top-subtrees")
    above = _descended(tops, top_roots, None, depth, "top-paths")
    paths = stored(_named_paths(ordered, above, depth), "subroot-paths")
    outer = stored(_descended(turns, roots, paths, depth, "paths"), "outer-nodes")
    (root,) = [r["digest"] for ended in top_roots for r in ended.collect()] or [""]  # one row, none for an empty table

    def finish(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        _, path, siblings = _local(rows, outer, depth)
        made = []
        for i, (name, leaf, given) in enumerate(zip(rows["id"], rows["digest"], rows["given"], strict=True)):
            before, after = siblings(i)
            before, after = [*before, *path["before"]], [*after, *path["after"]]
            folded = given if isinstance(given, str) else leaf
            for b, a in zip(before, after, strict=True):
                folded = digest(b + folded + a)
            proof = digest("".join(b + a for b, a in zip(before, after, strict=True)))
            made.append([name, leaf, path["subroot"], root, proof, folded, folded == root])
        return pd.DataFrame(made, columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    # ids travel as text: pandas has no nulls among integers
    both = _blocked(placed, depth).groupBy(*KEY).cogroup(outer.groupBy(*KEY))
    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    done = both.applyInPandas(finish, schema)
    return done.select(F.col("id").cast("long").alias("doc_id"), *done.columns[1:])


def _named_paths(ordered: DataFrame, outer: DataFrame, depth: int) -> DataFrame:
    """(name, before, after): the path of every subroot to the root."""

    def extend(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        _, path, siblings = _local(rows, outer, depth)
        found = [(name, *siblings(i)) for i, name in enumerate(rows["name"])]
        return pd.DataFrame([[n, [*b, *path["before"]], [*a, *path["after"]]] for n, b, a in found], columns=["name", "before", "after"])

    both = _blocked(ordered, depth).groupBy(*KEY).cogroup(outer.groupBy(*KEY))
    return both.applyInPandas(extend, "name string, before array<string>, after array<string>")
