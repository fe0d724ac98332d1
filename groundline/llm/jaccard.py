"""Exact Jaccard self-join on word shingles, to components, with signature trees.

Candidates. Under any one order of all shingles, two sets of similarity t share k shingles among the first
n - ceil(t * n) + k of each. The order puts shingles that many documents hold last, so prefixes hold rare ones; which
shingles count as frequent changes the work, never the result. With k = n // 12 + 1, a set of whose prefix fewer shingles
stand in any other prefix has no partner, which rules out documents that only quote the same passages. Equal sets
are one set from the start, and copies never multiply.

Blocks. The sets that share a prefix shingle form a block. First come the blocks of one shingle for each set, the least
under a few hashes in turn, which join most copies; then, for every shingle that still stands in several components, one
delegate of each component, a frequent shingle's dealt over several blocks; then all sets of the shingles that are left. Links inside a component are never needed
again, so a group of copies costs about one comparison for each member.

Leads. The first shingle that two linked sets share stands among the first n - ceil(2t / (1 + t) * n) + 1 of the smaller
one. A set is a lead of these shingles. In the last blocks every pair has a lead, and shingles without leads have no
block. The sets of a crowded shingle meet by bands of sizes, as leads on one side and all sets of the next sizes on the
other, so a template that many pages quote but don't begin with in that order costs nothing, and one with few leads a
row or two for each page.

Signature trees. In a block, leaves hold a set's token bitmap and size, inner nodes the OR of the bitmaps and the range of the
sizes. A dual traversal drops node pairs whose largest possible overlap is below the least overlap that their sizes
demand; the pairs of sets that remain are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.llm.components import components
from groundline.llm.segments import mixed, passes, shingle_sets, words
from groundline.llm.storage import partitions, stored

# A shingle is frequent when so many documents hold it; as many frequent shingles as this are told apart (8 MB).
FREQUENT, TOLD_APART = 16, 500_000
# Shingles that are counted together, and sets of one block.
WINDOW, BLOCK = 1_000_000, 1000
# Largest list of ids that is sent to all tasks.
BROADCAST_IDS = 4_000_000
FAN_OUT = 4
# Linked sets share n // SHARED_PART + 1 shingles of their prefixes, n the smaller size.
SHARED_PART = 12
# Turns of the blocks of one shingle for each set, and most turns of delegates.
FIRST_TURNS, DELEGATE_TURNS = 3, 3
# Pairs for each set above which a block is compared as a whole.
PAIRS_FOR_EACH = 4


def _set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit id of each set; equal sets have equal ids."""
    sums = np.fromiter((mixed(s).sum(dtype=np.uint64) for s in sets), np.uint64, len(sets))
    return mixed(sums ^ (np.fromiter(map(len, sets), np.uint64, len(sets)) << np.uint64(40))).view(np.int64)


def _read(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray]]:
    for batch in passes(batches):
        sets = shingle_sets(*words(batch.column("text")), size)
        yield batch, sets, _set_ids(sets)


def _distinct(reader, most: int) -> Iterator[tuple[list[np.ndarray], list[int]]]:
    """Windows of sets with about ``most`` shingles together, each set once in a window, empty ones never."""
    sets, ids, seen, held = [], [], set(), 0
    for _, found, names in reader:
        for s, name in zip(found, names.tolist(), strict=True):
            if len(s) and name not in seen:
                seen.add(name)
                sets.append(s)
                ids.append(name)
                held += len(s)
                if held >= most:
                    yield sets, ids
                    sets, ids, seen, held = [], [], set(), 0
    if sets:
        yield sets, ids


# --- signature trees ---------------------------------------------------------------------------------------------


def bitmap(shingles: np.ndarray) -> bytes:
    """Token bitmap of a set, at most half full."""
    width = 64
    while width < 2 * len(shingles) and width < 65_536:
        width *= 2
    bits = np.zeros(width, bool)
    bits[(shingles & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _of_one_width(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words; a narrower one repeats, so that every common token still has a common bit."""
    width = max(map(len, bitmaps))
    return np.array([np.frombuffer(b * (width // len(b)), np.uint64) for b in bitmaps])


class _Level:
    """Nodes of one level: OR of the bitmaps, least and largest size, most set members that share bits, and the
    component when it is one (-1 otherwise)."""

    def __init__(self, bits, low, high, excess, label):
        self.bits, self.low, self.high, self.excess, self.label = bits, low, high, excess, label

    def above(self) -> _Level:
        starts = np.arange(0, len(self.low), FAN_OUT)
        least, most = np.minimum.reduceat(self.label, starts), np.maximum.reduceat(self.label, starts)
        return _Level(
            np.bitwise_or.reduceat(self.bits, starts, axis=0), np.minimum.reduceat(self.low, starts), np.maximum.reduceat(self.high, starts),
            np.maximum.reduceat(self.excess, starts), np.where(least == most, least, -1),
        )

    def possible(self, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which node pairs may hold two sets of similarity num / den that aren't in one component."""
        one = (self.label[i] >= 0) & (self.label[i] == self.label[j])
        small, large = np.minimum(self.high[i], self.high[j]), np.maximum(self.low[i], self.low[j])
        keep = ~one & (den * small >= num * large)
        step = max(1, 4_000_000 // (8 * self.bits.shape[1]))
        for start in range(0, len(i), step):
            part = np.flatnonzero(keep[start : start + step]) + start
            a, b = i[part], j[part]
            shared = np.bitwise_count(self.bits[a] & self.bits[b]).sum(axis=1, dtype=np.int64)
            bound = np.minimum(small[part], shared + np.minimum(self.excess[a], self.excess[b]))
            keep[part] = (num + den) * bound >= num * (self.low[a] + self.low[b])
        return keep


def candidate_pairs(bitmaps: list[bytes], sizes: np.ndarray, labels: np.ndarray, num: int = 3, den: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that the dual traversal of their signature tree can't rule out, those with the likest bitmaps first; best
    with neighbours by size."""
    ones = np.array([np.bitwise_count(np.frombuffer(b, np.uint8)).sum() for b in bitmaps], np.int64)
    levels = [_Level(_of_one_width(bitmaps), sizes, sizes, sizes - ones, labels)]
    while len(levels[-1].low) > FAN_OUT:
        levels.append(levels[-1].above())
    i, j = np.triu_indices(len(levels[-1].low))
    for depth in range(len(levels) - 1, 0, -1):
        keep = levels[depth].possible(i, j, num, den) | ((i == j) & (levels[depth].label[i] < 0))
        i, j = i[keep], j[keep]
        a, b = np.meshgrid(np.arange(FAN_OUT), np.arange(FAN_OUT), indexing="ij")
        i, j = (i[:, None] * FAN_OUT + a.ravel()).ravel(), (j[:, None] * FAN_OUT + b.ravel()).ravel()
        inside = (i <= j) & (j < len(levels[depth - 1].low))
        i, j = i[inside], j[inside]
    apart = i != j
    i, j = i[apart], j[apart]
    keep = levels[0].possible(i, j, num, den)
    i, j = i[keep], j[keep]
    bits, likeness = levels[0].bits, np.zeros(len(i))
    step = max(1, 4_000_000 // (8 * bits.shape[1]))
    for start in range(0, len(i), step):
        a, b = i[start : start + step], j[start : start + step]
        either = np.bitwise_count(bits[a] | bits[b]).sum(axis=1)
        likeness[start : start + step] = np.bitwise_count(bits[a] & bits[b]).sum(axis=1) / np.maximum(either, 1)
    order = np.argsort(-likeness, kind="stable")
    return i[order], j[order]


def block_links(ids: list[int], sets: list[np.ndarray], labels: list[int], num: int = 3, den: int = 4, center: int | None = None) -> list[tuple[int, int]]:
    """Links that join all sets of a block as their similarity does, with the given components joined beforehand. Of a star,
    whose ``center`` is one of the ids, only the pairs with the center are compared."""
    order = sorted(range(len(ids)), key=lambda r: (len(sets[r]), ids[r]))
    ids, sets, labels = [ids[r] for r in order], [sets[r] for r in order], [labels[r] for r in order]
    names: dict[int, int] = {}
    parent = [names.setdefault(label, row) for row, label in enumerate(labels)]
    left = len(names)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []

    def compare(x: int, y: int) -> None:
        nonlocal left
        a, b = root(x), root(y)
        if a == b:
            return
        small, large = sets[x], sets[y]
        at = np.searchsorted(large, small)
        at[at == len(large)] = 0
        both = int((large[at] == small).sum())
        if den * both >= num * (len(small) + len(large) - both):
            parent[max(a, b)] = min(a, b)
            left -= 1
            links.append((ids[x], ids[y]))

    if center is not None:
        middle = ids.index(center)
        for x in range(len(ids)):
            if x != middle:
                compare(min(x, middle), max(x, middle))
        return links
    if len(ids) > 16:  # neighbours by size, and one set with all others, join most copies before the traversal
        middle = len(ids) // 2
        for x in range(len(ids)):
            if x != middle:
                compare(min(x, middle), max(x, middle))
    if left > 1:
        roots, sizes = np.array([root(x) for x in range(len(ids))]), np.fromiter(map(len, sets), np.int64, len(sets))
        pairs = candidate_pairs([bitmap(x) for x in sets], sizes, roots, num, den)
        for x, y in zip(*(p.tolist() for p in pairs), strict=True):
            if left == 1:
                break
            compare(x, y)
    return links


# --- the join ----------------------------------------------------------------------------------------------------


def _described(docs: DataFrame, size: int) -> DataFrame:
    """kind 0: (doc_id, size and id of its set); kind 1: a shingle with its number of sets, where a window has two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []

        def reader():
            for batch, sets, ids in _read(batches, size):
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                rows.append(_rows(0, batch.column("doc_id"), n, ids))
                yield batch, sets, ids

        for sets, _ in _distinct(reader(), WINDOW):
            yield from rows
            rows.clear()
            shingles, counts = np.unique(np.concatenate(sets), return_counts=True)
            often = counts > 1
            yield _rows(1, pa.nulls(int(often.sum()), pa.int64()), counts[often], shingles[often].view(np.int64))
        yield from rows

    return docs.mapInArrow(run, "kind int, doc_id long, n long, id long")


def _rows(kind: int, doc_id: pa.Array, n: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(n), kind, np.int32)), doc_id, pa.array(n.astype(np.int64)), pa.array(ids)], names=["kind", "doc_id", "n", "id"]
    )


def _frequent(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent shingles and their classes (log2 of the count); at most ``TOLD_APART``, the most frequent ones."""
    sums = stored(
        counted.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
        .select("id", F.floor(F.log2("n")).cast("int").alias("class")), "shingle-counts"
    )
    least, room = 64, TOLD_APART
    for row in sums.groupBy("class").count().orderBy(F.desc("class")).collect():  # one row for each power of two
        if row["count"] > room:
            break
        least, room = row["class"], room - row["count"]
    kept = sums.where(F.col("class") >= least).toArrow()
    ids, classes = kept["id"].to_numpy().view(np.uint64), kept["class"].to_numpy().astype(np.int8)
    order = np.argsort(ids)
    return ids[order], classes[order]


def _postings(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], size: int, num: int, den: int, slices: int) -> DataFrame:
    """Prefix shingles of all sets: frequent ones in rows of their own, of kind 3 where the set is a lead and 1 elsewhere; kind 2 all
    others, packed by slice of the shingles' range: the number of leads, the leads, the rest."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, classes = shared.value
        for sets, ids in _distinct(_read(batches, size), WINDOW):
            flat = np.concatenate(sets)
            ranks = np.zeros(len(flat), np.int8)
            if len(often):
                at = np.minimum(np.searchsorted(often, flat), len(often) - 1)
                hit = often[at] == flat
                ranks[hit] = classes[at[hit]]
            ends = np.cumsum([len(s) for s in sets])
            prefix, prefix_ranks, lengths, leads = [], [], [], []
            for s, end in zip(sets, ends.tolist(), strict=True):
                n = len(s)
                length, rank = n - -(-num * n // den) + n // SHARED_PART + 1, ranks[end - n : end]
                order = np.argsort(rank, kind="stable")[:length] if rank.any() else slice(0, length)
                prefix.append(s[order])
                prefix_ranks.append(rank[order])
                lengths.append(length)
                leads.append(np.arange(length) <= n - -(-2 * num * n // (num + den)))
            lengths = np.array(lengths)
            shingle, rank, owner, lead = np.concatenate(prefix), np.concatenate(prefix_ranks), np.repeat(np.array(ids, np.int64), lengths), np.concatenate(leads)
            for kind, chosen in ((1, (rank > 0) & ~lead), (3, (rank > 0) & lead)):
                yield _packed(kind, shingle[chosen], owner[chosen])
            shingle, owner, lead = shingle[rank == 0], owner[rank == 0], lead[rank == 0]
            order = np.argsort(shingle)
            shingle, owner, lead = shingle[order], owner[order], lead[order]
            step = np.uint64((1 << 64) // slices + 1)
            part = (shingle // step).astype(np.int64)
            bounds = np.searchsorted(part, np.arange(slices + 1))
            full = np.flatnonzero(np.diff(bounds))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(full), 2, np.int32)), pa.array(full), pa.nulls(len(full), pa.int64()),
                pa.array([_joined_bytes(*(x[bounds[p] : bounds[p + 1]] for x in (shingle, owner, lead))) for p in full.tolist()], pa.binary()),
            ], names=["kind", "shingle", "id", "packed"])

    return docs.mapInArrow(run, "kind int, shingle long, id long, packed binary")


def _joined_bytes(shingle: np.ndarray, owner: np.ndarray, lead: np.ndarray) -> bytes:
    first = np.argsort(~lead, kind="stable")
    return np.array([lead.sum()], np.int64).tobytes() + shingle[first].tobytes() + owner[first].tobytes()


def _parted(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(content) // 16
    return np.frombuffer(content, np.uint64, n, 8), np.frombuffer(content, np.int64, n, 8 + 8 * n), np.arange(n) < np.frombuffer(content, np.int64, 1)[0]


def _packed(kind: int, shingle: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
    n = len(shingle)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(shingle.view(np.int64)), pa.array(owner), pa.nulls(n, pa.binary())],
        names=["kind", "shingle", "id", "packed"],
    )


def _shared(packed: DataFrame, slices: int) -> DataFrame:
    """(shingle, id, lead) of all rarer shingles that stand in the prefixes of two sets or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(parts: list[bytes]) -> pa.RecordBatch:
            shingle, owner, lead = (np.concatenate(x) for x in zip(*map(_parted, parts), strict=True))
            order = np.argsort(shingle, kind="stable")
            shingle, owner, lead = shingle[order], owner[order], lead[order]
            same = np.zeros(len(shingle) + 1, bool)
            same[1:-1] = shingle[1:] == shingle[:-1]
            twice = same[1:] | same[:-1]
            shingle, owner, lead = shingle[twice], owner[twice], lead[twice]
            order = np.lexsort((owner, shingle))
            shingle, owner, lead = shingle[order], owner[order], lead[order]
            new = np.ones(len(shingle), bool)
            new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
            shingle, owner, lead = shingle[new], owner[new], lead[new]
            same = np.zeros(len(shingle) + 1, bool)
            same[1:-1] = shingle[1:] == shingle[:-1]
            twice = same[1:] | same[:-1]
            return pa.RecordBatch.from_arrays([pa.array(shingle[twice].view(np.int64)), pa.array(owner[twice]), pa.array(lead[twice])], names=["shingle", "id", "lead"])

        now, parts = None, []
        for batch in batches:
            for number, content in zip(batch.column("shingle").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if number != now and parts:
                    yield finish(parts)
                    parts = []
                now = number
                parts.append(content)
        if parts:
            yield finish(parts)

    dealt = packed.select("shingle", "packed").repartition(slices, "shingle").sortWithinPartitions("shingle")
    return dealt.mapInArrow(run, "shingle long, id long, lead boolean")


def _small(ids: DataFrame) -> DataFrame:
    """A stored list of ids, for broadcast when it is small enough; else both sides are shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _with_partners(shared: DataFrame, sets: DataFrame, num: int, den: int, turns: int = 2) -> DataFrame:
    """``shared`` without the sets that have too few shared shingles for any partner, and without shingles left alone.

    A partner of a set of n has at least ceil(num * n / den) shingles. Dropping a set may leave others without
    partners, hence the ``turns``.
    """
    least = F.floor(F.ceil(F.col("n") * num / den) / SHARED_PART) + 1
    needs = sets.select(F.col("id").alias("__id"), least.alias("least"))
    for _ in range(turns):
        held = shared.groupBy("id").count().join(needs, F.col("id") == F.col("__id")).where("count >= least").select("id")
        shared = shared.join(_small(stored(held, "partner-ids")), "id", "left_semi")
        twice = shared.groupBy("shingle").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("shingle")
        shared = stored(shared.join(twice, "shingle", "left_semi"), "prefix-partners")
    return shared


def _contents(docs: DataFrame, sets: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """(id, n, bitmap, packed): size, bitmap and shingles of the ``needed(id)`` sets, each from one document that has it."""
    chosen = stored(needed.join(sets, "id").select("doc_id").distinct(), "set-owners")
    mine = docs.join(_small(chosen), docs["doc_id"].eqNullSafe(chosen["doc_id"]), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets, ids in _distinct(_read(batches, size), 500_000):
            columns = [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *[pa.array([f(s) for s in sets], pa.binary()) for f in (bitmap, np.ndarray.tobytes)]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "bitmap", "packed"])

    # a set may come from several documents of one id
    return mine.mapInArrow(run, "id long, n long, bitmap binary, packed binary").join(needed, "id", "left_semi")


def _links(members: DataFrame, contents: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links of all blocks of ``members(block, id, label, center)``; a block with a center is a star."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(rows: dict[int, tuple[int, bytes]], center: int | None) -> list[tuple[int, int]]:
            if len(rows) < 2:
                return []
            return block_links(list(rows), [np.frombuffer(p, np.uint64) for _, p in rows.values()], [label for label, _ in rows.values()], num, den, center)

        found: list[tuple[int, int]] = []
        now, rows, middle = None, {}, None
        for batch in batches:
            for block, name, label, center, content in zip(*(batch.column(c).to_pylist() for c in ("block", "id", "label", "center", "packed")), strict=True):
                if block != now:
                    found += finish(rows, middle)
                    now, rows, middle = block, {}, None
                rows[name] = (label, content)
                if center:
                    middle = name
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])
                found = []
        found = finish(rows, middle)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return _dealt(members, contents.select("id", "packed")).mapInArrow(run, "a long, b long")


def _dealt(members: DataFrame, contents: DataFrame) -> DataFrame:
    """The members with what their sets hold, block by block."""
    return members.join(contents, "id").repartition(partitions(members.sparkSession), "block").sortWithinPartitions("block")


def _traversed(members: DataFrame, contents: DataFrame, num: int, den: int, schema: str, found_in) -> DataFrame:
    """What ``found_in`` makes of each block of ``members(block, id, label)`` with candidate pairs of different labels: it gets
    the block, ids, labels as small numbers, labels, and both sides of the pairs, best pairs first. With a column ``lead``,
    pairs whose smaller set is no lead are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(block: int, rows: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
            if len(rows) < 2:
                return
            ordered = sorted(rows.items(), key=lambda r: (r[1][1], r[0]))
            names, labels = [r[0] for r in ordered], [r[1][0] for r in ordered]
            numbers: dict[int, int] = {}
            number = np.array([numbers.setdefault(x, len(numbers)) for x in labels])
            bitmaps = [r[1][2] for r in ordered]
            sizes, leads = np.array([r[1][1] for r in ordered], np.int64), np.array([r[1][3] for r in ordered])
            i, j = candidate_pairs(bitmaps, sizes, number, num, den)
            led = leads[i] | (leads[j] & (sizes[i] == sizes[j]))
            i, j = i[led], j[led]
            if len(i):
                yield found_in(block, names, number, labels, i, j)

        now, rows = None, {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "id", "label", "n", "bitmap")]
            leads = batch.column("lead").to_pylist() if "lead" in batch.schema.names else [True] * batch.num_rows
            for block, name, label, n, bits, lead in zip(*columns, leads, strict=True):
                if block != now:
                    yield from finish(now, rows)
                    now, rows = block, {}
                rows[name] = (label, n, bits, lead or (name in rows and rows[name][3]))
        yield from finish(now, rows)

    return _dealt(members, contents.select("id", "n", "bitmap")).mapInArrow(run, schema)


def _forest(block: int, names: list[int], number: np.ndarray, labels: list[int], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """(a, b), a < b: as many pairs as join all labels that candidate pairs join, so at most one for each label."""
    parent = list(range(int(number.max()) + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    pairs = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = root(number[x]), root(number[y])
        if a != b:
            parent[b] = a
            pairs.append((min(names[x], names[y]), max(names[x], names[y])))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], names=["a", "b"])


def _compared(block: int, names: list[int], number: np.ndarray, labels: list[int], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """(block, id, dense): what is to be compared. A few pairs are stars, blocks named by one of their sets; where most
    sets pair with most others, the block itself with the sets that are in pairs."""
    rows = np.unique(np.concatenate([i, j]))
    ids = np.array(names)
    dense = len(i) > PAIRS_FOR_EACH * len(rows)
    first, second = (np.full(len(rows), block), ids[rows]) if dense else (np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]))
    return pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(np.full(len(first), dense))], names=["block", "id", "dense"])


def _salted(key: str, name: str, count: Column, turn: int = 0) -> Column:
    """The block of a row with ``count`` others of its ``key``: one block for about ``BLOCK`` of them, dealt by ``name``."""
    salt = F.pmod(F.xxhash64(name, F.lit(turn)), F.ceil(count / BLOCK).cast("long"))
    return F.xxhash64(key, salt)


def _crowded(rows: DataFrame, key: str) -> DataFrame:
    """(__key, count) of the keys with more than ``BLOCK`` rows, for a left join; few, as each stands for so many rows."""
    counts = rows.groupBy(F.col(key).alias("__key")).count().where(F.col("count") > BLOCK)
    return _small(stored(counts, "crowded"))


def _delegates(rows_open: DataFrame, count: Column, turn: int) -> DataFrame:
    """(block, id, label): one delegate of each component that holds a shingle, in blocks of about ``BLOCK`` rows at most."""
    named = stored(rows_open.groupBy("shingle", "label").agg(F.min("id").alias("id"), F.max(count > BLOCK).alias("many")), "blocks")
    dealt = named.join(_crowded(named.where("many"), "shingle"), F.col("shingle") == F.col("__key"), "left")
    return dealt.select(_salted("shingle", "id", F.coalesce("count", F.lit(1)), turn).alias("block"), "id", "label")


def _stars(pairs: DataFrame) -> DataFrame:
    """(block, id, center): every ``a`` of ``pairs(a, b)`` as the center of blocks with about ``BLOCK`` of its partners at most."""
    dealt = pairs.join(_crowded(pairs, "a"), F.col("a") == F.col("__key"), "left")
    dealt = dealt.select(_salted("a", "b", F.coalesce("count", F.lit(1))).alias("block"), "a", "b")
    partners = dealt.select("block", F.col("b").alias("id"), F.lit(False).alias("center"))
    return partners.unionByName(dealt.select("block", F.col("a").alias("id"), F.lit(True).alias("center")).distinct())


def _one_for_each(members: DataFrame) -> DataFrame:
    """Blocks that hold the same sets, once."""
    names = [c for c in ("id", "lead") if c in members.columns]
    signs = members.groupBy("block").agg(F.sum(F.xxhash64(*names).cast("decimal(38,0)")).alias("sign"), F.count("*").alias("n"))
    return members.join(signs.groupBy("sign", "n").agg(F.min("block").alias("block")).select("block"), "block")


def _open_rows(shared: DataFrame, labels: DataFrame) -> tuple[DataFrame, Column]:
    """(shingle, id, lead, label, count) of the shingles that stand in several components and have leads, and the column of their count."""
    labelled = shared.join(labels, "id")
    spread = labelled.groupBy("shingle").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("count"), F.max("lead").alias("led"))
    return labelled.join(spread.where("least <> most and led").select("shingle", "count"), "shingle"), F.col("count")


def _last_blocks(rows_open: DataFrame, sizes: DataFrame, ratio: float) -> DataFrame:
    """(block, id, label, lead): blocks in which all pairs of different labels meet that can link, the smaller set as a lead.

    A shingle with at most ``BLOCK`` sets is one block. Of others, the leads of a band of sizes meet the sets of this band and the
    next one, dealt in parts when there are many of both. The label that most leads of a band have never meets itself.
    """
    plain = rows_open.where(F.col("count") <= BLOCK).select(F.xxhash64("shingle").alias("block"), "id", "label", "lead")
    # somewhat wider than the ratio of the sizes of linked sets, so rounding can't put two of them further apart
    band = F.floor(F.log(F.col("n")) / math.log(1.01 * ratio))
    crowded = stored(rows_open.where(F.col("count") > BLOCK).join(sizes, "id").select("shingle", "id", "label", "lead", band.alias("band")), "crowded-rows")
    labels = crowded.where("lead").groupBy("shingle", "band", "label").count()
    main = labels.groupBy(F.col("shingle").alias("__shingle"), F.col("band").alias("__band")).agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    main = _small(stored(main, "main-labels"))
    met = crowded.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1))).withColumn("lead", F.lit(False))
    sides = crowded.where("lead").unionByName(met).join(main, (F.col("shingle") == F.col("__shingle")) & (F.col("band") == F.col("__band")))
    own = F.col("label") == F.col("main")
    kinds = F.when(F.col("lead"), F.array(own)).when(own, F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False)))
    sides = stored(sides.select(F.xxhash64("shingle", "band").alias("group"), F.explode(kinds).alias("main"), "id", "label", "lead"), "sides")
    parts = lambda lead: F.ceil(F.count_if(F.col("lead") == F.lit(lead)) / BLOCK).cast("long")
    counts = sides.groupBy(F.col("group").alias("__group"), F.col("main").alias("__main")).agg(parts(True).alias("leads"), parts(False).alias("others"))
    counts = _small(stored(counts.where("leads > 0 and others > 0"), "side-counts"))
    dealt = sides.join(counts, (F.col("group") == F.col("__group")) & (F.col("main") == F.col("__main")))
    mine, other = F.when(F.col("lead"), F.col("leads")).otherwise(F.col("others")), F.when(F.col("lead"), F.col("others")).otherwise(F.col("leads"))
    dealt = dealt.withColumns({"mine": F.pmod(F.xxhash64("id"), mine), "other": F.explode(F.sequence(F.lit(0).cast("long"), other - 1))})
    first, second = F.when(F.col("lead"), F.col("mine")).otherwise(F.col("other")), F.when(F.col("lead"), F.col("other")).otherwise(F.col("mine"))
    return plain.unionByName(dealt.select(F.xxhash64("group", "main", first, second).alias("block"), "id", "label", "lead"))


def _joined(ids: DataFrame, links: DataFrame | None, labels: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links with the new ones, and (id, label): the component of every set."""
    found = stored(found, "links")
    if found.isEmpty():
        return (found if links is None else links), labels
    links = found if links is None else links.unionByName(found)
    named = components(links)
    named = ids.join(named, ids["id"] == named["node"], "left").select("id", F.coalesce("component", "id").alias("label"))
    return links, stored(named, "labels")


def similar_components(docs: DataFrame, similarity: Fraction = Fraction(3, 4), size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of ``docs(doc_id, text)``.

    Words are runs without blanks, A-Z lower-cased; a document's set holds its distinct runs of ``size`` words, the whole
    sequence when it has fewer, nothing without words. Two documents link at a Jaccard similarity of ``similarity`` or
    more; empty sets link with nothing. ``component_id`` is the smallest ``doc_id`` reachable by links. Null texts are empty, a
    null ``doc_id`` is kept (and names a component only if it has no other), repeated rows are kept, other columns are
    ignored, an empty table gives an empty result. Shingles are compared as 64-bit hashes.
    """
    num, den = similarity.numerator, similarity.denominator
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slices = partitions(docs.sparkSession)
    described = stored(_described(docs, size), "sets")
    rows = described.where("kind = 0").select("doc_id", "n", "id")
    sets = stored(rows.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")), "set-list")
    frequent = _frequent(described.where("kind = 1"))

    postings = _postings(docs, frequent, size, num, den, slices)
    often = postings.where("kind <> 2").select("shingle", "id", (F.col("kind") == 3).alias("lead")).distinct()
    shared = _with_partners(stored(_shared(postings.where("kind = 2"), slices).unionByName(often), "prefix-shared"), sets, num, den)

    ids = stored(shared.select("id").distinct(), "partner-ids")
    contents = stored(_contents(docs, sets, ids, size), "set-contents")
    labels = ids.withColumn("label", F.col("id"))
    links = None
    for turn in range(FIRST_TURNS):
        chosen = shared.groupBy("id").agg(F.min_by("shingle", F.xxhash64("shingle", F.lit(turn))).alias("shingle"))
        members = chosen.join(labels, "id").groupBy("shingle", "label").agg(F.min("id").alias("id"))
        counts = members.groupBy("shingle").count().where("count > 1")
        # a frequent shingle has several blocks
        blocks = members.join(counts, "shingle").select(_salted("shingle", "id", F.col("count")).alias("block"), "id", "label", F.lit(False).alias("center"))
        links, labels = _joined(ids, links, labels, _links(blocks, contents, num, den))

    for turn in range(DELEGATE_TURNS):
        blocks = _delegates(*_open_rows(shared, labels), turn)
        pairs = stored(_traversed(_one_for_each(blocks), contents, num, den, "a long, b long", _forest).distinct(), "pairs")
        before = labels
        links, labels = _joined(ids, links, labels, _links(_stars(pairs).join(labels, "id"), contents, num, den))
        if labels is before:
            break

    rows_open, _ = _open_rows(shared, labels)
    blocks = _last_blocks(rows_open, contents.select("id", "n"), den / num)
    compared = stored(_traversed(_one_for_each(stored(blocks, "blocks")), contents, num, den, "block long, id long, dense boolean", _compared), "compared")
    pairs = stored(compared.where("not dense").select(F.col("block").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    members = _stars(pairs).unionByName(_one_for_each(compared.where("dense").select("block", "id")).withColumn("center", F.lit(False)))
    links, labels = _joined(ids, links, labels, _links(members.join(labels, "id"), contents, num, den))

    names = labels.select(F.col("id").alias("__id"), "label")
    whole = rows.join(names, rows["id"] == names["__id"], "left").select("doc_id", "n", F.coalesce("label", "id").alias("label"))
    least = whole.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    joined = whole.join(least, "label", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, similarity: Fraction = Fraction(3, 4), size: int = 5) -> DataFrame:
    """``docs`` without near copies: of each component the row with the smallest ``doc_id`` stays, with all its columns.

    Of rows that repeat both id and text one stays. Rows without words and rows without ``doc_id`` all stay.
    """
    found = stored(similar_components(docs, similarity, size), "components")
    extra = found.where("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct()
    again = found.where("n_shingles > 0 and doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    marked = extra.withColumn("gone", F.lit(True)).unionByName(again.withColumn("gone", F.lit(False)))
    marked = marked.groupBy(F.col("doc_id").alias("__id")).agg(F.max("gone").alias("__gone"))
    marked = stored(marked, "copies")
    joined = docs.join(_small(marked), docs["doc_id"] == F.col("__id"), "left")
    kept = joined.where("__gone is null").select(*docs.columns)
    return kept.unionByName(joined.where("not __gone").select(*docs.columns).dropDuplicates(["doc_id", "text"]))
