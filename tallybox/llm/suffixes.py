"""Prefix-partitioned suffix trees over word sequences.

A suffix is a text from some word on, cut after `depth` words: a node deeper than that says no more about who repeats it. It is
spelled in `LETTERS` letters, each the hash of a stretch of its words, so a prefix of j letters is a prefix of j stretches of words,
and two suffixes that agree in all letters share `depth` words.

Only suffixes of one *anchor* can be equal: the anchor is the least hash among the `shingle`-word runs of the suffix (the
leftmost of equals), which equal suffixes share. So anchors that occur too rarely rule their suffixes out before any is spelled.

`deep_nodes` splits suffixes by variable-length prefixes. Those of an anchor with at most `GROUP` branches are parted by their first
letter. For the others prefixes are counted, and a suffix takes the shortest prefix that at most `GROUP` suffixes share. Prefixes are
packed into groups of about `PACK` suffixes. Each group builds its subtrees: its suffixes in order, the prefix that each shares with
the one before it, and from these the internal nodes, of which those of full depth are read. Suffixes of a prefix that no
length makes small enough are equal in all but their last letter, or in all: their nodes are counted with map-side sums, so no
task ever holds more than a group, however often a passage occurs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybox.llm.common import cut, few, span_hashes

LETTERS = 5
#: Suffixes that may share a prefix within a group.
GROUP = 5_000
#: Suffixes of a group, which holds many prefixes.
PACK = 200_000


def letter_names(depth: int) -> list[str]:
    return [f"l{i}" for i in range(min(LETTERS, depth))]


def spell(words: np.ndarray, start: np.ndarray, depth: int) -> list[np.ndarray]:
    """The letters of the suffixes at `start`, one array for each letter."""
    n = min(LETTERS, depth)
    cuts = [round(depth * i / n) for i in range(n + 1)]
    return [span_hashes(words, start + a, start + b).view(np.int64) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def window_anchors(words: np.ndarray, first: np.ndarray, window: int, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of whole windows, the place of each one's anchor, shingle hashes by place); places count the batch's words."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - shingle + 1)
    value = span_hashes(words, at, at + shingle)
    best, where, width, need = value.copy(), at.copy(), 1, window - shingle + 1
    while width < need:
        step = min(width, need - width)
        a, b = best[:len(best) - step], best[step:]
        later = b < a
        best, where, width = np.where(later, b, a), np.where(later, where[step:], where[:len(where) - step]), width + step
    row = np.searchsorted(first, np.arange(len(where)), "right") - 1
    whole = np.flatnonzero(np.arange(len(where)) + window <= first[row + 1])
    return whole, where[whole], value


def internal_nodes(shared: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges [lo, hi) of ordered suffixes under each internal node of a depth or deeper; shared[i]: letters that i shares with i - 1."""
    inside = np.concatenate([[0], (shared[1:] >= depth).astype(np.int8), [0]])
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1) + 1


def subtrees(anchor: np.ndarray, letters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the suffixes, lo, hi): those at order[lo:hi] are under an internal node of full depth."""
    keys = [anchor, *letters]
    order = np.lexsort(keys[::-1])
    same = np.ones(len(order), bool)
    same[:1] = False
    shared = np.zeros(len(order), np.int8)
    for k, key in enumerate(keys):
        key = key[order]
        same[1:] &= key[1:] == key[:-1]
        if k:
            shared += same
    return order, *internal_nodes(shared, len(letters))


def _subtrees(n: int):
    """Of a group's suffixes, those under an internal node of full depth that weighs their `least` or more."""
    def run(group):
        import pyarrow as pa

        group = group.combine_chunks()
        order, lo, hi = subtrees(group.column("anchor").to_numpy(), [group.column(f"l{i}").to_numpy() for i in range(n)])
        weight = np.concatenate([[0.0], np.cumsum(group.column("weight").to_numpy()[order])])
        total = weight[hi] - weight[lo]
        size = hi - lo
        at = order[np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
        at = at[np.repeat(total, size) > group.column("least").to_numpy()[at] - 0.5]
        return group.select(["_k1", "_k2", "s"]).take(pa.array(at))
    return run


def _packed_subtrees(suffixes: DataFrame, n: int, total: int) -> DataFrame:
    """`suffixes` with the column `prefix`, in groups of about PACK."""
    group = F.pmod("prefix", F.lit(max(1, -(-total // PACK)))).alias("part")
    rows = suffixes.select(group, "anchor", *[f"l{i}" for i in range(n)], "_k1", "_k2", "s", "weight", "least")
    return rows.groupBy("part").applyInArrow(_subtrees(n), "_k1 long, _k2 long, s int")


def deep_nodes(suffixes: DataFrame, depth: int, total: int) -> DataFrame:
    """(_k1, _k2, s) of suffixes under a node of full depth that weighs `least`.

    `suffixes`: anchor long, the letters, _k1, _k2 long, s int, weight double, least double, of anchors with at most GROUP
    branches; there are about `total`."""
    names = letter_names(depth)
    return _packed_subtrees(suffixes.withColumn("prefix", F.xxhash64("anchor", names[0])), len(names), total)


def deep_nodes_of_frequent(suffixes: DataFrame, depth: int) -> DataFrame:
    """The same for anchors with more branches."""
    names = letter_names(depth)
    n = len(names)
    rows = cut(suffixes)
    total = rows.count()
    prefix = F.lit(None).cast("long")
    for j in range(n - 1, 0, -1):
        key = F.xxhash64("anchor", *names[:j])
        large = few(rows.groupBy(key.alias("large")).agg(F.count("*").alias("c")).filter(F.col("c") > GROUP).select("large"))
        rows = rows.join(large, key == F.col("large"), "left").withColumn("small", F.col("large").isNull()).drop("large")
        prefix = F.when(F.col(f"small{j}"), key).otherwise(prefix)
        rows = rows.withColumnRenamed("small", f"small{j}")
    rows = cut(rows.select("*", prefix.alias("prefix")).drop(*[f"small{j}" for j in range(1, n)]))
    parted = _packed_subtrees(rows.filter("prefix is not null"), n, total)
    equal = rows.filter("prefix is null")
    nodes = few(equal.groupBy("anchor", *names).agg(F.sum("weight").alias("total")).filter("total > 1.5"))
    counted = equal.join(nodes, ["anchor", *names]).filter("total > least - 0.5").select("_k1", "_k2", "s")
    return parted.union(counted)
