"""Source divergence audit: how far the word counts of sources of one language lie apart, and by which terms.

Terms are letter runs, A-Z lower-cased. A language keeps the terms that `min_docs` of its documents hold. A group is one
(language, source); its p of a kept term is 1 + floor(SCALE * (count + 2) / (N + 2 V)), N its count of kept terms, V their number. Two p's lie
floor((p - q)^2 / (p + q)) apart. All of it is in integers.

A language's terms are dealt to blocks by their hash, so that a block holds few enough cells (groups times terms) for one task. Over the term ids of a block each
group has a segment tree of its counts. Trees are hash-consed from the leaves up: equal count subtrees, of whatever group and place, are one node, so the
long stretches that a small source lacks are one node for each size. Two groups' trees are walked together, level by level: a frontier holds each pair of nodes once, with the
number of times it stands, so equal pairs are expanded and priced once. What a pair of groups is worth in a block is summed over blocks, and no task sees a
whole vocabulary, however long.

Counts are made in tasks that sum their own documents first, and then by term; the most frequent word of the largest source is a row from each task.
Work and result of the pairs grow with the square of the sources of a language, as their rows do.

Null text, language or source count as ''. A group without terms has pairs, as every occurring group, and no terms; where V = 0 all values are 0. Rows are documents, repeated ones count
each time. Texts of any length are whole. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybox.llm.common import by_size, few, written

SCALE = 1_000_000_000
#: Term ids of a block at most, about, and its cells: groups of the language times terms.
BLOCK_TERMS, BLOCK_CELLS = 1_024, 1 << 21
#: Pairs of nodes in a frontier at most, about.
FRONTIER = 1 << 20
#: Distinct terms that a counting task holds before it hands them on.
HELD = 200_000
#: Bytes of `[^\x00-\x40\x5B-\x60\x7B-\x7F]+` after A-Z became a-z; all others become spaces.
FOLD = bytes(c if c >= 0x80 or 0x61 <= c < 0x7B else c + 32 if 0x41 <= c < 0x5B else 32 for c in range(256))
#: Mark of leaves past the last term: they have no price.
PAD = -1


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n occurrences, df documents that hold it), a row for each."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from collections import Counter

        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out():
            for (lang, source), (n, df) in held.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), terms, pa.array(n.values(), pa.int64()), pa.array([df[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "df"])
            held.clear()

        for b in batches:
            texts = b.column(0).cast(pa.binary())
            keys = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            sizes = pc.binary_length(texts).to_pylist()
            for lo, hi in by_size([x or 0 for x in sizes], 1 << 22):
                for key, text in zip(keys[lo:hi], texts.slice(lo, hi - lo).to_pylist(), strict=True):
                    words = (text or b"").translate(FOLD).split()
                    if words:
                        n, df = held.setdefault(key, (Counter(), Counter()))
                        n.update(words)
                        df.update(set(words))
                if sum(len(n) for n, _ in held.values()) > HELD:
                    yield from out()
        yield from out()

    empty = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    rows = docs.select(empty(text_col, "text"), empty(lang_col, "lang"), empty(source_col, "source"))
    parts = rows.mapInArrow(run, "lang string, source string, term string, n long, df long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def consed(counts: np.ndarray, width: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Segment trees of all rows of `counts` (groups x width leaves, a power of two): (values of the leaf ids, the levels from the leaves up). A level: the
    node of each group and place, and each node's left and right child; leaves have none."""
    values, ids = np.unique(counts, return_inverse=True)
    ids = ids.reshape(counts.shape)
    levels = [(ids, np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while width > 1:
        n = int(ids.max(initial=0)) + 1
        nodes, above = np.unique(ids[:, ::2] * n + ids[:, 1::2], return_inverse=True)
        ids, width = above.reshape(len(counts), width // 2), width // 2
        levels.append((ids, nodes // n, nodes % n))
    return values, levels


def _merged(pair: np.ndarray, u: np.ndarray, v: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Each (pair of groups, pair of nodes) once, with the number of times it stands."""
    nodes, node = np.unique(u * n + v, return_inverse=True)
    keys, at = np.unique(pair * len(nodes) + node.ravel(), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at.ravel(), times)
    both = nodes[keys % len(nodes)]
    return keys // len(nodes), both // n, both % n, total


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); p and q are SCALE + 1 at most, so 64 bits hold the square."""
    return (p - q) ** 2 // (p + q)


def shares(counts: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """p of counts in groups of `whole` = N + 2 V, exact for counts of any size."""
    if int(counts.max(initial=0)) < 9_000_000_000:
        return 1 + SCALE * (counts + 2) // whole
    return np.array([1 + SCALE * (c + 2) // n for c, n in zip(counts.tolist(), np.broadcast_to(whole, counts.shape).tolist(), strict=True)], np.int64)


def pair_values(levels: list, values: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(g, h, value) of all g < h: the prices of a block's terms summed. values: count of each leaf id, PAD for none; whole: N + 2 V of each group."""
    g, h = (x.astype(np.int64) for x in np.triu_indices(len(whole), 1))
    value = np.zeros(len(g), np.int64)
    step = max(1, FRONTIER // levels[0][0].shape[1])
    for lo in range(0, len(g), step):
        a, b = g[lo:lo + step], h[lo:lo + step]
        root = levels[-1][0][:, 0]
        pair, u, v, times = np.arange(len(a)), root[a], root[b], np.ones(len(a), np.int64)
        for k in range(len(levels) - 1, 0, -1):
            _, left, right = levels[k]
            n = int(levels[k - 1][0].max(initial=0)) + 1
            pair, u, v, times = _merged(np.concatenate([pair, pair]), np.concatenate([left[u], right[u]]), np.concatenate([left[v], right[v]]), np.concatenate([times, times]), n)
        on = values[u] != PAD
        pair, u, v, times = pair[on], u[on], v[on], times[on]
        np.add.at(value, lo + pair, times * price(shares(values[u], whole[a[pair]]), shares(values[v], whole[b[pair]])))
    return g, h, value


def _audit_block(rows, top: int):
    """Pairs and leading terms of one block. rows: source, term, n; a row without a term for each group, with its N and V, and the language's N."""
    import pyarrow as pa

    source, term = rows.column("source").to_pylist(), rows.column("term").cast(pa.binary()).to_pylist()
    n, total, v, whole = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("n", "total", "v", "whole"))
    lang = rows.column("lang")[0].as_py()
    heads = sorted((s.encode(), i) for i, (s, t) in enumerate(zip(source, term, strict=True)) if t is None)
    names = [s.decode() for s, _ in heads]
    group = {s: k for k, s in enumerate(names)}
    terms = sorted({t for t in term if t is not None})
    place = {t: k for k, t in enumerate(terms)}
    width = 1 << max(0, len(terms) - 1).bit_length()
    counts = np.zeros((len(names), width), np.int64)
    counts[:, len(terms):] = PAD
    at = [i for i, t in enumerate(term) if t is not None]
    counts[[group[source[i]] for i in at], [place[term[i]] for i in at]] = n[at]
    values, levels = consed(counts, width)
    head = [i for _, i in heads]
    sizes = np.array([int(total[i]) + 2 * int(v[i]) for i in head], np.int64)
    g, h, value = pair_values(levels, values, sizes)

    counts = counts[:, :len(terms)]
    q = shares(counts.sum(0), int(whole[head[0]]) + 2 * int(v[head[0]]))
    x, y = np.nonzero(counts > 0)
    mine, theirs = shares(counts[x, y], sizes[x]), q[y]
    over = mine > theirs
    x, y, f = x[over], y[over], price(mine[over], theirs[over])
    order = np.lexsort([y, -f, x])
    x, y, f = x[order], y[order], f[order]
    rank = np.arange(len(x)) - np.searchsorted(x, x)
    x, y, f = (c[rank < top] for c in (x, y, f))

    names = pa.array(names, pa.string())
    item = pa.concat_arrays([names.take(pa.array(h)), pa.array([terms[k] for k in y], pa.binary()).cast(pa.string())])
    part = pa.array(["pair"] * len(g) + ["term"] * len(x), pa.string())
    return pa.table({"lang": pa.array([lang] * len(part), pa.string()), "source": pa.concat_arrays([names.take(pa.array(g)), names.take(pa.array(x))]), "part": part, "item": item, "value": pa.array(np.concatenate([value, f]), pa.int64())})


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank. `pair`: each other source of the language, by its distance; `term`: the `top` kept terms that the group uses more than its language."""
    by_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs, text_col, lang_col, source_col).withColumn("_d", F.sum("df").over(by_term)).filter(F.col("_d") >= min_docs)
    kept = written(counts.select("lang", "source", "term", "n"))
    empty = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    groups = docs.select(empty(lang_col, "lang"), empty(source_col, "source")).distinct()
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").fillna(0, ["total"])
    terms = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("whole"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("_g")).join(terms, "lang", "left").fillna(0, ["v", "whole"])
    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK_TERMS), F.ceil(F.col("v") * F.col("_g") / BLOCK_CELLS)).cast("int")
    langs = few(langs.select("lang", "v", "whole", blocks.alias("blocks")))
    none = lambda kind: F.lit(None).cast(kind)
    heads = groups.join(langs, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", none("string").alias("term"), none("long").alias("n"), "total", "v", "whole")
    cells = kept.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "n", none("long").alias("total"), none("long").alias("v"), none("long").alias("whole"))
    found = heads.union(cells).groupBy("lang", "block").applyInArrow(lambda rows: _audit_block(rows, top), "lang string, source string, part string, item string, value long")
    found = written(found)
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.union(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    leading = found.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= top)
    return both.withColumn("rank", rank).union(leading.select("lang", "source", "part", "item", "value", "rank"))
