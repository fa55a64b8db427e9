r"""Substring dedup: words covered by a `window`-word sequence that also starts elsewhere go.

The windows of a text are its suffixes, cut after `window` words; a window that starts twice is an internal node of their tree
that is `window` words deep. The tree is never whole anywhere: see `suffixes` for how variable-length prefixes split it.

1. Windows that hold an anchor in common stand in runs. Anchors that occur once root no repeat, and their windows leave (most of a corpus does).
2. A run's whole word span is one compressed path: if it occurs twice, all its windows are repeats, and one row for the span goes
   on, whatever the number of its copies.
3. Where an anchor has two different spans or more, the windows of each span are spelled as suffixes, split by variable-length
   prefixes into memory-sized groups, and each group's subtrees give the internal nodes of full depth. The shortest prefix is the anchor
   itself: anchors of few spans travel as the words of their spans and are spelled in the group; only the windows of others travel.

Sequences are compared by 64-bit hashes of their words within 64-bit anchors. A passage in a third of all documents stays one row a
span, or one counted node, in every step.

Windows are judged on the input, not on what is left. Null and empty texts have no words, and come back empty. Texts of any length are
whole. Rows equal in id and text are separate documents: each repeats the other. An empty table gives no rows. Other
columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybox.llm import suffixes
from tallybox.llm.common import as_bytes, by_size, few, hashed_words, mix, row_key, span_hashes, written
from tallybox.llm.suffixes import window_anchors

WINDOW, SHINGLE = 35, 6
LIMIT = 1 << 21


def _runs(starts: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of consecutive windows that share an anchor."""
    cut = np.flatnonzero((np.diff(anchors, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
    return cut, np.append(cut, len(starts))[1:]


def _slices(batch, column: int):
    texts = as_bytes(batch.column(column))
    for lo, hi in by_size([len(t) for t in texts], LIMIT):
        yield lo, hi, texts[lo:hi]


def _run_rows(window: int, shingle: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo, _, texts in _slices(b, 2):
                words, first = hashed_words(texts)
                starts, anchors, value = window_anchors(words, first, window, shingle)
                if not len(starts):
                    continue
                a, z = _runs(starts, anchors)
                begin, end = starts[a], starts[z - 1] + window
                row = np.searchsorted(first, begin, "right") - 1
                key = pa.array(lo + row)
                # a run has fewer windows than a window has words, so one number holds where it begins and how many it has
                place = (begin - first[row]) * window + (z - a - 1)
                anchor, span = value[anchors[a]], span_hashes(words, begin, end)
                # the first of the copies met here stands for the others, which are known to be repeats and go anywhere
                _, at, which, n = np.unique(span, return_index=True, return_inverse=True, return_counts=True)
                other = at[which] != np.arange(len(span))
                anywhere = mix(b.column(0).take(key).to_numpy().view(np.uint64) ^ mix(place.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.where(other, anywhere, anchor).view(np.int64)), pa.array(span.view(np.int64)), b.column(0).take(key), b.column(1).take(key), pa.array(place),
                    pa.array(np.where(other, 2, n[which]))], names=["anchor", "span", "_k1", "_k2", "place", "copies"])
    return run


def _span_rows():
    """The words of given runs (arrays anchor, s, e)."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            sizes = np.concatenate([[0], np.cumsum(pc.list_value_length(b.column(3)).to_numpy())])
            anchor, s, e = b.column(3).flatten().flatten()
            for lo, hi, texts in _slices(b, 2):
                i, j = int(sizes[lo]), int(sizes[hi])
                row = np.repeat(np.arange(hi - lo), np.diff(sizes[lo:hi + 1]))
                words = [t.split() for t in texts]
                spans = [b" ".join(words[k][x:y]) for k, x, y in zip(row.tolist(), s[i:j].to_pylist(), e[i:j].to_pylist(), strict=True)]
                key = pa.array(lo + row)
                yield pa.RecordBatch.from_arrays([anchor[i:j], b.column(0).take(key), b.column(1).take(key), s[i:j], pa.array(spans, pa.binary())], names=["anchor", "_k1", "_k2", "s", "words"])
    return run


def _span_subtrees(window: int):
    """Of a group's spans, given by their words, the ranges whose windows lie under a node of full depth."""
    def run(group):
        import pyarrow as pa

        group = group.combine_chunks()
        words, first = hashed_words(as_bytes(group.column("words")))
        n = np.diff(first) - window + 1
        row = np.repeat(np.arange(len(n)), n)
        start = np.arange(len(row)) + (row * (window - 1))
        letters = suffixes.spell(words, start, window)
        order, lo, hi = suffixes.subtrees(group.column("anchor").to_numpy()[row], letters)
        inside = np.zeros(len(order) + 1, np.int64)
        np.add.at(inside, lo, 1)
        np.add.at(inside, hi, -1)
        found = np.sort(order[np.cumsum(inside[:-1]) > 0])
        a, z = _runs(found, row[found])
        begin, end = found[a], found[z - 1]
        at, key = start - first[row], pa.array(row[begin])
        s = group.column("s").to_numpy()[row[begin]]
        return pa.table({"_k1": group.column("_k1").take(key), "_k2": group.column("_k2").take(key), "s": pa.array((s + at[begin]).astype(np.int32)), "e": pa.array((s + at[end] + window).astype(np.int32))})
    return run


def _window_rows(window: int):
    """The windows of given runs (arrays a, s, e of anchors and spans), spelled as suffixes."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            runs = b.column(3).to_pylist()
            for lo, _, texts in _slices(b, 2):
                words, first = hashed_words(texts)
                start, row, anchor = [], [], []
                for k in range(len(texts)):
                    for r in runs[lo + k]:
                        at = np.arange(r["s"], r["e"] - window + 1)
                        start.append(first[k] + at)
                        row.append(np.full(len(at), k))
                        anchor.append(np.full(len(at), r["anchor"], np.int64))
                if not start:
                    continue
                start, row, anchor = np.concatenate(start), np.concatenate(row), np.concatenate(anchor)
                key = pa.array(lo + row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), *[pa.array(x) for x in suffixes.spell(words, start, window)], b.column(0).take(key), b.column(1).take(key), pa.array((start - first[row]).astype(np.int32))],
                    names=["anchor", *suffixes.letter_names(window), "_k1", "_k2", "s"])
    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), *row_key(id_col, text_col), F.col(text_col).alias("_text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
                   dealt: DataFrame | None = None) -> DataFrame:
    """(_k1, _k2, spans array<struct<s, e>>): word ranges of each row that lie in repeats; rows without are absent.

    `dealt`: the keyed rows, dealt out by key, where the caller needs them so itself."""
    keyed = _keyed(docs, id_col, text_col)
    dealt = keyed.repartition("_k1", "_k2") if dealt is None else dealt
    runs = keyed.select("_k1", "_k2", "_text").mapInArrow(_run_rows(window, shingle), "anchor long, span long, _k1 long, _k2 long, place long, copies long")
    # runs are dealt by anchor once, and both kinds of windows read them in one order
    anchor, span = Window.partitionBy("anchor"), Window.partitionBy("anchor", "span")
    runs = runs.repartition("anchor").withColumns({"n": F.sum("copies").over(span), "copy": F.row_number().over(span.orderBy("_k1", "_k2", "place"))})
    runs = runs.withColumn("spans", F.count_if(F.col("copy") == 1).over(anchor))
    # an anchor met once roots no repeat; a span met twice is one; an anchor with several spans has open branches, and there one run of each span stands for its copies
    runs = runs.select("_k1", "_k2", F.expr(f"int(place div {window})").alias("s"), F.expr(f"int(place div {window} + place % {window} + {window})").alias("e"),
                       (F.col("n") > 1).alias("whole"), F.when((F.col("spans") > 1) & (F.col("copy") == 1), F.col("anchor")).alias("anchor"), (F.col("spans") > suffixes.GROUP).alias("frequent"))
    live = written(runs.filter("whole or anchor is not null"))
    whole, one = live.filter("whole").select("_k1", "_k2", "s", "e"), live.filter("anchor is not null")

    def by_row(runs: DataFrame) -> DataFrame:
        return runs.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("anchor", "s", "e")).alias("runs"))

    n = {r.frequent: r.n for r in one.groupBy("frequent").agg(F.sum(F.col("e") - F.col("s") - window + 1).alias("n")).collect()}
    found = [whole]
    if False in n:
        # the id goes along unread: the last step needs the same columns, so that both share one shuffle of the texts
        rows = dealt.join(by_row(one.filter("not frequent")), ["_k1", "_k2"]).select("_k1", "_k2", "_text", "runs", "_id").mapInArrow(_span_rows(), "anchor long, _k1 long, _k2 long, s int, words binary")
        part = F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-n[False] // suffixes.PACK))))
        found.append(rows.withColumn("part", part).groupBy("part").applyInArrow(_span_subtrees(window), "_k1 long, _k2 long, s int, e int"))
    if True in n:
        spell = ", ".join(["anchor long", *[f"{x} long" for x in suffixes.letter_names(window)], "_k1 long, _k2 long, s int"])
        rows = keyed.join(few(by_row(one.filter("frequent")), "runs"), ["_k1", "_k2"]).select("_k1", "_k2", "_text", "runs").mapInArrow(_window_rows(window), spell)
        deep = suffixes.deep_nodes_of_frequent(rows.select("*", F.lit(1.0).alias("weight"), F.lit(2.0).alias("least")), window)
        found.append(deep.select("_k1", "_k2", "s", (F.col("s") + window).alias("e")))
    return reduce(DataFrame.union, found).groupBy("_k1", "_k2").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_text (kept words joined by one space), spans."""
    dealt = _keyed(docs, id_col, text_col).repartition("_k1", "_k2")
    spans = repeated_spans(docs, id_col, text_col, window, shingle, dealt)
    packed = dealt.join(spans, ["_k1", "_k2"], "left").select("_id", "spans", "_text")

    def cut_out(texts, spans):
        n, gone, kept = [], [], []
        for t, x in zip(texts, spans, strict=True):
            words = t.split()
            keep = np.ones(len(words), bool)
            for r in x or ():
                keep[r["s"]:r["e"]] = False
            n.append(len(words))
            gone.append(int((~keep).sum()))
            kept.append(b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k) if gone[-1] else b" ".join(words))
        return n, gone, kept

    def run(batches):
        import pyarrow as pa

        for b in batches:
            spans = b.column(1).to_pylist()
            for lo, hi, texts in _slices(b, 2):
                n, gone, kept = cut_out(texts, spans[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                                                 names=[id_col, "spans", "n_words", "n_removed", "kept_text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return packed.mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<s:int,e:int>>, n_words long, n_removed long, kept_text string")
