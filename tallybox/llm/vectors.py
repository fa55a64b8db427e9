"""Embedding near-dedup: an exact metric range join of unit vectors.

Pivots (a bounded hash sample of the vectors) partition the vectors: each lives in the cell of its nearest pivot.
Two vectors within the angle r of the threshold lie in one cell, or the one is within r of the other's cell: by
the triangle inequality it is then no further than r from the bisector of the two pivots, and it is copied to
that cell (to the lower-numbered of the two only, so each pair meets once). Cells join independently, in blocks of
at most `BLOCK` by `BLOCK` vectors, so no task holds more however many vectors a cell has. A block returns link
counts by vector and a spanning forest of its links, never the pairs; components of the forests are the classes.
Vectors in no preferred direction are near every bisector: then nearly all are copied, and the join compares all
pairs once, in blocks; that is the price of an exact answer there.

The number of pivots grows with that of the vectors: its cube root at least, and as many as leave `BLOCK` vectors to a cell, up to its square root. Ids are whole numbers or cast to them; one that is no number is an error. Equal vectors are one from the start, counted with their number. Null ids, and vectors that are null, empty, zero or
hold null or non-finite components, link with nothing. Vectors of different lengths don't link. Rows that share an
id are one vertex, and get the larger count of links. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybox.llm.common import cut
from tallybox.llm.graph import components

#: Vectors on one side of a block, and those of them that are multiplied at once.
BLOCK, STRIP = 16384, 256


def _unit(batches):
    """Valid vectors as unit vectors of doubles, packed."""
    import pyarrow as pa

    for b in batches:
        v, m, out, dim = b.column(0), b.column(1), [], []
        keep = []
        for i, x in enumerate(b.column(2).to_pylist()):
            if x and None not in x:
                a = np.array(x, float)
                big = np.abs(a).max()
                if np.isfinite(big) and big > 0:
                    a = a / big
                    keep.append(i)
                    out.append((a / np.sqrt(a @ a)).tobytes())
                    dim.append(len(a))
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([v.take(at), m.take(at), pa.array(dim, pa.int32()), pa.array(out, pa.binary())], names=["v", "m", "dim", "u"])


def _stack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), float).reshape(len(column), -1)


def _cells(pivots, sine: float):
    """Rows (dim, cell, guest, v, m, u): a vector in its own cell and, as a guest, in lower cells that it is near."""
    def run(batches):
        import pandas as pd

        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                p = pivots.value[int(dim)]
                for lo in range(0, len(part), step := max(1, (1 << 22) // len(p))):
                    some = part.iloc[lo:lo + step]
                    x = _stack(some["u"].to_list())
                    s = x @ p.T
                    home = s.argmax(1)
                    gap = np.sqrt(np.maximum(2 - 2 * p[home] @ p.T, 1e-30))
                    far = (s[np.arange(len(x)), home][:, None] - s) / gap
                    near = (far <= sine) & (np.arange(len(p))[None, :] < home[:, None])
                    row, cell = np.nonzero(near)
                    row, cell = np.concatenate([np.arange(len(x)), row]), np.concatenate([home, cell])
                    guest = np.arange(len(row)) >= len(x)
                    yield some.iloc[row].assign(cell=cell.astype("int32"), guest=guest)[["dim", "cell", "guest", "v", "m", "u"]]
    return run


def _links(x: np.ndarray, y: np.ndarray, own: bool, mx: np.ndarray, my: np.ndarray, least: float):
    """Link counts of both sides and forest edges (row of x, row of y), by strips of x. own: x is y, pairs once."""
    nx, ny = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    label = np.arange(len(x) + (0 if own else len(y)))
    shift = 0 if own else len(x)
    edges = []

    def find(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for lo in range(0, len(x), STRIP):
        hit = x[lo:lo + STRIP] @ y.T >= least
        if own:
            hit[np.arange(hit.shape[0]), lo + np.arange(hit.shape[0])] = False
        nx[lo:lo + STRIP] = hit @ my
        if not own:
            ny += mx[lo:lo + STRIP] @ hit
        for i in np.flatnonzero(hit.any(1)):
            others = np.flatnonzero(hit[i])
            a = find(lo + i)
            # one look at the labels of all neighbours; only those of other trees are joined
            for j in others[label[others + shift] != a].tolist():
                b = find(j + shift)
                if b != a:
                    edges.append((lo + i, j))
                    label[b] = a
    return nx, ny, edges


def _join(least: float):
    def run(pdf):
        import pandas as pd

        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        own = len(b) == 0
        b = a if own else b
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        nx, ny, edges = _links(_stack(a["u"].to_list()), _stack(b["u"].to_list()), own, a["m"].to_numpy(), b["m"].to_numpy(), least)
        va, vb = a["v"].to_numpy(), b["v"].to_numpy()
        e = np.array(edges, np.int64).reshape(-1, 2)
        out = [pd.DataFrame({"a": va[e[:, 0]], "b": vb[e[:, 1]], "n": np.zeros(len(e), np.int64)}), pd.DataFrame({"a": va[nx > 0], "b": None, "n": nx[nx > 0]})]
        if not own:
            out.append(pd.DataFrame({"a": vb[ny > 0], "b": None, "n": ny[ny > 0]}))
        return pd.concat([o.astype({"b": "Int64"}) for o in out if len(o)] or [out[0].astype({"b": "Int64"})])
    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", min_cosine: float = 0.95) -> DataFrame:
    """One row per row: id, n_links (other vectors linked directly), component_id (smallest id reachable)."""
    keyed = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_e"), F.xxhash64(vector_col).alias("h1"), F.xxhash64(F.lit(1), vector_col).alias("h2"))
    one = keyed.filter("_id is not null and _e is not null").groupBy("h1", "h2").agg(F.min("_id").alias("v"), F.count("*").alias("m"), F.first("_e").alias("e"))
    units = cut(one.select("v", "m", "e", "h1", "h2").select("v", "m", "e").mapInArrow(_unit, "v long, m long, dim int, u binary"))
    dims = {r["dim"]: r["count"] for r in units.groupBy("dim").count().collect()}
    pivots = {}
    for dim, n in dims.items():
        k = max(int(np.ceil(np.cbrt(n))), min(-(-n // BLOCK), int(np.ceil(np.sqrt(n)))))  # the square root keeps the pivots a small broadcast
        pivots[dim] = _stack([bytes(r.u) for r in units.filter(F.col("dim") == dim).orderBy(F.xxhash64("v"), "v").limit(k).collect()])
    sine = float(np.sqrt(max(0.0, 1 - min_cosine**2))) + 1e-9 if min_cosine > 0 else 2.0
    pivots = vectors.sparkSession.sparkContext.broadcast(pivots)
    cells = units.mapInPandas(_cells(pivots, sine), "dim int, cell int, guest boolean, v long, m long, u binary")
    cells = cells.withColumn("salt", F.xxhash64("v"))
    sizes = cells.groupBy("dim", "cell").agg(F.count_if(~F.col("guest")).alias("homes"), F.count_if(F.col("guest")).alias("guests"))
    parts = sizes.select("dim", "cell", F.greatest(F.lit(1), F.ceil(F.col("homes") / BLOCK)).cast("int").alias("kh"), F.ceil(F.col("guests") / BLOCK).cast("int").alias("kg"))
    dealt = cells.join(F.broadcast(parts), ["dim", "cell"])  # a row for each pivot at most
    home, guest = dealt.filter("not guest").withColumn("i", F.pmod("salt", "kh").cast("int")), dealt.filter("guest").withColumn("j", F.pmod("salt", "kg").cast("int"))
    # blocks: (i, i) a home part with itself, (i, k) two home parts, (i, -1 - j) a home part with a guest part
    pair = "struct(least(i, k) as x, greatest(i, k) as y, cast(if(k < i, 1, 0) as int) as side)"
    to = F.expr(f"concat(transform(sequence(0, kh - 1), k -> {pair}), if(kg > 0, transform(sequence(1, greatest(kg, 1)), g -> struct(i as x, -g as y, 0 as side)), array()))")
    home = home.select("dim", "cell", "v", "m", "u", F.explode(to).alias("t")).select("dim", "cell", "t.*", "v", "m", "u")
    guest = guest.select("dim", "cell", F.explode(F.expr("transform(sequence(0, kh - 1), k -> struct(k as x, -1 - j as y, 1 as side))")).alias("t"), "v", "m", "u").select("dim", "cell", "t.*", "v", "m", "u")
    joined = cut(home.union(guest).groupBy("dim", "cell", "x", "y").applyInPandas(_join(min_cosine), "a long, b long, n long"))
    counts = joined.groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("n"))
    roots = components(joined.filter("b is not null").select("a", "b"))
    per = one.select("h1", "h2", "v", "m").join(units.select("v").distinct(), "v").join(counts, "v", "left").join(roots, "v", "left")
    per = per.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "v").alias("root"))
    per = per.groupBy("h1", "h2").agg(F.max("n_links").alias("n_links"), F.min("root").alias("root"))
    out = keyed.join(per, ["h1", "h2"], "left")
    linked = F.col("_id").isNotNull()
    return out.select(F.col("_id").alias(id_col), F.when(linked, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
                             F.when(linked, F.coalesce("root", "_id")).alias("component_id"))
