"""Suppression, fusion and matching of large groups: Arrow batches, one group in each, with a cell index over box corners.

The folds of `fuse` compare a box with all kept ones of its group, inside the JVM: right for tens to hundreds of boxes. An image may hold many thousands, though. Here
the same rules run over arrays, and boxes meet only where their corners stand in cells near enough for the overlap that is asked for: if two boxes have an
IoU above t, the intersection is wider than t times either width, so the other's left side lies within (1 - t) widths to the right, or (1 - t) / t widths to the left, of
one's own; the same holds for heights. Results equal the folds' row for row. A group (an image, or an image's class) is in memory at once, as in the fold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tallybox.functions.columns import BOX, GUARD


def overlaps(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """IoU of a box with each of others (rows x1, y1, x2, y2)."""
    side = lambda lo, hi: np.maximum(0.0, hi - lo)
    area = lambda b: side(b[..., 0], b[..., 2]) * side(b[..., 1], b[..., 3])
    i = side(np.maximum(one[0], others[:, 0]), np.minimum(one[2], others[:, 2])) * side(np.maximum(one[1], others[:, 1]), np.minimum(one[3], others[:, 3]))
    return i / np.maximum(area(one) + area(others) - i, GUARD)


def reach(box: np.ndarray, threshold: float) -> tuple[float, float, float, float]:
    """Where the left upper corner of a box with an IoU above `threshold` can stand: x from, x to, y from, y to."""
    w, h = box[2] - box[0], box[3] - box[1]
    if threshold <= 0:
        return -np.inf, np.inf, -np.inf, np.inf
    back, on = (1 - threshold) / threshold * 1.000001, (1 - threshold) * 1.000001
    return box[0] - back * w, box[0] + on * w, box[1] - back * h, box[1] + on * h


def cell_size(boxes: np.ndarray) -> tuple[float, float]:
    sides = np.maximum(boxes[:, 2:] - boxes[:, :2], GUARD)
    return float(np.median(sides[:, 0])), float(np.median(sides[:, 1]))


def suppressed(boxes: np.ndarray, threshold: float, limit: int | None = None) -> np.ndarray:
    """Places of the boxes, given in their order, that greedy suppression keeps."""
    n = len(boxes)
    if threshold < 0 or not n:
        return np.arange(min(n, 1))
    wide, high = cell_size(boxes)
    column, row = np.floor(boxes[:, 0] / wide), np.floor(boxes[:, 1] / high)
    order = np.lexsort([column, row])
    column, row = column[order], row[order]
    rows, first = np.unique(row, return_index=True)
    first = np.append(first, n)
    alive, kept = np.ones(n, bool), []
    for i in range(n):
        if not alive[i]:
            continue
        kept.append(i)
        if limit and len(kept) == limit:
            break
        x0, x1, y0, y1 = reach(boxes[i], threshold)
        near = []
        for r in range(np.searchsorted(rows, np.floor(y0 / high)), np.searchsorted(rows, np.floor(y1 / high), "right")):
            line = column[first[r]:first[r + 1]]
            near.append(order[first[r] + np.searchsorted(line, np.floor(x0 / wide)):first[r] + np.searchsorted(line, np.floor(x1 / wide), "right")])
        at = np.concatenate(near) if near else np.zeros(0, np.int64)
        at = at[(at > i) & alive[at]]
        alive[at[overlaps(boxes[i], boxes[at]) > threshold]] = False
    return np.array(kept, np.int64)


def fused(boxes: np.ndarray, scores: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean boxes, highest scores, sizes) of the clusters of weighted box fusion over boxes in their order."""
    wide, high = cell_size(boxes)
    mean, weight, best, size = np.zeros((len(boxes), 4)), np.zeros(len(boxes)), np.zeros(len(boxes)), np.zeros(len(boxes), np.int32)
    held: dict[tuple[float, float], set[int]] = {}
    cell = lambda b: (float(np.floor(b[0] / wide)), float(np.floor(b[1] / high)))
    n = 0
    for box, score in zip(boxes, scores, strict=True):
        x0, x1, y0, y1 = reach(box, threshold)
        a, b, c, d = np.floor(x0 / wide), np.floor(x1 / wide), np.floor(y0 / high), np.floor(y1 / high)
        if (b - a + 1) * (d - c + 1) < len(held):
            near = [k for x in np.arange(a, b + 1) for y in np.arange(c, d + 1) for k in held.get((float(x), float(y)), ())]
        else:
            near = range(n)
        near = np.sort(np.fromiter(near, np.int64))
        v = overlaps(box, mean[near])
        k = int(near[np.argmax(v)]) if len(near) and v.max() > threshold else None  # the first of equals
        if k is None:
            mean[n], weight[n], best[n], size[n] = box, score, score, 1
            held.setdefault(cell(box), set()).add(n)
            n += 1
            continue
        was = cell(mean[k])
        mean[k] = (mean[k] * weight[k] + box * score) / max(weight[k] + score, 1e-12)
        weight[k], best[k], size[k] = weight[k] + score, max(best[k], score), size[k] + 1
        if (now := cell(mean[k])) != was:
            held[was].discard(k)
            held.setdefault(now, set()).add(k)
    return mean[:n], best[:n], size[:n]


def _arrays(group, score: str, id_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order: score down, id up; boxes in it; scores in it)."""
    get = lambda c: group.column(c).to_numpy()
    scores = get(score).astype(float)
    order = np.lexsort([get(id_col), -scores])
    return order, np.stack([get(c).astype(float) for c in BOX], 1)[order], scores[order]


def nms(df: DataFrame, threshold: float, keys: list[str], score: str, id_col: str, limit: int | None) -> DataFrame:
    def run(group):
        import pyarrow as pa

        group = group.combine_chunks()
        order, boxes, _ = _arrays(group, score, id_col)
        return group.take(pa.array(order[suppressed(boxes, threshold, limit)]))

    return df.groupBy(*keys).applyInArrow(run, df.schema)


def wbf(df: DataFrame, threshold: float, keys: list[str], score: str, id_col: str) -> DataFrame:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys]

    def run(group):
        import pyarrow as pa

        group = group.combine_chunks()
        _, boxes, scores = _arrays(group, score, id_col)
        mean, best, size = fused(boxes, scores, threshold)
        head = [group.column(k).take(pa.array(np.zeros(len(size), np.int64))) for k in names]
        return pa.Table.from_arrays([*head, pa.array(np.arange(len(size), dtype=np.int32)), *[pa.array(mean[:, i]) for i in range(4)], pa.array(best), pa.array(size)], names=[*names, "cluster", *BOX, "score", "n"])

    names = [f.name for f in df.schema if f.name in keys]
    out = df.select(*keys, id_col, score, *BOX).groupBy(*keys).applyInArrow(run, ", ".join([*kept, "cluster int", *[f"{c} double" for c in BOX], "score double, n int"]))
    return out.select(*keys, "cluster", *BOX, "score", "n")


def match_greedy(pairs: DataFrame, keys: list[str]) -> DataFrame:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name in keys]
    names = [f.name for f in pairs.schema if f.name in keys]

    def run(group):
        import pyarrow as pa

        group = group.combine_chunks()
        det, gt, score, iou = (group.column(c).to_numpy() for c in ("det_id", "gt_id", "score", "iou"))
        taken, done, out = set(), set(), []
        for i in np.lexsort([gt, -iou, det, -score]).tolist():
            if det[i] not in done and gt[i] not in taken:
                done.add(det[i])
                taken.add(gt[i])
                out.append(i)
        return group.select([*names, "det_id", "gt_id"]).take(pa.array(out, pa.int64()))

    whole = pairs.select(*keys, "det_id", "gt_id", "score", "iou")
    return whole.groupBy(*keys).applyInArrow(run, ", ".join([*kept, "det_id long, gt_id long"])).select(*keys, "det_id", "gt_id")
