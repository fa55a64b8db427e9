"""Quality classifier: ridge regression on random Fourier features of document statistics.

Statistics of a text (lengths, shares of byte classes, repetition, word and line shapes) are standardised;
random Fourier features approximate a Gaussian kernel over them. Each partition of the training rows sums its
part of the normal equations, the driver adds these few matrices and solves them with a ridge. Isotonic
regression over training rows that the fit has not seen turns the fit into a score from 0 to 1.

Which rows train: the caller's boolean column. Of them at most `FIT_ROWS` labelled rows (a hash sample of the
ids) are read: a documented bound. Rows with crc32 mod 4 = 3 of the id calibrate. Null and empty texts have
statistics 0 and are scored like any other; texts of any length are whole; equal rows are scored alike; an empty table gives no rows. Other columns, whatever their names, are not read,
and come back if `keep` names them. Null labels and labels other than 0 and 1 are left out; an id with several labels counts as
good if one says so. Without labels of both classes every score is 0.5.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybox.llm.common import add_columns
from tallybox.llm.toxicity import labelled

FIT_ROWS = 40_000
#: Training rows are summed in so many partitions: a bound on what reaches the driver.
FIT_PARTITIONS = 16
N_FEATURES = 256
RIDGE = 1e-3
SEED = 20


def _byte_classes() -> np.ndarray:
    """Nine classes of bytes, a column each."""
    out = np.zeros((256, 9))
    for i in range(256):
        c = chr(i)
        k = 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c == " " else 4 if c == "\n" else 5 if i >= 0x80 else 6 if c in ".,;:'\"-()" else 7 if c in "!?" else 8
        out[i, k] = 1
    return out


CLASSES = _byte_classes()
N_STATS = 9 + 11


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of N_STATS numbers for each text."""
    out = np.zeros((len(texts), N_STATS))
    for k, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "replace")
        words = raw.split()
        if not words:
            continue
        n, distinct = len(words), len(set(words))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ CLASSES / len(raw)
        sizes = np.fromiter(map(len, words), np.int64, n)
        marked = sum(not w[-1:].isalnum() and w[-1] < 0x80 for w in words) / n
        out[k, :9] = np.sqrt(share)
        out[k, 9:] = (np.log1p(len(raw)), np.log1p(n), distinct / n ** 0.9, sizes.mean(), sizes.std(), marked,
                      np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(len(raw) / len(lines)),
                      sum(w.isupper() for w in words) / n, sum(w[0] < 0x30 or 0x3A <= w[0] <= 0x40 or 0x7B <= w[0] < 0x80 for w in words) / n)
    return out


class Fourier:
    """cos(w.x + b) for random w, b: inner products approximate a Gaussian kernel of the given width."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, width: float = 3.0) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.std = mean, std
        self.w = rng.normal(0, 1 / width, (len(mean), N_FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, N_FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.std, -5, 5)
        return np.column_stack([np.sqrt(2 / N_FEATURES) * np.cos(x @ self.w + self.b), x, np.ones(len(x))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, level) of the increasing step fit, by pooling adjacent violators; ties in x are pooled first."""
    xs, at = np.unique(x, return_inverse=True)
    total, count = np.bincount(at, y).tolist(), np.bincount(at).tolist()
    blocks: list[list[float]] = []
    for v, s, c in zip(xs.tolist(), total, count, strict=True):
        blocks.append([v * c, s, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def score_quality(docs: DataFrame, labels: DataFrame, train, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: the id) and score double. `train`: boolean column, the ids that may teach."""
    spark = docs.sparkSession
    keep = keep or [id_col]
    n = max(1, labels.filter(F.col(label_col).isNotNull()).count())
    share = min(1.0, FIT_ROWS / n)
    sample = labels.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(share * 1_000_000))
    known = labelled(docs, sample, id_col, text_col, label_col, train, broadcast_rows=2 * FIT_ROWS)

    def examine(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"stats": list(statistics(pdf["text"].tolist())), "label": pdf["label"], "part": pdf["part"]})

    # bounded: FIT_ROWS rows of N_STATS numbers, dealt evenly over FIT_PARTITIONS
    stats = known.select("text", "label", "part").mapInPandas(examine, "stats array<double>, label int, part long").repartition(FIT_PARTITIONS).persist()
    fit = stats.filter("part <> 3")

    def moments(batches):
        import pandas as pd

        x = [np.stack(p["stats"].to_list()) for p in batches if len(p)]
        if x:
            x = np.concatenate(x)
            yield pd.DataFrame({"n": [len(x)], "s": [x.sum(0)], "q": [(x * x).sum(0)]})

    m = fit.mapInPandas(moments, "n long, s array<double>, q array<double>").toPandas()
    model = None
    if len(m):
        count, s, q = m["n"].sum(), np.sum(m["s"].to_list(), 0), np.sum(m["q"].to_list(), 0)
        mean = s / count
        fourier = Fourier(mean, np.sqrt(np.maximum(q / count - mean**2, 0)) + 1e-6)

        def normal(batches):
            import pandas as pd

            a, b = 0.0, 0.0
            for p in batches:
                if len(p):
                    z = fourier(np.stack(p["stats"].to_list()))
                    a, b = a + z.T @ z, b + z.T @ p["label"].to_numpy(float)
            if not np.isscalar(a):
                yield pd.DataFrame({"a": [a.ravel()], "b": [b]})

        parts = fit.mapInPandas(normal, "a array<double>, b array<double>").toPandas()
        d = len(parts["b"][0])
        a = np.sum(parts["a"].to_list(), 0).reshape(d, d)
        beta = np.linalg.solve(a + RIDGE * count * np.eye(d) / d, np.sum(parts["b"].to_list(), 0))

        def raw(batches):
            import pandas as pd

            for p in batches:
                if len(p):
                    yield pd.DataFrame({"raw": fourier(np.stack(p["stats"].to_list())) @ beta, "label": p["label"]})

        cal = stats.filter("part = 3").mapInPandas(raw, "raw double, label int").toPandas()
        if cal["label"].nunique() == 2:
            model = fourier, beta, *isotonic(cal["raw"].to_numpy(), cal["label"].to_numpy(float))
    stats.unpersist()
    model = spark.sparkContext.broadcast(model)

    def score(texts):
        if model.value is None:
            return [np.full(len(texts), 0.5)]
        fourier, beta, knots, levels = model.value
        raw = fourier(statistics(texts)) @ beta
        # between knots the step fit is joined by lines; a little of the raw value keeps the order within a step
        return [np.clip(0.98 * np.interp(raw, knots, levels) + 0.02 / (1 + np.exp(-np.clip(4 * (raw - 0.5), -30, 30))), 0, 1)]

    return add_columns(docs, keep, text_col, score, "score double")
