r"""Toxicity: class-conditional Kneser-Ney models over the letters of words.

Expressions of several languages are compounds, so their parts, runs of letters, are what rare ones share. For each class
(ordinary, toxic) an interpolated Kneser-Ney model of order 5 predicts a word's letters: the top order uses the class's counts, orders 4
and 3 its continuation counts (distinct left neighbours), and both classes back off to one shared continuation model of orders 2
and 1, so that letters neither class has seen in a place weigh nothing.

Counts are Spark tables keyed by the letters themselves, of any script, and grow with the labelled texts: words are counted, split into runs,
and the probabilities of each order joined to those of the next. What scoring needs of them is one number for each run of letters (the
log of its toxic over its ordinary probability) and one for each context (of its two back-off weights). They are broadcast
while they are at most `MODEL_ROWS`; beyond it the corpus's distinct words meet the tables in shuffle joins, and the texts
their words, with the same result.

A text is scored by length-normalised log-likelihood ratios (toxic minus ordinary, by letter): of the whole text, of its most toxic word,
of its most toxic stretches of 8 words, and of the most toxic beginnings of its words. A logistic curve, fitted on `CALIBRATION_ROWS` labelled training texts at most, and on counts
without them, turns these and the length, which the largest of many follows, into a score. Then the counts take in all training texts.

Which rows train: the caller's boolean column; of them, rows with crc32 / 5 mod 4 = 3 of the id calibrate.
Null, empty and wordless texts have all ratios 0 and are scored so. Texts of any length are whole. Labels other than 0 and 1 and null ones are left out; an id with
several labels is toxic if one says so; rows that share an id share its labels. Without labels of both classes every score is 0. Equal rows are scored alike; an
empty table gives no rows. Other columns, whatever their names, are not read, and come back if `keep` names them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybox.llm.common import BROADCAST_KEYS, add_columns, cut, few, mix

ORDER = 5
#: The lowest orders, which both classes share.
SHARED = 2
DISCOUNT = 0.75
#: The chance of a letter before any was seen: the same for both classes.
FLOOR = 1 / 256
CALIBRATION_ROWS = 20_000
#: Rows of the tables that scoring tasks hold (12 bytes each); more of them are joined.
MODEL_ROWS = 4_000_000
WINDOW = 8
#: Letters of a word's beginning, which carry the stem of a compound.
STEM = 6
#: Words whose ratios a task remembers.
REMEMBERED = 400_000
START, END = "\0", "\1"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def plain_text(text) -> F.Column:
    """The text's words in lower case, of letters alone, between white space."""
    return F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{M}\s]+", "")


def words_of(plain) -> F.Column:
    return F.array_remove(F.split(plain, r"\s+"), "")


def letter_runs(word) -> F.Column:
    """The ORDER letters that end at each letter of a word and at its end."""
    letters = F.concat(F.array_repeat(F.lit(START), ORDER - 1), F.split(word, ""), F.array(F.lit(END)))
    # the letters become a lambda's variable, so that they are not split again for each run
    runs = F.transform(F.array(letters), lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - ORDER), lambda i: F.concat(*[F.get(x, i + k) for k in range(ORDER)])))
    return F.get(runs, 0)


def model_tables(known: DataFrame) -> DataFrame:
    """(model, kind, run, ratio) from (text, label, part): model 0 of the parts but 3, model 1 of all; kind 0: a run of letters, the log of its
    toxic over its ordinary probability; kind 1: a context, the log of its two back-off weights' quotient."""
    toxic, fit = F.col("label") == 1, F.col("part") != 3
    words = known.select("label", "part", F.explode(words_of(plain_text("text"))).alias("word")).groupBy("word").agg(
        *[F.count_if(c).cast("double").alias(n) for n, c in (("a0", ~toxic & fit), ("a1", toxic & fit), ("b0", ~toxic), ("b1", toxic))])
    runs = words.select("a0", "a1", "b0", "b1", F.explode(letter_runs(F.col("word"))).alias("run")).groupBy("run").agg(*[F.sum(c).alias(c) for c in ("a0", "a1", "b0", "b1")])
    pair = F.explode(F.array(F.struct(F.lit(0).alias("model"), F.col("a0").alias("v0"), F.col("a1").alias("v1")), F.struct(F.lit(1).alias("model"), F.col("b0").alias("v0"), F.col("b1").alias("v1"))))
    now = cut(runs.select("run", pair.alias("x")).select("x.model", "run", "x.v0", "x.v1").filter("v0 + v1 > 0"))
    orders = {ORDER: now}
    for order in range(ORDER - 1, 0, -1):
        # continuation counts of the next lower order: distinct left neighbours
        seen = [(F.col(v) > 0).cast("double") for v in ("v0", "v1")]
        if order == SHARED:
            seen = [F.greatest(*seen)] * 2
        now = cut(now.groupBy("model", F.substring("run", 2, order).alias("run")).agg(F.sum(seen[0]).alias("v0"), F.sum(seen[1]).alias("v1")))
        orders[order] = now
    out, lower = [], None
    for order in range(1, ORDER + 1):
        rows = orders[order].withColumn("context", F.substring("run", 1, order - 1))
        of = rows.groupBy("model", "context").agg(*[f for c in "01" for f in (F.sum(f"v{c}").alias(f"t{c}"), F.count_if(F.col(f"v{c}") > 0).alias(f"k{c}"))])
        of = of.select("model", "context", "t0", "t1", *[F.when(F.col(f"t{c}") > 0, DISCOUNT * F.col(f"k{c}") / F.col(f"t{c}")).otherwise(1.0).alias(f"w{c}") for c in "01"])
        rows = rows.join(of.hint("merge"), ["model", "context"])  # the tables grow with the corpus: no broadcasts through the driver
        if lower is None:
            rows = rows.withColumns({"q0": F.lit(FLOOR), "q1": F.lit(FLOOR)})
        else:
            tails = lower.select(F.col("model").alias("_m"), F.col("run").alias("_tail"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
            rows = rows.join(tails.hint("merge"), (F.substring("run", 2, order) == F.col("_tail")) & (F.col("model") == F.col("_m"))).drop("_m", "_tail")
        p = [(F.when(F.col(f"t{c}") > 0, F.greatest(F.col(f"v{c}") - DISCOUNT, F.lit(0.0)) / F.col(f"t{c}")).otherwise(0.0) + F.col(f"w{c}") * F.col(f"q{c}")).alias(f"p{c}") for c in "01"]
        lower = cut(rows.select("model", "run", *p))
        out += [lower.select("model", F.lit(0).alias("kind"), "run", (F.log("p1") - F.log("p0")).alias("ratio")),
                of.select("model", F.lit(1).alias("kind"), F.col("context").alias("run"), (F.log("w1") - F.log("w0")).alias("ratio"))]
    return cut(reduce(DataFrame.unionByName, out))


# --- ratios of words, from the tables in memory -------------------------------------------------

def _extend(before: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Keys of runs of letters, from those of all letters but the last."""
    return mix((before ^ (code.astype(np.uint64) + np.uint64(1))) * _ODD)


def run_keys(runs: list[str]) -> np.ndarray:
    """64-bit keys of runs of any lengths."""
    out = np.zeros(len(runs), np.uint64)
    size = np.fromiter(map(len, runs), np.int64, len(runs))
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        code = np.frombuffer("".join([runs[i] for i in at]).encode("utf-32-le"), np.uint32).reshape(len(at), n)
        key = np.zeros(len(at), np.uint64)
        for k in range(n):
            key = _extend(key, code[:, k])
        out[at] = key ^ np.uint64(n)
    return out


class Table:
    """Numbers by 64-bit key: sorted keys, and where those of each leading bits begin."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], np.uint64(2**64 - 1)), np.append(values[order], 0).astype(np.float32)
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length()))
        self.begin = np.searchsorted(self.keys, np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key is there, its number or 0)"""
        at = self.begin[keys >> self.shift]
        last = len(self.keys) - 1
        on = np.flatnonzero(self.keys[at] < keys)
        while len(on):
            at[on] += 1
            on = on[(at[on] < last) & (self.keys[at[on]] < keys[on])]
        there = self.keys[at] == keys
        return there, np.where(there, self.values[at], 0)


#: What the key of a context differs in from that of the same letters as a run.
_CONTEXT = np.uint64(0xA5A5A5A5A5A5A5A5)


class Ratios:
    """The table of one model, and the words met so far."""

    def __init__(self, keys: np.ndarray, ratios: np.ndarray) -> None:
        self.table = Table(keys.view(np.uint64), ratios)
        self.words: dict[str, tuple[float, int, float]] = {}

    def of(self, words: list[str]) -> np.ndarray:
        """Per word: log-likelihood ratio, letters (the end is one), ratio of its first STEM letters."""
        raw = np.frombuffer((END.join(words) + END).encode("utf-32-le"), np.uint32)
        word = np.cumsum(raw == ord(END)) - (raw == ord(END))
        place = np.arange(len(raw)) - np.searchsorted(word, np.arange(len(words)))[word]
        before = [np.zeros(len(raw), np.uint64)]  # keys of the letters before each, as many as the list's index
        start = np.zeros(1, np.uint64)
        for _ in range(ORDER):
            now = _extend(before[-1], raw)
            start = _extend(start, np.zeros(1, np.uint32))
            before.append(np.where(place > 0, np.concatenate([now[:1], now[:-1]]), start[0]))
        ratio = np.zeros(len(raw))
        on = np.arange(len(raw))
        for order in range(ORDER, 0, -1):
            there, value = self.table.find(_extend(before[order - 1][on], raw[on]) ^ np.uint64(order))
            ratio[on[there]] += value[there]
            on = on[~there]
            if order > SHARED:
                ratio[on] += self.table.find(before[order - 1][on] ^ np.uint64(order - 1) ^ _CONTEXT)[1]
        n = len(words)
        return np.stack([np.bincount(word, ratio, n), np.bincount(word, minlength=n), np.bincount(word, np.where(place < STEM, ratio, 0), n)], 1)

    def texts(self, plain: list[str]) -> list[np.ndarray]:
        """Per text, the numbers of each of its words."""
        rows = [t.split() for t in plain]
        new = list({w for r in rows for w in r if w not in self.words})
        for lo in range(0, len(new), 20_000):
            some = new[lo:lo + 20_000]
            self.words.update(zip(some, map(tuple, self.of(some).tolist()), strict=True))
        out = [np.array([self.words[w] for w in r]).reshape(-1, 3) for r in rows]
        if len(self.words) > REMEMBERED:
            self.words.clear()
        return out


#: Ranks of the most toxic beginnings that count: what is said once may be chance, what recurs is not.
RANKS = (1, 2, 3, 5)
FEATURES = ["whole", "word", "stretch", *[f"start{k}" for k in RANKS], "size"]


def features(rows: list[np.ndarray]) -> np.ndarray:
    """Per text, from its words' (ratio, letters, ratio of the beginning): mean ratio by letter of the whole, of the most toxic word and stretch, and of
    the beginnings of the RANKS by toxicity (of the last if there are fewer); the log of the number of words."""
    out = np.zeros((len(rows), len(FEATURES)))
    for k, x in enumerate(rows):
        if len(x):
            r, n, t = x.T
            sr, sn = np.concatenate([[0], np.cumsum(r)]), np.concatenate([[0], np.cumsum(n)])
            w = min(WINDOW, len(r))
            start = np.sort(t)[::-1] / STEM
            out[k] = sr[-1] / sn[-1], (r / n).max(), ((sr[w:] - sr[:-w]) / (sn[w:] - sn[:-w])).max(), *[start[min(j, len(start)) - 1] for j in RANKS], np.log(len(r))
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic fit by Newton steps, the last one the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)) * len(x)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * len(x) * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _part(id_col: str) -> F.Column:
    """crc32 of the id / 5 mod 4."""
    return F.pmod(F.floor(F.crc32(F.col(id_col).cast("string")) / 5), F.lit(4))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train, broadcast_rows: int = BROADCAST_KEYS) -> DataFrame:
    """(_id, text, label, part): training rows; part = crc32 of the id / 5 mod 4."""
    one = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
           .agg(F.max(F.col(label_col).cast("int")).alias("label")).filter("label in (0, 1)"))
    rows = docs.filter(train).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    one = F.broadcast(one) if one.count() <= broadcast_rows else one
    return rows.join(one, "_id").select("_id", "text", "label", _part("_id").alias("part"))


def _keyed(batches):
    """Keys and ratios of rows (kind, run, ratio)."""
    import pyarrow as pa

    for b in batches:
        keys = run_keys(b.column(1).to_pylist()) ^ np.where(b.column(0).to_numpy() == 1, _CONTEXT, np.uint64(0))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column(2).cast(pa.float32())], names=["key", "ratio"])


def joined_ratios(words: DataFrame, tables: DataFrame) -> DataFrame:
    """(word, ratio, letters, start) of distinct words, by joins with the tables of one model."""
    rows = words.select("word", F.posexplode(letter_runs(F.col("word"))).alias("place", "run"))
    total = F.lit(0.0)
    runs, contexts = tables.filter("kind = 0").select("run", "ratio"), tables.filter("kind = 1").select("run", "ratio")
    for order in range(1, ORDER + 1):
        rows = rows.join(runs.toDF("_r", f"r{order}"), F.substring("run", ORDER - order + 1, order) == F.col("_r"), "left").drop("_r")
        back = total
        if order > SHARED:
            rows = rows.join(contexts.toDF("_r", f"c{order}"), F.substring("run", ORDER - order + 1, order - 1) == F.col("_r"), "left").drop("_r")
            back = total + F.coalesce(f"c{order}", F.lit(0.0))
        total = F.coalesce(F.col(f"r{order}"), back)
    rows = rows.select("word", "place", total.alias("ratio"))
    return rows.groupBy("word").agg(F.sum("ratio").alias("ratio"), F.count("*").cast("double").alias("letters"), F.sum(F.when(F.col("place") < STEM, F.col("ratio")).otherwise(0.0)).alias("start"))


def _joined_features(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """(_key, the features) of texts (_key long, _plain), by joins."""
    words = rows.select("_key", F.posexplode(words_of(F.col("_plain"))).alias("i", "word"))
    ratios = cut(joined_ratios(words.select("word").distinct(), tables))
    lists = words.join(ratios, "word").groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("i", "ratio", "letters", "start"))).alias("words"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            lists = [np.array([(w["ratio"], w["letters"], w["start"]) for w in x]).reshape(-1, 3) for x in pdf["words"]]
            yield pd.DataFrame(features(lists), columns=FEATURES).assign(_key=pdf["_key"].to_numpy())

    return lists.mapInPandas(run, ", ".join(f"{c} double" for c in FEATURES) + ", _key long")


def _features(docs: DataFrame, tables: DataFrame, model: int, keep: list[str], text_col: str) -> DataFrame:
    """The columns `keep` and the features."""
    tables = tables.filter(F.col("model") == model)
    if tables.count() <= MODEL_ROWS:
        rows = tables.select("kind", "run", "ratio").mapInArrow(_keyed, "key long, ratio float").toArrow()
        shared = docs.sparkSession.sparkContext.broadcast((rows["key"].to_numpy(), rows["ratio"].to_numpy()))
        del rows
        plain = docs.select(*[F.col(c) for c in keep], plain_text(text_col).alias("_plain"))
        model: list[Ratios] = []  # built once in each task, and gone with it

        def run(texts):
            if not model:
                model.append(Ratios(*shared.value))
            return list(features(model[0].texts(texts)).T)

        return add_columns(plain, keep, "_plain", run, ", ".join(f"{c} double" for c in FEATURES))
    rows = cut(docs.select(F.monotonically_increasing_id().alias("_key"), F.struct(*[F.col(c) for c in keep]).alias("_keep"), plain_text(text_col).alias("_plain")))
    got = rows.select("_key", "_keep").join(_joined_features(rows, tables), "_key", "left")
    return got.select("_keep.*", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in FEATURES])


def score_toxicity(docs: DataFrame, labels: DataFrame, train, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: the id) and score double. `train`: boolean column, the ids that may teach."""
    keep = keep or [id_col]
    tables = model_tables(labelled(docs, labels, id_col, text_col, label_col, train))
    apart = labels.filter(F.col(label_col).isNotNull() & (_part(id_col) == 3))
    share = min(1.0, CALIBRATION_ROWS / max(1, apart.select(id_col).distinct().count()))
    some = apart.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(share * 1_000_000))
    cal = _features(labelled(docs, some, id_col, text_col, label_col, train), tables, 0, ["label"], "text").toPandas()
    if cal["label"].nunique() < 2:
        return docs.select(*[F.col(c) for c in keep], F.lit(0.0).alias("score"))
    x = cal[FEATURES].to_numpy()
    mean, std = x.mean(0), x.std(0) + 1e-9
    weights = logistic((x - mean) / std, cal["label"].to_numpy(float)).tolist()
    z = F.lit(weights[-1])
    for name, m, s, w in zip(FEATURES, mean.tolist(), std.tolist(), weights, strict=False):
        z = z + w * F.greatest(F.lit(-20.0), F.least(F.lit(20.0), (F.col(name) - m) / s))
    return _features(docs, tables, 1, keep, text_col).select(*[F.col(c) for c in keep], (1 / (1 + F.exp(-z))).alias("score"))
