"""Shared pieces of the text operators: row keys, lineage cuts, word hashing."""

from __future__ import annotations

from uuid import uuid4

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tallybox.session import cut as cut
from tallybox.session import shared_folder

#: The separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` on text that keeps its capitals.
WORD_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str, text_col: str) -> list[Column]:
    """128 bits that stand for a row: rows equal in id and text share them, and get the same result."""
    return [F.xxhash64(id_col, text_col).alias("_k1"), F.xxhash64(F.lit(1), text_col, id_col).alias("_k2")]


#: Rows of a table that is broadcast at most, and entries of its lists together; a longer one is joined in a shuffle, with the same result.
BROADCAST_KEYS, BROADCAST_ENTRIES = 500_000, 4_000_000


def few(df: DataFrame, lists: str | None = None) -> DataFrame:
    """`df`, written down, and marked for a broadcast if it is short, the arrays of the column `lists` included."""
    df = cut(df)
    size = df.agg(F.count("*").alias("n"), (F.coalesce(F.sum(F.size(lists)), F.lit(0)) if lists else F.lit(0)).alias("e")).first()
    return F.broadcast(df) if size["n"] <= BROADCAST_KEYS and size["e"] <= BROADCAST_ENTRIES else df


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: smaller than a checkpoint where rows hold texts."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def packed(docs: DataFrame, *columns: Column) -> DataFrame:
    """`docs` as one column `_row`, with `columns` beside it, so that names of its columns clash with none of an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *columns)


def folded_words(text: str | Column) -> Column:
    """Words of the class above, capitals kept; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


# --- words of a batch, hashed ----------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads low differences over all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def span_hashes(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of x[start:end] for each pair: two blocks of a power of two that cover the span, blocks being hashed from their
    halves. Unlike a polynomial it has no sequences that always collide."""
    n = (end - start).astype(np.int64)
    out = np.zeros(len(n), np.uint64)
    level = np.frexp(np.maximum(n, 1))[1] - 1
    h = mix(x ^ _ODD)
    for k in range(int(level.max(initial=-1)) + 1):
        on = np.flatnonzero((level == k) & (n > 0))
        if len(on):
            out[on] = mix(mix(h[start[on]] + _ODD) * _ODD ^ h[end[on] - (1 << k)]) + n[on].astype(np.uint64)
        w = 1 << k
        if len(h) <= w:
            break
        h = mix(mix(h[:-w] + np.uint64(k + 1)) * _ODD ^ h[w:])
    return mix(out)


#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z; all others become spaces.
FOLD = bytes(c if c >= 0x80 or 0x30 <= c < 0x3A or 0x61 <= c < 0x7B else c + 32 if 0x41 <= c < 0x5B else 32 for c in range(256))


def hashed_words(texts: list[bytes], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each text's words begin (one more entry than texts).

    Words are what spaces and control characters 9-13 separate; with `fold` those of the class above."""
    rows = [t.translate(FOLD).split() if fold else t.split() for t in texts]
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
    return np.fromiter((xxh3_64_intdigest(w) for r in rows for w in r), np.uint64, int(first[-1])), first


def as_bytes(column) -> list[bytes]:
    """An Arrow text column as bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def add_columns(docs: DataFrame, keep: list[str], text_col: str, fn, fields: str, limit: int = 1 << 23) -> DataFrame:
    """`keep` of each row, and the columns that `fn(list of texts)` gives for texts of about `limit` characters, by Arrow: kept columns pass untouched. The
    texts are sent once, also if `keep` names them."""
    names = [f.split()[0] for f in fields.split(", ")]
    at = keep.index(text_col) if text_col in keep else len(keep)
    source = docs.select(*[F.col(c) for c in keep], *[F.col(text_col).alias("_text")][:at == len(keep)])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            texts = b.column(at)
            sizes = pc.utf8_length(texts).fill_null(0).to_pylist()
            for lo, hi in by_size(sizes, limit):
                some = fn(texts.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(i).slice(lo, hi - lo) for i in range(len(keep))] + [x if isinstance(x, pa.Array) else pa.array(x) for x in some], names=[*keep, *names])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:len(keep)]]
    return source.mapInArrow(run, ", ".join([*kept, fields]))


def by_size(sizes: list[int], limit: int):
    """Ranges of rows of about `limit` together at most."""
    lo = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(sizes):
        yield lo, len(sizes)
