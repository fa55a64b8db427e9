"""MinHash near-dedup by Order MinHash, candidates verified by banded alignment.

Words are folded words, k-mers `SHINGLE` consecutive words (a shorter text is one k-mer), each labelled with
its occurrence number. For each of `SKETCHES` hashes the `KEPT` smallest labelled k-mers, put back in their
text order, make one sketch value: texts agree in it if they share these k-mers and their order.

Two texts are similar if the best alignment of their words, m words in common order, has m / (n1 + n2 - m) >= `min_similarity`: one
edited word costs one word, though it breaks five k-mers. Texts that are similar at 0.8 with all edits scattered share 0.38 of their
k-mers, agree in a sketch value with probability 0.15, and share none of sixteen with 0.08, the worst case; at 0.9, where
copies of one text with a word in twenty changed are, with 1e-4.

Texts of equal words are one class from the start and only one of them goes on. Buckets of equal sketch values
give candidates: in buckets of at most `SMALL` all pairs; in larger ones each member first meets the bucket's hub, the member
whose values are shared most often over all bands (the text that others are edits of). A large bucket whose members are one
class by then is done. In every other one all pairs that are not yet of one class meet exactly: members are parted by
length (texts of one class of lengths and the next can be similar), the members outside the bucket's largest class are dealt
into salted blocks, as are all members, and each block of the ones meets each block of the others in a group of its
own, which holds `BLOCK` texts of a side or so. A group counts the words that two texts share, which bounds their similarity,
and aligns the pairs that can reach it, most alike first, until they are one class. So rows are copied once per
`BLOCK` members outside the largest class, no group is gathered, and no pair of a bucket is left out.
Classes are the components of the links.

Null, empty and wordless texts link with nothing. Texts are whole, however long. Rows equal in id and text are copies of each other. Null ids
sort first. An empty table gives no rows; other columns, whatever their names, are not read, and `drop_near_duplicates` returns them untouched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xxhash import xxh3_128_digest

from tallybox.llm.common import as_bytes, by_size, cut, few, hashed_words, mix, packed, row_key, span_hashes
from tallybox.llm.graph import components

SHINGLE, SKETCHES, KEPT = 5, 16, 2
SMALL = 12
#: Texts, and k-mers of them, on one side of a group in which a large bucket is finished.
BLOCK, BLOCK_KMERS = 512, 1 << 19
#: Sketch values in which a hub and a member must agree to meet as such; members that do not, meet it when the bucket is finished.
AGREE = 2
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def labelled_kmers(words: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the k-mers in text order, each mixed with its occurrence number, so all differ."""
    k = min(shingle, len(words))
    at = np.arange(len(words) - k + 1)
    h = span_hashes(words, at, at + k)
    order = np.argsort(h, kind="stable")
    same = np.diff(h[order], prepend=~h[order[:1]]) != 0
    begin = np.maximum.accumulate(np.where(same, np.arange(len(h)), 0))
    occurrence = np.empty(len(h), np.uint64)
    occurrence[order] = np.arange(len(h)) - begin
    return mix(h + occurrence * _ODD)


def sketch(keys: np.ndarray) -> np.ndarray:
    """SKETCHES values of a text's labelled k-mers."""
    out = np.empty(SKETCHES, np.uint64)
    for lo in range(0, SKETCHES, step := max(1, min(SKETCHES, (1 << 18) // len(keys)))):
        h = mix(keys[:, None] ^ _SEEDS[None, lo:lo + step])
        if len(keys) > KEPT:
            h = np.sort(np.argpartition(h, KEPT - 1, axis=0)[:KEPT], axis=0)
        else:
            h = np.repeat(np.arange(len(keys))[:, None], h.shape[1], 1)
        value = np.zeros(h.shape[1], np.uint64)
        for row in h:
            value = mix(value * _ODD + keys[row])
        out[lo:lo + step] = value
    return out


def alignment(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """m / (n1 + n2 - m) of the longest common subsequence m of two sequences of word hashes, within the band that a result of
    `least` allows; 0 where it falls short of `least`. A row of the alignment is one number of as many bits as `a` has words."""
    need = int(np.ceil(least * (len(a) + len(b)) / (1 + least) - 1e-9))
    short = min(len(a), len(b))
    if not short or need > short:
        return 0.0
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[head:][::-1][:short - head] != b[head:][::-1][:short - head])
    tail = int(differ[0]) if len(differ) else short - head
    left, right = len(a) - need, len(b) - need
    x, y = a[head:len(a) - tail], b[head:len(b) - tail]
    # words that only one side has match nothing
    i, j = np.flatnonzero(np.isin(x, y)), np.flatnonzero(np.isin(y, x))
    m = head + tail
    if m + min(len(i), len(j)) < need:
        return 0.0
    if len(i) and len(j):
        places: dict[int, int] = {}
        for k, w in enumerate(x[i].tolist()):
            places[w] = places.get(w, 0) | 1 << k
        lo, hi = np.searchsorted(i, j - right).tolist(), np.searchsorted(i, j + left, "right").tolist()
        full = row = (1 << len(i)) - 1
        for w, p, q in zip(y[j].tolist(), lo, hi, strict=True):
            on = row & places[w] & ((1 << q) - (1 << p) if p or q < len(i) else full)
            row = ((row + on) | (row - on)) & full
        m += len(i) - row.bit_count()
    return m / (len(a) + len(b) - m) if m >= need else 0.0


def _sketch_rows(batches):
    import pyarrow as pa

    for b in batches:
        texts = as_bytes(b.column(2))
        for lo, hi in by_size([len(t) for t in texts], 1 << 21):
            words, first = hashed_words(texts[lo:hi], fold=True)
            keep, n, same, values = [], [], [], []
            for k in range(hi - lo):
                w = words[first[k]:first[k + 1]]
                if len(w):
                    keep.append(lo + k)
                    n.append(len(w))
                    same.append(np.frombuffer(xxh3_128_digest(w.tobytes()), np.int64))
                    values.append(sketch(labelled_kmers(w)))
            if keep:
                flat = np.concatenate(values).view(np.int64)
                at, same = pa.array(keep), np.stack(same)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array(n, pa.int32()), pa.array(same[:, 0]), pa.array(same[:, 1]),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, SKETCHES, dtype=np.int32)), pa.array(flat))],
                    names=["_k1", "_k2", "n", "c1", "c2", "sketch"])


def _verify(least: float):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            left, right = as_bytes(b.column(2)), as_bytes(b.column(3))
            out = []
            for lo, hi in by_size([len(x) + len(y) for x, y in zip(left, right, strict=True)], 1 << 21):
                words, first = hashed_words(left[lo:hi] + right[lo:hi], fold=True)
                m = hi - lo
                out += [alignment(words[first[k]:first[k + 1]], words[first[m + k]:first[m + k + 1]], least) for k in range(m)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])
    return run


def _shared(level: DataFrame) -> DataFrame:
    """Rows (bucket, band, v, n, fame) whose bucket holds two or more, with its size and hub."""
    sizes = level.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    kept = level.join(sizes, "bucket")
    hub = kept.filter(F.col("size") > SMALL).groupBy("bucket").agg(F.min(F.struct((-F.col("fame")).alias("f"), "v", "n")).alias("hub"))
    return kept.join(hub, "bucket", "left")


def _pairs(shared: DataFrame, values: DataFrame, min_similarity: float) -> DataFrame:
    """Candidate pairs a < b: all of small buckets, and of large ones the hub with each other member that agrees with it in AGREE values."""
    small = shared.filter(F.col("size") <= SMALL).select("bucket", "v", "n")
    x, y = small.toDF("bucket", "a", "na"), small.toDF("bucket", "b", "nb")
    close = F.least("na", "nb") >= min_similarity * F.greatest("na", "nb")
    pairs = x.join(y, "bucket").filter("a < b").filter(close).select("a", "b")
    star = shared.filter("hub.v <> v").filter(F.least("n", "hub.n") >= min_similarity * F.greatest("n", "hub.n"))
    first = F.col("hub.v") < F.col("v")
    star = star.select(F.when(first, F.col("hub.v")).otherwise(F.col("v")).alias("a"), F.when(first, F.col("v")).otherwise(F.col("hub.v")).alias("b")).distinct()
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    star = star.join(values.toDF("a", "sa"), "a").join(values.toDF("b", "sb"), "b").filter(agree >= AGREE).select("a", "b")
    return pairs.union(star).distinct()


def _meet(least: float):
    """Links of a group that make its classes: of texts on the left (side 0 or 2) with texts on the right (1 or 2)."""
    def run(group):
        import pyarrow as pa

        group = group.combine_chunks()
        k1, k2, r1, r2, side, rest, upper = (group.column(c).to_numpy() for c in ("_k1", "_k2", "r1", "r2", "side", "rest", "upper"))
        words, first = hashed_words(as_bytes(group.column("_text")), fold=True)
        keys = [words[lo:hi] for lo, hi in zip(first[:-1], first[1:], strict=True)]
        n = np.array([len(k) for k in keys])
        _, ids = np.unique(np.concatenate([labelled_kmers(k, 1) for k in keys]), return_inverse=True)
        ids = np.split(ids, np.cumsum(n)[:-1])
        rank = np.empty(len(n), np.int64)
        rank[np.lexsort((k2, k1))] = np.arange(len(n))
        root = np.unique(np.stack([r1, r2], 1), axis=0, return_inverse=True)[1].ravel()
        right = np.flatnonzero(side > 0)
        pairs = []
        if len(right):
            there, begin = np.concatenate([ids[k] for k in right]), np.cumsum(n[right]) - n[right]
            mark = np.zeros(max(x.max() for x in ids) + 1, bool)
            for a in np.flatnonzero(side != 1):
                mark[ids[a]] = True
                both = np.add.reduceat(mark[there], begin, dtype=np.int64)
                mark[ids[a]] = False
                need = np.ceil(least * (n[a] + n[right]) / (1 + least) - 1e-9)
                # two members outside the largest class meet twice, and two of the upper lengths in the next cell
                on = np.flatnonzero((both >= need) & (root[right] != root[a]) & ~(rest[right] & (rank[right] < rank[a])) & ~(upper[right] & upper[a]))
                pairs += zip((both[on] / (n[a] + n[right[on]] - both[on])).tolist(), [int(a)] * len(on), right[on].tolist(), strict=True)
        above = list(range(len(n)))

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        links = []
        for _, a, b in sorted(pairs, reverse=True):
            x, y = top(root[a]), top(root[b])
            if x != y and alignment(keys[a], keys[b], least) >= least:
                above[x] = y
                links.append((a, b))
        out = []
        for at in np.array(links, np.int64).reshape(-1, 2).T:
            out.append(pa.StructArray.from_arrays([pa.array(k1[at]), pa.array(k2[at])], names=["_k1", "_k2"]))
        return pa.Table.from_arrays(out, names=["a", "b"])
    return run


def _finish(shared: DataFrame, roots: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between members of large buckets that `roots` leaves in different classes."""
    lengths = F.floor(F.log("n") / F.log(F.lit(1.0001 / least))).cast("int")
    member = shared.filter(F.col("size") > SMALL).select("bucket", "v", "n").join(roots, "v", "left").select("bucket", "v", "n", F.coalesce("root", "v").alias("root"), lengths.alias("length"))
    member = member.select("*", F.explode(F.array("length", F.col("length") - 1)).alias("cell"))
    by_root = member.groupBy("bucket", "cell", "root").agg(F.count("*").alias("c"), F.sum("n").alias("w"), F.min("length").alias("l"))
    cells = (by_root.groupBy("bucket", "cell").agg(F.max(F.struct("c", "w", "root")).alias("top"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.count("*").alias("classes"), F.min("l").alias("l"))
             .filter("classes > 1 and l = cell").select("bucket", "cell", "top", "c", "w"))

    def blocks(c, w):
        return F.greatest(F.ceil(c / BLOCK), F.ceil(w / BLOCK_KMERS)).cast("int")

    cells = cells.select("bucket", "cell", F.col("top.root").alias("largest"), blocks(F.col("c"), F.col("w")).alias("wide"), blocks(F.col("c") - F.col("top.c"), F.col("w") - F.col("top.w")).alias("high"))
    rest = F.col("root") != F.col("largest")
    j, i = F.pmod(F.xxhash64("v"), F.col("wide")).cast("int"), F.pmod(F.xxhash64("v"), F.col("high")).cast("int")
    dealt = member.join(cells, ["bucket", "cell"]).select("bucket", "cell", "v", "root", "wide", "high", rest.alias("rest"), (F.col("length") > F.col("cell")).alias("upper"), j.alias("j"), i.alias("i"))
    as_right = F.transform(F.sequence(F.lit(0), F.col("high") - 1), lambda x: F.struct(x.alias("i"), F.col("j").alias("j"), F.when(F.col("rest") & (x == F.col("i")), 2).otherwise(1).alias("side")))
    others = F.filter(F.sequence(F.lit(0), F.col("wide") - 1), lambda x: F.col("rest") & (x != F.col("j")))
    as_left = F.transform(others, lambda x: F.struct(F.col("i").alias("i"), x.alias("j"), F.lit(0).alias("side")))
    groups = (dealt.withColumn("at", F.concat(as_right, as_left)).join(texts, "v")
              .select("bucket", "cell", "v._k1", "v._k2", F.col("root._k1").alias("r1"), F.col("root._k2").alias("r2"), "rest", "upper", F.explode("at").alias("at"), "_text")
              .select("bucket", "cell", F.col("at.i").alias("i"), F.col("at.j").alias("j"), F.col("at.side").alias("side"), "_k1", "_k2", "r1", "r2", "rest", "upper", "_text"))
    return groups.groupBy("bucket", "cell", "i", "j").applyInArrow(_meet(least), "a struct<_k1:long,_k2:long>, b struct<_k1:long,_k2:long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_similarity: float = 0.8) -> DataFrame:
    """One row per row of `docs`: id, _k1, _k2, class_id (smallest id of its class), kept (it is the one that stays)."""
    keyed = docs.select(F.col(id_col).alias("_id"), *row_key(id_col, text_col), F.col(text_col).alias("_text"))
    rows = cut(keyed.select("_k1", "_k2", "_text").mapInArrow(_sketch_rows, "_k1 long, _k2 long, n int, c1 long, c2 long, sketch array<long>").distinct())
    content = cut(rows.groupBy("c1", "c2").agg(F.min(F.struct("_k1", "_k2")).alias("v"), F.min("n").alias("n"), F.min("sketch").alias("sketch")))
    level = content.select("v", "n", F.posexplode("sketch").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "band", "v", "n")
    sizes = level.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1")
    fame = level.select("bucket", "v").join(sizes, "bucket").groupBy("v").agg(F.sum("c").alias("fame"))
    shared = cut(_shared(level.join(fame, "v")))
    wanted = few(shared.select("v._k1", "v._k2").distinct())
    texts = keyed.join(wanted, ["_k1", "_k2"], "left_semi").select("_k1", "_k2", "_text").dropDuplicates(["_k1", "_k2"])
    texts = cut(texts.select(F.struct("_k1", "_k2").alias("v"), "_text"))
    pairs = cut(_pairs(shared, content.select("v", "sketch"), min_similarity))
    some = texts.join(few(pairs.select("a").union(pairs.select("b")).toDF("v").distinct()), "v", "left_semi")
    found = (pairs.join(some.toDF("a", "ta"), "a").join(some.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
             .mapInArrow(_verify(min_similarity), "a struct<_k1:long,_k2:long>, b struct<_k1:long,_k2:long>, similarity double")
             .filter(F.col("similarity") >= min_similarity).select("a", "b"))
    roots = cut(components(found))
    more = cut(_finish(shared, roots, texts, min_similarity))
    if not more.isEmpty():
        roots = components(roots.toDF("a", "b").union(more))
    by_content = (content.select("c1", "c2", "v").join(roots, "v", "left").select("c1", "c2", F.coalesce("root", "v").alias("root")))
    named = rows.select("_k1", "_k2", "c1", "c2").join(by_content, ["c1", "c2"]).select("_k1", "_k2", "root")
    ids = keyed.select("_id", "_k1", "_k2")
    full = ids.join(named, ["_k1", "_k2"], "left")
    first = full.filter("root is not null").groupBy("root").agg(F.min(F.struct("_id", "_k1", "_k2")).alias("first"))
    out = full.join(first, "root", "left")
    here = (F.col("first._k1") == F.col("_k1")) & (F.col("first._k2") == F.col("_k2"))
    return out.select(F.col("_id").alias(id_col), "_k1", "_k2", F.when(F.col("first").isNull(), F.col("_id")).otherwise(F.col("first._id")).alias("class_id"),
                      F.coalesce(here, F.lit(True)).alias("kept"), F.col("root").isNotNull().alias("_worded"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_similarity: float = 0.8) -> DataFrame:
    """The rows of `docs`, all columns, with one document of each class; of rows equal in id and text one stays."""
    verdict = near_duplicates(docs, id_col, text_col, min_similarity).filter("not kept or _worded")
    verdict = cut(verdict.groupBy("_k1", "_k2").agg(F.min("kept").alias("_kept"), F.count("*").alias("_same")))
    joined = packed(docs, *row_key(id_col, text_col)).join(verdict, ["_k1", "_k2"], "left").filter("_kept is null or _kept")
    if verdict.filter("_kept and _same > 1").isEmpty():
        return joined.select("_row.*")
    twice = joined.filter("_same > 1").dropDuplicates(["_k1", "_k2"])
    return joined.filter("_same is null or _same = 1").union(twice).select("_row.*")
