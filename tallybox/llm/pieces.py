"""SentencePiece encoding and decoding of BPE models with byte fallback, by suffix-array matching.

A batch's texts are cut into chunks that no piece crosses (a word with the spaces before it, or a newline);
its distinct chunks are concatenated, a terminator between them. A suffix array of that text is built on
64-bit blocks; every piece is binary-searched for its range of occurrences; the resulting edges, sorted by
the place where they end, are relaxed from left to right: of the edges that reach a place the one stands whose
piece may follow the piece before it, that is, whose pair merges to just that pair. That is the BPE result of
each prefix, hence of the chunk. A character that no piece holds becomes its bytes' pieces.

Chunks that begin with two spaces or more hold pieces of equal score, which pairs can't order: these alone are merged by BPE's
definition, beside the suffix array.

Null texts give null, empty texts empty ids; texts and words of any length are whole; repeated rows are coded alike, once for a batch; an empty table gives no
rows. Other columns come back untouched, but for one named `ids`, which the result replaces. As in the library itself, a text's own U+2581 is read as a
space, so decoding returns a space for it; all other texts come back as they were.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybox.llm.common import add_columns

SPACE = "▁"
#: Bytes of distinct chunk text under one suffix array, so that memory does not follow the batch.
SLICE = 1 << 18
#: Characters of text whose distinct chunks are matched together.
BATCH = 6_000_000
END = 0xFF


class Pieces:
    """The model's pieces: space for the space mark, bytes as keys."""

    def __init__(self, model_file: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            m.ParseFromString(f.read())
        if m.trainer_spec.model_type != 2 or m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a BPE model without normalisation is needed")
        self.text = [p.piece.replace(SPACE, " ") for p in m.pieces]
        self.score = [p.score for p in m.pieces]
        kind = [p.type for p in m.pieces]
        self.id = {t.encode(): i for i, t in enumerate(self.text) if kind[i] == 1}
        self.byte = {int(self.text[i][3:5], 16): i for i in range(len(kind)) if kind[i] == 6}
        self.unknown = kind.index(2)
        self.prefix = " " if m.normalizer_spec.add_dummy_prefix else ""
        if any(" " in t.lstrip(" ") or "\n" in t for t in map(bytes.decode, self.id)):
            raise ValueError("pieces that cross a space are not supported")
        order = sorted(self.id.items())
        self.keys, self.key_ids = [k for k, _ in order], np.array([i for _, i in order], np.int32)
        self.sizes = np.array([len(k) for k in self.keys], np.int64)
        self.blocks = -(-int(self.sizes.max()) // 8)
        flat = np.zeros((len(self.keys), 8 * self.blocks), np.uint8)
        top = np.full_like(flat, 0xFF)
        for i, k in enumerate(self.keys):
            flat[i, :len(k)] = top[i, :len(k)] = np.frombuffer(k, np.uint8)
        self.low, self.high = flat.view(">u8").astype(np.uint64), top.view(">u8").astype(np.uint64)
        n = len(self.text)
        self.decoded = [b""] * n
        for k, i in self.id.items():
            self.decoded[i] = k
        for b, i in self.byte.items():
            self.decoded[i] = bytes([b])
        self._follows: dict[int, bool] = {}

    def merge(self, chunk: bytes) -> list[int]:
        """BPE by its definition: the best-scored neighbours merge first, the leftmost of equals."""
        parts = [c.encode() for c in chunk.decode()]
        while len(parts) > 1:
            best = max(((self.score[i], -k) for k in range(len(parts) - 1) if (i := self.id.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return [i for p in parts for i in self.ids(p)]

    def ids(self, part: bytes) -> list[int]:
        if (i := self.id.get(part)) is not None:
            return [i]
        return [self.byte.get(b, self.unknown) for b in part]

    def follows(self, pairs: np.ndarray) -> np.ndarray:
        """Whether the second piece of each pair (first * n + second; first = n: the start) may follow the first."""
        n = len(self.text)
        out = np.empty(len(pairs), bool)
        for k, x in enumerate(pairs.tolist()):
            y = self._follows.get(x)
            if y is None:
                a, b = divmod(x, n)
                want = [b] if a == n else [a, b]
                y = self._follows[x] = self.merge(b"".join(self.decoded[i] for i in want)) == want
            out[k] = y
        if len(self._follows) > 300_000:
            self._follows.clear()
        return out


def suffix_blocks(data: np.ndarray, blocks: int) -> list[np.ndarray]:
    """The first 8 * blocks bytes from each place on, as big-endian numbers."""
    pad = np.concatenate([data, np.full(8 * blocks + 8, END, np.uint8)]).astype(np.uint64)
    key = np.zeros(len(pad) - 8, np.uint64)
    for k in range(8):
        key |= pad[k:k + len(key)] << np.uint64(56 - 8 * k)
    return [key[8 * b:8 * b + len(data)] for b in range(blocks)]


def _bisect(keys: list[np.ndarray], value: np.ndarray, lo: np.ndarray, hi: np.ndarray, after: bool) -> np.ndarray:
    """Per piece, the first place in [lo, hi) of the sorted `keys` that is not below (or that is above) its value."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        at = keys[np.minimum(mid, len(keys) - 1)]
        below = open_ & ((at <= value) if after else (at < value))
        lo = np.where(below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)
    return lo


def edges(model: Pieces, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, piece index in `keys`) of every occurrence of every piece."""
    blocks = suffix_blocks(data, model.blocks)
    order = np.argsort(blocks[0])
    run = np.cumsum(np.diff(blocks[0][order], prepend=blocks[0][order[:1]]) != 0)
    tied = np.flatnonzero(np.bincount(run)[run] > 1)  # the further blocks order only what the first leaves equal
    sub = order[tied]
    order[tied] = sub[np.lexsort([*[b[sub] for b in blocks[:0:-1]], run[tied]])]
    lo, hi = np.zeros(len(model.keys), np.int64), np.full(len(model.keys), len(data), np.int64)
    for b in range(model.blocks):
        sorted_ = blocks[b][order]
        on = np.flatnonzero((model.sizes > 8 * b) & (lo < hi))
        if b == 0:
            lo[on], hi[on] = np.searchsorted(sorted_, model.low[on, 0]), np.searchsorted(sorted_, model.high[on, 0], "right")
        else:
            start, stop = lo[on], hi[on]
            lo[on], hi[on] = _bisect(sorted_, model.low[on, b], start, stop, False), _bisect(sorted_, model.high[on, b], start, stop, True)
    n = np.maximum(hi - lo, 0)
    piece = np.repeat(np.arange(len(n)), n)
    return order[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())], piece


def encode_chunks(model: Pieces, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks, one after the other, and where each chunk's begin (one more entry than chunks)."""
    ids: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    lo = size = 0
    for i, c in enumerate([*chunks, None]):
        if c is None or (size and size + len(c) > SLICE):
            a, b = _encode_slice(model, chunks[lo:i])
            ids.append(a)
            counts.append(b)
            lo, size = i, 0
        size += len(c or b"")
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def _encode_slice(model: Pieces, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    if not chunks:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    n = len(model.text)
    data = np.frombuffer(b"\xff".join(chunks) + b"\xff", np.uint8)
    start = np.concatenate([[0], np.flatnonzero(data == END)[:-1] + 1])
    at, piece = edges(model, data)
    end = at + model.sizes[piece]
    pid = model.key_ids[piece]
    # characters outside the vocabulary: one edge over the whole character, of a piece that fits anywhere
    head = (data & 0xC0) != 0x80
    one = np.zeros(len(data) + 1, bool)
    char_end = np.append(np.flatnonzero(head)[1:], len(data))
    whole = np.zeros(len(data) + 1, np.int64)
    whole[np.flatnonzero(head)] = char_end
    one[at[end == whole[at]]] = True
    odd = np.flatnonzero(head & ~one[:-1] & (data != END))
    at, end, pid = np.concatenate([at, odd]), np.concatenate([end, whole[odd]]), np.concatenate([pid, np.full(len(odd), -1, np.int32)])
    owner = np.cumsum(data == END) - (data == END)
    step = end - start[owner[at]]  # edges are relaxed in the order of their ends within their chunks
    order = np.argsort(step, kind="stable")
    at, end, pid, step = at[order], end[order], pid[order], step[order]
    last = np.full(len(data) + 1, -2, np.int64)  # -2: not reached; -1: a character of its own; n: a chunk's start
    back = np.zeros(len(data) + 1, np.int64)
    last[start] = n
    cuts = np.flatnonzero(np.diff(step, prepend=-1, append=-1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        was, p = last[at[a:b]], pid[a:b].astype(np.int64)
        on = was != -2
        free = on & ((p == -1))
        after = np.where(was == -1, n, was)  # what follows a fallback character begins anew
        test = np.flatnonzero(on & ~free)
        keys, inv = np.unique(after[test] * n + p[test], return_inverse=True)
        good = test[model.follows(keys)[inv]]
        good = np.concatenate([good, np.flatnonzero(free)])
        last[end[a:b][good]] = p[good]
        back[end[a:b][good]] = at[a:b][good]
    # walk back from all chunks' ends at once
    stop = np.flatnonzero(data == END)
    place, chunk, rows, turn = stop.copy(), np.arange(len(chunks)), [], 0
    while len(place):
        on = place > start[chunk]
        place, chunk = place[on], chunk[on]
        if len(place):
            rows.append((chunk, np.full(len(chunk), turn), last[place], place))
            place = back[place]
        turn += 1
    if not rows:
        return np.zeros(0, np.int32), np.zeros(len(chunks), np.int64)
    chunk, turn_, p, place = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort([-turn_, chunk])
    chunk, p, place = chunk[order], p[order], place[order]
    width = np.where(p == -1, place - back[place], 1)
    out = np.repeat(p, width)
    if (p == -1).any():
        raw = np.flatnonzero(out == -1)
        source = np.repeat(back[place], width) + np.arange(len(out)) - np.repeat(np.cumsum(width) - width, width)
        table = np.array([model.byte.get(b, model.unknown) for b in range(256)], np.int64)
        out[raw] = table[data[source[raw]]]
    return out.astype(np.int32), np.bincount(chunk, width, len(chunks)).astype(np.int64)


def _chunks(model: Pieces, text: str) -> list[str]:
    """A word with the space before it, or a newline; runs of spaces and what follows them stay together."""
    out = []
    for k, line in enumerate((model.prefix + text.replace(SPACE, " ")).split("\n")):
        if k:
            out.append("\n")
        if "  " in line or line[-1:] == " ":
            word = ""
            for c in line.replace(" ", "\n ").split("\n"):
                if c == " " or word.strip(" ") == "":
                    word += c
                else:
                    out.append(word)
                    word = c
            if word:
                out.append(word)
        elif line:
            first, *rest = line.split(" ")
            if first:
                out.append(first)
            out += [" " + w for w in rest]
    return out


def encode_batch(model: Pieces, texts: list[str | None]) -> list[np.ndarray | None]:
    index: dict[str, int] = {}
    rows = []
    for t in texts:
        rows.append(None if t is None else [index.setdefault(c, len(index)) for c in _chunks(model, t)] if t else [])
    raw = [c.encode() for c in index]
    # pieces of equal score (runs of spaces) follow the leftmost rule, which pairs can't tell: merged by definition
    plain = [i for i, c in enumerate(raw) if b"  " not in c]
    ids, first = encode_chunks(model, [raw[i] for i in plain])
    spaced = [i for i, c in enumerate(raw) if b"  " in c]
    more = [np.array(_merge_spaced(model, raw[i]), np.int32) for i in spaced]
    flat = np.concatenate([ids, *more])
    begin, count = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
    begin[plain], count[plain] = first[:-1], np.diff(first)
    count[spaced] = [len(x) for x in more]
    begin[spaced] = len(ids) + np.cumsum(count[spaced]) - count[spaced]
    out = []
    for r in rows:
        if r is None:
            out.append(None)
            continue
        c = np.array(r, np.int64)
        n = count[c]
        to = np.cumsum(n)
        out.append(flat[np.repeat(begin[c] - (to - n), n) + np.arange(to[-1] if len(to) else 0)])
    return out


def _merge_spaced(model: Pieces, chunk: bytes) -> list[int]:
    """A chunk that begins with several spaces: long runs are merged by halves of equal score from the left."""
    return model.merge(chunk) if len(chunk) <= 64 else _merge_long(model, chunk)


def _merge_long(model: Pieces, chunk: bytes) -> list[int]:
    """The same in passes over the parts by score, for chunks where a search for each merge is too slow."""
    import heapq

    parts = [c.encode() for c in chunk.decode()]
    after, before, alive = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)], [True] * len(parts)
    heap: list[tuple[float, int, bytes]] = []

    def offer(k: int) -> None:
        if k >= 0 and after[k] >= 0 and (i := model.id.get(both := parts[k] + parts[after[k]])) is not None:
            heapq.heappush(heap, (-model.score[i], k, both))

    for k in range(len(parts)):
        offer(k)
    while heap:
        _, k, both = heapq.heappop(heap)
        if not alive[k] or after[k] < 0 or parts[k] + parts[after[k]] != both:
            continue
        gone = after[k]
        parts[k], after[k], alive[gone] = both, after[gone], False
        if after[gone] >= 0:
            before[after[gone]] = k
        offer(k)
        offer(before[k])
    return [i for k, p in enumerate(parts) if alive[k] for i in model.ids(p)]


def decode_ids(model: Pieces, ids) -> str:
    out = b"".join([model.decoded[i] for i in ids]).decode("utf-8", "replace")
    return out[len(model.prefix):] if out.startswith(model.prefix) else out


_loaded: dict[str, Pieces] = {}


def load(model_file: str) -> Pieces:
    """The model, once per worker process."""
    if model_file not in _loaded:
        _loaded.clear()
        _loaded[model_file] = Pieces(model_file)
    return _loaded[model_file]


def encode(docs: DataFrame, model_file: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all but `ids`) and ids array<int>. `model_file`: a path on every node."""
    import pyarrow as pa

    def run(texts):
        rows = encode_batch(load(model_file), texts)
        first = np.concatenate([[0], np.cumsum([0 if r is None else len(r) for r in rows])]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int32), *[r for r in rows if r is not None]])
        return [pa.ListArray.from_arrays(pa.array(first), pa.array(flat), mask=pa.array([r is None for r in rows]))]

    return add_columns(docs, keep or [c for c in docs.columns if c != "ids"], text_col, run, "ids array<int>", limit=BATCH)


def decode(encoded: DataFrame, model_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns, and the text that the ids stand for (null for null): pieces joined as hexadecimal bytes, inside the JVM,
    so that no second Python worker stands beside the encoder's. Ids outside the vocabulary stand for nothing."""
    model = load(model_file)
    table = F.split(F.lit(",".join(x.hex() for x in model.decoded)), ",")  # folded to a constant
    text = F.unhex(F.array_join(F.transform(F.col(ids_col), lambda i: F.get(table, i)), "")).cast("string")
    if model.prefix:
        text = F.when(F.startswith(text, F.lit(model.prefix)), F.substr(text, F.lit(len(model.prefix) + 1))).otherwise(text)
    return encoded.withColumn(out_col, text)
