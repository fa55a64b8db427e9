"""The text operators on small tables: results against plain Python, and the odd cases: nulls in any column, empty and very
long texts, ties, repeated rows, empty tables, extra columns whose names clash."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybox.llm import graph, pages, pieces, quality, stages, substring_dedup, suffixes, toxicity, vectors
from tallybox.llm.common import hashed_words
from tallybox.llm.decontaminate import decontaminate, drop_contaminated
from tallybox.llm.licenses import notices, scan_licenses
from tallybox.llm.line_dedup import dedup_lines
from tallybox.llm.near_dedup import alignment, drop_near_duplicates, labelled_kmers, near_duplicates
from tallybox.llm.queries import model_file
from tallybox.llm.substring_dedup import remove_repeats

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, spans string, ids string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(WORDS) + str(r.randrange(400)) for _ in range(n)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 0.5, 7, "x", "y") for i, t, s in rows], DOCS)


ODD = [(None, None, None), (1, None, "a"), (2, "", "b"), (3, " \n\t ", None), (4, "é", "a"), (5, "one two", "b"), (5, "one two", "b"), (6, "Wide " * 60_000, "c"), (7, "x" * 200_000, "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return docs(spark, [])


def test_decontamination_marks_words_and_items(spark):
    item = words(14, 1)
    rows = [(1, "Start. " + " ".join(item).upper() + " end", "a"), (2, " ".join(item[:9]), "a"), (3, "x y z tiny Item w", "a"), (4, "tinyitem", "b")]
    items = spark.createDataFrame([(10, ", ".join(item)), (9, "Tiny item"), (8, None), (None, "")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate(docs(spark, rows), items).collect()}
    assert got == {1: (16, 14, ["10"]), 2: (9, 0, []), 3: (6, 2, ["9"]), 4: (1, 0, [])}
    assert {r.doc_id for r in drop_contaminated(docs(spark, rows), items).collect()} == {2, 4}


def test_decontamination_odd_cases(spark, odd, nothing):
    items = spark.createDataFrame([(1, "wide wide"), (2, None)], "item_id long, text string")
    got = decontaminate(odd, items).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id: r.n_hit for r in got}[6] == 60_000
    assert decontaminate(nothing, items).count() == 0
    assert decontaminate(odd, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert drop_contaminated(odd, items).columns == odd.columns


TRICKY = ["", "a", " a", "a  b", "\n", "x\n y", "日本 é\u0000", "a   b      c\n\n   d ", " ", "  ", "x  ", "naïve 😀😀", "a" * 300, "=" * 200 + " " * 50 + "x", "\ttab", "end\n", " " * 33 + "the cat", "русский текст", "<s> <0x0A>"]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model_file())
    texts = [*TRICKY, " ".join(words(500, 2)), None]
    model = pieces.load(model_file())
    for t, ids in zip(texts, pieces.encode_batch(model, texts), strict=True):
        if t is None:
            assert ids is None
        else:
            assert list(ids) == lib.encode(t), t[:40]
            assert pieces.decode_ids(model, ids.tolist()) == t


def test_pieces_odd_cases(spark, odd, nothing):
    out = pieces.decode(pieces.encode(odd, model_file(), keep=["doc_id", "text"]), model_file())
    assert out.filter(~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0
    assert out.filter("text = ''").first()["ids"] == []
    assert pieces.encode(nothing, model_file()).count() == 0


def labelled_docs(spark, bad):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        y = int(i % 3 == 0)
        rows.append((i, bad(r, y, " ".join(words(r.randrange(20, 80), i))), "a"))
        labels.append((i, 1 - y, y))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(out, labels, col, flip, at):
    y = {r.doc_id: r[col] for r in labels.collect()}
    rows = [(r.score, y[r.doc_id]) for r in out.collect() if r.doc_id % 5 == 0]
    return np.mean([(s >= at) == bool(v) for s, v in rows])


def test_quality_held_out(spark):
    d, labels = labelled_docs(spark, lambda r, y, t: " ".join(w.upper() + "!!" for w in t.split()) if y else t)
    out = quality.score_quality(d, labels, F.col("doc_id") % 5 != 0)
    assert accuracy(out, labels, "quality", False, 0.5) > 0.95


def test_toxicity_held_out(spark):
    d, labels = labelled_docs(spark, lambda r, y, t: t + " grumpfel" + r.choice(["en", "st", "ig"]) if y else t)
    out = toxicity.score_toxicity(d, labels, F.col("doc_id") % 5 != 0)
    assert accuracy(out, labels, "toxic", False, 0.5) > 0.95


def test_toxicity_by_joins_equals_tables_in_memory(spark, monkeypatch):
    d, labels = labelled_docs(spark, lambda r, y, t: t + " Grümpfel-" + r.choice(["en", "ст", "日本"]) if y else t)
    d = d.union(docs(spark, ODD))
    want = {(r.doc_id, r.text): r.score for r in toxicity.score_toxicity(d, labels, F.col("doc_id") % 5 != 0, keep=["doc_id", "text"]).collect()}
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 10)
    got = toxicity.score_toxicity(d, labels, F.col("doc_id") % 5 != 0, keep=["doc_id", "text"]).collect()
    assert len(got) == 600 + len(ODD) and all(r.score == pytest.approx(want[r.doc_id, r.text], abs=1e-4) for r in got)


def plain_kneser_ney(words, c):
    """The log-probability of each word's letters under class c, straight from the definition; words: (word, ordinary count, toxic count)."""
    top: dict = {}
    for w, *n in words:
        x = "\0" * 4 + w + "\1"
        for i in range(len(w) + 1):
            top.setdefault(x[i:i + 5], [0, 0])
            top[x[i:i + 5]] = [p + q for p, q in zip(top[x[i:i + 5]], n, strict=True)]
    levels = {5: top}
    for o in (4, 3, 2, 1):
        now: dict = {}
        for g, v in levels[o + 1].items():
            seen = [int(x > 0) for x in v]
            seen = [max(seen)] * 2 if o == 2 else seen
            now[g[1:]] = [p + q for p, q in zip(now.get(g[1:], [0, 0]), seen, strict=True)]
        levels[o] = now

    def p(g):
        if not g:
            return 1 / 256
        of = [v[c] for h, v in levels[len(g)].items() if h[:-1] == g[:-1] and v[c] > 0]
        low = p(g[1:])
        return low if not of else max(levels[len(g)].get(g, [0, 0])[c] - 0.75, 0) / sum(of) + 0.75 * len(of) / sum(of) * low

    return lambda w: sum(np.log(p(("\0" * 4 + w + "\1")[i:i + 5])) for i in range(len(w) + 1))


def test_ratios_equal_kneser_ney_by_its_definition(spark):
    texts = [("plain words and more plain words", 0), ("nasty worm", 1), ("more words", 0), ("nasty plain nastier", 1), ("änd wörms", 0)]
    known = spark.createDataFrame([(t, y, 0) for t, y in texts], "text string, label int, part long")
    counts: dict = {}
    for t, y in texts:
        for w in t.split():
            counts.setdefault(w, [0, 0])[y] += 1
    both = [plain_kneser_ney([(w, *n) for w, n in counts.items()], c) for c in (0, 1)]
    tables = toxicity.model_tables(known).filter("model = 1")
    rows = tables.select("kind", "run", "ratio").mapInArrow(toxicity._keyed, "key long, ratio float").toPandas()
    some = ["plain", "nastiest", "worm", "wörm", "zzz", "a"]
    got = toxicity.Ratios(rows["key"].to_numpy(), rows["ratio"].to_numpy()).of(some)[:, 0]
    assert np.allclose(got, [both[1](w) - both[0](w) for w in some], atol=1e-4)


def test_classifiers_odd_cases(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, None), (2, None, 0), (None, 1, 1), (5, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for f in (quality.score_quality, toxicity.score_toxicity):
        assert f(odd, labels, F.lit(True)).filter("score between 0 and 1").count() == len(ODD)
        assert f(nothing, labels, F.lit(True)).count() == 0
        assert f(odd, labels.limit(0), F.lit(True)).filter("score between 0 and 1").count() == len(ODD)


def test_isotonic_rises(spark):
    x, y = quality.isotonic(np.array([1.0, 2.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 0.0, 1.0]))
    assert (np.diff(y) > 0).all() and np.isclose(y[0], 0) and np.isclose(y[-1], 1) and len(x) == len(y)


def plain_repeats(texts, window=35):
    rows = [t.encode().split() if t else [] for t in texts]
    seen: dict = {}
    for w in rows:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i:i + window])] = seen.get(tuple(w[i:i + window]), 0) + 1
    out = []
    for w in rows:
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                keep[i:i + window] = [False] * window
        out.append(b" ".join(x for x, k in zip(w, keep, strict=True) if k).decode())
    return out


def test_substring_dedup_equals_brute_force(spark):
    a, b, c = words(60, 10), words(90, 11), words(36, 12)
    texts = [" ".join(words(50, 1) + a + words(9, 2)), " ".join(a + words(70, 3)), " ".join(b + ["edit"] + b[:40]), " ".join(b[:44] + ["other"] + b[45:]), " ".join(c[:35]), " ".join(c), "same " * 120, " ".join(words(34, 13)), " ".join(words(34, 13)), None, ""]
    r = random.Random(1)
    for i in range(60):
        base = words(200, 100 + i % 7)
        at = r.randrange(150)
        base[at:at + r.randrange(1, 9)] = words(r.randrange(12), 900 + i)
        texts.append(" ".join(base[r.randrange(40):]))
    d = docs(spark, [(i, t, "a") for i, t in enumerate(texts)])
    got = {x.doc_id: x.kept_text for x in remove_repeats(d).collect()}
    assert [got[i] for i in range(len(texts))] == plain_repeats(texts)


def test_substring_dedup_odd_cases(spark, odd, nothing):
    got = remove_repeats(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[6].n_removed == 60_000 and by[2].kept_text == "" and by[7].n_removed == 0
    twice = docs(spark, [(1, " ".join(words(40, 1)), "a")] * 2)
    assert [r.n_removed for r in remove_repeats(twice).collect()] == [40, 40]
    assert remove_repeats(nothing).count() == 0


def test_licenses(spark, odd, nothing):
    rows = [(1, " ".join(words(300, 1)) + "\nReleased under the MIT License.\n" + " ".join(words(50, 2)), "a"), (2, "licensed under the apache license version 2.0", "a"), (3, "released under the license", "a")]
    got = {r.doc_id: r.licenses for r in scan_licenses(docs(spark, rows), notices(spark)).collect()}
    assert got == {1: ["MIT"], 2: ["Apache-2.0"], 3: []}
    assert scan_licenses(odd, notices(spark)).filter("n_licenses = 0").count() == len(ODD)
    assert scan_licenses(nothing, notices(spark)).count() == 0
    assert scan_licenses(odd, notices(spark).limit(0)).count() == len(ODD)


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 16))
    x[100:140] = x[0] + r.normal(size=(40, 16)) * 0.22
    x[140:150] = x[0] * 3
    bad = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [float("inf")] + [1.0] * 15), (904, []), (None, [1.0] * 16), (905, [None] + [1.0] * 15), (906, [1.0] * 8)]
    d = spark.createDataFrame([*[(i, v.tolist()) for i, v in enumerate(x)], *bad], "vec_id long, embedding array<double>")
    old = vectors.BLOCK
    vectors.BLOCK = 64  # several pivots, cells and blocks
    try:
        got = {g.vec_id: (g.n_links, g.component_id) for g in vectors.near_vectors(d).collect()}
    finally:
        vectors.BLOCK = old
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    label = np.arange(300)
    for _ in range(300):
        label = np.minimum(label, np.where(hit, label[None, :], 999).min(1))
    assert {i: got[i] for i in range(300)} == {i: (int(hit[i].sum()), int(label[i])) for i in range(300)}
    assert all(got[k] == (0, k) for k in range(900, 907)) and got[None][0] == 0
    assert vectors.near_vectors(d.limit(0)).count() == 0
    # cells of several pivots without a smaller block too; rows of one id are one vertex, other columns are not read
    more = d.filter("vec_id < 300").withColumn("n_links", F.lit(1)).union(spark.createDataFrame([(7, x[200].tolist(), 1), (7, (-x[3]).tolist(), 1)], "vec_id long, embedding array<double>, n_links int"))
    found = vectors.near_vectors(more).collect()
    assert {g.vec_id: (g.n_links, g.component_id) for g in found if g.vec_id not in (7, 200)} == {i: got[i] for i in range(300) if i not in (7, 200)}
    assert {(g.vec_id, g.component_id) for g in found if g.vec_id in (7, 200)} == {(7, 7), (200, 7)} and len(found) == 302 and found[0].asDict().keys() == {"vec_id", "n_links", "component_id"}


def test_near_duplicates(spark):
    base = words(200, 1)
    rows = [(1, " ".join(base), "a"), (2, " ".join(base[:90] + ["edit"] + base[91:]), "a"), (3, " ".join(words(200, 2)), "a"), (4, " ".join(base).upper(), "b"), (5, " ".join(reversed(base)), "b"), (6, "tiny", "a"), (7, "Tiny", "b")]
    hub = words(150, 9)
    r = random.Random(2)
    for i in range(100, 160):
        t = list(hub)
        for k in r.sample(range(150), 2):
            t[k] = f"edit{i}x{k}"
        rows.append((i, " ".join(t), "a"))
    rows.append((99, " ".join(hub), "c"))
    got = {x.doc_id: x.class_id for x in near_duplicates(docs(spark, rows)).collect()}
    assert [got[i] for i in range(1, 8)] == [1, 1, 3, 1, 5, 6, 6]
    assert all(got[i] == 99 for i in range(99, 160) if i in got)
    stay = drop_near_duplicates(docs(spark, rows))
    assert sorted(x.doc_id for x in stay.collect()) == [1, 3, 5, 6, 99]


def test_near_duplicates_of_large_buckets_equal_brute_force(spark):
    """An edit chain and a group around a template, whose members share large buckets with members that are not similar."""
    r = random.Random(5)
    chain = [words(300, 21)]
    for i in range(79):
        t = list(chain[-1])
        for k in r.sample(range(300), 2):
            t[k] = f"step{i}x{k}"
        chain.append(t)
    template = words(174, 22)  # texts of one pair share seven words more, which takes them from 0.77 to 0.82
    group = [template + words(7, 100 + i // 2) + words(19, 200 + i) for i in range(160)]
    rows = [(i, " ".join(t), "a") for i, t in enumerate(chain + group)]
    r.shuffle(rows)
    keys = {i: hashed_words([t.encode()], fold=True)[0] for i, t, _ in rows}
    root = {i: i for i in keys}
    for a in sorted(keys):
        for b in range(a):
            if root[a] != root[b] and alignment(keys[a], keys[b], 0.8) >= 0.8:
                x, y = sorted((root[a], root[b]))
                root = {i: x if c == y else c for i, c in root.items()}
    got = {x.doc_id: x.class_id for x in near_duplicates(docs(spark, rows)).collect()}
    assert got == root


def test_near_duplicates_odd_cases(spark, odd, nothing):
    got = near_duplicates(odd).collect()
    assert len(got) == len(ODD) and all(r.kept for r in got if r.doc_id in (1, 2, 3))
    assert drop_near_duplicates(odd).filter("doc_id = 5").count() == 1
    assert near_duplicates(nothing).count() == 0


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            row[j], before = (before + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_alignment_equals_the_table_of_all_prefixes():
    r = random.Random(3)
    for _ in range(600):
        a = [r.randrange(r.choice([3, 40])) for _ in range(r.randrange(1, 40))]
        b = list(a)
        for _ in range(r.randrange(6)):
            b.insert(r.randrange(len(b) + 1), 1) if r.random() < 0.5 or not b else b.pop(r.randrange(len(b)))
        m = longest_common(a, b)
        want = m / (len(a) + len(b) - m)
        assert alignment(np.array(a, np.uint64), np.array(b, np.uint64), 0.8) == pytest.approx(want if want >= 0.8 else 0)


def test_alignment_needs_the_order():
    w = np.arange(1, 101, dtype=np.uint64)
    assert alignment(w, w, 0.8) == 1.0
    assert alignment(w, w[::-1].copy(), 0.8) == 0.0
    assert len(set(labelled_kmers(np.ones(50, np.uint64)).tolist())) == 46


def thue_morse():
    """Sequences on which a polynomial hash with an odd base collides, whatever the base."""
    x = "a"
    while len(x) < 4096:
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_words_and_texts_that_polynomials_confuse(spark):
    a, b = thue_morse()
    assert len(set(hashed_words([a.encode(), b.encode()])[0].tolist())) == 2
    d = docs(spark, [(1, " ".join(a), "a"), (2, " ".join(b), "a"), (3, a, "a"), (4, b, "a")])
    got = {r.doc_id: r.class_id for r in near_duplicates(d).collect()}
    assert got[3] == 3 and got[4] == 4
    tail = words(34, 8)
    d = docs(spark, [(1, " ".join([a, *tail]), "a"), (2, " ".join([b, *tail]), "a")])
    assert [r.n_removed for r in remove_repeats(d).collect()] == [0, 0]


def test_near_copies_are_caught(spark):
    """Copies with one word in fourteen changed, deleted or added: nine in ten at least are found, and texts of one half in common are not."""
    r = random.Random(8)
    rows = []
    for i in range(120):
        base = words(r.randrange(60, 400), 1000 + i)
        rows.append((2 * i, " ".join(base), "a"))
        for k in r.sample(range(len(base)), len(base) // 14):
            base[k] = r.choice(["", f"new{k}", f"{base[k]} more{k}"])
        rows.append((2 * i + 1, " ".join(base), "a"))
    half = words(150, 77)
    rows += [(1000 + i, " ".join(half + words(100, 2000 + i)), "b") for i in range(40)]
    got = {x.doc_id: x.class_id for x in near_duplicates(docs(spark, rows)).collect()}
    assert np.mean([got[2 * i + 1] == 2 * i for i in range(120)]) >= 0.9
    assert all(got[i] == i for i in range(1000, 1040))


def test_lines(spark, odd, nothing):
    rows = [(i, f"Cookie notice\nown {i}\n\n shared by few {i % 3}", f"s{i}") for i in range(12)]
    got = {r.doc_id: r for r in dedup_lines(docs(spark, rows)).collect()}
    assert got[0].text == rows[0][1] and got[1].text == "own 1\n\n shared by few 1"
    assert (got[1].n_lines, got[1].n_removed, got[0].n_removed) == (4, 1, 0)
    assert dedup_lines(odd).filter("n_removed = 0").count() == len(ODD)
    assert dedup_lines(nothing).count() == 0
    assert dedup_lines(odd, counts=False).columns == odd.columns


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li>Menu</li></ul></nav><!-- c -->
<header>Top</header><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>First<br>second&nbsp;x  y</b><p>third <em>em</em>phasis<aside>side</aside><form>f</form></p><section class="comments"><p>reader</p></section></article><div id="cookie-notice">n</div><footer>&copy;</footer></body></html>"""


def test_pages(spark):
    rows = [(1, "http://h.x/1", PAGE), (2, "http://h.x/2", None), (3, None, ""), (4, "http://h.x/4", "<article><p>cut off &am"), (5, "u", "<body><div class='content'>plain page</div><footer>f</footer>"), (1, "http://h.x/1", PAGE)]
    boiler = " ".join(words(20, 3))
    rows += [(10 + i, "http://same.x/a", f"<body><p>{boiler}</p><p>{' '.join(words(30, 40 + i))}</p></body>") for i in range(4)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in pages.extract_pages(d).collect()}
    assert got[1] == "Head & line First second x y third emphasis"
    assert (got[2], got[3], got[4], got[5]) == ("", "", "cut off &am", "plain page")
    assert got[12] == " ".join(words(30, 42))
    assert pages.extract_pages(d.limit(0)).count() == 0


def test_pages_lose_what_stands_on_most_articles_of_a_host(spark):
    share, quote = " ".join(words(16, 5)), " ".join(words(18, 6))
    own = [" ".join(words(60, 60 + i)) for i in range(12)]
    rows = [(i, "http://h.x/a", f"<main><p>{own[i]}</p>{f'<p>{quote}</p>' if i < 3 else ''}<p>{share}</p></main>") for i in range(12)]
    rows += [(100 + i, "http://copies.x/a", f"<article>{own[0]} version {i}</article>") for i in range(8)]
    rows += [(200, "http://few.x/a", f"<article>{own[1]} {share}</article>"), (201, "http://few.x/a", f"<article>{own[2]} {share}</article>")]
    got = {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == (f"{own[i]} {quote}" if i < 3 else own[i]) for i in range(12))
    assert all(got[100 + i] == f"{own[0]} version {i}" for i in range(8))
    assert got[200] == f"{own[1]} {share}" and got[201] == f"{own[2]} {share}"


ARTICLES = {
    "<article><p data-id='share-2'>kept</p></article>": "kept",
    "<article><p class='news-header'>a</p><p id='form-of-life'>b</p><section id='related-work'>c</section><span class='search-term'>d</span></article>": "a b c d",
    "<article><div class='entry-header'><h1>head</h1></div><p>text</p></article>": "head text",
    "<div class='layout no-sidebar'><article>inside</article></div><p>after</p>": "inside",
    "<div class='widget'><main><p>wrapped</p></main></div>": "wrapped",
    "<form action=x><article>in a form</article><input></form>": "in a form",
    "<article><p title=it's>one</p><p>isn't two</p></article>": "one isn't two",
    "<article><div class='share'>s</div><div class='ad-slot'>x</div><p>t</p><ol class='comments-list'><li>c</li></ol></article>": "t",
    "<div class='sidebar'><article>card</article></div><main>real</main>": "real",
    "<body><div class='search'>s</div><div role='banner'>b</div><p>plain</p></body>": "plain",
    "<article>a &lt;b&gt; &eacute;&#x20;&#8364;<!-- <p>no</p> --> c</article>": "a <b> é € c",
    "<article><p>open <b>bold<p>next</article>": "open bold next",
    "<p x='unclosed>text": "text",
    "<article><section id='social-impact'>a</section><h2 id='share-prices'>b</h2><p class='menu-planning'>c</p><div id='comment-on-results'>d</div><h2 id='how-to-share'>e</h2></article>": "a b c d e",
    "<article><p>t</p><div class='post-comments'>1</div><div class='user-comments'>2</div><div class='site-nav'>3</div><div class='post-share'>4</div><div class='wp-sidebar'>5</div><div class='comment-list'>6</div></article>": "t",
    "<body><div class='main-menu'>m</div><div id='top-nav'>n</div><div class='cookieNotice'>c</div><p>plain</p></body>": "plain",
    "<body><div class='content'>the real text</div><article class='teaser'>card</article><article class='post-card'>card</article></body>": "the real text",
    "<article class='post preview-mode'>own</article>": "own",
    "<article><div class='ad'>x<p>y</p></div>z</article>": "z",
}


@pytest.mark.parametrize("html", ARTICLES)
def test_page_blocks(html):
    assert " ".join(pages.blocks(html)[0]) == ARTICLES[html]


def plain_pages(rows, around=()):
    """Texts of (host, marked, words) by the definition: counts of all runs of DEPTH words over the host's distinct streams. around: (host, words, number of streams) of surroundings."""
    streams = {(h, m, tuple(w)) for h, m, w in rows}
    n, seen = {}, {}
    for h, _, _ in streams:
        n[h] = n.get(h, 0) + 1
    for h, w, k in [*[(h, w, 1) for h, _, w in streams], *around]:
        for g in {tuple(w[i:i + pages.DEPTH]) for i in range(len(w) - pages.DEPTH + 1)}:
            seen[h, g] = seen.get((h, g), 0) + k
    out = []
    for h, m, w in rows:
        least, gone = max(pages.FEW, n[h] // 2 + 1) if m else 2, set()
        for i in range(len(w) - pages.DEPTH + 1):
            if seen[h, tuple(w[i:i + pages.DEPTH])] >= least:
                gone.update(range(i, i + pages.DEPTH))
        left = [x for i, x in enumerate(w) if i not in gone]
        out.append(" ".join(w if m and 2 * len(left) < len(w) else left))
    return out


@pytest.mark.parametrize("group", [5000, 2])
def test_pages_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    monkeypatch.setattr(suffixes, "PACK", 50 if group == 2 else 200_000)
    r = random.Random(3)
    shared = [words(20, 500 + i) for i in range(4)]
    rows = []
    for i in range(70):
        own = words(r.randrange(5, 60), 600 + i)
        for _ in range(r.randrange(3)):
            at = r.randrange(len(own))
            own[at:at] = r.choice(shared)[r.randrange(6):]
        rows.append((f"h{i % 3}.x", r.random() < 0.6, own))
    rows += [("h0.x", True, words(30, 900 + i) + shared[0]) for i in range(60)] + [("h1.x", False, rows[1][2])] * 3
    html = [(i, f"http://{h}/p", (f"<article>{' '.join(w)}</article>" if m else f"<div>{' '.join(w)}</div>")) for i, (h, m, w) in enumerate(rows)]
    got = {x.page_id: x.text for x in pages.extract_pages(spark.createDataFrame(html, "page_id long, url string, html string").repartition(5)).collect()}
    assert [got[i] for i in range(len(rows))] == plain_pages(rows)


def test_the_host_array_finds_surroundings_and_what_they_mark(spark):
    menu, once = words(25, 40), words(15, 41)
    own = [words(40, 700 + i) for i in range(7)]
    html = [f"<body><nav>{' '.join(menu)}</nav><div class='ad'>{' '.join(words(14, 50 + i))}</div><article>{' '.join(own[i])}</article></body>" for i in range(5)]
    html += [f"<body><div>{' '.join(menu)}</div><div>{' '.join(own[5])}</div></body>", f"<body><div>{' '.join(own[6])} {' '.join(once)}</div><footer>{' '.join(once[:11])}</footer></body>"]
    d = spark.createDataFrame([(i, "http://h.x/a", x, 1) for i, x in enumerate(html)] + [(9, "http://h.x/a", html[0], 1)], "page_id long, url string, html string, n_around int").repartition(3)
    got = {r.page_id: r for r in pages.extract_pages(d).collect()}
    assert [got[i].text for i in range(7)] == [*[" ".join(w) for w in own[:6]], " ".join(own[6] + once)]
    assert [(got[i].n_repeated, got[i].n_around, got[i].n_around_repeated) for i in (0, 4, 5, 6, 9)] == [(0, 39, 25), (0, 39, 25), (25, 0, 0), (0, 11, 0), (0, 39, 25)]


def test_a_megabyte_of_unclosed_tags_takes_seconds():
    import time

    begin = time.perf_counter()
    html = "<article>" + "<p>x" * 120_000 + "</i></b>" * 120_000 + "</article>"
    text = " ".join(pages.blocks(html)[0])
    assert text == " ".join("x" * 120_000) and time.perf_counter() - begin < 20


def test_substring_dedup_of_frequent_prefixes_equals_brute_force(spark, monkeypatch):
    """Anchors and prefixes with more branches than a group may hold, down to suffixes that are equal."""
    monkeypatch.setattr(suffixes, "GROUP", 3)
    monkeypatch.setattr(suffixes, "PACK", 40)
    passage = words(50, 1)
    texts = [" ".join(words(r % 7 + 1, 100 + r) + passage[r % 5:50 - r % 4] + words(r % 9, 200 + r)) for r in range(60)] + [" ".join(words(20, 9) + words(30, 300 + r % 20)) for r in range(40)]
    got = {x.doc_id: x.kept_text for x in remove_repeats(docs(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == plain_repeats(texts)


def test_spans_of_a_group_may_repeat_nowhere():
    import pyarrow as pa

    a, z = substring_dedup._runs(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(a) == len(z) == 0
    spans = [" ".join(words(40, seed)).encode() for seed in (1, 2)]
    group = pa.table({"anchor": [7, 7], "_k1": [1, 2], "_k2": [1, 2], "s": pa.array([0, 3], pa.int32()), "words": spans})
    out = substring_dedup._span_subtrees(35)(group)
    assert out.num_rows == 0 and out.column_names == ["_k1", "_k2", "s", "e"]


def test_licenses_near_the_threshold_and_templates_that_share_a_name(spark):
    text = words(44, 50)  # 40 shingles
    almost, less = text[:41] + ["x"] + text[42:], text[:30] + ["x"] + text[31:36] + ["y"] + text[37:]  # 37 and 30 of them
    templates = spark.createDataFrame([("L", " ".join(text)), ("L", " ".join(words(30, 51))), ("L", " ".join(text)), ("tiny", "two words"), (None, "x y z"), ("empty", " "), ("long", " ".join(words(900, 52)))], "name string, text string")
    far = words(5000, 53)
    rows = [(1, " ".join(almost), "a"), (2, " ".join(less), "a"), (3, " ".join(far[:3000] + words(30, 51) + far[3000:]), "a"), (4, "these two words", "a"), (5, " ".join(far[:100] + words(900, 52) + far[100:]), "a"), (6, " ".join(text + far[:90] + text), "a")]
    got = {r.doc_id: r for r in scan_licenses(docs(spark, rows), templates).collect()}
    assert {k: r.licenses for k, r in got.items()} == {1: ["L"], 2: [], 3: ["L"], 4: ["tiny"], 5: ["long"], 6: ["L"]}
    assert got[3].spans[0].first == 3000 and got[1].spans[0].containment == pytest.approx(37 / 40)
    assert {s.first for s in got[6].spans} >= {0, 134}


def test_pipeline_runs_over_odd_tables(spark, tmp_path):
    import corpus_pipeline

    item, copy = words(15, 70), words(80, 71)
    rows = [*ODD, (20, " ".join(copy), "a"), (21, " ".join(copy[:40] + ["edit"] + copy[41:]), "b"), (22, " ".join(words(20, 72) + item), "a")]
    rows += [(100 + i, f"seen on all sites\n{' '.join(words(30, 100 + i))}", f"s{i}") for i in range(12)]
    clash = docs(spark, rows).selectExpr("*", "1 as _k1", "2 as _kept", "3 as _row", "4 as _gone", "5 as _text", "'d' as decoded", "6 as round_trip")
    clash.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = {r.doc_id: r for r in out.collect()}
    assert sorted(k for k in got if k is not None) == [1, 2, 3, 4, 5, 6, 7, 20, *range(100, 112)] and None in got
    assert all(r.round_trip for r in got.values()) and got[1].ids is None and got[20]._kept == 2 and got[20].decoded == "d"
    assert sum("seen on all sites" in got[100 + i].text for i in range(12)) == 1
    (tmp_path / "none").mkdir()
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (3, 7), (7, 6)], "a long, b long")
    assert {r.v: r.root for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 6: 1, 9: 8, 8: 8}
    assert graph.components(e.limit(0)).count() == 0


def test_stages_keep_columns(spark, odd, tmp_path):
    spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = odd
    for stage in (stages.toxicity, stages.line_dedup, stages.near_dedup, stages.decontamination):
        d = stage(spark, d, str(tmp_path))
        assert d.columns == odd.columns
    out = stages.sentencepiece(spark, d, str(tmp_path))
    assert out.count() == len(ODD) - 1 and out.filter("not round_trip").count() == 0


def test_words_of_the_contract(spark):
    from tallybox.llm.common import LOWER, UPPER, folded_words

    t = "Été ÉTÉ a_b C3-PO naïve x “q” 日本語 \x00z"
    want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(str.maketrans(UPPER, LOWER)))
    got = spark.createDataFrame([(t,)], "t string").select(F.transform(folded_words("t"), lambda w: F.translate(w, UPPER, LOWER)).alias("w")).first().w
    assert got == want
    assert len(hashed_words([t.encode()], fold=True)[0]) == len(want)


def test_quality_equals_plain_normal_equations(spark, monkeypatch):
    """The scores against one ridge fit over all training rows, and the steps of the isotonic fit against their definition."""
    r = random.Random(12)
    rows = []
    for i in range(260):
        good = i % 3 > 0
        t = " ".join(words(r.randrange(5, 80), i)) if good or r.random() < 0.1 else " ".join(w + "$$$" for w in words(r.randrange(5, 40), i))
        rows.append((i, t, "a"))
    labels = [(i, int(i % 3 > 0)) for i in range(0, 260) if i % 7] + [(5000, 1), (3, None)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {x.doc_id: x.score for x in quality.score_quality(docs(spark, rows), lab, F.col("doc_id") % 5 != 0).collect()}

    import zlib

    part = lambda i: zlib.crc32(str(i).encode()) // 5 % 4
    train = [i for i, y in labels if y is not None and i < 260 and i % 5]
    y = {i: q for i, q in labels if q is not None}
    stats = quality.statistics([t for _, t, _ in rows])
    fit, cal = [i for i in train if part(i) != 3], [i for i in train if part(i) == 3]
    x = stats[fit]
    f = quality.Fourier(x.mean(0), x.std(0) + 1e-6)
    z = f(x)
    beta = np.linalg.solve(z.T @ z + quality.RIDGE * len(fit) * np.eye(z.shape[1]) / z.shape[1], z.T @ np.array([y[i] for i in fit], float))
    knots, levels = quality.isotonic(f(stats[cal]) @ beta, np.array([y[i] for i in cal], float))
    raw = f(stats) @ beta
    want = np.clip(0.98 * np.interp(raw, knots, levels) + 0.02 / (1 + np.exp(-np.clip(4 * (raw - 0.5), -30, 30))), 0, 1)
    assert np.allclose([got[i] for i in range(260)], want, atol=1e-6)

    v, q = np.array([r.randrange(30) for _ in range(80)], float), np.array([r.randrange(2) for _ in range(80)], float)
    knots, levels = quality.isotonic(v, q)
    # the fit at v: the largest, over beginnings up to v, of the smallest mean up to an end from v on
    xs = sorted(set(v))
    mean = lambda a, b: q[(v >= a) & (v <= b)].mean()
    plain = [max(min(mean(a, b) for b in xs if b >= x) for a in xs if a <= x) for x in xs]
    assert np.allclose(sorted(set(np.round(plain, 9))), sorted(set(np.round(levels, 9)))) and (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all()


def test_open_spans_travel_as_words_and_copies_of_a_span_spread(spark):
    import pyarrow as pa

    from tallybox.llm.substring_dedup import _run_rows

    texts = [" ".join(words(60, 1) + words(20, 100 + i % 5)) for i in range(40)] + [" ".join(words(300, 500))] * 30 + ["same " * 50]
    out = remove_repeats(docs(spark, [(i, t, "a") for i, t in enumerate(texts)]))
    assert "l4#" not in out._jdf.queryExecution().executedPlan().toString()  # a letter of a spelled window
    got = {r.doc_id: r.kept_text for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == plain_repeats(texts)
    batch = pa.RecordBatch.from_pydict({"_k1": list(range(len(texts))), "_k2": list(range(len(texts))), "_text": texts})
    rows = pa.Table.from_batches(_run_rows(35, 6)([batch])).to_pandas()
    assert rows.groupby(["anchor", "span"]).size().max() == 1  # one of the copies in a batch is dealt by its anchor
