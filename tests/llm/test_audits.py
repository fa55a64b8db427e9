"""Source divergence, quality rules and filter interaction against plain Python, and their odd cases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybox.llm import divergence, filter_audit, weak_rules
from tallybox.llm.divergence import audit_sources
from tallybox.llm.filter_audit import audit_filters, later_copies
from tallybox.llm.weak_rules import judge

DOCS = "doc_id long, text string, lang string, source string, value double, part string, n_words long, votes string, term string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(None, None, None, None), (1, None, "a", "s"), (2, "", None, "s"), (3, " \n\t ", "a", None), (4, "é É", "a", "t"), (5, "one two", "b", "s"), (5, "one two", "b", "s"), (6, "Wide " * 60_000, "c", "s"), (7, "x" * 200_000, "c", "s"), (8, "Q!#" * 9, "c", "s")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0.5, "p", 7, "v", "t") for i, t, lang, s in rows], DOCS)


def texts(seed, n, vocabulary, most, letters=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randrange(letters, letters + 4))) for _ in range(vocabulary)]
    return [" ".join(r.choice(words[:r.randrange(1, vocabulary)]) for _ in range(r.randrange(most))) for _ in range(n)], r


# --- source divergence -------------------------------------------------------------------------

def plain_divergence(rows, min_docs, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {i: i + 32 for i in range(65, 91)}
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, t, lang, s in rows:
        lang, s = lang or "", s or ""
        groups[lang].add(s)
        w = term.findall((t or "").translate(lower))
        counts[lang, s].update(w)
        df[lang].update(set(w))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        v = len(kept)
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})
        share = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept})(sum(c[t] for t in kept))
        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -x, k + 1) for k, (x, _, o) in enumerate(pair)]
            lead = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -x, k + 1) for k, (x, _, t) in enumerate(lead[:top])]
    return sorted(out)


@pytest.mark.parametrize("block,frontier,held", [(1_024, 1 << 20, 200_000), (8, 64, 20)])
def test_divergence_equals_plain_python(spark, monkeypatch, block, frontier, held):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    t, r = texts(3, 220, 60, 40)
    rows = [(i, x.upper() if i % 7 == 0 else x, r.choice(["en", "fr", None]), r.choice(["s1", "s2", "S3", "é", "s1", None])) for i, x in enumerate(t)] + ODD
    got = sorted(tuple(x) for x in audit_sources(docs(spark, rows).repartition(5), min_docs=4).collect())
    assert got == plain_divergence(rows, 4, 10)
    values = np.array([list(map(int, x)) for x in np.random.default_rng(1).integers(0, 3, (5, 16))])
    monkeypatch.setattr(divergence, "FRONTIER", frontier)
    ids, levels = divergence.consed(values, 16)
    whole = np.array([int(x.sum()) + 32 for x in values])
    for g, h, x in zip(*divergence.pair_values(levels, ids, whole), strict=True):
        p, q = (1 + 10**9 * (values[k] + 2) // whole[k] for k in (g, h))
        assert x == ((p - q) ** 2 // (p + q)).sum()


def test_equal_subtrees_are_one_node():
    counts = np.zeros((3, 8), np.int64)
    counts[1, 5] = 2
    values, levels = divergence.consed(counts, 8)
    assert len(values) == 2 and [int(x[0].max()) + 1 for x in levels] == [2, 2, 2, 2]  # zeros, and the path to the one count
    assert divergence.shares(np.array([10**12]), np.array([10**12 + 2]))[0] == 1 + 10**9


def test_divergence_without_kept_terms(spark):
    got = [tuple(x) for x in audit_sources(docs(spark, [(1, "a b", "x", "s"), (2, "c", "x", "t"), (3, None, None, None)])).collect()]
    assert sorted(got) == [("x", "s", "pair", "t", 0, 1), ("x", "t", "pair", "s", 0, 1)]
    assert audit_sources(docs(spark, [])).count() == 0


# --- quality rules -----------------------------------------------------------------------------

def plain_figures(t):
    t = t or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    n = len(w)
    windows = Counter(tuple(w[i:i + 8]) for i in range(n - 7))
    inside = {p for i in range(n - 7) if windows[tuple(w[i:i + 8])] > 1 for p in range(i, i + 8)}
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), len(lines), len(re.findall("[A-Z]", t)), sum(a == b for a, b in zip(w, w[1:])), len(set(w)), sum(x[-1].isalnum() for x in w))


def test_figures_equal_plain_python(spark):
    t, r = texts(5, 60, 30, 60)
    t += [" ".join(["a b c d e f g h i j"] * 3), "\n".join(["same line", "same line", " ", "", "other", "same line"]), "x $$ <b> Ab\x0bcd\x85e", " lead\ttail ", "q " * 500, *[x + "\n" + x for x in t[:10]], *[" ".join((x + " ") * 2 for x in t[10:12])]]
    rows = [(i, x, "en", "s") for i, x in enumerate(t)] + [(None, None, "a", "b"), (900, "", "a", "b"), (901, "w " * 70_000, "a", "b")]
    got = {x.doc_id: tuple(x[c] for c in weak_rules.FIGURES) for x in judge(docs(spark, rows)).collect()}
    assert got == {i: plain_figures(x) for i, x, _, _ in rows}


def plain_rounds(patterns, kinds, rounds):
    pi, a = list(weak_rules.SHARES), weak_rules.start(kinds)

    def post(v):
        odds = [p * np.prod([{1: y, -1: 1 - y, 0: 1}[x] for x, y in zip(v, row)]) for p, row in zip(pi, a)]
        return [o / sum(odds) for o in odds]

    for _ in range(rounds):
        w = [(v, n, post(v)) for v, n in patterns]
        total = sum(n for _, n, _ in w)
        pi = [(1 + sum(n * g[c] for _, n, g in w)) / (3 + total) for c in range(3)]
        a = [[(1 + sum(n * g[c] for v, n, g in w if v[j] == 1)) / (2 + sum(n * g[c] for v, n, g in w if v[j])) for j in range(len(kinds))] for c in range(3)]
    return pi, a


def test_accuracies_equal_plain_rounds_and_are_found_again(spark):
    r = random.Random(4)
    kinds, shares = [1, 1, 2, 2, 1, 2], [0.8, 0.12, 0.08]
    right = [[0.97, 0.95, 0.99, 0.96, 0.98, 0.97], [0.1, 0.3, 0.95, 0.9, 0.2, 0.9], [0.95, 0.9, 0.2, 0.1, 0.95, 0.3]]
    patterns = Counter()
    for _ in range(20_000):
        c = r.choices(range(3), shares)[0]
        patterns[tuple(0 if r.random() < 0.1 else 1 if r.random() < y else -1 for y in right[c])] += 1
    rows = sorted((list(v), n) for v, n in patterns.items())
    m = weak_rules.estimate(spark.createDataFrame(rows, "v array<int>, n long"), kinds).first()["m"]
    pi, a = plain_rounds(rows, kinds, weak_rules.ROUNDS)
    assert np.allclose(m["pi"], pi) and np.allclose(m["a"], a)
    assert np.abs(np.array(m["pi"]) - shares).max() < 0.03 and np.abs(np.array(m["a"]) - right).max() < 0.08


def test_rules_keep_clean_and_drop_junk(spark):
    t, r = texts(9, 80, 400, 200, 4)
    t = [x for x in t if len(x.split()) >= 40]
    junk = [" ".join(w + r.choice(["$$$", "###"]) for w in x.split()) for x in t[:8]] + [" ".join(f"{w} {w} {w} {w} {w} {w} {w}" for w in x.split()[:12]) for x in t[8:14]] + [x.upper().replace(" ", "!! ") for x in t[14:20]]
    rows = [(i, x, "en", "s") for i, x in enumerate(t)] + [(1000 + i, x, "en", "s") for i, x in enumerate(junk)] + [(2000, "few words", "a", "b"), (2001, "one two three four five six seven eight nine " * 5, "a", "b")]
    got = {x.doc_id: x for x in judge(docs(spark, rows)).collect()}
    assert not any(got[i].kept for i in got if i >= 1000) and all(got[i].kept for i in range(len(t)))
    assert got[2000].base_failed and got[2001].base_failed and not got[1000].base_failed


def test_rules_odd_cases(spark):
    out = judge(docs(spark, ODD), keep=["doc_id", "votes", "n_words", "part"])
    assert out.columns == ["doc_id", "part", *weak_rules.FIGURES, "votes", "base_failed", "posterior", "kept"]
    assert out.count() == len(ODD) and out.filter("posterior is null or base_failed is null").count() == 0
    assert judge(docs(spark, [])).count() == 0


# --- filter interaction ------------------------------------------------------------------------

def plain_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    smallest = {}
    for i, t, _, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    by = defaultdict(list)
    for i, t, lang, _ in rows:
        x = t or ""
        w = WORD.findall(x)
        fails = {"A"} if len(w) < 100 else set()
        fails |= {f for f, on in (("B", 100 * len(set(w)) < 80 * len(w)), ("C", 100 * len(re.findall("[A-Z]", x)) > 10 * len(x)), ("D", re.search(r"[#$%&*|]", x)), ("E", i is not None and smallest[x] < i)) if on}
        by[lang or ""].append((fails, i in good, i in toxic))
    out = []
    for part, members in by.items():
        total, steps = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = list(members)
            for k, f in enumerate(order):
                gone = [m for m in left if f in m[0]]
                left = [m for m in left if f not in m[0]]
                total[f] += len(gone)
                steps.append((part, order, k + 1, len(left), len(gone), sum(f in m[0] for m in members) - len(gone), sum(m[0] == {f} for m in members), sum(m[1] for m in gone), sum(m[2] for m in gone)))
        out += [(*s, total[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


@pytest.mark.parametrize("split", [2_000, 3])
def test_audit_equals_plain_filters(spark, monkeypatch, split):
    monkeypatch.setattr(filter_audit, "SPLIT", split)
    t, r = texts(11, 40, 300, 260)
    t = [x.upper() if r.random() < 0.2 else x + "|" if r.random() < 0.2 else x for x in t]
    rows = [(i, r.choice(t) if i % 3 else t[0], r.choice(["en", "fr", None]), "s") for i in range(120)] + ODD
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 130, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(x) for x in audit_filters(docs(spark, rows).repartition(5), lab).collect())
    assert got == plain_audit(rows, labels)


def test_later_copies_and_empty_tables(spark):
    rows = [(1, "a", "x", "s"), (1, "a", "x", "s"), (2, "a", "x", "s"), (3, "b", "x", "s"), (None, "a", "x", "s"), (4, None, "x", "s"), (5, "", "x", "s")]
    assert sorted(x.doc_id for x in later_copies(docs(spark, rows)).collect()) == [2, 5]
    assert later_copies(docs(spark, rows)).columns == docs(spark, rows).columns
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(docs(spark, []), none).count() == 0
    assert audit_filters(docs(spark, ODD), none).agg(F.sum("good_lost")).first()[0] == 0
