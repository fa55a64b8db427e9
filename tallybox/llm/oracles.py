"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from tallybox.llm.common import LOWER, UPPER
from tallybox.llm.licenses import NOTICES
from tallybox.llm.weak_rules import ROUNDS, RULES, SHARES, start

_WORDS = rf"""regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

HITS = rf"""
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, w[s:s+9] AS words FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0)),
tok AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS x FROM d),
hit AS (SELECT DISTINCT tok.doc_id, tok.pos, len(win.words) AS n, win.item FROM tok JOIN win ON tok.x = win.words[1]
        WHERE tok.w[tok.pos:tok.pos + len(win.words) - 1] = win.words)"""

DECONTAMINATE = f"""WITH {HITS},
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hit GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""

_VALUES = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(NOTICES.items()))

LICENSES = rf"""WITH t0(name, text) AS (VALUES {_VALUES}),
t1 AS (SELECT name, {_WORDS} AS w FROM t0),
t AS (SELECT DISTINCT name, len(w) AS n, least(5, len(w)) AS k, array_to_string(w[s:s + least(5, len(w)) - 1], ' ') AS sh
      FROM (SELECT name, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS s FROM t1)),
total AS (SELECT name, count(*) AS total FROM t GROUP BY 1),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w))) AS pos FROM d),
g AS (SELECT p.doc_id, p.pos, k.k, array_to_string(p.w[p.pos + 1:p.pos + k.k], ' ') AS sh FROM p, (SELECT DISTINCT k FROM t) k WHERE p.pos + k.k <= len(p.w)),
m AS (SELECT g.doc_id, g.pos, t.name, t.n, t.k, g.sh FROM g JOIN t ON g.sh = t.sh AND g.k = t.k),
v AS (SELECT doc_id, pos, name, k, sh, unnest([pos // (n - k + 1), pos // (n - k + 1) - 1]) AS win FROM m),
held AS (SELECT doc_id, name, win, min(pos) AS first, count(DISTINCT sh) AS c FROM v WHERE win >= 0 GROUP BY 1, 2, 3),
spans AS (SELECT DISTINCT h.doc_id, h.name, h.first FROM held h JOIN total USING (name) WHERE h.c / total.total >= 0.8),
per AS (SELECT doc_id, count(DISTINCT name) AS nl, array_to_string(list_sort(list(DISTINCT name)), ',') AS ls, count(*) AS ns FROM spans GROUP BY 1)
SELECT d.doc_id, coalesce(nl, 0) AS n_licenses, coalesce(ls, '') AS licenses, coalesce(ns, 0) AS n_spans FROM d LEFT JOIN per USING (doc_id)"""

LINES = r"""WITH l AS (SELECT doc_id, coalesce(source, chr(1)) AS site, unnest(range(0, len(string_split(text, chr(10))))) AS pos,
             unnest(string_split(text, chr(10))) AS raw FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, site, pos, raw, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM l),
b AS (SELECT line, min(struct_pack(a := doc_id, b := pos)) AS first FROM t WHERE line <> '' GROUP BY 1 HAVING count(DISTINCT site) >= 10),
k AS (SELECT t.doc_id, t.pos, t.raw, b.line IS NOT NULL AND NOT (b.first.a = t.doc_id AND b.first.b = t.pos) AS gone FROM t LEFT JOIN b ON t.line = b.line),
r AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM k GROUP BY 1)
SELECT d.doc_id, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed, r.text FROM documents d LEFT JOIN r USING (doc_id)"""

FILTER_AUDIT = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT doc_id, t, part, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, concat(CASE WHEN len(w) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' END,
             CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
             CASE WHEN first < doc_id THEN 'E' END) AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
j AS (SELECT c.*, s.*, contains(fails, f) AS failing, before <> '' AND regexp_matches(fails, '[' || CASE before WHEN '' THEN 'x' ELSE before END || ']') AS gone FROM c, s),
r AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed,
             coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant, coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
             coalesce(sum(good) FILTER (NOT gone AND failing), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND failing), 0) AS toxic_lost FROM j GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f) AS shapley FROM r"""

def _rules_sql() -> str:
    """Figures, votes, the rounds of expectation-maximisation as a recursion over the pattern counts, and the verdict."""
    r, classes = range(1, len(RULES) + 1), range(len(SHARES))
    case = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v{j}" for j, (_, _, good, bad) in zip(r, RULES, strict=True))
    vs = ", ".join(f"v{j}" for j in r)
    odds = [" * ".join([f"pi{c}", *[f"CASE v{j} WHEN 1 THEN a{c}_{j} WHEN -1 THEN 1 - a{c}_{j} ELSE 1 END" for j in r]]) for c in classes]
    begin = ", ".join(f"{x}::DOUBLE AS pi{c}, " + ", ".join(f"{y}::DOUBLE AS a{c}_{j}" for j, y in zip(r, row, strict=True)) for c, x, row in zip(classes, SHARES, start([k for _, k, _, _ in RULES]), strict=True))
    a = ", ".join(f"(1 + sum(n * w{c})) / ({len(SHARES)} + sum(n)), " + ", ".join(f"(1 + coalesce(sum(n * w{c}) FILTER (v{j} = 1), 0)) / (2 + coalesce(sum(n * w{c}) FILTER (v{j} <> 0), 0))" for j in r) for c in classes)
    w = ", ".join(f"o{c} / ({' + '.join(f'o{k}' for k in classes)}) AS w{c}" for c in classes)
    o = ", ".join(f"{x} AS o{c}" for c, x in zip(classes, odds, strict=True))
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
s AS (SELECT doc_id, s, list_slice(w, s, s + 7) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS s FROM w)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS k FROM s) WHERE k > 1) GROUP BY 1),
f AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals,
             len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS n_stutter, len(list_distinct(w)) AS n_distinct, len(list_filter(w, lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]\z'))) AS n_plain_ends FROM w LEFT JOIN c USING (doc_id)),
v AS (SELECT *, {case} FROM f),
p AS (SELECT {vs}, count(*) AS n FROM v GROUP BY ALL),
em AS (SELECT 0 AS it, {begin} UNION ALL
       SELECT it + 1, {a} FROM (SELECT it, n, {vs}, {w} FROM (SELECT it, p.*, {o} FROM em, p WHERE it < {ROUNDS})) GROUP BY it),
k AS (SELECT {vs}, o0 / ({' + '.join(f'o{k}' for k in classes)}) AS post FROM (SELECT p.*, {o} FROM em, p WHERE it = {ROUNDS})),
j AS (SELECT v.*, post, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM v JOIN k USING ({vs}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND post >= 0.5 AS kept FROM j"""


DIVERGENCE = rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, lang, source, unnest(w) AS term FROM d) GROUP BY 1, 2, 3),
t AS (SELECT lang, term, sum(n)::BIGINT AS n FROM x GROUP BY 1, 2 HAVING sum(df) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS whole FROM t GROUP BY 1),
k AS (SELECT x.* FROM x JOIN t USING (lang, term)),
g AS (SELECT o.lang, o.source, coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT DISTINCT lang, source FROM d) o LEFT JOIN k USING (lang, source) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, t.term, coalesce(k.n, 0) AS n, 1 + 1000000000 * (coalesce(k.n, 0) + 2) // (g.total + 2 * l.v) AS p, 1 + 1000000000 * (t.n + 2) // (l.whole + 2 * l.v) AS q
      FROM g JOIN t USING (lang) JOIN l USING (lang) LEFT JOIN k ON k.lang = g.lang AND k.source = g.source AND k.term = t.term),
c AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(c.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN c ON c.lang = a.lang AND c.source = a.source AND c.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r)
SELECT * FROM z WHERE part = 'pair' OR rank <= 10"""

SQL = {"op11_source_divergence": DIVERGENCE, "op12_quality_rules": _rules_sql(), "op13_filter_audit": FILTER_AUDIT, "op1_decontaminate": DECONTAMINATE, "op5_license_scan": LICENSES, "op8_line_dedup": LINES}
