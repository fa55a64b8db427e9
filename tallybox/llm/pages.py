"""HTML extraction: the article of a page, without what surrounds it.

A page becomes a stream of text blocks, all of them: menus, headers and footers too. Its kept stream is what its marks make likely text: the blocks inside `article` or `main`, else
those outside of elements that hold none (by tag, role, class or id). The rest is its surroundings, in segments between the kept blocks.

Both go through the suffix array of their host first: the words of its pages, each suffix `DEPTH` words deep, in order. Neighbours in it that share all `DEPTH` words are one repeated
run, and the distinct pages that it stands on are counted. Segments that are equal on many pages of a host, as menus are, enter once, with their number. The array is built in parts
(see `suffixes`), so a host may hold any share of the pages; anchors that no host repeats often enough rule most suffixes out before. A run that stands on two distinct pages is boilerplate,
in surroundings and in the text of pages without a mark. A marked article is evidence that its words are text, since articles quote each other: there a run goes only if it stands on at
least `FEW` pages and on more than half of those of the host, and none goes if they cover more than half of the article (then it has copies). What the array leaves of the surroundings (a page's own adverts, comments, forms) goes last, by the rules; `n_around` counts the words of
the surroundings, `n_around_repeated` those that the array found, `n_repeated` those that it took from the kept stream.

Character references are decoded, white space within a block becomes one space, blocks are joined by one space. Null
html is empty; null urls share the empty host. Html of any length is whole, unclosed elements too. Rows that are equal are extracted alike. An empty table
gives no rows. Other columns are returned untouched, but for those named as a result, which it replaces.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybox.llm import suffixes
from tallybox.llm.common import add_columns, as_bytes, by_size, cut, few, hashed_words, mix, written
from tallybox.llm.suffixes import window_anchors

DEPTH = 12
#: Words of a run inside a suffix's first words, the least of which by hash must be repeated if the suffix is.
ANCHOR = 4
#: Distinct streams that a sequence of a marked article must stand in, besides more than half of the host's, to be boilerplate.
FEW = 5

#: Elements whose content is never text of the article.
EXCLUDED_TAGS = frozenset("head title script style noscript template nav footer aside form button select option textarea input iframe svg canvas object audio video dialog menu".split())
#: Roles of what surrounds an article.
EXCLUDED_ROLES = frozenset("banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words in classes and ids of what is no text wherever it stands.
EXCLUDED_NAMES = frozenset("ad ads advert advertisement adverts sponsor sponsored promo cookie cookies consent popup modal newsletter subscribe nav navigation navbar menu breadcrumb breadcrumbs sidebar comment comments disqus respond share sharing social".split())
#: Words that may stand beside them in a class or id; beside any other word they name a subject, as in `share-prices`.
STRUCTURAL_NAMES = frozenset("area bar banner blog body bottom box button buttons column container content desktop entry field footer form global group header holder icons inner item items left link links list main message mobile notice outer overlay page panel post primary reader right row secondary section signup site slot title top unit user widget wp wrap wrapper".split())
#: Words in the class of an `article` that is a card for another page.
TEASER_NAMES = frozenset("card preview promo recommended related teaser".split())
#: Classes and ids that are no text only outside of a marked article.
OUTER_NAMES = frozenset("banner complementary footer form header login masthead notice notices recommended related search site-footer site-header page-footer page-header widget".split())
#: Elements that begin and end a block.
BLOCK_TAGS = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements without content.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: The inside of a start tag: quotes count only after an equals sign.
_INSIDE = r"(?>=\s*(?>\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?|[^>=])*+"
_PIECES = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|title|iframe)(?![\w:-]){_INSIDE}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<attrs>{_INSIDE})>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z", re.I | re.S)
_ATTRS = re.compile(r"([^\s=\"'/>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")


def _names_only(name: str, among: frozenset[str]) -> bool:
    """Whether a class or id is made of words `among`, one at least, and structural ones."""
    pieces = [x for x in re.split("[-_]+", name) if x]
    return any(x in among for x in pieces) and all(x in among or x in STRUCTURAL_NAMES or x.isdigit() for x in pieces)


def _excluded(name: str, attrs: str, in_article: bool, wraps: bool) -> bool:
    """Whether an element is none of the article's text. `wraps`: it holds all articles of the page, which its class can't exclude."""
    if name in EXCLUDED_TAGS:
        return not (wraps and name == "form")
    if name == "header":
        return not in_article
    if name in ("html", "body", "main") or not attrs:
        return False
    roles, names = set(), set()
    for key, value in _ATTRS.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "role":
            roles.update(value.lower().split())
        elif key in ("class", "id"):
            names.update(re.sub("(?<=[a-z])(?=[A-Z])", "-", value).lower().split())  # camel case parts too
    if name == "article":
        return any(_names_only(x, frozenset(("comment", "comments"))) or (not wraps and _names_only(x, TEASER_NAMES)) for x in names)
    if wraps:
        return False
    return not roles.isdisjoint(EXCLUDED_ROLES) or any(_names_only(x, EXCLUDED_NAMES) for x in names) or (not in_article and not names.isdisjoint(OUTER_NAMES))


def _wrappers(tags: list[re.Match]) -> set[int]:
    """Places of start tags whose elements hold every article (or main) of the page."""
    open_: list[tuple[str, int, int]] = []
    counts: dict[str, int] = {}
    total = sum(not m["end"] and m["name"].lower() in ("article", "main") for m in tags)
    found, seen = set(), 0
    if not total:
        return found
    for m in tags:
        name = m["name"].lower()
        if not m["end"]:
            if name not in VOID_TAGS and not m["attrs"].endswith("/"):
                open_.append((name, m.start(), seen))
                counts[name] = counts.get(name, 0) + 1
            seen += name in ("article", "main")
        elif counts.get(name):
            while True:
                at, start, before = open_.pop()
                counts[at] -= 1
                if before == 0 and seen == total:
                    found.add(start)
                if at == name:
                    break
    return found | {start for _, start, before in open_ if before == 0}


ARTICLE, AROUND, RULED = 0, 1, 2


def segments(html: str) -> tuple[list[tuple[int, str]], bool]:
    """The text blocks of a page in order, each with where it stands (in a marked article, outside, in an excluded element), and whether the page marks an article."""
    found: list[tuple[int, str]] = []
    now: list[str] = []
    depth, skip, skip_depth, marked = 0, "", 0, False

    pieces = list(_PIECES.finditer(html))
    wraps = _wrappers([m for m in pieces if m["name"]])

    def close() -> None:
        text = " ".join(unescape("".join(now)).split())
        now.clear()
        if text:
            found.append((RULED if skip else ARTICLE if depth else AROUND, text))

    at = 0
    for m in pieces:
        if m.start() > at:
            now.append(html[at:m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in BLOCK_TAGS:
            close()
        if skip:
            left = False
            if name == skip:
                skip_depth += -1 if m["end"] else 0 if m["attrs"].endswith("/") else 1
                left = skip_depth <= 0
            elif m["end"] and name in ("article", "main", "body", "html"):
                left = True  # an element left open ends with what it stands in
            if left:
                close()
                skip = ""
            if skip or name not in ("article", "main"):
                continue
        if m["end"]:
            if name in ("article", "main") and depth:
                depth -= 1
        elif name not in VOID_TAGS and _excluded(name, m["attrs"], depth > 0, m.start() in wraps):
            close()
            if not m["attrs"].endswith("/"):
                skip, skip_depth = name, 1
        elif name in ("article", "main"):
            depth, marked = depth + 1, True
    if at < len(html):
        now.append(html[at:])
    close()
    return found, marked


def blocks(html: str) -> tuple[list[str], bool]:
    """The kept text blocks of a page, and whether they come from a marked article."""
    found, marked = segments(html)
    return [t for k, t in found if k == (ARTICLE if marked else AROUND)], marked


def _text(htmls: list[str | None]) -> list[list]:
    """The kept text, whether it is marked, and the distinct segments of the surroundings."""
    texts, marks, around = [], [], []
    for h in htmls:
        found, marked = segments(h or "")
        kept, rest, last = [], [], False
        for k, t in found:
            if k == (ARTICLE if marked else AROUND):
                kept.append(t)
                last = False
            elif last:
                rest[-1].append(t)
            else:
                rest.append([t])
                last = True
        texts.append(" ".join(kept))
        marks.append(marked)
        around.append(list(dict.fromkeys(" ".join(x) for x in rest)))
    return [texts, marks, around]


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def _once(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Marks one of the equal keys of each row."""
    order = np.lexsort((key, row))
    once = np.ones(len(key), bool)
    once[order[1:]] = (np.diff(key[order]) != 0) | (np.diff(row[order]) != 0)
    return once


def _slices(batches):
    """Rows _k1, _k2, _host, weight, least, _raw (and more) of about a megabyte: the rows, their words' hashes, and whole suffixes'
    starts with the anchor of each, mixed with the host."""
    for whole in batches:
        texts = as_bytes(whole.column("_raw"))
        for lo, hi in by_size([len(t) for t in texts], 1 << 20):
            b = whole.slice(lo, hi - lo)
            words, first = hashed_words(texts[lo:hi])
            start, anchor, value = window_anchors(words, first, DEPTH, ANCHOR)
            row = np.searchsorted(first, start, "right") - 1
            host = b.column("_host").to_numpy().view(np.uint64)[row]
            yield b, words, first, start, row, mix(value[anchor] ^ host)


def _anchor_rows(batches):
    """The distinct anchors of each row."""
    import pyarrow as pa

    for b, _, _, _, row, anchor in _slices(batches):
        on = _once(row, anchor)
        at = pa.array(row[on])
        yield pa.RecordBatch.from_arrays([pa.array(anchor[on].view(np.int64)), *[b.column(c).take(at) for c in ("_k1", "_k2", "weight", "least")]], names=["anchor", "_k1", "_k2", "weight", "least"])


def _suffix_rows(batches):
    """The suffixes of each row with one of its `anchors`, spelled; one that a row holds twice weighs once."""
    import pyarrow as pa

    for b, words, first, start, row, anchor in _slices(batches):
        lists = b.column("anchors").to_pylist()
        on = np.zeros(len(start), bool)
        bounds = np.searchsorted(row, np.arange(b.num_rows + 1))
        for k, wanted in enumerate(lists):
            span = slice(bounds[k], bounds[k + 1])
            on[span] = np.isin(anchor[span].view(np.int64), np.array(wanted, np.int64))
        start, row, anchor = start[on], row[on], anchor[on]
        letters = suffixes.spell(words, start, DEPTH)
        whole = anchor.copy()
        for x in letters:
            whole = mix(whole ^ x.view(np.uint64))
        weight = np.where(_once(row, whole), b.column("weight").to_numpy()[row], 0.0)
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), *[pa.array(x) for x in letters], b.column("_k1").take(at), b.column("_k2").take(at), pa.array((start - first[row]).astype(np.int32)), pa.array(weight), b.column("least").take(at)],
                                         names=["anchor", *suffixes.letter_names(DEPTH), "_k1", "_k2", "s", "weight", "least"])


def _key(*parts) -> list:
    """128 bits of a unit of text: a page's kept stream, or a segment."""
    return [F.xxhash64(*parts).alias("_k1"), F.xxhash64(F.lit(1), *parts[::-1]).alias("_k2")]


KEY = ["_k1", "_k2"]


def host_units(raw: DataFrame) -> DataFrame:
    """What enters the array: _host, _k1, _k2, _raw, weight (distinct pages that hold it), least (pages that its runs must stand on to be boilerplate).

    `raw`: _host, _marked, _raw, _around, _id. Pages of equal kept streams count as one together, so copies are no boilerplate. Equal units of a host enter once, from the row of the
    least _id."""
    rows = raw.select("*", *[c.alias(n) for c, n in zip(_key("_host", "_marked", "_raw"), ("_s1", "_s2"), strict=True)])
    copies = cut(rows.groupBy("_s1", "_s2", "_host").agg(F.count("*").alias("m")))
    hosts = few(copies.groupBy("_host").agg(F.count("*").alias("n")))
    again = few(copies.filter("m > 1").select("_s1", "_s2", "m"))
    rows = rows.join(again, ["_s1", "_s2"], "left").withColumn("w", (1 / F.coalesce("m", F.lit(1))).cast("double"))
    unit = F.concat(F.array(F.struct(F.lit(True).alias("kept"), F.col("_raw").alias("t"))), F.transform("_around", lambda t: F.struct(F.lit(False).alias("kept"), t.alias("t"))))
    rows = rows.select("_host", "_id", "w", "_marked", F.explode(unit).alias("u"))
    guarded = F.col("_marked") & F.col("u.kept")
    rows = rows.select("_host", "_id", "w", guarded.alias("guarded"), *_key("_host", guarded, "u.kept", "u.t"), F.col("u.t").alias("_raw"))
    shared = rows.groupBy(*KEY).agg(F.sum("w").alias("weight"), F.count("*").alias("c"), F.min("_id").alias("first")).filter("c > 1").select(*KEY, "weight", "first")
    rows = rows.join(few(shared), KEY, "left").join(hosts, "_host").filter("first is null or first = _id")
    least = F.when(F.col("guarded"), F.greatest(F.lit(FEW), F.floor(F.col("n") / 2) + 1)).otherwise(2).cast("double")
    return rows.select("_host", *KEY, "_raw", F.coalesce("weight", "w").alias("weight"), least.alias("least"), "n").filter("least <= n").drop("n")


def repeated_runs(rows: DataFrame) -> DataFrame | None:
    """(_k1, _k2, starts): where runs of DEPTH words begin that the host repeats; None if there are none. `rows`: of `host_units`."""
    anchors = rows.mapInArrow(_anchor_rows, "anchor long, _k1 long, _k2 long, weight double, least double")
    found = few(anchors.groupBy("anchor").agg(F.sum("weight").alias("c"), F.count("*").alias("rows"), F.min("least").alias("least")).filter("c > least - 0.5")
                .select("anchor", (F.col("rows") > suffixes.GROUP).alias("frequent")))
    if found.isEmpty():
        return None
    wanted = few(anchors.join(found.select("anchor"), "anchor").groupBy(*KEY).agg(F.collect_set("anchor").alias("anchors")), "anchors")
    spell = ", ".join(["anchor long", *[f"{x} long" for x in suffixes.letter_names(DEPTH)], "_k1 long, _k2 long, s int, weight double, least double"])
    spelled = cut(rows.join(wanted, KEY).select(*KEY, "_host", "weight", "least", "_raw", "anchors").mapInArrow(_suffix_rows, spell).join(found, "anchor"))
    n = {r.frequent: r["count"] for r in spelled.groupBy("frequent").count().collect()}
    nodes = suffixes.deep_nodes(spelled.filter("not frequent"), DEPTH, n.get(False, 0))
    if True in n:
        nodes = nodes.union(suffixes.deep_nodes_of_frequent(spelled.filter("frequent").drop("frequent"), DEPTH))
    return nodes.groupBy(*KEY).agg(F.collect_set("s").alias("starts"))


def _covered(starts):
    return F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + DEPTH - 1))))


def extract_pages(pages: DataFrame, html_col: str = "html", url_col: str = "url", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all but the html), text string, and n_repeated, n_around, n_around_repeated long."""
    figures = ["n_repeated", "n_around", "n_around_repeated"]
    keep = [c for c in keep or pages.columns if c not in (html_col, "text", *figures)]
    keyed = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.xxhash64(host_of(url_col)).alias("_host"), F.col(html_col).alias("_html"))
    raw = add_columns(keyed, ["_row", "_host"], "_html", _text, "_raw string, _marked boolean, _around array<string>")
    raw = written(raw.withColumn("_id", F.monotonically_increasing_id()))
    size = lambda t: F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))
    n_around = F.aggregate("_around", F.lit(0), lambda n, t: n + size(t)).cast("long")
    runs = repeated_runs(host_units(raw.drop("_row")))
    if runs is None:
        none = F.lit(0).cast("long")
        return raw.select("_row.*", F.col("_raw").alias("text"), none.alias("n_repeated"), n_around.alias("n_around"), none.alias("n_around_repeated"))
    runs = few(runs, "starts")
    around = raw.select("_id", "_host", F.explode("_around").alias("t")).select("_id", *_key("_host", F.lit(False), F.lit(False), "t"))
    lengths = runs.select(*KEY, F.size(_covered("starts")).cast("long").alias("c"))
    around = few(around.join(lengths, KEY).groupBy("_id").agg(F.sum("c").alias("_n")))
    words = F.split("_raw", " ")
    left = F.array_except(F.sequence(F.lit(0), F.size(words) - 1), _covered("starts"))
    kept = F.array_join(F.transform(left, lambda i: F.get(words, i)), " ")
    out = raw.select("*", *_key("_host", "_marked", F.lit(True), "_raw")).join(runs, KEY, "left").join(around, "_id", "left")
    whole = F.col("starts").isNull() | (F.col("_marked") & (2 * F.size(left) < F.size(words)))
    gone = F.when(whole, 0).otherwise(F.size(_covered("starts"))).cast("long")
    return out.select("_row.*", F.when(whole, F.col("_raw")).otherwise(kept).alias("text"), gone.alias("n_repeated"), n_around.alias("n_around"), F.coalesce("_n", F.lit(0)).alias("n_around_repeated"))
