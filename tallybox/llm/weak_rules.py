"""Quality rules by weak supervision: rules vote or abstain, and what their votes are worth is estimated from the votes alone.

Eight rules look at counts of a text and vote good (1), bad (-1) or abstain (0). A latent class is behind each document: good, or bad in one of two ways,
garbled or repetitive, since what one kind of rule sees says little about faults of the other. Given the class, rules vote independently of each other.
Expectation-maximisation finds the share of each class and each rule's accuracies: how often its votes on documents of a class are good. It begins with rules
that are mostly right about good documents and see half of their own kind of bad ones. An abstention says nothing. The posterior probability of good then takes
the place of a filter that all rules must pass.

Documents of equal votes are alike to the model, so it is fitted on the counts of vote patterns, at most 3 to the power of the rules (6561),
whatever the number of documents: one row holds them, and one `aggregate` runs the rounds. All documents are counted. The patterns' posteriors,
as few, are broadcast.

Beside the posterior stands a base filter: under `MIN_WORDS` words, or more than `MAX_REPEAT` percent of the words in windows of `WINDOW` words
that the text holds twice or more. Windows are compared by hash first; where a hash comes twice, by their words.

Words are what spaces and control characters 9-13 separate. A null text has no words, as an empty one; both fail the base filter. Texts of any length
are whole; their words are one array in one row. Rows are documents: ids may be null or repeat. Equal texts get equal figures. An empty table gives no rows. Columns that `keep`
does not name are not read; columns of `keep` named as a figure are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybox.llm.common import cut

MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
ROUNDS = 30
GAP = r"[\x20\x09-\x0D]+"

#: Name, the kind of fault that it sees, condition for a good vote, condition for a bad one; plain SQL over the figures.
RULES = [
    ("symbols", 1, "100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    ("repeats", 2, "n_repeat_words = 0", "100 * n_repeat_words > 30 * n_words"),
    ("lines", 2, "n_dup_lines = 0 AND n_lines > 1", "2 * n_dup_lines > n_lines"),
    ("word_length", 1, "2 * word_chars >= 7 * n_words AND word_chars <= 7 * n_words", "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    ("capitals", 1, "10 * n_capitals <= word_chars", "10 * n_capitals > 3 * word_chars"),
    ("stutter", 2, "20 * n_stutter <= n_words", "5 * n_stutter > n_words"),
    ("variety", 2, "2 * n_distinct >= n_words", "4 * n_distinct < n_words AND n_words <= 1000"),
    ("endings", 1, "4 * n_plain_ends >= 3 * n_words", "5 * n_plain_ends < 3 * n_words"),
]
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_stutter", "n_distinct", "n_plain_ends"]
#: Where the rounds begin: shares of the classes good, garbled, repetitive; how often a vote is good where the rule has nothing to see, and where it has.
SHARES, RIGHT, SEEN = (0.8, 0.1, 0.1), 0.95, 0.5


def start(kinds: list[int]) -> list[list[float]]:
    """Accuracies by class and rule to begin with."""
    return [[SEEN if c and kind == c else RIGHT for kind in kinds] for c in range(len(SHARES))]


def let(value: Column, body) -> Column:
    """`body` of a value that is made once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(w: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more."""
    def exact(hashes):
        rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), F.slice(w, i + 1, WINDOW).alias("w"), i.alias("at"))))
        same = lambda a, b: (a["h"] == b["h"]) & (a["w"] == b["w"])
        twice = lambda s: F.transform(s, lambda e, i: F.when(same(e, F.get(s, i - 1)) | same(e, F.get(s, i + 1)), e["at"]))
        places = let(rows, lambda s: F.sort_array(F.array_compact(twice(s))))
        covered = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
        return let(places, covered)

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(h)))
    return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(found)


def figures(text: Column) -> Column:
    """A struct of FIGURES."""
    text = F.coalesce(text, F.lit(""))
    count = lambda kept: F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")
    long = lambda c, name: c.cast("long").alias(name)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = let(lines, lambda x: F.struct(long(F.size(x), "n"), long(F.size(x) - F.size(F.array_distinct(x)), "dup")))

    def of_words(w):
        next_too = F.filter(F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: a == b), lambda x: x)
        plain = F.filter(w, lambda x: x.rlike(r"[\p{L}\p{N}]\z"))
        return F.struct(long(F.size(w), "n"), long(F.length(F.array_join(w, "")), "chars"), long(_repeated(w), "repeat"), long(F.size(next_too), "stutter"), long(F.size(F.array_distinct(w)), "distinct"), long(F.size(plain), "plain"))

    words = let(F.array_remove(F.split(text, GAP), ""), of_words)
    return let(F.struct(words.alias("w"), of_lines.alias("l")), lambda x: F.struct(
        x["w"]["n"].alias("n_words"), x["w"]["chars"].alias("word_chars"), count("#*$%&|<>").alias("n_symbols"), x["l"]["dup"].alias("n_dup_lines"), x["w"]["repeat"].alias("n_repeat_words"),
        x["l"]["n"].alias("n_lines"), count("A-Z").alias("n_capitals"), x["w"]["stutter"].alias("n_stutter"), x["w"]["distinct"].alias("n_distinct"), x["w"]["plain"].alias("n_plain_ends")))


def votes() -> Column:
    """The rules' votes on a row with FIGURES."""
    return F.array(*[F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END") for _, _, good, bad in RULES])


def _posterior(x: str, m: str, rules: int) -> str:
    """SQL for the probabilities of the classes of a pattern `x` (v: votes) under a model `m` (pi, a)."""
    each = f"aggregate(sequence(0, {rules - 1}), 0D, (s, j) -> s + CASE {x}.v[j] WHEN 1 THEN ln({m}.a[c][j]) WHEN -1 THEN ln(1 - {m}.a[c][j]) ELSE 0D END)"
    logs = f"transform(sequence(0, {len(SHARES) - 1}), c -> ln({m}.pi[c]) + {each})"
    odds = f"transform(array({logs}), z -> transform(z, l -> exp(l - array_max(z))))[0]"
    return f"transform(array({odds}), e -> transform(e, y -> y / aggregate(e, 0D, (s, t) -> s + t)))[0]"


def estimate(patterns: DataFrame, kinds: list[int], rounds: int = ROUNDS) -> DataFrame:
    """One row: p, the patterns array<struct<v, n>>, and m, the model struct<pi shares of the classes, a accuracies by class and rule>.
    patterns: v array<int> of a vote for each rule of `kinds`, n long.

    Each count starts with one document of either kind, so no accuracy becomes 0 or 1."""
    rules, classes = len(kinds), len(SHARES)
    numbers = lambda xs: "array(" + ", ".join(f"{x}D" for x in xs) + ")"
    first = f"named_struct('pi', {numbers(SHARES)}, 'a', array({', '.join(map(numbers, start(kinds)))}))"
    total = lambda what, least: f"aggregate(q, {least}D, (s, x) -> s + {what})"
    by_class = lambda what: f"transform(sequence(0, {classes - 1}), c -> {what})"
    share = by_class(f"{total('x.w[c]', 1)} / {total('x.n', classes)}")
    right = by_class(f"transform(sequence(0, {rules - 1}), j -> {total('if(x.v[j] = 1, x.w[c], 0D)', 1)} / {total('if(x.v[j] <> 0, x.w[c], 0D)', 2)})")
    weighed = f"transform(p, x -> named_struct('v', x.v, 'n', x.n, 'w', transform({_posterior('x', 'm', rules)}, y -> y * x.n)))"
    step = f"transform(array({weighed}), q -> named_struct('pi', {share}, 'a', {right}))[0]"
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("v", F.col("n").cast("double").alias("n")))).alias("p"))
    return one.withColumn("m", F.expr(f"aggregate(sequence(1, {rounds}), {first}, (m, i) -> {step})"))


def judge(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: doc_id) of each row, FIGURES, votes, base_failed, posterior and kept."""
    names = [c for c in (keep or ["doc_id"]) if c not in {*FIGURES, "votes", "base_failed", "posterior", "kept"}]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), figures(F.col(text_col)).alias("_f"))
    rows = cut(rows.select("_row", "_f.*").withColumn("votes", votes()))
    model = estimate(rows.groupBy(F.col("votes").alias("v")).agg(F.count("*").alias("n")), [kind for _, kind, _, _ in RULES])
    # 3 ** len(RULES) rows at most
    posteriors = model.select("m", F.explode("p").alias("x")).select(F.col("x.v").alias("votes"), F.expr(f"{_posterior('x', 'm', len(RULES))}[0]").alias("posterior"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    out = rows.join(F.broadcast(posteriors), "votes").withColumn("base_failed", base)
    return out.select("_row.*", *FIGURES, "votes", "base_failed", "posterior", (~F.col("base_failed") & (F.col("posterior") >= 0.5)).alias("kept"))
