"""Filter interaction audit: what each order of five filters removes, and what each filter owes to its place.

A document fails filter A (under `min_words` words), B (few distinct words), C (many capitals), D (holds a symbol) or
E (its text equals that of a smaller id anywhere in the table, removed or not). A document that passes A to D still has one bit
for each; E is an existential self-join: a left-semi join on hash, exact text and a smaller id. Its ids join those of the
other failures, one aggregation gives each document its combination of bits, and a second one counts combinations by part:
32 rows of a part at most. Every figure of the report is a sum over those.

An E is decided by a text's smallest id alone, so only the row of that id stands on the right side of the join. Texts met once take no part.
A text's copies may be a third of all rows: those of more than `SPLIT` rows, of which there are `rows / SPLIT` at most, are dealt
to several keys, and their one right row is repeated for each.

A null text is an empty one, so all of them are copies of each other; a null part is the empty string. Null ids fail no E and make none
fail. Rows are documents: repeated ids count each time, and a copy under the same id is no E. Labels of one id are joined by `any`; ids without
labels are neither good nor toxic. Words are what spaces and control characters 9-13 separate. Texts of any length are whole. An empty table gives no rows.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybox.llm.common import cut, few

FILTERS = "ABCDE"
#: Rows of one text that a task may hold; also the least share of all rows, as 1 / SHARES, that makes a text hot.
SPLIT, SHARES = 2_000, 1_000
_E = 1 << 4


def failures(text: Column, min_words: int = 100) -> Column:
    """Bits 1, 2, 4, 8 of filters A to D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    rules = lambda w: (F.when(F.size(w) < min_words, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < 80 * F.size(w), 2).otherwise(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    counted = F.get(F.transform(F.array(words), rules), F.lit(0))  # the words are made once
    return counted + F.when(100 * capitals > 10 * F.length(text), 4).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def _salted(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """`_salt`: rows of hot texts by their id, all others 0."""
    return rows.join(F.broadcast(hot), ["_h1", "_h2"], "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_id"), F.col("_parts")), F.lit(0)))


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` (columns as they are) whose text, null as empty, equals that of a smaller id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), text.alias("_text"),
                       F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(7), text).alias("_h2"))
    copied = cut(rows.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1"))
    share = copied.agg(F.greatest(F.lit(SPLIT), F.ceil(F.sum("_n") / SHARES)).alias("s")).first()["s"]
    hot = copied.filter(F.col("_n") > share).select("_h1", "_h2", F.ceil(F.col("_n") / share).alias("_parts"))  # SHARES rows at most
    met = rows.join(few(copied.select("_h1", "_h2", "_first")), ["_h1", "_h2"])
    left = _salted(met.filter("_id > _first"), hot)
    right = met.filter("_id = _first").join(F.broadcast(hot), ["_h1", "_h2"], "left")
    right = right.select(F.col("_h1").alias("r1"), F.col("_h2").alias("r2"), F.col("_id").alias("r_id"), F.col("_text").alias("r_text"),
                         F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("r_salt"))
    on = (F.col("_h1") == F.col("r1")) & (F.col("_h2") == F.col("r2")) & (F.col("_salt") == F.col("r_salt")) & (F.col("_text") == F.col("r_text")) & (F.col("r_id") < F.col("_id"))
    return left.join(right, on, "left_semi").select("_row.*")


def combinations(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the bits of the filters that they fail."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    keys = [F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(7), text).alias("_h2"), part.alias("part")]
    plain = docs.select(*keys, failures(text).alias("_bits"), F.lit(1).alias("_row"))
    copies = later_copies(docs.select(id_col, text_col, part_col), id_col, text_col).select(*keys, F.lit(_E).alias("_bits"), F.lit(0).alias("_row"))
    # rows that are equal in id, text and part fail alike
    each = plain.union(copies).groupBy("_id", "_h1", "_h2", "part").agg(F.bit_or("_bits").alias("mask"), F.sum("_row").alias("_n"))
    marks = labels.groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("_good"), F.max((F.col("toxic") == 1).cast("long")).alias("_toxic"))
    each = each.groupBy("_id", "part", "mask").agg(F.sum("_n").alias("_n")).join(marks, "_id", "left")
    some = lambda c: F.sum(F.col("_n") * F.coalesce(c, F.lit(0)))
    return each.groupBy("part", "mask").agg(F.sum("_n").alias("n"), some("_good").alias("good"), some("_toxic").alias("toxic"))


def audit_orders(combos: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders.

    A step's figures depend on its filter and on the set of those before it: 80 cells of a part, each summed once."""
    cells = [(f, p) for f in range(5) for p in range(32) if not p >> f & 1]
    cell = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(1 << f).alias("bit"), F.lit(p).alias("p")) for f, p in cells])).alias("c")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("p")) != 0
    here = fails & ~gone
    total = lambda v, on: F.sum(F.when(on, F.col(v)).otherwise(0))
    d = combos.select("*", cell).select("part", "mask", "n", "good", "toxic", "c.f", "c.bit", "c.p")
    d = d.groupBy("part", "f", "p").agg(total("n", ~gone & ~fails).alias("kept"), total("n", here).alias("removed"), total("n", fails & gone).alias("redundant"),
                                        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"))
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(4 - k)) for k in range(5)]), F.bit_count("p") + 1)
    shapley = d.groupBy("part", "f").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    # the orders in which filter f follows the set p, by cell
    follow: dict[tuple[int, int], list[str]] = {c: [] for c in cells}
    for order in permutations(range(5)):
        for k, f in enumerate(order):
            follow[f, sum(1 << g for g in order[:k])].append("".join(FILTERS[g] for g in order))
    orders = F.create_map(*[x for (f, p), names in follow.items() for x in (F.lit(32 * f + p), F.array(*map(F.lit, names)))])
    out = d.join(shapley, ["part", "f"]).withColumn("filter_order", F.explode(F.element_at(orders, 32 * F.col("f") + F.col("p"))))
    figures = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return out.select("part", "filter_order", (F.bit_count("p") + 1).alias("step"), *[F.col(c).cast("long").alias(c) for c in figures])


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    return audit_orders(combinations(docs, labels, id_col, text_col, part_col))
