"""Benchmark decontamination: a prefix-filtered join of item windows with document words.

Every window of `window` consecutive item words (an item of fewer words is one window) must occur whole, so
its overlap threshold is its full length and one *prefix* token is necessary: its rarest word in the corpus.
Document words meet the windows on that token alone; the length bound (the document has at least as many
words) and the positional bound (the window fits at the place that the token dictates) follow, and the exact
check compares the words of that item-sized stretch. Nothing but the matches leaves the scan.

Null or empty texts have no words and no hits. Texts of any length are whole. Rows equal in id and text get the same result. An item
without an id counts under the id `null`, as does one whose id is that text; items that share an id count once. Without items nothing is hit, an empty
table of documents gives no rows. Other columns, whatever their names, are not read; `drop_contaminated` returns them untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybox.llm.common import LOWER, UPPER, cut, folded_words, packed, row_key

#: Windows of one broadcast block; a larger benchmark is joined block by block, each within this bound.
BLOCK_WINDOWS = 200_000


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Distinct windows: wid, wlen, wtext (words joined by a space), words, ids of the items that hold it."""
    words = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"),
                         folded_words(F.translate(text, UPPER, LOWER)).alias("w")).filter(F.size("w") > 0)
    spans = words.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))).alias("s"))
    spans = spans.select("item", F.slice("w", F.col("s"), window).alias("words"))
    return (spans.groupBy("words").agg(F.collect_set("item").alias("items"))
            .select(F.sha2(F.array_join("words", " "), 256).alias("wid"), F.size("words").alias("wlen"),
                    F.array_join("words", " ").alias("wtext"), "words", "items"))


def token_rarity(words: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """How often each token of the benchmark occurs in all documents."""
    tokens = words.select(F.explode("w").alias("x")).select(F.lower("x").alias("token"))
    if small:
        return tokens.join(F.broadcast(vocabulary), "token").groupBy("token").count()
    return tokens.groupBy("token").count().join(vocabulary, "token")


def find_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              item_id: str = "item_id", item_text: str = "text", window: int = 10) -> tuple[DataFrame, DataFrame]:
    """(hits: _k1, _k2, start, wlen, wid; windows). One hit row per occurrence of a window."""
    words = docs.select(*row_key(id_col, text_col), folded_words(text_col).alias("w"))
    windows = cut(item_windows(items, item_id, item_text, window))
    n = windows.count()
    tokens = windows.select("wid", F.posexplode("words").alias("off", "x")).select("wid", "off", F.lower("x").alias("token"))
    rare = token_rarity(words, tokens.select("token").distinct(), n <= BLOCK_WINDOWS)
    # the rarest token of each window is its necessary prefix; one that no document holds rules the window out
    prefix = (tokens.join(rare, "token", "left").groupBy("wid")
              .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token", "off")).alias("p")))
    ready = (windows.join(prefix.filter("p.n > 0"), "wid")
             .select("wid", "wlen", "wtext", F.col("p.token").alias("token"), F.col("p.off").alias("off")))
    blocks = -(-n // BLOCK_WINDOWS) or 1
    ready = cut(ready)
    at = F.col("pos") - F.col("off")
    same = F.translate(F.array_join(F.slice("w", at + 1, F.col("wlen")), " "), UPPER, LOWER) == F.col("wtext")
    found = []
    for b in range(blocks):
        part = ready if blocks == 1 else ready.filter(F.pmod(F.xxhash64("wid"), F.lit(blocks)) == b)
        places = words.select("_k1", "_k2", "w", F.posexplode("w").alias("pos", "x")).withColumn("token", F.lower("x"))
        found.append(places.join(F.broadcast(part), "token")
                     .filter((at >= 0) & (at + F.col("wlen") <= F.size("w"))).filter(same)
                     .select("_k1", "_k2", at.alias("start"), "wlen", "wid"))
    return reduce(DataFrame.union, found), windows


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """One row per document: id, n_words, n_hit (words inside any occurrence), items (sorted ids found)."""
    hits, windows = find_hits(docs, items, id_col, text_col, item_id, item_text, window)
    hits = cut(hits)
    # words covered: each occurrence adds what lies beyond the furthest end before it
    before = Window.partitionBy("_k1", "_k2").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ends = hits.groupBy("_k1", "_k2", "start").agg(F.max(F.col("start") + F.col("wlen")).alias("end"))
    add = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    covered = ends.withColumn("add", add).groupBy("_k1", "_k2").agg(F.sum("add").alias("n_hit"))
    named = (hits.select("_k1", "_k2", "wid").distinct().join(windows.select("wid", "items"), "wid")
             .select("_k1", "_k2", F.explode("items").alias("item"))
             .groupBy("_k1", "_k2").agg(F.sort_array(F.collect_set("item")).alias("items")))
    base = docs.select(F.col(id_col), *row_key(id_col, text_col), F.size(folded_words(text_col)).cast("long").alias("n_words"))
    return (base.join(covered.join(named, ["_k1", "_k2"]), ["_k1", "_k2"], "left")
            .select(F.col(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """The rows of `docs`, all columns, that hold no window of any item."""
    hits, _ = find_hits(docs, items, id_col, text_col, item_id, item_text, window)
    bad = hits.select("_k1", "_k2").distinct()
    return packed(docs, *row_key(id_col, text_col)).join(bad, ["_k1", "_k2"], "left_anti").select("_row.*")
