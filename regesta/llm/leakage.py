"""Passages of evaluation items inside training texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from regesta.llm.words import words
from regesta.session import materialise

#: Words of a window, and of a shingle within it.
WINDOW, SHINGLE = 12, 3
#: Changed words are isolated if no WINDOW successive words of the item have more than EDITS of them; each breaks at most SHINGLE of a window's shingles, so that this many are left.
EDITS = 1
KEPT = WINDOW - SHINGLE + 1 - SHINGLE * EDITS


def _word_lists(values: pd.Series) -> pd.Series:
    return values.map(lambda t: [] if t is None else words(t))


word_list = F.pandas_udf(_word_lists, ArrayType(StringType()))


def shingled(w: Column, size: int = SHINGLE) -> Column:
    """at and s (a hash) of every shingle of a list of words."""
    last = F.size(w) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(i.alias("at"), F.xxhash64(*(F.get(w, i + k) for k in range(size))).alias("s"))))


def aligned_span(doc: list[str], item: list[str], hits: list[tuple[int, int]], whole: int) -> bool:
    """Does doc hold, around one of the hits, WINDOW successive words of item, or all of it, but for isolated words?

    Exact runs of two words and more on neighbouring diagonals are chained where at most one word lies between them on either
    side. A chain counts with the words of item from its first to its last; a word changed, dropped or added
    costs nothing else, but two of them side by side end the chain. A chain of just WINDOW words may have one such word:
    with more of them, what chance puts together from stock phrases looks the same.
    """
    n, m = len(doc), len(item)
    need = min(WINDOW, whole)
    runs: dict[tuple[int, int], int] = {}
    todo = list(hits)
    seen: set[tuple[int, int]] = set()
    while todo:
        d, i = todo.pop()
        if (d, i) in seen:
            continue
        a, b = d, i
        while a > 0 and b > 0 and doc[a - 1] == item[b - 1]:
            a, b = a - 1, b - 1
        if (a, b) in runs:
            continue
        k = 0
        while a + k < n and b + k < m and doc[a + k] == item[b + k]:
            seen.add((a + k, b + k))
            k += 1
        if k == 0:
            continue
        runs[a, b] = k
        for x, y in ((1, 1), (0, 1), (1, 0)):  # after the run: a word changed, dropped, added
            c, e = a + k + x, b + k + y
            if c < n and e < m and doc[c] == item[e]:
                todo.append((c, e))
            c, e = a - 1 - x, b - 1 - y
            if c >= 0 and e >= 0 and doc[c] == item[e]:
                todo.append((c, e))
    best: dict[tuple[int, int], tuple[int, int]] = {}  # end of a run (exclusive) -> (first word of item in its chain, matched words)
    for (a, b), k in sorted(runs.items()):
        first, matched = b, k
        for x, y in ((1, 1), (0, 1), (1, 0)):
            before = best.get((a - x, b - y))
            if before and before[1] >= 1 and (before[0], -before[1] - k) < (first, -matched):
                first, matched = before[0], before[1] + k
        known = best.get((a + k, b + k))
        if known is None or (first, -matched) < (known[0], -known[1]):
            best[a + k, b + k] = (first, matched)
        if b + k - first >= need and matched >= need - 1:
            return True
    return False


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Which texts give away which items: doc_id, item_id, partie (each once).

    docs: doc_id, text. items: item_id, partie, texte. A text holds a part if it has all its words, or WINDOW successive ones, up to
    isolated words changed, dropped or added (no more than EDITS in any such window: with two in twelve, what stock phrases put together by chance looks the same); case, accents, punctuation, spacing and escapes do not count.

    A prefix-filtered set join. The set of a window of WINDOW words is its WINDOW - SHINGLE + 1 shingles, of which KEPT at least are left in a text that holds
    it. So any such text has one of the rarest: all but KEPT - 1 of them.

    1. The places of the items' shingles in the texts are found in one pass over the corpus and written, as (shingle, text, place).
    2. Shingles are ordered by their number of places in the whole corpus; those in the prefix of some window are the index.
    3. Places and index are joined. Positional bound: a hit places the item in the text, and hits of one window lie within WINDOW diagonals of each other.
    4. What passes is verified on the words, over windows of the item's size.

    Which side of a join is broadcast is left to the planner, by the measured sizes of the tables written. Null texts and items of no words give nothing; items of
    fewer than SHINGLE words are looked for as they are. Repeated rows come out once. Empty tables: no rows.
    """
    tokens = materialise(docs.where("text is not null and doc_id is not null").select("doc_id", word_list("text").alias("w")), "doc-words")
    parts = materialise(items.where("texte is not null and item_id is not null").select("item_id", "partie", word_list("texte").alias("v")).where("size(v) > 0").dropDuplicates(), "item-words")
    part_shingles = parts.select("item_id", "partie", F.size("v").alias("size"), F.explode(shingled(F.col("v"))).alias("x")).select("item_id", "partie", "size", "x.at", "x.s")
    wanted = materialise(part_shingles.select("s").distinct(), "wanted-shingles")
    places = tokens.select("doc_id", F.explode(shingled(F.col("w"))).alias("x")).select("doc_id", F.col("x.at").alias("d"), F.col("x.s").alias("s"))
    places = materialise(places.join(wanted, "s", "left_semi").select("s", "doc_id", "d"), "places")
    rarity = places.groupBy("s").agg(F.count("*").alias("n"))

    per = WINDOW - SHINGLE + 1
    ranked = part_shingles.join(rarity, "s", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    # the windows that a shingle is in, as the window's first word; an item shorter than a window is one window
    last_window = F.greatest(F.col("size") - WINDOW, F.lit(0))
    windows = ranked.withColumn("win", F.explode(F.sequence(F.greatest(F.col("at") - per + 1, F.lit(0)), F.least("at", last_window))))
    prefix = windows.groupBy("item_id", "partie", "win").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "s", "at"))), 1, per - KEPT + 1).alias("p"))
    index = materialise(prefix.select("item_id", "partie", F.explode("p").alias("p")).select("item_id", "partie", F.col("p.s").alias("s"), F.col("p.at").alias("i")).distinct(), "prefix-index")

    # a shingle that a text or an item repeats meets in many ways, but what is kept of a pair is bounded by the diagonals of text and item
    hits = places.join(index, "s").groupBy("doc_id", "item_id", "partie", (F.col("d") - F.col("i")).alias("diagonal")).agg(F.min(F.struct("d", "i")).alias("h"), F.count("*").alias("n"))
    pairs = materialise(hits.groupBy("doc_id", "item_id", "partie").agg(F.collect_list("h").alias("h")), "pairs")

    joined = pairs.join(tokens, "doc_id").join(parts, ["item_id", "partie"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [aligned_span(list(w), list(v), [(h["d"], h["i"]) for h in hs], len(v)) for w, v, hs in zip(b["w"], b["v"], b["h"], strict=True)]
            yield b.loc[ok, ["doc_id", "item_id", "partie"]]

    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = joined.select("doc_id", "item_id", "partie", "w", "v", "h").mapInPandas(verify, f"doc_id {id_type}, item_id string, partie string")
    for size in range(1, SHINGLE):
        short = parts.where(F.size("v") == size).select("item_id", "partie", F.xxhash64(*(F.get("v", k) for k in range(size))).alias("s"))
        if not short.isEmpty():
            found = found.unionByName(tokens.select("doc_id", F.explode(shingled(F.col("w"), size)).alias("x")).select("doc_id", F.col("x.s").alias("s")).join(short, "s").select("doc_id", "item_id", "partie"))
    return found.distinct()
