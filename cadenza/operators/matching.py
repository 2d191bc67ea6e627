"""Nearest known phrases and commands: an indexed similarity join, with banks and texts of any number."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import COMMAND_PUNCTUATION, scaled_distance
from ..workspace import materialize

#: Numbers of edits for which the bank is indexed, one after the other, for the texts that are still open.
EDITS = (2, 5)
#: Phrases from which on the index is worth its passes; fewer meet every text in one block.
FEW = 64
#: Phrases and texts of a length that one key of the last join holds.
BANK_BLOCK, TEXT_BLOCK = 2048, 16384


def phrase_bank(texts: DataFrame, ord_col: str, text_col: str) -> DataFrame:
    """Distinct non-empty phrases by first appearance: (ord, phrase)."""
    return texts.filter(F.coalesce(F.col(text_col), F.lit("")) != "").groupBy(F.col(text_col).alias("phrase")).agg(F.min(ord_col).alias("ord")).select("ord", "phrase")


def _parts(s: Column, starts: Column, size: Column) -> Column:
    """Pieces of ``s`` at the given places (from 0): an array of (piece, at)."""
    return F.transform(starts, lambda i: F.struct(F.substring(s, i + 1, size).alias("piece"), i.cast("int").alias("at")))


def _pieces(bank: DataFrame, k: int) -> DataFrame:
    """(ord, phrase, m, piece, at): k + 1 pieces that make up a phrase, one of which k edits leave whole, no farther than k
    from its place.  Phrases of up to k characters have a piece for each character: within k edits a text that shares
    none is at scaled distance 1."""
    m, p = F.col("m"), F.col("phrase")
    begin = lambda i: F.floor(i * m / (k + 1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.struct(F.substring(p, begin(i) + 1, begin(i + 1) - begin(i)).alias("piece"), begin(i).alias("at")))
    letters = _parts(p, F.sequence(F.lit(0), m - 1), F.lit(1))
    return bank.select("ord", "phrase", "m", F.explode(F.when(m > k, cut).otherwise(letters)).alias("x")).select("ord", "phrase", "m", "x.*")


def _substrings(strings: DataFrame, k: int) -> DataFrame:
    """(s, n, lo, hi, piece, at): all that may equal a piece of a phrase within k edits."""
    n, s = F.col("n"), F.col("s")
    least = F.greatest(F.lit(1), F.floor((n - k) / (k + 1)).cast("int"))
    most = F.greatest(least, F.least(n, F.ceil((n + k) / (k + 1)).cast("int")))
    sized = strings.select("s", "n", "lo", "hi", F.explode(F.sequence(least, most)).alias("size"))
    return sized.select("s", "n", "lo", "hi", F.explode(_parts(s, F.sequence(F.lit(0), F.greatest(n - F.col("size"), F.lit(0))), F.col("size"))).alias("x")).select("s", "n", "lo", "hi", "x.*")


def _best(rows: DataFrame) -> DataFrame:
    """(g, score, ord, phrase): the least score of a group, the first phrase among equals."""
    return rows.groupBy("g").agg(F.min(F.struct("score", "ord", "phrase")).alias("b")).select("g", "b.*")


def _nearest(grouped: DataFrame, bank: DataFrame) -> DataFrame:
    """(g, phrase, score): of all strings of a group and all phrases the pair of least scaled distance, the first phrase
    among equals.  ``grouped``: (g, s, lo, hi), strings that aren't empty and the lengths of phrases they are held against.

    For rising numbers of edits k, strings and phrases meet by equal pieces, so that every pair within k edits is seen.  All
    others are at (k + 1) / (n + k + 1) at least, for a string of n characters: a group with a pair below that is settled.
    What is left meets the phrases of each length that may still be nearer than the best pair so far, in blocks, by bounded
    distances.  Every join is by equality; neither side need fit anywhere.
    """
    known = materialize(bank.withColumn("m", F.length("phrase")), "bank")
    # Phrases by length: no more rows than the longest has characters.
    counts = {r.m: r["count"] for r in known.groupBy("m").count().collect()}
    size = sum(counts.values())
    grouped = materialize(grouped.withColumn("n", F.length("s")), "strings")
    still, best = grouped.select("g", F.lit(1.0).alias("most")).distinct(), None
    if size:
        for k in EDITS if size > FEW else ():
            mine = grouped if best is None else grouped.join(still, "g", "left_semi")
            strings = mine.select("s", "n", "lo", "hi").distinct()
            met = _substrings(strings, k).withColumnRenamed("at", "at_s").join(_pieces(known, k), "piece")
            near = (F.abs(F.col("n") - F.col("m")) <= k) & F.col("m").between(F.col("lo"), F.col("hi")) & (F.abs(F.col("at") - F.col("at_s")) <= k)
            pairs = met.filter(near).select("s", "lo", "hi", "ord", "phrase").distinct()
            scored = pairs.withColumn("score", scaled_distance(F.col("s"), F.col("phrase")))
            found = mine.select("g", "s", "lo", "hi").join(scored, ["s", "lo", "hi"]).select("g", "score", "ord", "phrase")
            best = materialize(_best(found if best is None else found.unionByName(best)), "nearest")
            widest = mine.groupBy("g").agg(F.max("n").alias("n")).join(best, "g", "left")
            still = materialize(widest.filter(F.col("score").isNull() | (F.col("score") >= (k + 1) / (F.col("n") + k + 1))).select("g", F.coalesce("score", F.lit(1.0)).alias("most")), "open")
        rest = _in_blocks(grouped, still, known, counts)
        best = materialize(_best(rest if best is None else best.unionByName(rest)), "nearest")
    else:
        best = still.select("g", F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("phrase"))
    return best.select("g", "phrase", "score")


def _in_blocks(grouped: DataFrame, still: DataFrame, bank: DataFrame, counts: dict[int, int]) -> DataFrame:
    """(g, score, ord, phrase): for open groups (g, most) all pairs of score up to ``most``.  ``counts``: phrases by length.

    A score of at most x needs lengths n and m of a ratio of 1 - x at least: a string meets the lengths that this leaves, and
    of each the phrases in blocks.  Strings without a common character with any phrase have distance 1 from all of them."""
    mine = materialize(grouped.join(still, "g").withColumn("most", F.least("most", F.lit(1.0))), "far")
    blocks, spread = math.ceil(max(counts.values()) / BANK_BLOCK), max(1, math.ceil(mine.count() / TEXT_BLOCK))
    share = 1 - F.col("most") - 1e-9
    lo = F.greatest(F.col("lo"), F.ceil(F.col("n") * share).cast("int"))
    hi = F.least(F.col("hi"), F.when(share > 0, F.floor(F.col("n") / share)).otherwise(max(counts)).cast("int"))
    asked = mine.withColumns({"_lo": lo, "_hi": hi})
    fits = F.filter(F.array(*map(F.lit, sorted(counts))), lambda m: m.between(F.col("_lo"), F.col("_hi")))
    asked = asked.select("g", "s", "n", "most", F.explode(fits).alias("m"), F.pmod(F.xxhash64("s"), F.lit(spread)).alias("row")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = bank.select("ord", "phrase", "m", F.pmod(F.xxhash64("phrase"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))).alias("row"))
    within = F.floor(F.col("most") * F.greatest("n", "m") + 1e-9).cast("int")
    apart = F.call_function("levenshtein", F.col("s"), F.col("phrase"), within)
    pairs = asked.join(held, ["m", "block", "row"]).withColumn("apart", apart).filter("apart >= 0")
    return pairs.select("g", (F.col("apart") / F.greatest("n", "m")).alias("score"), "ord", "phrase")


def nearest_phrase(texts: DataFrame, text_col: str, bank: DataFrame) -> DataFrame:
    """(text, phrase, distance) for each distinct text: the phrase of least scaled distance, first in the bank among equals.

    Distances are taken once for each distinct text.  Texts that are phrases are settled by an equi-join, the others by the
    index (``_nearest``).  An empty text, and any text if the bank is empty, has no phrase and distance 1; null texts are
    left out."""
    distinct = texts.select(F.col(text_col).alias("text")).filter("text IS NOT NULL").distinct()
    exact = distinct.join(bank, distinct["text"] == bank["phrase"], "left")
    hit = exact.filter("phrase IS NOT NULL").select("text", "phrase", F.lit(0.0).alias("distance"))
    rest = exact.filter("phrase IS NULL AND text <> ''").select(F.col("text").alias("g"), F.col("text").alias("s"), F.lit(1).alias("lo"), F.lit((1 << 31) - 1).alias("hi"))
    near = _nearest(rest, bank).select(F.col("g").alias("text"), "phrase", F.coalesce("score", F.lit(1.0)).alias("distance"))
    empty = distinct.filter("text = ''").select("text", F.lit(None).cast("string").alias("phrase"), F.lit(1.0).alias("distance"))
    return hit.unionByName(near).unionByName(empty)


def match_commands(texts: DataFrame, text_col: str, commands: DataFrame, threshold: float = 0.35) -> DataFrame:
    """(text, command, score): the command nearest to any window of its length, one less or one more, of the text without
    punctuation; no command above the threshold.  Ties go to the earlier command.

    A text shorter than a window is that window.  Windows are held against the commands by the index; a text is settled as
    soon as no other window can be nearer than its best one."""
    distinct = texts.select(F.col(text_col).alias("text")).filter("text IS NOT NULL").distinct().withColumn("body", F.translate("text", COMMAND_PUNCTUATION, ""))
    n = F.length("body")
    # The lengths of commands: no more numbers than the longest command has characters.
    sizes = sorted({r.m + d for r in commands.select(F.length("phrase").alias("m")).distinct().collect() for d in (-1, 0, 1)} - {0})
    cut = distinct.filter("body <> ''").select("text", "body", F.explode(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>")).alias("w")).filter(F.col("w") < n)
    inner = cut.select("text", F.explode(F.transform(F.sequence(F.lit(1), n - F.col("w") + 1), lambda i: F.substring(F.col("body"), i, F.col("w")))).alias("s"), (F.col("w") - 1).alias("lo"), (F.col("w") + 1).alias("hi"))
    whole = distinct.filter("body <> ''").select("text", F.col("body").alias("s"), (n - 1).alias("lo"), F.lit((1 << 31) - 1).alias("hi"))
    best = _nearest(inner.unionByName(whole).distinct().withColumnRenamed("text", "g"), commands)
    scored = distinct.select("text").join(best.withColumnRenamed("g", "text"), "text", "left")
    hit = (F.col("score") <= threshold) & (F.col("score") < 1.0)
    return scored.select("text", F.when(hit, F.col("phrase")).alias("command"), F.coalesce(F.least("score", F.lit(1.0)), F.lit(1.0)).alias("score"))
