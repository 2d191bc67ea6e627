"""Readings by a dictionary of phrases: a character is read as its word is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_out(texts: DataFrame, text_col: str, dictionary: DataFrame) -> DataFrame:
    """(text, readings array<string>) of each distinct text, from left to right: the longest phrase of the dictionary (phrase, reading)
    that begins at a place is read and passed; a character that begins none stands for itself.

    Stretches of texts meet phrases by equality, so the dictionary may have any size; what is collected by text is at most one phrase a
    character.  Of a phrase's several readings the first by name holds.  Null texts are left out; an empty one has no
    readings."""
    distinct = texts.select(F.col(text_col).alias("text")).filter("text IS NOT NULL").distinct()
    known = dictionary.filter("length(phrase) > 0").groupBy("phrase").agg(F.min("reading").alias("reading"))
    # The lengths of phrases: no more numbers than the longest phrase has characters.
    sizes = sorted(r.n for r in known.select(F.length("phrase").alias("n")).distinct().collect())
    n = F.length("text")
    places = distinct.filter(n > 0).select("text", F.explode(F.sequence(F.lit(1), n)).alias("at"))
    cuts = places.select("text", "at", F.explode(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>")).alias("size")).filter(F.col("at") + F.col("size") - 1 <= n)
    met = cuts.withColumn("phrase", F.substring(F.col("text"), F.col("at"), F.col("size"))).join(known, "phrase")
    longest = met.groupBy("text", "at").agg(F.max(F.struct("size", "reading")).alias("hit"))
    found = longest.groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("at", "hit"))).alias("hits"))

    def step(state, at):
        hit = F.col("hits")[at]
        here = F.when(hit.isNull(), F.struct((at + 1).alias("next"), F.array_append(state["out"], F.substring(F.col("text"), at, F.lit(1))).alias("out")))
        here = here.otherwise(F.struct((at + hit["size"]).alias("next"), F.array_append(state["out"], hit["reading"]).alias("out")))
        return F.when(at < state["next"], state).otherwise(here)

    begin = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("out"))
    every = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    whole = distinct.join(found, "text", "left").withColumn("hits", F.coalesce("hits", F.expr("CAST(map() AS map<int, struct<size: int, reading: string>>)")))
    return whole.select("text", F.aggregate(every, begin, step, lambda s: s["out"]).alias("readings"))
