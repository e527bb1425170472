"""Candidate articles against existing events, by the words of their headlines."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import headline_key

#: Ours: no figure is given. Jaccard similarity of two headlines' sets of words from which they may tell of one event.
SIMILAR_FROM = 0.5


def words(headline: Column) -> Column:
    """Sorted distinct words of a headline's key; none for a headline without Latin letters or digits."""
    key = headline_key(headline)
    return F.when(F.coalesce(key, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.split(key, " "))))


#: 64-bit words of the sketch that stands for a set of words in the join.
SKETCH = 4


def match_events(candidates: DataFrame, events: DataFrame, threshold: float = SIMILAR_FROM) -> DataFrame:
    """(url, event_id, similarity): the most similar event of each of candidates(url, headline) among events(event_id, title); ties go to the least id.

    Each different set of words is compared once, however many headlines have it; of the events
    with one set only the least id can win.

    Sets whose similarity reaches the threshold share one of their first |x| - ceil(t |x|) + 1
    words in order of rarity, so only those words are joined on: the rarest ones, which keeps
    frequent words from pairing everything, and no pair is lost. A joined row is dropped inside the
    join, before it is written anywhere, where sizes, places of the shared word or sketches show
    that too few words can be common; words themselves are compared for the rest only."""
    a = candidates.select("url", words(F.col("headline")).alias("w")).filter(F.size("w") > 0).withColumn("set", _set_id())
    b = events.select("event_id", words(F.col("title")).alias("w")).filter(F.size("w") > 0).withColumn("set", _set_id())
    asked = a.groupBy("set").agg(F.any_value("w").alias("w"))
    known = b.groupBy("set").agg(F.any_value("w").alias("w"), F.min("event_id").alias("event_id"))
    counts = asked.select(F.explode("w").alias("word")).unionByName(known.select(F.explode("w").alias("word"))).groupBy("word").agg(F.count("*").alias("n"))

    x, y = _prefixes(asked, counts, threshold, "1"), _prefixes(known, counts, threshold, "2")
    needed = F.ceil((F.col("size1") + F.col("size2")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-6))
    left = F.least(F.col("size1") - F.col("place1"), F.col("size2") - F.col("place2")) + 1
    apart = reduce(add, [F.bit_count(F.col(f"sketch1_{k}").bitwiseXOR(F.col(f"sketch2_{k}"))) for k in range(SKETCH)])
    fits = (left >= needed) & (F.least("size1", "size2") >= needed) & (apart <= F.col("size1") + F.col("size2") - needed * 2)
    pairs = x.join(y, (x["word"] == y["word"]) & fits).select("set1", "set2").distinct()

    sized = pairs.join(asked.select(F.col("set").alias("set1"), F.col("w").alias("w1")), "set1").join(known.select(F.col("set").alias("set2"), F.col("w").alias("w2"), "event_id"), "set2")
    shared = F.size(F.array_intersect("w1", "w2"))
    similarity = shared / (F.size("w1") + F.size("w2") - shared)
    close = sized.select("set1", "event_id", similarity.alias("similarity")).filter(F.col("similarity") >= threshold)
    nearest = F.min(F.struct((-F.col("similarity")).alias("s"), "event_id")).alias("b")
    best = a.select("url", F.col("set").alias("set1")).join(close.groupBy("set1").agg(nearest), "set1").groupBy("url").agg(F.min("b").alias("b"))
    return best.select("url", "b.event_id", (-F.col("b.s")).alias("similarity"))


def _set_id() -> Column:
    """32 bytes that stand for a set of words w."""
    return F.unhex(F.sha2(F.array_join("w", " "), 256))


def _prefixes(sets: DataFrame, counts: DataFrame, threshold: float, side: str) -> DataFrame:
    """The words of sets(set, w) to join on, with their place in the order of rarity, the set's size and its sketch, under names that end on side.

    Bit i of a sketch is the parity of how many words fall on it: two sketches differ in at most as many bits as their sets in words."""
    h = F.xxhash64("word")
    bit = lambda k: F.when(h.bitwiseAND(F.lit(64 * SKETCH - 64)) == 64 * k, F.expr("shiftleft(1L, cast(xxhash64(word) & 63 as int))")).otherwise(F.lit(0).cast("bigint"))
    ranked = sets.select("set", F.explode("w").alias("word")).join(counts, "word")
    ordered = ranked.groupBy("set").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("o"), *[F.bit_xor(bit(k)).alias(f"sketch{side}_{k}") for k in range(SKETCH)])
    size = F.size("o")
    keep = size - F.ceil(size * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    sketches = [f"sketch{side}_{k}" for k in range(SKETCH)]
    return ordered.select(F.col("set").alias(f"set{side}"), size.alias(f"size{side}"), *sketches, F.posexplode(F.slice("o.word", F.lit(1), keep)).alias("at", "word")).select(
        f"set{side}", f"size{side}", *sketches, (F.col("at") + 1).alias(f"place{side}"), "word",
    )
