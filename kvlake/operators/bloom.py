"""Bloom filters as relations: built by one aggregation, probed by one join, whatever their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.operators.stats import bloom_sizing


def positions(key: Column, bits: int, hashes: int) -> Column:
    """The bits of a key: ``(h1 + i h2) mod bits`` with 60 bits of its MD5 for each hash."""
    digest = F.md5(key.cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    first, second = F.pmod(half(1), F.lit(bits)), F.pmod(half(17), F.lit(bits))
    return F.array(*[F.pmod(first + F.lit(i) * second, F.lit(bits)) for i in range(hashes)])


def build(keys: DataFrame, expected: int, rate: float = 0.01) -> DataFrame:
    """Words of the filter of column key: word and bits (64 of them).  Words without a set bit are left out.

    Each task combines its keys to at most all words before the exchange.
    """
    size = bloom_sizing(expected, rate)
    set_ = keys.select(F.explode(positions(F.col("key"), size["bits"], size["hashes"])).alias("at"))
    return set_.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))


def may_contain(probes: DataFrame, words: DataFrame, expected: int, rate: float = 0.01) -> DataFrame:
    """probes (distinct column key) with ``maybe``: false only if the key isn't in the filter."""
    size = bloom_sizing(expected, rate)
    asked = probes.select("key", F.explode(positions(F.col("key"), size["bits"], size["hashes"])).alias("at")).withColumn("word", F.expr("at div 64"))
    hit = F.coalesce(F.expr("shiftright(bits, cast(at % 64 as int)) & 1L") == 1, F.lit(False))
    return asked.join(words, "word", "left").groupBy("key").agg(F.bool_and(hit).alias("maybe"))


def pruned(log: DataFrame, probes: DataFrame, words: DataFrame, expected: int, rate: float = 0.01) -> DataFrame:
    """Probes that occur in ``log``: the filter drops what it can before the join, a false positive goes with the join."""
    maybe = may_contain(probes.select("key").distinct(), words, expected, rate).where("maybe").select("key")
    return maybe.join(log.select("key"), "key", "left_semi")
