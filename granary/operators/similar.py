"""Lists without near repeats: of items whose sets are alike, the first that stays in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.sources.files import kept


#: Words of 64 bits that stand for a set of tokens.
_WORDS = 4


def _bits(tokens: Column) -> list[Column]:
    """Words with a bit for each token; two sets differ in as many tokens as their words do in bits, or more."""
    slots = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(64 * _WORDS)).cast("int"))

    def word(first: int) -> Column:
        here = F.filter(slots, lambda s: s.between(first, first + 63))
        return F.aggregate(here, F.lit(0).cast("long"), lambda bits, s: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), s - first)))

    return [word(64 * w) for w in range(_WORDS)]


def met_pairs(sized: DataFrame, group: str, threshold: float) -> DataFrame:
    """group, a, b, n, m: pairs of items (group, place, tokens; none of them empty) that may be alike, and their sizes.

    Two such sets share a token among their rarest, size - ceil(threshold * size) + 1 each, so only those are met by equality. As they meet, pairs
    go whose sizes can't do, whose tokens from the shared one on are too few, or whose bits differ in more places than the tokens may.
    """
    rare = sized.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    ranked = sized.select(group, "place", F.size("tokens").alias("n"), F.explode("tokens").alias("t")).join(rare, "t").groupBy(group, "place", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("by_df"))
    prefix = F.slice("by_df", F.lit(1), (F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).cast("int"))
    words = [f"w{i}" for i in range(_WORDS)]
    marked = ranked.withColumns(dict(zip(words, _bits(F.col("by_df.t")), strict=True)))
    heads = marked.select(group, "place", "n", *words, F.posexplode(F.transform(prefix, lambda x: x["t"])).alias("i", "t"))
    other = heads.select(group, F.col("place").alias("b"), F.col("n").alias("m"), *(F.col(w).alias(f"o{w}") for w in words), F.col("i").alias("j"), "t")
    both = F.col("n") + F.col("m")
    differ = reduce(Column.__add__, [F.bit_count(F.col(w).bitwiseXOR(F.col(f"o{w}"))) for w in words])
    # at the rarest token that they share, the tokens from there on bound what they share; a millionth for rounding
    share = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= both * (threshold / (1 + threshold)) - 1e-6
    fits = (F.least("n", "m") >= threshold * F.greatest("n", "m")) & (F.col("a") < F.col("b")) & share & (differ <= both * ((1 - threshold) / (1 + threshold)) + 1e-6)
    return heads.withColumnRenamed("place", "a").join(other, [group, "t"]).where(fits).select(group, "a", "b", "n", "m").distinct()


def like_pairs(items: DataFrame, group: str, threshold: float) -> DataFrame:
    """group, a, b (places, a before b) and similarity of the items (group, place, tokens) whose sets have a Jaccard similarity over the threshold.

    What met_pairs() leaves, few but the like ones, is compared in full. Items without tokens are like nothing.
    """
    sized = items.where(F.size("tokens") > 0)
    met = met_pairs(sized, group, threshold)
    left, right = (sized.select(group, F.col("place").alias(p), F.col("tokens").alias(f"t{p}")) for p in ("a", "b"))
    shared = F.size(F.array_intersect("ta", "tb"))
    compared = met.join(left, [group, "a"]).join(right, [group, "b"]).withColumn("similarity", shared / (F.col("n") + F.col("m") - shared))
    return compared.where(F.col("similarity") > threshold).select(group, "a", "b", "similarity")


def first_unlike(items: DataFrame, group: str, threshold: float) -> DataFrame:
    """group and place of the items (group, place, name, tokens) that stay: in the order of places each goes that is like one that stayed. Items of
    one name, or of one set of tokens, are alike.

    Equal items become one first, so a name that is a third of a list costs a row. Then, in rounds: what has no undecided and no staying item
    before it stays, and what is like a staying one goes. The rounds are as many as items depend on each other in a row. Places are the
    list's own and occur once in it.
    """
    key = F.when(F.size("tokens") > 0, F.to_json("tokens")).otherwise(F.concat(F.lit("name:"), "name"))
    first = kept(items.withColumn("_key", key).groupBy(group, "_key").agg(F.min_by(F.struct("place", "tokens"), "place").alias("x")).select(group, "x.*"))
    pairs = kept(like_pairs(first, group, threshold).drop("similarity"))
    left, gone = pairs, []
    while not left.isEmpty():
        later = left.select(group, F.col("b").alias("a"))
        stay = kept(left.select(group, "a").distinct().join(later, [group, "a"], "left_anti"))  # nothing undecided before them
        gone.append(kept(left.join(stay, [group, "a"], "left_semi").select(group, F.col("b").alias("place")).distinct()))
        left = left.join(stay, [group, "a"], "left_anti")
        for end in ("a", "b"):
            left = left.join(gone[-1].withColumnRenamed("place", end), [group, end], "left_anti")
        left = kept(left)
    return reduce(lambda rows, part: rows.join(part, [group, "place"], "left_anti"), gone, first.select(group, "place"))
