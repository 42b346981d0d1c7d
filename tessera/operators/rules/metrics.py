"""Rules over function metrics: Halstead complexity estimated from size, and duplicated functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def halstead(functions: DataFrame, least_lines: int = 5) -> DataFrame:
    """(fn_id, volume, difficulty, bugs, severity) of functions (fn_id, n_lines, n_params) above the limits.

    Operators are 2.5 per line, operands 3.5; distinct ones grow with the square root. Sizes are floored at one.
    """
    at_least_1 = lambda c: F.greatest(c, F.lit(1.0))
    d = functions.filter(F.col("n_lines") >= least_lines)
    d = d.withColumn("ops", at_least_1(F.floor(2.5 * F.col("n_lines")).cast("double"))).withColumn("base", at_least_1(F.floor(3.5 * F.col("n_lines")).cast("double")))
    d = d.withColumn("n1", at_least_1(F.floor(1.5 * F.sqrt("ops")).cast("double"))).withColumn("n2", at_least_1(F.floor(2.0 * F.sqrt("base")).cast("double") + F.col("n_params"))).withColumn("opnds", F.col("base") + F.col("n_params"))
    volume = (F.col("ops") + F.col("opnds")) * F.log2(F.col("n1") + F.col("n2"))
    difficulty = F.col("n1") / 2 * (F.col("opnds") / F.col("n2"))
    d = d.withColumn("volume", F.round(volume, 6)).withColumn("difficulty", F.round(difficulty, 6)).withColumn("bugs", F.round(F.col("volume") / 3000, 6)).filter("ops >= 5")
    severity = F.when((F.col("volume") > 1500) | (F.col("difficulty") > 40) | (F.col("bugs") > 1), "High").when((F.col("volume") > 1000) | (F.col("difficulty") > 30) | (F.col("bugs") > 0.5), "Medium")
    return d.select("fn_id", "volume", "difficulty", "bugs", severity.alias("severity")).filter("severity is not null")


def duplicates(functions: DataFrame, least: float = 0.85) -> DataFrame:
    """(fn_id, first_id, copies, similarity): functions (fn_id, body) whose normalized body another one has, by its hash.

    A class is told by its first member, not by its pairs; members whose tokens overlap the first one's less than
    ``least`` (a shared hash by chance) are left out.
    """
    d = functions.withColumn("norm", F.regexp_replace(F.lower("body"), r"\s+", " ")).withColumn("h", F.xxhash64("norm"))
    g = d.groupBy("h").agg(F.min("fn_id").alias("first_id"), F.count("*").alias("copies"), F.min_by("norm", "fn_id").alias("first")).filter("copies > 1")
    tokens = lambda c: F.array_distinct(F.split(c, " "))
    sim = F.size(F.array_intersect(tokens("norm"), tokens("first"))) / F.size(F.array_union(tokens("norm"), tokens("first")))
    return d.join(g, "h").withColumn("similarity", F.round(sim, 4)).filter((F.col("fn_id") != F.col("first_id")) & (F.col("similarity") >= least)).select("fn_id", "first_id", "copies", "similarity")
