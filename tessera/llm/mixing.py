"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies each of its documents should have on average. The whole part
is given to all; the fraction becomes 0 or 1 by pivotal rounding: two documents with fractional probabilities exchange
mass, in units of words, until one of them is 0 or 1. The direction is drawn so that every probability keeps its
expectation, and the words taken stay exactly what they were. The rounding is a reduction tree: each task rounds the
documents of one bucket of a source and leaves one fractional document, the leftovers of some buckets meet at the next
level, until a source has one. Long documents come first, in TIERS by size: the last one of a tier is rounded by a draw
if the shorter documents still open can make up for either outcome, else to the side that they can, else to the nearer
one; they then share what is left of the target. So what a source misses is a part of a document of the last tier, where
it has some. Draws are hashes of ids, so reruns agree.

A source with a third of all rows fills as many buckets as its size asks for; no task holds more than some
``bucket_rows`` of them.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, pick, ship, stage, text_or_empty

#: Documents of a bucket, leftovers that meet at the next level, and copies of a document at most; least sizes of the tiers.
BUCKET_ROWS, FAN_IN, MOST = 4096, 64, 3
TIERS = (2048, 256, 32, 1)
ROWS = "source string, key long, size long, p double, draw double, taken int"


def sizes(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumn("size", F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long"))


def targets(totals: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights 1, 2, 3, 1, ... by code point, null last.

    All sizes are shared by weight, no target above ``most`` times its source's size, the excess shared again by
    weight until none is above. Sharing again and again ends at the level where the sources with the smallest limits
    per weight are full, so one ordering of the sources gives it.
    """
    everything = Window.partitionBy()
    t = totals.withColumn("weight", ((F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")) - 1) % 3 + 1).cast("double"))
    t = t.withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("all", F.sum("source_size").over(everything).cast("double"))
    first = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    full, used = F.coalesce(F.sum("cap").over(first), F.lit(0.0)), F.coalesce(F.sum("weight").over(first), F.lit(0.0))
    level = (F.col("all") - full) / (F.sum("weight").over(everything) - used)  # if all sources before this one are full
    t = t.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    t = t.withColumn("share", F.max(F.when(F.col("open"), F.col("level"))).over(everything))
    return t.select("source", "source_size", F.least("cap", F.coalesce(F.col("share") * F.col("weight"), F.col("cap"))).alias("target"))


def pivot(size: list[int], p: list[float], draw: list[float]) -> tuple[list[int | None], int | None]:
    """0 or 1 for each document but one at most, whose place comes second and whose entry of ``p`` is its probability now.

    Mass moves in words: size times probability, summed over all, never changes. Of documents without words, the
    draw alone decides.
    """
    out: list[int | None] = [None] * len(p)
    held = None
    for i, q in enumerate(p):
        if q <= 0 or q >= 1 or size[i] == 0:
            out[i] = int(q >= 1 or 0 < q and draw[i] < q)
            continue
        if held is None:
            held = i
            continue
        a, b = held, i
        up = min((1 - p[a]) * size[a], p[b] * size[b])  # words that may move from b to a
        down = min(p[a] * size[a], (1 - p[b]) * size[b])
        # each direction as likely as the other one is large: expectations stay
        move = up if draw[i] * (up + down) < down else -down
        p[a] += move / size[a]
        p[b] -= move / size[b]
        held = None
        for j in (a, b):
            if p[j] < 1e-12:
                out[j] = 0
            elif p[j] > 1 - 1e-12:
                out[j] = 1
            else:
                held = j
    return out, held


def _reduce(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["size", "draw", "key"], ascending=[False, True, True], kind="stable", ignore_index=True)  # the last fraction is left to a short one
    p = group["p"].tolist()
    out, held = pivot(group["size"].tolist(), p, group["draw"].tolist())
    group["taken"] = pd.array(out, "Int32")
    if held is not None:
        group.loc[held, "p"] = p[held]
        group.loc[held, "draw"] = group.loc[held, "draw"] * 7919 % 1  # the next level draws anew
    return group[["source", "key", "size", "p", "draw", "taken"]]


def round_all(rows: DataFrame, bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """For rows (source, key, size, p, draw) with 0 < p < 1, by the reduction tree: (source, key, size, taken), and the same rows of the sources' last documents, with what is left of p."""
    ship(rows.sparkSession)
    counts = rows.groupBy("source").agg(F.count("*").alias("n")).select(F.col("source").alias("s"), F.ceil(F.col("n") / bucket_rows).cast("int").alias("buckets"))
    left = rows.join(counts, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(11)), "buckets").cast("int"))
    done = []
    while True:
        out = stage(left.groupBy("source", "bucket", "buckets").applyInPandas(_keyed, ROWS + ", bucket int, buckets int"), "rounded")
        done.append(out.filter("taken is not null").select("source", "key", "size", "taken"))
        left = out.filter("taken is null")
        if (left.agg(F.max("buckets")).first()[0] or 1) == 1:
            break
        left = left.drop("taken").withColumn("bucket", F.floor(F.col("bucket") / fan_in).cast("int")).withColumn("buckets", F.ceil(F.col("buckets") / fan_in).cast("int"))
    return reduce(DataFrame.unionByName, done), left.select("source", "key", "size", "p", "draw")


def round_tiers(rows: DataFrame, words: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(key, taken) for rows (source, key, size, draw); ``words`` has (source, need): the words to take of each source."""
    rows = rows.withColumn("tier", reduce(lambda rest, t: F.when(F.col("size") >= TIERS[t], t).otherwise(rest), reversed(range(len(TIERS))), F.lit(len(TIERS))))
    per = rows.groupBy("source").agg(*[F.sum(F.when(F.col("tier") >= t, F.col("size")).otherwise(0)).cast("double").alias(f"open{t}") for t in range(len(TIERS) + 1)])
    same = lambda a, b: a.join(b.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    state, whole = stage(same(per, words), "needs"), []
    for t in range(len(TIERS)):
        own = rows.filter(F.col("tier") == t)
        rate = F.greatest(F.least(F.col("need") / F.col(f"open{t}"), F.lit(1.0)), F.lit(0.0))
        rates = state.filter(F.col(f"open{t}") > 0).select("source", rate.alias("p"), F.col(f"open{t + 1}").alias("after"))
        rated = same(own, rates.select("source", "p")).select("source", "key", "size", "p", "draw")
        found, last = round_all(rated, bucket_rows)
        last = same(last.withColumnRenamed("p", "rest"), rates)
        up, down = (1 - F.col("rest")) * F.col("size"), F.col("rest") * F.col("size")
        can_up, can_down = up <= F.col("p") * F.col("after"), down <= (1 - F.col("p")) * F.col("after")
        drawn = F.when(can_up & can_down, F.col("draw") < F.col("rest")).when(can_up | can_down, can_up).otherwise(up < down)
        found = stage(found.unionByName(last.select("source", "key", "size", F.when(drawn, 1).otherwise(0).alias("taken"))), "tier")
        whole.append(found.select("key", "taken"))
        got = found.groupBy("source").agg(F.sum(F.col("taken") * F.col("size")).cast("double").alias("got"))
        state = stage(same(state, got).withColumn("need", F.col("need") - F.coalesce("got", F.lit(0.0))).drop("got"), "needs")
    return reduce(DataFrame.unionByName, whole)


def _keyed(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    return _reduce(group).assign(bucket=key[1], buckets=key[2])


def row_key(id_col: str, source_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{source_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"), F.lit(seed))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7, most: int = MOST, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per input row: id, size, source_size, target, copies, taken (copies times size).

    A null text has size 0 and a null source is a source of its own. Rows that repeat an id are documents of their
    own if their texts differ; equal rows are rounded as one document, and each of them takes what it takes. A source of size 0 has target 0. An empty table gives no rows; other columns
    aren't read.
    """
    rows = pick(docs, id=id_col, source=source_col, text=text_col)
    rows = sizes(rows, "text").select(F.col("id").cast("long"), F.col("source").cast("string"), "size", row_key("id", "source", "text", seed).alias("key"))
    rows = stage(rows, "sizes")
    per_source = stage(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), most), "targets").withColumnRenamed("source", "s")
    rated = rows.join(per_source, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = rated.withColumn("whole", F.floor(rate + 1e-12).cast("int")).withColumn("p", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    draw = F.shiftrightunsigned(F.xxhash64("key", F.lit(seed)), 11) / F.lit(float(1 << 53))
    # rows that repeat, and by chance rows of one hash, are one row, so that nothing is taken twice below
    some = rated.filter("p > 0 and size > 0")
    open_ = some.groupBy("key").agg(F.min(F.struct("source", "size")).alias("x"), F.count("*").alias("n")).select("x.source", "key", (F.col("x.size") * F.col("n")).alias("size"), draw.alias("draw"))
    words = per_source.select(F.col("s").alias("source"), (F.col("target") - F.floor(F.col("target") / F.col("source_size") + 1e-12) * F.col("source_size")).alias("need")).filter("need is not null")
    rounded = round_tiers(stage(open_, "open"), words, bucket_rows)
    found = rated.join(rounded, "key", "left")
    copies = F.col("whole") + F.coalesce(F.col("taken"), F.lit(0))
    return found.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), F.col("key").alias("row_key"))


def take(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7, **how) -> DataFrame:
    """The rows of the mix with all their columns: each as often as ``mix`` says, those with no copy not at all."""
    copies = mix(docs, id_col, source_col, text_col, seed, **how).filter("copies > 0").select(F.col("row_key").alias("__row_key"), F.col("copies").alias("__copies"))
    copies = copies.groupBy("__row_key").agg(F.max("__copies").alias("__copies"))
    keyed = docs.withColumn("__key", row_key(id_col, source_col, text_col, seed))
    out = keyed.join(copies, F.col("__key") == F.col("__row_key")).withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
