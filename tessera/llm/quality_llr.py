"""Quality rules: plain text statistics, and a hashed n-gram likelihood ratio of trusted text against the raw corpus.

Single words and pairs of neighbouring words are hashed to BUCKETS bins. The raw corpus's multinomial is counted over
all documents, the trusted one over those of all trusted ids; a document's score is the mean, over its n-grams, of the
smoothed log ratio of their shares, so it doesn't depend on its length. A document is kept if it passes the plain rules
and its score is at least LIMIT.

Only DataFrame functions run. Statistics, n-grams and scores are array expressions within a row: a document stays in
its task whatever its length, and nothing but counts per bin and trusted ids is shuffled, unless these are too many to send (``marked``). The ratios of all bins, a fixed number, are
part of the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, pick, text_or_empty

#: Bins of hashed n-grams.
BUCKETS = 1 << 14
SYMBOLS = "#*$%&|<>"
#: Added to each bin's counts, as a share of the mean count of a bin; a document's mean log ratio at least.
SMOOTH, LIMIT = 0.5, -0.15
MIN_WORDS, MOST_REPEATED = 50, 50
#: Words of 64 trusted ids, or ids that aren't whole numbers, that are broadcast at most: 4 MiB with their numbers where ids are dense (16 million take as many), some 30 MiB where none shares a block.
WORDS_SENT = 1 << 18


def words(text: Column) -> Column:
    inner = F.trim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def following(ws: Column, n: int) -> Column:
    """The words from the n-th on."""
    return F.slice(ws, n, F.greatest(F.size(ws) - (n - 1), F.lit(0)))


def bins(ws: str, buckets: int) -> Column:
    """The bins of a word column's single words and neighbouring pairs; the last word has no pair.

    Neighbours are zipped, not looked up by place: linear even where the optimizer copies the words' expression.
    """
    w = F.col(ws)
    to_bin = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    pair = F.zip_with(w, following(w, 2), lambda x, y: F.when(y.isNotNull(), to_bin(F.xxhash64(x, y))))
    return F.concat(F.transform(w, lambda x: to_bin(F.xxhash64(x))), F.slice(pair, 1, F.greatest(F.size(w) - 1, F.lit(0))))


def statistics(docs: DataFrame) -> DataFrame:
    """(id, words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of (id, text).

    Repeated windows are found by sorting a document's hashed windows with their places; 64 bits tell the windows of one document apart.
    """
    d = docs.select("id", text_or_empty("text").alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\f\r")) != "")
    d = d.select("id", words(F.col("text")).alias("words"), lines.alias("lines"), F.length(F.translate("text", " \t\n\x0b\f\r", "")).alias("word_chars"), (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"))
    w = F.col("words")
    pairs = F.zip_with(w, following(w, 2), lambda x, y: F.xxhash64(x, y))
    grams = F.slice(F.zip_with(pairs, following(w, 3), lambda h, z: F.xxhash64(h, z)), 1, F.greatest(F.size(w) - 2, F.lit(0)))
    d = d.select("id", "words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), grams.alias("grams"))
    zipped = F.arrays_zip("grams", F.sequence(F.lit(1), F.size("grams")))
    d = d.withColumn("placed", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(zipped)))
    gram = lambda x: x["grams"]
    again = F.filter("placed", lambda x, i: gram(x).eqNullSafe(gram(F.get("placed", i - 1))) | gram(x).eqNullSafe(gram(F.get("placed", i + 1))))
    d = d.withColumn("places", F.sort_array(F.transform(again, lambda x: x["1"])))
    covered = F.aggregate(F.transform("places", lambda p, i: F.least(F.coalesce(F.get("places", i + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x)
    long = lambda c: c.cast("long")
    return d.select("id", "words", long(F.size("words")).alias("n_words"), long(F.col("word_chars")).alias("word_chars"), long(F.col("n_symbols")).alias("n_symbols"), long(F.col("n_dup_lines")).alias("n_dup_lines"), long(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"))


def marked(docs: DataFrame, trusted_ids: DataFrame, most: int = WORDS_SENT) -> DataFrame:
    """``docs`` with ``good``, 1 for trusted ids, else null. Texts don't move: trusted whole numbers are sent to them as bits, 64 ids a word.

    Ids of other types are sent as they are. Only where these are more than ``most`` words or ids are documents joined by a shuffle.
    """
    chosen = trusted_ids.select("id").filter("id is not null")
    whole = all(df.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long") for df in (docs, chosen))
    if not whole:
        ids = chosen.distinct().withColumn("good", F.lit(1))
        return docs.join(F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids, "id", "left")
    n, bit = F.col("id").cast("long"), F.expr("shiftleft(1L, cast(id & 63 as int))")
    words_of = chosen.groupBy(F.shiftright(n, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    if words_of.count() > most:
        return docs.join(chosen.distinct().withColumn("good", F.lit(1)), "id", "left")
    # 64 words to a row, so that a row's own size counts little where ids are dense
    blocks = words_of.groupBy(F.shiftright("word", 6).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("sent"))
    found = docs.withColumn("block", F.shiftright(n, 12)).join(F.broadcast(blocks), "block", "left")
    return found.withColumn("good", F.when(F.try_element_at("sent", F.shiftright(n, 6)).bitwiseAND(bit) != 0, 1)).drop("block", "sent")


def log_ratios(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS, smooth: float = SMOOTH) -> list[float]:
    """Per bin, the log of the trusted share over the raw share; 0 everywhere without trusted documents.

    ``docs`` is (id, text), ``trusted_ids`` is (id), of any number.
    """
    d = marked(docs.select("id", "text"), trusted_ids).select("good", words(text_or_empty("text")).alias("words"))
    each = d.select("good", bins("words", buckets).alias("bins")).select("good", F.explode_outer("bins").alias("bin")).filter("bin is not null")
    counts = each.groupBy("bin").agg(F.count("*").alias("raw"), F.count("good").alias("good")).collect()  # a row per bin at most
    raw, good = [0] * buckets, [0] * buckets
    for r in counts:
        raw[r["bin"]], good[r["bin"]] = r["raw"], r["good"]
    all_raw, all_good = sum(raw), sum(good)
    if not all_good:
        return [0.0] * buckets
    add_raw, add_good = smooth * all_raw / buckets, smooth * all_good / buckets
    return [round(math.log((g + add_good) / (all_good + add_good * buckets)) - math.log((r + add_raw) / (all_raw + add_raw * buckets)), 4) for r, g in zip(raw, good)]


def judge(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, limit: float = LIMIT, ratios: list[float] | None = None) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    ``trusted_ids`` has the id column. A null text counts as empty: no words, score 0, base_failed. Rows that repeat are judged alike
    and each counts in the corpus. An empty table gives no rows; other columns aren't read.
    """
    rows = pick(docs, id=id_col, text=text_col)
    if ratios is None:
        ratios = log_ratios(rows, pick(trusted_ids, id=id_col), buckets)
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    d = statistics(rows).withColumn("bins", bins("words", buckets))
    total = F.aggregate("bins", F.lit(0.0), lambda a, b: a + F.get(table, b))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    d = d.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.when(F.size("bins") > 0, total / F.size("bins")).otherwise(0.0).alias("score"))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= limit))
