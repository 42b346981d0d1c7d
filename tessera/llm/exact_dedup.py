"""Exact deduplication by a log-structured merge index of text digests.

A document's SHA-256 goes to a digest log. Memtables, one per run, flush sorted runs of (digest, best id, count)
with Parquet Bloom filters; compaction merges the runs and keeps one identifier per digest. Digests that occur more
than once are hits: a bitmap filter picks the rows that may be hits in a second scan, and only those carry their text
through a shuffle, where each is compared byte for byte with the text of the row that stays. Rows whose digest agrees
but whose text doesn't are grouped again by their texts.

All steps are DataFrame operations. A digest with a third of all rows is pre-aggregated in each task before the
shuffle, and the joins on it are ones whose large partitions Spark splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, pick, stage, text_or_empty

#: Bits of the hit filter: 2 MiB. Beyond some millions of repeated digests it passes more rows, never fewer.
FILTER_BITS = 1 << 24
PROBES = 2


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """Runs of (digest, keep_id, n) under one folder, with flush, compact and probe."""

    def __init__(self, spark: SparkSession, keep: str = "min", path: str | None = None):
        if keep not in ("min", "max"):
            raise ValueError("keep must be min or max")
        self.spark, self.best = spark, F.min if keep == "min" else F.max
        self.path, self.levels = path or fresh_path(spark, "digest-index"), []

    def _write(self, df: DataFrame, name: str) -> str:
        to = f"{self.path}/{name}"
        (df.sortWithinPartitions("digest").write.options(**{"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"})
         .option("compression", "zstd").parquet(to))
        return to

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("digest binary, keep_id long, n long").parquet(*paths)

    def flush(self, log: DataFrame) -> None:
        """A memtable of (id, digest) rows becomes one sorted run."""
        run = log.groupBy("digest").agg(self.best("id").alias("keep_id"), F.count("*").alias("n"))
        self.levels.append(self._write(run, f"run-{len(self.levels)}"))

    def compact(self) -> None:
        """All runs become one, which keeps the best identifier and the count of each digest."""
        if len(self.levels) > 1:
            merged = self._read(self.levels).groupBy("digest").agg(self.best("keep_id").alias("keep_id"), F.sum("n").alias("n"))
            self.levels = [self._write(merged, f"compacted-{len(self.levels)}")]

    def entries(self) -> DataFrame:
        self.compact()
        return self._read(self.levels)

    def lookup(self, digest: bytes) -> list:
        """The entries of one digest; row groups without it are skipped by their filters."""
        return self.entries().filter(F.col("digest") == F.lit(digest)).collect()


def _bits(digest: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(bits)).cast("long") for k in range(PROBES)]


def hit_filter(entries: DataFrame, bits: int) -> DataFrame:
    """One row per 4 KiB page of a bitmap of ``bits`` bits, set where a repeated digest falls; bits / 32768 rows at most."""
    at = entries.filter("n > 1").select(F.explode(F.array(*_bits(F.col("digest"), bits))).alias("bit")).select((F.col("bit") + 1).alias("at"))
    return at.groupBy(F.expr("bitmap_bucket_number(at)").alias("page")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("map"))


def may_hit(rows: DataFrame, pages: DataFrame, bits: int) -> DataFrame:
    """The rows whose digest's bits are all set. The pages are broadcast: FILTER_BITS / 8 bytes at most."""
    for k, at in enumerate(_bits(F.col("digest"), bits)):
        page, pos = f"page{k}", f"pos{k}"
        rows = rows.withColumn(page, F.floor(at / 32768) + 1).withColumn(pos, (at % 32768).cast("int"))
        rows = rows.join(F.broadcast(pages.select(F.col("page").alias(page), F.col("map").alias(f"map{k}"))), page)
        byte = F.conv(F.hex(F.expr(f"substring(map{k}, cast(floor({pos} / 8) as int) + 1, 1)")), 16, 10).cast("int")
        rows = rows.filter(byte.bitwiseAND(F.expr(f"shiftleft(1, {pos} % 8)")) != 0).drop(page, pos, f"map{k}")
    return rows


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", runs: int = 4, digest: Callable[[Column], Column] = sha256, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest (lowercase hex).

    Null texts count as empty. A null id never stays while its group has another id; where it has none, keep_id is
    null and the row is kept. Rows that repeat an id and a text share keep_id and are all marked kept. An empty table gives no
    rows. Columns besides the two named ones are not read. ``digest`` may be any binary function of the text: texts that
    share one by chance are told apart by their bytes.
    """
    spark = docs.sparkSession
    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), text_or_empty("text").alias("text"))
    hashed = rows.select("id", "text", digest(F.col("text")).alias("digest"))
    log = stage(hashed.select("id", "digest", F.pmod(F.xxhash64("id"), F.lit(runs)).cast("int").alias("run")), "digest-log")

    index = DigestIndex(spark, keep)
    for run in range(runs):
        index.flush(log.filter(F.col("run") == run))
    entries = index.entries()
    groups = entries.filter("n > 1")

    pages = stage(hit_filter(entries, filter_bits), "hit-filter")
    hits = stage(may_hit(hashed, pages, filter_bits).join(groups, "digest"), "hits")
    stays = hits.filter("id <=> keep_id").select("digest", F.col("text").alias("kept_text"))
    # a repeated id may stand with several texts; staged, so that the join below has no aggregate on either side and a hot digest's partition can be split
    stays = stage(stays.groupBy("digest").agg(F.min("kept_text").alias("kept_text")), "kept-texts")
    differ = stage(hits.join(stays, "digest").filter("text != kept_text").select("id", "digest", "text"), "collisions")

    found = log.select("id", "digest").join(groups.select("digest", "keep_id", "n"), "digest", "left")
    found = found.select("id", "digest", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"))
    if not differ.isEmpty():
        found = _split_collisions(found, differ, index)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.expr("id <=> keep_id").alias("kept"), F.lower(F.hex("digest")).alias("digest"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows that stay, with all their columns. Rows that repeat an id and a text are one document and stay together."""
    stays = exact_dedup(docs, id_col, text_col, **how).filter("kept").select(F.col(id_col).alias("__id"), F.unhex("digest").alias("__digest")).distinct()
    digest = how.get("digest", sha256)(text_or_empty(f"`{text_col}`"))
    return docs.join(stays, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__id")) & (digest == F.col("__digest")), "left_semi")


def _split_collisions(found: DataFrame, differ: DataFrame, index: DigestIndex) -> DataFrame:
    """Rows that only share a digest form groups by text; their number is taken from the group whose text stays."""
    parts = stage(differ.groupBy("digest", "text").agg(index.best("id").alias("keep2"), F.count("*").alias("n2")), "collision-groups")
    own = differ.join(parts, ["digest", "text"]).select("id", "digest", "keep2", "n2").distinct()
    less = parts.groupBy("digest").agg(F.sum("n2").alias("less"))
    whole = found.join(less, "digest", "left").join(own, (found["id"].eqNullSafe(own["id"])) & (found["digest"] == own["digest"]), "left").select(found["id"], found["digest"], "keep_id", "group_size", "less", "keep2", "n2")
    return whole.select("id", "digest", F.when(F.col("n2").isNull(), F.col("keep_id")).otherwise(F.col("keep2")).alias("keep_id"), F.when(F.col("n2").isNull(), F.col("group_size") - F.coalesce("less", F.lit(0))).otherwise(F.col("n2")).cast("long").alias("group_size"))
