"""Secret scans: pattern spans, and tokens that look random and not like ordinary text.

Tokens of TOKEN characters or more, and the pieces of that length between their ``/`` and ``+``, get an encoding inferred
from their characters (hex, base32, letters and digits, base64). Three tests ask whether the characters could be
independent and uniform over that alphabet: chi-squared of the counts, runs above and below the alphabet's middle, and
serial correlation of neighbours; Fisher's method combines them, and a token that they reject at ALPHA is not random.

What is not rejected may still be ordinary: the tests are weak on short tokens. So each token also gets a p-value under
the hypothesis that it is ordinary: the inverse of its likelihood ratio, uniform over its alphabet against a model of
ordinary text, which is at least as small as chance has it with no more than that probability (Markov's inequality).
The model's letters follow the pairs counted in all long words of the corpus, case folded; its classes (lower, upper,
digit, mark) stay with STAY and else change to any other. Within each class of lengths the Benjamini-Hochberg procedure
picks the tokens that are not ordinary, so the expected share of ordinary ones among those reported is FDR at most.

Only DataFrame functions run. Found strings are exploded to rows with the lengths of what lies between them, so places
are running sums within a text; texts without any never leave their task. The procedure works on counts of p-values on a
fixed grid, so its ranking handles BINS rows for each length class whatever the number of tokens; the model is a table of
27 by 26 letters.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stage, text_or_empty

#: Kinds in order; pattern, the group whose length counts and the length it needs.
KINDS = {
    "assign": ("((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]{32,}", 0, 32),  # the same spans as runs of any length of which those below 32 are dropped
}
TOKEN = 20
RANDOM = "random"
#: Padding ends a token, so a name and its value aren't one; the pieces of a path are tokens too.
CANDIDATE, PIECE = f"[A-Za-z0-9+/_-]{{{TOKEN},}}={{0,2}}", f"[A-Za-z0-9_-]{{{TOKEN},}}"
#: Of the tokens reported, the expected share that is ordinary; steps of -log10 p and their number; the level of the battery.
FDR, STEP, BINS, ALPHA = 0.05, 0.05, 2000, 0.001
#: Letters of a word that counts for the model; the chance that a class of characters stays, and added counts of a pair.
LONG_WORD, STAY, SMOOTH = 8, 0.7, 0.5
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def found(rows: DataFrame, kinds: dict[str, tuple[str, int, int]]) -> DataFrame:
    """(id, key, kind, start, end, value) of each kind's leftmost non-overlapping matches whose group is long enough.

    The pieces of a text between matches, and the matches, give every start as a sum of lengths, in code points.
    """
    listed = []
    for kind, (pattern, group, _) in kinds.items():
        p = F.lit(pattern)
        hits = F.arrays_zip(F.regexp_extract_all("text", p, F.lit(0)).alias("hit"), F.regexp_extract_all("text", p, F.lit(group)).alias("value"), F.split("text", pattern, -1).alias("between"))
        each = F.transform(hits, lambda m, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), m["value"].alias("value"), F.length(m["hit"]).alias("n"), F.length(m["between"]).alias("gap")))  # noqa: B023
        listed.append(F.when(F.regexp_like("text", p), each).otherwise(F.array().cast("array<struct<kind:string,k:int,value:string,n:int,gap:int>>")))
    m = rows.select("id", "key", F.explode_outer(F.concat(*listed)).alias("m")).filter("m.n is not null")
    m = m.select("id", "key", "m.*").distinct()  # rows that repeat count once
    order = Window.partitionBy("id", "key", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = m.withColumn("end", F.sum((F.col("n") + F.col("gap")).cast("long")).over(order))
    enough = reduce(lambda rest, kind: F.when(F.col("kind") == kind, F.length("value") >= kinds[kind][2]).otherwise(rest), kinds, F.lit(False))
    return m.filter(enough).select("id", "key", "kind", (F.col("end") - F.col("n")).alias("start"), "end", "value")


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by the rational approximation of Abramowitz and Stegun, 7.1.26."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, tail).otherwise(1 - tail)


#: (encoding, characters a token may have, its alphabet in order), the narrowest first.
ENCODINGS = (
    ("hex", "0-9a-f", DIGITS + "abcdef"),
    ("HEX", "0-9A-F", DIGITS + "ABCDEF"),
    ("base32", "A-Z2-7", UPPER + "234567"),
    ("base36", "a-z0-9", DIGITS + LOWER),
    ("base62", "A-Za-z0-9", UPPER + LOWER + DIGITS),
    ("base64", "A-Za-z0-9+/", UPPER + LOWER + DIGITS + "+/"),
)


def _of_encoding(make) -> Column:
    return reduce(lambda rest, e: F.when(F.col("encoding") == e[0], make(e)).otherwise(rest), reversed(ENCODINGS), F.lit(None))


def battery(tokens: DataFrame) -> DataFrame:
    """``tokens`` (with value) and encoding, n, p_uniform, p_runs, p_serial and p; padding and URL-safe marks are mapped first.

    Small p: not random. Runs: of codes in the lower and upper half of the alphabet. Serial: products of neighbouring
    codes around the alphabet's mean. Chi-squared by Wilson and Hilferty's cube root.
    """
    t = tokens.withColumn("body", F.rtrim(F.translate("value", "-_", "+/"), F.lit("=")))
    t = t.withColumn("encoding", F.coalesce(*[F.when(F.regexp_like("body", F.lit(f"^[{chars}]+$")), F.lit(name)) for name, chars, _ in ENCODINGS]))
    t = t.filter("encoding is not null and length(body) > 7")
    t = t.withColumn("letters", _of_encoding(lambda e: F.lit(e[2]))).withColumn("m", F.length("letters").cast("double")).withColumn("n", F.length("body").cast("double"))
    half = _of_encoding(lambda e: F.lit("0" * (len(e[2]) // 2) + "1" * (len(e[2]) - len(e[2]) // 2)))
    t = t.withColumn("squares", F.expr("aggregate(sequence(1, length(letters)), 0D, (a, k) -> a + power(n - length(replace(body, substring(letters, k, 1), '')), 2))")).withColumn("bits", F.call_function("translate", F.col("body"), F.col("letters"), half))
    t = t.withColumn("codes", F.expr("transform(filter(split(body, ''), c -> c <> ''), c -> locate(c, letters) - 1 - (m - 1) / 2)"))
    t = t.withColumn("products", F.expr("aggregate(zip_with(codes, slice(codes, 2, size(codes)), (x, y) -> coalesce(x * y, 0D)), 0D, (a, x) -> a + x)"))
    n, m = F.col("n"), F.col("m")
    df = m - 1
    chi = m / n * F.col("squares") - n
    p_uniform = upper_tail((F.cbrt(F.greatest(chi, F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    ones = F.expr("length(replace(bits, '0', ''))").cast("double")
    zeros = n - ones
    runs = 1 + F.expr("(2 * length(bits) - length(replace(bits, '01', '')) - length(replace(bits, '10', ''))) / 2")
    pairs = 2 * ones * zeros
    spread = F.sqrt(pairs * (pairs - n) / (n * n * (n - 1)))
    p_runs = F.when(spread > 0, 2 * upper_tail(F.abs((runs - pairs / n - 1) / spread))).otherwise(F.pow(F.lit(0.5), n - 1))
    p_serial = 2 * upper_tail(F.abs(F.col("products") / ((m * m - 1) / 12 * F.sqrt(n - 1))))
    least = lambda p: F.least(F.greatest(p, F.lit(1e-99)), F.lit(1.0))
    t = t.withColumn("p_uniform", least(p_uniform)).withColumn("p_runs", least(p_runs)).withColumn("p_serial", least(p_serial))
    x = -F.log(F.col("p_uniform")) - F.log(F.col("p_runs")) - F.log(F.col("p_serial"))  # half of Fisher's statistic
    return t.withColumn("p", least(F.exp(-x) * (1 + x + x * x / 2))).drop("letters", "squares", "bits", "codes", "products")


def letter_pairs(rows: DataFrame) -> list[float]:
    """Natural logs of the shares of each letter after a given one, and, as the last 26, at a word's start, in all long words."""
    words = rows.select(F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z]{{{LONG_WORD},}}"), F.lit(0))).alias("w")).groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("c"))
    pairs = words.select("c", F.explode(F.expr("transform(sequence(0, length(w) - 1), i -> substring(w, if(i = 0, 1, i), if(i = 0, 1, 2)))")).alias("pair"))
    counts = [SMOOTH] * (27 * 26)
    for r in pairs.groupBy("pair").agg(F.sum("c").alias("c")).collect():  # 27 * 26 rows at most
        *before, last = (LOWER.index(x) for x in r["pair"])
        counts[(before[0] if before else 26) * 26 + last] += r["c"]
    totals = [sum(counts[k * 26 : k * 26 + 26]) for k in range(27)]
    return [round(math.log(c / totals[k // 26]), 4) for k, c in enumerate(counts)]


def ordinary(tested: DataFrame, pairs: list[float]) -> DataFrame:
    """``tested`` (with body, m and n) and p_ordinary: small if the token is unlike ordinary text."""
    table = F.split(F.lit(",".join(map(str, pairs))), ",").cast("array<double>")
    classes = F.translate("body", LOWER + UPPER + DIGITS + "+/", "l" * 26 + "u" * 26 + "d" * 10 + "mm")
    t = tested.withColumn("classes", classes).withColumn("places", F.expr(f"transform(filter(split(lower(body), ''), c -> c <> ''), c -> locate(c, '{LOWER}') - 1)"))
    stays = F.expr("aggregate(sequence(1, length(classes) - 1), 0, (a, i) -> a + if(substring(classes, i, 1) = substring(classes, i + 1, 1), 1, 0))")
    # a digit is one of ten, a mark one of two; a letter follows the one before, or begins where that isn't one
    before = F.expr("concat(array(-1), slice(places, 1, size(places) - 1))")
    letters = F.aggregate(F.zip_with("places", before, lambda x, y: F.when(x >= 0, F.get(table, F.when(y >= 0, y).otherwise(26) * 26 + x)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    count = lambda c: F.expr(f"length(classes) - length(replace(classes, '{c}', ''))")
    of_null = stays * math.log(STAY) + (F.col("n") - 1 - stays) * math.log((1 - STAY) / 3) - math.log(4) + letters - count("d") * math.log(10) - count("m") * math.log(2)
    ratio = -F.col("n") * F.log("m") - math.log(len(ENCODINGS)) - of_null
    return t.withColumn("p_ordinary", F.exp(-F.least(F.greatest(ratio, F.lit(0.0)), F.lit(230.0)))).drop("classes", "places")


def rejected(tested: DataFrame, fdr: float = FDR) -> DataFrame:
    """(length_class, least): tokens of the class with a bin of -log10 p_ordinary from ``least`` on are not ordinary."""
    counts = tested.groupBy("length_class", "bin").agg(F.count("*").alias("c"))
    by_class = Window.partitionBy("length_class")
    ranked = counts.withColumn("rank", F.sum("c").over(by_class.orderBy(F.col("bin").desc()))).withColumn("all", F.sum("c").over(by_class))
    return ranked.filter(F.pow(F.lit(10.0), -F.col("bin") * STEP) <= F.col("rank") / F.col("all") * fdr).groupBy("length_class").agg(F.min("bin").alias("least"))


def random_tokens(spans: DataFrame, pairs: list[float], fdr: float = FDR, alpha: float = ALPHA) -> DataFrame:
    """Of candidate spans, those that are not ordinary, that the battery leaves, and that hold both letters and digits; of nested ones the widest."""
    tested = battery(spans.dropDuplicates(["id", "key", "start", "end"]))
    tested = ordinary(tested.select("id", "key", "start", "end", "value", "body", "m", "n", "p"), pairs)
    tested = tested.withColumn("length_class", F.floor(F.log2("n")).cast("int")).withColumn("bin", F.least(F.floor(-F.log10("p_ordinary") / STEP), F.lit(BINS - 1)).cast("int"))
    tested = stage(tested.select("id", "key", "start", "end", "value", "length_class", "bin", "p"), "tested")  # used four times
    least = F.broadcast(rejected(tested, fdr))  # a row per power of two of the lengths
    kept = tested.join(least, "length_class").filter((F.col("bin") >= F.col("least")) & (F.col("p") >= alpha))
    kept = kept.filter(F.regexp_like("value", F.lit("[0-9]")) & F.regexp_like("value", F.lit("[A-Za-z]"))).select("id", "key", F.lit(RANDOM).alias("kind"), "start", "end", "value")
    wide = kept.select(F.col("id").alias("i"), F.col("key").alias("k"), F.col("start").alias("s"), F.col("end").alias("e"))
    inside = (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("start") >= F.col("s")) & (F.col("end") <= F.col("e")) & (F.col("end") - F.col("start") < F.col("e") - F.col("s"))
    return kept.join(wide, inside, "left_anti")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, spans array<struct<start, kind_no, end, kind>>, in order.

    A null or empty text has no spans. Rows that repeat are scanned as one and get the same spans. An empty table gives
    no rows; other columns aren't read.
    """
    rows = pick(docs, id=id_col, text=text_col).select("id", text_or_empty("text").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("id", "text"))
    spans = stage(found(rows, {**KINDS, RANDOM: (CANDIDATE, 0, TOKEN), "piece": (PIECE, 0, TOKEN)}), "spans")
    of_kind = F.col("kind").isin(*KINDS)
    whole = spans.filter(of_kind).unionByName(stage(random_tokens(spans.filter(~of_kind), letter_pairs(rows), fdr), "random"))
    names = [*KINDS, RANDOM]
    number = reduce(lambda rest, k: F.when(F.col("kind") == k, names.index(k)).otherwise(rest), names, F.lit(None))
    per_row = whole.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("start", number.alias("kind_no"), "end", "kind"))).alias("spans"))
    keys = rows.select("id", "key")
    out = keys.join(per_row.select(F.col("id").alias("i"), F.col("key").alias("k"), "spans"), (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")), "left").drop("i", "k")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>"))
    out = out.select(F.col("id").alias(id_col), spans.alias("spans"))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(id_col, *[of(k) for k in KINDS], "spans")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(docs: DataFrame, **how) -> DataFrame:
    """``scan`` with the spans as text, and the digest of the base spans."""
    out = scan(docs, **how)
    base = F.filter("spans", lambda x: x["kind"] != RANDOM)
    return out.withColumn("base_sha256", F.sha2(listed(base), 256)).withColumn("spans", listed(F.col("spans")))
