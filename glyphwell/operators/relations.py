"""Relational operators of evaluation and verification: labels, reports, joins of intervals, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphwell.functions import kernel, text as X

REPORT = ("in_hash", "path", "kind", "status", "converted", "untouched", "fonts", "out_hash", "out_entries_hash", "detail")
#: Buckets of this many characters keep interval joins of one long part from being all pairs.
BUCKET = 4096


def label_counts(tokens: DataFrame, times: str | None = None) -> DataFrame:
    """Tokens of each label in either split and in all; a row counts once, or ``times`` over."""
    n = F.col(times) if times else F.lit(1).cast("bigint")
    of = lambda split: F.sum(F.when(F.col("split") == split, n).otherwise(0)).alias(split)
    return tokens.groupBy("label").agg(of("tune"), of("test"), F.sum(n).alias("total"))


def last_by_hash(report: DataFrame, order: str) -> DataFrame:
    """The last row of each input hash; rows without one are left out."""
    return report.where("in_hash is not null and in_hash <> ''").withColumn("_rn", F.row_number().over(Window.partitionBy("in_hash").orderBy(F.col(order).desc()))).where("_rn = 1").drop("_rn")


def compare_reports(old: DataFrame, new: DataFrame) -> DataFrame:
    """``in_hash``, ``change``: identical, differing, vanished or new."""
    fields = ("status", "out_hash", "converted", "untouched", "fonts")
    a = old.select("in_hash", F.struct(*fields).alias("a"))
    b = new.select("in_hash", F.struct(*fields).alias("b"))
    change = F.when(F.col("b").isNull(), "vanished").when(F.col("a").isNull(), "new").when(F.col("a").eqNullSafe(F.col("b")), "identical").otherwise("differing")
    return a.join(b, "in_hash", "full_outer").select("in_hash", change.alias("change"))


def not_yet_verified(files: DataFrame, report: DataFrame) -> DataFrame:
    return files.join(report.select("in_hash"), "in_hash", "left_anti")


def first_by_hash(files: DataFrame) -> DataFrame:
    """One path for each content hash, the first in order."""
    return files.groupBy("hash").agg(F.min("path").alias("path"))


def duplicate_destinations(paths: DataFrame) -> DataFrame:
    """Destinations that more than one input would be written to."""
    return paths.groupBy(X.derived_name("path").alias("destination")).agg(F.count("*").alias("inputs")).where("inputs > 1")


def _buckets(df: DataFrame) -> DataFrame:
    return df.withColumn("_bucket", F.explode(F.sequence(F.expr(f"start div {BUCKET}"), F.expr(f"greatest(start, stop - 1) div {BUCKET}"))))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], prefix: str = "r_") -> DataFrame:
    """Pairs of half-open intervals ``start``, ``stop`` of equal keys that overlap; the right one's columns with a prefix.

    An equi-join on keys and bucket, so that Spark hashes or sorts it; the pair is
    kept in the first bucket that both are in, and so comes once.
    """
    r = _buckets(right)
    r = r.select(*keys, "_bucket", *(F.col(c).alias(prefix + c) for c in right.columns if c not in keys))
    joined = _buckets(left).join(r, [*keys, "_bucket"])
    joined = joined.where((F.col("start") < F.col(f"{prefix}stop")) & (F.col("stop") > F.col(f"{prefix}start")))
    first = F.greatest(F.expr(f"start div {BUCKET}"), F.expr(f"{prefix}start div {BUCKET}"))
    return joined.where(F.col("_bucket") == first).drop("_bucket")


def font_of_tokens(tokens: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Each token with a font: any legacy font in its span, else the first named."""
    # Fonts are judged once a run, not once a pair.
    pairs = overlap_join(tokens, runs.where("font is not null").select(*keys, "start", "stop", "font", X.is_legacy_font("font").alias("legacy")), keys, "run_")
    legacy = F.when(F.col("run_legacy"), F.col("run_font"))
    fonts = pairs.groupBy(*keys, "start").agg(F.coalesce(F.min_by(legacy, F.when(legacy.isNotNull(), F.col("run_start"))), F.min_by("run_font", "run_start")).alias("font"))
    return tokens.join(fonts, [*keys, "start"], "left")


def text_of_runs(pieces: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Each run's text after conversion: unchanged pieces cut to the overlap, a changed one whole where it begins.

    ``pieces`` has ``start``, ``stop``, ``text``, ``changed``; ``runs`` has ``start``, ``stop``.
    """
    pairs = overlap_join(runs.select(*keys, "start", "stop"), pieces, keys, "p_")
    low, high = F.greatest("start", "p_start"), F.least("stop", "p_stop")
    part = F.when(~F.col("p_changed"), F.substring("p_text", low - F.col("p_start") + 1, high - low)).when(F.col("p_start") >= F.col("start"), F.col("p_text")).otherwise(F.lit(""))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_start", part.alias("t")))), lambda x: x["t"]), "")
    return runs.join(pairs.groupBy(*keys, "start").agg(joined.alias("out")), [*keys, "start"], "left").withColumn("out", F.coalesce("out", F.lit("")))


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Counts, recall, precision, F1 and false positive rate of two boolean columns."""
    t, g = F.col(truth), F.col(guess)
    n = rows.agg(*(F.count_if(c).alias(k) for k, c in (("tp", t & g), ("fp", ~t & g), ("fn", t & ~g), ("tn", ~t & ~g))))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    c = F.col
    return n.select("*", ratio(c("tp"), c("tp") + c("fn")).alias("recall"), ratio(c("tp"), c("tp") + c("fp")).alias("precision"), ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"), ratio(c("fp"), c("fp") + c("tn")).alias("fpr"))


def round_trip(words: DataFrame) -> DataFrame:
    """``word``, ``legacy``, ``got``, ``exact``, ``canonical``, ``distance`` of the testable words."""
    tested = words.select("word").distinct().where(X.testable("word") & X.well_formed("word"))
    legacy = tested.withColumn("legacy", kernel.column(kernel.to_legacy)("word")).withColumn("got", kernel.column_of_all(kernel.convert_all)("legacy"))
    return legacy.select("*", (F.col("word") == F.col("got")).alias("exact"), (X.canonical("word") == X.canonical("got")).alias("canonical"), F.levenshtein("word", "got").alias("distance"))


def top_patterns(mismatches: DataFrame, k: int = 12) -> DataFrame:
    """The most frequent differences with an example each."""
    pair = F.concat_ws("\u0001", "word", "got")
    pattern = kernel.column(lambda p: kernel.difference(*p.split("\u0001")))(pair)
    return mismatches.withColumn("pattern", pattern).groupBy("pattern").agg(F.count("*").alias("n"), F.min("word").alias("example")).orderBy(F.desc("n"), "pattern").limit(k)


def hash_sample(rows: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """``k`` rows in the order of a hash of the key and the seed: the same on any cluster."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string"))), key).limit(k)


def size_tier(size: Column) -> Column:
    return F.when(size < 1_000_000, "text").when(size < 50_000_000, "mid").otherwise("media")

