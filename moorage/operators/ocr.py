"""Agreement of several recognitions of one image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
UNKNOWN = "«불명»"
PUNCTUATION = r"[.,·:;'\"“”‘’()\[\]{}\-—_/\\|]"
NO_TEXT, USABLE, AGREED = "[[NO_TEXT]]", 20, 0.82
TILE, OVERLAP, LEAST_TILE = 2_200, 160, 80


def compared(text: Column) -> Column:
    """What recognitions are compared by."""
    bare = F.regexp_replace(F.regexp_replace(text, UNKNOWN, ""), r"[\t\n\x0b\f\r \x{a0}\x{200b}\x{2028}\x{2029}\x{3000}\x{feff}]+", "")
    return F.lower(F.regexp_replace(bare, PUNCTUATION, ""))


def dice(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Key, dice over the multisets of character bigrams: 0 if one is empty, 1 if they are equal."""
    texts = pairs.select(key, compared(F.col(a)).alias("x"), compared(F.col(b)).alias("y"))
    pattern = F.lit("(?s)(?=(..))")

    def counted(col: str, name: str) -> DataFrame:
        return texts.select(key, F.explode(F.regexp_extract_all(F.col(col), pattern, F.lit(1))).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias(name))

    both = counted("x", "n").join(counted("y", "m"), [key, "gram"]).groupBy(key).agg(F.sum(F.least("n", "m")).alias("common"))
    total = F.length("x") - 1 + F.length("y") - 1
    value = F.when((F.length("x") == 0) | (F.length("y") == 0), 0.0).when(F.col("x") == F.col("y"), 1.0).when(total > 0, 2 * F.coalesce("common", F.lit(0)) / total).otherwise(0.0)
    return texts.join(both, key, "left").select(key, value.alias("dice"))


def unknown_ratio(text: Column) -> Column:
    """The share of unreadable marks in a quarter of the characters."""
    marks = F.regexp_count(text, F.lit(UNKNOWN))
    return F.least(F.lit(1.0), marks / F.greatest(F.lit(1.0), F.length(F.regexp_replace(text, r"\s+", "")) / 4))


def consensus(results: DataFrame, key: str = "image") -> DataFrame:
    """Key, engine, text, agreement, confidence, reread_wanted.

    ``results``: key, engine, is_primary, text, reported, height. The primary's
    text counts; without one the longest of the usable others.
    """
    clean = results.withColumn("text", F.coalesce("text", F.lit("")))
    main = clean.where("is_primary").select(key, F.col("engine").alias("e0"), F.col("text").alias("t0"), F.col("reported").alias("r0"), "height")
    usable = clean.where(~F.col("is_primary") & (F.length("text") > USABLE) & (F.col("text") != NO_TEXT))
    longest = usable.groupBy(key).agg(F.min_by(F.struct("engine", "text", "reported"), F.struct(-F.length("text"), "engine")).alias("alt"), F.count("*").alias("n_usable"), F.max("reported").alias("told"))
    joined = main.join(longest, key, "left")
    lost = (F.col("t0") == "") | (F.col("t0") == NO_TEXT)
    use_alt = lost & F.col("alt").isNotNull()
    best = joined.select(key, "height", "n_usable", "told", F.when(use_alt, F.col("alt.engine")).otherwise(F.col("e0")).alias("engine"), F.when(use_alt, F.col("alt.text")).otherwise(F.col("t0")).alias("best"), F.when(use_alt, F.col("alt.reported")).otherwise(F.col("r0")).alias("own"))
    pairs = usable.select(key, "engine", F.col("text").alias("other")).join(best.select(key, "best"), key).withColumn("pair", F.concat_ws("\u0001", F.col(key).cast("string"), "engine"))
    agreed = dice(pairs, "pair", "best", "other").join(pairs.select("pair", key), "pair").groupBy(key).agg(F.max("dice").alias("agreement"))
    told = best.join(agreed, key, "left")
    text = F.when(F.col("best") == NO_TEXT, "").otherwise(F.col("best"))
    base = F.when(F.col("n_usable") > 0, 0.55 + 0.4 * F.coalesce("agreement", F.lit(0.0))).otherwise(0.62)
    reported = F.greatest("own", "told")
    mean = F.when(reported.isNotNull(), (base + reported) / 2).otherwise(base)
    confidence = F.when(text == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean - unknown_ratio(text) * 0.5)))
    wanted = (F.col("height") > TILE) | ((F.coalesce("n_usable", F.lit(0)) > 0) & (F.coalesce("agreement", F.lit(0.0)) < AGREED))
    return told.select(key, "engine", text.alias("text"), F.coalesce("agreement", F.lit(0.0)).alias("agreement"), confidence.alias("confidence"), wanted.alias("reread_wanted"))


def tiles(images: DataFrame, key: str = "image") -> DataFrame:
    """Key, tile, top, height of the overlapping tiles of tall images; a last one that is too low is left out."""
    step = TILE - OVERLAP
    tops = images.select(key, "height", F.posexplode(F.sequence(F.lit(0), F.greatest(F.col("height") - 1, F.lit(0)), F.lit(step))).alias("tile", "top"))
    cut = tops.select(key, "tile", "top", F.least(F.lit(TILE), F.col("height") - F.col("top")).alias("height"))
    return cut.where((F.col("height") >= LEAST_TILE) | (F.col("tile") == 0))
