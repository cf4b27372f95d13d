"""Mixing sources to target weights: repetition rates from token counts, then floor(rate) copies and one seeded extra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Without given weights, a source's target share is its share of the tokens to this power (flattens large sources).
ALPHA = 0.7
SEED = 20240229
#: Sources up to so many travel as one broadcast table; beyond it the rates are joined like any table.
BROADCAST_SOURCES = 100_000


def tokens(text: Column) -> Column:
    """Runs of characters other than space, tab, newline and carriage return; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0))


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone: the first 32 bits of an MD5 sum."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, budget: int | None = None) -> DataFrame:
    """One row per source: tokens, weight (they sum to 1 over all sources) and rate = budget * weight / tokens.

    ``budget`` is the number of tokens wanted in all, by default as many as there are. A source without tokens, or one
    that ``weights`` doesn't name, has rate 0. The null source is a source like any other (named by None in weights). Null and empty texts have no
    tokens, repeated rows count each, long texts are read whole; other columns than source and text are not read, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    per = docs.groupBy("source").agg(F.sum(tokens(F.col("text"))).alias("tokens"))
    if weights is None:
        per = per.withColumn("raw", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(float(alpha)))).otherwise(0.0))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, raw double")
        per = per.join(given, per["source"].eqNullSafe(given["name"]), "left").select("source", "tokens", F.when(F.col("tokens") > 0, F.coalesce("raw", F.lit(0.0))).otherwise(0.0).alias("raw"))
    total = per.agg(F.sum("raw").alias("all_raw"), F.sum("tokens").alias("all_tokens"))
    want = F.lit(float(budget)) if budget is not None else F.col("all_tokens").cast("double")
    weight = F.when(F.col("all_raw") > 0, F.col("raw") / F.col("all_raw")).otherwise(0.0)
    rate = F.when(F.col("tokens") > 0, want * F.col("weight") / F.col("tokens")).otherwise(0.0)
    return per.crossJoin(total).withColumn("weight", weight).withColumn("rate", rate).select("source", "tokens", "weight", "rate")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """Each document floor(rate) times, and once more if its seeded draw lies below the fraction of the rate.

    Adds ``copy`` (0, 1, ...); an input column of that name is replaced. All other columns are kept. A null or empty text
    counts no tokens but is copied at its source's rate; repeated rows of one doc_id share their draw; where it is null the text decides the draw.
    An empty table gives no rows. Only the token counts are exchanged; texts stay where they are read.
    """
    spark = docs.sparkSession
    found = rates(docs, weights, alpha, budget).select("source", "rate").limit(BROADCAST_SOURCES + 1).collect()
    if len(found) <= BROADCAST_SOURCES:  # counted, so what is broadcast is bounded
        per = F.broadcast(spark.createDataFrame(found, "source string, rate double"))
    else:
        per = rates(docs, weights, alpha, budget).select("source", "rate")
    per = per.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    whole = F.floor("__rate").cast("int")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")))))  # without a number, by its words
    extra = F.coalesce((draw(key, seed) < F.col("__rate") - F.floor("__rate")).cast("int"), F.lit(0))
    copies = F.sequence(F.lit(0), F.col("__n") - 1)
    out = docs.drop("copy").join(per, docs["source"].eqNullSafe(per["__source"])).withColumn("__n", whole + extra).where("__n > 0")
    return out.withColumn("copy", F.explode(copies)).drop("__source", "__rate", "__n")
