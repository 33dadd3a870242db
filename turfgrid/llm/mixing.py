"""Mixing sources to target weights by Pareto order sampling, DataFrame operations only.

A source whose target is e times its words takes floor(e) whole copies of every document. The rest is a
sample: with the inclusion probability p = e - floor(e) and a random number u per document, documents
rank by (u / (1-u)) / (p / (1-p)), random odds over inclusion odds, and are taken in that order until
the words still wanted are reached (Rosén's Pareto sampling; the size fixed is that of the words). A
preference multiplies the expected copies of single documents, which makes p differ inside a source.

Only the last key taken is looked for in each source: words are summed by buckets of the order, and rows
are sorted in the one bucket where the target is crossed. Documents then decide by comparing their key
with their source's, so texts are never shuffled and a large source is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfgrid.functions.hashing import keyed_uniform
from turfgrid.llm.storage import drop, written
from turfgrid.session import broadcast_if_small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
SEED = 61
BUCKET_ROWS = 2_000


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """Add `target` to a table (source, source_size): `share` of all words by weight, at most `most` times a source.

    Weights repeat over the sources in code point order, null last. What a full source cannot take goes to
    the others by weight; filling sources in the order of limit over weight gives the level of all others.
    """
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    limit = F.lit(float(most)) * F.col("source_size")
    filled = sources.withColumn("__weight", weight).withColumn("__limit", limit).withColumn("__level", F.col("__limit") / F.col("__weight"))
    everything = Window.partitionBy(F.lit(0))
    upward = everything.orderBy("__level", F.col("source").asc_nulls_last())
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("__limit").over(before), F.lit(0.0))
    others = F.sum("__weight").over(upward.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # the first source, in this order, that does not reach its limit sets the level for itself and all after it
    filled = filled.withColumn("__open", F.when(left / others < F.col("__level"), left / others))
    level = F.first("__open", ignorenulls=True).over(upward.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return filled.withColumn("target", F.coalesce(level * F.col("__weight"), F.col("__limit"))).drop("__weight", "__limit", "__level", "__open")


def _keys(rows: DataFrame, seed: int, most: int) -> DataFrame:
    """`__copies` whole copies and the place of each row in the Pareto order of its source (`__order` in 0..1)."""
    wanted = F.least(F.lit(float(most)), F.col("__rate") * F.col("preference"))
    rows = rows.withColumn("__copies", F.floor(wanted)).withColumn("__chance", wanted - F.floor(wanted))
    u = keyed_uniform(seed, F.col("doc_id"))
    odds = F.col("__chance") / (1 - F.col("__chance"))
    usual = F.col("__rate") - F.floor(F.col("__rate"))
    # times the odds of a document without preference: the order is the same, and the key is u itself for such documents
    # where such a document has no fraction, odds over odds alone
    key = (u / (1 - u)) / odds * F.when(usual > 0, usual / (1 - usual)).otherwise(1.0)
    rows = rows.withColumn("__order", F.when(F.col("__chance") > 0, key / (1 + key)))
    parts = F.greatest(F.lit(1), F.ceil(F.col("__documents") / BUCKET_ROWS))
    rows = rows if "__tie" in rows.columns else rows.withColumn("__tie", F.lit(-(1 << 63)))
    return rows.withColumn("__bucket", F.floor(F.col("__order") * parts)).withColumn("__id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))))


def _tie() -> Column:
    """Tells rows apart that are equal in doc_id or have none."""
    return F.xxhash64("text").alias("__tie")


def plan(docs: DataFrame, preference: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """One row per source: its words, target, rate and the last key that its sample takes."""
    liking = F.lit(1.0) if preference is None else preference
    sized = docs.select("doc_id", "source", word_count().alias("size"), liking.cast("double").alias("preference"), _tie())
    sized = written(sized, "sized")
    liked = F.sum(F.col("size") * F.col("preference"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), liked.alias("__liked"), F.count("*").alias("__documents"))
    rate = F.when(F.col("__liked") > 0, F.least(F.col("target") / F.col("__liked"), F.lit(float(most)))).otherwise(F.lit(0.0))
    sources = written(targets(sources, weights, share, most).withColumn("__rate", rate), "targets")
    rows = _keys(with_plan(sized, sources), seed, most)
    whole = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("__copies")).alias("__whole"), F.sum(F.col("size") * F.col("__chance")).alias("__parts"))
    buckets = rows.where(F.col("__bucket").isNotNull()).groupBy("source", "__bucket").agg(F.sum("size").alias("__words"))
    named = sources.withColumnRenamed("source", "__name").select("__name", "target", "__rate")
    # at the highest rate the target is out of reach: only the fractions of the documents are wanted
    left = F.when(F.col("__rate") >= most, F.col("__parts")).otherwise(F.col("target") - F.col("__whole"))
    whole = whole.join(named, F.col("source").eqNullSafe(F.col("__name"))).select("source", left.alias("__left"))
    whole = whole.withColumnRenamed("source", "__name")
    order = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("__before", F.coalesce(F.sum("__words").over(order), F.lit(0)))
    buckets = buckets.join(whole, F.col("source").eqNullSafe(F.col("__name"))).drop("__name").where(F.col("__before") <= F.col("__left"))
    last = buckets.groupBy("source").agg(F.max_by(F.struct("__bucket", "__before", "__left"), "__bucket").alias("__last"))
    last = written(last.select(F.col("source").alias("__name"), "__last.*"), "last")
    crossed = last.withColumnRenamed("__bucket", "__cut")
    inside = rows.join(crossed, F.col("source").eqNullSafe(F.col("__name")) & (F.col("__bucket") == F.col("__cut")))
    order = Window.partitionBy("__name").orderBy("__order", "__id", "__tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("__sum", F.col("__before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    taken = inside.where(F.col("__sum") + F.col("size") / 2 <= F.col("__left"))
    keys = taken.groupBy("__name").agg(F.max(F.struct("__order", "__id", "__tie")).alias("__key"))
    cuts = last.select("__name", F.col("__bucket").alias("__cut")).join(keys.withColumnRenamed("__name", "__of"), F.col("__name").eqNullSafe(F.col("__of")), "left").drop("__of")
    result = written(sources.join(cuts, F.col("source").eqNullSafe(F.col("__name")), "left").drop("__name", "__liked"), "mix")
    for table in (sized, sources, last):
        drop(table)
    return result


def with_plan(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with the columns of their source's plan; the plan is broadcast once its row count is checked."""
    named = broadcast_if_small(sources).withColumnRenamed("source", "__name")
    return rows.join(named, F.col("source").eqNullSafe(F.col("__name"))).drop("__name")


def copies(rows: DataFrame, sources: DataFrame, seed: int = SEED, most: int = MOST_COPIES) -> DataFrame:
    """Add `copies`, how often the mix takes each row, by comparing its key with its source's last one.

    `rows` has doc_id, source and preference. Rows equal in doc_id follow each other by `__tie`, a hash of
    their text; rows equal in both, or without that column, are taken alike.
    """
    keyed = _keys(with_plan(rows, sources), seed, most)
    sampled = (F.col("__bucket") < F.col("__cut")) | ((F.col("__bucket") == F.col("__cut")) & (F.struct("__order", "__id", "__tie") <= F.col("__key")))
    taken = F.col("__copies") + F.when(sampled, 1).otherwise(0)
    return keyed.withColumn("copies", taken.cast("bigint")).drop("__copies", "__chance", "__order", "__bucket", "__id", "__rate", "__documents", "__cut", "__key", "__tie")


def mix(docs: DataFrame, preference: Column | None = None, seed: int = SEED) -> DataFrame:
    """The mixed corpus: the columns of `docs`, each row as often as the mix takes it.

    Sizes are words of the text (null: 0). Null is a source of its own. A source without words takes
    nothing, and an empty table gives no rows. Other columns, whatever their names, are carried along.
    """
    names = docs.columns
    liking = F.lit(1.0) if preference is None else preference
    packed = docs.select("doc_id", "source", liking.cast("double").alias("preference"), _tie(), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    counted = copies(packed, plan(docs, preference, seed=seed), seed).where(F.col("copies") > 0)
    repeated = counted.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy"))
    return repeated.select("__row.*")


def amounts(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document."""
    rows = docs.select("doc_id", "source", word_count().alias("size"), F.lit(1.0).alias("preference"), _tie())
    counted = copies(rows, plan(docs, seed=seed), seed)
    return counted.select(F.col("doc_id").cast("bigint").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
