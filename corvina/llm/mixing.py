"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Sizes are words. The mix is to hold ``share`` times all words; sources share it by their weights, but none more than
``epochs`` times its own words. Water-filling finds the level at which this comes out: sources above their cap are clamped,
and the others share what is left by weight, until none is above. A round is one aggregation over the table of sources, and
two numbers reach the driver.

A source's target is so many whole repetitions of all its documents and a rest. The rest goes to its documents in the order
of a seeded hash, each whole, until it is used up; the document in which it ends gives the leading words that are missing.
Where that is goes by two levels: words by slots of the hash for each source (partial sums, SLOTS rows a source), then the
rows of the one slot where the rest ends. So a source's taken words are its target, rounded, and no source is ever sorted
or gathered as a whole. A source with a third of all rows meets its numbers by a broadcast of bounded size
(``operators/joins.py``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.operators.joins import frequent_limit, join_counted
from corvina.session import saved

WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the hash that name a slot, so 4,096 slots for each source.
SLOT = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """(id, source, size, h): source as a key that sorts like the sources, null last; h the seeded hash of the row, in hex."""
    told = F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.col(source_col), F.col(text_col))
    source = F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1"))
    return docs.select(F.col(id_col).alias("id"), source.alias("source"), word_count(F.col(text_col)).alias("size"), F.md5(told).alias("h"))


def numbered(sources: DataFrame, key: str) -> DataFrame:
    """``sources`` with ``place``, from 0 in the order of ``key``: places count within ranges, so no task sees all."""
    ranged = saved(sources.repartitionByRange(key).sortWithinPartitions(key).withColumn("__part", F.spark_partition_id()), "sources")
    parts = ranged.groupBy("__part").agg(F.count("*").alias("n"))  # no more rows than partitions
    before = parts.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(key))
    placed = ranged.withColumn("k", inside).join(F.broadcast(before.select("__part", "start")), "__part")
    return placed.withColumn("place", F.col("start") + F.col("k") - 1).drop("__part", "k", "start")


def water_level(sources: DataFrame, share: float, epochs: float) -> float:
    """The level at which min(level * weight, epochs * source_size) sums up to share * all sizes; infinite if none does.

    The sum is concave and made of straight pieces, and a round is a step of Newton's method on it from below: levels only
    grow, clamped sources stay clamped, and it ends when no further source is.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cap, level, clamped = F.col("source_size") * F.lit(float(epochs)), None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        n, spent, weight = sources.agg(F.count(F.when(above, 1)), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        if not weight:
            return float("inf")
        if n == clamped:
            return level
        clamped, level = n, (total * share - (spent or 0.0)) / weight


def source_targets(rows: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """(source, n, source_size, weight, target) of rows (source, size); weights repeat along the sorted sources."""
    sizes = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = saved(numbered(sizes, "source").withColumn("weight", cycle[(F.col("place") % len(weights)).cast("int")]).drop("place"), "weights")
    level, cap = water_level(sources, share, epochs), F.col("source_size") * F.lit(float(epochs))
    poured = F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.when((F.col("source_size") == 0) | (F.lit(level) == float("inf")) | (poured > cap), cap).otherwise(poured))


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: int = 1, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row (id, source, size, source_size, target, repeats, part, taken, h) for each row of docs.

    ``repeats`` whole copies and the first ``part`` words of one more are taken: taken = repeats * size + part words, no more
    than ``epochs`` (rounded up) times size. Weights are positive. Null text has size 0, null is a source of its own and
    comes last. Rows that are equal in id, source and text have equal hashes: where the rest ends among them they share it
    in proportion to size, rounded down, so the target is then missed by less than a word a row. Sources without words have
    target 0. An empty table gives an empty result. Reruns with the same seed agree, however rows are partitioned. Only the
    three named columns are read.
    """
    rows = saved(measured(docs, id_col, text_col, source_col, seed), "sizes")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    targets = source_targets(rows, weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0).cast("long")
    targets = targets.withColumn("budget", budget).withColumn("repeats", whole).withColumn("rest", F.col("budget") - F.col("repeats") * F.col("source_size"))

    slots = rows.groupBy("source", F.substring("h", 1, SLOT).alias("slot")).agg(F.sum("size").alias("w"))
    running = Window.partitionBy("source").orderBy("slot")  # at most 16 ** SLOT rows a source
    slots = slots.withColumn("until", F.sum("w").over(running))
    ends = slots.join(targets.select("source", "rest"), "source").where("until > rest")
    ends = ends.groupBy("source").agg(F.min(F.struct("slot", (F.col("until") - F.col("w")).alias("used"))).alias("end"))
    per_source = saved(
        targets.join(ends, "source", "left").select("source", "n", "source_size", "target", "repeats", "rest", F.col("end.slot").alias("slot"), F.col("end.used").alias("used")), "targets"
    )
    total = per_source.agg(F.sum("n")).first()[0] or 0
    met = join_counted(rows, per_source, "source", "n", frequent_limit(total), "h")
    mine = F.substring("h", 1, SLOT)
    # without such a slot (no words) nothing is left over
    met = met.withColumn("place", F.when(F.col("slot").isNull() | (mine > F.col("slot")), 1).when(mine < F.col("slot"), -1).otherwise(0))

    last = met.where("place = 0")
    groups = last.groupBy("source", "rest", "used", "h").agg(F.sum("size").alias("w"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("w").over(Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    given = F.least(F.col("w"), F.greatest(F.col("rest") - F.col("used") - before, F.lit(0)))
    groups = groups.withColumn("given", given).select("h", "n", "w", "given")
    last = join_counted(last, groups, "h", "n", frequent_limit(total), "id")
    last = last.withColumn("part", F.when(F.col("w") > 0, F.expr("cast(cast(given as decimal(38,0)) * size div w as long)")).otherwise(F.lit(0).cast("long"))).drop("w", "given")
    others = met.where("place <> 0").withColumn("part", F.when(F.col("place") < 0, F.col("size")).otherwise(F.lit(0).cast("long")))
    name = F.when(F.col("source") != "1", F.expr("substring(source, 2)"))
    done = others.unionByName(last)
    return done.select("id", name.alias("source"), "size", "source_size", "target", "repeats", "part", (F.col("repeats") * F.col("size") + F.col("part")).alias("taken"), "h")


def mixed_documents(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: rows of docs with ``copy`` (from 0), whole texts first, then the part with its leading words.

    Rows that give nothing are absent; a column ``copy`` of docs is replaced.
    """
    plan = mix(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    plan = plan.groupBy("h").agg(F.first("repeats").alias("__repeats"), F.first("part").alias("__part"), F.first("size").alias("__size")).where("__repeats > 0 or __part > 0")
    told = F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.col(source_col), F.col(text_col))
    rows = docs.drop("copy").withColumn("__h", F.md5(told)).join(plan.withColumnRenamed("h", "__h"), "__h").where("__size > 0")
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__repeats") - F.when(F.col("__part") > 0, 0).otherwise(1))))
    words = F.slice(F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.greatest(F.col("__part"), F.lit(1)).cast("int"))
    text = F.when(F.col("copy") < F.col("__repeats"), F.col(text_col)).otherwise(F.array_join(words, ""))
    kept = [c for c in docs.columns if c != "copy"]
    return copies.select(*[text.alias(c) if c == text_col else F.col(c) for c in kept], F.col("copy").cast("long").alias("copy"))
