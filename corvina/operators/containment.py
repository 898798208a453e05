"""Which strings occur in which texts, in cells of bounded size.

The patterns of a scope are dealt to blocks and its texts to parts, both by a hash and both bounded in characters. Every block
meets every part in a cell, where an Aho-Corasick automaton over the block reads the part's texts once. However many patterns
share their first characters, a cell's work grows with its texts and with the occurrences found in them.

Blocks times parts grows with the product of both. Numbered names have few shapes, in which every digit is a 0, and a pattern
can occur in a text only where its shape occurs in the text's. Where there are far fewer shapes than strings, shapes meet in
cells instead; a text then offers the pieces at the places so found, and these are joined with the patterns.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.operators.joins import frequent_limit, join_counted
from corvina.session import saved

#: Characters of a block's patterns and of a part's texts.
BLOCK, PART = 2_000_000, 1_000_000
#: Rows in cells from which shapes may meet first.
MANY = 1_000_000


def _automaton(patterns: list[str]) -> ahocorasick.Automaton | None:
    if not patterns:
        return None
    a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for n, p in enumerate(patterns):
        a.add_word(p, n)
    a.make_automaton()
    return a


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each cell; rows come sorted by cell, within it the patterns (which have no id) first."""
    cell, patterns, automaton, ready = None, [], None, False
    for b in batches:
        cells, is_text, strings = b.column("cell"), b.column("is_text").to_numpy(zero_copy_only=False), b.column("x")
        change = pc.not_equal(cells.slice(1), cells.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(change | (is_text[1:] != is_text[:-1])) + 1).tolist(), b.num_rows]
        rows, found = [], []
        for lo, hi in zip(cut, cut[1:], strict=False):
            if hi == lo:
                continue
            if cells[lo].as_py() != cell:
                cell, patterns, automaton, ready = cells[lo].as_py(), [], None, False
            some = strings.slice(lo, hi - lo).to_pylist()
            if not is_text[lo]:
                patterns += some
                continue
            if not ready:
                automaton, ready = _automaton(patterns), True
            if automaton is None:
                continue
            for k, x in enumerate(some, lo):
                hits = {n for _, n in automaton.iter(x)}
                rows += [k] * len(hits)
                found += [patterns[n] for n in hits]
                if len(rows) > 50_000:
                    yield _pairs(b, rows, found)
                    rows, found = [], []
        if rows:
            yield _pairs(b, rows, found)


def _pairs(b: pa.RecordBatch, rows: list[int], found: list[str]) -> pa.RecordBatch:
    at = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays([b.column("scope").take(at), pa.array(found, pa.string()), b.column("id").take(at)], names=["scope", "pattern", "id"])


def _shape(x: str) -> Column:
    return F.translate(x, "123456789", "0" * 9)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where shapes of patterns occur in shapes of texts (pattern, id), overlaps too, a row for each place."""
    for b in batches:
        rows, at = [], []
        for k, (p, t) in enumerate(zip(b.column("pattern").to_pylist(), b.column("id").to_pylist(), strict=True)):
            place = t.find(p)
            while place >= 0:
                rows.append(k)
                at.append(place)
                place = t.find(p, place + 1)
        some = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(some) for c in ("scope", "pattern", "id")), pa.array(at, pa.int32())], names=["scope", "pattern", "id", "place"])


def containing(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(scope, pattern, id): the patterns (scope, pattern) that occur in the texts (scope, id, text) of their scope, once a text.

    Case counts. Null and empty patterns occur nowhere here; null scopes meet nothing.
    """
    p = saved(patterns.select("scope", "pattern").where("scope is not null and pattern <> ''").distinct(), "patterns")
    t = saved(texts.select("scope", "id", "text").where("scope is not null and text <> ''"), "texts")
    asked = p.groupBy("scope").agg(F.count("*").alias("pn"), F.sum(F.length("pattern")).alias("pc"), F.approx_count_distinct(_shape("pattern")).alias("ps"))
    held = t.groupBy("scope").agg(F.count("*").alias("tn"), F.sum(F.length("text")).alias("tc"), F.approx_count_distinct(_shape("text")).alias("ts"))
    sizes = asked.join(held, "scope").withColumn("n", F.col("pn") + F.col("tn"))
    sizes = saved(sizes.withColumn("blocks", F.ceil(F.col("pc") / BLOCK)).withColumn("parts", F.ceil(F.col("tc") / PART)), "sizes")
    blocks, parts = F.ceil(F.col("pc") * F.col("ps") / F.col("pn") / BLOCK), F.ceil(F.col("tc") * F.col("ts") / F.col("tn") / PART)
    by_strings, by_shapes = F.col("pn") * F.col("parts") + F.col("tn") * F.col("blocks"), F.col("ps") * parts + F.col("ts") * blocks + F.col("tn")
    strings, shapes, total = sizes.agg(*(F.coalesce(F.sum(x.cast("double")), F.lit(0.0)) for x in (by_strings, by_shapes)), F.coalesce(F.sum("tn"), F.lit(0))).first()
    if strings > MANY and 2 * shapes < strings:
        return _by_shapes(p, t, total)
    return _in_cells(p, t, sizes.select("scope", "n", "blocks", "parts"))


def _by_shapes(p: DataFrame, t: DataFrame, total: int) -> DataFrame:
    """As ``containing``, of distinct patterns and a number of texts: shapes meet in cells, and then what lies at the places found with the patterns."""
    p, t = p.withColumn("shape", _shape("pattern")), t.withColumn("shape", _shape("text"))
    asked = saved(p.select("scope", F.col("shape").alias("pattern")).distinct(), "shapes")
    held = saved(t.groupBy("scope", "shape").agg(F.count("*").alias("n")), "shapes")
    sizes = asked.groupBy("scope").agg(F.count("*").alias("pn"), F.ceil(F.sum(F.length("pattern")) / BLOCK).alias("blocks"))
    sizes = sizes.join(held.groupBy("scope").agg(F.count("*").alias("tn"), F.ceil(F.sum(F.length("shape")) / PART).alias("parts")), "scope")
    sizes = saved(sizes.select("scope", (F.col("pn") + F.col("tn")).alias("n"), "blocks", "parts"), "sizes")
    met = saved(_in_cells(asked, held.select("scope", F.col("shape").alias("id"), F.col("shape").alias("text")), sizes), "met")
    kinds = f"scope {p.schema['scope'].dataType.simpleString()}, pattern string, id string, place int"
    # a shape without a 0 is the pattern itself
    place = F.struct((F.col("place") + 1).alias("place"), F.length("pattern").alias("n"), (~F.contains("pattern", F.lit("0"))).alias("sure"))
    places = met.mapInArrow(_places, kinds).groupBy("scope", F.col("id").alias("shape")).agg(F.collect_list(place).alias("places"))  # no more than places in a text
    places = saved(places.join(held, ["scope", "shape"]).select(F.struct("scope", "shape").alias("key"), "n", "places"), "places")
    marked = join_counted(t.withColumn("key", F.struct("scope", "shape")), places, "key", "n", frequent_limit(total), "text").where("places is not null")

    def pieces(sure: bool) -> DataFrame:
        some = F.filter("places", lambda x: x["sure"] == sure)
        return marked.select("scope", F.explode(F.array_distinct(F.transform(some, lambda x: F.substr("text", x["place"], x["n"])))).alias("pattern"), "id")

    wanted = p.join(met.select("scope", F.col("pattern").alias("shape")).distinct(), ["scope", "shape"], "left_semi").select("scope", "pattern")
    return pieces(True).unionByName(pieces(False).join(wanted, ["scope", "pattern"]).select("scope", "pattern", "id"))


def _in_cells(p: DataFrame, t: DataFrame, sizes: DataFrame) -> DataFrame:
    """As ``containing``, of distinct patterns; sizes: (scope, n, blocks, parts), n rows of both."""
    spark = p.sparkSession
    total, cells = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("blocks") * F.col("parts")), F.lit(0))).first()
    limit = frequent_limit(total)

    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def row(df, block, part, is_text, x, i):
        df = df.where("blocks is not null").withColumn("b", block).withColumn("k", part)
        return df.select("scope", F.concat_ws(":", F.col("b").cast("string"), F.col("k").cast("string"), F.col("scope").cast("string")).alias("cell"), F.lit(is_text).alias("is_text"), F.col(x).alias("x"), i.alias("id"))

    none = F.lit(None).cast(t.schema["id"].dataType)
    asked = row(join_counted(p, sizes, "scope", "n", limit, "pattern"), F.pmod(F.xxhash64("pattern"), F.col("blocks")), every("parts"), False, "pattern", none)
    held = row(join_counted(t, sizes, "scope", "n", limit, "text"), every("blocks"), F.pmod(F.xxhash64("text", "id"), F.col("parts")), True, "text", F.col("id"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(int(cells), 4_000))
    dealt = asked.unionByName(held).repartition(parts, "cell").sortWithinPartitions("cell", "is_text")
    kinds = f"scope {p.schema['scope'].dataType.simpleString()}, pattern string, id {t.schema['id'].dataType.simpleString()}"
    return dealt.mapInArrow(_find, kinds)
