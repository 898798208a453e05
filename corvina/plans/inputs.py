"""Graph-shaped inputs that Spark derives from the star schema, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.plans.registry import table


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(ord, subject, predicate, object, doc_id, source_node_id, confidence); ord sorts as the input order."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    customer, supplier, orders = (table(spark, d, n) for n in ("customer", "supplier", "orders"))

    def doc(key):
        return F.concat(F.lit("d"), (key % 50).cast("string"))

    def rows(df, src, key, s, p, o, doc_id, confidence):
        return df.select(
            (F.lit(src).cast("long") * 10_000_000_000 + key).alias("ord"), s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), doc_id.alias("doc_id"),
            F.concat(doc_id, F.lit("_"), (key % 7).cast("string")).alias("source_node_id"), confidence.cast("double").alias("confidence"),
        )

    c = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    s = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    n = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    o = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    k = {x: F.col(x) for x in ("c_custkey", "s_suppkey", "n_nationkey", "o_orderkey")}
    return (
        rows(c, 1, k["c_custkey"], F.col("c_name"), "located_in", F.col("n_name"), doc(k["c_custkey"]), 0.5 + (k["c_custkey"] % 50) / 100)
        .unionByName(rows(s, 2, k["s_suppkey"], F.col("s_name"), "located_in", F.col("n_name"), doc(k["s_suppkey"]), F.lit(0.9)))
        .unionByName(rows(n, 3, k["n_nationkey"], F.col("n_name"), "part_of", F.col("r_name"), F.lit("d0"), F.lit(1.0)))
        .unionByName(rows(o, 4, k["o_orderkey"], F.concat(F.lit("Order#"), k["o_orderkey"].cast("string")), "placed_by", F.col("c_name"), doc(k["o_orderkey"]), F.lit(0.8)))
    )


EDGES = """edges as (
  select 1 * 10000000000 + c_custkey as ord, c_name as subject, 'located_in' as predicate, n_name as object, 'd' || (c_custkey % 50) as doc_id,
         'd' || (c_custkey % 50) || '_' || (c_custkey % 7) as source_node_id, 0.5 + (c_custkey % 50) / 100.0::double as confidence
    from customer join nation on c_nationkey = n_nationkey
  union all
  select 2 * 10000000000 + s_suppkey, s_name, 'located_in', n_name, 'd' || (s_suppkey % 50), 'd' || (s_suppkey % 50) || '_' || (s_suppkey % 7), 0.9
    from supplier join nation on s_nationkey = n_nationkey
  union all
  select 3 * 10000000000 + n_nationkey, n_name, 'part_of', r_name, 'd0', 'd0_' || (n_nationkey % 7), 1.0
    from nation join region on n_regionkey = r_regionkey
  union all
  select 4 * 10000000000 + o_orderkey, 'Order#' || o_orderkey, 'placed_by', c_name, 'd' || (o_orderkey % 50), 'd' || (o_orderkey % 50) || '_' || (o_orderkey % 7), 0.8
    from orders join customer on o_custkey = c_custkey
)"""


def statements(spark: SparkSession, d: str) -> DataFrame:
    """(s, p, o, conf, doc_id, source_node_id): reified rows, several for one triple."""
    line = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return line.select(
        F.col("s_name").alias("s"), F.lit("supplies").alias("p"), F.concat(F.lit("Part#"), F.col("l_partkey").cast("string")).alias("o"),
        F.round(1 - F.col("l_discount"), 2).alias("conf"), F.concat(F.lit("d"), (F.col("l_orderkey") % 50).cast("string")).alias("doc_id"),
        F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("source_node_id"),
    )


STATEMENTS = """statements as (
  select s_name as s, 'supplies' as p, 'Part#' || l_partkey as o, round(1 - l_discount, 2) as conf, 'd' || (l_orderkey % 50) as doc_id,
         l_orderkey || '_' || l_linenumber as source_node_id
  from lineitem join supplier on l_suppkey = s_suppkey
)"""


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """(id, name, tail): part names with an ending that may be a particle or a title."""
    from corvina.functions.text import PARTICLES, TITLES

    tails = F.array(*map(F.lit, [*PARTICLES, *TITLES, ""]))
    part = table(spark, d, "part")
    tail = F.element_at(tails, (F.col("p_partkey") % len([*PARTICLES, *TITLES, ""]) + 1).cast("int"))
    return part.select(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), F.col("p_name"), tail, F.lit("  ")).alias("name"), tail.alias("tail"))


def _mentions_sql() -> str:
    from corvina.functions.text import PARTICLES, TITLES

    tails = [*PARTICLES, *TITLES, ""]
    listed = ", ".join(f"'{x}'" for x in tails)
    return f"mentions as (select p_partkey as id, ' ' || p_name || tail || '  ' as name, tail from (select *, [{listed}][p_partkey % {len(tails)} + 1] as tail from part))"


MENTIONS = _mentions_sql()


def status_events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "signup", "pending").when(kind == "view", "processing").when(kind == "click", "deleting").when(kind == "purchase", "completed").otherwise("error")
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("doc_id"), "ts", status.alias("status"))


STATUS_EVENTS = """status_events as (
  select event_id, user_id as doc_id, ts, case event_type when 'signup' then 'pending' when 'view' then 'processing' when 'click' then 'deleting'
         when 'purchase' then 'completed' else 'error' end as status from events
)"""
