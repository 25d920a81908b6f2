"""Queries on integer series: differences, inverses, packing costs, feedback, palettes, runs, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import series
from .registry import query, table

#: Orders as a series of cents in blocks of 8,192 (64 KiB of 8-byte words); the same in DuckDB.
ORDERS = "s AS (SELECT o_orderkey AS pos, (o_orderkey // 8192)::BIGINT AS block, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders)"
LINES = "s AS (SELECT l_suppkey AS key, l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem)"
EVENTS = "s AS (SELECT event_id AS pos, (event_id // 8192)::BIGINT AS block, user_id AS q, event_type, CAST(round(value * 100) AS BIGINT) AS v FROM events)"
WRAP16 = "((({0}) % 65536 + 65536 + 32768) % 65536 - 32768)"
BITS = "(CASE WHEN ({0}) = 0 THEN 0 ELSE length(to_binary(({0})::BIGINT)) END)"
ZZ = "(CASE WHEN ({0}) >= 0 THEN 2 * ({0}) ELSE -2 * ({0}) - 1 END)"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), series.blocked(F.col("o_orderkey"), 8192).alias("block"), F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("v"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), series.blocked(F.col("event_id"), 8192).alias("block"), F.col("user_id").alias("q"), "event_type", F.round(F.col("value") * 100).cast("long").alias("v"))


@query(f"WITH {ORDERS} SELECT pos, v - coalesce(lag(v) OVER (PARTITION BY block ORDER BY pos), 0) AS delta FROM s")
def word_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.delta(orders(spark, sf_dir), ["block"], ["pos"], "v").select("pos", "delta")


@query(f"WITH {ORDERS} SELECT pos, coalesce(v - 2 * lag(v) OVER o + lag(v, 2) OVER o, v - lag(v) OVER o, v) AS delta2 FROM s WINDOW o AS (PARTITION BY block ORDER BY pos)")
def word_delta2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.delta2(orders(spark, sf_dir), ["block"], ["pos"], "v").select("pos", "delta2")


@query(f"WITH {ORDERS}, d AS (SELECT pos, coalesce(v - 2 * lag(v) OVER o + lag(v, 2) OVER o, v - lag(v) OVER o, v) AS d FROM s WINDOW o AS (PARTITION BY block ORDER BY pos)) SELECT pos, {ZZ.format('d')} AS zigzag FROM d")
def word_delta2_zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.zigzagged(series.delta2(orders(spark, sf_dir), ["block"], ["pos"], "v"), "delta2").select("pos", "zigzag")


@query(f"WITH {ORDERS} SELECT pos, v AS value FROM s")
def word_delta_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = series.delta(orders(spark, sf_dir), ["block"], ["pos"], "v").select("block", "pos", "delta")
    return series.undelta(there, ["block"], ["pos"], "delta").select("pos", "value")


@query(f"WITH {ORDERS} SELECT pos, v AS value FROM s")
def word_delta2_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = series.delta2(orders(spark, sf_dir), ["block"], ["pos"], "v").select("block", "pos", "delta2")
    return series.undelta2(there, ["block"], ["pos"], "delta2").select("pos", "value")


@query(f"WITH {ORDERS} SELECT pos, xor(v, coalesce(lag(v) OVER (PARTITION BY block ORDER BY pos), 0)) AS residual FROM s")
def word_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.xor_lag(orders(spark, sf_dir), ["block"], ["pos"], "v").select("pos", "residual")


FOR_SQL = f"SELECT key, count(*) AS n, {BITS.format('max(v) - min(v)')}::INT AS width, ({BITS.format('max(v) - min(v)')} * count(*))::BIGINT AS bits FROM s GROUP BY key"
D1 = "d1 AS (SELECT key, v - lag(v) OVER (PARTITION BY key ORDER BY l_orderkey, l_linenumber) AS d FROM s)"
D2 = "d2 AS (SELECT key, v - 2 * lag(v) OVER o + lag(v, 2) OVER o AS d FROM s WINDOW o AS (PARTITION BY key ORDER BY l_orderkey, l_linenumber))"
DBITS = "SELECT key, count(*) AS n, coalesce(max({w}), 0)::INT AS width, (coalesce(max({w}), 0) * count(d))::BIGINT AS bits FROM {t} GROUP BY key"


def _dbits(t: str) -> str:
    return DBITS.format(w=BITS.format(ZZ.format("d")), t=t)


PFOR = f"""o AS (SELECT key, {BITS.format('v - min(v) OVER (PARTITION BY key)')} AS w FROM s),
r AS (SELECT key, w, row_number() OVER (PARTITION BY key ORDER BY w) - 1 AS i, count(*) OVER (PARTITION BY key) AS n, max(w) OVER (PARTITION BY key) AS most FROM o),
ws AS (SELECT DISTINCT key, n, most, width FROM (SELECT key, n, most, w AS width FROM r WHERE i = least(floor(n * 0.90)::BIGINT, n - 1) OR i = least(floor(n * 0.95)::BIGINT, n - 1) OR i = least(floor(n * 0.99)::BIGINT, n - 1) OR w = most UNION ALL SELECT key, n, most, 0 FROM r)),
p AS (SELECT ws.key, ws.n, ws.width, ws.most, sum((r.w > ws.width)::INT) AS exceptions FROM ws JOIN r USING (key) GROUP BY ALL)"""
PFOR_BITS = "(n * width + exceptions * (32 + most - width))::BIGINT"


@query(f"WITH {LINES} {FOR_SQL}")
def for_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.frame_of_reference(lines(spark, sf_dir), ["key"], "v").select("key", "n", "width", "bits")


@query(f"WITH {LINES}, {D1} {_dbits('d1')}")
def delta_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.delta_bits(lines(spark, sf_dir), ["key"], ["l_orderkey", "l_linenumber"], "v")


@query(f"WITH {LINES}, {D2} {_dbits('d2')}")
def delta2_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.delta_bits(lines(spark, sf_dir), ["key"], ["l_orderkey", "l_linenumber"], "v", order=2)


@query(f"WITH {LINES}, {PFOR} SELECT key, n, width::INT AS width, exceptions::BIGINT AS exceptions, {PFOR_BITS} AS bits FROM p")
def pfor_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.patched_widths(lines(spark, sf_dir), ["key"], "v")


@query(f"""WITH {LINES}, {D1}, {D2}, {PFOR}, c AS (SELECT key, 0 AS place, 'for' AS kind, bits FROM ({FOR_SQL}) UNION ALL SELECT key, 1, 'delta', bits FROM ({_dbits('d1')}) UNION ALL SELECT key, 2, 'delta2', bits FROM ({_dbits('d2')})
UNION ALL SELECT key, 3 + width, 'pfor' || width, {PFOR_BITS} FROM p), best AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY bits, place) AS i FROM c) SELECT key, kind, bits FROM best WHERE i = 1""")
def numeric_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.packing_costs(lines(spark, sf_dir), ["key"], ["l_orderkey", "l_linenumber"], "v")
    return found.select("key", F.array_min("costs").alias("best")).select("key", "best.kind", "best.bits")


@query(f"WITH {LINES}, k AS (SELECT unnest(range(17)) AS k) SELECT key, k::INT AS k, sum((v >> k::INT) + 1 + k)::BIGINT AS bits FROM s CROSS JOIN k GROUP BY key, k")
def rice_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.rice_costs(lines(spark, sf_dir), ["key"], "v")


@query(f"WITH {LINES} SELECT key, sum(greatest(1, ceil({BITS.format('v')} / 7.0)))::BIGINT AS bytes FROM s GROUP BY key")
def varint_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.varint_costs(lines(spark, sf_dir), ["key"], "v")


@query(f"WITH {EVENTS} SELECT pos, {WRAP16.format('v - coalesce(lag(v) OVER (PARTITION BY q ORDER BY pos), 0)')}::BIGINT AS correction FROM s")
def coordinate_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.feedback(events(spark, sf_dir), ["q"], ["pos"], "v").select("pos", "correction")


@query(f"WITH {EVENTS} SELECT pos, {WRAP16.format('v')}::BIGINT AS value FROM s")
def coordinate_feedback_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = series.feedback(events(spark, sf_dir), ["q"], ["pos"], "v").select("q", "pos", "correction")
    return series.unfeedback(there, ["q"], ["pos"], "correction").select("pos", "value")


@query(f"""WITH {EVENTS}, f AS (SELECT event_type, min(v) AS o FROM s GROUP BY event_type)
SELECT pos, m.mode, v - CASE m.mode WHEN 0 THEN 0 WHEN 1 THEN coalesce(lag(v) OVER (PARTITION BY block, m.mode ORDER BY pos), 0) WHEN 2 THEN coalesce(lag(v) OVER (PARTITION BY block, event_type, m.mode ORDER BY pos), f.o) ELSE f.o END AS delta
FROM s JOIN f USING (event_type) CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS mode) m""")
def pointer_delta_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value less: nothing; the last value; the last value of the same key, else its first option; its first option."""
    from pyspark.sql import Window

    from ..operators.relate import small

    rows = events(spark, sf_dir)
    first = small(rows.groupBy("event_type").agg(F.min("v").alias("option")))
    every, own = Window.partitionBy("block").orderBy("pos"), Window.partitionBy("block", "event_type").orderBy("pos")
    bases = [F.lit(0).cast("long"), F.coalesce(F.lag("v").over(every), F.lit(0)), F.coalesce(F.lag("v").over(own), F.col("option")), F.col("option")]
    wide = rows.join(first, "event_type").select("pos", *((F.col("v") - b).alias(f"m{k}") for k, b in enumerate(bases)))
    return wide.select("pos", F.posexplode(F.array("m0", "m1", "m2", "m3")).alias("mode", "delta"))


@query(f"WITH {EVENTS}, d AS (SELECT pos, pos - coalesce(lag(pos) OVER (PARTITION BY block, event_type ORDER BY pos), pos) AS distance FROM s) SELECT pos, distance, {BITS.format('distance')}::INT AS bucket FROM d")
def recurrence_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.recurrence(events(spark, sf_dir), ["block"], "pos", "event_type").select("pos", "distance", "bucket")


@query(f"""WITH {EVENTS}, c AS (SELECT block, pos, v - 5000 AS q FROM s)
SELECT block, sign(q)::INT AS sign, {BITS.format('abs(q)')}::INT AS length, ((q % 16 + 16) % 16)::BIGINT AS low, count(*) AS n, min(pos) AS first, max(pos) AS last FROM c GROUP BY ALL""")
def partition_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("c", F.col("v") - 5000)
    return series.partitions(rows, ["block"], "pos", "c", 2)


@query("""WITH s AS (SELECT event_id AS pos, (event_id // 8192)::BIGINT AS block, event_type AS symbol FROM events),
n AS (SELECT *, CASE WHEN symbol = lag(symbol) OVER o THEN 0 ELSE 1 END AS new FROM s WINDOW o AS (PARTITION BY block ORDER BY pos)),
g AS (SELECT *, sum(new) OVER (PARTITION BY block ORDER BY pos) AS run FROM n) SELECT block, min(pos) AS start, min(symbol) AS symbol, count(*) AS length FROM g GROUP BY block, run""")
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.runs(events(spark, sf_dir), ["block"], "pos", "event_type")


@query("""WITH c AS (SELECT l_suppkey, l_returnflag AS symbol, count(*) AS c FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY c DESC, symbol) AS i, sum(c) OVER (PARTITION BY l_suppkey) AS n FROM c)
SELECT l_suppkey, symbol AS dominant, c AS times, (n - c)::BIGINT AS exceptions FROM r WHERE i = 1""")
def dominant_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.dominant(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag"), ["l_suppkey"], "l_returnflag")


@query("""WITH c AS (SELECT l_suppkey, l_quantity::BIGINT AS v, count(*) AS times FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY times DESC, v) - 1 AS rank FROM c)
SELECT l_suppkey, v, times, rank::INT AS rank FROM r WHERE rank < 8""")
def palette_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("v"))
    return series.palette(rows, ["l_suppkey"], "v", 8)


@query("""WITH c AS (SELECT l_returnflag, l_suppkey AS v, count(*) AS times, min(l_orderkey * 8 + l_linenumber) AS first FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY times DESC, first, v) - 1 AS rank FROM c)
SELECT l_returnflag, v, times, rank::INT AS rank FROM r WHERE rank < 64""")
def vector_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent values, ties by first occurrence."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_suppkey").alias("v"), F.struct((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("a"), F.col("l_suppkey").alias("b")).alias("at"))
    return series.palette(rows, ["l_returnflag"], "v", 64, first="at")


_DICT = "c AS (SELECT l_returnflag, l_quantity::BIGINT AS v, count(*) AS times FROM lineitem GROUP BY ALL), r AS (SELECT *, (row_number() OVER (PARTITION BY l_returnflag ORDER BY v) - 1)::INT AS id FROM c)"


@query(f"WITH {_DICT} SELECT l_returnflag, v, times, id FROM r")
def column_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.dictionary(table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("v")), ["l_returnflag"], "v")


@query(f"WITH {_DICT} SELECT l_orderkey, l_linenumber, r.id FROM lineitem l JOIN r ON r.l_returnflag = l.l_returnflag AND r.v = l.l_quantity::BIGINT")
def column_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("long").alias("v"))
    return series.encoded(rows, ["l_returnflag"], "v").select("l_orderkey", "l_linenumber", "id")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem")
def literal_split_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a column format can hold apart from the literal ones, coded, decoded and put together again."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    hundredths = F.round(F.col("l_discount") * 100).cast("long")
    fits = (hundredths / 100 == F.col("l_discount")) & F.col("l_quantity").isNotNull()
    coded = rows.where(fits).select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), hundredths.alias("d"))
    literal = rows.where(~F.coalesce(fits, F.lit(False)))
    return coded.select("l_orderkey", "l_linenumber", F.col("q").cast("double").alias("l_quantity"), (F.col("d") / 100).alias("l_discount")).unionByName(literal)


_CELLS = "c AS (SELECT vec_id, i - 1 AS dim, CAST(round(v * 1000) AS BIGINT) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a grid: vector, dimension, thousandths. Products keep the components' type, as in SQL: in floats some
    reach the half that doubles stay below, and round the other way."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    thousand = F.lit(1000).cast(rows.schema["x"].dataType)
    return rows.select("vec_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("x") * thousand).cast("long").alias("v"))


@query(f"WITH {_CELLS}, d AS (SELECT vec_id, dim, v - coalesce(lag(v) OVER (PARTITION BY dim, vec_id // 64 ORDER BY vec_id), 0) AS d FROM c) SELECT vec_id, dim, {ZZ.format('d')} AS residual FROM d")
def volume_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).withColumn("slab", F.expr("vec_id div 64"))  # whole numbers, towards zero, as SQL's //
    return series.axis_delta(rows, ["dim", "slab"], "vec_id", "v").select("vec_id", "dim", "residual")


@query(f"""WITH {_CELLS}, w AS (SELECT vec_id, dim, v, lag(v) OVER o AS l, lead(v) OVER o AS r FROM c WINDOW o AS (PARTITION BY vec_id ORDER BY dim)),
d AS (SELECT vec_id, dim, v, v - floor((l + coalesce(r, l)) / 2.0)::BIGINT AS d FROM w)
SELECT vec_id, (dim % 2)::INT AS band, (dim // 2)::BIGINT AS index, (CASE WHEN dim % 2 = 1 THEN {ZZ.format('d')} ELSE v END)::BIGINT AS coefficient FROM d""")
def lifting_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.lifted(cells(spark, sf_dir), ["vec_id"], "dim", "v").select("vec_id", "band", "index", "coefficient")


@query("SELECT o_orderkey, (date_diff('day', DATE '0001-01-01', o_orderdate::DATE) + 1)::INT AS ordinal, o_orderdate::DATE AS back FROM orders")
def date_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.to_date(F.lit("0001-01-01"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "M/d/yyyy").alias("text"))
    day = F.to_date("text", "M/d/yyyy")  # canonical text: it reads back as it was written
    canonical = F.date_format(day, "M/d/yyyy") == F.col("text")
    coded = rows.where(canonical).select("o_orderkey", (F.datediff(day, first) + 1).alias("ordinal"))
    return coded.select("o_orderkey", "ordinal", F.date_add(first, F.col("ordinal") - 1).alias("back"))


@query("SELECT l_orderkey, l_linenumber, round(l_discount / 0.01)::BIGINT AS q, ((round(l_discount / 0.01)::BIGINT % 16 + 16) % 16)::BIGINT AS low FROM lineitem")
def quantised_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.rint(F.col("l_discount") / 0.01).cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q"), F.pmod(q, F.lit(16)).alias("low"))


@query(f"WITH {LINES}, b AS (SELECT key, l_orderkey // 256 AS block, v FROM s) SELECT key, block::BIGINT AS block, min(v) AS low, max(v) AS high, count(*) AS n, {BITS.format('max(v) - min(v)')}::INT AS width FROM b GROUP BY key, block")
def interval_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("block", F.floor(F.col("l_orderkey") / 256).cast("long"))
    return rows.groupBy("key", "block").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).withColumn("width", N.bit_width(F.col("high") - F.col("low")))
