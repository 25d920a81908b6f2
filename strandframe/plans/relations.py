"""Queries that relate tables: indexes, options, ranges, overlaps, parents, references, policies, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relate, select, series
from .registry import query, table

_INDEX = "idx AS (SELECT c_mktsegment AS name, c_nationkey::BIGINT AS value, count(*) AS times FROM customer WHERE c_nationkey <> 0 GROUP BY ALL)"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").cast("long").alias("value"))
    return relate.symbol_index(symbols, "name", "value")


@query(f"WITH {_INDEX} SELECT * FROM idx")
def global_symbol_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)


_OPTIONS = f"""{_INDEX}, slots AS (SELECT c_custkey, c_mktsegment AS name, c_nationkey::BIGINT AS own FROM customer),
o AS (SELECT s.c_custkey, string_agg(i.value::VARCHAR, ',' ORDER BY i.times DESC, i.value) AS rest FROM slots s JOIN idx i ON i.name = s.name AND i.value <> s.own GROUP BY s.c_custkey)"""


@query(f"WITH {_OPTIONS} SELECT s.c_custkey, s.own::VARCHAR || CASE WHEN rest IS NULL THEN '' ELSE ',' || rest END AS options FROM slots s LEFT JOIN o USING (c_custkey)")
def option_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("name"), F.col("c_nationkey").cast("long").alias("own"))
    found = relate.option_lists(slots, ["c_custkey"], "name", "own", _index(spark, sf_dir), "value")
    return found.select("c_custkey", F.array_join(F.transform("options", lambda v: v.cast("string")), ",").alias("options"))


@query(f"""WITH {_INDEX}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY times DESC, value) - 1 AS at FROM idx)
SELECT c_custkey, r.at::INT AS position FROM customer LEFT JOIN r ON r.name = c_mktsegment AND r.value = c_nationkey""")
def option_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each customer's nation stands among its segment's values; those that the index lacks have none."""
    ranked = _index(spark, sf_dir).groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("times")).alias("r"), F.col("value").alias("v")))), lambda x: x["v"]).alias("options"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("name"), F.col("c_nationkey").cast("long").alias("own")).join(relate.small(ranked), "name", "left")
    return rows.select("c_custkey", relate.option_position(F.coalesce("options", F.array().cast("array<bigint>")), F.col("own")).cast("int").alias("position"))


_RANGES = "r AS (SELECT p_partkey AS name, p_partkey * 50 AS lo, p_partkey * 50 + 20 + p_size AS hi FROM part)"


@query(f"""WITH {_RANGES}, j AS (SELECT o_orderkey, name, o_orderkey - lo AS distance, count(*) OVER (PARTITION BY o_orderkey) AS n FROM orders JOIN r ON o_orderkey BETWEEN lo AND hi)
SELECT o_orderkey, name, distance FROM j WHERE n = 1""")
def range_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the one range of parts that holds their key; in none or several: dropped."""
    ranges = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), (F.col("p_partkey") * 50).alias("lo"), (F.col("p_partkey") * 50 + 20 + F.col("p_size")).alias("hi"))
    points = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("at"))
    return relate.range_resolved(points, ["o_orderkey"], "at", ranges, "name", "lo", "hi", 64).select("o_orderkey", "name", F.col("offset").alias("distance"))


@query("""WITH s AS (SELECT user_id, event_id, event_id * 10 AS start, floor(value * 100)::BIGINT AS length FROM events),
w AS (SELECT *, lead(start) OVER o AS after, lag(start + length) OVER o AS before FROM s WINDOW o AS (PARTITION BY user_id ORDER BY start, length))
SELECT user_id, event_id, start, length FROM w WHERE NOT (coalesce(after < start + length, false) OR coalesce(before > start, false))""")
def overlap_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 10).alias("start"), F.floor(F.col("value") * 100).cast("long").alias("length"))
    return relate.without_overlaps(spans, ["user_id"], "start", "length")


@query("SELECT c.conv_id, c.turn, length(c.text) - coalesce(length(p.text), 0) AS residual FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")
def parent_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return relate.parent_residual(rows, ["conv_id"], "turn", "n").select("conv_id", "turn", "residual")


@query("SELECT l_orderkey, l_suppkey AS node, arg_max(l_linenumber, l_linenumber)::INT AS parent FROM lineitem WHERE l_linenumber < l_suppkey GROUP BY ALL")
def last_bond_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    bonds = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_linenumber").alias("a"), F.col("l_suppkey").alias("b"))
    return relate.parents(bonds, ["l_orderkey"], "n", "a", "b")


@query("SELECT doc_id, lag(doc_id) OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS reference FROM documents")
def block_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return relate.block_reference(rows, "doc_id", "digest").select("doc_id", "reference")


_POLICY = """b AS (SELECT c_custkey AS identity, role FROM customer JOIN (SELECT unnest(['reader', 'writer', 'auditor']) AS role, unnest([2, 3, 5]) AS step) ON c_custkey % step = 0),
rules AS (SELECT * FROM (VALUES ('reader', 'allow', 100, 'seg:*', NULL), ('writer', 'allow', 40, NULL, 'AMER'), ('writer', 'deny', 0, 'seg:MACHINERY', '*'), ('auditor', 'allow', 70, '*', '*'), ('auditor', 'deny', 0, NULL, 'ASIA')) t(role, effect, cap, object, place))"""


@query(f"""WITH {_POLICY}, q AS (SELECT c_custkey AS identity, 'seg:' || c_mktsegment AS object, r_name AS place FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
m AS (SELECT q.identity, effect, cap FROM q JOIN b USING (identity) JOIN rules USING (role) WHERE (rules.object IS NULL OR rules.object = '*' OR rules.object = q.object OR (rules.object LIKE '%:*' AND starts_with(q.object, rules.object[:-2]))) AND (rules.place IS NULL OR rules.place = '*' OR rules.place = q.place)),
g AS (SELECT identity, bool_or(effect = 'deny') AS d, bool_or(effect = 'allow') AS a, min(CASE WHEN effect = 'allow' THEN cap END) AS cap FROM m GROUP BY identity)
SELECT q.identity, q.object, q.place, coalesce(a AND NOT d, false) AS allowed, CASE WHEN a AND NOT d THEN g.cap END::INT AS cap FROM q LEFT JOIN g USING (identity)""")
def policy_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = relate.small(nations.join(relate.small(regions), nations.n_regionkey == regions.r_regionkey).select("n_nationkey", F.col("r_name").alias("place")))
    requests = customers.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("identity"), F.concat(F.lit("seg:"), "c_mktsegment").alias("object"), "place")
    roles = F.array_compact(F.array(*(F.when(F.col("c_custkey") % k == 0, F.lit(r)) for r, k in (("reader", 2), ("writer", 3), ("auditor", 5)))))
    bindings = customers.select(F.col("c_custkey").alias("identity"), F.explode(roles).alias("role"))
    rules = spark.createDataFrame([("reader", "allow", 100, "seg:*", None), ("writer", "allow", 40, None, "AMER"), ("writer", "deny", 0, "seg:MACHINERY", "*"), ("auditor", "allow", 70, "*", "*"), ("auditor", "deny", 0, None, "ASIA")], "role string, effect string, cap int, on_object string, on_place string")
    return relate.policy_decision(requests, bindings, rules, ["identity"], {"object": "on_object", "place": "on_place"}).select("identity", "object", "place", "allowed", "cap")


@query("""WITH t AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS turn, min(p_partkey) OVER (PARTITION BY p_brand) AS family_first FROM part)
SELECT p_partkey, p_brand, turn::INT AS turn, family_first FROM t""")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.round_robin(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey").orderBy("turn", "family_first")


#: Known spans of the texts, the gaps between them and their pieces, in DuckDB.
_REGIONS = """sz AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM documents),
kn AS (SELECT doc_id, (size // 3)::BIGINT AS a, (size // 3 + 64)::BIGINT AS b, 'marked' AS kind FROM sz WHERE size >= 300 UNION ALL SELECT doc_id, (size // 2 + 100)::BIGINT, (size // 2 + 140)::BIGINT, 'noted' FROM sz WHERE size >= 900),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f FROM kn),
g AS (SELECT doc_id, f AS a, a AS b FROM e WHERE a > f UNION ALL SELECT sz.doc_id, coalesce(m, 0), size FROM sz LEFT JOIN (SELECT doc_id, max(b) AS m FROM kn GROUP BY doc_id) USING (doc_id) WHERE size > coalesce(m, 0)),
c AS (SELECT doc_id, a, b, unnest(range((b - a + 1023) // 1024)) AS k FROM g)"""


@query(f"WITH {_REGIONS} SELECT doc_id, a AS start, b AS \"end\", kind FROM kn UNION ALL SELECT doc_id, a + k * 1024, least(b, a + (k + 1) * 1024), 'generic' FROM c")
def region_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete partitions of the texts' bytes: known spans, and gaps cut at 1,024 bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    third, half = F.floor(F.col("size") / 3), F.floor(F.col("size") / 2)
    marks = [F.when(F.col("size") >= 300, F.struct(third.alias("a"), (third + 64).alias("b"), F.lit("marked").alias("kind"))), F.when(F.col("size") >= 900, F.struct((half + 100).alias("a"), (half + 140).alias("b"), F.lit("noted").alias("kind")))]
    spans = docs.select("doc_id", F.explode(F.array_compact(F.array(*marks))).alias("s")).select("doc_id", "s.a", "s.b", "s.kind")
    return relate.partitioned(spans, "doc_id", "a", "b", "kind", docs, "size", 1024)


@query("""WITH s AS (SELECT user_id, event_id AS a, event_id + 1 + event_id % 7 AS b FROM events), n AS (SELECT *, CASE WHEN lag(b) OVER (PARTITION BY user_id ORDER BY a) = a THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a) AS g FROM n) SELECT user_id, min(a) AS a, max(b) AS b FROM g GROUP BY user_id, g""")
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("a"), (F.col("event_id") + 1 + F.col("event_id") % 7).alias("b"))
    return relate.merged_spans(spans, ["user_id"], "a", "b")


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id AS a, event_id + 1 + event_id % 301 AS b, event_type AS kind FROM events), i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a, a - b, kind) AS i FROM s),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 0::BIGINT AS last, 0 AS taken, false AS took FROM s
UNION ALL SELECT i.user_id, i.i, CASE WHEN i.a >= f.last AND f.taken < 256 THEN i.b ELSE f.last END, f.taken + (i.a >= f.last AND f.taken < 256)::INT, i.a >= f.last AND f.taken < 256 FROM f JOIN i ON i.user_id = f.user_id AND i.i = f.i + 1)
SELECT i.user_id, i.a AS start, i.b AS "end", i.kind FROM f JOIN i ON i.user_id = f.user_id AND i.i = f.i WHERE f.took""")
def greedy_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-overlapping spans of each user's events by start, longest first, at most 256 of each."""
    spans = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + 1 + F.col("event_id") % 301).alias("end"), F.col("event_type").alias("kind"))
    return relate.greedy_spans(spans, "user_id")


@query("""WITH n AS (SELECT p_name AS name, count(*) AS documents FROM part GROUP BY p_name), r AS (SELECT *, row_number() OVER (ORDER BY documents DESC, name) AS i FROM n) SELECT name, documents FROM r WHERE i <= 8192""")
def frequent_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8,192 most frequent names, ties by name: a top-k report."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "name").limit(8192)


@query("""WITH u AS (SELECT c_name AS name, min(c_custkey) AS value FROM customer GROUP BY c_name HAVING count(*) = 1) SELECT c.c_custkey, u.value * 8 AS rank FROM customer c JOIN u ON u.name = c.c_name""")
def unique_name_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    unique = customers.groupBy("name").agg(F.min("c_custkey").alias("value"), F.count("*").alias("n")).where("n = 1")
    return customers.join(unique, "name").select("c_custkey", (F.col("value") * 8).alias("rank"))


@query("""WITH c AS (SELECT doc_id, unnest(range(1, 5)) AS k, n_chars FROM documents) SELECT doc_id, k::INT AS k, CASE WHEN n_chars * k <= 8192 THEN 'admitted' ELSE 'omitted' END AS status FROM c""")
def candidate_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.explode(F.array(*(F.lit(k) for k in range(1, 5)))).alias("k"))
    return select.admitted(rows.withColumn("needed", F.col("n_chars") * F.col("k")), "needed", 8192).select("doc_id", "k", "status")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber AS place, CAST(round(l_extendedprice * 100) AS BIGINT) AS bytes FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY bytes, place) - 1 AS rank FROM c)
SELECT l_orderkey, place, bytes, rank::INT AS rank FROM r WHERE rank < 3""")
def beam_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("place"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("bytes"))
    return select.beam(rows, ["l_orderkey"], "bytes", "place", 3)
