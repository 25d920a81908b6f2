"""Queries on objects, sections, symbols, dictionaries and regions, over the driver's tables reshaped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records, relate
from .registry import query, table


@query("""SELECT e.event_id, split_part(substr(d.text, (e.event_id % 40 + 1)::INT), ' ', 1) AS name FROM events e JOIN documents d ON d.doc_id = e.user_id""")
def symbol_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols' names by their offset in their object's string table (a text, whose names end with a space)."""
    symbols = table(spark, sf_dir, "events").select(F.col("user_id").alias("object"), "event_id", (F.col("event_id") % 40).cast("int").alias("offset"))
    tables = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("object"), "text")
    return relate.string_names(symbols, ["object"], "offset", tables, "text", " ").select("event_id", "name")


@query("""SELECT l_orderkey, min(CASE WHEN l_returnflag = 'A' THEN l_linenumber END) AS s0, min(CASE WHEN l_returnflag = 'N' THEN l_linenumber END) AS s1, min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS s2 FROM lineitem GROUP BY l_orderkey HAVING s0 IS NOT NULL AND s1 IS NOT NULL AND s2 IS NOT NULL""")
def required_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that have all three sections, and where these are."""
    return relate.all_sections(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", "l_linenumber", ["A", "N", "R"])


@query("""WITH pool AS (SELECT p_partkey * 12 AS value, p_partkey - 1 AS place FROM part WHERE p_size < 10), n AS (SELECT count(*) AS n FROM pool)
SELECT o_orderkey, coalesce(place, CASE WHEN o_orderkey >= 100 AND (o_orderkey - 100) % 4 = 0 THEN n + (o_orderkey - 100) // 4 END)::BIGINT AS digit FROM orders CROSS JOIN n LEFT JOIN pool ON pool.value = o_orderkey""")
def section_pointer_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pointer's place in a pool of functions, else its word in the section."""
    pool = table(spark, sf_dir, "part").where("p_size < 10").select((F.col("p_partkey") * 12).alias("value"), (F.col("p_partkey") - 1).alias("place"))
    pointers = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("at"))
    return relate.pointer_digit(pointers, "at", pool, F.lit(100), 4).select("o_orderkey", "digit")


@query("""WITH d AS (SELECT n_nationkey AS number, sha256(n_name) AS digest FROM nation WHERE n_nationkey < 20), f AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS number, sha256(CASE WHEN c_custkey % 7 = 0 THEN 'other' ELSE n_name END) AS digest FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, CASE WHEN f.number IS NULL THEN 'none' WHEN d.digest IS NULL THEN 'unknown' WHEN d.digest <> f.digest THEN 'mismatch' ELSE 'ok' END AS status FROM f LEFT JOIN d ON d.number = f.number""")
def dictionary_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the dictionary that a frame names is there and is the one it was made with."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("number"), "n_name")
    frames = table(spark, sf_dir, "customer").join(relate.small(nations), F.col("c_nationkey") == F.col("number"))
    frames = frames.select("c_custkey", F.when(F.col("c_custkey") % 11 != 0, F.col("number")).alias("number"), F.sha2(F.when(F.col("c_custkey") % 7 == 0, "other").otherwise(F.col("n_name")), 256).alias("digest"))
    known = nations.where("number < 20").select("number", F.sha2("n_name", 256).alias("digest"))
    return relate.dictionary_status(frames, "number", "digest", known).select("c_custkey", "status")


@query("""SELECT o_orderkey, coalesce(bool_or(l_linenumber = 3), false) AS slots, coalesce(bool_or(l_returnflag = 'R' AND l_linestatus = 'F'), false) AS pointers, coalesce(bool_or(l_quantity > 45), false) AS sections, coalesce(bool_or(l_tax = 0), false) AS tables FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def object_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which transforms an object is eligible for, by what one of its rows fulfils."""
    conditions = {"slots": F.col("l_linenumber") == 3, "pointers": (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "sections": F.col("l_quantity") > 45, "tables": F.col("l_tax") == 0}
    facts = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return relate.eligible(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], facts, conditions)


@query("""WITH b AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), l AS (SELECT doc_id, doc_id - lag(doc_id) OVER (PARTITION BY h ORDER BY doc_id) AS d FROM b) SELECT doc_id, CASE WHEN d <= 64 THEN d END AS distance FROM l""")
def recent_block_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance to the newest equal block among the last 64."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return relate.recent_reference(rows, "doc_id", "digest", 64).select("doc_id", "distance")


@query("""WITH n AS (SELECT p_partkey, list_transform(regexp_extract_all(p_name, '.'), lambda c: ascii(c)::BIGINT) AS l FROM part)
SELECT p_partkey, list_reduce(l, lambda h, c: xor((h * 16 + c) % 4294967296, ((h * 16 + c) % 4294967296 // 268435456) * 16) % 268435456, 0::BIGINT)::BIGINT AS hash FROM n""")
def name_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of a symbol's name in an object's hash table."""
    return table(spark, sf_dir, "part").select("p_partkey", relate.name_hash(F.col("p_name")).alias("hash"))


@query("""WITH s AS (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS v FROM events) SELECT event_id, v - coalesce(lag(v) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS field FROM s""")
def symbol_field_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of each object's symbols less those of the symbol before."""
    from ..operators import series

    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("v"))
    return series.delta(rows, ["user_id"], ["event_id"], "v", "field").select("event_id", "field")


_MARKS = (("the ", "word"), ("\n", "line"), (". ", "stop"), (", ", "pause"))


@query("WITH p AS (" + " UNION ".join("SELECT doc_id, strpos(text, {0}) - 1 AS a, strpos(text, {0}) - 1 + {1} AS b, '{2}' AS kind FROM documents WHERE strpos(text, {0}) > 0".format("chr(10)" if m == "\n" else f"'{m}'", len(m), k) for m, k in _MARKS) + """)
SELECT doc_id, a AS start, b AS "end", kind, (row_number() OVER (PARTITION BY doc_id ORDER BY a, b DESC, kind) - 1)::INT AS rank FROM p""")
def region_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that four detectors propose, in their order."""
    docs = table(spark, sf_dir, "documents")

    def detector(mark: str, kind: str) -> DataFrame:
        at = F.instr(F.col("text"), mark)
        return docs.where(at > 0).select("doc_id", (at - 1).cast("long").alias("start"), (at - 1 + len(mark)).cast("long").alias("end"), F.lit(kind).alias("kind"))

    return relate.proposals([detector(*m) for m in _MARKS], "doc_id")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'molecule,hydrogen' WHEN 1 THEN 'executable' WHEN 2 THEN 'records' ELSE '' END AS kinds FROM documents""")
def admitted_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record kinds that admit a blob: texts with the marks of each kind put before them."""
    mark = F.element_at(F.array(F.lit(b"x V2000 M  END "), F.lit(b"\x7fELF"), F.lit(b"\x01\x00\x05"), F.lit(b"plain ")), (F.col("doc_id") % 4 + 1).cast("int"))
    data = F.concat(mark, F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(records.admissions(data), ",").alias("kinds"))
