"""Queries of the job and metadata store, over events and orders reshaped as its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import select, service
from ..operators.relate import small
from ..sources import frames
from .registry import query, table

_JOBS = """j AS (SELECT event_id AS id, user_id AS tenant, CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' ELSE 'cancelling' END AS state,
event_id * 1000 + 999 - (event_id * 7919) % 1000000 AS created_ms, event_id * 977 % 10000000 AS lease_until, 'w' || (event_id % 5) AS lease_owner FROM events)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    state = F.when(kind == "click", "queued").when(kind == "view", "running").when(kind == "error", "failed").when(kind == "purchase", "succeeded").otherwise("cancelling")
    at = F.col("event_id")
    return table(spark, sf_dir, "events").select(at.alias("id"), F.col("user_id").alias("tenant"), state.alias("state"), (at * 1000 + 999 - (at * 7919) % 1000000).alias("created_ms"), (at * 977 % 10000000).alias("lease_until"), F.concat(F.lit("w"), (at % 5).cast("string")).alias("lease_owner"))


@query("SELECT o_orderkey, o_custkey, (SELECT max(o_orderkey) FROM (SELECT o_orderkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100)) AS next_cursor FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 500, 100)


@query("WITH p AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100) SELECT o_orderkey, o_custkey FROM p WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY')")
def page_then_authorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authorization after the page is cut: a page may be short."""
    page = select.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 500, 100)
    allowed = table(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return small(page).join(allowed, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query(f"WITH {_JOBS} SELECT id, tenant, state, created_ms FROM j WHERE state = 'queued' OR (state IN ('running', 'cancelling') AND lease_until < 5000000) ORDER BY created_ms, id LIMIT 8")
def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.claimable(jobs(spark, sf_dir), 5_000_000).select("id", "tenant", "state", "created_ms")


@query(f"WITH {_JOBS} SELECT id, state FROM j WHERE lease_owner = 'w3' AND lease_until >= 5000000 AND state NOT IN ('succeeded', 'failed', 'cancelled')")
def lease_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.alive(jobs(spark, sf_dir), "w3", 5_000_000).select("id", "state")


_IDEM = "r AS (SELECT user_id AS tenant, event_type AS provider, event_id % 50 AS idem, event_id, md5(props) AS fingerprint FROM events)"


@query(f"WITH {_IDEM}, w AS (SELECT *, row_number() OVER (PARTITION BY tenant, provider, idem ORDER BY event_id) AS i, count(*) OVER p AS requests, min(fingerprint) OVER p <> max(fingerprint) OVER p AS conflict FROM r WINDOW p AS (PARTITION BY tenant, provider, idem)) SELECT tenant, provider, idem, event_id, fingerprint, requests, conflict FROM w WHERE i = 1")
def idempotent_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("tenant"), F.col("event_type").alias("provider"), (F.col("event_id") % 50).alias("idem"), "event_id", F.md5("props").alias("fingerprint"))
    return service.submitted(rows, ["tenant", "provider", "idem"], "fingerprint", ["event_id"])


@query("SELECT user_id, max(event_id) AS revision, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("revision"), "event_type", "value")
    return service.latest(rows, ["user_id"], "revision")


@query("WITH c AS (SELECT user_id, max(event_id) AS revision FROM events GROUP BY user_id) SELECT e.user_id, e.event_id AS revision, e.event_type FROM events e JOIN c ON c.user_id = e.user_id AND c.revision = e.event_id")
def fenced_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("revision"), "event_type")
    return service.fenced(rows, service.latest(rows.select("user_id", "revision"), ["user_id"], "revision"), ["user_id"], "revision")


@query(f"WITH {_JOBS} SELECT state, count(*) AS jobs, count(DISTINCT tenant) AS tenants FROM j GROUP BY state")
def admission_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).groupBy("state").agg(F.count("*").alias("jobs"), F.countDistinct("tenant").alias("tenants"))


@query("""WITH m AS (SELECT doc_id, sha256(coalesce(text, '')) AS address FROM documents), st AS (SELECT doc_id + (CASE WHEN doc_id % 97 = 0 THEN 1000000 ELSE 0 END) AS doc_id, address FROM m)
SELECT doc_id, address, 'missing' AS problem FROM m WHERE doc_id % 97 = 0 UNION ALL SELECT doc_id, address, 'extra' FROM st WHERE doc_id >= 1000000""")
def backup_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of all documents against a store in which some stand under other ids: what is missing and what is extra."""
    wanted = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("address"))
    stored = wanted.withColumn("doc_id", F.col("doc_id") + F.when(F.col("doc_id") % 97 == 0, 1_000_000).otherwise(0))
    return frames.differences(wanted, stored, ["doc_id", "address"])


@query("""SELECT page_id, CASE WHEN n % 4 = 0 THEN 'br' WHEN n % 4 = 1 THEN 'gzip' WHEN n % 4 = 2 THEN 'zstd' END AS coding FROM (SELECT page_id, page_id % 4 AS n FROM pages)""")
def negotiated_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = F.array(F.lit("gzip;q=0.5, br;q=0.9, zstd;q=0.1"), F.lit("gzip, identity;q=0.2"), F.lit("*;q=0.3, gzip;q=0.2, br;q=0"), F.lit("identity, gzip;q=0"))
    return table(spark, sf_dir, "pages").select("page_id", service.negotiated(F.element_at(headers, (F.col("page_id") % 4 + 1).cast("int")), ["zstd", "gzip", "br"]).alias("coding"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN page_id * 1024 WHEN 1 THEN page_id * 1048576 ELSE page_id END::BIGINT AS bytes FROM pages")
def parsed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(F.lit("KiB"), F.lit(" MiB"), F.lit("")), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", service.size_of(F.concat(F.col("page_id").cast("string"), suffix)).alias("bytes"))


@query("SELECT doc_id, CASE WHEN n_chars > 4000 THEN 'input' WHEN n_chars * 3 > 9000 THEN 'memory' END AS violation FROM documents")
def limit_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", service.first_violation({"input": (n, F.lit(4000)), "memory": (n * 3, F.lit(9000))}).alias("violation"))


@query("""WITH s AS (SELECT DISTINCT user_id AS tenant, event_type AS kind, event_id % 20 AS id FROM events WHERE event_id % 2 = 0), n AS (SELECT user_id AS tenant, event_type AS kind, event_id % 20 AS id, min(event_id) AS body, count(*) - 1 AS repeats FROM events WHERE event_id % 3 = 0 GROUP BY ALL)
SELECT n.tenant, n.kind, n.id, n.body, n.repeats, CASE WHEN s.tenant IS NULL THEN 'created' ELSE 'conflict' END AS status FROM n LEFT JOIN s ON s.tenant = n.tenant AND s.kind = n.kind AND s.id = n.id""")
def insert_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for a store that takes each key once."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("tenant"), F.col("event_type").alias("kind"), (F.col("event_id") % 20).alias("id"), F.col("event_id").alias("body"))
    return service.inserted(rows.where("body % 2 = 0"), rows.where("body % 3 = 0"), ["tenant", "kind", "id"])


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 97")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), o_orderkey=97)


@query(f"""WITH {_JOBS}, u AS (SELECT event_id AS id, 'w' || (event_id % 3) AS worker, event_id % 4 AS expected, CASE WHEN event_id % 2 = 0 THEN 'succeeded' ELSE 'failed' END AS to_state FROM events)
SELECT id, tenant, id % 4 + 1 AS revision, to_state AS state, worker FROM j JOIN u USING (id) WHERE expected = id % 4 AND worker = lease_owner AND lease_until >= 4000000 AND state NOT IN ('succeeded', 'failed', 'cancelled')""")
def terminal_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that workers finish: the events of updates that pass the fences of revision and lease."""
    known = jobs(spark, sf_dir).withColumn("revision", F.col("id") % 4)
    updates = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("w"), (F.col("event_id") % 3).cast("string")).alias("worker"), (F.col("event_id") % 4).alias("expected"), F.when(F.col("event_id") % 2 == 0, "succeeded").otherwise("failed").alias("to_state"))
    return service.finished(known, updates, 4_000_000)


@query("""WITH p AS (SELECT event_id, event_type FROM events WHERE user_id = 3 AND event_id > 10 ORDER BY event_id LIMIT 3), a AS (SELECT count(*) AS n FROM events WHERE user_id = 3 AND event_id > 10)
SELECT event_id, event_type, (SELECT CASE WHEN n > 3 THEN (SELECT max(event_id) FROM p) END FROM a) AS next_cursor FROM p""")
def event_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of one job's events after a cursor."""
    rows = service.lookup(table(spark, sf_dir, "events"), user_id=3).select("event_id", "event_type")
    return select.page(rows, "event_id", 10, 3)


@query("""WITH a AS (SELECT sha256(coalesce(text, '')) AS id, octet_length(encode(coalesce(text, '')))::BIGINT AS size, doc_id FROM documents) SELECT id, size, 'text/plain' AS media_type, count(*) AS names, min(doc_id) AS first_name FROM a GROUP BY id, size""")
def describe_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts by their content address: size, type, and the names that refer to them."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(F.sha2(text, 256).alias("id"), F.octet_length(text).cast("long").alias("size"), "doc_id")
    return rows.groupBy("id", "size").agg(F.count("*").alias("names"), F.min("doc_id").alias("first_name")).withColumn("media_type", F.lit("text/plain"))


@query("""WITH e AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations) SELECT conv_id, count(*)::INT AS entries, sum(n)::BIGINT AS chars, arg_min(role, turn) AS first_role, string_agg(turn::VARCHAR || '/' || role, ',' ORDER BY turn) AS paths FROM e GROUP BY conv_id""")
def collection_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections as nested documents (an array of entries, each with its metadata), and what is read from them."""
    entry = F.struct("turn", F.concat_ws("/", F.col("turn").cast("string"), "role").alias("path"), F.create_map(F.lit("role"), F.col("role")).alias("metadata"), F.length("text").cast("long").alias("size"))
    nested = table(spark, sf_dir, "conversations").select("conv_id", "turn", entry.alias("entry")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "entry.path", "entry.size", F.col("entry.metadata")["role"].alias("role")))).alias("entries"))
    return nested.select("conv_id", F.size("entries").alias("entries"), F.aggregate("entries", F.lit(0).cast("long"), lambda a, e: a + e["size"]).alias("chars"), F.col("entries")[0]["role"].alias("first_role"), F.array_join(F.transform("entries", lambda e: e["path"]), ",").alias("paths"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN page_id WHEN 1 THEN page_id * 1000 WHEN 2 THEN page_id * 60000 END::BIGINT AS ms FROM pages")
def parsed_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(F.lit("ms"), F.lit("s"), F.lit("m"), F.lit("h")), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", service.duration_ms(F.concat(F.col("page_id").cast("string"), suffix)).alias("ms"))
