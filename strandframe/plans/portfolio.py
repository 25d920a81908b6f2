"""Queries on trials, routes, backends, eligibility, carriers and containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blobs, select, service
from ..sources import frames
from ..streaming.blocks import folder
from .bytes import BYTES, R, H
from .registry import query, table

_TRIALS = "t AS (SELECT l_orderkey, l_linenumber AS route, round(l_extendedprice)::BIGINT AS source, round(l_extendedprice * (0.5 + l_discount * 10))::BIGINT AS payload, CASE WHEN l_returnflag = 'R' THEN 'skipped' ELSE 'ran' END AS status FROM lineitem)"


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("route"), F.round(price).cast("long").alias("source"), F.round(price * (0.5 + F.col("l_discount") * 10)).cast("long").alias("payload"), F.when(F.col("l_returnflag") == "R", "skipped").otherwise("ran").alias("status"))


@query(f"""WITH {_TRIALS} SELECT route, count(*) AS trials, sum((status <> 'ran')::INT)::BIGINT AS skipped, sum(CASE WHEN status = 'ran' THEN source ELSE 0 END)::BIGINT AS source_bytes, sum(CASE WHEN status = 'ran' THEN payload ELSE 0 END)::BIGINT AS payload_bytes, sum((status = 'ran' AND payload < source)::INT)::BIGINT AS smaller FROM t GROUP BY route""")
def trial_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.trial_totals(trials(spark, sf_dir), "route", "source", "payload", "status")


@query(f"""WITH {_TRIALS}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY payload, route) AS i FROM t WHERE status = 'ran') SELECT l_orderkey, route, payload FROM r WHERE i = 1""")
def whole_input_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest payload of each input among the trials that ran; ties: the earlier route."""
    ran = trials(spark, sf_dir).where("status = 'ran'").select("l_orderkey", "route", "payload")
    return select.winner(ran, ["l_orderkey"], "payload", "route")


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, '{a}', '{b}', '{c}')" for k, (a, b, c) in enumerate(select.BACKENDS)) + ") t(place, id, backend, profile)")
def backend_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.backends(spark)


_SIZED = "s AS (SELECT l_orderkey, l_linenumber AS n, round(l_quantity * 10)::BIGINT AS raw, CASE WHEN l_returnflag = 'A' THEN NULL ELSE round(l_quantity * 10 * (0.6 + l_tax * 6))::BIGINT END AS nested, round(l_quantity * 10 * (0.5 + l_discount * 6))::BIGINT AS live FROM lineitem)"


@query(f"""WITH RECURSIVE {_SIZED}, i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n, raw, nested NULLS FIRST, live) AS i FROM s),
f AS (SELECT l_orderkey, i, n, 'none' AS route, raw, nested, live FROM i WHERE false
UNION ALL SELECT l_orderkey, 0::BIGINT, 0::INT, 'none', 0::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT l_orderkey FROM s)
UNION ALL SELECT i.l_orderkey, i.i, i.n, CASE WHEN i.live + 3 <= i.raw + x.c AND i.live + 3 <= coalesce(i.nested + x.c, 4611686018427387904) THEN 'live' WHEN coalesce(i.nested + x.c, 4611686018427387904) <= i.raw + x.c THEN 'nested' ELSE 'raw' END, i.raw, i.nested, i.live
FROM (SELECT l_orderkey, i, CASE WHEN route = 'live' THEN 44 ELSE 0 END AS c FROM f) x JOIN i ON i.l_orderkey = x.l_orderkey AND i.i = x.i + 1)
SELECT l_orderkey, n::BIGINT AS region, route FROM f WHERE i > 0""")
def region_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of each stream's regions; what one costs depends on whether the one before left a segment open."""
    q = F.col("l_quantity") * 10
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("region"), F.round(q).cast("long").alias("raw"), F.when(F.col("l_returnflag") != "A", F.round(q * (0.6 + F.col("l_tax") * 6)).cast("long")).alias("nested"), F.round(q * (0.5 + F.col("l_discount") * 6)).cast("long").alias("live"))
    return select.region_routes(rows, ["l_orderkey"], "region", "raw", "nested", "live")


@query(f"""WITH {BYTES}, g AS (SELECT doc_id, pos // 1024 AS region, pos, b FROM bytes), r AS (SELECT doc_id, region, b, CASE WHEN b = lag(b) OVER (PARTITION BY doc_id, region ORDER BY pos) THEN 0 ELSE 1 END AS new FROM g),
u AS (SELECT doc_id, region, count(*) AS n, 2 * sum(new) AS runs FROM r GROUP BY ALL), h AS (SELECT doc_id, region, {H} AS e, count(*) AS m FROM (SELECT doc_id, region, b, count(*) AS c FROM g GROUP BY ALL) GROUP BY ALL),
c AS (SELECT doc_id, region, unnest(['stored', 'runs', 'entropy']) AS route, unnest([0, 1, 2]) AS place, unnest([n, runs, ceil(round(n * e / 8, 6))::BIGINT + m]) AS bytes FROM u JOIN h USING (doc_id, region))
SELECT doc_id, region::INT AS region, route, bytes::BIGINT AS bytes FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, region ORDER BY bytes, place) = 1""")
def region_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest of three codings of each region of 1,024 bytes; ties: the earlier one."""
    import numpy as np

    from ..functions import kernels as K

    def rows(d: bytes) -> list[dict]:
        x, out = K.octets(d), []
        for k in range(0, len(x), 1024):
            part = x[k : k + 1024]
            coded = int(np.ceil(round(len(part) * K.entropy(part) / 8, 6))) + len(np.unique(part))
            costs = (("stored", len(part)), ("runs", 2 * (int((part[1:] != part[:-1]).sum()) + 1)), ("entropy", coded))
            out += [{"region": k // 1024, "place": i, "route": name, "bytes": n} for i, (name, n) in enumerate(costs)]
        return out

    costs = blobs.per_blob(table(spark, sf_dir, "documents"), ["doc_id"], "text", rows, "region int, place int, route string, bytes long")
    return select.winner(costs, ["doc_id", "region"], "bytes", "place").select("doc_id", "region", "route", "bytes")


_WINDOWS = f"""{BYTES}, k AS (SELECT doc_id, pos // 4096 AS seq, count(*)::INT AS n_bytes, string_agg(lpad(hex(b), 2, '0'), '' ORDER BY pos) AS h FROM bytes GROUP BY ALL)"""


@query(f"""WITH {_WINDOWS} SELECT doc_id, seq::BIGINT AS seq, n_bytes, sha256(unhex(h)) AS digest, seq = max(seq) OVER (PARTITION BY doc_id) AS terminal, true AS intact FROM k""")
def window_carrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 4 KiB with sequence numbers, digests and a mark on the last, written as a carrier and scanned back."""
    cut = blobs.blocks(table(spark, sf_dir, "documents"), ["doc_id"], "text", 4096)
    path = folder(spark)
    frames.write_container(frames.framed(cut, "data"), path, "doc_id", "block")
    back = frames.read_container(spark, path, "doc_id", "block")
    last = spark.read.parquet(f"{path}/summary").select("doc_id", F.col("last").alias("_last"))
    return back.join(last, "doc_id").select("doc_id", F.col("block").alias("seq"), F.col("frame.source_len").alias("n_bytes"), F.lower(F.hex("frame.digest")).alias("digest"), (F.col("block") == F.col("_last")).alias("terminal"), F.col("ok").alias("intact"))


@query("""SELECT doc_id, (octet_length(encode(text)) + 1023) // 1024 AS regions, sha256(text) AS digest FROM documents WHERE octet_length(encode(text)) > 0""")
def carrier_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts put together again from the regions of a carrier, whatever the order these arrive in."""
    cut = blobs.blocks(table(spark, sf_dir, "documents"), ["doc_id"], "text", 1024)
    return frames.restored(cut, ["doc_id"], "block", "data").select("doc_id", F.col("pieces").alias("regions"), F.sha2("data", 256).alias("digest"))


@query(f"""WITH {_WINDOWS} SELECT doc_id, seq::BIGINT AS block, n_bytes, sha256(unhex(h)) AS digest, true AS ok FROM k""")
def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of texts to frames, and the stream of these frames decoded: every block checked by its digest."""
    from ..streaming import blocks

    texts = blocks.read_stream(spark, f"{sf_dir}/documents.parquet", "doc_id long, text string")
    encoded = frames.framed(blobs.blocks(texts, ["doc_id"], "text", 4096), "data").select("doc_id", "block", "frame")
    written = blocks.drained(encoded)
    path = folder(spark)
    written.write.parquet(path)
    decoded = blocks.read_stream(spark, f"{path}/", f"doc_id long, block long, frame {frames.FRAME}", files=16)
    decoded = decoded.select("doc_id", "block", F.col("frame.source_len").alias("n_bytes"), F.lower(F.hex("frame.digest")).alias("digest"), frames.intact().alias("ok"))
    return blocks.drained(decoded)


@query("SELECT doc_id, CASE WHEN octet_length(encode(coalesce(text, ''))) <= 4096 THEN 'read' ELSE 'too long' END AS status, least(octet_length(encode(coalesce(text, ''))), 4097)::INT AS taken FROM documents")
def bounded_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts under a hard cap of 4,096 bytes; of a longer one a byte beyond the cap tells that it is."""
    return frames.bounded(table(spark, sf_dir, "documents"), "text", 4096).select("doc_id", "status", "taken")


_OPTIONS = "o AS (SELECT o_orderkey, o_orderkey % 11 AS level, o_custkey % 7 = 0 AS pipe, o_custkey % 5 = 0 AS live, o_custkey % 3 AS history, round(o_totalprice)::BIGINT AS size, CASE o_orderkey % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'framed' WHEN 2 THEN 'gzip' ELSE 'auto' END AS format FROM orders)"


@query(f"""WITH {_OPTIONS} SELECT o_orderkey, CASE WHEN level < 9 THEN NULL WHEN pipe THEN 'input cannot be read twice' WHEN live THEN 'live flushing' WHEN size > 200000 THEN 'input too long' WHEN size * 3 + 1 > 450000 THEN 'memory' WHEN history <> 0 THEN 'history' WHEN format NOT IN ('auto', 'framed') THEN 'format' END AS reason,
level >= 9 AND NOT pipe AND NOT live AND size <= 200000 AND size * 3 + 1 <= 450000 AND history = 0 AND format IN ('auto', 'framed') AS eligible FROM o""")
def plan_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a whole input may be tried at the highest effort, and the first reason why not."""
    key = F.col("o_orderkey")
    size = F.round("o_totalprice").cast("long")
    format_ = F.element_at(F.array(F.lit("auto"), F.lit("framed"), F.lit("gzip"), F.lit("auto")), (key % 4 + 1).cast("int"))
    asked = key % 11 >= 9
    reasons = {"input cannot be read twice": F.col("o_custkey") % 7 == 0, "live flushing": F.col("o_custkey") % 5 == 0, "input too long": size > 200_000, "memory": size * 3 + 1 > 450_000, "history": F.col("o_custkey") % 3 != 0, "format": ~format_.isin("auto", "framed")}
    reason = F.when(asked, service.first_reason(reasons))
    return table(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"), (asked & reason.isNull()).alias("eligible"))


@query("""SELECT doc_id, format('signature="{}" path=Stored restored_bytes={} verified=true', coalesce(substr(text, 1, 4), ''), octet_length(encode(coalesce(text, '')))) AS line FROM documents""")
def list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of a listing for each blob."""
    return table(spark, sf_dir, "documents").select("doc_id", frames.list_line(F.coalesce(F.substring("text", 1, 4), F.lit("")), F.lit("Stored"), F.octet_length(F.coalesce("text", F.lit("")))).alias("line"))
