"""Queries on what stands before a byte or a row: contexts, matches, lanes, planes, predictions, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blobs, series
from .bytes import BYTES, R, H, _transform
from .registry import query, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"""WITH {BYTES}, w AS (SELECT doc_id, pos, lag(b, 1) OVER o AS b1, lag(b, 2) OVER o AS b2, lag(b, 3) OVER o AS b3, lag(b, 4) OVER o AS b4 FROM bytes WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
p AS (SELECT doc_id, pos - lag(pos) OVER (PARTITION BY doc_id, b1, b2, b3, b4 ORDER BY pos) AS far FROM w WHERE b4 IS NOT NULL),
g AS (SELECT doc_id, count(*) AS positions, count(far) AS hits, sum(far) AS distances FROM p GROUP BY doc_id)
SELECT z.doc_id, coalesce(positions, 0) AS positions, coalesce(hits, 0) AS hits, coalesce(distances, 0)::BIGINT AS distances FROM sizes z LEFT JOIN g USING (doc_id)""")
def context_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that follow four bytes which were there before, and how far back."""
    return blobs.context_history(documents(spark, sf_dir), ["doc_id"], "text")


@query(f"""WITH {BYTES}, w AS (SELECT doc_id, pos, b, lead(b, 1) OVER o AS b1, lead(b, 2) OVER o AS b2, lead(b, 3) OVER o AS b3 FROM bytes WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
l AS (SELECT doc_id, pos, {", ".join(f"pos - lag(pos, {k}) OVER o AS d{k}" for k in range(1, 9))} FROM w WHERE b3 IS NOT NULL WINDOW o AS (PARTITION BY doc_id, b, b1, b2, b3 ORDER BY pos)),
u AS (SELECT doc_id, pos, unnest([{", ".join(f"d{k}" for k in range(1, 9))}]) AS far FROM l),
n AS (SELECT doc_id, pos, count(*) AS c, min(far) AS near, sum(far) AS far FROM u WHERE far <= 65536 GROUP BY doc_id, pos),
g AS (SELECT doc_id, count(*) AS positions, sum(c) AS matches, sum(near) AS nearest, sum(far) AS distances FROM n GROUP BY doc_id)
SELECT z.doc_id, coalesce(positions, 0) AS positions, coalesce(matches, 0)::BIGINT AS matches, coalesce(nearest, 0)::BIGINT AS nearest, coalesce(distances, 0)::BIGINT AS distances FROM sizes z LEFT JOIN g USING (doc_id)""")
def newest_k_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight newest earlier matches of each position within 64 KiB."""
    return blobs.match_history(documents(spark, sf_dir), ["doc_id"], "text")


_LANES = f"l AS (SELECT doc_id, pos % 4 AS lane, b, count(*) AS c FROM bytes GROUP BY ALL)"


@query(f"""WITH {BYTES}, {_LANES} SELECT doc_id, lane::INT AS lane, sum(c)::BIGINT AS n_bytes, count(*)::INT AS symbols, CASE WHEN count(*) = 1 THEN 0 ELSE length(to_binary((count(*) - 1)::BIGINT)) END::INT AS index_bits, round({H}, {R}) AS entropy FROM l GROUP BY doc_id, lane""")
def record_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lane of four-byte records as a stream of its own: its palette and entropy."""
    return blobs.lanes(documents(spark, sf_dir), ["doc_id"], "text", 4).withColumn("entropy", F.round("entropy", R))


@query(f"""WITH {BYTES}, p AS (SELECT unnest(range(8)) AS plane), x AS (SELECT doc_id, pos, plane, (b >> plane::INT) & 1 AS v FROM bytes CROSS JOIN p),
c AS (SELECT doc_id, plane, v, (v <> lag(v) OVER (PARTITION BY doc_id, plane ORDER BY pos))::INT AS d FROM x), g AS (SELECT doc_id, plane, sum(v) AS ones, coalesce(sum(d), 0) AS changes FROM c GROUP BY doc_id, plane)
SELECT z.doc_id, p.plane::INT AS plane, coalesce(ones, 0)::BIGINT AS ones, coalesce(changes, 0)::BIGINT AS changes FROM sizes z CROSS JOIN p LEFT JOIN g ON g.doc_id = z.doc_id AND g.plane = p.plane""")
def bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.bit_planes(documents(spark, sf_dir), ["doc_id"], "text")


@query(f"""WITH {BYTES}, p AS (SELECT unnest(range(8)) AS level), c AS (SELECT doc_id, level, b >> (8 - level)::INT AS node, count(*) AS n, sum((b >> (7 - level)::INT) & 1) AS o FROM bytes CROSS JOIN p GROUP BY ALL),
g AS (SELECT doc_id, level, count(*) AS nodes, sum(o) AS ones, sum(CASE WHEN o > 0 THEN -o * log2(o / n) ELSE 0 END + CASE WHEN n > o THEN -(n - o) * log2((n - o) / n) ELSE 0 END) AS bits FROM c GROUP BY doc_id, level)
SELECT z.doc_id, p.level::INT AS level, coalesce(nodes, 0)::INT AS nodes, coalesce(ones, 0)::BIGINT AS ones, round(coalesce(bits, 0), 5) + 0.0::DOUBLE AS bits FROM sizes z CROSS JOIN p LEFT JOIN g ON g.doc_id = z.doc_id AND g.level = p.level""")
def wavelet_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.wavelet_levels(documents(spark, sf_dir), ["doc_id"], "text").withColumn("bits", F.round("bits", 5) + F.lit(0.0))


@query(f"""WITH {BYTES}, w AS (SELECT doc_id, pos, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS ctx FROM bytes),
s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS n0, row_number() OVER (PARTITION BY doc_id, b ORDER BY pos) - 1 AS c0, row_number() OVER (PARTITION BY doc_id, ctx ORDER BY pos) - 1 AS n1, row_number() OVER (PARTITION BY doc_id, ctx, b ORDER BY pos) - 1 AS c1 FROM w),
g AS (SELECT doc_id, sum(log2((256 + n0) / (1 + c0))) AS x0, sum(log2((256 + n1) / (1 + c1))) AS x1 FROM s GROUP BY doc_id), k AS (SELECT unnest([0, 1]) AS k)
SELECT z.doc_id, k::INT AS "order", round(coalesce(CASE WHEN k = 0 THEN x0 ELSE x1 END, 0), 4) AS bits FROM sizes z CROSS JOIN k LEFT JOIN g USING (doc_id)""")
def adaptive_context_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits under adaptive counts, without a context and in that of the byte before."""
    return blobs.adaptive_costs(documents(spark, sf_dir), ["doc_id"], "text").withColumn("bits", F.round("bits", 4))


@query(f"""WITH {BYTES} SELECT h.doc_id, h.n::BIGINT AS n_bytes, sha256(unhex(coalesce(string_agg(lpad(hex(b), 2, '0'), '' ORDER BY CASE WHEN pos < 28 THEN -1 WHEN pos < h.n // 28 * 28 THEN pos % 28 ELSE 28 END, pos), ''))) AS digest, true AS restored
FROM sizes h LEFT JOIN bytes USING (doc_id) GROUP BY h.doc_id, h.n""")
def grid_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of 28 bytes after a header of one record, column by column."""
    return _transform(spark, sf_dir, "grid28")


@query(f"""WITH {BYTES}, cut AS (SELECT doc_id, pos, b, (lead(b, 1) OVER o) AS b1, (lead(b, 2) OVER o) AS b2, (lead(b, 3) OVER o) AS b3, n FROM bytes JOIN sizes USING (doc_id) WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
t AS (SELECT doc_id, n, pos, ((b * 256 + b1) * 256 + b2)::BIGINT * 256 + b3 AS token FROM cut WHERE pos % 4 = 0 AND pos < least(n, 65536) - 4),
d AS (SELECT doc_id, n, pos, pos - lag(pos) OVER (PARTITION BY doc_id, token ORDER BY pos) AS width FROM t),
v AS (SELECT doc_id, n, width, count(*) AS votes, min(pos) AS seen FROM d WHERE width BETWEEN 2 AND least(2048, n // 16) AND n // 16 >= 2 GROUP BY doc_id, n, width),
r AS (SELECT doc_id, n, width FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, seen) <= 16),
q AS (SELECT doc_id, n, unnest(list_filter(range(2, width + 1), lambda k: width % k = 0)) AS w FROM r UNION SELECT doc_id, n, unnest([2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024, 1536, 2048]) FROM sizes)
SELECT DISTINCT doc_id, w::INT AS width FROM q WHERE w <= least(2048, n // 16) AND n // 16 >= 2""")
def width_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record widths to try: the union of the usual ones, the voted ones and their divisors."""
    return blobs.record_widths(documents(spark, sf_dir), ["doc_id"], "text")


@query(f"""WITH {BYTES}, t AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END, x)) AS t),
l AS (SELECT doc_id, list(b::BIGINT ORDER BY pos) AS l FROM bytes GROUP BY doc_id)
SELECT z.doc_id, CASE WHEN l IS NULL THEN 0 ELSE xor(4294967295, list_reduce(l, lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]), 4294967295)) END::BIGINT AS crc FROM sizes z LEFT JOIN l USING (doc_id) CROSS JOIN t""")
def crc32_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))


#: Orders in blocks of 64: a coarse signed coordinate and a coarse value.
_GRID = "s AS (SELECT o_orderkey AS pos, (o_orderkey // 64)::BIGINT AS block, (o_custkey % 7 - 3)::BIGINT AS q, (o_custkey % 5 - 2)::BIGINT * 1000000000 AS v FROM orders)"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.floor(F.col("o_orderkey") / 64).cast("long").alias("block"), (F.col("o_custkey") % 7 - 3).cast("long").alias("q"), ((F.col("o_custkey") % 5 - 2) * 1_000_000_000).cast("long").alias("v"))


def _modal(name: str, same: str) -> str:
    return f"""{name}n AS (SELECT a.block, a.pos, b.v, count(*) AS n FROM k a JOIN k b ON b.block = a.block AND b.pos < a.pos AND {same} GROUP BY ALL),
{name} AS (SELECT block, pos, v AS guess FROM {name}n QUALIFY row_number() OVER (PARTITION BY block, pos ORDER BY n DESC, abs(v), v) = 1)"""


@query(f"""WITH {_GRID}, k AS (SELECT *, CASE WHEN q < 0 THEN 1 ELSE 0 END AS sign, CASE WHEN q = 0 THEN 0 ELSE length(to_binary(abs(q))) END AS bits FROM s),
{_modal("own", "b.q = a.q")}, {_modal("ctx", "b.sign = a.sign AND b.bits = a.bits AND (b.q % 16 + 16) % 16 = (a.q % 16 + 16) % 16")},
l AS (SELECT block, pos, q, v, lag(v) OVER (PARTITION BY block, q ORDER BY pos) AS last FROM k),
g AS (SELECT l.block, l.pos, l.v, unnest([coalesce(last, 0), coalesce(own.guess, 0), coalesce(last, ctx.guess, 0), coalesce(own.guess, ctx.guess, 0), coalesce(ctx.guess, 0)]) AS guess, unnest([0, 1, 2, 3, 4]) AS mode FROM l LEFT JOIN own ON own.block = l.block AND own.pos = l.pos LEFT JOIN ctx ON ctx.block = l.block AND ctx.pos = l.pos)
SELECT pos, mode::INT AS mode, (((v - guess + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)::BIGINT AS residual FROM g""")
def grid_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values less the last or the modal value at their coordinate or in its context: five modes."""
    return series.predicted(grid(spark, sf_dir), "block", "pos", "q", "v").select("pos", "mode", "residual")


@query(f"WITH {_GRID} SELECT pos, count(*) OVER w AS held, min(v) OVER w AS least, max(v) OVER w AS most FROM s WINDOW w AS (PARTITION BY block ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)".replace("count(*) OVER w", "count(v) OVER w"))
def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a bounded history holds before each row: the last eight values of its block."""
    return series.history(grid(spark, sf_dir), ["block"], ["pos"], "v", 8).select("pos", "held", "least", "most")


@query("""WITH s AS (SELECT user_id, event_id, (CASE WHEN event_type = 'click' THEN 1 ELSE -1 END) * round(value)::BIGINT AS change FROM events), h AS (SELECT user_id, change, sum(change) OVER (PARTITION BY user_id ORDER BY event_id) AS held FROM s)
SELECT user_id, sum(change)::BIGINT AS reserved, greatest(max(held), 0)::BIGINT AS peak FROM h GROUP BY user_id""")
def memory_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's reservations and releases leave, and their peak."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.when(F.col("event_type") == "click", 1).otherwise(-1) * F.round("value").cast("long")).alias("change"))
    return series.usage(rows, ["user_id"], ["event_id"], "change").select("user_id", "reserved", F.col("peak").cast("long").alias("peak"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


@query("""WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS c FROM lineitem GROUP BY ALL)
SELECT l_orderkey, sum(c)::INT AS n, (factorial(sum(c)::INT) // product(factorial(c::INT))::HUGEINT)::BIGINT AS arrangements FROM c GROUP BY l_orderkey""")
def arrangement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many arrangements the return flags of each order have."""
    return series.arrangements(lines(spark, sf_dir).select("l_orderkey", "l_returnflag"), ["l_orderkey"], "l_returnflag")


@query("""WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber + 5 AS place FROM lineitem WHERE l_returnflag = 'N'), i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY place) AS i FROM p)
SELECT l_orderkey, count(*) AS places, sum(CASE WHEN place >= i THEN factorial(place::INT) // (factorial(i::INT) * factorial((place - i)::INT)) ELSE 0 END)::BIGINT AS rank FROM i GROUP BY l_orderkey""")
def colex_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colexicographic rank of the places of each order's unreturned lines."""
    rows = lines(spark, sf_dir).where("l_returnflag = 'N'").select("l_orderkey", (F.col("l_linenumber") + 5).alias("place")).distinct()
    return series.subset_rank(rows, ["l_orderkey"], "place")


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber, l_linenumber % (l_linenumber + 2) AS digit, l_linenumber + 2 AS alphabet FROM lineitem), w AS (SELECT *, coalesce(product(alphabet) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS w FROM d)
SELECT l_orderkey, count(*) AS digits, sum(digit * w)::BIGINT AS number FROM w GROUP BY l_orderkey""")
def mixed_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choices of each order's lines as one number, each from an alphabet of its own."""
    n = F.col("l_linenumber")
    rows = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", (n % (n + 2)).alias("digit"), (n + 2).alias("alphabet")).distinct()
    return series.mixed_radix(rows, ["l_orderkey"], ["l_linenumber"], "digit", "alphabet")


@query("""WITH b AS (SELECT (o_orderkey // 256)::BIGINT AS block, o_orderpriority AS s, count(*) AS c FROM orders GROUP BY ALL)
SELECT block, sum(c)::BIGINT AS n, round((lgamma(sum(c) + 1.0) - sum(lgamma(c + 1.0))) / ln(2), 4) AS bits FROM b GROUP BY block""")
def remaining_count_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of each block's priorities by what remains of each: the logarithm of their arrangements."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 256).cast("long").alias("block"), "o_orderpriority")
    return series.remaining_cost(rows, ["block"], ["o_orderkey"], "o_orderpriority").withColumn("bits", F.round("bits", 4))
