"""Queries on texts as byte sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blobs, select
from .registry import ORACLES, query, table

#: (doc_id, pos, b) of whole texts, in DuckDB.
BYTES = """hexed AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS l FROM documents),
bytes AS (SELECT doc_id, ('0x' || x)::INT AS b, pos FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS pos FROM hexed)),
sizes AS (SELECT doc_id, len(l) AS n FROM hexed)"""
#: The sample regions of 2048 bytes in all, and their bytes.
SAMPLE = f"""{BYTES},
starts AS (SELECT doc_id, n, unnest(list_sort(list_distinct([0, n // 3, 2 * n // 3, greatest(0, n - 512)]))) AS start FROM sizes),
parts AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS region, start, least(n, start + 512) AS stop FROM starts),
sampled AS (SELECT p.doc_id, p.region, b.pos - p.start AS i, b.b FROM parts p JOIN bytes b ON b.doc_id = p.doc_id AND b.pos >= p.start AND b.pos < p.stop)"""
#: Entropy of the counts c of a group.
H = "log2(sum(c)) - sum(c * log2(c)) / sum(c)"
R = 9


@query(f"""WITH {SAMPLE},
h AS (SELECT doc_id, sum(c) AS n, count(*) AS m, {H} AS e FROM (SELECT doc_id, b, count(*) AS c FROM sampled GROUP BY doc_id, b) GROUP BY doc_id),
w AS (SELECT *, lag(b) OVER o AS b1, lag(b, 2) OVER o AS b2, lag(b, 3) OVER o AS b3 FROM sampled WINDOW o AS (PARTITION BY doc_id, region ORDER BY i)),
r AS (SELECT doc_id, sum((b = b1)::INT) AS eq, count(b3) AS k, count(DISTINCT CASE WHEN b3 IS NOT NULL THEN ((b3 * 256 + b2) * 256 + b1)::BIGINT * 256 + b END) AS d FROM w GROUP BY doc_id),
p AS (SELECT doc_id, b, lag(b) OVER (PARTITION BY doc_id, b2 * 256 + b1 ORDER BY region, i) AS guess FROM w WHERE b2 IS NOT NULL),
q AS (SELECT doc_id, count(guess) AS o, sum((guess = b)::INT) AS hit FROM p GROUP BY doc_id),
g AS (SELECT doc_id, max(e) - min(e) AS spread FROM (SELECT doc_id, region, {H} AS e FROM (SELECT doc_id, region, b, count(*) AS c FROM sampled GROUP BY ALL) GROUP BY ALL) GROUP BY doc_id),
z AS (SELECT doc_id, count(*) AS regions FROM parts GROUP BY doc_id)
SELECT z.doc_id, coalesce(h.n, 0)::INT AS sample_bytes, round(coalesce(h.e, 0), {R}) AS entropy, coalesce(h.m, 0)::INT AS symbols,
  round(coalesce(r.eq, 0) / greatest(coalesce(h.n, 0) - z.regions, 1), {R}) AS run_fraction, round((coalesce(r.k, 0) - coalesce(r.d, 0)) / greatest(coalesce(r.k, 0), 1), {R}) AS repeat_fraction,
  round(coalesce(q.hit, 0) / greatest(coalesce(q.o, 0), 1), {R}) AS predictability, coalesce(q.o, 0)::INT AS prediction_opportunities, round(coalesce(g.spread, 0), {R}) AS regional_entropy_range
FROM z LEFT JOIN h USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN q USING (doc_id) LEFT JOIN g USING (doc_id)""")
def byte_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blobs.profile(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    real = ("entropy", "run_fraction", "repeat_fraction", "predictability", "regional_entropy_range")
    return found.select("doc_id", *(F.round(c, R).alias(c) if c in real else c for c in found.columns if c not in ("doc_id", "lag_entropy")))


@query(f"""WITH {BYTES} SELECT doc_id, b AS byte, count(*) AS times, min(pos) AS first FROM bytes GROUP BY doc_id, b""")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.histogram(table(spark, sf_dir, "documents"), ["doc_id"], "text")


@query(f"""WITH {BYTES} SELECT doc_id, sum(c)::BIGINT AS n_bytes, round({H}, {R}) AS entropy FROM (SELECT doc_id, b, count(*) AS c FROM bytes GROUP BY doc_id, b) GROUP BY doc_id""")
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.entropies(table(spark, sf_dir, "documents"), ["doc_id"], "text").withColumn("entropy", F.round("entropy", R))


@query(f"""WITH {SAMPLE} SELECT p.doc_id, p.region::INT AS region, p.start, p.stop - p.start AS bytes, round(coalesce(e.e, 0), {R}) AS entropy FROM parts p LEFT JOIN
(SELECT doc_id, region, {H} AS e FROM (SELECT doc_id, region, b, count(*) AS c FROM sampled GROUP BY ALL) GROUP BY ALL) e USING (doc_id, region)""")
def region_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.region_entropies(table(spark, sf_dir, "documents"), ["doc_id"], "text").withColumn("entropy", F.round("entropy", R))


@query(f"""WITH {SAMPLE}, lags AS (SELECT unnest([1, 2, 4, 8, 16, 32, 64]) AS lag),
x AS (SELECT a.doc_id, lags.lag, xor(a.b, z.b) AS v, count(*) AS c FROM sampled a CROSS JOIN lags JOIN sampled z ON z.doc_id = a.doc_id AND z.region = a.region AND z.i = a.i - lags.lag GROUP BY ALL),
e AS (SELECT doc_id, lag, {H} AS e FROM x GROUP BY doc_id, lag)
SELECT s.doc_id, lags.lag::INT AS lag, round(coalesce(e.e, 0), {R}) AS entropy FROM sizes s CROSS JOIN lags LEFT JOIN e ON e.doc_id = s.doc_id AND e.lag = lags.lag""")
def lag_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.kernels import LAGS

    found = blobs.profile(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    lags = F.array(*(F.struct(F.lit(k).alias("lag"), F.round(F.col("lag_entropy")[i], R).alias("entropy")) for i, k in enumerate(LAGS)))
    return found.select("doc_id", F.explode(lags).alias("e")).select("doc_id", "e.lag", "e.entropy")


def _digested(expr: str) -> str:
    """The digest of a per-byte expression over (doc_id, pos, b) with window o."""
    return f"""WITH {BYTES}, x AS (SELECT doc_id, pos, {expr} AS v FROM bytes WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT h.doc_id, h.n::BIGINT AS n_bytes, sha256(unhex(coalesce(string_agg(lpad(hex(v), 2, '0'), '' ORDER BY pos), ''))) AS digest, true AS restored FROM sizes h LEFT JOIN x USING (doc_id) GROUP BY h.doc_id, h.n"""


def _transform(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return blobs.transform_check(table(spark, sf_dir, "documents"), ["doc_id"], "text", name).select("doc_id", "n_bytes", "digest", "restored")


@query(_digested("xor(b, coalesce(lag(b, 4) OVER o, 0))"))
def byte_xor_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transform(spark, sf_dir, "xor4")


@query(_digested("(b - coalesce(lag(b, 2) OVER o, 0) + 256) % 256"))
def byte_sub_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transform(spark, sf_dir, "sub2")


@query(f"""WITH {BYTES}, k AS (SELECT doc_id, n // 4 * 4 AS whole FROM sizes)
SELECT h.doc_id, h.n::BIGINT AS n_bytes, sha256(unhex(coalesce(string_agg(lpad(hex(b), 2, '0'), '' ORDER BY CASE WHEN pos < whole THEN pos % 4 ELSE 4 END, pos), ''))) AS digest, true AS restored
FROM sizes h JOIN k USING (doc_id) LEFT JOIN bytes USING (doc_id) GROUP BY h.doc_id, h.n""")
def byte_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transform(spark, sf_dir, "shuffle4")


def _word_sql(value: str) -> str:
    """The digest of 4-byte little-endian words under an expression of v, p (the word before) and pp."""
    return f"""WITH {BYTES}, words AS (SELECT b.doc_id, pos // 4 AS w, sum(b.b::BIGINT << (8 * (pos % 4))::INT)::BIGINT AS v FROM bytes b JOIN sizes h USING (doc_id) WHERE pos < h.n // 4 * 4 GROUP BY ALL),
lagged AS (SELECT doc_id, w, v, lag(v) OVER o AS p, lag(v, 2) OVER o AS pp FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY w)),
stepped AS (SELECT doc_id, w, {value} AS x FROM lagged),
out AS (SELECT doc_id, 4 * w AS pos, lpad(hex(x & 255), 2, '0') || lpad(hex((x >> 8) & 255), 2, '0') || lpad(hex((x >> 16) & 255), 2, '0') || lpad(hex((x >> 24) & 255), 2, '0') AS t FROM stepped
UNION ALL SELECT b.doc_id, pos, lpad(hex(b.b), 2, '0') FROM bytes b JOIN sizes h USING (doc_id) WHERE pos >= h.n // 4 * 4)
SELECT h.doc_id, h.n::BIGINT AS n_bytes, sha256(unhex(coalesce(string_agg(t, '' ORDER BY pos), ''))) AS digest, true AS restored FROM sizes h LEFT JOIN out USING (doc_id) GROUP BY h.doc_id, h.n"""


_WRAP = "4294967296"


@query(_word_sql(f"(v - coalesce(p, 0) + {_WRAP}) % {_WRAP}"))
def word_delta_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transform(spark, sf_dir, "word_delta4le")


@query(_word_sql("xor(v, coalesce(p, 0))"))
def word_xor_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transform(spark, sf_dir, "word_xor4le")


@query(_word_sql(f"CASE WHEN p IS NULL THEN v WHEN pp IS NULL THEN (v - p + {_WRAP}) % {_WRAP} ELSE (v - 2 * p + pp + 2 * {_WRAP}) % {_WRAP} END"))
def word_delta2_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transform(spark, sf_dir, "word_delta24le")


@query()
def reversible_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered transform over all texts: documents, bytes, mean entropy and whether all came back."""
    from functools import reduce

    docs = table(spark, sf_dir, "documents")
    names = [n for n in blobs.TRANSFORMS if n not in ("match_xor", "adaptive", "move_to_front")]
    each = [blobs.transform_check(docs, ["doc_id"], "text", n).groupBy(F.lit(n).alias("transform")).agg(F.count("*").alias("documents"), F.sum("n_bytes").alias("n_bytes"), F.round(F.avg("entropy"), 6).alias("entropy"), F.min("restored").alias("restored")) for n in names]
    return reduce(DataFrame.unionByName, each)


@query()
def sequential_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match-XOR, the adaptive predictor and move-to-front of every whole text, with their inverses checked."""
    from functools import reduce

    docs = table(spark, sf_dir, "documents")
    return reduce(DataFrame.unionByName, [blobs.transform_check(docs, ["doc_id"], "text", n).withColumn("transform", F.lit(n)).withColumn("entropy", F.round("entropy", R)) for n in ("match_xor", "adaptive", "move_to_front")])


@query()
def block_sort_and_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block sorting, move-to-front runs and LZ parse of each 4 KiB block of every text, restored."""
    return blobs.sequence_check(table(spark, sf_dir, "documents"), ["doc_id"], "text").withColumn("front_entropy", F.round("front_entropy", R))


@query()
def stride_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.stride_choice(table(spark, sf_dir, "documents"), ["doc_id"], "text")


@query(f"""WITH {BYTES}, c AS (SELECT doc_id, b, count(*) AS c FROM bytes GROUP BY doc_id, b),
g AS (SELECT doc_id, sum(c) AS n, count(*) AS m, sum(lgamma(c + 1.0)) AS s FROM c GROUP BY doc_id)
SELECT z.doc_id, z.n::BIGINT AS n_bytes, coalesce(m, 0)::INT AS symbols, round(CASE WHEN z.n = 0 THEN 1.0 ELSE (8 + (lgamma(257.0) - lgamma(m + 1.0) - lgamma(257.0 - m) + lgamma(z.n::DOUBLE) - lgamma(m::DOUBLE) - lgamma(z.n - m + 1.0) + lgamma(z.n + 1.0) - s) / ln(2)) / 8 END, 5) AS estimate FROM sizes z LEFT JOIN g USING (doc_id)""")
def typeclass_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.type_class(table(spark, sf_dir, "documents"), ["doc_id"], "text").withColumn("estimate", F.round("estimate", 5))


@query()
def period_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best periodic residuals of each text, of all lags up to half of it."""
    return blobs.period_profile(table(spark, sf_dir, "documents"), ["doc_id"], "text")


@query(f"""WITH {BYTES}, c AS (SELECT doc_id, pos // 1024 AS tile, b, count(*) AS c FROM bytes GROUP BY ALL)
SELECT doc_id, tile::INT AS tile, sum(c)::BIGINT AS bytes, count(*)::INT AS symbols, (arg_max(b, c * 256 + (255 - b)))::INT AS mode, max(c)::BIGINT AS mode_times FROM c GROUP BY doc_id, tile""")
def tile_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.tiles(table(spark, sf_dir, "documents"), ["doc_id"], "text")


@query(f"""WITH {BYTES}, cut AS (SELECT doc_id, pos, b, (lead(b, 1) OVER o) AS b1, (lead(b, 2) OVER o) AS b2, (lead(b, 3) OVER o) AS b3, n FROM bytes JOIN sizes USING (doc_id) WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
t AS (SELECT doc_id, n, pos, ((b * 256 + b1) * 256 + b2)::BIGINT * 256 + b3 AS token FROM cut WHERE pos % 4 = 0 AND pos < least(n, 65536) - 4),
d AS (SELECT doc_id, n, pos, pos - lag(pos) OVER (PARTITION BY doc_id, token ORDER BY pos) AS width FROM t),
v AS (SELECT doc_id, width, count(*) AS votes, min(pos) AS seen FROM d WHERE width BETWEEN 2 AND least(2048, n // 16) AND n // 16 >= 2 GROUP BY doc_id, width),
r AS (SELECT doc_id, width, votes, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, seen) - 1 AS rank FROM v)
SELECT doc_id, rank::INT AS rank, width::INT AS width, votes::INT AS votes FROM r WHERE rank < 16""")
def record_width_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.record_width_votes(table(spark, sf_dir, "documents"), ["doc_id"], "text")


@query(f"""WITH {BYTES}, g AS (SELECT doc_id, pos, b * 256 + lead(b) OVER (PARTITION BY doc_id ORDER BY pos) AS digram FROM bytes),
c AS (SELECT doc_id, digram, count(*) AS times, min(pos) AS first FROM g WHERE digram IS NOT NULL GROUP BY doc_id, digram HAVING count(*) >= 8),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY times DESC, first) - 1 AS rank FROM c)
SELECT doc_id, rank::INT AS rank, digram::INT AS digram, times::INT AS times, first::INT AS first FROM r WHERE rank < 32""")
def digram_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.phrase_palette(table(spark, sf_dir, "documents"), ["doc_id"], "text")


@query(f"""WITH {BYTES}, k AS (SELECT doc_id, pos // 65536 AS block, count(*)::INT AS n_bytes, string_agg(lpad(hex(b), 2, '0'), '' ORDER BY pos) AS h FROM bytes GROUP BY ALL)
SELECT doc_id, block::BIGINT AS block, n_bytes, 0 AS route, n_bytes AS payload_len, sha256(unhex(h)) AS digest FROM k""")
def sha256_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.frames import framed

    cut = blobs.blocks(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return framed(cut, "data").select("doc_id", "block", "n_bytes", "frame.route", "frame.payload_len", F.lower(F.hex("frame.digest")).alias("digest"))


@query("""WITH s AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents), w AS (SELECT doc_id, n, unnest(range((n + 4095) // 4096)) AS window_no FROM s)
SELECT window_no::BIGINT AS window_no, count(*) AS windows, sum(least(4096, n - window_no * 4096))::BIGINT AS bytes FROM w GROUP BY window_no""")
def count_window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length(F.coalesce("text", F.lit("")))
    docs = table(spark, sf_dir, "documents").select("doc_id", size.cast("long").alias("n")).where("n > 0")
    cut = docs.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 4096))).alias("window_no"))
    return cut.groupBy("window_no").agg(F.count("*").alias("windows"), F.sum(F.least(F.lit(4096), F.col("n") - F.col("window_no") * 4096)).alias("bytes"))


@query()
def candidate_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest substream coder of each text; equal sizes: the earlier coder."""
    costs = blobs.coded(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return select.winner(costs, ["doc_id"], "bytes", "place").select("doc_id", "coder", "bytes")


@query()
def standard_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text through every standard format and back: sizes by format, and whether all were restored."""
    each = blobs.standard_roundtrip(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return each.groupBy("format").agg(F.count("*").alias("documents"), F.sum("bytes").alias("bytes"), F.min("restored").alias("restored"))


@query(f"""WITH {SAMPLE},
h AS (SELECT doc_id, sum(c) AS n, count(*) AS m, {H} AS e FROM (SELECT doc_id, b, count(*) AS c FROM sampled GROUP BY doc_id, b) GROUP BY doc_id),
w AS (SELECT *, lag(b) OVER o AS b1, lag(b, 2) OVER o AS b2, lag(b, 3) OVER o AS b3 FROM sampled WINDOW o AS (PARTITION BY doc_id, region ORDER BY i)),
r AS (SELECT doc_id, count(b3) AS k, count(DISTINCT CASE WHEN b3 IS NOT NULL THEN ((b3 * 256 + b2) * 256 + b1)::BIGINT * 256 + b END) AS d FROM w GROUP BY doc_id),
p AS (SELECT doc_id, b, lag(b) OVER (PARTITION BY doc_id, b2 * 256 + b1 ORDER BY region, i) AS guess FROM w WHERE b2 IS NOT NULL),
q AS (SELECT doc_id, count(guess) AS o, sum((guess = b)::INT) AS hit FROM p GROUP BY doc_id),
lags AS (SELECT unnest([1, 2, 4, 8, 16, 32, 64]) AS lag),
x AS (SELECT a.doc_id, lags.lag, xor(a.b, y.b) AS v, count(*) AS c FROM sampled a CROSS JOIN lags JOIN sampled y ON y.doc_id = a.doc_id AND y.region = a.region AND y.i = a.i - lags.lag GROUP BY ALL),
le AS (SELECT doc_id, min(e) AS e, count(*) AS k FROM (SELECT doc_id, lag, {H} AS e FROM x GROUP BY doc_id, lag) GROUP BY doc_id),
f AS (SELECT s.doc_id, round(coalesce(h.e, 0), {R}) AS e, coalesce(h.m, 0) AS m, round((coalesce(r.k, 0) - coalesce(r.d, 0)) / greatest(coalesce(r.k, 0), 1), {R}) AS rep, round(coalesce(q.hit, 0) / greatest(coalesce(q.o, 0), 1), {R}) AS pr, coalesce(q.o, 0) AS o,
  round(CASE WHEN coalesce(le.k, 0) < 7 THEN 0 ELSE le.e END, {R}) AS le FROM sizes s LEFT JOIN h USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN q USING (doc_id) LEFT JOIN le USING (doc_id)),
efforts AS (SELECT * FROM (VALUES ('fast', 4), ('balanced', 7), ('maximum', 10)) t(effort, most)),
listed AS (SELECT doc_id, effort, most, unnest(l) AS route, generate_subscripts(l, 1) AS seq FROM (SELECT doc_id, effort, most, ['runs', 'deflate', CASE WHEN rep > 0.01 THEN 'lz' END, CASE WHEN le < e - 0.20 THEN 'stride' END, CASE WHEN pr > 0.1 THEN 'predictor' END,
  CASE WHEN pr > 0.1 AND effort = 'balanced' AND o >= 64 THEN 'ppm' END, CASE WHEN m < 96 OR e < 5.5 THEN 'composition' END, 'lz', 'bwt', 'stride', 'predictor', 'phrases', 'composition', 'ppm', 'mixture'] AS l FROM f CROSS JOIN efforts)),
firsts AS (SELECT doc_id, effort, most, route, min(seq) AS seq FROM listed WHERE route IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, effort ORDER BY seq) - 1 AS place FROM firsts)
SELECT doc_id, effort, place::INT AS place, route FROM ranked WHERE place < most""")
def route_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blobs.profile(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return select.shortlisted(select.rounded(found, R), ["doc_id"])


@query(f"""WITH r AS (SELECT * FROM ({ORACLES["route_shortlist"]}) WHERE effort = 'balanced'),
n AS (SELECT r.*, list_position(['runs', 'composition', 'bwt', 'stride', 'lz', 'predictor', 'phrases', 'ppm', 'mixture', 'deflate'], route) AS number FROM r),
l AS (SELECT *, CASE WHEN number BETWEEN 2 AND 7 THEN ['hybrid', 'native', 'deflate'] ELSE [route] END AS l FROM n),
e AS (SELECT doc_id, effort, place, number, unnest(l) AS backend, generate_subscripts(l, 1) AS turn FROM l UNION ALL SELECT DISTINCT doc_id, effort, -1, 0, 'raw', 0 FROM r)
SELECT doc_id, effort, (row_number() OVER (PARTITION BY doc_id, effort ORDER BY place, turn) - 1)::INT AS ordinal, number::INT AS route, backend FROM e""")
def candidate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal (route, backend) candidates of each text at the balanced effort, in order."""
    found = blobs.profile(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    routes = select.shortlisted(select.rounded(found, R), ["doc_id"]).where("effort = 'balanced'")
    return select.candidates(routes, ["doc_id"])
