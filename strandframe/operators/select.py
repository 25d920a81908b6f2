"""Selection: efforts, shortlists from features, legal candidates, winners and keyset pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Efforts (block bytes, sample bytes, candidates), routes by number, backends that may be nested.
EFFORTS = {"fast": (65_536, 2_048, 4), "balanced": (32_768, 4_096, 7), "maximum": (65_536, 8_192, 10)}
ROUTES = {"raw": 0, "runs": 1, "composition": 2, "bwt": 3, "stride": 4, "lz": 5, "predictor": 6, "phrases": 7, "ppm": 8, "mixture": 9, "deflate": 10}
NESTED = {"fast": (), "balanced": ("hybrid", "native", "deflate"), "maximum": ("native", "deflate", "hybrid", "range", "count-range", "context-range-o1-b4", "context-range-o1-b8", "context-range-o2-b8", "huffman")}
TAIL = ("lz", "bwt", "stride", "predictor", "phrases", "composition", "ppm", "mixture")


def rounded(features: DataFrame, digits: int) -> DataFrame:
    """Features with real numbers rounded, so that thresholds don't depend on the order of sums."""
    out = features
    for name, kind in features.dtypes:
        if kind == "double":
            out = out.withColumn(name, F.round(name, digits))
    return out.withColumn("lag_entropy", F.transform("lag_entropy", lambda v: F.round(v, digits)))


def shortlist(effort: str) -> Column:
    """Route names in order of trial: the two fixed ones, those that the features favour, then the others; no name twice."""
    likely = F.col("predictability") > 0.1
    favoured = [
        F.when(F.col("repeat_fraction") > 0.01, F.lit("lz")),
        F.when(F.array_min("lag_entropy") < F.col("entropy") - 0.20, F.lit("stride")),
        F.when(likely, F.lit("predictor")),
        F.when(likely & F.lit(effort == "balanced") & (F.col("prediction_opportunities") >= 64), F.lit("ppm")),
        F.when((F.col("symbols") < 96) | (F.col("entropy") < 5.5), F.lit("composition")),
    ]
    routes = F.array_distinct(F.array_compact(F.array(F.lit("runs"), F.lit("deflate"), *favoured, *(F.lit(t) for t in TAIL))))
    return F.slice(routes, 1, EFFORTS[effort][2])


def shortlisted(features: DataFrame, key: list[str]) -> DataFrame:
    """(key, effort, place, route) for all efforts."""
    lists = F.array(*(F.struct(F.lit(e).alias("effort"), shortlist(e).alias("routes")) for e in EFFORTS))
    rows = features.select(*key, F.explode(lists).alias("l"))
    return rows.select(*key, "l.effort", F.posexplode("l.routes").alias("place", "route"))


def legal(route: Column, backend: Column) -> Column:
    """Whether a route may use a backend: routes 2 to 7 any nested one, the others their own."""
    nested = F.array(*(F.lit(b) for b in NESTED["maximum"]))
    own = F.create_map(*(F.lit(x) for pair in ((0, "raw"), (1, "runs"), (8, "ppm"), (9, "mixture"), (10, "deflate")) for x in pair))
    return F.when(route.between(2, 7), F.array_contains(nested, backend)).otherwise(F.coalesce(F.try_element_at(own, route) == backend, F.lit(False)))


def candidates(routes: DataFrame, key: list[str]) -> DataFrame:
    """Raw first, then each route with its own backend or, for nested routes, each of the effort's backends, in order.

    The grid comes from literal arrays in each row: no join, no cross product of tables.
    """
    number = F.create_map(*(F.lit(x) for pair in ROUTES.items() for x in pair))
    backends = F.coalesce(*(F.when(F.col("effort") == e, F.array(*(F.lit(b) for b in names)) if names else F.array().cast("array<string>")) for e, names in NESTED.items()))
    numbered = routes.withColumn("number", F.try_element_at(number, F.col("route")))
    choice = F.when(F.col("number").between(2, 7), backends).otherwise(F.array("route"))
    rows = numbered.select(*key, "effort", "place", "number", F.posexplode(choice).alias("turn", "backend")).where(legal(F.col("number"), F.col("backend")))
    raw = routes.select(*key, "effort").distinct().select(*key, "effort", F.lit(-1).alias("place"), F.lit(0).alias("number"), F.lit(0).alias("turn"), F.lit("raw").alias("backend"))
    order = Window.partitionBy(*key, "effort").orderBy("place", "turn")
    return raw.unionByName(rows).select(*key, "effort", (F.row_number().over(order) - 1).alias("ordinal"), F.col("number").alias("route"), "backend")


def winner(costs: DataFrame, key: list[str], cost: str, order: str) -> DataFrame:
    """The row of least cost for each key; equal costs: the least ``order``. One pre-aggregated minimum, no sort."""
    rest = [c for c in costs.columns if c not in key]
    return costs.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(cost, order)).alias("_b")).select(*key, "_b.*")


def beam(estimates: DataFrame, key: list[str], cost: str, order: str, width: int) -> DataFrame:
    """The ``width`` best estimates of each key, ranked from 0."""
    w = Window.partitionBy(*key).orderBy(cost, order)
    return estimates.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < width)


def admitted(candidates_: DataFrame, needed: str, available: int) -> DataFrame:
    """All candidates with status ``admitted`` or ``omitted`` and, for the latter, the reason."""
    fits = F.col(needed) <= available
    return candidates_.withColumn("status", F.when(fits, "admitted").otherwise("omitted")).withColumn("reason", F.when(~fits, F.format_string("needs %d of %d bytes", F.col(needed).cast("long"), F.lit(available))))


def page(df: DataFrame, key: str, cursor, size: int = 100) -> DataFrame:
    """Rows with ``key`` above the cursor in order: at most ``size``, and next_cursor on each if there are more."""
    rows = df if cursor is None else df.where(F.col(key) > F.lit(cursor))
    head = rows.orderBy(key).limit(size + 1)  # a page is the feature; top-k keeps size + 1 rows in each task
    w = Window.orderBy(key)
    numbered = head.withColumn("_n", F.row_number().over(w)).withColumn("_all", F.count("*").over(Window.partitionBy()))
    last = F.max(F.when(F.col("_n") == size, F.col(key))).over(Window.partitionBy())
    return numbered.withColumn("next_cursor", F.when(F.col("_all") > size, last)).where(F.col("_n") <= size).drop("_n", "_all")


#: What a frame's prefix and the end of a live segment cost, in bytes.
PREFIX_COST, END_COST = 41, 3


def region_routes(regions: DataFrame, key: list[str], number: str, raw: str, nested: str, live: str) -> DataFrame:
    """(key, number, route) of each region in order: live, nested or raw, whichever is least of their sizes.

    While a live segment is open, the others bear the cost of closing it; a live region bears that of its end. Ties prefer
    live, then nested, then raw; a null nested size is no candidate. Whether a segment is open depends on the region before
    only, so a key's regions are one fold over its ordered array.
    """
    item = F.struct(F.col(number).cast("long").alias("number"), F.col(raw).cast("long").alias("raw"), F.col(nested).cast("long").alias("nested"), F.col(live).cast("long").alias("live"))
    ordered = regions.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("_r"))
    choice = "struct<number:bigint,route:string>"

    def step(state: Column, r: Column) -> Column:
        open_ = F.coalesce(F.try_element_at(state, F.lit(-1))["route"] == "live", F.lit(False))
        reset = F.when(open_, PREFIX_COST + END_COST).otherwise(0)
        end = r["live"] + END_COST
        plain = r["raw"] + reset
        other = F.coalesce(r["nested"] + reset, F.lit(2**62))
        route = F.when((end <= plain) & (end <= other), "live").when(other <= plain, "nested").otherwise("raw")
        return F.array_append(state, F.struct(r["number"].alias("number"), route.alias("route")))

    folded = F.aggregate("_r", F.array().cast(f"array<{choice}>"), step)
    return ordered.select(*key, F.explode(folded).alias("c")).select(*key, F.col("c.number").alias(number), "c.route")


#: The whole-input backends (id, backend, profile) in order.
BACKENDS = (
    ("gzip-fast", "gzip", "fast"), ("gzip-size", "gzip", "size"), ("bzip2-size", "bzip2", "size"), ("xz-default-6", "xz", "default"), ("xz-size-9e", "xz", "size"),
    ("zstd-fast", "zstd", "fast"), ("zstd-default-3", "zstd", "default"), ("zstd-size-22", "zstd", "size"), ("brotli-fast-0", "brotli", "fast"), ("brotli-size-q11-generic-w22", "brotli", "size"),
    ("xz-dict128-size-9e", "xz", "size"), ("xz-dict128-preset6", "xz", "size"), ("bsc-v3.3.12-bwt-qlfc-static-lzp15-72-fast", "bsc", "size"), ("zpaq715-l5", "zpaq", "size"),
)


def backends(spark) -> DataFrame:
    """The registry of whole-input backends as a table."""
    return spark.createDataFrame([(k, *b) for k, b in enumerate(BACKENDS)], "place int, id string, backend string, profile string")


def trial_totals(trials: DataFrame, route: str, source: str, payload: str, status: str) -> DataFrame:
    """For each route: trials, those that were skipped, bytes in and out of the others, and how often its payload was smaller."""
    ran = F.col(status) == "ran"
    return trials.groupBy(route).agg(F.count("*").alias("trials"), F.sum(F.when(ran, 0).otherwise(1)).alias("skipped"), F.sum(F.when(ran, F.col(source)).otherwise(0)).alias("source_bytes"), F.sum(F.when(ran, F.col(payload)).otherwise(0)).alias("payload_bytes"), F.sum(F.when(ran & (F.col(payload) < F.col(source)), 1).otherwise(0)).alias("smaller"))
