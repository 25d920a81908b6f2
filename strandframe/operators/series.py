"""Reversible transforms of integer series, their inverses and their costs.

A series is the rows of one ``key`` in the order of ``pos``. All windows are partitioned by the key: a long stream is cut
into blocks first (``blocked``), as fixed-size blocks are the unit of parallel work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import bit_width, signed, varint_length, wrapped, zigzag


def blocked(pos: Column, size: int) -> Column:
    """The block that a position lies in."""
    return F.floor(pos / size).cast("long")


def _over(key: list[str], pos: list[str]):
    return Window.partitionBy(*key).orderBy(*pos)


def delta(df: DataFrame, key: list[str], pos: list[str], value: str, out: str = "delta", bits: int | None = None, lag: int = 1) -> DataFrame:
    """Difference to the value ``lag`` rows before (the first rows keep their value), modulo 2^bits if asked for."""
    v = F.col(value) - F.coalesce(F.lag(value, lag).over(_over(key, pos)), F.lit(0))
    return df.withColumn(out, v if bits is None else wrapped(v, bits))


def undelta(df: DataFrame, key: list[str], pos: list[str], value: str, out: str = "value", bits: int | None = None) -> DataFrame:
    """Inverse of ``delta`` with lag 1: running sums."""
    v = F.sum(value).over(_over(key, pos).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, v if bits is None else wrapped(v, bits))


def delta2(df: DataFrame, key: list[str], pos: list[str], value: str, out: str = "delta2") -> DataFrame:
    """Second differences; the first row keeps its value and the second its first difference."""
    w = _over(key, pos)
    one = F.col(value) - F.lag(value).over(w)
    first = df.withColumn("_d", one)
    before = F.lag("_d").over(w)
    return first.withColumn(out, F.coalesce(F.col("_d") - before, F.col("_d"), F.col(value))).drop("_d")


def undelta2(df: DataFrame, key: list[str], pos: list[str], value: str, out: str = "value") -> DataFrame:
    """Inverse of ``delta2``: running sums of the running sums of all rows but the first."""
    w = _over(key, pos).rowsBetween(Window.unboundedPreceding, 0)
    steps = F.when(F.row_number().over(_over(key, pos)) > 1, F.col(value)).otherwise(0)
    rows = df.withColumn("_s", steps).withColumn("_d", F.sum("_s").over(w))
    first = F.first(value).over(w)
    return rows.withColumn(out, first + F.sum("_d").over(w)).drop("_s", "_d")


def zigzagged(df: DataFrame, value: str, out: str = "zigzag") -> DataFrame:
    return df.withColumn(out, zigzag(F.col(value)))


def xor_lag(df: DataFrame, key: list[str], pos: list[str], value: str, out: str = "residual", lag: int = 1) -> DataFrame:
    """Exclusive or with the value ``lag`` rows before."""
    return df.withColumn(out, F.col(value).bitwiseXOR(F.coalesce(F.lag(value, lag).over(_over(key, pos)), F.lit(0).cast(df.schema[value].dataType))))


def frame_of_reference(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """For each series: its least value, the bits of the largest offset from it, and the bits of all offsets at that width."""
    least, most, n = F.min(value), F.max(value), F.count(value)
    rows = df.groupBy(*key).agg(least.alias("base"), (most - least).alias("_span"), n.alias("n"))
    return rows.select(*key, "n", "base", bit_width(F.col("_span")).alias("width"), (bit_width(F.col("_span")) * F.col("n")).cast("long").alias("bits"))


def delta_bits(df: DataFrame, key: list[str], pos: list[str], value: str, order: int = 1) -> DataFrame:
    """For each series: the width and the bits of its zigzag differences (order 1) or second differences (order 2); the
    rows that keep a value whole are apart."""
    if order == 1:
        rows = df.withColumn("_d", F.col(value) - F.lag(value).over(_over(key, pos)))
    else:
        rows = df.withColumn("_f", F.col(value) - F.lag(value).over(_over(key, pos))).withColumn("_d", F.col("_f") - F.lag("_f").over(_over(key, pos)))
    width = F.coalesce(F.max(bit_width(zigzag(F.col("_d")))), F.lit(0))
    return rows.groupBy(*key).agg(F.count("*").alias("n"), width.cast("int").alias("width"), (width * F.count("_d")).cast("long").alias("bits"))


def patched_widths(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """For each series, the distinct low widths that a patched frame tries: 0, the 90th, 95th and 99th percentile (the value
    at floor(n q) of the sorted widths) and the largest width of its offsets; with the exceptions and bits of each."""
    offsets = df.join(df.groupBy(*key).agg(F.min(value).alias("_base")), key).select(*key, bit_width(F.col(value) - F.col("_base")).alias("_w"))
    counts = offsets.groupBy(*key, "_w").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*key).orderBy("_w").rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.withColumn("_upto", F.sum("_c").over(w)).withColumn("n", F.sum("_c").over(Window.partitionBy(*key)))
    pick = lambda q: F.min(F.when(F.col("_upto") > F.least(F.floor(F.col("n") * q), F.col("n") - 1), F.col("_w")))
    widths = cum.groupBy(*key, "n").agg(F.array_distinct(F.array(F.lit(0), pick(0.90), pick(0.95), pick(0.99), F.max("_w"))).alias("_ws"), F.max("_w").alias("_most"))
    low = widths.select(*key, "n", "_most", F.explode("_ws").alias("width"))
    over = low.join(counts, key).groupBy(*key, "n", "_most", "width").agg(F.sum(F.when(F.col("_w") > F.col("width"), F.col("_c")).otherwise(0)).alias("exceptions"))
    bits = F.col("n") * F.col("width") + F.col("exceptions") * (32 + F.col("_most") - F.col("width"))
    return over.select(*key, "n", "width", "exceptions", bits.cast("long").alias("bits"))


def cheapest(candidates: DataFrame, key: list[str], cost: str, order: str) -> DataFrame:
    """For each key the candidate of least cost; equal costs: of least ``order``."""
    best = F.min_by(F.struct(*(c for c in candidates.columns if c not in key)), F.struct(cost, order))
    return candidates.groupBy(*key).agg(best.alias("_b")).select(*key, "_b.*")


def rice_costs(df: DataFrame, key: list[str], value: str, most: int = 16) -> DataFrame:
    """For each series of non-negative numbers and each k: the bits of its Rice code (quotient + 1 + k each)."""
    # sums for all k in one aggregation, then a row for each k: no row is multiplied before the aggregation
    sums = df.groupBy(*key).agg(*(F.sum(F.shiftright(F.col(value), k) + 1 + k).alias(f"_{k}") for k in range(most + 1)))
    return sums.select(*key, F.posexplode(F.array(*(F.col(f"_{k}") for k in range(most + 1)))).alias("k", "bits"))


def varint_costs(df: DataFrame, key: list[str], value: str) -> DataFrame:
    return df.groupBy(*key).agg(F.sum(varint_length(F.col(value))).cast("long").alias("bytes"))


def feedback(df: DataFrame, key: list[str], pos: list[str], value: str, bits: int = 16, out: str = "correction") -> DataFrame:
    """Value less the last value at the same key, wrapped to a signed number of ``bits``."""
    return df.withColumn(out, signed(F.col(value) - F.coalesce(F.lag(value).over(_over(key, pos)), F.lit(0)), bits))


def unfeedback(df: DataFrame, key: list[str], pos: list[str], value: str, bits: int = 16, out: str = "value") -> DataFrame:
    return df.withColumn(out, signed(F.sum(value).over(_over(key, pos).rowsBetween(Window.unboundedPreceding, 0)), bits))


def recurrence(df: DataFrame, block: list[str], pos: str, symbol: str) -> DataFrame:
    """Distance to the last row with the same symbol in the block (none: 0) and its bucket, the bits of the distance."""
    last = F.lag(pos).over(_over([*block, symbol], [pos]))
    return df.withColumn("distance", F.coalesce(F.col(pos) - last, F.lit(0)).cast("long")).withColumn("bucket", bit_width(F.col("distance")))


def runs(df: DataFrame, block: list[str], pos: str, symbol: str) -> DataFrame:
    """Runs of equal symbols of a block: first position and length."""
    w = _over(block, [pos])
    new = F.when(F.col(symbol).eqNullSafe(F.lag(symbol).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    rows = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*block, "_run").agg(F.min(pos).alias("start"), F.first(symbol).alias("symbol"), F.count("*").alias("length")).drop("_run")


def dominant(df: DataFrame, key: list[str], symbol: str) -> DataFrame:
    """For each key its most frequent symbol (ties: the smallest), its rows, and the rows that differ."""
    counts = df.groupBy(*key, symbol).agg(F.count("*").alias("_c"))
    best = F.min_by(F.struct(symbol, "_c"), F.struct((-F.col("_c")).alias("a"), F.col(symbol).alias("b")))
    return counts.groupBy(*key).agg(best.alias("_b"), F.sum("_c").alias("_n")).select(*key, F.col(f"_b.{symbol}").alias("dominant"), F.col("_b._c").alias("times"), (F.col("_n") - F.col("_b._c")).alias("exceptions"))


def palette(df: DataFrame, group: list[str], value: str, most: int, first: str | None = None) -> DataFrame:
    """The ``most`` most frequent values of each group with their rank from 0; ties: the smaller value, or the value whose
    first position is least if ``first`` names the position."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("times"), *([F.min(first).alias("_first")] if first else []))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("times"), "_first" if first else value)) - 1
    return counts.withColumn("rank", rank).where(F.col("rank") < most).select(*group, value, "times", "rank")


def dictionary(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The distinct values of each group, sorted, with their ids from 0 and counts."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("times"))
    return counts.withColumn("id", F.row_number().over(Window.partitionBy(*group).orderBy(value)) - 1)


def encoded(df: DataFrame, group: list[str], value: str, out: str = "id") -> DataFrame:
    """Each row's id in its group's dictionary."""
    ids = dictionary(df, group, value).select(*group, value, F.col("id").alias(out))
    return df.join(ids, [*group, value])


def partition_key(value: Column, level: int) -> Column:
    """The context that a coordinate falls into: 0 all, 1 sign and bit length, 2 also the value modulo 16, 3 the value."""
    sign = F.signum(value).cast("int")
    length = bit_width(F.abs(value))
    if level == 0:
        return F.struct(F.lit(0).alias("sign"), F.lit(0).alias("length"), F.lit(0).cast("long").alias("low"))
    low = {1: F.lit(0).cast("long"), 2: F.pmod(value, F.lit(16)).cast("long"), 3: value.cast("long")}[level]
    return F.struct(sign.alias("sign"), length.alias("length"), low.alias("low"))


def partitions(df: DataFrame, block: list[str], pos: str, value: str, level: int) -> DataFrame:
    """For each block and context of ``partition_key``: how many positions, the first and the last."""
    keyed = df.withColumn("_k", partition_key(F.col(value), level))
    return keyed.groupBy(*block, "_k.sign", "_k.length", "_k.low").agg(F.count("*").alias("n"), F.min(pos).alias("first"), F.max(pos).alias("last"))


def round_robin(df: DataFrame, family: str, order: str, span: int = 65_536) -> DataFrame:
    """Rows interleaved by family: all families' first rows, then the second ones; families by their first row's order (a
    number). Rows are numbered within spans of the order, and a span's first number comes from the spans' counts, so that a
    family with a third of all rows is not sorted in one task."""
    rows = df.withColumn("_span", F.floor(F.col(order) / span))
    counts = rows.groupBy(family, "_span").agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(family).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(family, "_span", before.alias("_start"), F.min("_first").over(Window.partitionBy(family)).alias("family_first"))
    mine = F.row_number().over(Window.partitionBy(family, "_span").orderBy(order)) - 1
    return rows.withColumn("_mine", mine).join(starts, [family, "_span"]).withColumn("turn", (F.col("_mine") + F.col("_start")).cast("int")).select(*df.columns, "turn", "family_first")


def packing_costs(df: DataFrame, key: list[str], pos: list[str], value: str) -> DataFrame:
    """For each series, an array ``costs`` of (bits, place, kind): frame of reference, differences, second differences and
    patched frames at each width. One shuffle and one sort: all widths come from the same windows and a histogram of widths."""
    w = _over(key, pos)
    rows = df.withColumn("_f", F.col(value) - F.lag(value).over(w)).withColumn("_s", F.col("_f") - F.lag("_f").over(w))
    rows = rows.withColumn("_w", bit_width(F.col(value) - F.min(value).over(Window.partitionBy(*key))))
    wide = lambda c: F.coalesce(F.max(bit_width(zigzag(F.col(c)))), F.lit(0))
    hist = rows.groupBy(*key, "_w").agg(F.count("*").alias("_c"), wide("_f").alias("_a"), F.count("_f").alias("_na"), wide("_s").alias("_b"), F.count("_s").alias("_nb"))
    hist = hist.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*key).orderBy("_w").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*key)))
    pick = lambda q: F.min(F.when(F.col("_upto") > F.least(F.floor(F.col("_n") * q), F.col("_n") - 1), F.col("_w")))
    most = F.max("_w")
    one = hist.groupBy(*key, "_n").agg(most.alias("_most"), F.max("_a").alias("_a"), F.sum("_na").alias("_na"), F.max("_b").alias("_b"), F.sum("_nb").alias("_nb"), F.array_distinct(F.array(F.lit(0), pick(0.90), pick(0.95), pick(0.99), most)).alias("_ws"), F.collect_list(F.struct("_w", "_c")).alias("_h"))  # at most 64 widths
    cost = lambda bits, place, kind: F.struct(bits.cast("long").alias("bits"), place.cast("int").alias("place"), kind.alias("kind"))
    over = lambda width: F.aggregate(F.filter("_h", lambda x: x["_w"] > width), F.lit(0).cast("long"), lambda a, x: a + x["_c"])
    patched = F.transform("_ws", lambda x: cost(F.col("_n") * x + over(x) * (32 + F.col("_most") - x), x + 3, F.concat(F.lit("pfor"), x.cast("string"))))
    plain = F.array(cost(F.col("_most") * F.col("_n"), F.lit(0), F.lit("for")), cost(F.col("_a") * F.col("_na"), F.lit(1), F.lit("delta")), cost(F.col("_b") * F.col("_nb"), F.lit(2), F.lit("delta2")))
    return one.select(*key, F.concat(plain, patched).alias("costs"))


def lifted(df: DataFrame, key: list[str], pos: str, value: str, predictor: int = 1) -> DataFrame:
    """Lifting along ``pos`` (whole numbers from 0): even rows are the low band; an odd row becomes the zigzag of its value
    less a prediction from its neighbours in the low band: the left one (0), or the floor of the mean of both (1; at the
    edge the left one alone)."""
    w = _over(key, [pos])
    left, right = F.lag(value).over(w), F.lead(value).over(w)
    guess = left if predictor == 0 else F.floor((left + F.coalesce(right, left)) / 2)
    odd = F.col(pos) % 2 == 1
    return df.withColumn("band", odd.cast("int")).withColumn("index", F.floor(F.col(pos) / 2).cast("long")).withColumn("coefficient", F.when(odd, zigzag(F.col(value) - guess)).otherwise(F.col(value)).cast("long"))


def axis_delta(df: DataFrame, others: list[str], axis: str, value: str, out: str = "residual") -> DataFrame:
    """Zigzag difference to the neighbour before along one axis of a grid."""
    return df.withColumn(out, zigzag(F.col(value) - F.coalesce(F.lag(value).over(_over(others, [axis])), F.lit(0))))


def predicted(df: DataFrame, block: str, pos: str, key: str, value: str, modes: tuple[int, ...] = (0, 1, 2, 3, 4), bits: int = 32) -> DataFrame:
    """(block, pos, mode, residual): values less what the rows before in the block let expect; the modes of
    ``kernels.predicted``. Each guess depends on running modes, so a block is one ordered pass: cut streams into blocks."""
    import pyarrow as pa

    from ..functions.kernels import predicted as residuals

    def rows(table: pa.Table) -> pa.Table:
        table = table.sort_by(pos)
        q, v = (table.column(c).to_pylist() for c in (key, value))
        parts = [pa.table({block: table.column(block), pos: table.column(pos), "mode": pa.array([m] * len(q), pa.int32()), "residual": pa.array(residuals(q, v, m, bits), pa.int64())}) for m in modes]
        return pa.concat_tables(parts)

    return df.select(block, pos, key, value).groupBy(block).applyInArrow(rows, f"{block} long, {pos} long, mode int, residual long")


def history(df: DataFrame, key: list[str], pos: list[str], value: str, last: int) -> DataFrame:
    """Each row with the number, least and greatest of the ``last`` values before it (none: 0 and nulls)."""
    w = _over(key, pos).rowsBetween(-last, -1)
    return df.withColumn("held", F.count(value).over(w)).withColumn("least", F.min(value).over(w)).withColumn("most", F.max(value).over(w))


def usage(df: DataFrame, key: list[str], pos: list[str], change: str) -> DataFrame:
    """For each key: what is reserved after all changes, and the greatest amount that ever was."""
    held = df.withColumn("_held", F.sum(change).over(_over(key, pos).rowsBetween(Window.unboundedPreceding, 0)))
    return held.groupBy(*key).agg(F.sum(change).alias("reserved"), F.greatest(F.max("_held"), F.lit(0)).alias("peak"))


def arrangements(df: DataFrame, key: list[str], symbol: str) -> DataFrame:
    """For each key, the number of arrangements of its symbols: n! over the product of the counts' factorials (n up to 20)."""
    counts = df.groupBy(*key, symbol).agg(F.count("*").cast("int").alias("_c"))
    n = F.sum("_c").cast("int")
    divisor = F.aggregate(F.collect_list("_c"), F.lit(1).cast("long"), lambda a, c: a * F.factorial(c))  # at most 20 counts
    return counts.groupBy(*key).agg(n.alias("n"), divisor.alias("_d")).select(*key, "n", F.expr("factorial(n) div _d").alias("arrangements"))


def subset_rank(df: DataFrame, key: list[str], place: str) -> DataFrame:
    """For each key, the colexicographic rank of its set of places (from 0, below 21): the sum of C(place, number), numbers
    from 1 by rising place."""
    numbered = df.withColumn("_i", F.row_number().over(_over(key, [place])))
    fits = F.col(place) >= F.col("_i")
    choose = F.when(fits, F.expr(f"factorial(cast({place} as int)) div (factorial(_i) * factorial(cast({place} as int) - _i))")).otherwise(0)
    return numbered.withColumn("_c", choose).groupBy(*key).agg(F.count("*").alias("places"), F.sum("_c").cast("long").alias("rank"))


def mixed_radix(df: DataFrame, key: list[str], pos: list[str], digit: str, alphabet: str) -> DataFrame:
    """For each key, its digits as one number: each stands for the product of the alphabets before it (below 2^62)."""
    w = _over(key, pos).rowsBetween(Window.unboundedPreceding, -1)
    weight = F.round(F.exp(F.coalesce(F.sum(F.log(alphabet)).over(w), F.lit(0.0)))).cast("long")
    return df.withColumn("_w", weight).groupBy(*key).agg(F.count("*").alias("digits"), F.sum(F.col(digit) * F.col("_w")).cast("long").alias("number"))


def remaining_cost(df: DataFrame, key: list[str], pos: list[str], symbol: str) -> DataFrame:
    """For each key, the bits of coding its symbols one after another by the counts that remain of each."""
    left = F.count("*").over(Window.partitionBy(*key)) - F.row_number().over(_over(key, pos)) + 1
    own = F.count("*").over(Window.partitionBy(*key, symbol)) - F.row_number().over(_over([*key, symbol], pos)) + 1
    return df.withColumn("_a", left).withColumn("_b", own).groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.log2(F.col("_a") / F.col("_b"))).alias("bits"))
