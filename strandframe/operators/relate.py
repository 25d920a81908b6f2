"""Joins: symbol indexes and option lists, range resolution, overlaps, parents, block references, policies, spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A table is broadcast only if a count finds at most so many rows.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is small; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def symbol_index(symbols: DataFrame, name: str, value: str) -> DataFrame:
    """(name, value, times) over all objects, zero values left out."""
    return symbols.where(F.col(value) != 0).groupBy(name, value).agg(F.count("*").alias("times"))


def option_lists(slots: DataFrame, slot: list[str], name: str, own: str, index: DataFrame, value: str) -> DataFrame:
    """A slot's options: its own value, then the index's other values of its name, most frequent first (ties: smaller)."""
    # options are ranked once for each name, not once for each slot
    ranked = index.groupBy(name).agg(F.array_sort(F.collect_list(F.struct((-F.col("times")).alias("r"), F.col(value).alias("v")))).alias("_o"))
    rows = slots.join(small(ranked), name, "left")
    others = F.filter(F.transform(F.coalesce("_o", F.array().cast("array<struct<r:bigint,v:bigint>>")), lambda x: x["v"]), lambda v: v != F.col(own))
    return rows.select(*slot, name, own, F.concat(F.array(F.col(own).cast("long")), others).alias("options"))


def option_position(options: Column, value: Column) -> Column:
    """Where a value stands in an option list, from 0; none: null (it is written out)."""
    at = F.array_position(options, value)
    return F.when(at > 0, at - 1)


def range_resolved(points: DataFrame, point: list[str], at: str, ranges: DataFrame, name: str, lo: str, hi: str, width: int) -> DataFrame:
    """Points joined with the one range [lo, hi] that holds them; points in none or in several are dropped.

    Ranges are cut at multiples of ``width`` and joined by that bin, so the join is an equi-join of bounded fan-out: a range
    of n bins becomes n rows.
    """
    bins = ranges.select(F.col(name), F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))).alias("_bin"))
    hit = points.withColumn("_bin", F.floor(F.col(at) / width)).join(bins, "_bin").where((F.col(at) >= F.col("_lo")) & (F.col(at) <= F.col("_hi")))
    one = hit.groupBy(*point, at).agg(F.count("*").alias("_n"), F.min(name).alias(name), F.min("_lo").alias("_lo"))
    return one.where("_n = 1").select(*point, at, name, (F.col(at) - F.col("_lo")).alias("offset"))


def without_overlaps(df: DataFrame, key: list[str], start: str, length: str) -> DataFrame:
    """Spans of a key without both members of each neighbouring pair that overlaps."""
    w = Window.partitionBy(*key).orderBy(start, length)
    after, before = F.lead(start).over(w), F.lag(F.col(start) + F.col(length)).over(w)
    hit = F.coalesce(after < F.col(start) + F.col(length), F.lit(False)) | F.coalesce(before > F.col(start), F.lit(False))
    return df.withColumn("_hit", hit).where("not _hit").drop("_hit")


def parents(bonds: DataFrame, key: list[str], order: str, a: str, b: str) -> DataFrame:
    """For each node b the partner a < b of its last bond."""
    return bonds.where(F.col(a) < F.col(b)).groupBy(*key, F.col(b).alias("node")).agg(F.max_by(a, order).alias("parent"))


def parent_residual(nodes: DataFrame, key: list[str], node: str, value: str, parent: DataFrame | None = None) -> DataFrame:
    """Value less the parent's value; the parent is the node before unless ``parent`` names one; no parent: the value."""
    if parent is None:
        rows = nodes.withColumn("parent", F.when(F.col(node) > 0, F.col(node) - 1))
    else:
        rows = nodes.join(parent.withColumnRenamed("node", node), [*key, node], "left").withColumn("parent", F.coalesce("parent", F.when(F.col(node) > 0, F.col(node) - 1)))
    up = nodes.select(*key, F.col(node).alias("parent"), F.col(value).alias("_up"))
    return rows.join(up, [*key, "parent"], "left").withColumn("residual", F.col(value) - F.coalesce("_up", F.lit(0))).drop("_up")


def block_reference(df: DataFrame, number: str, digest: str, span: int = 65_536) -> DataFrame:
    """For each block the newest earlier block of the same content (null: none).

    Numbers are cut into spans: within one the block before is a lag, and its first block of a content takes the last one
    of the spans before, from a table of a row for each content and span. So a content that a third of all blocks have is
    sorted by span, not in one task.
    """
    rows = df.withColumn("_span", F.floor(F.col(number) / span))
    lasts = rows.groupBy(digest, "_span").agg(F.max(number).alias("_last"))
    before = lasts.withColumn("_before", F.lag("_last").over(Window.partitionBy(digest).orderBy("_span"))).where("_before is not null").drop("_last")
    own = F.lag(number).over(Window.partitionBy(digest, "_span").orderBy(number))
    return rows.withColumn("_own", own).join(before, [digest, "_span"], "left").withColumn("reference", F.coalesce("_own", "_before")).select(*df.columns, "reference")


def selector_matches(selector: Column, value: Column) -> Column:
    """Null or ``*`` match anything, ``prefix:*`` what starts with ``prefix:``, others what is equal."""
    star = F.endswith(selector, F.lit(":*"))
    return selector.isNull() | (selector == "*") | (star & F.startswith(value, F.substring(selector, F.lit(1), F.length(selector) - 1))) | (selector == value)


def policy_decision(requests: DataFrame, bindings: DataFrame, rules: DataFrame, request: list[str], selectors: dict[str, str]) -> DataFrame:
    """Allowed or not, and the least cap, of each request (its columns ``request`` and an identity).

    bindings: identity, role; rules: role, effect (allow, deny), cap and a selector for each request column that
    ``selectors`` names. One matching deny rejects; without any matching allow the answer is no.
    """
    mine = requests.join(bindings, "identity").join(small(rules), "role")
    hit = reduce(lambda x, y: x & y, (selector_matches(F.col(s), F.col(c)) for c, s in selectors.items()))
    found = mine.where(hit).groupBy(*request).agg(F.max((F.col("effect") == "deny").cast("int")).alias("_deny"), F.max((F.col("effect") == "allow").cast("int")).alias("_allow"), F.min(F.when(F.col("effect") == "allow", F.col("cap"))).alias("_cap"))
    allowed = (F.coalesce("_allow", F.lit(0)) == 1) & (F.coalesce("_deny", F.lit(0)) == 0)
    return requests.join(found, request, "left").select(*requests.columns, allowed.alias("allowed"), F.when(allowed, F.col("_cap")).alias("cap"))


def merged_spans(spans: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """Touching spans (the end of one is the start of the next) as one."""
    w = Window.partitionBy(*key).orderBy(start)
    new = F.when(F.lag(end).over(w) == F.col(start), 0).otherwise(1)
    rows = spans.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*key, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def partitioned(spans: DataFrame, key: str, start: str, end: str, kind: str, sizes: DataFrame, size: str, cut: int = 65_536) -> DataFrame:
    """A complete partition of each blob: its spans, and the gaps between them (generic) cut into pieces of ``cut``.

    ``spans`` don't overlap; ``sizes`` has every blob and its size.
    """
    w = Window.partitionBy(key).orderBy("start")
    known = spans.select(key, F.col(start).alias("start"), F.col(end).alias("end"), F.col(kind).alias("kind"))
    edges = known.withColumn("_from", F.coalesce(F.lag("end").over(w), F.lit(0)))
    gaps = edges.select(key, F.col("_from").alias("a"), F.col("start").alias("b"))
    tails = sizes.join(known.groupBy(key).agg(F.max("end").alias("_e")), key, "left").select(key, F.coalesce("_e", F.lit(0)).alias("a"), F.col(size).alias("b"))
    pieces = gaps.unionByName(tails).where("b > a").select(key, "a", "b", F.explode(F.sequence(F.lit(0), F.floor((F.col("b") - F.col("a") - 1) / cut))).alias("_k"))
    generic = pieces.select(key, (F.col("a") + F.col("_k") * cut).alias("start"), F.least("b", F.col("a") + (F.col("_k") + 1) * cut).alias("end"), F.lit("generic").alias("kind"))
    return known.unionByName(generic)


def greedy_spans(spans: DataFrame, key: str, most: int = 256) -> DataFrame:
    """Spans in the order start, longest first, kind; each is taken if it starts no earlier than the last one taken ends;
    at most ``most`` of a key. What is taken depends on what was: one ordered pass for each key."""

    def chosen(pdf):
        pdf = pdf.assign(_n=pdf["start"] - pdf["end"]).sort_values(["start", "_n", "kind"])
        keep, last, taken = [], 0, 0
        for start, end in zip(pdf["start"], pdf["end"], strict=True):
            take = start >= last and taken < most
            keep.append(take)
            last, taken = (end, taken + 1) if take else (last, taken)
        return pdf[keep].drop(columns="_n")

    return spans.groupBy(key).applyInPandas(chosen, spans.schema)


def string_names(symbols: DataFrame, key: list[str], offset: str, tables: DataFrame, text: str, end: str) -> DataFrame:
    """Symbols with ``name``: what stands at their offset in their object's string table, up to the ``end`` mark."""
    rows = symbols.join(tables.select(*key, F.col(text).alias("_table")), key)
    return rows.withColumn("name", F.substring_index(F.substring(F.col("_table"), F.col(offset) + 1, F.length("_table")), end, 1)).drop("_table")


def all_sections(sections: DataFrame, key: list[str], name: str, value: str, needed: list[str]) -> DataFrame:
    """Objects that have all ``needed`` sections, with the least value of each as a column: one aggregation, no joins."""
    found = sections.groupBy(*key).agg(*(F.min(F.when(F.col(name) == n, F.col(value))).alias(f"s{k}") for k, n in enumerate(needed)))
    return found.where(reduce(lambda a, b: a & b, (F.col(f"s{k}").isNotNull() for k in range(len(needed)))))


def pointer_digit(pointers: DataFrame, value: str, pool: DataFrame, base: Column, step: int) -> DataFrame:
    """Pointers with ``digit``: the place of their value in a pool of values (place, value), else its distance from ``base``
    in steps after the pool; values off the grid have none."""
    size = pool.agg(F.count("*").alias("_n"))
    places = pool.select(F.col("value").alias(value), F.col("place").alias("_place"))
    far = F.col(value) - base
    rows = pointers.join(small(places), value, "left").join(F.broadcast(size))  # one row
    return rows.withColumn("digit", F.coalesce("_place", F.when((far >= 0) & (far % step == 0), F.col("_n") + F.floor(far / step)))).drop("_place", "_n")


def dictionary_status(frames: DataFrame, number: str, digest: str, dictionaries: DataFrame) -> DataFrame:
    """Frames with ``status`` by the dictionaries (number, digest) they name: none (null number), unknown, mismatch or ok."""
    known = dictionaries.select(F.col("number").alias(number), F.col("digest").alias("_digest"))
    status = F.when(F.col(number).isNull(), "none").when(F.col("_digest").isNull(), "unknown").when(F.col("_digest") != F.col(digest), "mismatch").otherwise("ok")
    return frames.join(small(known), number, "left").withColumn("status", status).drop("_digest")


def eligible(objects: DataFrame, key: list[str], facts: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Objects with a flag for each condition: whether one of their facts fulfils it. One aggregation for all conditions."""
    found = facts.groupBy(*key).agg(*(F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in conditions.items()))
    return objects.join(found, key, "left").select(*objects.columns, *((F.coalesce(n, F.lit(0)) == 1).alias(n) for n in conditions))


def recent_reference(df: DataFrame, number: str, digest: str, most: int) -> DataFrame:
    """Each block with the distance to the newest earlier block of the same content, if it is at most ``most`` blocks back."""
    distance = F.col(number) - F.lag(number).over(Window.partitionBy(digest).orderBy(number))
    return df.withColumn("distance", F.when(distance <= most, distance))


def name_hash(name: Column) -> Column:
    """The System V hash of a name of ASCII characters."""

    def step(h: Column, c: Column) -> Column:
        shifted = (F.shiftleft(h, 4) + F.ascii(c).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF))
        high = shifted.bitwiseAND(F.lit(0xF0000000))
        return shifted.bitwiseXOR(F.shiftright(high, 24)).bitwiseAND(F.bitwise_not(high))

    return F.aggregate(F.filter(F.split(name, ""), lambda c: c != ""), F.lit(0).cast("long"), step)


def proposals(detectors: list[DataFrame], key: str) -> DataFrame:
    """Spans (key, start, end, kind) that detectors propose, each once, with their rank in each blob: by start, the longest
    first, then by kind."""
    rows = reduce(DataFrame.unionByName, detectors).distinct()
    order = Window.partitionBy(key).orderBy("start", F.desc("end"), "kind")
    return rows.withColumn("rank", F.row_number().over(order) - 1)
