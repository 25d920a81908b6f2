"""Embedding near-duplicates: sorted projection passes, then exact links within each component.

A pass orders the vectors lexicographically by the signs of random projections, taken from the centre of a sample, and
compares each with a bounded window of neighbours; verified pairs of all passes are united. How many passes that takes is
measured, not assumed: ghosts, planted at the threshold from a sample of the vectors, go through every pass, and passes are
added until RECALL of them are joined with the vector that they come from. Then every component is finished exactly, whatever
its size: members so close to its representative that the triangle inequality links them all are counted, not compared;
every other member is compared with the whole component, in blocks. So a group of near copies that is larger than any window
loses no link.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .util import checkpointed, dropped, local_union, tasks, written

#: Vectors in a window block (a vector meets its own block and the one before), projections of a pass, vectors in a block of a component.
WINDOW, BITS, BLOCK = 1024, 62, 512
RECALL = 0.97
#: Sampled vectors that have a ghost (their mean is the centre), passes in one round, and rounds of as many passes as the
#: first one at most: where ghosts stay unfound for longer, the share found is what there is.
GHOSTS, AT_ONCE, ROUNDS = 512, 16, 12


def passes(n: int, least: float) -> int:
    """How many passes give two vectors of cosine ``least`` a common window with probability RECALL if each sign halves the
    vectors: a window spans those that agree in the first log2(n / WINDOW) signs."""
    agree = (1 - math.acos(least) / math.pi) ** max(0.0, math.log2(max(n, 1) / WINDOW))
    return max(3, math.ceil(math.log(1 - RECALL) / math.log(1 - min(agree, 0.99))))


def _unit(table: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    """Unit vectors (double) of rows of one dimension."""
    arrays = table.column(column)
    arrays = arrays.combine_chunks() if isinstance(arrays, pa.ChunkedArray) else arrays
    x = np.asarray(arrays.flatten()).astype(np.float64).reshape(len(arrays), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sound(column: str):
    """Neither null, empty nor zero, and all components finite numbers."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _planted(classes: DataFrame, least: float, seed: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Ghosts (node, dim, vector) of GHOSTS sampled vectors, at cosine ``least`` from them in a random direction and named as
    they are; and the sample's mean for each dimension."""
    table = classes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(GHOSTS).select("node", "dim", "vector").toArrow()
    dims = np.asarray(table.column("dim"))
    rng = np.random.default_rng(seed)
    cos = min(1.0, least + 1e-4)  # the ghost's own rounding must not part the two
    schema = pa.schema([("node", pa.int64()), ("dim", pa.int32()), ("vector", pa.list_(pa.float64()))])
    ghosts, centres = [schema.empty_table()], {}
    for dim in np.unique(dims):
        part = table.filter(pa.array(dims == dim))
        x = _unit(part, "vector")
        centres[int(dim)] = x.mean(axis=0)
        u = rng.standard_normal(x.shape)
        u -= (u * x).sum(axis=1, keepdims=True) * x
        y = cos * x + math.sqrt(1 - cos * cos) * u / np.maximum(np.sqrt((u * u).sum(axis=1, keepdims=True)), 1e-300)
        vector = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dim, pa.int32()), pa.array(y.ravel()))
        ghosts.append(pa.Table.from_arrays([part.column("node").cast(pa.int64()), part.column("dim").cast(pa.int32()), vector], schema=schema))
    return classes.sparkSession.createDataFrame(pa.concat_tables(ghosts)), centres


def _ordered(classes: DataFrame, rounds: range, centres: dict[int, np.ndarray], seed: int) -> DataFrame:
    """(node, ghost, places): in each pass, the block of WINDOW vectors that the node's rank lies in; ghosts take no rank."""

    def coded(batches):
        for b in batches:
            dims = np.asarray(b.column("dim"))
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                x = _unit(part, "vector") - centres.get(int(dim), 0.0)
                for k in rounds:
                    planes = np.random.default_rng((seed, k, int(dim))).standard_normal((int(dim), BITS))
                    code = ((x @ planes > 0) << np.arange(BITS)[::-1]).sum(axis=1)
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), part.column("dim"), pa.array(code.astype(np.int64)), part.column("node"), part.column("ghost")], ["round", "dim", "code", "node", "ghost"])

    def numbered(batches):
        at: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for b in batches:
            rounds_, real = np.asarray(b.column("round")), ~b.column("ghost").to_numpy(zero_copy_only=False)
            place = np.zeros(len(b), np.int64)
            for k in np.unique(rounds_).tolist():
                mine = rounds_ == k
                place[mine] = at.get(k, 0) + np.cumsum(real[mine]) - real[mine]
                at[k] = at.get(k, 0) + int(real[mine].sum())
            yield pa.RecordBatch.from_arrays([b.column("round"), b.column("node"), b.column("ghost"), pa.array(np.full(len(b), part, np.int32)), pa.array(place)], ["round", "node", "ghost", "part", "place"])

    order = ["round", "dim", "code", "node", "ghost"]
    codes, codes_at = written(classes.mapInArrow(coded, "round int, dim int, code long, node long, ghost boolean"), "codes")
    ranks, _ = written(codes.repartitionByRange(tasks(classes.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(numbered, "round int, node long, ghost boolean, part int, place long"), "ranks")
    dropped(classes.sparkSession, codes_at)
    before: dict[int, int] = {}
    starts = []
    for r in sorted(ranks.groupBy("round", "part").agg(F.sum((~F.col("ghost")).cast("long")).alias("n")).collect()):  # a row for each partition and pass
        starts.append((r["round"], r.part, before.get(r["round"], 0)))
        before[r["round"]] = before.get(r["round"], 0) + r.n
    start = classes.sparkSession.createDataFrame(starts, "round int, part int, start long")
    block = ((F.col("start") + F.col("place")) / WINDOW).cast("long")
    return ranks.join(F.broadcast(start), ["round", "part"]).groupBy("node", "ghost").agg(F.collect_list(F.struct("round", block.alias("block"))).alias("places"))


def _verified(classes: DataFrame, rounds: range, centres: dict[int, np.ndarray], least: float, seed: int) -> DataFrame:
    """(a, b, ghost): a spanning forest of the verified pairs of each window; where ``ghost``, the ghost of b links with a."""
    placed = classes.join(_ordered(classes, rounds, centres, seed), ["node", "ghost"])
    both = F.flatten(F.transform("places", lambda p: F.array(F.struct(p["round"].alias("round"), p["block"].alias("block"), F.lit(0).alias("role")), F.struct(p["round"].alias("round"), (p["block"] + 1).alias("block"), F.lit(1).alias("role")))))
    rows = placed.select("node", "ghost", "dim", "vector", F.explode(both).alias("p")).select("p.round", "p.block", "p.role", "node", "ghost", "dim", "vector")

    def forest(table: pa.Table) -> pa.Table:
        node, role, dims = (np.asarray(table.column(c)) for c in ("node", "role", "dim"))
        ghost = table.column("ghost").to_numpy().astype(bool)
        label = np.arange(len(node))
        met = [np.zeros((0, 2), np.int64)]
        for dim in np.unique(dims):
            mine = np.flatnonzero(dims == dim)
            x = _unit(table.take(pa.array(mine)), "vector")
            home = np.flatnonzero(role[mine] == 0)
            for k in range(0, len(home), 256):
                i, j = np.nonzero(x[home[k : k + 256]] @ x.T >= least)
                i, j = mine[home[k + i]], mine[j]
                real = ~ghost[i] & ~ghost[j]
                local_union(label, i[real], j[real])
                one = ghost[i] != ghost[j]
                met.append(np.stack([np.where(ghost[i], j, i)[one], np.where(ghost[i], i, j)[one]], axis=1))
        child = np.flatnonzero(label != np.arange(len(node)))
        seen = np.concatenate(met)
        seen = np.unique(np.stack([node[label[seen[:, 0]]], node[seen[:, 1]]], axis=1), axis=0)
        return pa.table({"a": np.concatenate([node[label[child]], seen[:, 0]]), "b": np.concatenate([node[child], seen[:, 1]]), "ghost": np.arange(len(child) + len(seen)) >= len(child)})

    return rows.groupBy("round", "block").applyInArrow(forest, "a long, b long, ghost boolean")


def _joined(found: DataFrame, root: DataFrame) -> int:
    """How many ghosts link with the component of the vector that they come from."""
    met = checkpointed(found.where("ghost").select("a", "b").distinct())  # a bounded sample's
    ends = met.select(F.col("a").alias("node")).union(met.select("b")).distinct()
    named = checkpointed(root.join(F.broadcast(ends), "node"))
    of = lambda c: named.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    same = F.coalesce("a_root", "a") == F.coalesce("b_root", "b")
    return met.join(of("a"), "a", "left").join(of("b"), "b", "left").where(same).select("b").distinct().count()


def found_components(classes: DataFrame, least: float, seed: int = 7) -> tuple[DataFrame, float]:
    """(node, root) of the vectors that chains of found pairs join, and the share of ghosts that were found, which is the
    measured chance that a pair at the threshold is; ``classes`` has node, dim, vector."""
    kind = "array<float>" if classes.schema["vector"].dataType.simpleString() == "array<float>" else "array<double>"
    found, done = None, 0
    ghosts, centres = _planted(classes, least, seed)
    planted = max(ghosts.count(), 1)
    every = classes.withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True))).withColumn("vector", F.col("vector").cast(kind))
    first = need = passes(classes.count(), least)
    while True:
        while need > 0:
            at_once = min(need, AT_ONCE)
            links, _ = written(_verified(every, range(done, done + at_once), centres, least, seed), "links")
            found = links if found is None else found.union(links)
            done, need = done + at_once, need - at_once
        root = checkpointed(components(found.where("not ghost").select("a", "b")))
        share = _joined(found, root) / planted
        if share >= RECALL or done >= ROUNDS * first:
            return root, share
        each = 1 - (1 - max(share, 1 / planted)) ** (1 / done)  # the chance of one pass
        need = min(max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - min(each, 0.99))) - done), 2 * done, ROUNDS * first - done)


def _finished(members: DataFrame, least: float) -> DataFrame:
    """(node, linked): for ``members`` (root, node, m, dim, vector), the other rows that each class's rows link with."""
    near = math.cos(math.acos(least) / 2) + 1e-9
    centre = members.where("root = node").select("root", F.col("vector").alias("centre"))

    def close(batches):
        for b in batches:
            if len(b):
                dims = np.asarray(b.column("dim"))
                cos = np.zeros(len(b))
                for dim in np.unique(dims):
                    mine = np.flatnonzero(dims == dim)
                    part = b.take(pa.array(mine))
                    cos[mine] = (_unit(part, "vector") * _unit(part, "centre")).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("root", "node", "m", "dim", "vector")), pa.array(cos >= near)], ["root", "node", "m", "dim", "vector", "core"])

    fields = [f for f in members.schema.fields if f.name == "vector"][0].dataType.simpleString()
    rows, _ = written(members.join(centre, "root").select("root", "node", "m", "dim", "vector", "centre").mapInArrow(close, f"root long, node long, m long, dim int, vector {fields}, core boolean"), "members")
    size = rows.groupBy("root").agg(F.sum(F.when(F.col("core"), F.col("m")).otherwise(0)).alias("core_m"), F.sum(F.when(F.col("core"), 0).otherwise(1)).alias("loose"), F.count("*").alias("n"))
    size = checkpointed(size)
    plain = rows.join(size, "root").select("node", F.when(F.col("core"), F.col("core_m") - 1).otherwise(F.col("m") - 1).alias("linked"))
    blocks = size.where("loose > 0").select("root", F.ceil(F.col("loose") / BLOCK).cast("int").alias("qs"), F.ceil(F.col("n") / BLOCK).cast("int").alias("ts"))
    sized = rows.join(blocks, "root")
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asks = sized.where("not core").withColumn("q", mine("qs")).withColumn("t", F.explode(every("ts"))).withColumn("role", F.lit(0))
    told = sized.withColumn("q", F.explode(every("qs"))).withColumn("t", mine("ts")).withColumn("role", F.lit(1))

    def count(table: pa.Table) -> pa.Table:
        node, m, role, core = (np.asarray(table.column(c)) for c in ("node", "m", "role", "core"))
        x = _unit(table, "vector")
        q, t = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        linked = np.zeros(len(node), np.int64)
        for k in range(0, len(q), 256):
            part = q[k : k + 256]
            hit = (x[part] @ x[t].T >= least) & (node[part][:, None] != node[t])
            linked[part] += hit @ m[t]
            linked[t[core[t]]] += m[part] @ hit[:, core[t]]
        some = linked > 0
        return pa.table({"node": node[some], "linked": linked[some]})

    columns = ("root", "q", "t", "role", "node", "m", "core", "vector")
    dealt = asks.select(*columns).union(told.select(*columns)).repartition(tasks(members.sparkSession), "root", "q", "t")  # a component's blocks to tasks of their own
    more = dealt.groupBy("root", "q", "t").applyInArrow(count, "node long, linked long")
    return plain.union(more).groupBy("node").agg(F.sum("linked").cast("long").alias("linked"))


def linked(vectors: DataFrame, least: float = 0.9, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding; more columns are ignored).

    Equal vectors are one class, named by its smallest vec_id. A row whose vec_id is null, or whose vector is null, empty,
    zero or has null or non-finite components links with nothing; vectors of different dimensions never link. Rows that
    share a vec_id are one node. Empty input: no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), (sound("embedding") & F.col("vec_id").isNotNull()).alias("sound"))
    classes, _ = written(rows.where("sound").groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("m")).withColumn("dim", F.size("vector")), "classes")
    root, _ = found_components(classes.select("node", "dim", "vector"), least, seed)
    members = classes.join(root, "node")
    links = _finished(members.select("root", "node", "m", "dim", "vector"), least)
    known = classes.join(root, "node", "left").join(links, "node", "left").select("vector", F.coalesce("linked", F.col("m") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    good = rows.where("sound").join(known, "vector").select("vec_id", "n_links", "component_id")
    bad = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
