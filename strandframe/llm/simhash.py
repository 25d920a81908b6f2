"""SimHash near-duplicates: exact pairs of close fingerprints through vantage-point trees, then connected components."""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .util import BROADCAST_ROWS, checkpointed, dropped, joined_hot, joined_small, local_union, slices, written

TEXT_BYTES = 4 << 20
#: Fingerprints that the top of the tree is grown from, and that a leaf of it should hold; fingerprints in one block of a task.
SAMPLE, LEAF, BLOCK = 1 << 16, 1 << 13, 1 << 13
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)  # of each byte value, lowest first


def shingle_hashes(text: str | None, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of all word shingles, repeats included (ASCII case folded, ASCII white space between words); a text of fewer
    words is one shingle, one without words has none."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII rules
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    size = np.fromiter(map(len, found), np.int64, len(found))
    begin = np.cumsum(size + 1) - size - 1
    end = (begin + size)[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[i:j], seed) for i, j in zip(begin.tolist(), end, strict=False)), np.uint64, len(end))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; of none: 0."""
    set_bits = np.concatenate([np.bincount(b, minlength=256) @ _BITS for b in h.astype("<u8").view(np.uint8).reshape(-1, 8).T])
    return sum(1 << int(k) for k in np.flatnonzero(2 * set_bits > len(h)))


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64 majority bits of a text's shingles."""
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; null and empty texts have fingerprint 0."""

    def rows(batches):
        for b in slices(batches, "text", TEXT_BYTES):
            fp = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, fp long")


def grown(sample: np.ndarray, share: float) -> list | int:
    """A tree of [vantage point, radius, near, far] and leaf numbers over sampled fingerprints (uint64), cut at the median
    distance until a node holds at most ``share`` of them."""
    leaves = 0

    def grow(points: np.ndarray) -> list | int:
        nonlocal leaves
        if len(points) > max(share * len(sample), 16):
            far = np.bitwise_count(points ^ points[0])
            vantage = points[int(np.argmax(far))]  # a point at the edge spreads the distances
            d = np.bitwise_count(points ^ vantage)
            radius = int(np.median(d))
            if radius > 2 and (d > radius).any():
                return [int(vantage), radius, grow(points[d <= radius]), grow(points[d > radius])]
        leaves += 1
        return leaves - 1

    return grow(sample)


def reached(tree: list | int, points: np.ndarray, rows: np.ndarray, within: int) -> list[tuple[int, np.ndarray]]:
    """(leaf, rows whose ball of radius ``within`` meets it), by the triangle bound; within 0: each row's own leaf."""
    if isinstance(tree, int):
        return [(tree, rows)] if len(rows) else []
    vantage, radius, near, far = tree
    d = np.bitwise_count(points[rows] ^ np.uint64(vantage)).astype(np.int64)
    return reached(near, points, rows[d <= radius + within], within) + reached(far, points, rows[d > radius - within], within)


def linked(points: np.ndarray, queries: np.ndarray, within: int, union) -> None:
    """Call union(positions in points, positions in queries) with all pairs at most ``within`` bits apart.

    A vantage-point tree of its own: halves at the median distance, balls that meet both sides go to both; small or
    undivided nodes are compared in blocks.
    """
    stack = [(np.arange(len(points)), np.arange(len(queries)))]
    while stack:
        p, q = stack.pop()
        if len(p) == 0 or len(q) == 0:
            continue
        if len(p) > 1024:
            d = np.bitwise_count(points[p] ^ points[p[0]])
            vantage = points[p[int(np.argmax(d))]]
            d = np.bitwise_count(points[p] ^ vantage).astype(np.int64)
            radius = int(np.median(d))
            if (d > radius).any() and radius > within:
                e = np.bitwise_count(queries[q] ^ vantage).astype(np.int64)
                stack += [(p[d <= radius], q[e <= radius + within]), (p[d > radius], q[e > radius - within])]
                continue
        for i in range(0, len(p), 1024):
            for j in range(0, len(q), 1024):
                a, b = p[i : i + 1024], q[j : j + 1024]
                x, y = np.nonzero(np.bitwise_count(points[a][:, None] ^ queries[b]) <= within)
                union(a[x], b[y])


def _tiled(asked: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``asked`` (keys, role 0 for points and 1 for queries, name) with blocks p and q: each point in its block of points
    once for every block of queries of its leaf, each query likewise."""
    # a row for each leaf of the tree, which the sample bounds
    size = asked.groupBy(*keys).agg(*(F.greatest(F.ceil(F.sum(F.when(F.col("role") == k, 1).otherwise(0)) / BLOCK).cast("int"), F.lit(1)).alias(n) for k, n in ((0, "ps"), (1, "qs"))))
    sized = asked.join(F.broadcast(size), keys)
    mine = lambda n: F.array(F.pmod(F.xxhash64(name), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = lambda n, role: F.explode(F.when(F.col("role") == role, mine(n)).otherwise(every(n)))
    return sized.withColumn("p", dealt("ps", 0)).withColumn("q", dealt("qs", 1))


def links(classes: DataFrame, within: int = 2) -> DataFrame:
    """(a, b): links among the distinct fingerprints ``fp`` that join exactly those that chains of pairs at most ``within``
    bits apart join.

    The top of a vantage-point tree comes from a bounded sample (it only shapes the shards: the result doesn't depend on
    it). Each fingerprint belongs to one leaf and asks every leaf that its ball meets. A leaf with many fingerprints is
    dealt out in blocks, every block of points against every block of queries, so that a task's memory is bounded. A task
    returns a spanning forest of its pairs, at most a row for each fingerprint that it has.
    """
    spark = classes.sparkSession
    total = classes.count()
    sample = np.array([r.fp for r in classes.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(grown(sample, LEAF / max(total, 1)) if len(sample) else 0)

    def ask(batches):
        for b in batches:
            if not len(b):
                continue
            fp = np.asarray(b.column("fp")).view(np.uint64)
            rows = np.arange(len(fp))
            found = [(leaf, role, at) for role, reach in ((0, 0), (1, within)) for leaf, at in reached(shared.value, fp, rows, reach)]
            size = [len(at) for _, _, at in found]
            column = lambda k: pa.array(np.repeat(np.array([f[k] for f in found], np.int32), size))
            yield pa.RecordBatch.from_arrays([column(0), column(1), pa.array(fp[np.concatenate([at for _, _, at in found])].view(np.int64))], ["leaf", "role", "fp"])

    asked, _ = written(classes.select("fp").mapInArrow(ask, "leaf int, role int, fp long"), "asked")
    tiles = _tiled(asked, ["leaf"], "fp")

    def forest(table: pa.Table) -> pa.Table:
        role, fp = np.asarray(table.column("role")), np.asarray(table.column("fp")).view(np.uint64)
        points, queries = fp[role == 0], fp[role == 1]
        nodes = np.concatenate([points, queries])
        names, at = np.unique(nodes, return_inverse=True)
        label = np.arange(len(names))
        linked(points, queries, within, lambda x, y: local_union(label, at[x], at[len(points) + y]))
        child = np.flatnonzero(label != np.arange(len(names)))
        return pa.table({"a": names[label[child]].view(np.int64), "b": names[child].view(np.int64)})

    return tiles.select("leaf", "p", "q", "role", "fp").groupBy("leaf", "p", "q").applyInArrow(forest, "a long, b long")


#: Texts of the sample that tells common shingles, how many of these are kept, postings of a bucket, and postings of a block of a
#: shingle that many texts have; shingles of more than FEW texts are tried against one text at a time, STARS times at most,
#: before all their pairs are.
TOLD, COMMON, BUCKET, POSTINGS, FEW, STARS = 1 << 14, 1 << 16, 200_000, 1 << 12, 64, 2


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(shingle_hashes(text, words))


def prefix(h: np.ndarray, similarity: float, keys: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a set in one order for all texts (by hash, those in sorted ``keys`` last by ``ranks``): so many
    that two sets of at least this Jaccard similarity have one of them in common."""
    rank = np.zeros(len(h), np.int64)
    if len(keys) and len(h):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        rank = np.where(keys[at] == h, ranks[at], 0)
    return h[np.lexsort((h, rank))][: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]


def parities(h: np.ndarray) -> bytes:
    """For each of 2^k classes of hashes (about one class a hash, 64 at least): whether the set has an odd number of them."""
    m = 1 << max(6, int(len(h) - 1).bit_length() if len(h) else 0)
    odd = (np.bincount((h & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def alike(n: int, a: bytes, m: int, b: bytes, similarity: float) -> bool:
    """Whether sets of n and m hashes with these parities can have this Jaccard similarity: each class whose parities differ
    has a hash that only one of them has."""
    if min(n, m) < similarity * max(n, m) - 1e-9:
        return False
    if len(a) < len(b):
        a, b = b, a
    x, size = int.from_bytes(a, "little"), 8 * len(a)
    while size > 8 * len(b):  # the classes of the shorter one: halves laid upon one another
        size //= 2
        x = (x >> size) ^ (x & ((1 << size) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count() <= (1 - similarity) / (1 + similarity) * (n + m) + 1e-9


def paired(table: pa.Table, similarity: float) -> pa.Table:
    """(a, b): pairs of each token's postings, but those whose ``root`` is one and those that can't be similar by their sizes
    or by what comes after the token (the shingles before it are taken as different)."""
    table = table.take(pa.array(np.argsort(np.asarray(table.column("token")), kind="stable")))
    token, root, node, size, place = (np.asarray(table.column(c)) for c in ("token", "root", "node", "size", "place"))
    left, found, step, held = np.arange(len(token)), [np.zeros((0, 2), np.int64)], 1, 0
    while len(left):
        left = left[left + step < len(token)]
        left = left[token[left] == token[left + step]]
        x = left[root[left] != root[left + step]]
        y = x + step
        fits = np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-9
        fits &= np.minimum(size[x] - place[x], size[y] - place[y]) >= similarity / (1 + similarity) * (size[x] + size[y]) - 1e-9
        found.append(np.sort(np.stack([node[x[fits]], node[y[fits]]], axis=1), axis=1))
        held += int(fits.sum())
        if held > 1 << 20:
            found = [np.unique(np.concatenate(found), axis=0)]
            held = 0
        step += 1
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, similarity: float) -> tuple[DataFrame, str]:
    """Those of the ``pairs`` (a, b) of doc_ids whose texts' shingle sets are similar, as a written table, and its path.

    ``sets`` (node, size, parities) leaves few pairs that are not; only the texts of those left are moved, and all of them
    decide on whole texts.
    """

    def likely(batches):
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("a_size", "a_parities", "b_size", "b_parities")]
            near = [alike(*row, similarity) for row in zip(*columns, strict=True)]
            yield b.filter(pa.array(near, pa.bool_())).select(["a", "b"])

    of = lambda k: sets.select(F.col("node").alias(k), F.col("size").alias(f"{k}_size"), F.col("parities").alias(f"{k}_parities"))
    pairs, tried = written(pairs, "pairs")
    n = pairs.count()
    if n == 0:
        return pairs, tried
    degree = lambda df: {k: df.groupBy(k).count() for k in "ab"}
    by = degree(pairs)
    left, path = written(joined_hot(joined_hot(pairs, of("b"), ["b"], "inner", total=n, counts=by["b"]), of("a"), ["a"], "inner", total=n, counts=by["a"]).mapInArrow(likely, "a long, b long"), "likely")
    n, by = left.count(), degree(left)
    asked = checkpointed(left.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    known = joined_small(docs, asked, ["doc_id"], "left_semi")

    def rows(batches):
        kept = lru_cache(64)(lambda text: shingle_set(text, words))
        for batch in batches:
            near = np.zeros(len(batch), bool)
            for k, (x, y) in enumerate(zip(batch.column("a_text"), batch.column("b_text"), strict=True)):
                x, y = kept(x.as_py()), kept(y.as_py())
                common = len(x) + len(y) - len(np.union1d(x, y))
                near[k] = common >= similarity * (len(x) + len(y) - common) - 1e-9
            yield batch.filter(pa.array(near)).select(["a", "b"])

    text = lambda k: known.select(F.col("doc_id").alias(k), F.col("text").alias(f"{k}_text"))
    both = joined_hot(joined_hot(left, text("b"), ["b"], "inner", total=n, counts=by["b"]), text("a"), ["a"], "inner", total=n, counts=by["a"])
    links = written(both.select("a", "b", "a_text", "b_text").mapInArrow(rows, "a long, b long"), "links")
    dropped(docs.sparkSession, tried, path)
    return links


def near_clusters(docs: DataFrame, words: int = 5, similarity: float = 0.8, block: int = POSTINGS) -> DataFrame:
    """(doc_id, component_id) of every document: groups of texts that chains of pairs join whose shingle sets have at least
    this Jaccard similarity, all of them.

    Fingerprints only tell whether two texts are close on average, so none decides here. In one order of all shingles two
    such sets have one in common among the first of each (``prefix``), so candidates share a shingle there. The order puts
    shingles that are common in a sample last, which only saves work. A shingle's texts are first compared with one of them;
    while they are of several components, with one of another; then, in blocks, all pairs of different components are. So a
    group of near copies makes links in proportion to its texts, and no pair is left out. Every candidate is decided on
    whole texts. Equal sets are one class. Null and empty texts have the empty set and are one class; rows with a null
    doc_id have a null component; rows that share a doc_id are one node; empty input: no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    every = max(1, texts.count() // TOLD)

    def told(batches):
        for b in slices(batches, "text", TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_set(t, words) for t in b.column("text").to_pylist()]).view(np.int64))], ["token"])

    common = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text").mapInArrow(told, "token long").groupBy("token").count()
    common = common.where("count >= 3").orderBy(F.desc("count"), "token").limit(COMMON).toArrow()
    keys = np.asarray(common.column("token")).view(np.uint64)
    order = np.argsort(keys)
    shared_order = spark.sparkContext.broadcast((keys[order], len(keys) - order))  # at most COMMON

    def rows(batches):
        for b in slices(batches, "text", TEXT_BYTES):
            sets = [shingle_set(t, words) for t in b.column("text").to_pylist()]
            digest = np.array([np.frombuffer(blake2b(h.tobytes(), digest_size=16).digest(), np.int64) for h in sets]).reshape(-1, 2)
            first = [prefix(h, similarity, *shared_order.value) if len(h) else h for h in sets]
            ends = np.concatenate([[0], np.cumsum([len(f) for f in first])]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(np.array([len(h) for h in sets], np.int64)), pa.array([parities(h) for h in sets], pa.binary()), tokens], ["doc_id", "d0", "d1", "size", "parities", "tokens"])

    prints, prints_at = written(texts.mapInArrow(rows, "doc_id long, d0 long, d1 long, size long, parities binary, tokens array<long>"), "prefixes")
    classes = checkpointed(prints.groupBy("d0", "d1").agg(F.min("doc_id").alias("node")))
    named, _ = written(joined_small(prints.select("doc_id", "d0", "d1"), classes, ["d0", "d1"], "inner"), "named")
    # one row of each class: the others are found by their ids
    copies = named.where("doc_id <> node").select("doc_id", "d0", "d1").distinct()
    few = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    own = prints.join(F.broadcast(copies) if few else copies, ["doc_id", "d0", "d1"], "left_anti")
    tokens = own.select(F.col("doc_id").alias("node"), "size", F.posexplode("tokens").alias("place", "token"))
    shared, shared_at = written(tokens.groupBy("token").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1"), "shared")
    total = shared.agg(F.sum("n")).first()[0] or 0
    named_tokens = tokens.join(F.broadcast(shared), "token") if total <= BROADCAST_ROWS else joined_hot(tokens, shared, ["token"], "inner", total=total, counts=shared.select("token", F.col("n").alias("count")))
    postings, postings_at = written(named_tokens.select("token", "node", "size", F.col("place").cast("long").alias("place"), "hub", "n"), "postings")
    sets, sets_at = written(own.select(F.col("doc_id").alias("node"), "size", "parities"), "sets")
    links, at = verified(postings.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), sets, texts, words, similarity)
    found, paths = links, [at]
    root = components(found)
    stars = True
    for turn in range(STARS + 1):
        rooted = joined_small(postings.drop("hub"), root, ["node"]).withColumn("root", F.coalesce("root", "node"))
        # a token whose postings are all of one component is done
        open_ = rooted.groupBy("token").agg(F.first("n").alias("n"), F.min("root").alias("least"), F.max("root").alias("most"), F.max_by("node", "root").alias("hub")).where("least < most")
        open_ = checkpointed(open_)
        large = open_.where(F.col("n") > min(FEW, block))
        last = turn == STARS or not stars or not large.limit(1).count()
        rest = joined_small(rooted, (open_ if last else large).drop("n"), ["token"], "inner")
        if last:
            buckets = max(1, -(-rest.count() // BUCKET))
            blocks = F.ceil(F.col("n") / block).cast("int")
            tiled = rest.withColumn("mine", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            bucket = F.when(F.col("n") > block, F.col("token")).otherwise(F.pmod(F.xxhash64("token"), F.lit(buckets)))
            tiled = tiled.select("token", "node", "size", "place", "root", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), bucket.alias("bucket"))
            pairs = tiled.groupBy("bucket", "p", "q").applyInArrow(lambda t: paired(t, similarity), "a long, b long").distinct()
        else:
            pairs = rest.where("root <> most").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
        links, at = verified(pairs, sets, texts, words, similarity)
        paths.append(at)
        some = links.limit(1).count() > 0
        if some:
            found = found.union(links)
            root = components(found)
        if last:
            break
        stars = stars and some
    dropped(spark, prints_at, shared_at, postings_at, sets_at, *paths)
    table = joined_small(named.select("doc_id", "node"), root, ["node"]).select("doc_id", F.coalesce("root", "node").alias("component_id"))
    return table.union(docs.where("doc_id is null").select(F.lit(None).cast("long"), F.lit(None).cast("long")))


def clusters(docs: DataFrame, words: int = 3, within: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach) of every document.

    Documents with equal fingerprints are one class; null doc_ids stand in no minimum. Null and empty texts have
    fingerprint 0, long ones are read whole. Empty input: no rows. Repeated rows come back as often as they are there. More
    columns are ignored, whatever their names.
    """
    prints, _ = written(fingerprints(docs, words), "fingerprints")
    return grouped(prints, within)


def near_copies(docs: DataFrame, words: int = 3, within: int = 2, similar_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every document: groups of texts that chains of links join.

    Texts whose fingerprints (of ``words``-word shingles) are at most ``within`` bits apart link, all of them, by vantage-point
    trees. A fingerprint misses most near copies of a lower similarity, so those texts also link whose sets of
    ``similar_words``-word shingles have at least this Jaccard similarity (``near_clusters``), whatever their fingerprints.

    Null and empty texts are one class; rows with a null doc_id have a null component and join nothing; rows that share a
    doc_id are one node; empty input: no rows.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    pairs = lambda found: found.where("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    close, close_at = written(pairs(clusters(known, words, within)), "close")
    alike_, alike_at = written(pairs(near_clusters(known, similar_words, similarity)), "alike")
    root = components(close.union(alike_))
    dropped(docs.sparkSession, close_at, alike_at)
    return joined_small(docs.select(F.col("doc_id").cast("long").alias("node")), root, ["node"]).select(F.col("node").alias("doc_id"), F.coalesce("root", "node").alias("component_id"))


def grouped(prints: DataFrame, within: int = 2) -> DataFrame:
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = components(links(classes, within))
    rooted = joined_small(classes, root.withColumnRenamed("node", "fp"), ["fp"]).select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    table = checkpointed(joined_small(rooted, least, ["root"]).select("fp", "component_id"))
    return joined_small(prints, table, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
