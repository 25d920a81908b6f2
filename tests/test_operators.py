"""Operators on small tables of their own: ties, nulls, empty tables, containers, the job store."""

import pytest
from pyspark.sql import functions as F

from strandframe.functions import numbers as N
from strandframe.operators import blobs, relate, select, series, service
from strandframe.sources import container, frames


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_numbers(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, -1, 7, -8, 2**31, -(2**40))], "v long")
    back = df.select("v", N.unzigzag(N.zigzag(F.col("v"))).alias("b"), N.signed(F.col("v"), 16).alias("s"), N.bit_width(F.abs("v")).alias("w"))
    for r in back.collect():
        assert r.b == r.v and r.s == (r.v + 32768) % 65536 - 32768 and r.w == abs(r.v).bit_length()


def test_series_inverses(spark):
    df = spark.createDataFrame([(k % 2, k, (k * 7919) % 1000 - 500) for k in range(50)], "key int, pos long, v long")
    want = rows(df.select("pos", "v"))
    there = series.delta(df, ["key"], ["pos"], "v")
    assert rows(series.undelta(there, ["key"], ["pos"], "delta").select("pos", "value")) == want
    there = series.delta2(df, ["key"], ["pos"], "v")
    assert rows(series.undelta2(there, ["key"], ["pos"], "delta2").select("pos", "value")) == want
    assert series.delta(df.limit(0), ["key"], ["pos"], "v").count() == 0


def test_palette_ties(spark):
    df = spark.createDataFrame([("a", v, p) for p, v in enumerate([3, 3, 1, 1, 2])], "g string, v long, p long")
    assert rows(series.palette(df, ["g"], "v", 2).select("v", "rank")) == [(1, 0), (3, 1)]
    assert rows(series.palette(df, ["g"], "v", 2, first="p").select("v", "rank")) == [(1, 1), (3, 0)]
    assert rows(series.dominant(df, ["g"], "v")) == [("a", 1, 2, 3)]


def test_runs_keep_nulls_apart(spark):
    df = spark.createDataFrame([(0, k, s) for k, s in enumerate(["a", "a", None, None, "a"])], "b int, p long, s string")
    assert [(r.start, r["length"]) for r in series.runs(df, ["b"], "p", "s").orderBy("start").collect()] == [(0, 2), (2, 2), (4, 1)]


def test_winner_takes_the_earlier_of_equals(spark):
    df = spark.createDataFrame([(1, 5, 0, "x"), (1, 5, 1, "y"), (1, 9, 2, "z")], "k int, bytes long, place int, name string")
    assert [r.name for r in select.winner(df, ["k"], "bytes", "place").collect()] == ["x"]


def test_range_resolution_drops_ambiguous_points(spark):
    ranges = spark.createDataFrame([("a", 0, 10), ("b", 8, 200), ("c", 300, 300)], "name string, lo long, hi long")
    points = spark.createDataFrame([(k,) for k in (0, 9, 11, 200, 201, 300)], "at long").withColumn("id", F.col("at"))
    got = relate.range_resolved(points, ["id"], "at", ranges, "name", "lo", "hi", 4)
    assert rows(got.select("at", "name", "offset")) == [(0, "a", 0), (11, "b", 3), (200, "b", 192), (300, "c", 0)]


def test_partition_is_complete(spark):
    sizes = spark.createDataFrame([(1, 100), (2, 0), (3, 70)], "id long, size long")
    spans = spark.createDataFrame([(1, 10, 20, "x"), (1, 20, 30, "y"), (3, 0, 70, "z")], "id long, a long, b long, kind string")
    got = rows(relate.partitioned(spans, "id", "a", "b", "kind", sizes, "size", 40).select("id", "start", "end", "kind"))
    assert got == [(1, 0, 10, "generic"), (1, 10, 20, "x"), (1, 20, 30, "y"), (1, 30, 70, "generic"), (1, 70, 100, "generic"), (3, 0, 70, "z")]


def test_greedy_spans(spark):
    spans = spark.createDataFrame([(1, 0, 5, "a"), (1, 0, 9, "b"), (1, 3, 4, "c"), (1, 9, 10, "d")], "id long, start long, end long, kind string")
    assert rows(relate.greedy_spans(spans, "id").select("kind")) == [("b",), ("d",)]


def test_policy_deny_wins_and_null_is_any(spark):
    requests = spark.createDataFrame([("u", "seg:a", "x"), ("v", "seg:a", "x"), ("w", "zzz", "x")], "identity string, object string, place string")
    bindings = spark.createDataFrame([("u", "r"), ("v", "r"), ("v", "d"), ("w", "r")], "identity string, role string")
    rules = spark.createDataFrame([("r", "allow", 5, "seg:*", None), ("d", "deny", 0, None, "x")], "role string, effect string, cap int, oo string, pp string")
    got = relate.policy_decision(requests, bindings, rules, ["identity"], {"object": "oo", "place": "pp"})
    assert rows(got.select("identity", "allowed", "cap"))[:2] == [("u", True, 5), ("v", False, None)] and not got.where("identity = 'w' and allowed").count()


def test_keyset_page(spark):
    df = spark.createDataFrame([(k,) for k in range(10)], "id long")
    page = select.page(df, "id", 2, 3).collect()
    assert sorted(r.id for r in page) == [3, 4, 5] and {r.next_cursor for r in page} == {5}
    assert {r.next_cursor for r in select.page(df, "id", 6, 3).collect()} == {None}


def test_job_store(spark):
    requests = spark.createDataFrame([("t", "k", "f1", 1), ("t", "k", "f2", 2), ("t", "m", "f1", 3)], "tenant string, idem string, fp string, at long")
    got = {r.idem: r for r in service.submitted(requests, ["tenant", "idem"], "fp", ["at"]).collect()}
    assert got["k"].conflict and got["k"].fp == "f1" and got["k"].requests == 2 and not got["m"].conflict
    jobs = spark.createDataFrame([(1, "queued", 30, 0), (2, "running", 10, 5), (3, "running", 5, 99), (4, "failed", 1, 0)], "id long, state string, created_ms long, lease_until long")
    assert [r.id for r in service.claimable(jobs, 50).collect()] == [2, 1]


def test_negotiation_sizes_paths(spark):
    one = spark.range(1)
    pick = lambda h: one.select(service.negotiated(F.lit(h), ["zstd", "gzip"]).alias("c")).first().c
    assert pick("gzip") == "gzip" and pick("gzip;q=0.5, zstd;q=0.5") == "zstd" and pick("*;q=0") is None and pick("") is None
    size = lambda s: one.select(service.size_of(F.lit(s)).alias("c")).first().c
    assert size("64KiB") == 65536 and size("3M") == 3 << 20 and size("7") == 7 and size("x") is None
    ok = lambda s: one.select(service.valid_path(F.lit(s)).alias("c")).first().c
    assert ok("a/b.txt") and not ok("../a") and not ok("/a") and not ok("a//b") and not ok("")


def test_blobs_take_nulls_and_long_sequences(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ab" * 40_000)], "id long, text string")
    assert {r.id: r.n_bytes for r in blobs.type_class(df, ["id"], "text").collect()} == {1: 0, 2: 0, 3: 80_000}
    assert [r.n_bytes for r in blobs.blocks(df, ["id"], "text").orderBy("block").collect()] == [65_536, 14_464]
    assert blobs.profile(df.limit(0), ["id"], "text").count() == 0


def test_container_table(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, b"abc"), (1, 1, b"de"), (2, 0, b"")], "id long, number long, data binary")
    frames.write_container(frames.framed(df, "data"), str(tmp_path / "c"), "id", "number")
    back = frames.read_container(spark, str(tmp_path / "c"), "id", "number")
    assert back.where("ok").count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        frames.write_container(frames.framed(df, "data"), str(tmp_path / "c"), "id", "number")


def test_container_files(spark, tmp_path):
    container.register(spark)
    at = str(tmp_path / "files")
    spark.createDataFrame([(b"abc",), (b"",), (b"x" * 1000,)], "payload binary").coalesce(1).write.format("container").mode("append").save(at)
    back = spark.read.format("container").load(at)
    assert sorted(bytes(r.payload) for r in back.where("route = 0").collect()) == [b"", b"abc", b"x" * 1000] and back.where("not ok").count() == 0
    name = next((tmp_path / "files").iterdir())
    name.write_bytes(name.read_bytes()[:-5])
    assert spark.read.format("container").load(at).where("not ok").count() == 1


def test_manifest_differences(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, address string")
    b = spark.createDataFrame([(2, "y"), (3, "z")], "id long, address string")
    assert rows(frames.differences(a, b, ["id", "address"])) == [(1, "x", "missing"), (3, "z", "extra")]


def test_record_admissions(spark):
    import struct

    from strandframe.operators import records

    grid = struct.pack("<7i", 5, 6, -2, 0, 1, -1, 28) + bytes(56)
    data = [(0, b""), (1, b"\x03\x00\x05"), (2, b"\x01\x00\x00"), (3, grid), (4, grid + b"x"), (5, b"..V2000..M  END"), (6, b"\x7fELF"), (7, None)]
    df = spark.createDataFrame(data, "id int, data binary")
    got = {r.id: (r.kinds, r.n) for r in df.select("id", records.admissions(F.col("data")).alias("kinds"), records.grid_records(F.col("data")).alias("n")).collect()}
    assert got == {0: ([], None), 1: (["records"], None), 2: ([], None), 3: (["grid"], 2), 4: ([], None), 5: (["molecule", "hydrogen"], None), 6: (["executable"], None), 7: ([], None)}


def test_molecules(spark):
    from strandframe.operators import records

    lines = ["name", "", "", "  2  1  0  V2000", "    1.5000   -0.2500    0.0000 C   0", "   -0.0000   12.0000  999.0001 Br  0", "M  END"]
    text = "\n".join(lines) + "\n$$$$\n" + "x"
    df = spark.createDataFrame([(1, text), (2, "")], "id int, text string")
    parts = records.molecule_records(df, ["id"], "text")
    assert {r.id: r.text for r in records.joined_records(parts, ["id"]).collect()} == {1: text, 2: ""}
    got = [tuple(r) for r in records.atoms(parts, ["id"]).orderBy("atom").collect()]
    assert got == [(1, 0, 0, 15_000, -2_500, 0, 0), (1, 0, 1, None, 120_000, 9_990_001, 4)]


def test_estimates():
    import math

    import numpy as np

    from strandframe.functions import kernels as K

    assert K.estimate(K.octets(b"")) == 1.0 and K.estimate(K.octets(b"aaaa")) == pytest.approx((8 + math.log2(256)) / 8)
    assert K.estimate(K.octets(b"ab")) == pytest.approx((8 + math.log2(math.comb(256, 2)) + 1) / 8)
    x = np.concatenate([np.zeros(512, np.uint8), np.full(512, 7, np.uint8)])
    assert K.local_estimate(x, (512,)) == pytest.approx(min(K.estimate(x), 2 + 2 * K.estimate(x[:512])))
    assert K.width_candidates(x[:16]) == []


def test_period_profile_tries_every_lag(spark):
    """The period is longer than a sixteenth of the text; lags that are dealt out are ranked as those of one task."""
    text = ("".join(chr(97 + (7 * k * k + k // 3) % 26) for k in range(61)) * 8)[:400]
    df = spark.createDataFrame([(1, text), (1, text[:150]), (2, None), (3, ""), (4, "ab"), (5, text[:61] * 3 + "x" * 90)], "id long, text string")
    best = {(r.id, r.lag) for r in blobs.period_profile(df, ["id"], "text").where("rank = 0").collect()}
    assert (1, 61) in best
    for most, count in ((4, 3 * 4 + 2), (None, 400 + 150 + 2 + 2 * 136)):  # "ab" has one lag
        found = rows(blobs.period_profile(df, ["id"], "text", most))
        assert len(found) == count and found == rows(blobs.period_profile(df, ["id"], "text", most, unit=9_000))
