"""The relations behind a job and metadata store: submission, claims, leases, revisions, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States from which nothing follows.
TERMINAL = ("succeeded", "failed", "cancelled")


def submitted(requests: DataFrame, key: list[str], fingerprint: str, order: list[str]) -> DataFrame:
    """One row for each idempotency key: its first request, how often it was repeated, and whether a repetition differs."""
    first = F.min_by(F.struct(*(c for c in requests.columns if c not in key)), F.struct(*order))
    found = requests.groupBy(*key).agg(first.alias("_f"), F.count("*").alias("requests"), (F.min(fingerprint) != F.max(fingerprint)).alias("conflict"))
    return found.select(*key, "_f.*", "requests", "conflict")


def new_only(requests: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Requests whose key the store doesn't have."""
    return requests.join(known.select(*key).distinct(), key, "left_anti")


def claimable(jobs: DataFrame, now: Column | int, most: int = 8) -> DataFrame:
    """The queue's head: queued jobs, and running or cancelling ones whose lease is over; oldest first. A top-k."""
    free = (F.col("state") == "queued") | (F.col("state").isin("running", "cancelling") & (F.col("lease_until") < now))
    return jobs.where(free).orderBy("created_ms", "id").limit(most)


def alive(jobs: DataFrame, worker: str, now: Column | int) -> DataFrame:
    """Jobs whose lease a worker holds and may renew."""
    return jobs.where((F.col("lease_owner") == worker) & (F.col("lease_until") >= now) & ~F.col("state").isin(*TERMINAL))


def latest(changes: DataFrame, key: list[str], revision: str) -> DataFrame:
    """The newest revision of each entity, from a log of changes: one pre-aggregated maximum."""
    rest = [c for c in changes.columns if c not in key]
    return changes.groupBy(*key).agg(F.max_by(F.struct(*rest), revision).alias("_r")).select(*key, "_r.*")


def fenced(updates: DataFrame, current: DataFrame, key: list[str], revision: str) -> DataFrame:
    """Updates whose expected revision is the stored one, and for each entity only the first of them."""
    ok = updates.join(current.select(*key, F.col(revision).alias("_now")), key).where(F.col(revision) == F.col("_now")).drop("_now")
    w = Window.partitionBy(*key).orderBy(*[c for c in ok.columns if c not in key])
    return ok.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def negotiated(header: Column, offered: list[str]) -> Column:
    """The offered coding of the greatest weight in an Accept-Encoding header (ties: the earlier offer; weight 0: refused)."""
    parts = F.filter(F.transform(F.split(F.lower(header), ","), lambda p: F.trim(p)), lambda p: p != "")
    entry = lambda p: F.struct(F.trim(F.split(p, ";")[0]).alias("name"), F.coalesce(F.regexp_extract(p, r"q=([0-9.]+)", 1).try_cast("double"), F.lit(1.0)).alias("q"))
    named = F.transform(parts, entry)
    weight = lambda name: F.coalesce(F.try_element_at(F.transform(F.filter(named, lambda e: e["name"] == name), lambda e: e["q"]), F.lit(1)), F.try_element_at(F.transform(F.filter(named, lambda e: e["name"] == "*"), lambda e: e["q"]), F.lit(1)), F.lit(0.0))
    ranked = F.array_sort(F.filter(F.array(*(F.struct((F.lit(0.0) - weight(n)).alias("q"), F.lit(k).alias("k"), F.lit(n).alias("name")) for k, n in enumerate(offered))), lambda e: e["q"] < 0))
    return F.try_element_at(ranked, F.lit(1))["name"]


def size_of(text: Column) -> Column:
    """Bytes of a size text: digits with KiB, MiB or GiB (or K, M, G) after them; anything else: null."""
    number = F.regexp_extract(text, r"^\s*([0-9]+)\s*([KMG]?)(?:iB)?\s*$", 1)
    unit = F.regexp_extract(text, r"^\s*([0-9]+)\s*([KMG]?)(?:iB)?\s*$", 2)
    factor = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1)
    return F.when(number != "", number.cast("long") * factor)


def valid_path(path: Column) -> Column:
    """A relative path of plain parts: not empty, no ``.`` or ``..`` parts, no backslash, no leading slash."""
    part = r"(?!\.{1,2}(/|$))[^/\\]+"
    return path.rlike(rf"^{part}(/{part})*$")


def first_violation(limits: dict[str, tuple[Column, Column]]) -> Column:
    """The first limit (name: asked, cap) that is over its cap; none: null."""
    return F.coalesce(*(F.when(asked > cap, F.lit(name)) for name, (asked, cap) in limits.items()), F.lit(None).cast("string"))


def inserted(store: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with ``status``: created, or conflict if the store has their key or an equal key among the rows; created rows
    are what is to be appended. A row is the first of its key by all its columns."""
    first = rows.groupBy(*key).agg(F.min(F.struct(*(c for c in rows.columns if c not in key))).alias("_r"), F.count("*").alias("_n"))
    known = store.select(*key).distinct().withColumn("_known", F.lit(True))
    status = F.when(F.col("_known").isNotNull(), "conflict").otherwise("created")
    return first.join(known, key, "left").select(*key, "_r.*", (F.col("_n") - 1).alias("repeats"), status.alias("status"))


def lookup(df: DataFrame, **key) -> DataFrame:
    """The row of a primary key: a filter that reaches the scan."""
    for name, value in key.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def finished(jobs: DataFrame, updates: DataFrame, now: Column | int) -> DataFrame:
    """Terminal updates (id, worker, expected, state) that pass both fences: the stored revision is the expected one and the
    worker's lease lives. Of several for a job the first by worker and state. Each gives the job's next revision and is an event."""
    fits = (F.col("expected") == F.col("revision")) & (F.col("worker") == F.col("lease_owner")) & (F.col("lease_until") >= now) & ~F.col("state").isin(*TERMINAL)
    rows = updates.where(F.col("to_state").isin(*TERMINAL)).join(jobs, "id").where(fits)
    first = F.min(F.struct("worker", "to_state"))
    return rows.groupBy("id", "tenant", "revision").agg(first.alias("_f")).select("id", "tenant", (F.col("revision") + 1).alias("revision"), F.col("_f.to_state").alias("state"), F.col("_f.worker").alias("worker"))


def duration_ms(text: Column) -> Column:
    """Milliseconds of a duration text: digits with ms, s or m after them; anything else: null."""
    number, unit = (F.regexp_extract(text, r"^([0-9]+)(ms|s|m)$", k) for k in (1, 2))
    return F.when(number != "", number.cast("long") * F.when(unit == "ms", 1).when(unit == "s", 1000).otherwise(60_000))


def first_reason(reasons: dict[str, Column]) -> Column:
    """The first reason whose condition holds; none: null."""
    return F.coalesce(*(F.when(c, F.lit(name)) for name, c in reasons.items()), F.lit(None).cast("string"))
