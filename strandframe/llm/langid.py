"""Language id: interpolated Kneser-Ney character models, one for each language, in sorted hash arrays.

A text is read as its letters and marks in lower case, with one space for anything else. The key of a character n-gram is
its code points in 16 bits each (code points beyond are hashed into the private area), so a suffix or a context is a shift
or a mask. Counts, discounts, back-off weights and probabilities are DataFrames over all n-grams of all training texts; none
is dropped. Up to MODEL_ROWS rows (counted first) a model becomes sorted arrays for each order, n-grams of all languages in
one, and is broadcast: one binary search serves all languages. A larger one stays a table: the n-grams of the texts are
joined with it, and the cross-entropies are the same.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import checkpointed, joined_hot, slices

ORDER, TEXT_BYTES = 4, 2 << 20
#: Rows of a model (18 bytes each) that may be collected and broadcast.
MODEL_ROWS = 4_000_000
SPACE = 0x20
#: Factors of the cross-entropy among which calibration chooses, and the share of its own texts that a language accepts.
SHARPNESS, ACCEPTED = [0.25 * 1.5**k for k in range(16)], 0.999


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter or a mark, and whether a letter."""
    kind = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    return np.array([k in "LM" for k in kind]), np.array([k == "L" for k in kind])


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts (uint64), the text number of each, and which texts have a letter."""
    kept, letter = _letters()
    lower = ["\n" + (t or "").lower() + "\n" for t in texts]
    row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lower), np.int64, len(lower)))
    code = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    mark = kept[code]
    lettered = np.bincount(row[letter[code]], minlength=len(texts)) > 0
    stays = mark.copy()
    stays[1:] |= mark[:-1] | (row[1:] != row[:-1])
    stays[:1] = True
    code = np.where(mark, np.where(code < 0xE000, code, 0xE000 + code % 0x1900), SPACE).astype(np.uint64)
    return code[stays], row[stays], lettered


def grams(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key of the n-gram that ends at each symbol but a text's first (before it: spaces), its text number, and which texts have a letter."""
    code, row, lettered = symbols(texts)
    key = code.copy()
    for back in range(1, order):
        before = np.full(len(code), SPACE, np.uint64)
        if len(code) > back:
            same = row[back:] == row[:-back]
            before[back:][same] = code[:-back][same]
        key |= before << np.uint64(16 * back)
    later = np.zeros(len(row), bool)
    later[1:] = row[1:] == row[:-1]
    return key[later], row[later], lettered


def counted(docs: DataFrame) -> DataFrame:
    """(lang, key, n) over all rows of ``docs`` (lang, text): summed within a task, then by Spark."""

    def rows(batches):
        held: dict[str, tuple[list, int]] = {}

        def merged(parts):
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

        for b in slices(batches, "text", TEXT_BYTES):
            names = b.column("lang").to_pylist()
            texts = b.column("text").to_pylist()
            for lang in sorted(set(names)):
                key, _, _ = grams([t for t, name in zip(texts, names, strict=True) if name == lang])
                keys, n = np.unique(key, return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append((keys, n))
                if len(parts) >= 16:
                    held[lang] = [merged(parts)]
        for lang, parts in held.items():
            keys, n = merged(parts)
            for k in range(0, len(keys), 100_000):
                part = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys[part]), pa.string()), pa.array(keys[part].view(np.int64)), pa.array(n[part])], ["lang", "key", "n"])

    return docs.select("lang", "text").mapInArrow(rows, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


@dataclass
class Arrays:
    """For each order: sorted keys, language numbers and log-probabilities of n-grams; and the same of contexts, whose values
    are the logs of the weight that the order below has after them."""

    langs: list[str]
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    contexts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    def _held(self, table: tuple[np.ndarray, np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, language number, value) of the entries of all ``keys``."""
        mine, lang, value = table
        low, high = np.searchsorted(mine, keys), np.searchsorted(mine, keys, side="right")
        n = high - low
        row = np.repeat(np.arange(len(keys)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]
        return row, lang[at], value[at]

    def log_p(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Log-probability of each gram's last symbol after those before it, for each language."""
        if order == 0:
            return np.full((len(keys), len(self.langs)), -16 * np.log(2))
        out = self.log_p(order - 1, keys & np.uint64((1 << 16 * (order - 1)) - 1))
        row, lang, value = self._held(self.contexts[order], keys >> np.uint64(16))
        out[row, lang] += value
        row, lang, value = self._held(self.grams[order], keys)
        out[row, lang] = value
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol (nats) of each text under each language, and which texts have a letter."""
        key, row, lettered = grams(texts)
        names, at = np.unique(key, return_inverse=True)
        logs = self.log_p(ORDER, names)
        n = np.maximum(np.bincount(row, minlength=len(texts)), 1)
        return np.stack([-np.bincount(row, logs[at, k], minlength=len(texts)) / n for k in range(len(self.langs))], axis=1), lettered


@dataclass
class Models:
    """Languages by number, the tables (order, lang, key, value) of n-grams and contexts, and the arrays if they are few."""

    langs: list[str]
    grams: DataFrame
    contexts: DataFrame
    arrays: Arrays | None
    sharpness: float = 10.0
    limits: dict[str, float] | None = None


def _shorter(key: Column, order: int) -> Column:
    return key.bitwiseAND(F.lit((1 << 16 * order) - 1))


def kneser_ney(counts: DataFrame) -> Models:
    """Models from (lang, key, n) of all n-grams of the highest order.

    Below it a gram's count is the number of distinct symbols before it; the discount of an order is n1 / (n1 + 2 n2) over
    all its grams; what it takes goes to the order below, down to equal chances of 2^16 symbols.
    """
    spark = counts.sparkSession
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    number = F.create_map(*(F.lit(x) for pair in ((name, k) for k, name in enumerate(langs)) for x in pair)) if langs else F.create_map().cast("map<string,int>")
    by = {ORDER: counts.select(number[F.col("lang")].alias("lang"), "key", "n")}
    for k in range(ORDER - 1, 0, -1):
        by[k] = by[k + 1].groupBy("lang", _shorter(F.col("key"), k).alias("key")).agg(F.count("*").alias("n"))
    every = checkpointed(reduce(DataFrame.unionByName, [t.select(F.lit(k).alias("order"), "lang", "key", "n") for k, t in by.items()]))
    few = lambda n: F.sum(F.when(F.col("n") == n, 1).otherwise(0))
    share = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    discount = every.groupBy("order", "lang").agg(few(1).alias("n1"), few(2).alias("n2")).select("order", "lang", F.least(F.greatest(share, F.lit(0.1)), F.lit(0.95)).alias("discount"))
    discount = F.broadcast(checkpointed(discount))  # a row for each order and language
    context = F.shiftrightunsigned("key", 16)
    contexts = every.groupBy("order", "lang", context.alias("key")).agg(F.sum("n").alias("total"), F.count("*").alias("types")).join(discount, ["order", "lang"])
    contexts = checkpointed(contexts.select("order", "lang", "key", "total", (F.col("discount") * F.col("types") / F.col("total")).alias("back")))
    lower = None
    done = []
    for k in range(1, ORDER + 1):
        own = every.where(F.col("order") == k).join(discount, ["order", "lang"]).withColumn("context", context)
        rows = own.join(contexts.where(F.col("order") == k).select("lang", F.col("key").alias("context"), "total", "back"), ["lang", "context"])
        if lower is None:
            rows = rows.withColumn("below", F.lit(2.0**-16))
        else:
            rows = rows.withColumn("short", _shorter(F.col("key"), k - 1)).join(lower.select("lang", F.col("key").alias("short"), F.col("p").alias("below")), ["lang", "short"])
        lower = checkpointed(rows.select("order", "lang", "key", ((F.col("n") - F.col("discount")) / F.col("total") + F.col("back") * F.col("below")).alias("p")))
        done.append(lower)
    table = reduce(DataFrame.unionByName, done).select("order", "lang", "key", F.log("p").alias("value"))
    contexts = contexts.select("order", "lang", "key", F.log("back").alias("value"))
    arrays = None
    if table.count() + contexts.count() <= MODEL_ROWS:
        arrays = Arrays(langs, _sorted(table), _sorted(contexts))
    return Models(langs, table, contexts, arrays)


def _sorted(table: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    got = table.select("order", F.col("lang").cast("short").alias("lang"), "key", "value").toArrow()  # at most MODEL_ROWS rows
    order, lang, key, value = (np.asarray(got.column(c)) for c in ("order", "lang", "key", "value"))
    key = key.view(np.uint64)
    at = {k: np.flatnonzero(order == k) for k in range(1, ORDER + 1)}
    at = {k: i[np.argsort(key[i], kind="stable")] for k, i in at.items()}
    return {k: (key[i], lang[i], value[i]) for k, i in at.items()}


def entropies(docs: DataFrame, models: Models) -> DataFrame:
    """``docs`` (id columns and text) without the text, with h (cross-entropy by language number, null entries: none) and
    lettered."""
    kept = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    if models.arrays is None:
        return _joined(docs, models, kept, schema)
    shared = docs.sparkSession.sparkContext.broadcast(models.arrays)

    def rows(batches):
        for b in slices(batches, "text", TEXT_BYTES):
            h, lettered = shared.value.entropies(b.column("text").to_pylist()) if shared.value.langs else (np.zeros((len(b), 0)), np.zeros(len(b), bool))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * h.shape[1]), pa.array(h.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), flat, pa.array(lettered)], [*kept, "h", "lettered"])

    return docs.select(*kept, "text").mapInArrow(rows, f"{schema}, h array<double>, lettered boolean")


def _joined(docs: DataFrame, models: Models, kept: list[str], schema: str) -> DataFrame:
    """``entropies`` through joins: the distinct n-grams of all texts find their log-probabilities order by order, then each
    text's n-grams take theirs."""

    def rows(batches):
        for b in slices(batches, "text", TEXT_BYTES):
            key, row, lettered = grams(b.column("text").to_pylist())
            order = np.lexsort((key, row))
            new = np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(row[order]) != 0)]) if len(order) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[order][first], minlength=len(b)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (key[order][first].view(np.int64), np.diff(np.append(first, len(order))).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *lists, pa.array(lettered)], [*kept, "keys", "times", "lettered"])

    held = checkpointed(docs.select(*kept, "text").mapInArrow(rows, f"{schema}, keys array<long>, times array<long>, lettered boolean").withColumn("at", F.monotonically_increasing_id()))
    single = held.select("at", F.explode(F.arrays_zip("keys", "times")).alias("g")).select("at", F.col("g.keys").alias("key"), F.col("g.times").alias("times"))
    counts = checkpointed(single.groupBy("key").agg(F.count("*").alias("count")))
    open_ = counts.select("key", F.explode(F.lit(list(range(len(models.langs))))).alias("lang"), F.col("key").alias("short"), F.lit(0.0).alias("log"))
    found = []
    for k in range(ORDER, 0, -1):
        gram = models.grams.where(F.col("order") == k).select("lang", F.col("key").alias("short"), "value")
        tried = checkpointed(open_.join(gram, ["lang", "short"], "left"))
        found.append(tried.where("value is not null").select("key", "lang", (F.col("log") + F.col("value")).alias("log")))
        back = models.contexts.where(F.col("order") == k).select("lang", F.col("key").alias("context"), F.col("value").alias("back"))
        rest = tried.where("value is null").withColumn("context", F.shiftrightunsigned("short", 16)).join(back, ["lang", "context"], "left")
        open_ = rest.select("key", "lang", _shorter(F.col("short"), k - 1).alias("short"), (F.col("log") + F.coalesce("back", F.lit(0.0))).alias("log"))
    found.append(open_.select("key", "lang", (F.col("log") - 16 * float(np.log(2))).alias("log")))
    logs = checkpointed(reduce(DataFrame.unionByName, found).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("lang", "log"))), lambda x: x["log"]).alias("logs")))  # an entry for each language
    each = joined_hot(single, logs, ["key"], "inner", counts=counts)
    sums = each.groupBy("at").agg(F.sum("times").alias("n"), *(F.sum(F.col("times") * F.col("logs")[k]).alias(f"s{k}") for k in range(len(models.langs))))
    h = F.array(*(F.coalesce(-F.col(f"s{k}") / F.col("n"), F.lit(0.0)) for k in range(len(models.langs)))).cast("array<double>")
    return held.join(sums, "at", "left").select(*kept, h.alias("h"), "lettered")


def fitted(docs: DataFrame, training: Column, calibration: Column) -> Models:
    """Models from all rows of ``docs`` (lang, text) for which ``training`` holds.

    Those for which ``calibration`` holds too, judged by models without them, set the sharpness of the score and each
    language's limit of cross-entropy. Rows with a null text or lang teach nothing, repeated rows count each. No such rows:
    no languages.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & training).select(F.col("lang").cast("string").alias("lang"), "text", F.coalesce(calibration, F.lit(False)).alias("apart"))
    rest, apart = (checkpointed(counted(known.where(c))) for c in ("not apart", "apart"))
    models = kneser_ney(rest)
    if models.langs:
        number = F.create_map(*(F.lit(x) for k, name in enumerate(models.langs) for x in (name, k)))
        seen = entropies(known.where("apart").select("lang", "text"), models).where("lettered").withColumn("true", F.try_element_at(number, F.col("lang"))).where("true is not null")
        seen = seen.withColumn("own", F.get("h", F.col("true"))).withColumn("gap", F.transform("h", lambda v: F.array_min("h") - v))
        spread = lambda s: F.log(F.aggregate(F.transform("gap", lambda g: F.exp(g * s)), F.lit(0.0), lambda a, v: a + v))
        loss = [F.sum(spread(s) - (F.array_min("h") - F.col("own")) * s).alias(f"s{k}") for k, s in enumerate(SHARPNESS)]
        found = seen.groupBy("lang").agg(F.percentile_approx("own", ACCEPTED, 10_000).alias("limit"), *loss).collect()  # a row for each language
    else:
        found = []
    models = kneser_ney(checkpointed(rest.unionByName(apart).groupBy("lang", "key").agg(F.sum("n").alias("n"))))
    if found:
        models.sharpness = SHARPNESS[int(np.argmin([sum(r[f"s{k}"] for r in found) for k in range(len(SHARPNESS))]))]
    models.limits = {r.lang: r.limit for r in found}
    return models


def predicted(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, lang_pred, score, entropy (nats a symbol), rejected for every text of ``docs`` (doc_id, text).

    lang_pred is the language of the lowest cross-entropy (ties: the first by name), ``und`` with score 0 if the text is
    null or has no letter, or no language was learned. rejected: the cross-entropy is beyond what that language's own
    texts have, or the score is under a half. Repeated rows and rows that share a doc_id have their own; a long text is
    read whole; more columns are ignored; an empty table gives no rows.
    """
    rows = entropies(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), models)
    ok = F.col("lettered") & (F.size("h") > 0)
    least = F.array_min("h")
    best = (F.array_position("h", least) - 1).cast("int")
    score = 1 / F.aggregate("h", F.lit(0.0), lambda a, v: a + F.exp((least - v) * models.sharpness))
    names = F.lit(models.langs or ["und"])
    limits = F.array(*(F.lit(float((models.limits or {}).get(x, np.inf))) for x in models.langs or ["und"]))
    rows = rows.select("doc_id", F.when(ok, F.get(names, best)).otherwise("und").alias("lang_pred"), F.when(ok, score).otherwise(0.0).alias("score"), F.when(ok, least).otherwise(0.0).alias("entropy"), F.when(ok, F.get(limits, best)).alias("limit"))
    rejected = F.col("limit").isNull() | (F.col("entropy") > F.col("limit")) | (F.col("score") < 0.5)
    return rows.select("doc_id", "lang_pred", "score", "entropy", rejected.alias("rejected"))
