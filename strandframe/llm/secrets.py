"""Secret scans through a trigram inverted index, in DataFrame functions only.

From each rule's regex follows a Boolean query over trigrams that every match must hold. The index has the postings of
those trigrams, in blocks; a rule's candidates are the union over its clauses of the intersection of the
clause's postings. Only candidates are matched; a rule whose query needs no trigram is matched against every document.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import again, beside, written

#: Numbers that documents are named by in postings (what is broadcast has at most so many rows), of them in a block of
#: postings, and characters of a chunk of a text that is redacted.
SLOTS, BLOCK, CHUNK = 1 << 21, 4096, 4096


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``regex`` (letters of ASCII only are folded) whose ``group`` has ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: The base rules' patterns and lengths. A run of one class that must have n characters is written {n,}: a
#: shorter run can't be a match, and a longer one is matched as a whole.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Formats of well-known issuers, each with a mark of its own.
ISSUERS = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]{20,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[rs]k_live_[0-9A-Za-z]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + ISSUERS

#: A query: clauses, of which one must hold in full; None: anything may match.
Query = frozenset[frozenset[str]] | None
_WIDEST = 64


def _all_of(texts: set[str]) -> Query:
    if any(len(t) < 3 for t in texts):
        return None
    return _least(frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts)


def _least(clauses) -> Query:
    """Without clauses that another one implies."""
    found = set(clauses)
    return frozenset(c for c in found if not any(o < c for o in found))


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return _least(x | y for x in a for y in b)


def _derived(nodes) -> tuple[set[str] | None, Query]:
    """The lower-case texts that a pattern can match, if they are few, else None; and the trigrams that a match must hold."""
    run: set[str] = {""}
    query: Query = None
    exact = True
    for op, value in nodes:
        texts, inner = _of(op, value)
        if texts is not None and len(run) * len(texts) <= _WIDEST:
            run = {a + b for a in run for b in texts}
            continue
        exact = False
        query = _both(_both(query, _all_of(run)), inner if texts is None else _all_of(texts))
        run = {""}
    return (run, None) if exact else (None, _both(query, _all_of(run)))


def _of(op, value) -> tuple[set[str] | None, Query]:
    if op is sre.LITERAL:
        return {chr(value).lower()}, None
    if op is sre.IN and all(o is sre.LITERAL for o, _ in value):
        return {chr(v).lower() for _, v in value}, None
    if op is sre.SUBPATTERN:
        return _derived(value[-1])
    if op is sre.BRANCH:
        parts = [_derived(p) for p in value[1]]
        if all(t is not None for t, _ in parts):
            return set().union(*(t for t, _ in parts)), None
        queries = [q if t is None else _all_of(t) for t, q in parts]
        return None, None if None in queries else _least(c for q in queries for c in q)
    if op is sre.MAX_REPEAT:
        low, high, inner = value
        texts, query = _derived(inner)
        if texts is not None and (low, high) == (0, 1):
            return texts | {""}, None
        if texts is not None and low == high and len(texts) ** low <= _WIDEST:
            return reduce(lambda a, _: {x + y for x in a for y in texts}, range(low), {""}), None
        return None, None if low == 0 else query if texts is None else _all_of(texts)
    return None, None


def trigram_query(regex: str) -> Query:
    """Lower-case trigrams that every match holds, as clauses; None if there are none that must be there."""
    texts, query = _derived(sre_parser.parse(regex))
    return query if texts is None else _all_of(texts)


def slot(doc_id: Column) -> Column:
    """What postings name a document by: a number below SLOTS. Documents that share one are candidates together."""
    return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(SLOTS)).cast("int")


def index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (block, trigram, slots): of each trigram number, the slots in a block of BLOCK slots of documents whose
    lower-case text holds it. A trigram that most documents hold is spread over all blocks; a posting has at most BLOCK
    slots, whatever the number of documents."""
    lower = docs.select(slot(F.col("doc_id")).alias("slot"), F.lower("text").alias("lower"))
    held = F.array_compact(F.array(*(F.when(F.contains("lower", F.lit(t)), F.lit(k)) for k, t in enumerate(trigrams))))
    rows = lower.select("slot", F.explode(held).alias("trigram")).withColumn("block", F.floor(F.col("slot") / BLOCK).cast("int"))
    return rows.groupBy("block", "trigram").agg(F.collect_set("slot").alias("slots"))


def candidates(postings: DataFrame, queries: dict[int, Query], trigrams: list[str]) -> DataFrame:
    """(slot, rules): the slots whose documents may satisfy a rule's query, and those rules' numbers as a sum of powers of two."""
    number = {t: k for k, t in enumerate(trigrams)}
    block = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "slots"))).alias("post"))
    none = F.array().cast("array<int>")
    get = lambda t: F.coalesce(F.try_element_at("post", F.lit(number[t])), none)
    clause = lambda c: reduce(F.array_intersect, (get(t) for t in sorted(c)))
    found = [F.struct(F.lit(1 << k).cast("long").alias("rule"), reduce(F.array_union, (clause(c) for c in sorted(q, key=sorted))).alias("slots")) for k, q in sorted(queries.items())]
    rules = block.select(F.explode(F.array(*found)).alias("r")).select(F.col("r.rule").alias("rule"), F.explode("r.slots").alias("slot"))
    return rules.groupBy("slot").agg(F.bit_or("rule").alias("rules"))


def _let(value: Column, body) -> Column:
    """body(value), with ``value`` computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(values: Column, zero: int, op) -> Column:
    """Running results of ``op`` over an array of ints, in two levels of pieces of about the square root of its size: an
    appended array is copied each time, so one level would take the square of its size."""

    def of(a):
        width = F.ceil(F.sqrt(F.size(a))).cast("int")
        piece = lambda k: F.aggregate(F.slice(a, k * width + 1, width), F.array().cast("array<int>"), lambda s, x: F.array_append(s, op(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(zero)), x)))
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / width).cast("int")), piece)

        def together(p):
            heads = F.aggregate(p, F.array(F.lit(zero)), lambda s, x: F.array_append(s, op(F.element_at(s, -1), F.element_at(x, -1))))
            return F.flatten(F.zip_with(p, F.slice(heads, F.lit(1), F.size(p)), lambda x, h: F.transform(x, lambda v: op(h, v))))

        return F.when(F.size(a) > 0, _let(pieces, together)).otherwise(F.array().cast("array<int>"))

    return _let(values, of)


SPANS = "array<struct<start:int,kind:int,end:int>>"


def matches(text: Column, rule: Rule, number: int) -> Column:
    """Spans (start, kind, end) in code points of a rule's matches in ``text``.

    split() gives what stands between matches and regexp_extract_all() the matches, so running sums give the places.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    size = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    steps = F.zip_with(F.split(text, rule.regex, -1), F.arrays_zip(whole.alias("whole"), size.alias("size")), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["whole"]).alias("long"), F.length(m["size"]).alias("size")))

    def placed(found):  # what stands after the last match has no match
        ends = _scan(F.transform(found, lambda x: x["gap"] + x["long"]), 0, lambda a, b: a + b)
        spans = F.zip_with(found, ends, lambda x, end: F.struct((end - x["long"]).alias("start"), F.lit(number).alias("kind"), end.alias("end"), (x["size"] >= rule.least).alias("ok")))
        return F.transform(F.filter(spans, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    return _let(F.filter(steps, lambda x: x["long"].isNotNull()), placed)


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES, name: str = "_spans", postings: DataFrame | None = None) -> DataFrame:
    """``docs`` with an array ``name`` of (start, kind, end): all rules' spans in each whole text, by start, then rule.

    A null or empty text has none. Repeated rows, and rows that share a doc_id, have their own spans each; rows without
    doc_id are candidates together. An empty table comes back empty. More columns stay as they are, whatever their names
    (but ``name``, which is replaced). The work grows with the text and with n^1.5 of one text's n matches. Candidates
    are broadcast as at most SLOTS rows, so texts are never shuffled; beyond some SLOTS candidates fewer texts are ruled
    out, and the spans stay the same. ``postings``: the ``index`` of these documents, if it is there already.
    """
    kept = [c for c in docs.columns if c != name]
    queries = {k: trigram_query(r.regex) for k, r in enumerate(rules)}
    needed = {k: q for k, q in queries.items() if q is not None}
    trigrams = sorted({t for q in needed.values() for c in q for t in c})
    rows = beside(docs, text=F.coalesce(F.col("text").cast("string"), F.lit("")), slot=slot(F.col("doc_id")))
    if needed:
        found, _ = written(candidates(index(docs, trigrams) if postings is None else postings, needed, trigrams), "candidates")
        rows = rows.join(F.broadcast(found), "slot", "left")
    else:
        rows = rows.withColumn("rules", F.lit(0).cast("long"))
    empty = F.array().cast(SPANS)
    text = F.col("text")
    hit = lambda k: F.coalesce(F.col("rules").bitwiseAND(F.lit(1 << k)) != 0, F.lit(False))
    spans = [matches(text, r, k) if queries[k] is None else F.when(hit(k), matches(text, r, k)).otherwise(empty) for k, r in enumerate(rules)]
    return rows.select(*again(kept), F.array_sort(F.concat(*spans)).alias(name))


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """``text`` with each run of overlapping or touching spans replaced by ``mark``; null stays null. ``spans`` are sorted.

    The text is cut into chunks once, and what stands between two runs is put together from its chunks: linear in the text.
    """

    def kept(chunks, edges):
        """The text from edge a to edge b of each pair."""

        def between(e):
            a, b = F.floor(e["a"] / CHUNK).cast("int"), F.floor(e["b"] / CHUNK).cast("int")
            first, last = F.coalesce(F.get(chunks, a), F.lit("")), F.coalesce(F.get(chunks, b), F.lit(""))
            same = F.substring(first, e["a"] % CHUNK + 1, e["b"] - e["a"])
            longer = F.concat(F.substring(first, e["a"] % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(last, F.lit(1), e["b"] % CHUNK))
            return F.when(a == b, same).otherwise(longer)

        return F.transform(edges, between)

    def done(runs):
        # runs: (start, the furthest end so far) of each run's first span and of the span after its last
        ends = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["end"]))
        starts = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.length(text)))
        edges = F.zip_with(ends, starts, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
        return F.array_join(_let(chunks, lambda c: kept(c, edges)), mark)

    def runs_of(s):
        furthest = _scan(F.transform(s, lambda x: x["end"]), -1, F.greatest)
        before = F.concat(F.array(F.lit(-1)), furthest)  # what the spans before reach
        both = F.zip_with(F.zip_with(s, F.slice(before, F.lit(1), F.size(s)), lambda x, b: F.struct(x["start"].alias("start"), (x["start"] > b).alias("fresh"))), furthest, lambda x, f: F.struct(x["start"].alias("start"), x["fresh"].alias("fresh"), f.alias("end")))
        firsts = lambda z: F.transform(F.filter(z, lambda x: x["fresh"]), lambda x: x["start"])
        # a run ends where the span after it is fresh
        lasts = lambda z: F.transform(F.filter(F.zip_with(z, F.concat(F.slice(z, F.lit(2), F.size(z)), F.slice(z, F.lit(1), F.lit(1))), lambda x, y: F.struct(x["end"].alias("end"), y["fresh"].alias("fresh"))), lambda x: x["fresh"]), lambda x: x["end"])
        return _let(both, lambda z: F.zip_with(firsts(z), lasts(z), lambda a, b: F.struct(a.alias("start"), b.alias("end"))))

    return F.when(F.size(spans) > 0, _let(spans, lambda s: _let(runs_of(s), done))).otherwise(text)
