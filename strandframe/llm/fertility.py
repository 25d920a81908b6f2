"""Quality rules on tokeniser fertility: how public vocabularies take a text apart, against bands per language or script.

For each text: characters per token and token entropy under a byte-level vocabulary, and the share of tokens that a
vocabulary with byte fallback writes as bytes. A language's bands come from the quantiles of all its documents; a text
outside one of them is rejected. Words are tokenised once for each slice of texts, however often they occur.
"""

from __future__ import annotations

import base64
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import joined_small, slices, written

TEXT_BYTES = 6 << 20
SYMBOLS = b"#*$%&|<>"
#: Base rules: fewest words, and the largest share of words in repeated windows.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 0.5, 3
#: A band reaches so many times as far from the median as the quartiles, and at least SLACK; it widens by the share
#: SHORT / tokens for short texts. Languages of fewer than FEW documents take the bands of all.
REACH, SLACK, SHORT, FEW = 6.0, {"chars_per_token": 0.12, "fallback_share": 0.02, "token_entropy": 0.06}, 150, 50
MEASURES = tuple(SLACK)
#: First code points of blocks, and the script that starts there.
_SCRIPTS = ((0x0, "other"), (0x41, "latin"), (0x5B, "other"), (0x61, "latin"), (0x7B, "other"), (0xC0, "latin"), (0x250, "other"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x900, "devanagari"), (0x980, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0x20000, "han"), (0x32000, "other"))


def _dense(*codes: np.ndarray) -> np.ndarray:
    """One code for each distinct row of several columns of codes."""
    out = codes[0]
    for code in codes[1:]:
        width = int(code.max()) + 1 if len(code) else 1
        if len(out) and (int(out.max()) + 1) * width >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1]
        out = out.astype(np.int64) * width + code
    return np.unique(out, return_inverse=True)[1]


def repeated_words(row: np.ndarray, word: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """For each of n texts: its words that stand in a window of words which the text holds twice or more."""
    if len(word) < window:
        return np.zeros(n, np.int64)
    last = len(word) - window + 1
    inside = row[:last] == row[window - 1 :]
    key = _dense(row[:last][inside], *(word[k : last + k][inside] for k in range(window)))
    twice = np.zeros(last, bool)
    twice[inside] = np.bincount(key)[key] > 1 if len(key) else False
    held = np.zeros(len(word), bool)
    for k in range(window):
        held[k : last + k] |= twice
    return np.bincount(row[held], minlength=n)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    found = 0
    for line in text.split("\n"):
        if line in seen:
            found += bool(line.strip(" \t\r\x0b\x0c"))
        seen.add(line)
    return found


class Vocabularies:
    """A byte-level vocabulary and one with byte fallback, applied to words."""

    def __init__(self, byte_path: str, fallback_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(byte_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=fallback_path)
        self.is_byte = np.array([self.pieces.is_byte(k) for k in range(self.pieces.get_piece_size())])

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Byte-level ids of all words one after another, their numbers, and the numbers of fallback tokens and of bytes among them."""
        encode = self.byte.encode_ordinary
        ids = [encode(" " + w) for w in words]
        pieces = self.pieces.encode(words, num_threads=1) if words else []
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        piece_size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.fromiter((i for p in pieces for i in p), np.int64, int(piece_size.sum()))
        owner = np.repeat(np.arange(len(words)), piece_size)
        return np.fromiter((i for p in ids for i in p), np.int64, int(size.sum())), size, piece_size, np.bincount(owner, self.is_byte[flat], minlength=len(words)).astype(np.int64)


def measured(docs: DataFrame, byte_path: str, fallback_path: str) -> DataFrame:
    """The base counts, fertility measures and script of every text of ``docs`` (doc_id, text, lang); null texts have no words."""

    def rows(batches):
        known = Vocabularies(byte_path, fallback_path)
        firsts = np.array([c for c, _ in _SCRIPTS])
        names = sorted({s for _, s in _SCRIPTS} - {"other"})
        script_of = np.array([names.index(s) if s != "other" else len(names) for _, s in _SCRIPTS])
        for b in slices(batches, "text", TEXT_BYTES):
            n = len(b)
            text = pc.fill_null(b.column("text").cast(pa.large_string()), "")
            parts = pc.ascii_split_whitespace(text)
            row = np.repeat(np.arange(n), np.diff(np.asarray(parts.offsets)))
            flat = parts.flatten()
            full = np.asarray(pc.greater(pc.binary_length(flat), 0))
            row, coded = row[full], flat.filter(pa.array(full)).dictionary_encode()
            word = np.asarray(coded.indices).astype(np.int64)
            chars = np.asarray(pc.utf8_length(coded.dictionary)).astype(np.int64)
            ids, size, pieces, byte = known.words(coded.dictionary.to_pylist())
            count = lambda v: np.bincount(row, v[word], minlength=n).astype(np.int64)  # noqa: E731, B023
            tokens = count(size)
            # entropy of each text's byte-level ids
            begin = np.cumsum(size) - size
            at = np.repeat(begin[word] - (np.cumsum(size[word]) - size[word]), size[word]) + np.arange(int(size[word].sum()))
            key = np.repeat(row, size[word]) * (1 << 20) + ids[at]
            key.sort()
            edge = np.flatnonzero(np.diff(key, prepend=-1))
            times = np.diff(edge, append=len(key)).astype(float)
            own = key[edge] >> 20
            total = np.maximum(np.bincount(own, times, minlength=n), 1)
            bits = np.log2(total) - np.bincount(own, times * np.log2(times), minlength=n) / total
            texts = text.to_pylist()
            lines = np.array([repeated_lines(t) for t in texts], np.int64)
            raw = [t.encode("utf-8", "replace") for t in texts]
            symbols = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in raw], np.int64)
            # the script of most letters, from each distinct word
            code = np.frombuffer("".join(coded.dictionary.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
            script = script_of[np.searchsorted(firsts, code, side="right") - 1]
            of_word = np.bincount(np.repeat(np.arange(len(chars)), chars) * (len(names) + 1) + script, minlength=len(chars) * (len(names) + 1)).reshape(-1, len(names) + 1)
            by_script = np.stack([count(of_word[:, k]) for k in range(len(names))], axis=1) if len(chars) else np.zeros((n, len(names)))
            best = [names[k] if by_script[i, k] else "none" for i, k in enumerate(by_script.argmax(axis=1))]
            fallback = count(pieces)
            out = {"doc_id": b.column("doc_id"), "lang": b.column("lang"), "n_words": np.bincount(row, minlength=n), "word_chars": count(chars), "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeated_words(row, word, n), "n_tokens": tokens}
            out |= {"chars_per_token": count(chars) / np.maximum(tokens, 1), "fallback_share": count(byte) / np.maximum(fallback, 1), "token_entropy": bits / np.maximum(np.log2(np.maximum(tokens, 2)), 1), "script": best}
            yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in out.items()})

    longs = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").mapInArrow(rows, f"doc_id long, lang string, {longs}, chars_per_token double, fallback_share double, token_entropy double, script string")


def judged(measures: DataFrame) -> DataFrame:
    """``measures`` with base_failed and kept: neither a base rule nor a band of its language (null: script) rejects it."""
    base = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = measures.withColumn("base_failed", base).withColumn("band", F.coalesce("lang", "script"))
    quantiles = [F.percentile_approx(m, [0.25, 0.5, 0.75], 10_000).alias(m) for m in MEASURES]
    good = rows.where("not base_failed")
    everyone = good.agg(F.count("*").alias("n"), *quantiles).first()
    if everyone.n == 0:
        return rows.withColumn("kept", ~F.col("base_failed"))
    own = good.groupBy("band").agg(F.count("*").alias("band_n"), *(q.alias(f"band_{m}") for m, q in zip(MEASURES, quantiles, strict=True))).where(F.col("band_n") >= FEW)
    rows = joined_small(rows, own, ["band"])
    wider = 1 + SHORT / F.greatest("n_tokens", F.lit(1))
    inside = []
    for m in MEASURES:
        at = [F.coalesce(F.col(f"band_{m}")[k], F.lit(float(everyone[m][k]))) for k in range(3)]
        low, high = (F.greatest(F.abs(at[1] - at[k]) * REACH, F.lit(SLACK[m])) * wider for k in (0, 2))
        inside.append((F.col(m) >= at[1] - low) & (F.col(m) <= at[1] + high))
    return rows.withColumn("kept", ~F.col("base_failed") & reduce(lambda a, b: a & b, inside))


def assessed(docs: DataFrame, byte_path: str, fallback_path: str) -> DataFrame:
    """Measures and verdict for every row of ``docs`` (doc_id, text, lang; more columns are ignored, whatever their names).

    Null, empty and blank texts have no words and fail the base rules. Repeated rows are measured each and weigh in the
    bands each; rows that share a doc_id have their own verdicts. Long texts are measured whole. On a band's edge a text is
    kept. Without a text that passes the base rules there are no bands, and the base rules decide. Empty table: no rows.
    """
    measures, _ = written(measured(docs, byte_path, fallback_path), "fertility")
    return judged(measures)
