"""Byte-level BPE ids for whole columns of text, by the tokenizers library.

A text is cut before every space that a pre-tokenisation boundary is sure to stand at; equal pieces are encoded once per
batch. A piece goes through the vocabulary's own split pattern and the library's BPE model, so the ids are those of
``Tokenizer.encode(text, add_special_tokens=False)``; texts that name an added token go through ``encode`` itself.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The byte-level split pattern (white space spelt as its Unicode property).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pretokens that an encoder remembers; the first ones it meets, the frequent ones among them.
REMEMBERED = 300_000


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def _ragged(flat: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat`` (run i is size[i] long) in the order ``at``, one after another, and their sizes."""
    begin = np.cumsum(size) - size
    size_at = size[at]
    total = np.cumsum(size_at)
    where = np.repeat((begin[at] - (total - size_at)).astype(np.int32), size_at)
    where += np.arange(len(where), dtype=np.int32)
    return flat[where], size_at


class ByteBpe:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.find = regex.compile(PATTERN).findall
        self.letters = _byte_letters()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = pa.array([], pa.large_string())
        self.known_ids, self.known_size = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def fresh(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of pretokens by the BPE model."""
        plain, letters, model = self.letters[0x20], self.letters, self.model
        runs = []
        for t in tokens:
            shown = t.replace(" ", plain) if t.isascii() and t.isprintable() else t.encode().decode("latin-1").translate(letters)
            runs.append([x.id for x in model.tokenize(shown)])
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        return np.fromiter(chain.from_iterable(runs), np.uint32, int(size.sum())), size

    def token_ids(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for distinct pretokens, most of which earlier batches may have had."""
        old = np.asarray(pc.fill_null(pc.index_in(tokens, value_set=self.known), -1))
        missing = np.flatnonzero(old < 0)
        new = tokens.take(pa.array(missing))
        ids, size = self.fresh(new.to_pylist())
        at = np.where(old < 0, 0, old)
        at[missing] = len(self.known) + np.arange(len(missing))
        all_ids, all_size = np.concatenate([self.known_ids, ids]), np.concatenate([self.known_size, size])
        out = _ragged(all_ids, all_size, at)
        if (room := REMEMBERED - len(self.known)) > 0:
            self.known = pa.concat_arrays([self.known, new.slice(0, room)])
            self.known_size = all_size[: len(self.known)].copy()
            self.known_ids = all_ids[: int(self.known_size.sum())].copy()
        return out

    def pieces(self, words: pa.Array, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, one after another, and numbers of ids of each word (with a space before it) and then of each text.

        Letters alone, or with one full stop or comma after them, need no split pattern: they are one pretoken or two.
        """
        alone = np.asarray(pc.utf8_is_alpha(words))
        stem, mark = pc.utf8_slice_codeunits(words, 0, -1), pc.utf8_slice_codeunits(words, -1)
        marked = np.asarray(pc.and_(pc.utf8_is_alpha(stem), pc.is_in(mark, value_set=pa.array([".", ","], pa.large_string()))))
        other = ~(alone | marked)
        found = [self.find(" " + w) for w in words.filter(pa.array(other)).to_pylist()] + [self.find(t) for t in texts]
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pc.if_else(pa.array(marked), stem, words).filter(pa.array(~other)), pa.scalar(" ", pa.large_string()))
        marks = mark.filter(pa.array(marked))
        parts = np.ones(len(words), np.int64)
        parts[marked] = 2
        parts[other] = [len(f) for f in found[: int(other.sum())]]
        begin = np.cumsum(parts) - parts
        tail = np.array([len(f) for f in found[int(other.sum()) :]], np.int64)
        in_words = int(parts.sum())
        at = np.zeros(in_words + int(tail.sum()), np.int64)
        coded = pa.concat_arrays([spaced, marks, pa.array(list(chain.from_iterable(found)), pa.large_string())]).dictionary_encode()
        code = np.asarray(coded.indices)
        at[begin[~other]] = code[: len(spaced)]
        at[begin[marked] + 1] = code[len(spaced) : len(spaced) + len(marks)]
        rest = np.ones(len(at), bool)
        rest[begin[~other]] = False
        rest[begin[marked] + 1] = False
        at[rest] = code[len(spaced) + len(marks) :]
        flat, size = _ragged(*self.token_ids(coded.dictionary), at)
        total = np.concatenate([[0], np.cumsum(size)])
        return flat, np.diff(total[np.concatenate([[0], np.cumsum(np.concatenate([parts, tail]))])])

    def encode(self, texts: pa.Array, end: int | None = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (uint32), and where each text's ids begin (its end: the next entry).

        A null text counts as empty. ``end`` is appended to each text's ids.
        """
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        n = len(texts)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        parts = pc.split_pattern(texts, " ")
        starts = np.asarray(parts.offsets).astype(np.int64)
        starts, flat = starts - starts[0], parts.flatten()
        coded = flat.dictionary_encode()
        words = coded.dictionary
        at = np.asarray(coded.indices).astype(np.int64)
        first = np.zeros(len(at), bool)
        first[starts[:-1]] = True
        empty = pc.equal(words, "")
        head, tail = (np.asarray(pc.or_(empty, pc.utf8_is_space(pc.utf8_slice_codeunits(words, *cut)))) for cut in ((0, 1), (-1, None)))
        unsure = np.zeros(len(at), bool)  # cuts inside white space, or that could cut an added token
        unsure[1:] = tail[at[:-1]] & head[at[1:]] & ~first[1:]
        doc = np.repeat(np.arange(n), np.diff(starts))
        whole = np.zeros(n, bool)
        whole[doc[unsure]] = True
        for t in self.added:
            whole |= np.asarray(pc.match_substring(texts, t))
        # first parts have no space before them; a text with an unsure cut is one piece, one with an added token goes to encode()
        begin = flat.take(pa.array(starts[:-1])).dictionary_encode()
        heads = texts.take(pa.array(np.flatnonzero(whole))).to_pylist()
        special = [any(t in x for t in self.added) for x in heads]
        first_words = begin.dictionary.to_pylist()
        ids, size = self.pieces(words, first_words + ["" if s else x for x, s in zip(heads, special, strict=True)])
        extra = [self.tokenizer.encode(x, add_special_tokens=False).ids for x, s in zip(heads, special, strict=True) if s] + [[] if end is None else [end]]
        base = len(words) + len(first_words)
        head_at = base + np.arange(len(heads))
        head_at[special] = len(size) + np.arange(sum(special))
        ids = np.concatenate([ids, *(np.array(x, np.uint32) for x in extra)])
        size = np.concatenate([size, [len(x) for x in extra]]).astype(np.int64)
        at[starts[:-1]] = len(words) + np.asarray(begin.indices)
        at[starts[:-1][whole]] = head_at
        keep = first | ~whole[doc]
        at, doc = at[keep], doc[keep]
        count = np.bincount(doc, minlength=n)
        if end is not None:
            at = np.insert(at, np.cumsum(count), len(size) - 1)
            count = count + 1
        out, size_at = _ragged(ids, size, at)
        total = np.concatenate([[0], np.cumsum(size_at)])
        return out, total[np.concatenate([[0], np.cumsum(count)])]
