"""Byte-pair encoding of whole corpora with a public vocabulary, on padded integer matrices."""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARIES = os.environ.get("LOTGRID_TOKENIZERS", "/opt/tokenizers")
#: The pattern that byte-level vocabularies split text by, white space spelt out.
_WS = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
NEVER = np.int32(2**31 - 1)
_LOADED: dict[str, Vocabulary] = {}


def _printable_bytes() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabulary files use for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Merges of one vocabulary in an open-addressing hash table over pairs of token ids."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            ids, byte = model["vocab"], _printable_bytes()
            pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
            merges = [(ids[a], ids[b], rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)]
            single = {byte[c]: i for c, i in ids.items() if len(c) == 1}
        else:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            single = {t[0]: i for t, i in ranks.items() if len(t) == 1}
            merges = [(ranks[t[:k]], ranks[t[k:]], i, i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.single = np.zeros(256, np.int32)
        for b, i in single.items():
            self.single[b] = i
        table = np.array(sorted(merges, key=lambda x: -x[2]), np.int64).reshape(-1, 4)
        made = np.full(int(table.max(initial=0)) + 1, -1, np.int64)
        made[table[:, 3]] = table[:, 2]  # the lowest rank that makes a token
        #: Whether no merge precedes the merges of its parts: then all places of one pair may merge at once.
        self.ordered = bool(np.all((made[table[:, 0]] < table[:, 2]) & (made[table[:, 1]] < table[:, 2])))
        self.bits = max(4, int(np.ceil(np.log2(len(table) + 1))) + 2)
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NEVER, np.int32)
        self.into = np.full(size, -1, np.int32)
        keys = table[:, 0] << 32 | table[:, 1]
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] < 0
            first = np.unique(slot[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            at, row = slot[put], todo[put]
            self.keys[at], self.rank[at], self.into[at] = keys[row], table[row, 2], table[row, 3]
            left = np.ones(len(todo), bool)
            left[put] = False
            todo, slot = todo[left], (slot[left] + 1) & (size - 1)
        filled = self.keys >= 0
        run = np.diff(np.concatenate([[-1], np.flatnonzero(~filled), [size]]))
        self.longest = int(run.max()) + 1
        self.cache: dict[str, int] = {}
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; NEVER and -1 where they do not merge."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        shape, keys = keys.shape, keys.ravel()
        rank, into = np.full(len(keys), NEVER, np.int32), np.full(len(keys), -1, np.int32)
        open_ = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(keys[open_])
        for _ in range(self.longest):
            if not len(open_):
                break
            held = self.keys[slot]
            hit = held == keys[open_]
            rank[open_[hit]], into[open_[hit]] = self.rank[slot[hit]], self.into[slot[hit]]
            on = ~hit & (held >= 0)
            open_, slot = open_[on], (slot[on] + 1) & (len(self.keys) - 1)
        return rank.reshape(shape), into.reshape(shape)

    def merge(self, ids: np.ndarray) -> list[np.ndarray]:
        """Token ids of each row of a matrix of byte ids padded with -1."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(ids)
        rows = np.arange(len(ids))
        while len(rows):
            rank, into = self.lookup(ids[:, :-1], ids[:, 1:])
            best = rank.min(axis=1, initial=NEVER)
            done = best == NEVER
            for r, row in zip(rows[done], ids[done]):
                out[r] = row[row >= 0].copy()
            ids, rows, rank, into, best = ids[~done], rows[~done], rank[~done], into[~done], best[~done]
            if not len(rows):
                break
            if self.ordered:  # every place of the row's pair, the leftmost first where they overlap
                match = rank == best[:, None]
                place = np.arange(match.shape[1])
                gap = np.maximum.accumulate(np.where(match, -1, place[None, :]), axis=1)
                match &= ((place[None, :] - gap) & 1).astype(bool)
            else:
                match = np.zeros(rank.shape, bool)
                match[np.arange(len(rows)), rank.argmin(axis=1)] = True
            ids[:, :-1][match] = into[match]
            keep = ids >= 0
            keep[:, 1:] &= ~match
            width = keep.sum(axis=1)
            fresh = np.full((len(rows), int(width.max())), -1, np.int32)
            r, _ = np.nonzero(keep)
            fresh[r, (np.cumsum(keep, axis=1) - 1)[keep]] = ids[keep]
            ids = fresh
        return out

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of pieces of text that the pattern cut, in buckets of similar length."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        bucket = np.where(size < 16, (size + 3) // 4 * 4, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        for b in np.unique(bucket):
            members = np.flatnonzero(bucket == b)
            step = max(1, 400_000 // max(int(b), 1))
            for at in range(0, len(members), step):
                part = members[at : at + step]
                data = np.frombuffer(b"".join(words[i] for i in part), np.uint8)
                ids = np.full((len(part), max(2, int(size[part].max()))), -1, np.int32)
                ids[np.arange(ids.shape[1])[None, :] < size[part][:, None]] = self.single[data]
                for i, got in zip(part, self.merge(ids)):
                    out[i] = got
        return out

    def encode(self, texts: list[str | None], keep: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
        """All token ids in one array, and where each text begins in it (null and empty texts are empty).

        Pieces met before come from a cache; it is emptied, never relied on, beyond ``keep`` pieces.
        """
        cut = regex.compile(PATTERN).findall
        pieces: list[str] = []
        count = np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            if text:
                found = cut(text)
                pieces += found
                count[k + 1] = len(found)
        if len(self.cache) > keep:
            self.cache, self.flat, self.start = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        fresh = [w for w in dict.fromkeys(pieces) if w not in self.cache]
        if fresh:
            got = self.encode_words([w.encode("utf-8") for w in fresh])
            base = len(self.cache)
            self.cache.update(zip(fresh, range(base, base + len(fresh))))
            self.flat = np.concatenate([self.flat, *got])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(x) for x in got])])
        at = np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces))
        length = self.start[at + 1] - self.start[at]
        ends = np.concatenate([[0], np.cumsum(length)])
        take = np.arange(ends[-1]) + np.repeat(self.start[at] - ends[:-1], length)
        return self.flat[take], ends[np.cumsum(count)]


def vocabulary(name: str, folder: str = VOCABULARIES) -> Vocabulary:
    """The vocabulary file of a folder by its name, loaded once per worker process."""
    path = name if os.path.sep in name else next((p for p in (os.path.join(folder, name + e) for e in (".json", ".tiktoken", "")) if os.path.isfile(p)), name)
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _batches(batches: Iterator[pa.RecordBatch], name: str, folder: str, rows: int = 1024) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    vocab = vocabulary(name, folder)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            piece = batch.slice(at, rows)
            flat, ends = vocab.encode(piece.column(1).to_pylist())
            yield piece, flat, ends, np.asarray(piece.column(1).is_null())


def encode(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every document: one pass over Arrow batches, no shuffle.

    Null text gives null, empty text an empty array; texts are taken as they are, whole, and strings
    that look like special tokens are ordinary text. Further columns of the input are ignored.
    """
    plain = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([plain.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, flat, ends, null in _batches(batches, tokenizer, folder):
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=np.concatenate([null, [False]])), pa.array(flat))
            yield pa.RecordBatch.from_arrays([piece.column(0), lists], ["doc_id", "ids"])

    return plain.mapInArrow(run, schema)


def count_tokens(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every document; null text counts as 0 tokens."""
    plain = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([plain.schema["doc_id"], T.StructField("n_tokens", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, _, ends, _ in _batches(batches, tokenizer, folder):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(ends).astype(np.int32))], ["doc_id", "n_tokens"])

    return plain.mapInArrow(run, schema)
