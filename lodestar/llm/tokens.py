"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 7).

A pair of bytes that stands inside no token of the vocabulary marks a certain cut: no merge can cross it. Texts are split
at those cuts by one table look-up per byte, every distinct fragment of a batch is encoded once, and the fragments' ids
are put together by array gathers. A cut is taken only where the pattern that splits text before the merges comes to the
same pieces on both sides: after an ASCII byte that is no white space (else `\\s+(?!\\S)` could see another end), before
the first byte of a character that is no apostrophe (else a contraction could begin).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.wordhash import _BASE, _BASE_INV, U, _power, mix

#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the rank file is looked for if no path is given.
TOKENIZERS = os.environ.get("LODESTAR_TOKENIZERS", "/opt/tokenizers")
#: Fragments that a worker remembers, the longest of them, and bytes of text that are handled at a time.
MEMO, LONGEST, SLICE_BYTES = 300_000, 64, 2_000_000


def default_path() -> str:
    """The rank file of byte_bpe_50k."""
    return os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")


class Encoder:
    """A rank file with its table of certain cuts and a memory of fragments."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        inside = np.zeros(1 << 16, dtype=bool)
        for token in ranks:
            t = np.frombuffer(token, dtype=np.uint8).astype(np.int64)
            inside[t[:-1] << 8 | t[1:]] = True
        left, right = np.divmod(np.arange(1 << 16), 256)
        space = np.isin(left, [*range(9, 14), *range(28, 33)])
        self.cut = ~inside & (left < 128) & ~space & ((right < 128) | (right >= 192)) & (right != ord("'"))
        self.memo: dict[bytes, np.ndarray] = {}

    def fragment(self, raw: bytes) -> np.ndarray:
        ids = self.memo.get(raw)
        if ids is None:
            ids = np.array(self.bpe.encode_ordinary(raw.decode("utf-8")), dtype=np.int32)
            if len(raw) <= LONGEST:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[raw] = ids
        return ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text) of texts that lie end to end in data, text i at offsets[i] to offsets[i + 1]."""
        n = len(offsets) - 1
        if not len(data):
            return np.empty(0, dtype=np.int32), np.zeros(n, dtype=np.int64)
        start = self.cut[data[:-1].astype(np.int64) << 8 | data[1:]]
        at = np.concatenate([[True], start])
        at[offsets[:-1][offsets[:-1] < len(data)]] = True
        lo = np.flatnonzero(at)
        hi = np.append(lo[1:], len(data))
        sums = np.concatenate([[U(0)], np.cumsum((data.astype(U) + U(1)) * _power(_BASE, "b", len(data)), dtype=U)])
        h = mix((sums[hi] - sums[lo]) * _power(_BASE_INV, "i", len(data))[lo] + (hi - lo).astype(U))
        _, first, code = np.unique(h, return_index=True, return_inverse=True)
        if not self._alike(data, lo, hi, first, code):  # two fragments share a hash: each is one of its own
            first = code = np.arange(len(lo))
        raw = data.tobytes()
        ids = [self.fragment(raw[lo[i] : hi[i]]) for i in first]
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        per = sizes[code]
        ends = np.cumsum(per)
        flat = np.concatenate(ids)[np.repeat(begin[code] - (ends - per), per) + np.arange(ends[-1])]
        doc = np.searchsorted(offsets[1:], lo, side="right")
        return flat, np.bincount(doc, weights=per, minlength=n).astype(np.int64)

    @staticmethod
    def _alike(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, code: np.ndarray) -> bool:
        """Whether fragments of one hash are the same bytes."""
        size = hi - lo
        if not np.array_equal(size, size[first][code]):
            return False
        ends = np.cumsum(size)
        step = np.arange(ends[-1]) - np.repeat(ends - size, size)
        return np.array_equal(data[np.repeat(lo[first][code], size) + step], data)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def shipped(spark: SparkSession, path: str) -> str:
    """The name under which executors find the rank file; the driver hands it to them once a session."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(data, offsets) of slices of a string column, straight from its buffers; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.empty(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        to = min(to, len(column))
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def encode(df: DataFrame, row_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(row_id, ids): the token ids of each row's whole text, without special tokens.

    Empty and null texts both give an empty list. Row ids may be null or repeated; each row comes out once. An empty table
    gives an empty one. The map is narrow: nothing is shuffled.
    """
    name = shipped(df.sparkSession, path or default_path())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(SparkFiles.get(name))
        for b in parts:
            at = 0
            for data, offsets in _texts(b.column(1)):
                ids, per = bpe.encode(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(per)), lists], names=["row_id", "ids"])
                at += len(per)

    kind = df.schema[row_id].dataType.simpleString()
    out = df.select(F.col(row_id).alias("row_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"row_id {kind}, ids array<int>")
    return out.select(F.col("row_id").alias(row_id), "ids")


def count(df: DataFrame, row_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(row_id, n_tokens): the sizes of encode's lists, without handing the lists to the JVM."""
    name = shipped(df.sparkSession, path or default_path())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(SparkFiles.get(name))
        for b in parts:
            sizes = [bpe.encode(data, offsets)[1] for data, offsets in _texts(b.column(1))]
            if sizes:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(sizes))], names=["row_id", "n_tokens"])

    kind = df.schema[row_id].dataType.simpleString()
    out = df.select(F.col(row_id).alias("row_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"row_id {kind}, n_tokens long")
    return out.select(F.col("row_id").alias(row_id), "n_tokens")
