"""Frequency of every distinct term, and marks for the too rare and the too common (problem 3).

1. Blocks: each task counts its rows against a dictionary of its block, so a term leaves it as one row a block however
   often it occurs, and a hot term is no hot key.
2. Dictionary: the distinct terms of all blocks are sorted by ranges and numbered, which gives every term a dense id.
3. Encoding: the blocks' terms are replaced by their ids, through the broadcast dictionary if its counted size allows it,
   else by a shuffled join.
4. Sums: ids are gathered into count arrays of occurrences and records by ranges of RANGE ids, the arrays are shuffled by
   range and added up; a task holds MOST_RANGES ranges at most, so its memory does not grow with the dictionary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.wordhash import Words, joined, slices
from lodestar.operators.archive import numbered
from lodestar.session import broadcast_if_small, cut

#: Distinct terms after which a block is closed: bounds a task's memory, not the counts.
BLOCK_TERMS = 400_000
#: Ids in a range, whose counts are one array, and ranges that a task holds.
RANGE, MOST_RANGES = 4096, 256


class Block:
    """A dictionary of terms with the count arrays of occurrences and records."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.terms: list[str] = []
        self.occurrences = np.zeros(1024, dtype=np.int64)
        self.records = np.zeros(1024, dtype=np.int64)

    def encode(self, terms: list[str]) -> np.ndarray:
        out = np.empty(len(terms), dtype=np.int64)
        for i, t in enumerate(terms):
            at = self.ids.get(t)
            if at is None:
                at = self.ids[t] = len(self.terms)
                self.terms.append(t)
            out[i] = at
        while len(self.terms) > len(self.occurrences):
            self.occurrences = np.concatenate([self.occurrences, np.zeros_like(self.occurrences)])
            self.records = np.concatenate([self.records, np.zeros_like(self.records)])
        return out

    def add(self, terms: list[str], occurrences: np.ndarray, records: np.ndarray) -> None:
        """Add counts of terms that may repeat."""
        at = self.encode(terms)
        np.add.at(self.occurrences, at, occurrences)
        np.add.at(self.records, at, records)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.terms), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.terms[part], pa.string()), pa.array(self.occurrences[: len(self.terms)][part]), pa.array(self.records[: len(self.terms)][part])],
                names=["term", "occurrences", "records"],
            )


class Ranges:
    """Count arrays by range of ids: row 0 occurrences, row 1 records."""

    def __init__(self) -> None:
        self.held: dict[int, np.ndarray] = {}

    def add(self, number: int, at: np.ndarray, occurrences: np.ndarray, records: np.ndarray) -> None:
        own = self.held.get(number)
        if own is None:
            own = self.held[number] = np.zeros((2, RANGE), dtype=np.int64)
        np.add.at(own[0], at, occurrences)
        np.add.at(own[1], at, records)

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(range, places that have a count, their counts)."""
        for number, own in self.held.items():
            at = np.flatnonzero(own[0])
            yield number, at, own[:, at]


def _count_slice(texts: list[str], min_len: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct terms of a slice, with their occurrences and the number of texts that hold them."""
    w = Words(texts)
    keep = np.flatnonzero(w.end - w.start >= min_len)
    if not len(keep):
        return [], np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    _, first, code = np.unique(w.hash[keep], return_index=True, return_inverse=True)
    occurrences = np.bincount(code)
    seen = np.unique(code.astype(np.int64) * w.n_docs + w.doc[keep])
    records = np.bincount(seen // w.n_docs, minlength=len(first))
    return [w.text(keep[i]) for i in first], occurrences, records


def block_counts(df: DataFrame, title: str, description: str, min_len: int) -> DataFrame:
    """(term, occurrences, records) of every block of rows; a term may come from several blocks."""

    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for b in parts:
            texts = joined(b.column(0), b.column(1))
            for lo, hi in slices(texts):
                block.add(*_count_slice(texts[lo:hi], min_len))
                if len(block.terms) > BLOCK_TERMS:
                    yield from block.batches()
                    block = Block()
        yield from block.batches()

    texts = df.select(F.col(title).alias("title"), F.col(description).alias("description"))
    return texts.mapInArrow(blocks, "term string, occurrences long, records long")


def summed(encoded: DataFrame, n_terms: int) -> DataFrame:
    """(term_id, occurrences, records) summed over encoded rows of these columns with ids from 0 to n_terms - 1."""

    def gathered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Ranges()

        def flush() -> pa.RecordBatch:
            rows = list(arrays)
            arrays.held.clear()
            cols = [pa.array([n for n, _, _ in rows], pa.int64()), pa.array([at.astype("<u2").tobytes() for _, at, _ in rows], pa.binary())]
            return pa.RecordBatch.from_arrays([*cols, pa.array([c.tobytes() for _, _, c in rows], pa.binary())], names=["range", "at", "counts"])

        for b in parts:
            ids, occurrences, records = (b.column(k).to_numpy() for k in range(3))
            number = ids // RANGE
            order = np.argsort(number, kind="stable")
            starts = np.flatnonzero(np.diff(number[order], prepend=-1))
            for lo, hi in zip(starts, np.append(starts[1:], len(order))):
                own = order[lo:hi]
                arrays.add(int(number[own[0]]), ids[own] % RANGE, occurrences[own], records[own])
                if len(arrays.held) >= MOST_RANGES:
                    yield flush()
        if arrays.held:
            yield flush()

    def added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Ranges()
        for b in parts:
            for number, at, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                arrays.add(number, np.frombuffer(at, dtype="<u2"), *np.frombuffer(counts, dtype=np.int64).reshape(2, -1))
        for number, at, counts in arrays:
            cols = [pa.array(number * RANGE + at), pa.array(counts[0]), pa.array(counts[1])]
            yield pa.RecordBatch.from_arrays(cols, names=["term_id", "occurrences", "records"])

    n_ranges = max(1, math.ceil(n_terms / RANGE))
    # an explicit number of partitions is not coalesced, so ranges a task stay bounded
    parts = min(n_ranges, max(encoded.sparkSession.sparkContext.defaultParallelism, math.ceil(n_ranges / MOST_RANGES)))
    arrays = encoded.mapInArrow(gathered, "range long, at binary, counts binary")
    return arrays.repartition(parts, "range").mapInArrow(added, "term_id long, occurrences long, records long")


def term_counts(df: DataFrame, title: str = "title", description: str = "description", min_len: int = 2) -> DataFrame:
    """(term, term_id, occurrences, records) of every term of at least min_len characters.

    Null texts count as empty; repeated rows count each time; an empty table gives no rows; other columns are ignored.
    Texts of any length are read whole. term_id is the place of the term among all sorted terms, from 0.
    """
    blocks = cut(block_counts(df, title, description, min_len))
    dictionary = numbered(blocks.select("term").distinct(), [F.col("term")]).select("term", (F.col("pos") - 1).alias("term_id"))
    n_terms = dictionary.count()
    dictionary = broadcast_if_small(dictionary, 64)
    encoded = blocks.join(dictionary, "term").select("term_id", "occurrences", "records")
    return summed(encoded, n_terms).join(dictionary, "term_id").select("term", "term_id", "occurrences", "records")


def mark_terms(counts: DataFrame, n_rows: int, min_occurrences: int = 5, min_records: int = 3, max_share: float = 0.15) -> DataFrame:
    """counts with `mark`: 'rare' below either minimum, else 'common' above the share of all rows, else null."""
    rare = (F.col("occurrences") < min_occurrences) | (F.col("records") < min_records)
    return counts.withColumn("mark", F.when(rare, "rare").when(F.col("records") > max_share * n_rows, "common"))
