"""Near-duplicate rows and their groups by HyperMinHash (problem 1).

1. Profile: rows with the same set of shingles form one class, named by 128 bits of that set; each row gets its class and
   a small HyperMinHash sketch for estimates.
2. Bands: six hash functions spread a text's shingles over 64 buckets each; a bucket keeps the least hash as a register
   of leading-zero count and mantissa bits. Band b takes bucket b of each function. Entries (band key, class) travel as
   packed arrays, twelve bytes each; classes that share a key are candidates.
3. Estimate: candidates whose sketch agreement, corrected for chance collisions of compressed registers, lies four
   standard errors below the threshold are left out.
4. Verification: the exact similarity of the shingle sets decides.

With the threshold of 0.6 a pair at that similarity is missed in at most about 5 of 100 cases, one at 0.65 in less than
1 of 100, one at 0.75 practically never.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.components import components
from lodestar.llm.wordhash import U, Words, joined, mix, slices
from lodestar.session import BROADCAST_BYTES, broadcast_if_small, cut

FUNCTIONS, BUCKETS = 6, 64
#: Entries that one part of a band should hold, and classes under one key beyond which its pairs are made in blocks.
PART_ROWS, HOT = 2_000_000, 512
#: Bytes of entries that a task gathers before it passes them on, and rows of a class that one task expands into pairs.
HELD_BYTES, CHUNK = 32 << 20, 2_000
_SALT = mix(np.arange(1, FUNCTIONS + 3, dtype=U))
_rng = np.random.default_rng(20240101)
_PROBES = _rng.integers(0, BUCKETS, size=(256, FUNCTIONS, BUCKETS))
#: A key of a band and the first 64 bits of a class id. Two classes that clash in these stand for one another, which adds
#: candidates that the verification refuses; they are not candidates of each other.
_ENTRY = np.dtype([("key", "<u4"), ("cls", "<u8")])


def registers(keys: np.ndarray, n_docs: int, functions: range = range(FUNCTIONS)) -> np.ndarray:
    """(document, function, bucket) registers of sorted (document << 44 | hash) shingles: 1 + 1024 * exponent + mantissa
    of the bucket's least value, so that fewer leading zeros and a larger mantissa are larger; 0 is an empty bucket."""
    doc = (keys >> U(44)).astype(np.int64)
    least = np.full(n_docs * len(functions) * BUCKETS, np.iinfo(np.uint64).max, dtype=U)
    for k, f in enumerate(functions):
        x = mix((keys & U((1 << 44) - 1)) + _SALT[f])
        at = (doc * len(functions) + k) * BUCKETS + (x >> U(58)).astype(np.int64)
        np.minimum.at(least, at, x & U((1 << 58) - 1))
    empty = least == np.iinfo(np.uint64).max
    bits = np.maximum(least, U(1)).astype(np.float64).view(U) >> U(42)
    out = (bits - U(1023 << 10) + U(1)).astype(np.uint16)
    out[empty] = 0
    return out.reshape(n_docs, len(functions), BUCKETS)


def densify(regs: np.ndarray) -> np.ndarray:
    """Fill each empty bucket from another of its function, tried in an order fixed for the bucket."""
    regs = regs.copy()
    full = regs > 0
    d, f, b = np.nonzero(~full)
    for probe in _PROBES:
        if not len(d):
            return regs
        src = probe[f, b]
        ok = full[d, f, src]
        regs[d[ok], f[ok], b[ok]] = regs[d[ok], f[ok], src[ok]]
        d, f, b = d[~ok], f[~ok], b[~ok]
    for i in range(len(d)):  # almost empty functions: the next full bucket
        row = np.flatnonzero(full[d[i], f[i]])
        if len(row):
            regs[d[i], f[i], b[i]] = regs[d[i], f[i], row[np.searchsorted(row, b[i]) % len(row)]]
    return regs


def sketch(regs: np.ndarray) -> np.ndarray:
    """(document, bucket) one-byte registers: 1 + 16 * leading zeros (at most 14) + 4 mantissa bits; 0 is empty."""
    v = np.maximum(regs.astype(np.int64), 1) - 1
    zeros = np.clip(57 - (v >> 10), 0, 14)
    return np.where(regs > 0, 1 + zeros * 16 + ((v >> 6) & 15), 0).astype(np.uint8)


def _collision_table() -> tuple[np.ndarray, np.ndarray]:
    """Chance that two different minima fall into the same one-byte register, by the bucket loads of the two texts."""
    loads = np.geomspace(1 / BUCKETS, 4096, 64)
    zeros, mant = np.divmod(np.arange(240), 16)
    hi, lo = 2.0**-zeros, 2.0 ** -(zeros + 1.0)
    left = lo + (hi - lo) * mant / 16
    right = lo + (hi - lo) * (mant + 1) / 16
    left[zeros == 14] *= mant[zeros == 14] > 0
    p = np.exp(-loads[:, None] * left) - np.exp(-loads[:, None] * right)
    p /= p.sum(1, keepdims=True)
    return loads, p @ p.T


_LOADS, _COLLIDE = _collision_table()


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of pairs of sketches, corrected for chance collisions, and its standard error at 0.6."""
    fa, fb = a > 0, b > 0
    both, used = (fa & fb).sum(1), np.maximum((fa | fb).sum(1), 1)
    same = ((a == b) & fa).sum(1)
    at = [np.clip(np.searchsorted(_LOADS, n / BUCKETS), 0, len(_LOADS) - 1) for n in (na, nb)]
    p = _COLLIDE[at[0], at[1]]
    return np.clip((same - both * p) / (1 - p), 0, None) / used, np.sqrt(0.24 / used)


class _Texts:
    """Texts of a slice that have enough words, with their shingles."""

    def __init__(self, texts: list[str], min_words: int, shingle: int):
        w = Words(texts)
        self.enough = np.flatnonzero(w.per_doc >= min_words)
        keys, self.counts = w.shingles(shingle)
        if len(self.enough) < len(texts):
            new = np.full(len(texts), -1, dtype=np.int64)
            new[self.enough] = np.arange(len(self.enough))
            doc = new[(keys >> U(44)).astype(np.int64)]
            keys = ((doc.astype(U) << U(44)) | (keys & U((1 << 44) - 1)))[doc >= 0]
        self.keys, self.counts, self.n = keys, self.counts[self.enough], len(self.enough)

    def class_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit names of each text's set of shingles (sums over mixed hashes)."""
        doc, h = (self.keys >> U(44)).astype(np.int64), self.keys & U((1 << 44) - 1)
        out = []
        for salt in _SALT[FUNCTIONS : FUNCTIONS + 2]:
            total = np.concatenate([[U(0)], np.cumsum(mix(h + salt), dtype=U)])
            ends = np.cumsum(self.counts)
            out.append(mix(total[ends] - total[ends - self.counts] + self.counts.astype(U)))
        return out[0], out[1]


def profiles(texts: DataFrame, min_words: int, shingle: int) -> DataFrame:
    """(row_id, c1, c2, n, sketch) of (row_id, title, description) rows with at least min_words words."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            words = joined(b.column(1), b.column(2))
            for lo, hi in slices(words):
                t = _Texts(words[lo:hi], min_words, shingle)
                if not t.n:
                    continue
                c1, c2 = t.class_ids()
                small = sketch(registers(t.keys, t.n, range(FUNCTIONS - 1, FUNCTIONS))[:, 0])
                cols = [b.column(0).slice(lo, hi - lo).take(pa.array(t.enough)), c1.view(np.int64), c2.view(np.int64), t.counts.astype(np.int32)]
                cols = [pa.array(c) if isinstance(c, np.ndarray) else c for c in cols]
                cols.append(pa.array([x.tobytes() for x in small], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["row_id", "c1", "c2", "n", "sketch"])

    return texts.mapInArrow(run, "row_id long, c1 long, c2 long, n int, sketch binary")


def _unsent(ids: np.ndarray, sent: np.ndarray) -> np.ndarray:
    """Rows of ids (two halves of the full class id) that come first with their id and are not in sent, which is sorted by
    the first half. Of several sent with one first half only one is looked at: the others are sent again, never left out."""
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    own = ids[order]
    first = np.sort(order[np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)])])
    if not len(sent):
        return first
    at = np.minimum(np.searchsorted(sent[:, 0], ids[first, 0]), len(sent) - 1)
    return first[(sent[at] != ids[first]).any(axis=1)]


def band_entries(texts: DataFrame, min_words: int, shingle: int, split: int) -> DataFrame:
    """(part, entries): packed (key, class) entries of every band, part = band * split + a piece of the key space.

    A task leaves out a class that it has sent before, so copies cost one entry a task and band.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.empty((0, 2), dtype=U)  # by the first half
        held: list[list[np.ndarray]] = [[] for _ in range(BUCKETS * split)]
        size = 0

        def flush() -> pa.RecordBatch:
            full = [(p, np.concatenate(es).tobytes()) for p, es in enumerate(held) if es]
            for es in held:
                es.clear()
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in full], pa.int32()), pa.array([e for _, e in full], pa.binary())], names=["part", "entries"])

        for b in parts:
            words = joined(b.column(1), b.column(2))
            for lo, hi in slices(words):
                t = _Texts(words[lo:hi], min_words, shingle)
                if not t.n:
                    continue
                ids = np.stack(t.class_ids(), axis=1)
                first = _unsent(ids, sent)
                if not len(first):
                    continue
                if len(sent) > 1_000_000:
                    sent = sent[:0]
                sent = np.concatenate([sent, ids[first]])
                sent = sent[np.argsort(sent[:, 0], kind="stable")]
                regs = densify(registers(t.keys, t.n)[first]).astype(U)
                cls = ids[first, 0]
                size += len(first) * BUCKETS * _ENTRY.itemsize
                for band in range(BUCKETS):
                    k = np.full(len(first), U(band + 1))
                    for f in range(FUNCTIONS):
                        k = mix(k + regs[:, f, band])
                    e = np.empty(len(first), dtype=_ENTRY)
                    e["key"], e["cls"] = (k >> U(32)), cls
                    piece = ((k & U(0xFFFFFFFF)) % U(split)).astype(np.int64)
                    if split == 1:
                        held[band].append(e)
                        continue
                    order = np.argsort(piece, kind="stable")
                    for p, own in zip(*_runs(piece[order])):
                        held[band * split + p].append(e[order[own[0] : own[1]]])
                if size >= HELD_BYTES:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return texts.mapInArrow(run, "part int, entries binary")


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Values of a sorted array and the range of each."""
    at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, dtype=np.int64)
    ends = np.append(at[1:], len(ordered))
    return ordered[at], list(zip(at.tolist(), ends.tolist()))


def _spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries of a part too large for one task under the cells (lo, hi) of pairs of salts of their classes."""
    for p in parts:
        for part, salts, packed in zip(p.part, p.salts, p.entries):
            e = np.frombuffer(packed, dtype=_ENTRY)
            salt = mix(e["cls"].astype(U)) % U(salts)
            for a in range(salts):
                own = e[salt == a].tobytes()
                cells = [(part, salts, min(a, b), max(a, b), own) for b in range(salts)] if own else []
                yield pd.DataFrame(cells, columns=["part", "salts", "lo", "hi", "entries"])


_MADE = "a long, b long, part int, lo int, hi int, key long, side int, at int, others int, ids binary"


def _band_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs (a, b) of classes under one key of a cell of a part; of a hot key, its classes in blocks of HOT.

    A block has its number `at`, the number of blocks that it meets, and a side: 0 or 1 where the two salts of a cell meet,
    2 where the blocks of one salt meet one another.
    """
    e = np.frombuffer(b"".join(rows.entries), dtype=_ENTRY)
    part, salts, lo, hi = (int(rows[k].iloc[0]) for k in ("part", "salts", "lo", "hi"))
    key, cls = e["key"].astype(U), e["cls"].astype(U)
    order = np.lexsort((cls, key))
    key, cls = key[order], cls[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])]) if len(key) else np.empty(0, dtype=bool)
    key, cls = key[new], cls[new]
    salt = mix(cls) % U(salts)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)
    size = np.diff(np.append(at, len(key)))
    a, b, blocks = [], [], []
    for n in np.unique(size[(size > 1) & (size <= 16)]):  # all groups of one small size at once
        own = at[size == n][:, None] + np.arange(n)
        i, j = np.triu_indices(n, 1)
        a.append(own[:, i].ravel())
        b.append(own[:, j].ravel())
    for s, n in zip(at[size > 16], size[size > 16]):
        if n <= HOT:
            i, j = np.triu_indices(n, 1)
            a.append(s + i)
            b.append(s + j)
            continue
        sides = [(2, cls[s : s + n])] if lo == hi else [(k, cls[s : s + n][salt[s : s + n] == v]) for k, v in ((0, lo), (1, hi))]
        many = [-(-len(own) // HOT) for _, own in sides]
        for (side, own), others in zip(sides, many[::-1]):
            blocks += [(part, lo, hi, int(key[s]), side, k, others, own[k * HOT : (k + 1) * HOT].tobytes()) for k in range(-(-len(own) // HOT))]
    a, b = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (a, b))
    if lo != hi:
        across = salt[a] != salt[b]
        a, b = a[across], b[across]
    whole = pd.DataFrame({"a": cls[a].astype(np.int64), "b": cls[b].astype(np.int64)})
    for k, v in (("part", part), ("lo", lo), ("hi", hi), ("key", 0), ("side", 0), ("at", 0), ("others", 0), ("ids", None)):
        whole[k] = v
    if not blocks:
        return whole
    more = pd.DataFrame(blocks, columns=["part", "lo", "hi", "key", "side", "at", "others", "ids"])
    return pd.concat([whole, more.assign(a=0, b=0)[whole.columns]]) if len(whole) else more.assign(a=0, b=0)[whole.columns]


def _met(made: DataFrame) -> DataFrame:
    """Pairs of classes of the blocks of hot keys: each pair of blocks that meet is a key of a join, so that no task has
    more than its share of them."""
    blocks = made.where("ids is not null")
    key = ["part", "lo", "hi", "key"]
    last = F.col("others") - 1
    left = blocks.where("side <> 1").select(*key, F.col("at").alias("l"), F.explode(F.sequence(F.when(F.col("side") == 2, F.col("at")).otherwise(0), last)).alias("r"), F.col("ids").alias("block_a"))
    right = blocks.where("side <> 0").select(*key, F.col("at").alias("r"), F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 2, F.col("at")).otherwise(last))).alias("l"), F.col("ids").alias("block_b"))

    def expand(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for x, y in zip(p.block_a, p.block_b):
                x, y = np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U)
                a, b = np.repeat(x, len(y)), np.tile(y, len(x))
                # a block that meets itself has every pair twice
                ok = a < b if np.array_equal(x, y) else a != b
                yield pd.DataFrame({"a": np.minimum(a, b)[ok].astype(np.int64), "b": np.maximum(a, b)[ok].astype(np.int64)})

    return left.join(right, [*key, "l", "r"]).select("block_a", "block_b").mapInPandas(expand, "a long, b long")


def candidates(texts: DataFrame, min_words: int, shingle: int, n_rows: int) -> DataFrame:
    """Distinct pairs (a < b) of first halves of class ids (as unsigned numbers) that share a band.

    Where there are so many rows that a part could outgrow a task, the parts' entries are counted and those of large parts
    are spread over pairs of salts of their classes.
    """
    split = max(1, math.ceil(n_rows / PART_ROWS))
    entries = band_entries(texts, min_words, shingle, split)
    one = [F.lit(k).alias(c) for k, c in ((1, "salts"), (0, "lo"), (0, "hi"))]
    if split == 1:  # a part has at most PART_ROWS entries
        entries = entries.select("part", *one, "entries")
    else:
        entries = cut(entries)
        size = entries.groupBy("part").agg(F.sum(F.octet_length("entries") / _ENTRY.itemsize).alias("n"))
        size = broadcast_if_small(cut(size.select("part", F.ceil(F.col("n") / (4 * PART_ROWS)).cast("int").alias("salts")).where("salts > 1")), 16)
        sized = entries.join(size, "part", "left")
        large = sized.where("salts is not null").select("part", "salts", "entries").mapInPandas(_spread, "part int, salts int, lo int, hi int, entries binary")
        entries = sized.where("salts is null").select("part", *one, "entries").unionByName(large)
    made = cut(entries.groupBy("part", "lo", "hi").applyInPandas(_band_pairs, _MADE))
    pairs = made.where("ids is null").select("a", "b")
    if not made.where("ids is not null").isEmpty():
        pairs = pairs.unionByName(_met(made))
    return pairs.distinct()


def _estimated(threshold: float):  # noqa: ANN202
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            if not b.num_rows:
                continue
            a, c = (np.frombuffer(b"".join(b.column(k).to_pylist()), dtype=np.uint8).reshape(-1, BUCKETS) for k in ("sketch_a", "sketch_b"))
            j, error = estimate(a, c, b.column("n_a").to_numpy(), b.column("n_b").to_numpy())
            keep = b.filter(pa.array(j >= threshold - 4 * error))
            yield pa.RecordBatch.from_arrays([keep.column(k) for k in ("a1", "a2", "b1", "b2")], names=["a1", "a2", "b1", "b2"])

    return run


def _verified(threshold: float, shingle: int):  # noqa: ANN202
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            left, right = joined(b.column("title_a"), b.column("description_a")), joined(b.column("title_b"), b.column("description_b"))
            both = [x for pair in zip(left, right) for x in pair]
            keep = []
            for lo, hi in slices([x + y for x, y in zip(left, right)]):
                keys, counts = Words(both[2 * lo : 2 * hi]).shingles(shingle)
                doc = keys >> U(44)
                pair = np.sort(((doc >> U(1)) << U(44)) | (keys & U((1 << 44) - 1)))
                twice = pair[1:][pair[1:] == pair[:-1]]
                shared = np.bincount((twice >> U(44)).astype(np.int64), minlength=hi - lo)
                union = counts[::2] + counts[1::2] - shared
                keep.append(shared / np.maximum(union, 1) >= threshold)
            if keep:
                ok = b.filter(pa.array(np.concatenate(keep)))
                yield pa.RecordBatch.from_arrays([ok.column(k) for k in ("a1", "a2", "b1", "b2")], names=["a1", "a2", "b1", "b2"])

    return run


_PAIR = "a1 long, a2 long, b1 long, b2 long"


def class_pairs(df: DataFrame, row_id: str, title: str, description: str, threshold: float, min_words: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(profiles, pairs): the classed rows (row_id, c1, c2) and the class pairs (a1, a2, b1, b2) at or above threshold."""
    texts = df.select(F.col(row_id).alias("row_id"), F.col(title).alias("title"), F.col(description).alias("description")).where("row_id is not null")
    rows = cut(profiles(texts, min_words, shingle))
    classes = rows.groupBy("c1", "c2").agg(F.min("row_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))

    def side(x: str) -> DataFrame:
        return classes.select(F.col("c1").alias(x), *[F.col(f"c{i}").alias(f"{x}{i}") for i in (1, 2)], F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))

    near = candidates(texts, min_words, shingle, rows.count()).join(side("a"), "a").join(side("b"), "b")
    sizes = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")
    likely = cut(near.where(sizes).drop("a", "b").mapInArrow(_estimated(threshold), _PAIR))

    # one text of each class that is still in question
    asked = likely.select(F.col("a1").alias("c1"), F.col("a2").alias("c2")).unionByName(likely.select(F.col("b1").alias("c1"), F.col("b2").alias("c2"))).distinct()
    asked = cut(asked.join(classes.select("c1", "c2", "rep"), ["c1", "c2"]))
    shown = broadcast_if_small(asked.withColumnRenamed("rep", "row_id"), 32)
    one = texts.join(shown, "row_id")

    def text(x: str) -> DataFrame:
        return one.select(*[F.col(f"c{i}").alias(f"{x}{i}") for i in (1, 2)], F.col("title").alias(f"title_{x}"), F.col("description").alias(f"description_{x}"))

    full = likely.join(text("a"), ["a1", "a2"]).join(text("b"), ["b1", "b2"])
    return rows.select("row_id", "c1", "c2"), cut(full.mapInArrow(_verified(threshold, shingle), _PAIR).distinct())


def near_pairs(
    df: DataFrame, row_id: str = "log_id", title: str = "title", description: str = "description",
    threshold: float = 0.6, min_words: int = 20, shingle: int = 3,
) -> DataFrame:
    """(id_a, id_b; id_a < id_b): rows with at least min_words words whose sets of `shingle` successive words have shared
    size / union size >= threshold, copies included.

    Null texts count as empty; rows with too few words or a null id have no pairs; an empty table gives none; repeated
    ids are not paired with themselves; other columns are ignored. Texts are read whole.
    """
    rows, pairs = class_pairs(df, row_id, title, description, threshold, min_words, shingle)
    k = _chunks(rows)
    # a class of several rows is near to itself
    own = rows.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n > 1").select(*[F.col(c).alias(x + c[1]) for x in "ab" for c in ("c1", "c2")])
    every = pairs.unionByName(own)
    for x in "ab":
        every = every.join(k.withColumnsRenamed({"c1": f"{x}1", "c2": f"{x}2", "k": f"k_{x}"}), [f"{x}1", f"{x}2"], "left")
        every = every.withColumn(f"s_{x}", F.explode(F.sequence(F.lit(0), F.coalesce(f"k_{x}", F.lit(1)) - 1))).drop(f"k_{x}")
    salted = _salted(rows, k)

    def member(x: str) -> DataFrame:
        return salted.select(F.col("row_id").alias(f"id_{x}"), F.col("c1").alias(f"{x}1"), F.col("c2").alias(f"{x}2"), F.col("salt").alias(f"s_{x}"))

    both = every.join(member("a"), ["a1", "a2", "s_a"]).join(member("b"), ["b1", "b2", "s_b"])
    itself = (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2"))
    both = both.where(F.when(itself, F.col("id_a") < F.col("id_b")).otherwise(F.col("id_a") != F.col("id_b")))
    return both.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def _chunks(rows: DataFrame) -> DataFrame:
    """(c1, c2, k), to be broadcast: into how many salts the rows of each large class are split.

    The chunk grows with the table so far that the large classes, each a chunk at least, always fit a broadcast.
    """
    chunk = max(CHUNK, rows.count() * 32 // BROADCAST_BYTES)
    sizes = rows.groupBy("c1", "c2").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    return F.broadcast(cut(sizes.select("c1", "c2", F.ceil(F.col("n") / chunk).cast("int").alias("k"))))


def _salted(rows: DataFrame, k: DataFrame) -> DataFrame:
    """rows with the salt of each."""
    salt = F.pmod(F.xxhash64("row_id"), F.coalesce("k", F.lit(1))).cast("int")
    return rows.join(k, ["c1", "c2"], "left").withColumn("salt", salt).drop("k")


def near_groups(
    df: DataFrame, row_id: str = "log_id", title: str = "title", description: str = "description",
    threshold: float = 0.6, min_words: int = 20, shingle: int = 3,
) -> DataFrame:
    """(row_id, class_id, links, group_id): one row for each row of df with enough words.

    class_id is the least row id with the same set of shingles, links the number of other classes at or above the
    threshold, group_id the least class id reachable over such links. Copies are not expanded into pairs.
    """
    rows, pairs = class_pairs(df, row_id, title, description, threshold, min_words, shingle)
    reps = cut(rows.groupBy("c1", "c2").agg(F.min("row_id").alias("rep")))
    end = lambda x: reps.select(F.col("c1").alias(f"{x}1"), F.col("c2").alias(f"{x}2"), F.col("rep").alias(x))
    edges = cut(pairs.join(end("a"), ["a1", "a2"]).join(end("b"), ["b1", "b2"]).select("a", "b"))
    links = edges.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    named = reps.join(links, "rep", "left").join(components(edges, "a", "b").withColumnRenamed("node", "rep"), "rep", "left")
    out = named.select("c1", "c2", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("group_id"))
    k = _chunks(rows)
    out = out.join(k, ["c1", "c2"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1))).drop("k")
    return _salted(rows, k).join(out, ["c1", "c2", "salt"]).select(F.col("row_id").alias(row_id), "class_id", "links", "group_id")
