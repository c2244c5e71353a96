"""Words and word shingles of whole Arrow batches as numpy arrays, without a loop over words.

A word is a maximal run of a-z and 0-9 in the lower-cased text. All texts of a batch are laid end to end as bytes; word
borders come from a byte-class table, and 64-bit word hashes from one running sum of byte * B**position (mod 2**64).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U(pow(int(_BASE), -1, 1 << 64))
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True
#: Texts are handled in slices of about this many characters, which bounds memory whatever the batch holds.
SLICE_CHARS = 1_000_000

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.cumprod(np.concatenate([[U(1)], np.full(max(n, 1 << 21) - 1, base, dtype=U)]), dtype=U)
        _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """The words of a list of texts, in order: document index, byte span and hash of each."""

    def __init__(self, texts: list[str]):
        self.n_docs = len(texts)
        # a line feed is no word character, so no word crosses from one text into the next
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = b"\n".join([b"", *parts, b""])
        self.raw = raw
        data = np.frombuffer(raw, dtype=np.uint8)
        ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
        word = _IS_WORD[data]
        step = np.diff(word.astype(np.int8))
        self.start = np.flatnonzero(step == 1) + 1
        self.end = np.flatnonzero(step == -1) + 1
        self.doc = np.searchsorted(ends, self.start, side="left")
        powers = _power(_BASE, "b", len(data))
        sums = np.concatenate([[U(0)], np.cumsum((data.astype(U) + U(1)) * powers, dtype=U)])
        back = _power(_BASE_INV, "i", len(data))
        self.hash = mix((sums[self.end] - sums[self.start]) * back[self.start] + (self.end - self.start).astype(U))
        self.per_doc = np.bincount(self.doc, minlength=self.n_docs)

    def text(self, i: int) -> str:
        return self.raw[self.start[i] : self.end[i]].decode("ascii")

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted (document << 44 | 44-bit hash) of the distinct n-word shingles, and how many each document has.

        The hash is used inside one document or pair of documents only, where 44 bits tell all shingles apart.
        """
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.empty(0, dtype=U), np.zeros(self.n_docs, dtype=np.int64)
        h = np.zeros(m, dtype=U)
        for k in range(n):
            h = mix(h + self.hash[k : k + m] + U(k + 1))
        whole = self.doc[:m] == self.doc[n - 1 :]
        doc = self.doc[:m][whole]
        keys = np.sort((doc.astype(U) << U(44)) | (h[whole] >> U(20)))
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
        return keys, np.bincount((keys >> U(44)).astype(np.int64), minlength=self.n_docs)


def joined(title: pa.Array, description: pa.Array) -> list[str]:
    """Lower-cased title + ' ' + description; null counts as empty."""
    return [f"{t or ''} {d or ''}".lower() for t, d in zip(title.to_pylist(), description.to_pylist())]


def slices(texts: list[str]) -> list[tuple[int, int]]:
    """Ranges of texts of about SLICE_CHARS characters each; a longer text is alone in its range."""
    out, at, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE_CHARS:
            out.append((at, i))
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        out.append((at, len(texts)))
    return out
