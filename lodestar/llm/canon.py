"""Freely typed values mapped to the entries of a reference list (problem 6).

The list's names and its aliases form one trie. Runs of words of a value, as many as the longest name has, walk it as
Levenshtein automata (adjacent transpositions count one): a node keeps, for all runs of a batch at once, the row of edit
distances, and drops the runs whose least distance is over the limit. Every entry within the distance that its length
allows is a hit; the nearest decides, a region giving way to a named entry inside it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import cut

#: Names and aliases that one broadcast trie may hold; a longer list is searched in blocks of this size.
BLOCK_ENTRIES = 200_000
#: Words in a run at least (a name's word may be typed in parts; a run has one word more than the longest name), and runs
#: whose hits a task remembers.
RUN_WORDS, MEMO = 3, 400_000
#: Spellings of one sound or look-alike signs, applied in this order to names and values (fixed values).
FOLDS = (("0", "o"), ("1", "l"), ("w", "v"), ("q", "k"))
_LONG = re.compile(r"a{2,}|e{2,}|o{2,}")
_LONG_AS = {"a": "a", "e": "i", "o": "u"}
#: Words are runs of Latin letters and digits, or of those of other scripts with their marks.
_WORD = regex.compile(r"[a-z0-9]+|(?:(?![a-z0-9])[\p{L}\p{N}\p{M}])+")


def plain(text: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def fold(word: str) -> str:
    for a, b in FOLDS:
        word = word.replace(a, b)
    return _LONG.sub(lambda m: _LONG_AS[m.group()[0]], word)


def allowed(n: int) -> int:
    """Edits that a name of n folded letters allows."""
    return 0 if n < 6 else 1 if n < 8 else 2


class Trie:
    """Folded names as a trie; entry lists at the nodes where names end."""

    def __init__(self, entries: list[tuple[str, str]]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.entries = [(plain(name), key) for name, key in entries]
        self.deepest, self.nearest = [0], [1 << 30]
        for i, (name, _) in enumerate(self.entries):
            word = fold("".join(_WORD.findall(name)))
            if not word:
                continue
            node, path = 0, [0]
            for c in word:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][c] = nxt
                    self.children.append({})
                    self.ends.append([])
                    self.deepest.append(0)
                    self.nearest.append(1 << 30)
                node = nxt
                path.append(node)
            self.ends[node].append(i)
            for p in path:
                self.deepest[p] = max(self.deepest[p], len(word))
                self.nearest[p] = min(self.nearest[p], len(word))

    def search(self, words: list[str], cap: int = 2) -> list[list[tuple[int, int]]]:
        """For each folded word, every (distance, entry) within the distance that the entry's length allows, at most cap."""
        hits: list[list[tuple[int, int]]] = [[] for _ in words]
        by_len: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_len.setdefault(len(w), []).append(i)
        for m, at in by_len.items():
            for lo in range(0, len(at), 20_000):
                self._walk(np.array(at[lo : lo + 20_000]), words, m, hits, cap)
        return hits

    def _walk(self, at: np.ndarray, words: list[str], m: int, hits: list[list[tuple[int, int]]], cap: int) -> None:
        chars = np.array([[ord(c) for c in words[i]] for i in at], dtype=np.int32).reshape(len(at), m)
        along = np.arange(m + 1, dtype=np.int16)
        start = np.tile(along, (len(at), 1))
        # (node, its letter, depth, runs still alive, their row, the row above and the letter above)
        stack = [(n, c, 1, np.arange(len(at)), start, None, "") for c, n in self.children[0].items()]
        while stack:
            node, c, depth, alive, above, before, c_above = stack.pop()
            same = chars[alive] == ord(c)
            row = np.empty_like(above)
            row[:, 0] = depth
            row[:, 1:] = np.minimum(above[:, 1:] + 1, above[:, :-1] + ~same)
            if before is not None and m > 1:
                crossed = same[:, :-1] & (chars[alive][:, 1:] == ord(c_above))
                row[:, 2:] = np.minimum(row[:, 2:], np.where(crossed, before[:, :-2] + 1, 99))
            row = np.minimum.accumulate(row - along, axis=1) + along
            if self.ends[node]:
                ok = row[:, m] <= min(cap, allowed(depth))
                for i, d in zip(at[alive[ok]].tolist(), row[ok, m].tolist()):
                    hits[i] += [(d, e) for e in self.ends[node]]
            # of each cell, the letters that the word or every name below still has to gain
            short, deep = self.nearest[node] - depth, self.deepest[node] - depth
            most, left = min(cap, allowed(self.deepest[node])), m - along
            lack = np.maximum(0, np.maximum(left - deep, short - left)).astype(np.int16)
            # a transposition reaches back one row, where one letter more is left to match
            keep = ((row + lack).min(axis=1) <= most) | ((above + np.maximum(lack - 1, 0)).min(axis=1) < most)
            if not keep.any():
                continue
            for nxt_c, nxt in self.children[node].items():
                stack.append((nxt, nxt_c, depth + 1, alive[keep], row[keep], above[keep], c))


def distance(a: str, b: str) -> int:
    """Edit distance with adjacent transpositions."""
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, now[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            now.append(d)
        two, one = one, now
    return one[-1]


class Matcher:
    """Searches the values of batches in one trie and remembers the hits of runs."""

    def __init__(self, entries: list[tuple[str, str]]):
        self.trie = Trie(entries)
        several = [(name, key) for name, key in entries if len(_WORD.findall(plain(name))) > 1]
        self.several, self.at_several = Trie(several), [i for i, e in enumerate(entries) if e in set(several)]
        self.squashed = ["".join(_WORD.findall(name)) for name, _ in self.trie.entries]
        self.n_words = [len(_WORD.findall(name)) for name, _ in self.trie.entries]
        self.longest = max(map(len, self.squashed), default=0) + 2
        self.shortest = min((len(fold(s)) for s in self.squashed if s), default=0)
        self.most_words = max(RUN_WORDS, 1 + max(self.n_words, default=0))
        self.memo: dict[tuple[str, bool], list[tuple[int, int, int, str]]] = {}

    def runs(self, words: list[str]) -> list[tuple[int, int, str]]:
        out = []
        for n in range(1, self.most_words + 1):
            for i in range(len(words) - n + 1):
                run = "".join(words[i : i + n])
                if self.shortest - 2 <= len(run) <= 2 * self.longest:
                    out.append((i, i + n, run))
        return out

    def learn(self, runs: set[tuple[str, bool]]) -> None:
        """Search new runs; words that we joined, not the name, leave one edit only, so that is all that is looked for."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = [r for r in runs if r not in self.memo]
        self.memo.update(dict.fromkeys(new, ()))
        for joined in (False, True):
            own = [(r, f) for r in new if r[1] == joined and len(f := fold(r[0])) <= self.longest]
            found = self.trie.search([f for _, f in own], 1 if joined else 2)
            if joined and self.at_several:
                for hits, more in zip(found, self.several.search([f for _, f in own])):
                    hits += [(d, self.at_several[e]) for d, e in more if d > 1]
            for (r, _), hits in zip(own, found):
                if hits:
                    self.memo[r] = [(d, distance(r[0], self.squashed[e]), e, self.trie.entries[e][1]) for d, e in hits]

    def hits(self, values: list[str]) -> list[list[tuple[int, int, int, int, str]]]:
        """For each value its (distance, distance as typed, from word, to word, key) hits."""
        split = [self.runs(_WORD.findall(plain(v))) for v in values]
        self.learn({(r, hi - lo > 1) for runs in split for lo, hi, r in runs})
        out = []
        for runs in split:
            own = []
            for lo, hi, run in runs:
                for d, typed, e, key in self.memo[run, hi - lo > 1]:
                    # words that were merged by us, not by the name, leave one edit only
                    if d <= 1 or hi - lo <= max(1, self.n_words[e]):
                        own.append((d, typed, lo, hi, key))
            out.append(own)
        return out


def choose(hits: list[tuple[int, int, int, int, str]], region_of: dict[str, str]) -> str | None:
    """The key of the nearest hit (then as typed, then the longest run, then the first, then by key); if that is a region
    and another hit outside its words lies in the region, the nearest of those."""
    if not hits:
        return None
    order = lambda h: (h[0], h[1], h[2] - h[3], h[2], h[4])
    best = min(hits, key=order)
    if best[4] not in region_of:
        inside = [h for h in hits if region_of.get(h[4]) == best[4] and (h[3] <= best[2] or h[2] >= best[3])]
        if inside:
            best = min(inside, key=order)
    return best[4]


def map_values(values: DataFrame, names: DataFrame, regions: DataFrame, unmatched: str = "unmatched") -> DataFrame:
    """(record_kind, record_id, key) of each non-blank (record_kind, record_id, value).

    names (name, key) holds the reference entries and their aliases, regions (key, region) the region entry in which an
    entry lies. Null and blank values are left out, values that name no entry come out as `unmatched`, repeated rows come
    out as often as they come in. A list of more than BLOCK_ENTRIES names is searched block by block; the blocks' hits on a
    row, with the region of each, are merged before one is chosen.
    """
    spark = values.sparkSession
    names = names.where("name is not null and key is not null").select("name", "key").distinct()
    n_blocks = -(-max(names.count(), 1) // BLOCK_ENTRIES)
    values = values.select("record_kind", "record_id", "value").where(r"value is not null and value rlike '(?U)\\S'")
    # rows are told apart by a number that is written down, as their ids may repeat
    values = values if n_blocks == 1 else cut(values.withColumn("row", F.monotonically_increasing_id()))
    found = []
    for block in range(n_blocks):
        own = names if n_blocks == 1 else names.where(F.pmod(F.xxhash64("key"), F.lit(n_blocks)) == block)
        keys = own.select("key").distinct()
        rows = own.collect()  # at most about BLOCK_ENTRIES names
        inside = {r.key: r.region for r in regions.join(keys, "key", "left_semi").where("region is not null and region <> key").select("key", "region").collect()}
        shared = spark.sparkContext.broadcast((sorted((r.name, r.key) for r in rows), inside))

        def run(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            entries, region_of = shared.value
            matcher = Matcher(entries)
            for p in parts:
                hits = matcher.hits(p.value.tolist())
                yield pd.DataFrame({"record_kind": p.record_kind, "record_id": p.record_id, "key": [choose(h, region_of) for h in hits]})

        def hits_of(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            entries, region_of = shared.value
            matcher = Matcher(entries)
            for p in parts:
                hits = [(row, *h, region_of.get(h[4])) for row, own in zip(p.row, matcher.hits(p.value.tolist())) for h in own]
                yield pd.DataFrame(hits, columns=["row", "d", "typed", "start", "stop", "key", "region"])

        if n_blocks == 1:
            out = values.mapInPandas(run, "record_kind string, record_id long, key string")
        else:
            found.append(values.select("row", "value").mapInPandas(hits_of, "row long, d int, typed int, start int, stop int, key string, region string"))
    if n_blocks > 1:
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        fields = ("d", "typed", "start", "stop", "key", "region")
        merged = every.groupBy("row").agg(F.collect_list(F.struct(*fields)).alias("h")).select("row", *[F.col(f"h.{x}").alias(x) for x in fields])

        def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                chosen = [choose(list(zip(*h)), {k: r for k, r in zip(h[4], g) if r is not None}) for *h, g in zip(*[p[x] for x in fields])]
                yield pd.DataFrame({"row": p.row, "key": chosen})

        out = values.join(merged.mapInPandas(best, "row long, key string"), "row", "left")
    return out.select("record_kind", "record_id", F.coalesce("key", F.lit(unmatched)).alias("key"))
