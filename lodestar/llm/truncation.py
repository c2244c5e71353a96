"""Texts that were cut off before their end (problem 9).

A hashed logistic regression tells cut texts from whole ones. It is trained on a bounded sample: texts that look whole are
the negatives, and copies of them, cut at random places and at their source's length limits with the marks that such cuts
leave, the positives. The features are closing characters and words, punctuation, the shape of the last line, and the
distance of the length from a limit of the source. Limits (lengths that are far too frequent in a source), the marks left at
them, footers (lines that a source repeats) and known words are counted over all rows; every row is scored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.lines import frequent_lines, keyed_lines
from lodestar.session import BROADCAST_BYTES, cut

#: Rows in the training sample, hashed weights, passes over the sample, and rounds of dropping negatives that look cut.
SAMPLE, WEIGHTS, EPOCHS, ROUNDS = 20_000, 1 << 18, 12, 2
#: A length is a limit of a source if so many distinct texts, and this share of the source's, have it.
LIMIT_ROWS, LIMIT_SHARE = 4, 0.015
#: Marks put after a break, and marks that end a sentence.
MARKS = ("[...]", "[…]", "(...)", "...", "…", "\N{REPLACEMENT CHARACTER}")
STOPS = ".!?।॥。！？"
CLOSERS = "\"'»”’)]*_"
#: Texts that a known word stands in, and counts that a task holds before it passes them on.
KNOWN_TEXTS, HELD = 3, 200_000
#: Last characters of a sampled text that serve to learn from.
LEARNT = 6000
_TAIL = 400
#: Words that stand before another word or a stop are whole.
_WHOLE = re.compile(r"\w+(?=[.!?।,;:]|\W+\w)")
_DIGITS, _TOKEN = re.compile(r"\d+"), re.compile(r"[^\W_]+|[^\w\s]|_")


def shape(token: str) -> str:
    """Digits as 0; words as their case."""
    if token.isdigit():
        return "0"
    if token.isalpha():
        return "Aa" if token[:1].isupper() and token[1:].islower() else "A" if token.isupper() else "a"
    return token


def unmarked(text: str) -> tuple[str, str, str]:
    """A text without the white space at its end, the mark of a cut there, and the text before it."""
    core = text.rstrip()
    mark = next((m for m in MARKS if core.endswith(m)), "")
    return core, mark, core[: len(core) - len(mark)].rstrip() if mark else core


def last_word(text: str) -> str:
    return re.search(r"(\w*)\W*$", unmarked(text)[2].rstrip(CLOSERS)[-40:]).group(1).lower()


def features(text: str, n_chars: int, limits: tuple[int, ...], is_known: bool) -> list[str]:
    """Names of the active features of a text (footers already left out) of n_chars characters in the source's form, and
    whether its last word is known."""
    core, mark, body = unmarked(text)
    glued = bool(mark) and not core[: len(core) - len(mark)][-1:].isspace()
    end = body[-1:]
    bare = body.rstrip(CLOSERS)
    kind = "stop" if bare[-1:] and bare[-1:] in STOPS else "letter" if end.isalpha() else "digit" if end.isdigit() else end or "none"
    lines = [x for x in body[-_TAIL:].split("\n") if x.strip()]
    last = lines[-1].strip() if lines else ""
    tokens = _TOKEN.findall(last)
    one = "one" if "\n" not in body.strip() else "many"
    word = last_word(text)
    near = [x - n_chars for x in limits if 0 <= x - n_chars <= 4]
    limit = "at" if 0 in near else "near" if near else "no"
    opening = " ".join(shape(t) if t[:1].islower() or t.isdigit() else t for t in tokens[:1])
    hashtags = sum(t == "#" for t in tokens)
    lead = "#" if hashtags and hashtags * 2 >= len(tokens) else "0:0" if re.match(r"\d+:\d+", last) else opening if len(lines) > 1 and len(tokens) < 30 else ""
    stops = "s" if re.search(rf"[{re.escape(STOPS)}]\s", body[-_TAIL:]) else "-"
    size = len(tokens)
    long = "xs" if size < 4 else "s" if size < 9 else "m" if size < 16 else "l"
    known = "known" if is_known else "new"
    here = f"{kind}|{mark}|{limit}"
    base = [
        "bias", f"kind={kind}", f"mark={mark}", f"limit={limit}", f"here={here}", f"glued={mark}{glued}{kind}", f"one={one}|{stops}|{here}",
        f"form={one}|{stops}|{long}|{kind}", f"lead={lead}|{kind}", f"lead2={lead}|{kind}|{known}|{limit}", f"known={known}|{kind}", f"c1={end}",
        f"c2={body[-2:]}|{kind}", f"c3={body[-3:]}", f"c4={body[-4:]}", f"word={word}|{kind}", f"leadword={lead}|{word}", f"caption={one}|{stops}|{known}|{kind}",
        f"last2={'_'.join(t.lower() for t in tokens[-2:])}", f"comma={lead}|{tokens[-2] if len(tokens) > 1 else ''}|{kind}",
    ]
    return [_DIGITS.sub("0", x) for x in base]


def hashed(names: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(n.encode("utf-8", "surrogatepass")) % WEIGHTS for n in names], dtype=np.int64)


class Model:
    """Logistic regression over hashed features with a fixed number of active features a row."""

    def __init__(self) -> None:
        self.w = np.zeros(WEIGHTS, dtype=np.float32)
        self.w[hashed(["bias"])] = -5  # unfitted, it calls every text whole

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> None:
        rng, g2 = np.random.default_rng(seed), np.full(WEIGHTS, 1e-6)
        w = np.zeros(WEIGHTS)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), 256):
                i = order[lo : lo + 256]
                p = 1 / (1 + np.exp(-w[x[i]].sum(1)))
                g = np.bincount(x[i].ravel(), np.repeat(p - y[i], x.shape[1]), WEIGHTS)
                on = np.unique(x[i])
                g = g[on] / len(i) + 1e-5 * w[on]
                g2[on] += g * g
                w[on] -= 0.3 * g / np.sqrt(g2[on])
        self.w = w.astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.w[x].sum(1, dtype=np.float64)))


def cuts(text: str, limits: tuple[int, ...], habits: dict[int, str], rng: np.random.Generator) -> tuple[str, int] | None:
    """A cut copy of an intact text and its length, or None where the text gives none: cuts after a whole sentence or line
    and single lines without a sentence (captions, headings) leave nothing unfinished that could be seen."""
    if not re.search(rf"[{re.escape(STOPS)}]", text) and "\n" not in text.strip():
        return None
    fits = [x for x in limits if x < len(text)]
    if fits and rng.random() < 0.5:
        at = int(rng.choice(fits))
        mark = habits.get(at, "")
        part, n = text[: at - len(mark)] + mark, at
    else:
        if len(text) < 30:
            return None
        at = int(rng.integers(max(20, len(text) // 10), len(text)))
        mark = "" if rng.random() < 0.8 else str(rng.choice(MARKS))
        if mark == "...":
            mark = ""
        line = text[text.rfind("\n", 0, at) + 1 : (text.find("\n", at) + 1 or len(text) + 1) - 1].rstrip()
        if line.rstrip(CLOSERS)[-1:] not in STOPS and not (text[at - 1].isalnum() and text[at : at + 1].isalnum()):
            return None  # lists, credits and keywords are as complete after any of their words
        part = text[:at] + mark
        n = len(part)
    body = part[: len(part) - len(mark)] if mark else part
    bare = body.rstrip().rstrip(CLOSERS)
    if not re.search(rf"[{re.escape(STOPS)}]", body) and "\n" not in body.strip():
        return None
    if bare[-1:] in STOPS or text[len(body) : len(body) + 1] in ("\n", "\r", "") or body.rstrip(" \t") != body and body.endswith("\n"):
        return None
    return part, n


def source_limits(df: DataFrame, source: str, text: str) -> DataFrame:
    """(src, n): lengths of far too many distinct texts of a source, counted over all rows; copies count once."""
    rows = df.select(F.coalesce(F.col(source), F.lit("")).alias("src"), F.length(text).alias("n"), F.xxhash64(text).alias("h")).where("n > 0")
    by_len = rows.distinct().groupBy("src", "n").agg(F.count("*").alias("rows"))
    total = by_len.groupBy("src").agg(F.sum("rows").alias("total"))
    around = Window.partitionBy("src").orderBy("n").rangeBetween(-20, 20)
    peak = by_len.withColumn("near", F.sum("rows").over(around)).join(total, "src")
    often = (F.col("rows") >= LIMIT_ROWS) & (F.col("rows") >= LIMIT_SHARE * F.col("total")) & (F.col("rows") * 3 >= F.col("near"))
    return peak.where(often).select("src", "n")


def prepared(df: DataFrame, row_id: str, source: str, text: str) -> DataFrame:
    """(row_id, src, n_chars, body, limits): texts without the footers that their source repeats, with its limits."""
    rows = df.select(F.col(row_id).alias("row_id"), F.coalesce(F.col(source), F.lit("")).alias("src"), F.col(text).alias("text"))
    rows = rows.where(r"text is not null and text rlike '(?U)\\S'")
    limits = _sized(cut(source_limits(df, source, text).groupBy("src").agg(F.sort_array(F.collect_list("n")).alias("limits"))), "limits", 4)
    lines = _sized(
        cut(
            frequent_lines(df.withColumn(source, F.coalesce(source, F.lit(""))), source, text, min_letters=12, min_rows=5, min_share=0.04)
            .groupBy("src").agg(F.collect_list(F.struct("h1", "h2")).alias("footers"))
        ), "footers", 24,
    )
    rows = rows.join(limits, "src", "left").join(lines, "src", "left")
    kept = F.transform(F.filter(keyed_lines(F.col("text")), lambda x: ~F.array_contains(F.col("footers"), x["h"])), lambda x: x["line"])
    body = F.when(F.col("footers").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return rows.select("row_id", "src", F.length("text").alias("n_chars"), body.alias("body"), F.coalesce("limits", F.array().cast("array<int>")).alias("limits"))


def _sized(lists: DataFrame, column: str, item_bytes: int) -> DataFrame:
    """Lists by source, marked for broadcast if their items and keys, counted, are small."""
    size = lists.agg(F.coalesce(F.sum(F.size(column) * item_bytes + F.octet_length("src") + 64), F.lit(0)).alias("n")).first().n
    return F.broadcast(lists) if size <= BROADCAST_BYTES else lists


def drawn(src: str, n: int, body: str, row_id: object) -> int:
    """A 30-bit number that decides whether a row is in the sample; equal ids are told apart by their texts."""
    return zlib.crc32(f"{row_id}|{src}|{n}|".encode("utf-8", "surrogatepass") + body.encode("utf-8", "surrogatepass")) >> 2


_COUNTED = "kind int, src string, n int, word string, texts long, limits array<int>"


def counted(rows: DataFrame, below: int) -> DataFrame:
    """(kind, src, n, word, texts, limits) of one pass over all prepared rows, whole bodies read.

    Kind 0: in how many texts of a part of the rows each whole word stands; kind 1: how many of them end in a mark (word)
    at their source's limit n; kind 2: the rows whose drawn number is less than `below`, word being their body (its last
    LEARNT characters) and texts the number.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        ends: Counter = Counter()

        def flush() -> pd.DataFrame:
            kinds = [0] * len(words) + [1] * len(ends)
            out = pd.DataFrame(
                {"kind": kinds, "src": [None] * len(words) + [k[0] for k in ends], "n": pd.array([None] * len(words) + [k[1] for k in ends], dtype="Int32"),
                 "word": [*words, *(k[2] for k in ends)], "texts": [*words.values(), *ends.values()], "limits": None}
            )
            words.clear()
            ends.clear()
            return out

        for p in parts:
            picked = []
            for i, s, n, b, ls in zip(p.row_id, p.src, p.n_chars, p.body, p.limits):
                words.update(set(_WHOLE.findall(b.lower())))
                if n in ls:
                    ends[s, int(n), unmarked(b)[1]] += 1
                if (draw := drawn(s, n, b, i)) < below:
                    picked.append((2, s, int(n), b[-LEARNT:], draw, ls))
                if len(words) + len(ends) >= HELD:
                    yield flush()
            if picked:
                yield pd.DataFrame(picked, columns=["kind", "src", "n", "word", "texts", "limits"])
        if words or ends:
            yield flush()

    return rows.select("row_id", "src", "n_chars", "body", "limits").mapInPandas(run, _COUNTED)


def train(
    sample: pd.DataFrame, marks: dict[tuple[str, int], str], known: Callable[[set[str]], set[str]], rounds: int = ROUNDS, seed: int = 11
) -> Model:
    """Fit the model on a bounded sample of prepared rows (src, n_chars, body, limits); marks has what a source leaves at a
    limit, known gives the known ones of some words."""
    rng = np.random.default_rng(seed)
    sample = sample.reset_index(drop=True)
    if not len(sample):
        return Model()
    limits = [tuple(int(v) for v in x) for x in sample.limits]
    bodies, lengths = sample.body.tolist(), sample.n_chars.tolist()
    at_limit = np.array([n in x for n, x in zip(lengths, limits)], dtype=bool)
    marked = np.array([any(b.rstrip().endswith(m) for m in MARKS if m != "...") for b in bodies], dtype=bool)
    whole = np.flatnonzero(~at_limit & ~marked)
    every = sorted({(s, x) for s, ls in zip(sample.src, limits) for x in ls})
    by_source: dict[str, dict[int, str]] = {}
    for s, x in every:
        by_source.setdefault(s, {})[x] = marks.get((s, x), "")
    sources = list(by_source)
    copies: dict[int, tuple[str, int, tuple[int, ...]]] = {}
    for i in whole:
        for _try in range(3):
            # half of the copies are cut as another source would cut them
            s = sample.src[i] if rng.random() < 0.5 or not sources else sources[int(rng.integers(len(sources)))]
            own = by_source.get(s, {})
            if copy := cuts(bodies[i], tuple(own), own, rng):
                copies[int(i)] = (*copy, tuple(own))
                break
    words = known({last_word(b) for b in bodies} | {last_word(c[0]) for c in copies.values()})
    x = np.array([hashed(features(b, n, ls, last_word(b) in words)) for b, n, ls in zip(bodies, lengths, limits)]).reshape(len(bodies), -1)
    made = {i: hashed(features(*c, last_word(c[0]) in words)) for i, c in copies.items()}
    model = Model()
    fold = rng.integers(0, 3, len(bodies))
    for last in [False] * rounds + [True]:
        pos = [int(i) for i in whole if int(i) in made]
        if not pos:
            return model
        if last:
            xs = np.concatenate([x[whole], np.array([made[i] for i in pos])])
            model.fit(xs, np.repeat([0.0, 1.0], [len(whole), len(pos)]))
            break
        # some negatives are cut in truth: those that a model of the other rows calls cut are left out
        keep = np.ones(len(whole), dtype=bool)
        for k in range(3):
            own, rest = fold[whole] == k, whole[fold[whole] != k]
            others = [i for i in pos if fold[i] != k]
            if own.any() and len(rest) and others:
                judge = Model()
                judge.fit(np.concatenate([x[rest], np.array([made[i] for i in others])]), np.repeat([0.0, 1.0], [len(rest), len(others)]), epochs=8)
                keep[own] = judge.score(x[whole[own]]) < 0.5
        whole = whole[keep] if keep.any() else whole
    return model


def scored(df: DataFrame, row_id: str = "doc_id", source: str = "source", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(row_id, src, p): the chance that each non-blank text is cut.

    Null, empty and blank texts are not cut and have no row; a null source is a source of its own; repeated rows are scored
    each; without texts to learn from every text counts as whole. Texts of any length are read whole for footers, lines
    and words; what decides lies at their end.
    """
    spark = df.sparkSession
    rows = prepared(df, row_id, source, text)
    every = cut(counted(rows, int((1 << 30) * min(1.0, sample / max(1, df.count())))))
    words = every.where("kind = 0").groupBy("word").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= KNOWN_TEXTS).select("word")
    words = cut(words)
    learnt = every.where("kind = 2").select("src", F.col("n").alias("n_chars"), F.col("word").alias("body"), "limits", F.col("texts").alias("draw"))
    learnt = learnt.orderBy("draw", "src", "n_chars", "body").limit(2 * sample).toPandas()

    def known(some: set[str]) -> set[str]:
        asked = spark.createDataFrame([(w,) for w in sorted(some)], "word string")
        return {r.word for r in words.join(F.broadcast(asked), "word", "left_semi").collect()}

    own = spark.createDataFrame([(s,) for s in sorted(set(learnt.src))], "src string")
    # the commonest mark of each limit of the sampled sources; the least of equals
    ends = every.where("kind = 1").join(F.broadcast(own), "src", "left_semi").groupBy("src", "n", "word").agg(F.sum("texts").alias("texts"))
    best = ends.groupBy("src", "n").agg(F.min(F.struct(-F.col("texts"), F.col("word").alias("mark"))).alias("m"))
    marks = {(r.src, r.n): r.m.mark for r in best.collect()}
    model = train(learnt, marks, known)

    size = words.agg(F.coalesce(F.sum(F.octet_length("word") + 80), F.lit(0)).alias("n")).first().n
    listed = frozenset(r.word for r in words.collect()) if size <= BROADCAST_BYTES else None
    shared = spark.sparkContext.broadcast((model, listed))
    if listed is None:  # too many words to send to every task: a join tells which last words are known

        @F.pandas_udf("string")
        def ending(bodies: pd.Series) -> pd.Series:
            return bodies.map(last_word)

        rows = rows.withColumn("word", ending("body")).join(words.withColumn("known", F.lit(True)), "word", "left").drop("word")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, listed = shared.value
        for p in parts:
            if len(p):
                known = [last_word(b) in listed for b in p.body] if listed is not None else p.known.notna()
                x = np.array([hashed(features(b, n, tuple(ls), bool(k))) for b, n, ls, k in zip(p.body, p.n_chars, p.limits, known)])
                yield pd.DataFrame({"row_id": p.row_id, "src": p.src, "p": model.score(x)})

    kind = df.schema[row_id].dataType.simpleString()
    out = rows.mapInPandas(run, f"row_id {kind}, src string, p double")
    return out.select(F.col("row_id").alias(row_id), "src", "p")


def truncated(df: DataFrame, row_id: str = "doc_id", source: str = "source", text: str = "text", least: float = 0.5) -> DataFrame:
    """(row_id) of the rows whose text is cut off."""
    return scored(df, row_id, source, text).where(F.col("p") >= least).select(row_id)


def by_source(df: DataFrame, row_id: str = "doc_id", source: str = "source", text: str = "text", least: float = 0.5) -> DataFrame:
    """(source, texts, cut, share): non-blank texts of each source and how many of them are cut off."""
    hit = F.sum((F.col("p") >= least).cast("long"))
    out = scored(df, row_id, source, text).groupBy("src").agg(F.count("*").alias("texts"), hit.alias("cut"))
    return out.select(F.col("src").alias(source), "texts", "cut", F.round(F.col("cut") / F.col("texts"), 6).alias("share"))
