import os
import random

import numpy as np
import pytest

from lodestar.llm import packing, tokens, truncation

needs_files = pytest.mark.skipif(not os.path.exists(tokens.default_path()), reason="no tokenizer files")
TEXTS = [
    "", None, " ", "Hello world", "don't ''s #'s 'sx we'll", "a  b   c\n\n d \t\t e ", "नमस्ते दुनिया 🐘🐘", "x" * 3000, "qzxq jqvk 1234567 ½", " 　 a b", "<|endoftext|>",
    "mixed\r\nline\r\n\r\n  ends", "…—’s ’s“", "é́ combining", "0 00 000", "\x00\x01 control",
]


@needs_files
def test_ids_equal_the_library_on_odd_and_random_texts(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "SLICE_BYTES", 500)
    rng = random.Random(3)
    pool = ["the", " ", "  ", "\n", "'", "'s", "'re", "q", "Z", "9", "é", "क", "ि", "🐘", " ", "　", "-", "#", "\t", "\x85", "ü", "ﬁ", "​", "."]
    texts = TEXTS + ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(600)]
    t = Tokenizer.from_file(os.path.join(os.path.dirname(tokens.default_path()), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in tokens.encode(df).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    sizes = {r.doc_id: r.n_tokens for r in tokens.count(df).collect()}
    assert sizes == {i: len(x) for i, x in got.items()}
    assert tokens.encode(df.limit(0)).count() == 0


def check_packing(rows, items, capacity):
    held, whole = {}, {}
    for r in rows:
        if r.size:
            held[r.container_id] = held.get(r.container_id, 0) + r.size
        whole.setdefault(r.doc_id, []).append((r.piece, r.start, r.size))
    assert all(n <= capacity for n in held.values()) and sorted(held) == list(range(len(held)))
    for i, n in items.items():
        own = sorted(whole[i])
        assert sum(s for _, _, s in own) == (n or 0) and (len(own) == 1) == ((n or 0) <= capacity)
        assert [p for p, _, _ in own] == list(range(len(own))) and all(st == p * capacity for p, st, _ in own)
    return len(held)


@pytest.mark.parametrize("seed", [1, 2])
def test_packing_is_whole_and_tight(spark, seed, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 40)
    rng = np.random.default_rng(seed)
    sizes = np.concatenate([rng.integers(1, 120, 600), np.full(300, 67), rng.integers(100, 700, 10)])
    items = {int(i): int(n) for i, n in enumerate(sizes)} | {5000: 0, 5001: None}
    df = spark.createDataFrame(list(items.items()), "doc_id long, n_tokens long")
    n = check_packing(packing.pack(df, "doc_id", "n_tokens", 200, rounds=60).collect(), items, 200)
    assert n <= np.ceil(sizes.sum() / 200) * 1.02 + 1


@pytest.mark.parametrize("times", [1, 10, 100, 10_000])
def test_the_program_packs_and_needs_no_more_than_best_fit(times):
    drawn = np.clip(np.random.default_rng(3).lognormal(3.2, 1.0, 3000), 1, 256).astype(np.int64)
    sizes, counts = np.unique(drawn, return_counts=True)
    counts = counts * times
    fills, left = packing.programmed(sizes, counts, 256)
    whole = fills + packing.best_fit(sizes, left, 256)
    assert (sum(f * n for f, n in whole) == counts).all() and all(f @ sizes <= 256 for f, _ in whole)
    n = sum(n for _, n in whole)
    assert sum(n for _, n in fills) >= 0.95 * n and n <= sum(n for _, n in packing.best_fit(sizes, counts, 256))


def test_prices_prove_a_bound_where_room_proves_less():
    sizes, counts = np.array([400, 700, 1100]), np.array([100, 300, 200])
    least, price = packing.prices(sizes, counts, 2048)
    best = max(packing.knapsack(sizes, counts, price, 2048) @ price, 1e-9)
    assert (sizes * counts).sum() / 2048 < 240 < price @ counts / best <= 260 and np.isclose(least, price @ counts / best)


def test_packing_of_little(spark):
    schema = "doc_id long, n_tokens long"
    assert packing.pack(spark.createDataFrame([], schema), "doc_id", "n_tokens", 10).count() == 0
    only = packing.pack(spark.createDataFrame([(1, 0), (2, None)], schema), "doc_id", "n_tokens", 10).collect()
    assert [r.container_id for r in only] == [None, None]
    big = packing.pack(spark.createDataFrame([(1, 35), (1, 35)], schema), "doc_id", "n_tokens", 10).collect()
    assert sorted(r.size for r in big) == [5, 5] + [10] * 6 and len({r.container_id for r in big}) == 7


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(40):
        sizes = np.sort(rng.choice(np.arange(1, 25), 4, replace=False))
        counts, worth = rng.integers(1, 4, 4), rng.random(4)
        grid = np.array(np.meshgrid(*[np.arange(c + 1) for c in counts])).reshape(4, -1).T
        fit = grid[grid @ sizes <= 30]
        assert np.isclose(packing.knapsack(sizes, counts, worth, 30) @ worth, (fit @ worth).max())


def documents():
    rng = random.Random(9)
    people, acts, goods, where = (w.split() for w in ("farmers potters weavers children dancers", "carry paint count gather mend", "baskets lamps drums nets carpets", "market river temple harbour school"))
    say = lambda: f"{rng.choice(people).title()} {rng.choice(acts)} {rng.choice(goods)} near the {rng.choice(where)} and {rng.choice(acts)} the {rng.choice(goods)}."
    rows, truth = [], set()
    for i in range(2400):
        source = ("wire", "feed", "desk")[i % 3]
        if i % 8 == 7:
            text = f"{rng.choice(people).title()} at the {rng.choice(where)} - wide shot"
        else:
            text = " ".join(say() for _ in range(rng.randrange(2, 14)))
            if rng.random() < 0.3:
                text += f"\nCompiled by the {rng.choice(goods).title()} unit"
            if rng.random() < 0.05:
                text = text.rstrip(".") + "..." if text.endswith(".") else text
            if source == "wire" and len(text) > 300:
                cut = text[:300]
                if cut.rstrip()[-1] not in ".t":
                    truth.add(i)
                text = cut
            elif source == "feed" and len(text) > 400:
                text = text[:399] + "…"
                truth.add(i)
            elif rng.random() < 0.03 and len(text) > 90:
                text = text[: rng.randrange(60, len(text) - 30)]
                if text.rstrip()[-1] not in ".":
                    truth.add(i)
        if source == "desk" and rng.random() < 0.3 and i not in truth:
            text += "\nPlease cite the desk of records when you use this."
        rows.append((i, text, source))
    return rows, truth


def test_cut_texts_are_found_on_held_out_forms(spark):
    rows, truth = documents()
    extra = [(9001, None, "wire"), (9002, "", "wire"), (9003, " \n ", None), (9004, "A whole sentence stands here.", None)]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, source string")
    scored = {r.doc_id: r.p for r in truncation.scored(df).collect()}
    assert set(scored) == {r[0] for r in rows} | {9004} and scored[9004] < 0.5
    got = {i for i, p in scored.items() if p >= 0.5}
    hit = len(got & truth)
    assert hit / len(truth) > 0.93 and hit / len(got) > 0.9
    report = {r.source: (r.texts, r.cut) for r in truncation.by_source(df).collect()}
    assert sum(n for n, _ in report.values()) == len(rows) + 1 and sum(c for _, c in report.values()) == len(got)


def test_truncation_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert truncation.truncated(df).count() == 0
    few = spark.createDataFrame([(1, "One short caption", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert truncation.truncated(few).count() == 0


def test_known_words_come_from_all_rows_and_whole_texts(spark):
    rows, _ = documents()
    rows += [(7000 + i, f"The qwtzabcd stands here. {'Potters mend nets near the river. ' * 120}", "wire") for i in range(3)]
    rows += [(8001, "Potters carry nets near the river. Dancers mend the qwtzabcd", "desk"), (8002, "Potters carry nets near the river. Dancers mend the pfvzabcd", "desk")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    p = {r.doc_id: r.p for r in truncation.scored(df, sample=600).collect()}
    assert p[8001] < p[8002]  # alike to the model but for the word
