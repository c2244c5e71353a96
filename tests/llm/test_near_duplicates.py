import random
import re

import numpy as np

from lodestar.llm import components, neardup
from lodestar.llm.wordhash import Words

ROWS = "log_id long, title string, description string, extra string"


def shingles(title, description, n=3, least=20):
    w = re.findall("[a-z0-9]+", f"{title or ''} {description or ''}".lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= least else None


def brute(rows, threshold=0.6):
    sets = [(i, shingles(t, d)) for i, t, d, *_ in rows]
    sets = [(i, s) for i, s in sets if s]
    return {(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if len(x & y) / len(x | y) >= threshold}


def corpus(seed, families=40):
    rng, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(3000)]
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.choice([20, 25, 60, 140]))]
        for _ in range(rng.randrange(1, 6)):
            edited = [rng.choice(words) if rng.random() < rng.choice([0, 0.02, 0.06, 0.12]) else w for w in base]
            rows.append((len(rows) + 1, "Title", " ".join(edited), "x"))
    return rows


def test_words_and_hashes_follow_the_definition():
    texts = ["É one-two  3x", "", "a", "ONE".lower() + " two"]
    w = Words(texts)
    assert [w.text(i) for i in range(len(w.hash))] == ["one", "two", "3x", "a", "one", "two"] and list(w.per_doc) == [3, 0, 1, 2]
    assert w.hash[0] == w.hash[4] and w.hash[1] == w.hash[5] and len(set(w.hash.tolist())) == 4


def test_pairs_match_brute_force(spark):
    rows = corpus(3)
    got = [(r.id_a, r.id_b) for r in neardup.near_pairs(spark.createDataFrame(rows, ROWS)).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got)) >= 0.98 * len(want) > 30


def test_copies_hot_bands_short_null_and_empty(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 4)
    base = [f"k{i}" for i in range(40)]
    rows = [(i, "t", " ".join(base), "x") for i in range(10)]
    rows += [(100 + i, None, " ".join([*base[:39], f"end{i}"]), "x") for i in range(25)]
    rows += [(200, None, None, "x"), (201, "", "", "x"), (202, "too few words", None, "x"), (203, None, " ".join(["same"] * 30), "x"), (204, "same", " ".join(["same"] * 22), "x")]
    df = spark.createDataFrame(rows, ROWS)
    got = {(r.id_a, r.id_b) for r in neardup.near_pairs(df).collect()}
    assert got == brute(rows) and (203, 204) in got
    groups = {r.log_id: r for r in neardup.near_groups(df).collect()}
    assert set(groups) == {*range(10), *range(100, 125), 203, 204}
    assert groups[9].class_id == 0 and groups[124].group_id == groups[9].group_id == 0 and groups[204].group_id == 203 and groups[203].links == 0


def test_large_parts_hot_keys_and_hot_classes_are_spread(spark, monkeypatch):
    rows = corpus(7, 15) + [(1000 + i, None, " ".join([f"k{j}" for j in range(39)] + [f"end{i % 30}"]), "x") for i in range(60)]
    df = spark.createDataFrame(rows, ROWS)
    plain = sorted((r.id_a, r.id_b) for r in neardup.near_pairs(df).collect())
    groups = sorted(map(tuple, neardup.near_groups(df).collect()))
    for name, value in (("PART_ROWS", 10), ("HOT", 3), ("CHUNK", 1), ("HELD_BYTES", 1000)):
        monkeypatch.setattr(neardup, name, value)
    assert sorted((r.id_a, r.id_b) for r in neardup.near_pairs(df).collect()) == plain and set(plain) <= brute(rows)
    assert sorted(map(tuple, neardup.near_groups(df).collect())) == groups


def test_no_rows(spark):
    assert neardup.near_pairs(spark.createDataFrame([], ROWS)).count() == 0


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        shared, own = rng.integers(1, 1 << 44, 120), rng.integers(1, 1 << 44, (2, 40))
        keys = [np.unique(np.concatenate([shared, o])).astype(np.uint64) for o in own]
        s = [neardup.sketch(neardup.registers(k, 1, range(1))[:, 0]) for k in keys]
        j, _ = neardup.estimate(s[0], s[1], np.array([160]), np.array([160]))
        errors.append(j[0] - 0.6)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.12


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (300, 200), (200, 300), (None, 1)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + k] == 100 for k in range(40)) and got[300] == 200
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_a_clash_of_class_ids_leaves_no_class_out():
    one, two = np.uint64(5), np.uint64(9)
    none = np.empty((0, 2), dtype=np.uint64)
    ids = np.array([[one, 1], [two, 1], [one, 2], [one, 1], [one | np.uint64(1 << 40), 1]], dtype=np.uint64)
    assert neardup._unsent(ids, none).tolist() == [0, 1, 2, 4]
    assert neardup._unsent(ids, ids[:1]).tolist() == [1, 2, 4]


def test_classes_that_clash_in_forty_bits_all_enter_bands(spark, monkeypatch):
    rows = corpus(5, 12)
    real = neardup._Texts.class_ids
    # every class has the same lower 40 bits
    monkeypatch.setattr(neardup._Texts, "class_ids", lambda self: ((real(self)[0] << np.uint64(40)), real(self)[1]))
    texts = [(i, t, d) for i, t, d, _ in rows]
    ids = set()
    import pyarrow as pa

    class Frame:
        def mapInArrow(self, run, schema):  # noqa: N802
            columns = [pa.array(list(c)) for c in zip(*texts)]
            return list(run(iter([pa.RecordBatch.from_arrays(columns, names=["row_id", "title", "description"])])))

    for b in neardup.band_entries(Frame(), 20, 3, 1):
        for e in b.column(1).to_pylist():
            e = np.frombuffer(e, dtype=neardup._ENTRY)
            ids |= set(zip(*[e[n].tolist() for n in e.dtype.names if n != "key"]))
    assert len(ids) == len({frozenset(shingles(t, d)) for _, t, d in texts if shingles(t, d)})
