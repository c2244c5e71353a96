import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodestar.llm import canon, lines, terms

ROWS = "log_id long, title string, description string, channel_title string, n string"


def brute_lines(rows):
    key = lambda x: "".join(c for c in x.lower() if c.isalpha())
    total, seen = Counter(), defaultdict(set)
    for i, _, d, ch, _ in rows:
        if d is not None and ch is not None:
            total[ch] += 1
            for x in d.split("\n"):
                if len(key(x)) >= 12:
                    seen[ch, key(x)].add(i)
    hot = {k for k, ids in seen.items() if len(ids) >= 5 and len(ids) >= 0.08 * total[k[0]]}
    return {(i, n) for i, _, d, ch, _ in rows if d is not None and ch is not None for n, x in enumerate(d.split("\n"), 1) if (ch, key(x)) in hot}


def line_rows():
    rng, rows = random.Random(1), []
    foot = ["All rights RESERVED here!", "© Subscribe to the channel", "short", "सभी अधिकार सुरक्षित रखे गए हैं यहाँ"]
    for i in range(300):
        own = [f"line {rng.choice('abcdef')} about {rng.randrange(60)} {'x' * rng.randrange(12)}" for _ in range(rng.randrange(4))]
        own += [rng.choice([f, f.upper(), f"** {f} **"]) for f in foot if rng.random() < 0.3]
        own += own[-1:] * (rng.random() < 0.2)
        rows.append((i, "t", rng.choice([None, "", "\n".join(own), "\r\n".join(own)] + ["\n".join(own)] * 4), rng.choice([None, "A", "A", "A", "B", "c"]), "x"))
    return rows


def test_repeated_lines_match_brute_force(spark):
    rows = line_rows()
    df = spark.createDataFrame(rows, ROWS)
    want = brute_lines(rows)
    got = [(r.log_id, r.line_no) for r in lines.removable(df, "log_id", "channel_title", "description").collect()]
    assert sorted(got) == sorted(want) and len(want) > 50
    clean = {r.log_id: r.description for r in lines.without_frequent(df, "log_id", "channel_title", "description").collect()}
    for i, _, d, _, _ in rows:
        assert clean[i] == (None if d is None else "\n".join(x for n, x in enumerate(d.split("\n"), 1) if (i, n) not in want))


def test_many_frequent_lines_are_joined_under_salts(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_BYTES", 0)
    test_repeated_lines_match_brute_force(spark)


def test_lines_of_no_rows(spark):
    assert lines.removable(spark.createDataFrame([], ROWS), "log_id", "channel_title", "description").count() == 0


def test_term_counts_match_brute_force_and_ids_are_unique(spark, monkeypatch):
    monkeypatch.setattr(terms, "BLOCK_TERMS", 50)
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", "Ünder The Kelvin K x1"]), rng.choice([None, " ".join(f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.randrange(90)))]), "c", "x") for i in range(400)]
    rows += [(1000 + i, "hot hot", None, "c", "x") for i in range(200)] + [(2000, "y" * 300_000, "z " * 50_000, "c", "x")]
    occ, rec = Counter(), Counter()
    for _, t, d, *_ in rows:
        w = [x for x in re.findall("[a-z0-9]+", f"{t or ''} {d or ''}".lower()) if len(x) > 1]
        occ.update(w)
        rec.update(set(w))
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    got = terms.mark_terms(terms.term_counts(df), len(rows)).collect()
    assert {r.term: (r.occurrences, r.records) for r in got} == {t: (n, rec[t]) for t, n in occ.items()}
    assert len({r.term_id for r in got}) == len(got)
    for r in got:
        want = "rare" if occ[r.term] < 5 or rec[r.term] < 3 else "common" if rec[r.term] > 0.15 * len(rows) else None
        assert r.mark == want
    assert terms.term_counts(spark.createDataFrame([], ROWS)).count() == 0


ENTRIES = [("Tushagiri", "tushagiri"), ("Old Arvotal", "old arvotal"), ("Nermelipatam", "nermelipatam"), ("Nermelpiatam", "nermelpiatam"), ("Rudimbaganj", "rudimbaganj"),
           ("nermukapani", "pilvokramandal"), ("Pilvokramandal", "pilvokramandal"), ("Gurumnawadi", "gurumnawadi"), ("Goa", "goa")]
CASES = {
    "Winter birds in Tooshagiri": "tushagiri", "TUSHAGEERI!": "tushagiri", "Tush-agiri fort": "tushagiri", "O1d Arvotal": "old arvotal", "OldArvotal": "old arvotal",
    "Nermélipatam": "nermelipatam", "nermelpiatam's": "nermelpiatam", "Village wrestling, Nerm Ukapani": "pilvokramandal", "River ferries in Gurumnawadi - Rudimbaganj": "gurumnawadi",
    "Rudimbaganj (Gurumjawadi)": "gurumnawadi", "Enrmelipatab": "nermelipatam", "school yard and rowers": "unmatched", "goal": "unmatched", "Goa": "goa", "🎬": "unmatched",
}


def test_titles_find_their_entries(spark):
    values = spark.createDataFrame([("k", i, t) for i, t in enumerate(CASES)] + [("k", 90, None), ("k", 91, "   "), ("k", 0, next(iter(CASES)))], "record_kind string, record_id long, value string")
    names = spark.createDataFrame(ENTRIES, "name string, key string")
    regions = spark.createDataFrame([("gurumnawadi", "rudimbaganj")], "key string, region string")
    got = canon.map_values(values, names, regions).collect()
    assert len(got) == len(CASES) + 1
    assert {r.record_id: r.key for r in got} == dict(enumerate(CASES.values()))


def test_blocks_of_the_list_give_the_same(spark, monkeypatch):
    values = spark.createDataFrame([("k", i, t) for i, t in enumerate(CASES) if "Rudimbaganj" not in t], "record_kind string, record_id long, value string")
    names = spark.createDataFrame(ENTRIES, "name string, key string")
    none = spark.createDataFrame([], "key string, region string")
    whole = {r.record_id: r.key for r in canon.map_values(values, names, none).collect()}
    monkeypatch.setattr(canon, "BLOCK_ENTRIES", 3)
    assert {r.record_id: r.key for r in canon.map_values(values, names, none).collect()} == whole
    assert canon.map_values(values.limit(0), names, none).count() == 0
    assert {r.key for r in canon.map_values(values, names.limit(0), none).collect()} == {"unmatched"}


def test_trie_finds_what_brute_force_finds():
    rng = random.Random(8)
    names = sorted({"".join(rng.choice("bgr") for _ in range(rng.randrange(5, 13))) for _ in range(150)})
    trie = canon.Trie([(n, n) for n in names])
    asked = ["".join(rng.choice("bgr") for _ in range(rng.randrange(1, 15))) for _ in range(300)] + names[:50]
    for cap in (1, 2):
        for w, hits in zip(asked, trie.search(asked, cap)):
            want = {(canon.distance(w, n), i) for i, n in enumerate(names) if canon.distance(w, n) <= min(cap, canon.allowed(len(n)))}
            assert set(hits) == want, w


def test_hot_value_is_one_key_only(spark):
    values = spark.range(3000).select(F.lit("k").alias("record_kind"), F.col("id").alias("record_id"), F.lit("in Tushagiri").alias("value"))
    names = spark.createDataFrame(ENTRIES, "name string, key string")
    got = canon.map_values(values, names, spark.createDataFrame([], "key string, region string")).groupBy("key").count().collect()
    assert [tuple(r) for r in got] == [("tushagiri", 3000)]


def test_blocks_keep_cities_tie_breaks_and_repeated_rows(spark, monkeypatch):
    texts = [*CASES, *CASES]
    values = spark.createDataFrame([("k", i % len(CASES), t) for i, t in enumerate(texts)], "record_kind string, record_id long, value string")
    names = spark.createDataFrame(ENTRIES, "name string, key string")
    regions = spark.createDataFrame([("gurumnawadi", "rudimbaganj")], "key string, region string")
    count = lambda: Counter((r.record_id, r.key) for r in canon.map_values(values, names, regions).collect())
    whole = count()
    assert sum(whole.values()) == 2 * sum(bool(t and t.strip()) for t in CASES)
    for size in (1, 2, 3):
        monkeypatch.setattr(canon, "BLOCK_ENTRIES", size)
        assert count() == whole


def test_long_names_and_other_scripts_are_found(spark):
    cases = {"Trams at Old Fort Road Junction": "junction", "trams, OldFort Road Juncton": "junction", "Market in पटना": "patna", "पटनाmarket": "patna", "पटन market": "unmatched", "Old Fort": "unmatched", "At Saint-Étienne du Bois le Petit": "bois"}
    names = [("Old Fort Road Junction", "junction"), ("पटना", "patna"), ("Saint Etienne du Bois le Petit", "bois")]
    values = spark.createDataFrame([("k", i, t) for i, t in enumerate(cases)], "record_kind string, record_id long, value string")
    got = canon.map_values(values, spark.createDataFrame(names, "name string, key string"), spark.createDataFrame([], "key string, region string")).collect()
    assert {r.record_id: r.key for r in got} == dict(enumerate(cases.values()))
