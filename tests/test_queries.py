"""A few registered queries against their oracles on the smallest tables, if these are at hand."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"
NAMES = ("p4_found", "p5_found", "term_df", "bm25_topk", "dedupe_first", "facets_subject", "zones", "merge_upsert", "structural_score", "decade_histogram",
         "search_full", "search_collisions", "index_build", "place_covers", "rails", "watch_page", "classify_whole_titles", "seeded_sample", "gazetteer_merge", "clip_cards", "p4_regions", "p5_kept",
         "integrity_violations")


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, name):
    import duckdb

    import __spark_entry__ as e

    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    df = e.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    r = c.execute(e.oracle_sql()[name])
    at = [x[0] for x in r.description]
    assert sorted(at) == cols
    flat = lambda v: round(float(v), 6) if isinstance(v, float) or v.__class__.__name__ == "Decimal" else v
    want = sorted(repr(tuple(flat(x[at.index(k)]) for k in cols)) for x in r.fetchall())
    assert sorted(repr(tuple(flat(x[k]) for k in cols)) for x in df.collect()) == want
