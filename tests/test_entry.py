import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
NAMES = ["key_sets", "block_name_topk", "pair_set_features", "best_threshold", "output_issues", "pair_string_ratios", "sample_and_split", "tsv_round_trip", "candidate_file"]


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "part"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    frame = entry.queries()[name](spark, SMALL)
    columns = sorted(frame.columns)
    want = con.sql(f"select {', '.join(f'"{c}"' for c in columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in frame.collect()))) == sorted(map(repr, want))


def test_production_candidates_are_not_pruned_like_the_compared_ones(spark):
    small, full = ({tuple(r) for r in entry.queries()[n](spark, SMALL).select("i", "j").collect()} for n in ("candidate_pairs", "candidate_pairs_production"))
    assert len(full) > len(small) and {i for i, _ in small} <= {i for i, _ in full}
