import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from matchloom.operators import blocking, exhaustive, records


def best_of(rows, k):
    return sorted(rows, key=lambda r: (-round(r[1], 9), r[0]))[:k]


@pytest.mark.parametrize("first_look", [1, 8, 10**9])
def test_block_top_k_equals_all_sums(monkeypatch, first_look):
    """Frequent and rare tokens, short vectors with large weights, equal vectors, a token twice in a vector, vectors without a shared token."""
    monkeypatch.setattr(exhaustive, "FIRST_LOOK", first_look)
    r = random.Random(5)
    vector = lambda: [(f"t{int(300 * r.random() ** 4)}", r.choice((0.05, 0.2, 0.9))) for _ in range(r.randint(0, 9))]
    left, right = [vector() for _ in range(80)], [vector() for _ in range(300)]
    right[40:60] = [right[3]] * 20
    left[0], left[1] = right[3], [("unheard", 1.0)]
    arrays = lambda rows: (pa.array([[t for t, _ in v] for v in rows], pa.list_(pa.string())), pa.array([[w for _, w in v] for v in rows], pa.list_(pa.float64())))
    found = {i: list(zip(rows.tolist(), units.tolist(), strict=True)) for i, rows, units in exhaustive.block_top_k(arrays(left), exhaustive.Postings(*arrays(right)), 5)}
    for i, v in enumerate(left):
        sums = defaultdict(float)
        for j, other in enumerate(right):
            for t, w in other:
                for s, x in v:
                    if s == t:
                        sums[j] += w * x
        assert found.get(i, []) == [(j, int(np.floor(s * 10**9 + 0.5))) for j, s in best_of(sums.items(), 5)]


@pytest.mark.parametrize("blocks", [(131072, 65536), (17, 9)])
def test_top_k_over_all_keys_equals_all_pairs(spark, blocks):
    """Every word in many pool records, groups of equal names, two records of one id."""
    r = random.Random(3)
    words = "gale moor fen heath tarn beck dale".split()
    rows = [(f"S{2 if n % 3 else 1}-{n:03d}", " ".join(r.choices(words, k=r.randint(1, 3)))) for n in range(240)]
    rows += [("S2-001", "gale fen gill"), ("S1-000", "fen tarn"), ("S1-900", "unheard"), ("S1-901", "")]
    table = spark.createDataFrame([(i, n, "", "x", i[1] == "1") for i, n in rows], "entity_id string, business_name string, business_address string, country string, is_ref boolean")
    keyed = records.with_keys(records.prepare(table)).persist()
    vectors = {True: defaultdict(Counter), False: defaultdict(Counter)}
    for row in blocking.weights(keyed, blocking.NAME_KEYS).collect():
        vectors[row["is_ref"]][row["id"]][row["token"]] += row["w"]
    want = {}
    for i, v in vectors[True].items():
        sums = {j: sum(w * other[t] for t, w in v.items() if t in other) for j, other in vectors[False].items()}
        want |= {(i, n): j for n, (j, _) in enumerate(best_of([x for x in sums.items() if x[1]], 5), 1)}
    found = exhaustive.channel_top_k(keyed, blocking.NAME_KEYS, 5, pool_block=blocks[0], ref_block=blocks[1]).collect()
    assert len(found) == len(want) and {(x["i"], x["rank"]): x["j"] for x in found} == want
    assert exhaustive.channel_top_k(keyed, blocking.NAME_KEYS, 0).isEmpty()
    assert exhaustive.channel_top_k(keyed.where("is_ref"), blocking.NAME_KEYS, 5).isEmpty()


def test_best_threshold_counts_partners_that_share_frequent_keys_only(spark, tmp_path):
    """120 reference and 120 pool records of one text: every shared key is in more than 30 pool records."""
    text = " ".join(["one text that all of these records here hold"] * 2)
    ids = "explode(array(90 * id, 90 * id + 1)) as doc_id"
    spark.range(120).selectExpr(ids).selectExpr("doc_id", f"'{text}' as text", "'en' as lang", f"{len(text)}L as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    best = entry.queries()["best_threshold"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert best[0]["f05"] > 0.1 and [tuple(b) for b in best] == con.sql(entry.oracle_sql()["best_threshold"]).fetchall()
