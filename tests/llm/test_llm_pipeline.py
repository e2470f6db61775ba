"""The pipeline on the smallest tables: each stage against a brute-force version of its decision on its own input."""

import collections
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from matchloom.llm import simhash, suffix_dedup, toxicity
from matchloom.llm.common import documents, materialize
from tests.llm.test_llm_operators import slow_spans

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    found = [documents(spark, SMALL)]
    for _, stage in corpus_pipeline.STAGES:
        found.append(materialize(stage(spark, found[-1], SMALL)))
    return found


def by_id(docs):
    return {r["doc_id"]: r for r in docs.collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[1:-1])
    for s in stages[1:-1]:
        assert s.count() == s.select("doc_id").distinct().count()


def test_toxicity_stage(spark, stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    labels = collections.defaultdict(int)
    for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect():
        if r["doc_id"] in before and r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            labels[r["doc_id"]] = max(labels[r["doc_id"]], r["toxic"])
    order = sorted(labels, key=lambda i: (zlib.crc32(str(i).encode()), i))
    model = toxicity.train([toxicity.excerpt(before[i]["text"] or "") for i in order], [labels[i] for i in order])

    def score(text):
        words = [sum(model.evidence[i] for i in grams) / len(grams) for grams in map(toxicity.ngram_ids, re.findall(r"\w+", text.lower()))]
        windows = [sum(words[k:k + 8]) / 8 + model.bias for k in range(0, max(1, len(words) - 4), 4)]
        return 1 / (1 + np.exp(-(model.slope * max(windows) + model.shift)))

    assert {i: r["text"] for i, r in after.items()} == {i: r["text"] for i, r in before.items() if score(r["text"] or "") < 0.7}


def test_simhash_stage(stages):
    before, after = by_id(stages[1]), by_id(stages[2])
    prints = {i: int.from_bytes(simhash.fingerprint((r["text"] or "").encode()), "big") for i, r in before.items()}
    least = dict.fromkeys(prints)
    for i in sorted(prints):
        if least[i] is None:
            reached, todo = {i}, [i]
            while todo:
                a = todo.pop()
                near = {b for b in prints if b not in reached and (prints[a] ^ prints[b]).bit_count() <= 3}
                reached |= near
                todo += near
            least.update(dict.fromkeys(reached, i))
    assert sorted(after) == sorted(set(least.values())) and all(after[i]["text"] == before[i]["text"] for i in after)
    assert len(after) < len(before)


def test_suffix_stage(stages):
    before, after, n = by_id(stages[2]), by_id(stages[3]), suffix_dedup.PASSAGE
    data = {i: (r["text"] or "").encode() for i, r in before.items()}
    seen = collections.Counter(d[k:k + n] for d in data.values() for k in range(len(d) - n + 1))
    changed = 0
    for i, d in data.items():
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - n + 1):
            if seen[d[k:k + n]] > 1:
                gone[k:k + n] = True
        at, kept = 0, ""
        for c in before[i]["text"] or "":
            size = len(c.encode())
            kept += "" if gone[at:at + size].all() else c
            at += size
        assert after[i]["text"] == kept and after[i]["n_chars"] == len(kept)
        changed += kept != before[i]["text"]
    assert changed and sorted(after) == sorted(before)


def test_secrets_stage(stages):
    before, after = by_id(stages[3]), by_id(stages[4])
    assert sorted(after) == sorted(before)
    for i, r in before.items():
        out, at = "", 0
        for a, b, *_ in slow_spans(r["text"]):
            if a >= at:
                out += r["text"][at:a] + "[secret]"
            at = max(at, b)
        assert after[i]["text"] == out + r["text"][at:]  # the chains add no span in these tables
    assert any("[secret]" in r["text"] for r in after.values())


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, sequences = {}, collections.defaultdict(list)
    for i, r in by_id(stages[4]).items():
        ids = np.array([*library.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, k, s): (len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))}
    packed = stages[5].collect()
    assert {(r["doc_id"], r["piece"], r["start"]): (r["length"], r["ids_crc32"]) for r in packed} == want and len(packed) == len(want)
    for r in packed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in map(sorted, sequences.values()):
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(parts[-1]) <= 4096
    assert len(sequences) == -(-sum(n for n, _ in want.values()) // 4096)


def test_run_is_the_stages_in_turn(spark, stages):
    key = lambda d: sorted(tuple(r) for r in d.select("doc_id", "piece", "length", "ids_crc32").collect())
    assert key(corpus_pipeline.run(spark, SMALL)) == key(stages[-1])


def test_stages_keep_rows_of_null_ids_and_texts(spark):
    schema = documents(spark, SMALL).schema
    words = ["".join(chr(97 + (7 * k + j * j) % 26) for j in range(3 + k % 5)) for k in range(400)]
    texts = [" ".join(words[a:a + 60]) for a in (0, 100, 200, 300)]
    docs = spark.createDataFrame([(None, texts[0], "en", "s", 1), (None, texts[1], None, None, None), (5, texts[2], "en", "s", 2), (None, None, "en", "s", 3)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SMALL))
        assert sorted(r["text"] or "" for r in docs.collect()) == sorted(["", *texts[:3]]), name
        empty = stage(spark, docs.limit(0), SMALL)
        assert empty.count() == 0 and empty.columns == schema.names
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).where("doc_id is null").count() == 3
