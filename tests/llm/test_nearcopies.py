"""The near-duplicate stage against brute force over five-word shingles."""

import time

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from test_text_operators import docs_of, words_of

from skyfix.llm import nearcopies

SF = "/root/testdata/sf0.001"


def kept_ids(rows, similarity=0.8):
    sets = []
    for _, text in rows:
        w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= similarity * len(a | b) - 1e-9:
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted(low.values())


def test_stage_removes_near_copies_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert got == kept_ids([(r.doc_id, r.text) for r in docs.collect()])
    assert not {177, 145} & set(got)  # 0.83 similar to 1 and 6, more than 3 bits apart


@pytest.mark.parametrize("wide", [0, 3, nearcopies.WIDE])
def test_stage_matches_brute_force(spark, wide):
    rng = np.random.default_rng(wide)
    draw = lambda n: [f"w{i}" for i in rng.integers(0, 3000, n)]
    line, base, rows = draw(12), draw(140), [(1, None), (2, ""), (3, "one two"), (4, "ONE two"), (5, "x " * 300)]
    for i in range(120):
        w = list(base) if i % 2 else draw(int(rng.integers(3, 90)))
        for j in rng.integers(0, len(w), int(rng.integers(0, 6)) if i % 2 else 0):
            w[j] = draw(1)[0]
        rows.append((10 + i, " ".join(w + line if i % 3 == 0 else w)))
    rows += [(500 + i, t.upper()) for i, (_, t) in enumerate(rows[7:20])]
    got = nearcopies.near_copies(docs_of(spark, [(i, t, "a") for i, t in rows]), wide=wide).collect()
    low = {}
    for r in got:
        low[r.root] = min(low.get(r.root, r.row.doc_id), r.row.doc_id)
    assert sorted(low.values()) == kept_ids(rows)


def test_prefixes_take_no_longer_for_more_frequent_shingles():
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 5000, 60)).encode() for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(range(600)), pa.array(texts)], ["doc_id", "text_hash", "text"])
    sets = list(nearcopies.shingle_sets(batch.column("text"), 5))
    own = np.concatenate([s[::3] for s in sets])  # frequent ones that the texts hold, and as many as there may be
    last = np.unique(np.concatenate([own, rng.integers(0, 2**63, nearcopies.MOST, dtype=np.uint64) * 2]))
    began = time.process_time()
    got = [np.array(x, np.int64).view(np.uint64) for out in nearcopies._scan_prefixes(5, 0.8, last)(iter([batch])) for x in out.column("prefix").to_pylist()]
    assert time.process_time() - began < 2  # 8 ms a text before
    for prefix, s in zip(got, sets, strict=True):
        late = np.isin(s, last)
        assert late.any() and (prefix == np.concatenate([s[~late], s[late]])[: nearcopies._prefix(len(s), 0.8)]).all()
    assert not nearcopies.among(sets[0], last[:0]).any()
