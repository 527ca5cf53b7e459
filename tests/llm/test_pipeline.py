"""run() against a plain-Python version of every stage (the toxicity scores are the model's own)."""

import hashlib
import re

import corpus_pipeline
from test_nearcopies import kept_ids
from test_text_operators import held_items, words_of

from skyfix.llm import toxicity

SF = "/root/testdata/sf0.001"


def one_of_each_group(rows):
    kept = set(kept_ids([(r["doc_id"], r["text"]) for r in rows]))
    return [r for r in rows if r["doc_id"] in kept]


def masked(text):
    return re.sub(r'(?i)(token = ")[0-9a-f]{40}(?=")', r"\1[SECRET]", text)


def fair_targets(sizes):
    order = sorted(sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        level = (1.5 * sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over


def mixed(rows):
    size = {r["doc_id"]: len(words_of(r["text"])) for r in rows}
    total = {}
    for r in rows:
        total[r["source"]] = total.get(r["source"], 0) + size[r["doc_id"]]
    target, out = fair_targets(total), {}
    for s in total:
        passes = int(target[s] // total[s])
        left = target[s] - passes * total[s]
        own = sorted((int(hashlib.md5(f"{r['doc_id']}\n{r['text']}".encode()).hexdigest()[:14], 16), r["doc_id"]) for r in rows if r["source"] == s)
        used, open_ = 0, True
        for _, d in own:
            used += size[d]
            open_ = open_ and used <= left
            out[d] = (s, passes + open_, size[d])
    return {d: v for d, v in out.items() if v[1] > 0}


def test_run_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score >= toxicity.THRESHOLD}
    rows = sorted((r.asDict() for r in docs.collect() if r.doc_id not in toxic), key=lambda r: r["doc_id"])
    rows = one_of_each_group(rows)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {d for d, _ in held_items([(r["doc_id"], r["text"], "") for r in rows], items)}
    rows = [r | {"text": masked(r["text"])} for r in rows if r["doc_id"] not in leaks]
    wanted = mixed(rows)
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.source, r.copies, r.size) for r in out} == wanted
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert all(r.text == texts[r.doc_id] for r in out)


def test_stages_keep_the_columns_and_survive_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _of string, found int"
    rows = [(1, None, None, None, None, "a", 1), (None, "x y z", "en", "s", 5, "b", 2), (2, "", "en", "s", 0, "c", 3), (3, "word " * 5000, "en", "s", 25000, "d", 4), (3, "word " * 5000, "en", "s", 25000, "d", 4)]
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == frame.columns
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert {"doc_id", "size", "target", "taken"} <= set(out.columns)
        assert out.count() >= 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash-near-dedup", "benchmark-decontamination", "secret-scans", "mixing"]
