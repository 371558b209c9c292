"""Each stage of the pipeline against a plain version of its rule, on the smallest tables."""

import re

from tokenizers import Tokenizer

import corpus_pipeline
from pacegrid.llm import quality, tokens, toxicity

ROOT = "/root/testdata/sf0.001"


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    labels = spark.read.parquet(f"{ROOT}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    before = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    model = quality.fit(docs, labels)
    scores = quality.Scorer(model.margins(), float(model.bias[1] - model.bias[0]))(list(before.values()))
    kept = docs
    want = {d for d, s in zip(before, scores) if s >= 0.5}

    def after(name):
        nonlocal kept
        kept = spark.createDataFrame(stages[name](spark, kept, ROOT).collect(), docs.schema)
        assert kept.columns == docs.columns
        return {r["doc_id"] for r in kept.select("doc_id").collect()}

    assert after("quality") == want
    matcher = toxicity.Matcher(toxicity.fit(docs, labels))
    want = {d for d in want if matcher.score(before[d]) < 0.7}
    assert after("toxicity") == want
    ids, sets = sorted(want), {d: shingles(before[d]) for d in want}
    root = {d: d for d in ids}
    moved = True
    while moved:
        moved = False
        for a in ids:
            for b in ids:
                if root[a] < root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[b], moved = root[a], True
    want = {d for d in ids if root[d] == d}
    assert after("near_duplicates") == want
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [words(r["text"]) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]

    def leaks(text):
        w = f" {' '.join(words(text))} "
        return any(i and f" {' '.join(i)} " in w for i in items)

    leaky = {d for d in want if leaks(before[d])}
    left = after("decontamination")
    assert left == want - leaky
    rows = stages["packing"](spark, kept, ROOT).toPandas()
    t = Tokenizer.from_file(tokens.default_vocabulary())
    total = {d: len(t.encode(before[d], add_special_tokens=False).ids) + 1 for d in left}
    assert rows.groupby("doc_id")["length"].sum().to_dict() == total
    assert rows.groupby("sequence_id")["length"].sum().max() <= 4096
    assert rows["sequence_id"].nunique() <= -(-sum(total.values()) // 4096) + 1
