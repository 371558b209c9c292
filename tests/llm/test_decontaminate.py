"""Recall of the seeds by item length and substitutions, and odd rows of the decontamination."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacegrid.llm import decontaminate as D


def hashes(words):
    return D.word_hash(list(words))


def plain_overlaps(doc, item, share=0.5, rate=0.2, run=13, least=8):
    """(offset, start, length) of every diagonal with a run of the rule, by trying all runs."""
    out, n = set(), len(item)
    need = min(run, max(np.ceil(share * n - 1e-9), D.whole(np.array(n), rate, least)))
    for offset in range(-n + 1, len(doc)):
        a, b = max(0, offset), min(len(doc), offset + n)
        same = [doc[p] == item[p - offset] for p in range(a, b)]
        best = max((j - i for i in range(len(same)) for j in range(i + 1, len(same) + 1) if same[i] and same[j - 1] and same[i:j].count(False) <= rate * (j - i) + 1e-9), default=0)
        if best >= need:
            out.add((offset, best))
    return out


@pytest.mark.parametrize("n", [*range(1, 26), 30, 35, 40])
def test_recall_by_length_and_substitutions(n):
    """Every planted item that a search of all diagonals finds is found, whatever words are substituted."""
    rng = np.random.default_rng(n)
    vocabulary = np.array([f"w{k}" for k in range(5000)])
    for subs in range(0, int(0.2 * n) + 1):
        for _ in range(10):
            item = rng.choice(vocabulary, n, replace=False)
            changed = item.copy()
            changed[rng.choice(n, subs, replace=False)] = "zz"
            doc = [*rng.choice(vocabulary, 20), *changed, *rng.choice(vocabulary, 20)]
            seeds = D.Seeds([(7, " ".join(item))])
            found = {(d, k, n_words) for d, k, at, n_words, s in seeds.overlaps([hashes(doc)], 0.5, 0.2, 13, 8)}
            want = {(0, 0, best) for _, best in plain_overlaps(doc, item.tolist())}
            assert found == want


def test_parts_of_long_items_and_gaps(spark):
    rng = np.random.default_rng(3)
    words = [f"v{k}" for k in range(900)]
    item = [str(x) for x in rng.choice(words, 59, replace=False)]
    noise = lambda k: " ".join(rng.choice([f"n{i}" for i in range(500)], k))
    texts = [
        (1, f"{noise(30)} {' '.join(item[10:35])} {noise(30)}"),
        (2, f"{noise(9)} {' '.join([*item[:20], 'in', 'between', *item[20:40], 'more', *item[40:]])}"),
        (3, f"{noise(30)} {' '.join(item[10:18])} {noise(30)}"),
        (None, " ".join(item)), (4, None), (4, ""), (5, " ".join(item)), (5, " ".join(item)), (6, noise(60_000) + " " + " ".join(item) + " " + noise(60_000)),
    ]
    docs = spark.createDataFrame([(*t, "x", 1) for t in texts], "doc_id long, text string, item_id string, start int")
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (None, " ".join(item[:30])), (9, None), (8, " ... ")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_overlaps"] for r in D.contaminated(docs, bench).collect()}
    assert set(got) == {(d, i) for d in (1, 2, None, 5, 6) for i in (1, None)}
    assert got[(5, 1)] == 4 and got[(2, 1)] == 6 and got[(6, None)] == 1
    left = D.clean(docs, bench)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 4]
    assert D.contaminated(docs.limit(0), bench).count() == 0 and D.clean(docs, bench.limit(0)).count() == len(texts)


def test_one_repeated_word_is_bounded():
    doc, item = hashes(["a"] * 5_000), " ".join(["a"] * 300)
    found = D.Seeds([(1, item)]).overlaps([doc], 0.5, 0.2, 13, 8)
    assert len(found) == 5_000 + 300 - 1 - 2 * 12


def test_ties_of_one_longest_run(spark):
    df = spark.createDataFrame([(1, " ".join(["k0 k1 k2 k3 k4 k5 k6 k7 k8 k9"] * 2))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "k0 k1 k2 k3 k4 k5 k6 k7 k8 k9")], "item_id long, text string")
    r = D.contaminated(df, bench).first()
    assert (r["start"], r["n_words"], r["n_overlaps"]) == (0, 10, 2)
    assert D.overlaps(df.withColumn("start", F.lit(3)), bench).count() == 2
