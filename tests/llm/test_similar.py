"""The pipeline's near-copy stage against all pairs at a five-word Jaccard similarity of 0.8."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pacegrid.llm import simhash, similar


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def stay(rows):
    """The ids of the smallest document of each component."""
    sets, root, moved = {d: shingle_set(t) for d, t in rows}, {d: d for d, _ in rows}, True
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while moved:
        moved = False
        for a, b in near:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                moved = True
    return {d for d, r in root.items() if r == d}


@pytest.mark.parametrize("tile", [3, 4096])
def test_near_copies_with_changed_words_go(spark, tile):
    rng, rows = np.random.default_rng(5), []
    for k in range(6):
        base = rng.choice([f"w{x}" for x in range(500)], 200)
        for changes in (0, 1, 2, 3, 4, 5, 6, 9):
            made = base.copy()
            made[rng.choice(200, changes, replace=False)] = "zz"
            rows.append((len(rows) * 7 % 1009, " ".join(made)))
    rows += [(2000, ""), (2001, None), (2002, "three short words"), (2003, "three  SHORT words"), (2004, "other short words")]
    df = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").repartition(3)
    want = stay(rows)
    assert len(want) < 30
    kept = [r["doc_id"] for r in similar.keep_one(df, tile=tile).collect()]
    assert len(kept) == len(want) + 1 and set(kept) == want | {None}
    if tile == 4096:
        staged = corpus_pipeline.drop_near_duplicates(spark, df, "")
        assert {r["doc_id"] for r in staged.collect()} == want | {None}


def test_many_groups_at_a_wide_budget(spark):
    rng = np.random.default_rng(6)
    f = sorted({int(x) for x in rng.integers(-(1 << 62), 1 << 62, 500)} | {k << 40 for k in range(40)})
    links = simhash.near_links(spark.createDataFrame([(x,) for x in f], "fp long").coalesce(1), 12).select("a", "b").collect()
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1) for r in links)
    u = np.array(f, np.int64).view(np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None]) <= 12, 1))
    root = {x: x for x in f}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def parts(pairs):
        root.update({x: x for x in f})
        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return [find(x) for x in f]

    assert parts((r["a"], r["b"]) for r in links) == parts((f[a], f[b]) for a, b in zip(i, j))


def test_odd_rows_and_clashing_columns(spark):
    long = " ".join(f"w{k % 4001}" for k in range(60_000))
    rows = [(1, long, "a"), (2, long + " tail", "b"), (3, None, "c"), (3, None, "c"), (4, " ", "d"), (None, long, "e"), (5, "one", "f"), (6, "ONE", "g"), (7, "one two", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string").withColumns({"g": F.lit(1), "size": F.lit(None).cast("int"), "stays": F.lit(0)})
    kept = similar.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"] or 0), r["node"]) for r in kept.collect()) == [(0, "e"), (1, "a"), (3, "c"), (3, "c"), (5, "f"), (7, "h")]
    assert similar.keep_one(df.limit(0)).count() == 0


def test_wide_fingerprint_is_the_majority():
    rng = np.random.default_rng(7)
    for n in (1, 2, 255, 256, 700, 40_000):
        h = rng.integers(0, 1 << 63, n, np.uint64)
        keys = np.random.default_rng(17).integers(1, 1 << 63, (2, 3), np.uint64) | np.uint64(1)
        x = h[:, None] * keys[0] + keys[1]
        x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        ones = [[int((x[:, w] >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)] for w in range(3)]
        want = [sum(1 << b for b in range(64) if 2 * row[b] > n) for row in ones]
        assert similar.wide_fingerprint(h, 3).tolist() == want


def test_most_pairs_at_the_similarity_are_candidates():
    """Sets of 80 shared and 10 own shingles each are at 0.8: the blocks find over 0.97 of such pairs."""
    rng, layout, hit = np.random.default_rng(8), similar.Layout.of(10_000_000, 0.8, 0.01), 0
    for _ in range(400):
        h = rng.integers(0, 1 << 63, 100, np.uint64)
        prints = np.stack([similar.wide_fingerprint(np.unique(x), layout.longs) for x in (h[:90], np.concatenate([h[:80], h[90:]]))])
        g, code = layout.deal(prints)
        hit += bool(((g[0] == g[1]) & (np.bitwise_count((code[0] ^ code[1]).astype(np.uint64)) <= 1)).any()) and np.bitwise_count(prints[0, :2] ^ prints[1, :2]).sum() <= layout.limit
    assert hit > 0.97 * 400


def test_contracted_links_join_the_same(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (70, 2))] + [(5, 5)]
    df = spark.createDataFrame(pairs, "a long, b long").repartition(4)

    def parts(links):
        up = {}
        find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
        for a, b in links:
            up[max(find(a), find(b))] = min(find(a), find(b))
        return {x: find(x) for x in up if find(x) != x}

    for rows in (10, 1000):
        got = [tuple(r) for r in similar._contracted(df, rows).collect()]
        assert parts(got) == parts([p for p in pairs if p[0] != p[1]])
    assert len(got) < 60 and similar._contracted(df.filter("false")).count() == 0


def test_rows_repeated_many_times_and_one_id_with_several_texts(spark):
    """A row that stands 40 times, its near copy twice, and an id whose two rows have different texts, one near the first."""
    words = [f"w{x}" for x in range(120)]
    near = " ".join([*words[:-1], "zz"])
    rows = [(5, " ".join(words))] * 40 + [(9, near)] * 2 + [(7, "another text of quite different words here"), (7, near + " yy"), (11, "alone among the others it stays as it is")]
    kept = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=5, similarity=0.8)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [5] * 40 + [11]
    signs = spark.createDataFrame([(5, t) for t in (" ".join(words), near)], "doc_id long, text string")
    assert similar.keep_one(signs).count() == 2  # all rows of one id stay
