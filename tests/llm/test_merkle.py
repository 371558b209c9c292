"""The Merkle manifest against trees built level by level in plain Python."""

import hashlib
import zlib

import pytest

from pacegrid.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx string, block long, digest int"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def enc(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def grow(nodes, fanout):
    """All levels, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k : k + fanout])) for k in range(0, len(out[-1]), fanout)])
    return out


def rise(levels, k, fanout):
    for level in levels[:-1]:
        run = k // fanout * fanout
        yield level[run:k], level[k + 1 : run + fanout]
        k //= fanout


def plain(rows, fanout):
    by = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        leaf = h(enc(doc_id, source, lang, n_chars, text))
        hit = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        by.setdefault(lang, []).append(((doc_id is not None, doc_id or 0, leaf), h(enc(doc_id, source, lang, n_chars + 1, text)) if hit else leaf, doc_id))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: grow([r[0][2] for r in sorted(by[x], key=lambda r: r[0])], fanout) for x in langs}
    top = grow([trees[x][-1][0] for x in langs], fanout)
    out = []
    for i, x in enumerate(langs):
        for k, (key, changed, doc_id) in enumerate(sorted(by[x], key=lambda r: r[0])):
            path = [*rise(trees[x], k, fanout), *rise(top, i, fanout)]
            up = changed
            for a, b in path:
                up = h("".join([*a, up, *b]))
            proof = h("".join("".join(a) + "".join(b) for a, b in path))
            out.append((doc_id, key[2], trees[x][-1][0], top[-1][0], proof, up, up == top[-1][0]))
    return out


def row(k, lang, text="some text"):
    return (k, text, lang, None if k % 5 == 0 else f"s{k % 3}", None if k % 11 == 0 else 9, "x", 1, 2)


@pytest.mark.parametrize("fanout, block", [(2, 4), (2, 2), (3, 9), (2, 4096), (5, 5)])
def test_manifest_is_that_of_plain_trees(spark, fanout, block):
    rows = [row(k * 3, "en", f"text {k} é\x01\t漢") for k in range(75)] + [row(k, "de") for k in range(21)] + [row(k, None) for k in range(5)] + [row(7, "fr", None)]
    rows += [row(k, "éa", "w " * 30_000) for k in range(3)] + [row(k, "z", "") for k in range(17)]
    rows += [row(3, "en", "text 1 again")] * 2 + [(None, "x", "en", "s", 3, "", 0, 0), (None, "y", None, None, None, "", 0, 0), (None, "x", "en", "s", 3, "", 0, 0)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), fanout=fanout, block=block)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows, fanout), key=key)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 9, 16, 17, 31, 33])
def test_every_size_of_one_group(spark, n):
    rows = [row(k, "en") for k in range(n)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), block=2)
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, 2))


def test_empty_table_and_all_rows_equal(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [row(1, "en")] * 40
    assert sorted(map(tuple, merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(4), block=8).collect())) == sorted(plain(rows, 2))
