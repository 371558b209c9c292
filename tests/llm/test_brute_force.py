"""The operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pacegrid.llm import decontaminate, embeddings, language, packing, quality, sharding, simhash, token_files, tokens, toxicity, wrappers

VOCABULARY = tokens.default_vocabulary()
LONG = " ".join(f"word{k % 977} the," for k in range(6000))
TEXTS = [
    (5, "The quick brown fox, it's 1999!! Über 12% naïve café ΣΟΦΟΣ"), (3, None), (4, ""), (9, LONG), (9, LONG), (1, "The quick brown fox, it's 1999!! Über 12% naïve café ΣΟΦΟΣ"),
    (None, "a null id"), (7, "tab\tnew\nline\x0bvertical\x1cseparator  em <|endoftext|> end"), (2, "  \n "), (-8, "minus eight _under_score '***' é İstanbul"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "key", 7, 1.0) for d, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, length int, score double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def library_ids(text):
    t = Tokenizer.from_file(VOCABULARY)
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_cached_ids_are_the_library_ids():
    made = tokens.WordEncoder(VOCABULARY, most=50)
    texts = [t for _, t in TEXTS] + ["".join(map(chr, np.random.default_rng(k).integers(32, 0x250, 400))) for k in range(30)]
    for _ in range(2):
        for t, ids in zip(texts, made.encode(texts)):
            assert ids.tolist() == library_ids(t).tolist()


def test_packing_is_whole_and_tight(spark, docs):
    packed = packing.pack(docs, VOCABULARY)
    rows = packing.placed(packed).toPandas()
    whole = [library_ids(t) for _, t in TEXTS]
    assert rows["length"].sum() == sum(map(len, whole)) and (rows["length"] <= 4096).all()
    by_crc = {zlib.crc32(ids[k : k + 4096].tobytes()): len(ids[k : k + 4096]) for ids in whole for k in range(0, len(ids), 4096)}
    assert all(by_crc[r.ids_crc32] == r.length and r.start == 4096 * r.piece for r in rows.itertuples())
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist() and g["length"].sum() <= 4096
    assert rows["sequence_id"].nunique() == -(-rows["length"].sum() // 4096)
    made = packed.sequences().toPandas()
    assert sum(map(len, made["ids"])) == 4 * rows["length"].sum()


def test_bin_slack_against_bounds():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = rng.integers(1, 60, 200)
        counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
        patterns = packing.minimum_bin_slack(counts, 64)
        used = {}
        for p in patterns:
            assert sum(x * k for x, k in p.lengths.items()) <= 64
            for x, k in p.lengths.items():
                used[x] = used.get(x, 0) + k * p.bins
        assert used == counts
        big = sorted(lengths, reverse=True)
        first_fit = []
        for x in big:
            for i, room in enumerate(first_fit):
                if room >= x:
                    first_fit[i] -= x
                    break
            else:
                first_fit.append(64 - x)
        assert sum(p.bins for p in patterns) <= len(first_fit)


def test_token_files_round_trip(spark, docs):
    files = token_files.write_tokens(docs, files=3)
    rows = token_files.read_tokens(spark, files).toPandas()
    order = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0))
    at = 0
    got = sorted(((-(10**9) if pd.isna(r.doc_id) else r.doc_id), r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in rows.itertuples())
    want = []
    for d, t in order:
        ids = library_ids(t)
        want.append((-(10**9) if d is None else d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [x[0] for x in got] == sorted(x[0] for x in want)
    # repeated rows of one id may stand in either order; here they are equal
    assert sorted(got) == sorted(want)
    name, n, _, _ = files.files[0]
    f = token_files.TokenFile(f"{files.root}/{name}")
    assert np.concatenate([f.document(i) for i in range(n)]).tolist() == f.ids(0, f.n_ids).tolist()


def test_elias_fano_select():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (5, 5), (1000, 10**6), (3000, 100), (700, 1 << 40)):
        x = np.sort(rng.integers(0, top, n))
        ef = token_files.EliasFano.of(x)
        back = token_files.EliasFano.read(n, int(x[-1]), ef.tobytes())
        assert [back.select(i) for i in range(n)] == x.tolist()
        assert back.numbers().tolist() == x.tolist() and back.numbers(n // 3, n // 2).tolist() == x[n // 3 : n // 2].tolist()
        assert len(ef.tobytes()) <= (n * (2 + max(1, int(x[-1] / n)).bit_length()) + 16) / 8 + 2


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_components(spark):
    rng = np.random.default_rng(2)
    base = [" ".join(rng.choice(["aa", "bb", "cc", "Dd", "ee", "ff"], 400)) for _ in range(12)]
    texts = [b for b in base] + [b.replace("aa bb", "aa xx", 1) for b in base] + [b + " tail" for b in base] + ["", None, " \t "]
    df = spark.createDataFrame([(100 - k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r["doc_id"]: r for r in simhash.simhash_components(df).collect()}
    ids = sorted(got)
    f = [brute_fingerprint(texts[100 - d]) for d in ids]
    assert [int(got[d]["fingerprint"], 16) for d in ids] == f
    want = components(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if bin(f[i] ^ f[j]).count("1") <= 2])
    assert [got[d]["component_id"] for d in ids] == [ids[k] for k in want]


@pytest.mark.parametrize("most", [2, 1000])
def test_trie_join_in_small_and_split_groups(spark, most):
    rng = np.random.default_rng(4)
    f = rng.integers(-(1 << 62), 1 << 62, 60)
    near = [x ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))) for x in f.tolist()]
    dense = [(1 << 40) + k for k in range(64)]
    all_fp = sorted({*f.tolist(), *near, *dense})
    links = simhash.near_links(spark.createDataFrame([(x,) for x in all_fp], "fp long"), 2, most).collect()
    place = {x: i for i, x in enumerate(all_fp)}
    ours = components(len(all_fp), [(place[r["a"]], place[r["b"]]) for r in links])
    u = np.array(all_fp, np.int64).view(np.uint64)
    i, j = np.nonzero(np.bitwise_count(u[:, None] ^ u[None]) <= 2)
    assert ours == components(len(all_fp), zip(i.tolist(), j.tolist()))


def test_embedding_links(spark):
    rng = np.random.default_rng(6)
    rows = []
    for label in (0, 1):
        centre = rng.normal(size=16)
        rows += [(label, (centre + s * rng.normal(size=16)).astype(np.float32).tolist()) for s in [0.05] * 30 + [0.3] * 30 + [3.0] * 30]
    rows += [(0, rows[0][1]), (0, rows[0][1]), (None, rows[0][1]), (1, None), (1, [0.0] * 16), (0, [float("nan")] + [1.0] * 15), (0, [None] + [1.0] * 15), (1, [1e-30 * x for x in rows[95][1]])]
    df = spark.createDataFrame([(k * 3 % 1009, e, lab, "x") for k, (lab, e) in enumerate(rows)], "vec_id long, embedding array<double>, label int, rep string")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, 0.93, tile=7).collect()}
    data = sorted(((k * 3 % 1009, lab, e) for k, (lab, e) in enumerate(rows)), key=lambda x: x[0])
    links = []
    for i, (_, la, a) in enumerate(data):
        for j, (_, lb, b) in enumerate(data[:i]):
            ok = all(e is not None and None not in e and np.isfinite(e).all() and np.any(e) for e in (a, b))
            if la is not None and la == lb and ok:
                p, q = (np.array(e) / np.abs(e).max() for e in (a, b))
                if p @ q / np.sqrt(p @ p) / np.sqrt(q @ q) >= 0.93:
                    links.append((i, j))
    n = np.bincount(np.array(links).ravel(), minlength=len(data))
    assert [got[d[0]]["n_links"] for d in data] == n.tolist()
    assert [got[d[0]]["component_id"] for d in data] == [data[k][0] for k in components(len(data), links)]
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_embeddings_of_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (None, [1.0, 0.0]), (5, [0.3, 0.9]), (7, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "a") for r in rows], "vec_id long, embedding array<float>, label string")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect())
    assert got == [(0, 2, 1, False), (1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (5, 1, 1, False), (7, 0, 7, True)]


def test_vectors_at_the_threshold_are_linked_by_their_stored_components(spark):
    rng = np.random.default_rng(11)
    rows = rng.integers(-3, 4, (120, 4)).astype(float)
    rows = [r for r in rows.tolist() if any(r)]
    for threshold in (0.8, 0.9, 0.93):  # whole numbers: many pairs are at one cosine
        got = embeddings.near_duplicates(spark.createDataFrame([(k, r, 1) for k, r in enumerate(rows)], "vec_id long, embedding array<double>, label int"), threshold, blocks=2, tile=30)
        x = np.array(rows)
        links = [int(sum(embeddings.cosines(np.repeat(x[i : i + 1], len(x), 0), x) >= threshold)) - 1 for i in range(len(x))]
        assert {r["vec_id"]: r["n_links"] for r in got.collect()} == dict(enumerate(links))


def brute_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark, docs):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 12345678901234567]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 17, 100):
        assert [r[0] for r in df.select(sharding.jump(F.col("k"), n)).collect()] == [brute_jump(k % 2**64, n) for k in keys]
    rows = sharding.shard_documents(docs, 4, salts=3).toPandas()
    assert len(rows) == len(TEXTS) and set(rows["law"]) == {"key"}
    assert all((r.grown_shard == r.shard) or r.grown_shard == 4 for r in rows.itertuples())
    for _, g in rows.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert sorted(rows["size"]) == sorted(len((t or "").encode()) + 1 for _, t in TEXTS)
    assert sorted(rows["text_crc32"]) == sorted(zlib.crc32((t or "").encode()) for _, t in TEXTS)


def test_decontamination_against_all_diagonals(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [" ".join(rng.choice(vocabulary, n)) for n in (5, 14, 20, 40)]
    noise = lambda n: " ".join(rng.choice(vocabulary, n))

    def changed(text, every):
        return " ".join(w if k % every else "zz" for k, w in enumerate(text.split(), 1))

    texts = [noise(80), f"{noise(30)} {items[3]} {noise(9)}", f"{noise(30)} {changed(items[3], 9)}", f"{items[0]}", noise(2000) + " " + changed(items[2], 11), "", None, f"{items[1]} {items[1]}", changed(items[3], 2)]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(k, t) for k, t in enumerate([*items, "", None])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {(1, 3), (2, 3), (3, 0), (4, 2), (7, 1)}
    assert {r["doc_id"] for r in decontaminate.clean(df, bench).collect()} == {0, 5, 6, 8}
    split = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench, block_words=10).collect()}
    assert split == got


def test_best_run_is_the_longest():
    rng = np.random.default_rng(9)
    for _ in range(200):
        same = rng.random(25) < 0.7
        best = 0
        for a in range(25):
            for b in range(a + 1, 26):
                if same[a] and same[b - 1] and (~same[a:b]).sum() <= 0.2 * (b - a) + 1e-9:
                    best = max(best, b - a)
        run = decontaminate.best_run(same, 0.2)
        assert (run[1] - run[0] if run else 0) == best


def page(title, body, extra=""):
    return f'<!DOCTYPE html><html><head><title>{title}</title><script>var a="<p>no</p>";</script></head><body><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div>{extra}<article><h1>{title}</h1>{body}</article><aside>Side</aside><form><label>Mail</label></form><section id="comments"><p>Nice!</p></section><footer>&copy; us</footer></body></html>'


def test_extraction(spark):
    rows = [(k, f"https://Host.example/{k}", page(f"T{k}", f"<p>one {k}<br>two &amp;&lt; &nbsp;three</p><p>it<b>al</b>ic {k}<p>open {k}")) for k in range(8)]
    rows += [(20, "https://soup.example/a", "<div id=menu><a href=x>m</a></div><div class=text>Some <i>text</i> here</div><!-- c --><div class='ad'>buy</div>"), (21, None, None), (22, "bad url", ""), (23, "https://soup.example/b", "<p>cut <b>off")]
    # a host of plain markup, where only aligning its pages tells the template
    rows += [(30 + k, f"http://plain.example/{k}", f"<div><div>Daily words and weather</div><div>story number {k} is told here</div><div>Write to the editor</div></div>") for k in range(8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string").repartition(3)
    got = {r["page_id"]: r["text"] for r in wrappers.extract_pages(df).collect()}
    joined = {r["page_id"]: r["text"] for r in wrappers.extract_pages(df, broadcast_bytes=0).collect()}
    assert got == joined
    for k in range(8):
        assert got[k] == f"T{k} one {k} two &< three italic {k} open {k}"
        assert got[30 + k] == f"story number {k} is told here"
    assert (got[20], got[21], got[22], got[23]) == ("Some text here", "", "", "cut off")


def test_classifiers_on_held_out_rows(spark):
    root = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    held = d.join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    q = quality.with_score(held, quality.fit(d, labels, per_class=400)).select("quality", "score").toPandas()
    assert ((q["score"] >= 0.5) == (q["quality"] == 1)).mean() > 0.97
    x = toxicity.with_score(held, toxicity.fit(d, labels)).select("quality", "toxic", "score").toPandas()
    flagged = x["score"] >= 0.7
    assert flagged[x["toxic"] == 0].mean() < 0.01 and flagged[(x["toxic"] == 1) & (x["quality"] == 1)].mean() > 0.9
    n = language.with_language(held, language.fit(d)).select("lang", "language.lang_pred").toPandas()
    assert (n["lang"] == n["lang_pred"]).mean() > 0.99


def test_classifiers_on_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, labels) is None
    assert {r["score2"] for r in quality.with_score(docs, None, "score2").collect()} == {0.5}
    odd = docs.select("doc_id", "text", F.lit("en").alias("lang"))
    named = language.with_language(odd, language.fit(odd)).collect()
    assert all((r["language"]["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or ""))) for r in named)
    bad = [f"{k}a {k}b here is a scum of {k}c {k}d" for k in range(12)]
    good = [f"{k}e {k}f here is a text of {k}g {k}h" for k in range(36)] + [f"{k}i {k}j the pond scum is {k}k {k}l" for k in range(2)]
    model = toxicity.train([*bad, *bad, *good], np.array([1] * 24 + [0] * 38), least=3, odds=2, sure=8)
    m = toxicity.Matcher(model)
    assert toxicity.folded("Y0u $CUM, sсum! f@ce") == " you scum scum face "
    assert m.found(toxicity.folded("you ѕсum")) and not m.found(toxicity.folded("the pond scum"))
    assert toxicity.with_score(docs, model, "tox").count() == len(TEXTS)


def test_empty_tables(spark, empty):
    assert packing.placed(packing.pack(empty, VOCABULARY)).count() == 0
    assert token_files.read_tokens(spark, token_files.write_tokens(empty)).count() == 0
    assert simhash.simhash_components(empty).count() == 0
    assert sharding.shard_documents(empty).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert wrappers.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.with_score(empty, quality.fit(empty, labels)).count() == 0
    assert toxicity.with_score(empty, toxicity.fit(empty, labels)).count() == 0
    assert language.with_language(empty, language.fit(empty)).count() == 0


def test_a_budget_beyond_the_fingerprint_is_an_error(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    with pytest.raises(ValueError, match="largest is 15"):
        simhash.simhash_components(docs, budget=20)
