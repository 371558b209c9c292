"""Scores, matchings and extraction against plain recomputations, with ties, long, deep and repeated rows."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacegrid.llm import language, quality, toxicity, wrappers
from pacegrid.llm.dom import parse

LONG = " ".join(f"Word{k % 97}x, z" for k in range(30_000))
TEXTS = ["Plain words, and 3 numbers: 12 34!", LONG, "", None, "ééé ñandú 漢字かな交じり文" * 3, "a" * 20_000 + " b", "x x x x", "tab\tand\nline"]


def mix(x):
    x = x * 0x9E3779B97F4A7C15 % 2**64
    return x ^ x >> 31


def plain_features(word):
    raw = b"<%b>" % word.encode("utf-8", "surrogatepass")
    yield quality._bucket(raw, 1)
    yield quality._bucket(quality.shape(word).encode("utf-8", "surrogatepass"), 2)
    for n in (3, 4, 5):
        for k in range(len(raw) - n + 1):
            h = 0
            for c in raw[k : k + n]:
                h = mix((h + c + 1) % 2**64)
            yield (h >> 20) % quality.BUCKETS


def plain_quality(text, margins, bias):
    words = (text or "").split()
    found = [b for w in words for b in plain_features(w)]
    for a, b in zip(words, words[1:]):
        found.append(quality._bucket(f"{quality.shape(a)} {quality.shape(b)} {int(a == b)}".encode("utf-8", "surrogatepass"), 3))
    return 1 / (1 + math.exp(-(sum(margins[b] for b in found) / max(1, len(found)) + bias)))


def test_quality_scores_are_plain_averages():
    margins = np.random.default_rng(0).normal(0, 3, quality.BUCKETS)
    got = quality.Scorer(margins, 0.3)([t for t in TEXTS if t is None or len(t) < 30_000])
    want = [plain_quality(t, margins, 0.3) for t in TEXTS if t is None or len(t) < 30_000]
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_language_scores_are_plain_cosines():
    model = language.train(["el perro come pan", "la casa es blanca", "the dog eats bread", "the house is white"] * 3, ["es", "es", "en", "en"] * 3)
    for text in ["the white dog 42!", "Casa del PERRO ½", "ñandú", LONG]:
        low = text.lower()
        data, space = bytearray(b" "), True
        for byte in low.encode():
            if 97 <= byte < 123 or byte > 127:
                data.append(byte)
                space = False
            elif not space:
                data.append(32)
                space = True
        if not space:
            data.append(32)
        v = np.zeros(language.DIMS)
        for k in range(len(data) - 1):
            v[(data[k] << 8 | data[k + 1]) * 0x85EBCA77 % 2**32 >> 32 - language.BITS] += 1
        for k in range(len(data) - 2):
            v[(data[k] << 16 | data[k + 1] << 8 | data[k + 2]) * 0x9E3779B1 % 2**32 >> 32 - language.BITS] += 1
        x = np.log1p(v) * model.idf
        near = model.centroids @ (x / np.sqrt(x @ x))
        name, score, _ = model.predict(text)
        assert name == model.names[int(near.argmax())] and score == pytest.approx(float(near.max()), abs=1e-5)
    assert [model.predict(t)[0] for t in (None, "", "½ ² ① Ⅷ 12")] == ["und"] * 3


def test_toxicity_matches_are_those_of_a_plain_search():
    model = toxicity.Model({" scum ": 2.0, " scu": 1.0, " vile": 1.5, " scum of": 0.5}, [" pond scum "], (-2.0, 1.0, 0.5))
    m = toxicity.Matcher(model)
    for text in ["you scum", "sсum of a v1le place", "pond scum", "the pond scum and scums", LONG + " vile", "", None, "scu scu scu"]:
        t = toxicity.folded(text)
        spared = [(k, k + len(e) - 1) for e in model.exceptions for k in range(len(t)) if t.startswith(e, k)]
        total = 0.0
        for k in range(len(t)):
            if t[k] != " ":
                continue
            at = [e for e in model.lexicon if t.startswith(e, k)]
            if at:
                e = max(at, key=len)
                if not any(a <= k and k + len(e.rstrip()) <= b + 1 for a, b in spared):
                    total += model.lexicon[e]
        a, b, c = model.curve
        x, y = math.log1p(total), math.log1p(100 * total / max(1, t.count(" ") - 1)) if total else 0.0
        assert m.score(text) == pytest.approx(1 / (1 + math.exp(-(a + b * x + c * y))))


def test_scores_replace_a_column_of_their_name(spark):
    df = spark.createDataFrame([(1, "some text", 9.0, "x")], "doc_id long, text string, score double, language string")
    assert quality.with_score(df, None).first()["score"] == 0.5
    assert 0 <= toxicity.with_score(df, toxicity.Model({})).first()["score"] <= 1
    assert language.with_language(df, language.train([], [])).first()["language"]["lang_pred"] == "und"


def test_repeated_labels_and_texts_have_one_meaning(spark):
    docs = spark.createDataFrame([(k, f"text {k} of kind {'good' if k % 2 else 'bad'}") for k in range(60)] + [(0, "zz other text"), (0, "aa other text")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(2, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    a, b = quality.fit(docs, labels), quality.fit(docs.orderBy(F.desc("text")).repartition(5), labels.orderBy(F.desc("quality")).repartition(3))
    assert (a.embeddings == b.embeddings).all() and (a.weights == b.weights).all()


def plain_tree(node_list):
    """(label, children) of a page's nodes of one slot; children by label."""
    return node_list[0].label, [plain_tree(own) for own in wrappers.groups(node_list).values()]


def slot_tree(slot):
    return slot.label, [slot_tree(c) for c in slot.ordered()]


def plain_matching(a, b):
    if a[0] != b[0]:
        return 0
    best = 0
    for n in range(min(len(a[1]), len(b[1])) + 1):
        for xs in itertools.combinations(a[1], n):
            for ys in itertools.combinations(b[1], n):
                best = max(best, sum(plain_matching(x, y) for x, y in zip(xs, ys)) if all(x[0] == y[0] for x, y in zip(xs, ys)) else 0)
    return 1 + best


def test_tree_matching_is_the_largest():
    rng = np.random.default_rng(3)

    def html(depth):
        return "".join(f"<{t}>{html(depth - 1)}</{t}>" for t in rng.choice(["div", "ul", "section", "h2", "pre"], int(rng.integers(0, 6)))) if depth else "x"

    for _ in range(150):
        pages = [parse(html(3)) for _ in range(3)]
        wrapper = wrappers.as_slots(pages[0])
        wrappers.merge(wrapper, wrappers.as_slots(pages[1]))
        size, pairs = wrappers.matching([pages[2]], wrapper)
        assert size == len(pairs) == plain_matching(plain_tree([pages[2]]), slot_tree(wrapper))
        assert all(nodes[0].label == slot.label for nodes, slot in pairs)


def test_heaviest_chain_is_that_of_all_selections():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 5, 9):
        for _ in range(30):
            places, weights = rng.permutation(n).tolist(), rng.integers(1, 5, n).tolist()
            best = max(sum(weights[k] for k in c) for m in range(n + 1) for c in itertools.combinations(range(n), m) if all(places[i] < places[j] for i, j in zip(c, c[1:])))
            got = wrappers.heaviest_chain(places, weights)
            assert sum(weights[k] for k in got) == best and all(places[i] < places[j] for i, j in zip(got, got[1:]))


def sections(names, shown=()):
    own = "".join(f"<div class={n}><p>words of {n}</p></div>" for n in names)
    return f"<html><body><div>{own}{''.join(shown)}</div></body></html>"


def test_large_hosts_in_any_order_and_partitioning(spark):
    letters = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    box = "<div class=xbox><p>the same words everywhere</p></div>"
    rows = [(k, f"http://big.example/{k}", sections([f"own{letters(k)}q{letters(i)}" for i in range(400)], [box] * (k >= 2))) for k in range(10)]
    seen = set()
    for order, parts in ((rows, 1), (rows[::-1], 1), (rows, 5), (rows[3:] + rows[:3], 3)):
        df = spark.createDataFrame(order, "page_id long, url string, html string").coalesce(1).repartition(parts) if parts > 1 else spark.createDataFrame(order, "page_id long, url string, html string").coalesce(1)
        got = tuple(sorted((r["page_id"], r["text"]) for r in wrappers.extract_pages(df).collect()))
        assert not any("the same words everywhere" in t for _, t in got) and all(t.count("words of") == 400 for _, t in got)
        seen.add(got)
    assert len(seen) == 1


def test_long_pages_of_alternating_blocks_take_seconds():
    long = "".join(f"<h2>head {k}</h2><p>{'words ' * 5}{k}</p>" for k in range(8_000))
    a, b = parse(f"<body><div>{long}</div></body>"), parse(f"<body><div><p>first</p>{long}</div></body>")
    began = time.time()
    wrapper = wrappers.merge(wrappers.as_slots(a), wrappers.as_slots(b))
    wrapper.number()
    assert len(wrappers.slot_texts(a, wrapper)) > 16_000 - 1 and wrappers.extract(b, wrapper, frozenset([(0, 0)])).startswith("first head 0")
    odd = parse("".join(f"<div class=k{chr(97 + k // 676)}{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}><p>{k}</p></div>" for k in range(15_000)))
    assert len(wrappers.slots_of(odd, wrappers.as_slots(odd))) == 45_001
    assert time.time() - began < 5


def plain_texts(pages, share, least):
    """Main texts by counting each text of each path of labels over a host's different pages, by plain loops (blocks keep their order)."""

    def texts(node, path=()):
        for c in node.children:
            if c.tag == "#text":
                yield path + ("#text",), c.text
            else:
                yield from texts(c, path + (c.label,))

    counts, different = {}, {}
    for host, page in {(h, p) for _, h, p in pages}:
        different[host] = different.get(host, 0) + 1
        for x in set(texts(parse(page))):
            counts[host, x] = counts.get((host, x), 0) + 1
    out = {}
    for k, host, page in pages:
        every = list(texts(parse(page)))
        kept = [t for t in every if different[host] < least or counts[host, t] < share * different[host]]
        out[k] = " ".join(t for _, t in (kept or every))
    return out


def test_template_counts_against_plain_loops(spark):
    rng = np.random.default_rng(6)
    pages = []
    for k in range(60):
        host = f"h{k % 4}.example" if k < 57 else "few.example"
        body = "".join(f"<div class={c}>{f'fixed {c} of {host}' if rng.random() < 0.7 else f'own {c} {k}'}</div>" for c in "qrstuv" if rng.random() < 0.85)
        pages.append((k, host, f"<html><body><section>{body}<pre>page {k}</pre></section></body></html>"))
    pages += [(100 + k, pages[0][1], pages[0][2]) for k in range(40)]  # copies of one page count once
    df = spark.createDataFrame([(k, f"http://{h}/{k}", p) for k, h, p in pages], "page_id long, url string, html string").repartition(4)
    assert {r["page_id"]: r["text"] for r in wrappers.extract_pages(df).collect()} == plain_texts(pages, 0.6, 5)


def test_all_of_an_article_is_kept():
    assert wrappers.extract(parse("<main>one</main><div class=ad>x</div><main>two</main>")) == "one two"
    assert wrappers.extract(parse("<article><header><h1>T</h1><p>standfirst</p></header><p>body</p></article>")) == "T standfirst body"
    kept = "<article><section id=discussion><p>Discussion text</p></section><div class=related-methods><p>Methods</p></div><div class=comments><p>Nice</p></div><div class='ad box'>buy</div></article>"
    assert wrappers.extract(parse(kept)) == "Discussion text Methods"


def test_exceptions_of_a_very_long_text_take_no_time():
    m = toxicity.Matcher(toxicity.Model({" scum ": 2.0}, [" pond scum "], (-2.0, 1.0, 0.5)))
    text = toxicity.folded("pond scum and scum " * 100_000)
    began = time.time()
    assert len(m.found(text)) == 100_000 and time.time() - began < 3


def test_long_deep_and_repeated_pages(spark):
    def page(body):
        return f"<html><body><div><div>Daily words</div><ul><li>one</li><li>two</li><li>three</li></ul>{body}<div>Write to us</div></div></body></html>"

    paragraphs = lambda k, n: "".join(f"<p>part {i} of story {k}</p>" for i in range(n))
    rows = [(k, f"http://many.example/{k}", page(paragraphs(k, 20))) for k in range(8)]  # more texts a slot than any summary would keep
    rows += [(50, "http://many.example/0", rows[0][2])] * 30
    rows += [(60 + k, f"http://same.example/{k}", page("<p>the one story</p>")) for k in range(6)]
    deep = "<div>" * 500 + "<p>deep words</p><div class=ad>buy</div>" + "</div>" * 500
    rows += [(70, "http://deep.example/", f"<html><body>{deep}</body></html>"), (71, "http://long.example/", f"<article>{paragraphs(1, 40_000)}</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in wrappers.extract_pages(df).collect()}
    for k in range(8):
        assert got[k] == " ".join(f"part {i} of story {k}" for i in range(20))
    assert got[50] == got[0] and got[60] == "Daily words one two three the one story Write to us"
    assert got[70] == "deep words" and got[71].count("story 1") == 40_000
    assert {r["page_id"]: r["text"] for r in wrappers.extract_pages(df.repartition(1), broadcast_bytes=0).collect()} == got
    assert parse(None).children == []
