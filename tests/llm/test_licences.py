"""Licence scans against a search of every place."""

import math

import numpy as np
import pytest

from pacegrid.llm import licences

FILLER = "the and of public version 2 license by all rights free software 0 work under cc terms gnu you can or this é漢 with".split()


def plain(text, index, phrases, templates, share=0.75, play=0.25):
    words = licences.plain_words(text)
    hold = lambda p, b: words[b : b + len(p)] == p
    spots = [(b, label) for p, label in phrases.items() for b in range(len(words)) if hold(p.split(), b)]
    labels, score = {x for _, x in spots}, 1.0 if spots else 0.0
    base = set(labels)
    names = list(index.codes)
    rank = {names[c].decode(): int(index.order[c]) for c in range(len(names))}
    for label, body, keys in templates:
        t = licences.plain_words(body)
        slack = math.ceil(play * len(t))
        anchors = sorted(set(t) & set(words), key=rank.get)[:8]
        need = math.ceil(share * min(8, len(set(t))))
        for b in range(-len(t), len(words)):
            begins_at_an_anchor = any(0 <= b + q < len(words) and words[b + q] == w for w in anchors for q in range(len(t)) if t[q] == w)
            if not begins_at_an_anchor:
                continue
            near = lambda w, q: w in words[max(0, b + q) : max(0, b + q + slack + 1)]
            if sum(any(near(w, q) for q in range(len(t)) if t[q] == w) for w in anchors) < need:
                continue
            if not all(any(hold(k, p) for p in range(max(0, b - slack), b + len(t) + slack - len(k) + 1)) for k in map(licences.plain_words, keys)):
                continue
            got = sum(near(w, q) for q, w in enumerate(t)) / len(t)
            if got >= share:
                labels.add(label)
                score = max(score, got)
    at = [b for b, _ in spots]
    return {"n_words": len(words), "n_base": len(at), "first_word": min(at, default=None), "last_word": max(at, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score}


def texts():
    rng = np.random.default_rng(5)
    out = ["", "CC-BY", "cc\x7fby cc by by cc", "ACC BY", "cc by x", "\x00cc\nBY/cc@by", "all rights reserved all rights reserved", "general\tpublic LICENSE.", "General Public Licensee", "Kcc by"]
    for _, body, _ in licences.TEMPLATES:
        out.append(body)
        words = body.split()
        for _ in range(3):
            w = [x for x in words if rng.random() > 0.12]
            for _ in range(int(rng.integers(0, 4))):
                w.insert(int(rng.integers(0, len(w) + 1)), str(rng.choice(FILLER)))
            out.append(" ".join([*rng.choice(FILLER, 15), *w, *rng.choice(FILLER, 15)]))
    return out + [" ".join(rng.choice(FILLER, 60)) for _ in range(30)]


def test_words_are_those_of_the_pattern():
    for t in [*texts(), None, "a\u0080b \x80 \x7f`{@[/: Z9z", "İIİẞ"]:
        assert [w.decode("utf-8") for w in licences.words_of(t)] == licences.plain_words(t)


def test_scan_is_that_of_every_place():
    seen = texts()
    known = {}
    for t in seen:
        for w in set(licences.plain_words(t)):
            known[w] = known.get(w, 0) + 1
    index = licences.Index(licences.PHRASES, licences.TEMPLATES, known, len(seen))
    labelled = 0
    for t in seen:
        want = plain(t, index, licences.PHRASES, licences.TEMPLATES)
        got = index.scan(t)
        assert got == want, t
        labelled += got["labels"] != got["base_labels"]
    assert labelled > 40


def test_notices_get_their_labels():
    index = licences.Index(licences.PHRASES, licences.TEMPLATES, {}, 0)
    for label, body, _ in licences.TEMPLATES:
        assert label in index.scan(f"Some words before. {body}. And after.")["labels"].split(",")
    got = index.scan("Licensed under CC BY-NC 4.0. This work is licensed under the GNU General Public License, version 3.")
    assert got["labels"] == "cc-by,cc-by-nc,gpl,gpl-3.0" and got["base_labels"] == "cc-by,gpl" and (got["n_base"], got["first_word"], got["last_word"], got["score"]) == (2, 2, 14, 1.0)
    assert index.scan("the rights of the public under the terms of this version")["labels"] == ""
    assert index.scan(None) == {"n_words": 0, "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0}


def test_very_long_texts_and_many_places():
    index = licences.Index(licences.PHRASES, licences.TEMPLATES, {}, 0)
    got = index.scan("released under the mit license cc by " * 40_000)
    assert got["n_words"] == 280_000 and got["n_base"] == 40_000 and got["last_word"] == 279_998 and got["labels"] == "cc-by,mit"


def test_documents(spark):
    rows = [(1, "All rights reserved.", "x", 0.1), (1, "All rights reserved.", "x", 0.1), (2, None, "x", 0.2), (None, "Released under the MIT License", "x", 0.3), (4, "", "x", 0.3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licence string, score double")
    index = licences.fit(docs)
    got = licences.with_licences(docs, index).select("doc_id", "licence.*").collect()
    assert sorted((r["doc_id"] or 0, r["labels"], r["n_base"], r["n_words"]) for r in got) == [(0, "mit", 0, 5), (1, "reserved", 1, 3), (1, "reserved", 1, 3), (2, "", 0, 0), (4, "", 0, 0)]
    assert licences.with_licences(docs.filter("false"), licences.fit(docs.filter("false"))).count() == 0
    with pytest.raises(ValueError):
        licences.Index({"...": "x"}, [], {}, 0)
