"""The quality classifier reads long words whole."""

import numpy as np

from pacegrid.llm import quality


def features(words, **kw):
    found = [(a + int(w), int(b)) for a, _, where, bucket in quality.word_features(words, **kw) for w, b in zip(where, bucket)]
    return sorted(found)


def test_every_n_gram_of_a_long_word_counts():
    words = ["a", "漢字かな" * 100, "Zed" * 90, "b9", ""]
    n = [len(w.encode()) + 2 for w in words]
    got = features(words)
    assert [sum(k == i for k, _ in got) for i in range(len(words))] == [2 + sum(max(0, x - k + 1) for k in (3, 4, 5)) for x in n]
    for most in (7, 50, 271, 272, 273, 1000):
        assert features(words, most=most) == got


def test_words_of_one_beginning_differ():
    assert quality.shape("a" * 30 + "Z9") == "xX0" and quality.shape("ab" * 40 + "-9") == "x-0"
    margins = np.random.default_rng(1).normal(size=quality.BUCKETS)
    start = "読む文章" * 30
    a, b, both = quality.Scorer(margins, 0.0)([start + "良い" * 50, start + "悪い" * 50, start])
    assert len({a, b, both}) == 3


def test_training_learns_from_the_end_of_a_long_word():
    rng = np.random.default_rng(2)
    start = "始" * 40
    texts = [start + "".join(rng.choice(list("良善美" if k % 2 else "悪醜雑"), 60)) for k in range(80)]
    model = quality.train(texts, np.arange(80) % 2, epochs=20)
    scores = quality.Scorer(model.margins(), float(model.bias[1] - model.bias[0]))([start + "良善美美" * 15, start + "悪醜雑雑" * 15])
    assert scores[0] > 0.5 > scores[1]
