"""Licence scans by a positional rare-token index.

Templates (licence notices and bodies) and phrases are indexed by word: each word has its postings, the template and place where it
stands. A file looks up its licence words of the highest inverse document frequency, a template's own eight or as many as
are there; a word at place p of the file and q of a template speaks for the template beginning at p - q. Where enough of these words agree
on one beginning, give or take what may be inserted, the mandatory key phrases are verified, word by word, and the share of the
template's words in their places. A phrase is a template of one rare word, no play, and itself as key phrase: so every place of it is
found, and nothing else.

Document frequencies are counted over all documents, for the words of the templates alone (some hundred, whatever the corpus)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that are labels wherever their words stand together.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Notices and openings of public licences, with the phrases that must be in them.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license", "version 2 0"]),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["in compliance with the license", "apache org licenses"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", ["permission is hereby granted", "without restriction"]),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ["gnu general public license", "version 2"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ["gnu general public license", "version 2"]),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ["gnu general public license", "version 3"]),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["lesser general public license"]),
    ("agpl-3.0", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["affero general public license"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ["mozilla public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["source and binary forms", "following conditions are met"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("cc0-1.0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all rights to the work worldwide under copyright law", ["public domain", "waiving all"]),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["attribution noncommercial"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["attribution sharealike"]),
]

_SPACE = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPACE).split()


@dataclass
class Template:
    label: str
    base: bool
    words: np.ndarray  # codes
    keys: list[np.ndarray]
    rare: int  # words looked up
    play: int  # words that may be inserted


class Index:
    """Words to codes and the postings of each; `frequencies` (word -> documents) and the number of documents give the rarity."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple], frequencies: dict[str, int], documents: int, share: float = 0.75, rare: int = 8, play: float = 0.25):
        self.codes: dict[bytes, int] = {}
        self.share = share
        code = lambda text: np.array([self.codes.setdefault(w, len(self.codes)) for w in words_of(text)], np.int64)
        self.templates = [Template(label, True, w := code(p), [w], 1, 0) for p, label in phrases.items()]
        for label, text, keys in templates:
            w = code(text)
            self.templates.append(Template(label, False, w, [code(k) for k in keys], rare, math.ceil(play * len(w))))
        if any(not len(t.words) or not t.keys or any(not len(k) for k in t.keys) for t in self.templates):
            raise ValueError("a template and each of its key phrases must have words, and it must have a key phrase")
        known = sorted(self.codes)
        idf = {w: math.log((documents + 1) / (frequencies.get(w.decode("utf-8"), 0) + 1)) for w in known}
        place = {w: k for k, w in enumerate(sorted(known, key=lambda w: (-idf[w], w)))}
        self.order = np.array([place[w] for w in self.codes], np.int64)  # by code: 0 is the rarest
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, template in enumerate(self.templates):
            for q, c in enumerate(template.words.tolist()):
                self.postings.setdefault(c, []).append((t, q))

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        codes = np.fromiter(map(self.codes.get, words, [-1] * len(words)), np.int64, len(words))
        at = np.flatnonzero(codes >= 0)
        by_code = np.argsort(codes[at], kind="stable")
        names, starts = np.unique(codes[at[by_code]], return_index=True)
        places = dict(zip(names.tolist(), np.split(at[by_code], starts[1:])))
        # the file's licence words, rarest first, each to the templates that still look for words
        wanted: dict[int, list[int]] = {}
        for c in sorted(places, key=lambda c: self.order[c]):
            for t in dict.fromkeys(t for t, _ in self.postings[c]):
                if len(found := wanted.setdefault(t, [])) < self.templates[t].rare:
                    found.append(c)
        base, labels, score = [], set(), 0.0
        for t, anchors in wanted.items():
            template = self.templates[t]
            if any(c not in places for key in template.keys for c in key.tolist()):
                continue
            begins = self._begins(t, anchors, places)
            if not len(begins):
                continue
            if template.base:
                begins = _together(codes, begins, template.words)
                if len(begins):
                    base.append((template.label, begins))
                    score = 1.0
            else:
                best = self._verified(template, begins, codes, places)
                if best > 0:
                    labels.add(template.label)
                    score = max(score, best)
        own = {label for label, _ in base}
        spots = np.concatenate([b for _, b in base]) if base else np.zeros(0, np.int64)
        return {
            "n_words": len(words),
            "n_base": len(spots),
            "first_word": int(spots.min()) if len(spots) else None,
            "last_word": int(spots.max()) if len(spots) else None,
            "base_labels": ",".join(sorted(own)),
            "labels": ",".join(sorted(own | labels)),
            "score": score,
        }

    def _begins(self, t: int, anchors: list[int], places: dict[int, np.ndarray]) -> np.ndarray:
        """Beginnings b for which enough of the anchors stand where template t, beginning there, has them, up to its play further on."""
        template = self.templates[t]
        need = math.ceil(self.share * min(template.rare, len(set(template.words.tolist()))))
        if len(anchors) < need:
            return np.zeros(0, np.int64)
        each = [np.unique(np.concatenate([places[c] - q for s, q in self.postings[c] if s == t])) for c in anchors]
        begins = np.unique(np.concatenate(each))
        votes = np.zeros(len(begins), np.int64)
        for diagonals in each:
            k = np.searchsorted(diagonals, begins)
            votes += (k < len(diagonals)) & (diagonals[np.minimum(k, len(diagonals) - 1)] <= begins + template.play)
        return begins[votes >= need]

    def _verified(self, template: Template, begins: np.ndarray, codes: np.ndarray, places: dict[int, np.ndarray]) -> float:
        """The largest share of the template's words in place over the beginnings whose key phrases are all there; 0 under `share`."""
        for key in template.keys:
            spots = _together(codes, places[int(key[0])], key)
            k = np.searchsorted(spots, begins - template.play)
            ok = (k < len(spots)) & (spots[np.minimum(k, len(spots) - 1)] + len(key) <= begins + len(template.words) + template.play) if len(spots) else np.zeros(len(begins), bool)
            begins = begins[ok]
            if not len(begins):
                return 0.0
        there = np.zeros(len(begins), np.int64)
        for q, c in enumerate(template.words.tolist()):
            spots = places.get(c)
            if spots is not None:
                k = np.searchsorted(spots, begins + q)
                there += (k < len(spots)) & (spots[np.minimum(k, len(spots) - 1)] <= begins + q + template.play)
        best = float(there.max()) / len(template.words)
        return best if best >= self.share else 0.0


def _together(codes: np.ndarray, begins: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Which beginnings have the phrase's words one after the other."""
    begins = begins[(begins >= 0) & (begins + len(phrase) <= len(codes))]
    for i, c in enumerate(phrase.tolist()):
        begins = begins[codes[begins + i] == c]
    return begins


def fit(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple] = TEMPLATES, **how) -> Index:
    """The index of the templates, with the document frequencies of their words over all of `docs`."""
    known = set(words_of(" ".join([*phrases, *[t for _, t, _ in templates], *[k for *_, keys in templates for k in keys]])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = dict.fromkeys(known, 0), 0
        for b in batches:
            n += len(b)
            for text in b["text"]:
                for w in known.intersection(words_of(text)):
                    seen[w] += 1
        yield pd.DataFrame({"word": ["", *[w.decode("utf-8") for w in seen]], "n": [n, *seen.values()]})

    counts = docs.select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in counts.collect()}  # a row for each licence word, and one of no word for all documents
    return Index(phrases, templates, found, found.get("", 0), **how)


_FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def with_licences(docs: DataFrame, index: Index, name: str = "licence") -> DataFrame:
    """docs with a struct `name` (in place of a column of that name): n_words; n_base, first_word, last_word, the number of places of
    phrases and the first and last of them (null if none); base_labels and labels, the phrases' and all labels, sorted and joined by commas;
    score, 1 where a phrase stands, else the largest share of a found template's words in place, else 0. A null text is an empty
    one, repeated rows are rows of their own, whole texts are read."""

    @F.pandas_udf(_FOUND)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = [index.scan(t) for t in texts]
        out = pd.DataFrame(rows, columns=[f.split()[0] for f in _FOUND.split(", ")])
        return out.astype({c: "Int64" for c in ("n_words", "n_base", "first_word", "last_word")} | {"score": "float64"})

    return docs.withColumn(name, scan(F.coalesce(F.col("text"), F.lit(""))))


def plain_words(text: str | None) -> list[str]:
    """What words_of returns, as the pattern says it; for tests."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
