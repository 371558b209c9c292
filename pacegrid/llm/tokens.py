"""Token ids of whole texts, by the tokenizers library with a cache of words."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

from .common import Codes, ragged

END_ID = 1
#: Fixed value: the vocabulary's own rule for parting a word into pieces that are encoded apart.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts with these go to the library whole: white space to str.split() alone, a letter whose lower case depends on its place.
_ODD = re.compile("[\x1c-\x1fΣ]|<\\|")


class WordEncoder:
    """Ids of whole texts. The vocabulary's rules never join what white space parts, so the ids of each word are made
    once, by the library, and then looked up; a test holds the ids against the library's own over whole texts."""

    def __init__(self, path: str, most: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids are held in 16 bits: a vocabulary of over 65,536 ids can't be used")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.codes = Codes(most)
        self._empty()

    def _empty(self) -> None:
        self.codes.restart()
        self.pieces: dict[str, bytes] = {}  # ids as 16-bit numbers
        self.flat, self.starts, self.lengths, self.used = np.zeros(1 << 16, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _encode_pieces(self, pieces: list[str]) -> None:
        for k in range(0, len(pieces), 500):
            some = pieces[k : k + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint16)
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(some) and at[-1] == len(ids):
                cut, raw = [0, *(2 * at).tolist()], ids.tobytes()
                self.pieces.update((p, raw[a:b]) for p, a, b in zip(some, cut, cut[1:]))
            else:
                self.pieces.update((p, np.array(e.ids, np.uint16).tobytes()) for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)))

    def _learn(self) -> None:
        parts = [[w] if w.isalpha() else PIECES.findall(w) for w in self.codes.fresh]
        self.codes.fresh = []
        self._encode_pieces(list(dict.fromkeys(p for x in parts for p in x if p not in self.pieces)))
        ids = [self.pieces[x[0]] if len(x) == 1 else b"".join([self.pieces[p] for p in x]) for x in parts]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        flat = np.frombuffer(b"".join(ids), np.uint16)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used += len(flat)

    def encode(self, texts: list[str | None]):
        """For each text its ids and the end id, as uint32 array. None counts as the empty text."""
        k = 0
        while k < len(texts):
            if self.codes.full():
                self._empty()
            some, size = [], 0
            while k < len(texts) and size < 4_000_000:  # new words are encoded together
                text, k = texts[k] or "", k + 1
                size += len(text)
                if _ODD.search(text) or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
                    some.append(text)
                else:
                    some.append(self.codes.of(text.lower().split()))
            if self.codes.fresh:
                self._learn()
            for x in some:
                if isinstance(x, str):
                    yield np.array([*self.tokenizer.encode(x, add_special_tokens=False).ids, END_ID], "<u4")
                    continue
                lengths = self.lengths[x]
                out = np.empty(int(lengths.sum()) + 1, "<u4")
                out[:-1] = self.flat[ragged(self.starts[x], lengths)]
                out[-1] = END_ID
                yield out


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker: it outlives a task, and so do its words."""
    return WordEncoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
