"""Encoding with a ``tokenizers`` vocabulary that drops white space: one encoding per distinct word and worker."""

from __future__ import annotations

import functools
import os
import re
import unicodedata

import numpy as np

#: White space for Python's str.split, but not for the vocabulary's own pattern.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Signs that may follow a word; an apostrophe isn't one, since it may bind to letters.
TAIL = ".,;:!?|%&$#*\"()[]{}<>/\\+=~^_-…»”"
#: Letters whose lower case depends on their place, or has more than one character.
ODD_CASE = re.compile("[Σİ]")
#: Signs that are set apart in a whole text, and what a text must not have for that: such a sign beside another sign,
#: with which it would make one token, or the characters above.
APART = ".,;:!?"
ODD_LETTER = re.compile("[\x1c-\x1fΣİ]")
BESIDE_A_SIGN = re.compile(r"[.,;:!?](?:(?=[^\s\w])|(?=_)|(?<=[^\s\w].)|(?<=_.))")
#: How byte-level vocabularies write the bytes of a word: printable ones as themselves, others from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: b for b in _PLAIN} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


class WordEncoder:
    """Ids of whole texts as packed little-endian integers.

    The vocabulary normalizes, lower-cases and splits without looking across white space, and splits letters from
    signs, so the ids of a text are those of its words and of the signs after them, in order.  Each distinct word
    is encoded once and kept (bounded by ``keep`` tokens); texts with control characters that only Python takes for
    white space, or with strings of special tokens, are encoded as a whole.
    """

    def __init__(self, path: str, keep: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Strings of special tokens, which the library finds in the text as it stands, before it is lower-cased.
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)", re.I)
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 65536 else "<u4")
        self.known: dict[str, bytes] = {}
        self.keep = keep
        self.model = self.tokenizer.model
        probe = ["hello", "thé", "größe", "señor", "日本", "a", "ðþ", "heheingthation"]
        #: Whether words of lower-case letters may go to the merges straight, past the normalizer and the pattern.
        self.direct = [self._merged(w) for w in probe] == [e.ids for e in self.tokenizer.encode_batch_fast(probe, add_special_tokens=False)]

    def _merged(self, word: str) -> list[int]:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(BYTE_SIGNS)
        return [t.id for t in self.model.tokenize(word)]

    def _split(self, text: str | None) -> list[str] | None:
        """A text's words, if its ids are theirs in order; lower-cased and with signs apart where that changes nothing."""
        if not text:
            return []
        if self.special.search(text):
            return None
        if ODD_LETTER.search(text) or not self.direct or BESIDE_A_SIGN.search(text):
            return None if ODD_SPACE.search(text) else text.split()
        text = text.lower()
        for sign in APART:
            text = text.replace(sign, f" {sign} ")
        return text.split()

    def _learn(self, new: set[str]) -> None:
        plain, heads, lows, tails = [], [], [], []
        for t in new:
            head = t.rstrip(TAIL)
            if head.isalpha():
                low = head.lower()
                if low.isascii() or not ODD_CASE.search(head) and unicodedata.is_normalized("NFC", head) and unicodedata.is_normalized("NFC", low):
                    if self.direct or len(head) < len(t) or low != t:
                        heads.append(t)
                        lows.append(low)
                        tails.append(t[len(head) :])
                        continue
            plain.append(t)
        known, width = self.known, self.width
        words = set(lows)
        if self.direct:
            merged = self._merged
            for w in words.difference(known):
                known[w] = np.array(merged(w), width).tobytes()
        need = words.union(tails, plain).difference(known)
        need.discard("")
        need = list(need)
        for at in range(0, len(need), 20_000):
            part = need[at : at + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, width).tobytes()
        known[""] = b""
        for t, a, b in zip(heads, lows, tails, strict=True):
            known[t] = known[a] + known[b] if b else known[a]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = list(map(self._split, texts))
        words = set().union(*filter(None, split))
        new = words.difference(self.known)
        if len(self.known) + len(new) > self.keep:  # the words of now stay; most others came once
            self.known = {w: self.known[w] for w in words.difference(new)}
        if new:
            self._learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, s)) if s is not None else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.width).tobytes() for s, t in zip(split, texts, strict=True)]

    def wide(self, ids: bytes) -> bytes:
        """The same ids as little-endian unsigned 32-bit integers."""
        return np.frombuffer(ids, self.width).astype("<u4").tobytes()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """This worker's encoder: what one task has learnt helps the next."""
    return WordEncoder(path)
