"""Token ids of a lower-casing word BPE (tokenizers ``.json``), one pre-token at a time.

The tokenizer drops white space, lower-cases, and merges within a pre-token only, so a text's ids are its pre-tokens'
ids in a row. Texts whose characters are all below U+0180 are cut here, and their chunks looked up in a worker's
caches; unseen pre-tokens are encoded by the library, many in one call. Any other text, and one that may hold a special
string (it has "<|"), goes to the library whole. Both ways give the library's ids.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Mapping

import numpy as np

#: Latin letters and numbers below U+0180 as Unicode has them, after lower-casing; the tokenizer's white space.
_LETTERS, _NUMBERS, _SPACE = "a-zªµºß-öø-ÿĀ-ſ", "0-9²³¹¼-¾", " \\t\\n\\x0b\\x0c\\r\\x85\\xa0"
_PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+")
#: U+0130 grows when lower-cased.
_ODD = re.compile("[^\x00-įı-ſ]")
#: A full stop or comma that follows another mark belongs to its pre-token.
_MARKS = re.compile("[^\\s0-9a-zß-öø-ÿ][.,][ \\n]")
#: White space to ``str.split`` but not to the tokenizer.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def chunks(text: str) -> list[str] | None:
    """Lower-cased pieces between which the tokenizer joins nothing; None for a text that is left to the library."""
    if "<|" in text or not text.isascii() and _ODD.search(text) or _SEPARATORS.search(text):
        return None
    text = text.lower()
    if not _MARKS.search(text):
        text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n")
    return text.split()


class WordEncoder:
    """Bytes of ids (little-endian, 16 bits where the vocabulary fits) for texts, with a bounded cache.

    Two caches: of chunks, and of the pre-tokens that chunks other than plain words are cut into. ``value`` turns
    the bytes of a pre-token's ids into what they hold, ``join`` puts those of a chunk together, and ``known`` is a
    read-only first tier of chunks. A cache that passes ``cache_size`` starts again: results don't change.
    """

    def __init__(self, path: str, known: Mapping[str, object] | None = None, value=bytes, join=b"".join, cache_size: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocab.values(), default=0) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.known, self.value, self.join, self.cache_size = dict(known or {}), value, join, cache_size
        self.chunks: dict[str, object] = dict(self.known)
        self.words: dict[str, object] = {}

    def whole(self, text: str):
        return self.value(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes())

    def learn(self, words: list[str], into: dict) -> None:
        """Encode pre-tokens, a few thousand to a call; ids that end a word tell where each one stops."""
        for i in range(0, len(words), 2048):
            part = words[i : i + 2048]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):  # a vocabulary without word ends
                into.update((w, self.whole(w)) for w in part)
                continue
            raw, width, start = ids.tobytes(), self.dtype.itemsize, 0
            for word, stop in zip(part, (stops * width).tolist()):
                into[word] = self.value(raw[start:stop])
                start = stop

    def pieces(self, texts: list[str]) -> Iterable[list]:
        """For each text the list of its chunks' values; a list of one for a text that the library took whole."""
        for i in range(0, len(texts), 256):
            part = texts[i : i + 256]
            cut = [chunks(t) for t in part]
            seen: set[str] = set().union(*filter(None, cut))
            unseen = seen.difference(self.chunks)
            if len(self.chunks) + len(unseen) > len(self.known) + self.cache_size:
                self.chunks, unseen = dict(self.known), seen.difference(self.known)
            self.learn([c for c in unseen if c.isalpha()], self.chunks)
            mixed = {c: _PRETOKEN.findall(c) for c in unseen if not c.isalpha()}
            missing = set().union(*mixed.values()).difference(self.words)
            if len(self.words) + len(missing) > self.cache_size:
                self.words, missing = {}, set().union(*mixed.values())
            self.learn(list(missing), self.words)
            for c, found in mixed.items():
                self.chunks[c] = self.join(map(self.words.__getitem__, found))
            get = self.chunks.__getitem__
            for text, found in zip(part, cut):
                yield [self.whole(text)] if found is None else list(map(get, found))
