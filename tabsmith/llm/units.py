"""Token ids of texts by the ``tokenizers`` library, one distinct unit at a time.

Texts are cut where the tokenizer's own split can't be crossed by a token, so a
text's ids are its units' ids in order, and a unit that comes again is looked up.

* ``byte``: byte-level BPE. Units are runs of non-white space with at most one
  space in front, and runs of white space, cut exactly as the tokenizer's
  pattern cuts them (a unit is a whole number of its matches).
* ``word``: word BPE that drops white space. Units are the runs between.
"""

from __future__ import annotations

import gc
import os
import re
from functools import lru_cache
from operator import itemgetter

import numpy as np

#: FIXED VALUE: Unicode white space, as the inside of a character class.
WHITE = "\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
BYTE_UNITS = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
WORD_UNITS = re.compile(rf"[^{WHITE}]+")
#: str.split() also splits at these, which are no Unicode white space.
CONTROL = re.compile(r"[\x1c-\x1f]")
#: FIXED VALUE: ASCII marks that are a word of their own behind letters (the apostrophe isn't one).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that are given to the tokenizer as one text.
JOINED = 64
#: Cached units per worker, and the longest unit that is cached: some 250 MB.
CACHE_UNITS, CACHE_CHARS = 1_700_000, 48


def byte_units(text: str) -> list[str]:
    return BYTE_UNITS.findall(text)


def word_units(text: str) -> list[str]:
    return text.split() if CONTROL.search(text) is None else WORD_UNITS.findall(text)


class _Known(dict):
    """Units' values; asking for others gives None and notes them."""

    def __init__(self, items=()):
        super().__init__(items)
        self.missed: list[str] = []

    def __missing__(self, unit: str) -> None:
        self.missed.append(unit)


class UnitCache:
    """What units stand for, joined to what their texts stand for; a subclass finds new units' values."""

    def __init__(self, split, limit: int = CACHE_UNITS):
        self.split, self.limit = split, limit
        self.cache = _Known()

    def find(self, units: list[str]) -> list[bytes]:
        raise NotImplementedError

    def encode(self, texts: list[str | None]) -> list[bytes]:
        units = [self.split(t) if t else [] for t in texts]
        cache = self.cache
        values = [list(map(cache.__getitem__, u)) for u in units]
        new = list(dict.fromkeys(cache.missed))
        cache.missed.clear()
        found = dict(zip(new, self.find(new)))
        out = [b"".join([found[x] if y is None else y for x, y in zip(u, v)] if None in v else v)
               for u, v in zip(units, values)]
        cache.update((x, y) for x, y in found.items() if len(x) <= CACHE_CHARS)
        if len(cache) > self.limit:             # only what the last texts used stays
            self.cache = _Known((x, cache[x]) for u in units for x in u if x in cache)
            if len(self.cache) > self.limit // 2:
                self.cache = _Known()
        return out


class UnitEncoder(UnitCache):
    """Encodes texts to little-endian ids of ``width`` bytes."""

    def __init__(self, path: str, kind: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        super().__init__(byte_units if kind == "byte" else word_units)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True      # their strings in a text are ordinary text
        self.kind, self.dtype = kind, f"<u{width}"
        # the tokens that end a word, or that begin with the space before one
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.edge[number] = token.endswith("</w>") if kind == "word" else token.startswith(chr(0x120))
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 256 ** width:
            raise ValueError(f"ids of {path} need more than {width} bytes")

    def find(self, units: list[str]) -> list[bytes]:
        known, word = self.cache, self.kind == "word"
        heads, tails, unknown = [], [], set()
        for u in units:
            if word and u.isascii():
                u = u.lower()                   # the tokenizer does it anyway, and for ASCII it doesn't matter when
            head = u.rstrip(MARKS)
            tail = u[len(head):]
            # letters when lower-cased too: a mark that lower-casing adds would join the tail
            if tail and not (head.lower().isalpha() or head[:1] == " " and head[1:].isalpha()):
                head, tail = u, ""
            heads.append(head)
            tails.append(tail)
            if head not in known:
                unknown.add(head)
            if tail and tail not in known:
                unknown.add(tail)
        new = self._encode(list(unknown))
        known.update((x, y) for x, y in new.items() if len(x) <= CACHE_CHARS)
        new[""] = b""
        return [(new[h] if h in new else known[h]) + (new[t] if t in new else known[t]) for h, t in zip(heads, tails)]

    def _encode(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of each part. Single words go together; where each begins or ends shows in its tokens."""
        word = self.kind == "word"
        single = (lambda p: p.isascii() and p.isalpha()) if word else (lambda p: p[:1] == " " and p[1:].isalpha())
        plain = [p for p in parts if single(p)]
        rest = [p for p in parts if not single(p)]
        out: dict[str, bytes] = {}
        groups = [plain[i:i + JOINED] for i in range(0, len(plain), JOINED)]
        glue = " " if word else ""
        made = self.tokenizer.encode_batch_fast([glue.join(g) for g in groups], add_special_tokens=False)
        width = np.dtype(self.dtype).itemsize
        for g, e in zip(groups, made):
            ids = np.array(e.ids, self.dtype)
            at = np.flatnonzero(self.edge[ids])
            if len(at) != len(g):               # a word that is none to the tokenizer
                rest += g
                continue
            ends = ((at + 1) if word else np.append(at[1:], len(ids))) * width
            raw, start = ids.tobytes(), 0
            for p, end in zip(g, ends.tolist()):
                out[p] = raw[start:end]
                start = end
        made = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        out.update((p, np.array(e.ids, self.dtype).tobytes()) for p, e in zip(rest, made))
        return out


#: Marks that join an ASCII letter in front of them, sometimes in one case only.
COMBINING = re.compile("[\u0300-\u036f]")


class WordEncoder(UnitEncoder):
    """Encodes by word BPE. A-Z are lower-cased first, which the tokenizer does anyway, so that words have one
    form; not where a combining mark could join a letter in one case and not in the other."""

    def __init__(self, path: str):
        super().__init__(path, "word", 2)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        collects = gc.isenabled()
        gc.disable()                        # half the time would go into walking the lists of words; no cycles are made
        try:
            return self._encode_texts(texts)
        finally:
            if collects:
                gc.enable()

    def _encode_texts(self, texts: list[str | None]) -> list[bytes]:
        cache = self.cache
        units = [word_units(t if COMBINING.search(t) else t.encode().lower().decode()) if t else [] for t in texts]
        new = list(set().union(*units).difference(cache))
        cache.update(zip(new, self.find(new)))
        out = [b"".join(itemgetter(*u)(cache)) if len(u) > 1 else b"".join(cache[x] for x in u) for u in units]
        for x in new:
            if len(x) > CACHE_CHARS:
                del cache[x]
        if len(cache) > self.limit:
            cache.clear()
        return out


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """The worker's word encoder."""
    return WordEncoder(path)


@lru_cache(maxsize=4)
def unit_encoder(path: str, kind: str, width: int) -> UnitEncoder:
    """The worker's encoder; its cache serves all tasks the worker runs."""
    return UnitEncoder(path, kind, width)


def text_groups(ids: list, texts: list, limit: int = 4 << 20):
    """(ids, texts) in groups of about ``limit`` characters, one text at least."""
    i, n = 0, len(texts)
    while i < n:
        j, size = i, 0
        while j < n and (j == i or size < limit):
            size += len(texts[j] or "")
            j += 1
        yield ids[i:j], texts[i:j]
        i = j
