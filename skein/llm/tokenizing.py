"""Whole texts to token ids with a public vocabulary file.

A text is cut before single spaces and around single line feeds that stand between two plain characters, and before a sign that
follows a letter or digit. Both kinds of public vocabulary start a new token there whatever stands around, so the ids of a text are those of its pieces in turn, and each
distinct piece goes through the tokenizer once while it stays in the worker's cache. Pieces of a space and letters, which are nearly all,
go to it many in one text, as that takes a third of the time; the tokens that begin or end a word show where each one's ids lie.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from skein.llm import kernels

#: Distinct pieces that a worker keeps; past that it keeps those seen in more than one slice.
CACHE = 500_000
SLICE = 4 << 20
#: Pieces joined in one text for the tokenizer.
JOINED = 256
#: A space and letters, of one byte or two. A cut is safe before and after each.
_word = re.compile("[ ][A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u027f]+")
_PLAIN, _ALNUM, _LEAD, _HIGH, _SIGN, _SPACE, _LINE = (1 << i for i in range(7))
#: What a byte is: bits of the above.
_kinds = np.zeros(256, np.uint8)
_kinds[0x21:0x7F] |= _PLAIN
for _first, _last in ("09", "AZ", "az"):
    _kinds[ord(_first) : ord(_last) + 1] |= _ALNUM
_kinds[0xC3:0xCA] |= _LEAD  # letters of two bytes, but for the signs C3 97 and C3 B7; no white space and no combining mark
_kinds[0x80:] |= _HIGH
_kinds[[0x97, 0xB7]] |= _SIGN
_kinds[0x20] |= _SPACE
_kinds[0x0A] |= _LINE
_encoders: dict[tuple[str, int], Encoder] = {}


class Encoder:
    def __init__(self, path: str, cache: int):
        self.cache = cache
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.folds = "Lowercase" in str(self.model.normalizer)  # then A-Z and a-z need only one entry
        self.first, self.last = self._marks()
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.at = np.zeros(1 << 18, np.int64)  # start of each known piece's ids; the next one's start ends it
        self.seen = np.zeros(1 << 18, np.int32)
        self.used = 0

    def _marks(self) -> tuple[np.ndarray | None, np.ndarray | None]:
        """Ids that begin a word after a space, or, in vocabularies that mark ends, ids that end one. Neither: nothing is joined."""
        vocabulary = self.model.get_vocab()
        suffix = getattr(self.model.model, "end_of_word_suffix", None)
        if not suffix and not (self.model.normalizer is None and "ByteLevel" in str(self.model.pre_tokenizer)):
            return None, None
        marks = np.zeros(max(vocabulary.values()) + 1, bool)
        marks[[i for token, i in vocabulary.items() if (token.endswith(suffix) if suffix else token.startswith("\u0120"))]] = True
        return (None, marks) if suffix else (marks, None)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        got = [encoding.ids for encoding in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum())), size

    def _encode_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts of a space and letters. Each has one mark at least; if all together have no more, the marks are their bounds."""
        if self.first is None and self.last is None:
            return self._encode(texts)
        ids, _ = self._encode(["".join(texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)])
        bounds = np.append(np.flatnonzero(self.first[ids]), len(ids)) if self.last is None else np.append(0, np.flatnonzero(self.last[ids]) + 1)
        if len(bounds) != len(texts) + 1 or bounds[0] or bounds[-1] != len(ids):  # a letter that the vocabulary's lower case makes two signs
            return self._encode(texts)
        return ids, np.diff(bounds)

    def _trim(self) -> None:
        """Forget the pieces seen in one slice only, and all if that leaves too many."""
        n = len(self.known)
        keep = self.seen[:n] > 1
        if keep.sum() > self.cache // 2:
            keep[:] = False
        size = np.diff(self.at[: n + 1])
        self.ids[: int(size[keep].sum())] = self.ids[: self.used][np.repeat(keep, size)]
        self.known = dict(zip((t for t, k in zip(self.known, keep.tolist()) if k), range(int(keep.sum()))))
        n = len(self.known)
        self.at[1 : n + 1] = np.cumsum(size[keep])
        self.seen[:n] = 1
        self.used = int(self.at[n])

    def _learn(self, texts: list[str]) -> None:
        words, others = [], []
        for text in texts:
            (words if _word.fullmatch(text) else others).append(text)
        for texts, encode in ((words, self._encode_words), (others, self._encode)):
            for first in range(0, len(texts), 8192):
                part = texts[first : first + 8192]
                ids, size = encode(part)
                n, total = len(self.known), len(ids)
                while self.used + total > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
                while n + len(part) + 1 > len(self.at):
                    self.at, self.seen = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.seen, np.zeros_like(self.seen)])
                self.ids[self.used : self.used + total] = ids
                self.at[n + 1 : n + 1 + len(part)] = self.used + np.cumsum(size)
                self.seen[n : n + len(part)] = 0
                self.known.update(zip(part, range(n, n + len(part))))
                self.used += total

    def slice(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice, and each row's offsets into them."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        if self.folds:
            data = kernels.LOWER[data]
        cut = np.zeros(len(data) + 1, bool)
        kinds = _kinds[data]
        if len(data) > 2:
            before, here, after = kinds[:-2], kinds[1:-1], kinds[2:]
            letter = (here & _HIGH != 0) & (before & _LEAD != 0)
            cut[2:-1] = (after & (_PLAIN | _ALNUM) == _PLAIN) & ((here & _ALNUM != 0) | letter & (here & _SIGN == 0))
            cut[1] = kinds[1] & (_PLAIN | _ALNUM) == _PLAIN and kinds[0] & _ALNUM != 0
            # a space at i, between data[i - 1] and data[i + 1]
            between = before & _PLAIN != 0
            between[1:] |= letter[:-1]
            between &= after & (_PLAIN | _LEAD) != 0
            cut[1:-2] |= (here & (_SPACE | _LINE) != 0) & between
            cut[2:-1] |= (here & _LINE != 0) & between  # a line feed alone is a token, or none
        cut[at] = True
        cut = np.flatnonzero(cut)
        texts = pa.LargeStringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut), pa.py_buffer(data))
        coded = texts.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > self.cache:
            self._trim()
        number = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(number < 0)
        if len(new):
            texts = [distinct[i] for i in new.tolist()]
            self._learn(texts)
            number[new] = np.fromiter(map(self.known.__getitem__, texts), np.int64, len(texts))
        self.seen[number] += 1
        number = number[coded.indices.to_numpy(zero_copy_only=False)]
        n = self.at[number + 1] - self.at[number]
        ends = np.cumsum(n)
        source = np.repeat(self.at[number] - (ends - n), n) + np.arange(int(ends[-1]))
        return self.ids[source], np.concatenate([[0], ends])[np.searchsorted(cut, at)]


def encoder(path: str, cache: int) -> Encoder:
    if (path, cache) not in _encoders:
        _encoders[path, cache] = Encoder(path, cache)
    return _encoders[path, cache]


def encode(path: str, values: pa.Array, end_id: int, size: int | None = None, cache: int | None = None):
    """For slices of rows of about `size` bytes: (first row, end row, ids with end_id after each row, offsets)."""
    model = encoder(path, CACHE if cache is None else cache)
    for first, end, data, at in kernels.slices(values, SLICE if size is None else size):
        ids, off = model.slice(data, at)
        n = np.diff(off) + 1
        bounds = np.concatenate([[0], np.cumsum(n)])
        out = np.full(int(bounds[-1]), end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[bounds[1:] - 1] = False
        out[keep] = ids
        yield first, end, out, bounds
