"""Whole-text encoding with the ``tokenizers`` library, a batch at a time.

Byte-pair tokenizers treat white-space separated words on their own: no
pre-token runs on past a word into the space or line feed that follows it.
Texts whose white space is single spaces and line feeds are therefore cut
before each of them, and only words not met before by this worker are encoded
(joined by a special token, so each is a segment of its own).  All other texts
are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Texts with other white space than single inner spaces and line feeds, or
#: with what may be a special token, are encoded whole.
_WHOLE = (r"[ \n][ \n]|[\x00-\x09\x0b-\x1f\x7f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}"
          r"\x{205f}-\x{206f}\x{3000}\x{feff}]|^[ \n]|[ \n]$|<\|")
#: Words a worker remembers before it starts anew (about 300 MB).
CACHE_WORDS = 1_500_000
_FIRST = "\x01"
_workers: dict[str, "Encoder"] = {}


def slices(lengths: np.ndarray, limit: int):
    """(from, to) of consecutive items with at most ``limit`` in total, or one item."""
    ends, at = np.cumsum(lengths), 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield at, to
        at = to


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``flat[s:s + n]`` over all (s, n)."""
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


class Encoder:
    def __init__(self, path: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()
                   if t.special and t.content.startswith("<|") and not (t.lstrip or t.rstrip or t.single_word)}
        self.between, self.between_id = min(special.items(), key=lambda x: x[1], default=("", -1))
        self._forget()

    def _forget(self):
        self.known: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32)
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]):
        flats, lengths = [self.flat], [self.lengths]
        for at in range(0, len(words), 2000):
            part = words[at:at + 2000]
            joined = self.between.join(
                w[1:] if w[:1] == _FIRST else w if w[:1] == "\n" else " " + w for w in part)
            ids = self._whole([joined])[0]
            cuts = np.flatnonzero(ids == self.between_id)
            assert len(cuts) == len(part) - 1
            bounds = np.concatenate(([-1], cuts, [len(ids)]))
            flats.append(ids[ids != self.between_id])
            lengths.append(np.diff(bounds) - 1)
            self.known.update(zip(part, range(len(self.known), len(self.known) + len(part))))
        self.flat, self.lengths = np.concatenate(flats), np.concatenate(lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _words(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their number per text."""
        first, nothing = pa.scalar(_FIRST, texts.type), pa.scalar("", texts.type)
        marked = pc.binary_join_element_wise(first, pc.replace_substring(texts, "\n", " \n"), nothing)
        parts = pc.split_pattern(marked, " ")
        words = pc.list_flatten(parts).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.known) + len(distinct) > CACHE_WORDS:
            self._forget()
        self._learn([w for w in distinct if w not in self.known])
        of = np.fromiter((self.known[w] for w in distinct), np.int64, len(distinct))[
            words.indices.to_numpy(zero_copy_only=False)]
        total = np.concatenate(([0], np.cumsum(self.lengths[of])))
        bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy())))
        return gather(self.flat, self.starts[of], self.lengths[of]), np.diff(total[bounds])

    def encode(self, texts: pa.LargeStringArray, limit: int = 4 << 20):
        """Yield (first text, ids, ids per text) for runs of texts of about
        ``limit`` bytes; each text ends with ``end_id`` if one is set."""
        for a, b in slices(pc.binary_length(texts).to_numpy(), limit):
            part = texts.slice(a, b - a)
            whole = (pc.match_substring_regex(part, _WHOLE).to_numpy(zero_copy_only=False)
                     if self.between else np.ones(b - a, bool))
            found: list = [None] * (b - a)
            plain = np.flatnonzero(~whole)
            if len(plain):
                ids, counts = self._words(part.take(pa.array(plain)))
                for i, x in zip(plain.tolist(), np.split(ids, np.cumsum(counts)[:-1])):
                    found[i] = x
            odd = np.flatnonzero(whole)
            for i, x in zip(odd.tolist(), self._whole([part[int(i)].as_py() for i in odd])):
                found[i] = x
            if self.end_id is not None:
                end = np.array([self.end_id], np.uint32)
                found = [y for x in found for y in (x, end)]
                lengths = np.array([len(x) + 1 for x in found[::2]], np.int64)
            else:
                lengths = np.array([len(x) for x in found], np.int64)
            yield a, np.concatenate(found), lengths


def encoder(path: str, end_id: int | None) -> Encoder:
    """This worker's encoder for a vocabulary file; it stays between tasks."""
    key = f"{path}|{end_id}"
    if key not in _workers:
        _workers[key] = Encoder(path, end_id)
    return _workers[key]
