"""Encoding with a public vocabulary: each distinct word goes through the tokenizer once per worker."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from .buffers import Texts, kept_between_tasks

# Entries and ids of a pool before it is emptied; bounds a worker's memory to some 100 MB.
POOL_ENTRIES, POOL_IDS = 300_000, 4_000_000
# Entries of a pool where a worker holds no other caches; some 60 MB each for words and their pieces.
LARGE_POOL = 1_040_000
# New pieces that go through the tokenizer at once.
PIECES_AT_ONCE = 10_000
# Words of these characters need no Unicode normalisation, and lower-casing them has no context.
_PLAIN_LINES = re.compile(r"[\n!-~À-ÖØ-öø-ÿ]*")
# Fixed value: the vocabulary's rule for cutting lower-case text, for plain words; a line holds a word.
_PIECES = re.compile(r"[a-zß-öø-ÿ]+|\n|[0-9]|'(?:s|t|re|ve|m|ll|d)|[!-/:-@\[-`{-~]+")


class IdPool:
    """Token ids by a 64-bit key, for whole arrays of keys at a time (open addressing)."""

    def __init__(self, most: int = POOL_ENTRIES):
        self.most = most
        self._clear(1 << 16)

    def _clear(self, slots: int) -> None:
        self.slots, self.entries = np.full(slots, -1, np.int32), 0
        self.keys = np.zeros(slots // 2, np.uint64)
        self.offsets, self.counts = np.zeros(slots // 2, np.int64), np.zeros(slots // 2, np.int64)
        self.flat, self.used = np.zeros(slots, np.uint32), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry number of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            entry = self.slots[slot]
            hit = (entry >= 0) & (self.keys[np.maximum(entry, 0)] == keys[left])
            out[left[hit]] = entry[hit]
            go = (entry >= 0) & ~hit
            left, slot = left[go], (slot[go] + 1) & (len(self.slots) - 1)
        return out

    def make_room(self, more: int) -> bool:
        """Empty a full pool, and say whether it was. Entry numbers found before are void then."""
        full = self.entries + more > self.most or self.used > POOL_IDS
        if full:
            self._clear(1 << 16)
        return full

    def found(self, keys: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Entry number of each key; ``make`` gives ids and their numbers for places of ``keys`` that are new."""
        entries = self.find(keys)
        missing = np.flatnonzero(entries < 0)
        if len(missing):
            new = np.sort(missing[np.unique(keys[missing], return_index=True)[1]])
            if self.make_room(len(new)):
                missing, new = np.arange(len(keys)), np.sort(np.unique(keys, return_index=True)[1])
            self.add(keys[new], *make(new))
            entries[missing] = self.find(keys[missing])
        return entries

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Add distinct new keys with their ids, which follow one another in ``ids``."""
        n, total = self.entries + len(keys), self.used + len(ids)
        while len(self.keys) < n:
            self.keys, self.offsets, self.counts = (
                np.concatenate([a, np.zeros_like(a)]) for a in (self.keys, self.offsets, self.counts)
            )
        while len(self.flat) < total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.keys[self.entries : n], self.counts[self.entries : n] = keys, counts
        self.offsets[self.entries : n] = self.used + np.cumsum(counts) - counts
        self.flat[self.used : total] = ids
        fresh = np.arange(self.entries, n, dtype=np.int32)
        self.entries, self.used = n, total
        if 2 * n > len(self.slots):
            self.slots = np.full(4 * len(self.slots), -1, np.int32)
            fresh = np.arange(n, dtype=np.int32)
        slot = self._slot(self.keys[fresh])
        while len(fresh):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = fresh[free]  # of several for one slot the last stays
            go = self.slots[slot] != fresh
            fresh, slot = fresh[go], (slot[go] + 1) & (len(self.slots) - 1)

    def ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries one after another, and how many each has."""
        counts = self.counts[entries]
        return self.flat[places(self.offsets[entries], counts)], counts


def places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def _byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and number the others from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordEncoder:
    """Token ids of texts as the tokenizer file gives them without special tokens added.

    The vocabulary drops white space and never merges across it, so a text's ids are those of
    its words in turn, and a distinct word is put together once per pool of ``most`` entries. The
    pieces that the vocabulary's rule cuts words into have a pool of their own, so that a word met
    with other signs around it costs no merges.
    """

    def __init__(self, path: str, most: int = POOL_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.characters = _byte_characters()
        # The same model on pieces that are cut already, one a line.
        self.lines = Tokenizer(self.tokenizer.model)
        self.lines.pre_tokenizer = Split("\n", "removed")
        suffix = self.tokenizer.model.end_of_word_suffix or "\n"
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(self.size)])
        self.pool, self.pieces = IdPool(most), IdPool(most)

    def _tokenized(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after another, and their number."""
        spelled = [p if p.isascii() else p.encode().decode("latin-1").translate(self.characters) for p in pieces]
        ids = np.array(self.lines.encode_batch_fast(["\n".join(spelled)], add_special_tokens=False)[0].ids, np.uint32)
        # The last token of a piece, and no other, ends in the suffix.
        counts = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(counts) != len(pieces) or counts.sum() != len(ids):
            own = [[t.id for t in self.tokenizer.model.tokenize(p)] for p in spelled]
            ids, counts = np.array([i for o in own for i in o], np.uint32), np.array([len(o) for o in own], np.int64)
        return ids, counts

    def _plain_words(self, lines: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for words of plain letters, digits and signs; a piece is encoded once per pool."""
        pieces = _PIECES.findall(lines.lower())
        keys = np.fromiter(map(hash, pieces), np.int64, len(pieces)).view(np.uint64)
        line_end = keys == np.array([hash("\n")]).view(np.uint64)
        own = np.flatnonzero(~line_end)

        def make(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            parts = [new[k : k + PIECES_AT_ONCE] for k in range(0, len(new), PIECES_AT_ONCE)]
            done = [self._tokenized([pieces[i] for i in own[part].tolist()]) for part in parts]
            return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])

        ids, counts = self.pieces.ids(self.pieces.found(keys[own], make))
        word = np.cumsum(line_end)
        return ids, np.bincount(word[own], weights=counts, minlength=int(word[-1])).astype(np.int64)

    def words(self, lines: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one a line, and their number; odd words take the tokenizer's whole path."""
        if not any(s in lines for s in self.special) and _PLAIN_LINES.fullmatch(lines):
            return self._plain_words(lines)
        words = lines.split("\n")[:-1]
        plain = np.array([bool(_PLAIN_LINES.fullmatch(w)) and not any(s in w for s in self.special) for w in words])
        odd = [self.tokenizer.encode(words[i], add_special_tokens=False).ids for i in np.flatnonzero(~plain).tolist()]
        counts = np.zeros(len(words), np.int64)
        counts[~plain] = [len(o) for o in odd]
        own = np.zeros(0, np.uint32)
        if plain.any():
            own, counts[plain] = self._plain_words("\n".join([*(words[i] for i in np.flatnonzero(plain).tolist()), ""]))
        at = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), np.uint32)
        ids[places(at[plain], counts[plain])] = own
        ids[places(at[~plain], counts[~plain])] = [i for o in odd for i in o]
        return ids, counts

    def entries(self, texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pool entries of words given by byte spans; a space follows each."""

        def make(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            sizes = ends[new] - starts[new] + 1
            lines = texts.data[places(starts[new], sizes)]
            lines[np.cumsum(sizes) - 1] = ord("\n")
            return self.words(lines.tobytes().decode("utf-8", "replace"))

        return self.pool.found(texts.spans_hash(starts, ends), make)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        starts, ends, owner = texts.words()
        ids, counts = self.pool.ids(self.entries(texts, starts, ends))
        return ids, np.bincount(owner, weights=counts, minlength=len(texts.offsets) - 1).astype(np.int64)


@lru_cache(maxsize=1)
def encoder(path: str, most: int = POOL_ENTRIES) -> WordEncoder:
    """The worker's encoder for a vocabulary file; it lives until another is asked for, or as long as the worker."""
    return WordEncoder(path, most)


kept_between_tasks(encoder.cache_clear)
