"""Token ids by the tokenizers library, with the ids of words met before kept per worker.

Encoding a text equals encoding its words one by one for two kinds of tokenizers: byte-level ones
whose pattern takes one white-space character together with or apart from the word behind it
("lead"; texts with runs of white space go whole), and ones that drop white space ("drop"). Others
encode whole texts ("whole"). Words are found by a 64-bit hash in arrays, so only words not met
before go through the tokenizer.
"""

from __future__ import annotations

import json
import os

import numpy as np

from tapeloom.llm import shared

#: Words kept by a worker (about 60 bytes each).
KNOWN = 600_000
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def gather(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of runs one after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = start - np.concatenate(([0], np.cumsum(length)[:-1]))
    return np.repeat(shift, length) + np.arange(total)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] for t in spec.get("added_tokens", []))
        parts = split.get("pretokenizers", [])
        if plain and not spec.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space"):
            self.kind = "lead"
        elif plain and parts and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert"):
            self.kind = "drop"
        else:
            self.kind = "whole"
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        #: Type of the ids: the narrowest unsigned one.
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        if self.kind == "lead":
            self.begins = np.zeros(size, bool)
            for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
                self.begins[i] = token[:1] in ("Ġ", "Ċ")
        self.stop = next(((t["content"], t["id"]) for t in spec.get("added_tokens", []) if t.get("special") and not t.get("normalized")), None)
        self.slots = np.full(4 << (KNOWN - 1).bit_length() >> 1, -1, np.int32)
        self.keys = np.zeros(KNOWN, np.uint64)
        self.at = np.zeros(KNOWN, np.int64)
        self.length = np.zeros(KNOWN, np.int32)
        self.n, self.pool, self.filled = 0, np.zeros(1 << 20, self.dtype), 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(keys), -1, np.int32), np.arange(len(keys))
        slot = (keys & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(todo):
            there = self.slots[slot]
            hit = (there >= 0) & (self.keys[there] == keys[todo])
            out[todo[hit]] = there[hit]
            on = (there >= 0) & ~hit
            todo, slot = todo[on], (slot[on] + 1) & (len(self.slots) - 1)
        return out

    def _add(self, keys: np.ndarray, at: np.ndarray, length: np.ndarray) -> None:
        new = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.keys[new], self.at[new], self.length[new] = keys, at, length
        self.n += len(keys)
        slot = (keys & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(new):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = new[free]
            on = self.slots[slot] != new
            new, slot = new[on], (slot[on] + 1) & (len(self.slots) - 1)

    def _keep(self, ids: np.ndarray) -> int:
        """Append ids to the pool; their place."""
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(len(self.pool), self.dtype)))
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)
        return self.filled - len(ids)

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        runs = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        length = np.fromiter(map(len, runs), np.int64, len(runs))
        return np.fromiter((i for r in runs for i in r), self.dtype, int(length.sum())), length

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of ids of each word."""
        ats, lengths = [], []
        for a in range(0, len(words), 4096):
            part, length = words[a : a + 4096], []
            if self.kind == "lead" and all(p[0] in " \n" for p in part):
                ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, self.dtype)
                length = np.diff(np.append(np.flatnonzero(self.begins[ids]), len(ids)))
            elif self.kind == "drop" and self.stop:  # a special token parts words
                ids = np.array(self.tokenizer.encode_batch_fast([self.stop[0].join(part)], add_special_tokens=False)[0].ids, self.dtype)
                cut = ids == self.stop[1]
                length = np.diff(np.concatenate(([-1], np.flatnonzero(cut), [len(ids)]))) - 1
                ids = ids[~cut]
            if len(length) != len(part):
                ids, length = self._one_by_one(part)
            at = self._keep(ids)
            lengths.append(length)
            ats.append(at + np.cumsum(length) - length)
        return np.concatenate(ats), np.concatenate(lengths)

    def encode(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all whole texts (UTF-8 bytes and offsets), without special tokens, and the offsets of each text's ids."""
        texts = len(bounds) - 1
        data = raw.tobytes()
        starts, ends, offsets = shared.word_spans(raw, bounds)
        whole = np.full(texts, self.kind == "whole")
        n_known, filled = self.n, self.filled
        if self.kind == "lead":
            blank = shared.SPACE[raw]
            ends_blank = (bounds[1:] > bounds[:-1]) & blank[np.maximum(bounds[1:] - 1, 0)] if len(raw) else whole
            twice = np.flatnonzero(blank[1:] & blank[:-1]) + 1
            wide = np.flatnonzero((raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3)))  # may begin other white space
            whole = ends_blank.copy()
            for where in (twice, wide):
                whole[np.searchsorted(bounds, where, "right") - 1] = True
        words, _ = shared.word_hashes(raw, bounds, fold=False)
        if whole.any():
            keep = ~np.repeat(whole, np.diff(offsets))
            starts, ends, words = starts[keep], ends[keep], words[keep]
            offsets = np.concatenate(([0], np.cumsum(np.where(whole, 0, np.diff(offsets)))))
        if self.kind == "lead" and len(starts):
            first = np.isin(starts, bounds[:-1])
            before = np.where(first, 0, raw[np.maximum(starts - 1, 0)]).astype(np.uint64)
            words = shared.mix(words + before * np.uint64(0xA0761D6478BD642F))
            starts = np.where(first, starts, starts - 1)
        found = self._find(words)
        miss = np.flatnonzero(found < 0)
        at, length = self.at[found], self.length[found].astype(np.int64)
        if len(miss):
            new, where, back = np.unique(words[miss], return_index=True, return_inverse=True)
            order = np.argsort(raw[starts[miss[where]]], kind="stable")  # those behind the same character together
            spans = miss[where][order]
            place, many = self._learn([data[a:b].decode() for a, b in zip(starts[spans].tolist(), ends[spans].tolist(), strict=True)])
            back_at, back_many = np.empty_like(place), np.empty_like(many)
            back_at[order], back_many[order] = place, many
            at[miss], length[miss] = back_at[back], back_many[back]
            if self.n + len(new) <= KNOWN:
                self._add(new, back_at, back_many)
        if whole.any():
            at_whole = np.flatnonzero(whole)
            ids, many = self._one_by_one([data[bounds[d] : bounds[d + 1]].decode() for d in at_whole])
            place = len(self.pool) + np.cumsum(many) - many  # behind the pool, for this chunk alone
            at, length = np.insert(at, offsets[at_whole], place), np.insert(length, offsets[at_whole], many)
            offsets = offsets + np.concatenate(([0], np.cumsum(whole)))
        from_ = gather(at, length)
        out = np.empty(len(from_), self.dtype)
        kept = from_ < len(self.pool)
        out[kept] = self.pool[from_[kept]]
        if whole.any():
            out[~kept] = ids[from_[~kept] - len(self.pool)]
        if self.n == n_known:
            self.filled = filled  # nothing learnt is kept
        return out, np.concatenate(([0], np.cumsum(length)))[offsets]
