"""Token ids of whole Arrow text columns by a public tokenizer file, each distinct unit of text encoded once.

A unit is a stretch of text that the tokenizer never looks across: its own encoding does not depend on what is around it.
Ids of a text are the ids of its units one after the other, the same as of the whole text.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .kernel import Words, span_hashes

#: Distinct units kept per worker; beyond that the store starts anew.
KEPT_UNITS = 1_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13, 28, 29, 30, 31]] = True
#: First bytes of the blanks outside ASCII: a unit never ends before one.
_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: ASCII letters, digits and signs; 0: blanks, control characters and bytes of other characters, beside which nothing is cut.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_coders: dict[tuple[str, bool], Coder] = {}


def coder(path: str, special_text: bool = False) -> Coder:
    """One coder per file and worker process, so that tasks share its store."""
    if (path, special_text) not in _coders:
        _coders[path, special_text] = Coder(path, special_text)
    return _coders[path, special_text]


class Coder:
    """Encodes with a tokenizer file. special_text: strings of special tokens in a text are ordinary text, not these tokens."""

    def __init__(self, path: str, special_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # units are ordinary text; texts with special tokens are encoded whole
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # a second one that knows its special tokens: one of them keeps units apart that are encoded together
        self.joiner = Tokenizer.from_file(path)
        self.mark = spec["added_tokens"][-1]["content"]
        self.mark_id = spec["added_tokens"][-1]["id"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.whole = [] if special_text else [t.encode() for t in self.special]
        # blanks are dropped by a vocabulary with word ends, and belong to the word after them in a byte vocabulary
        self.drops_blanks = bool(spec["model"].get("end_of_word_suffix"))
        # the byte vocabulary's own pattern never puts letters, digits and signs into one piece, but for an apostrophe and letters
        self.parts_kinds = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.width = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._reset()

    def _reset(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.used = np.zeros(1 << 14, self.width), 0

    def _encode_units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units and how many each has; units go through the tokenizer together, a special token between them."""
        joined = self.mark.join(texts)
        if sum(joined.count(t) for t in self.special) == len(texts) - 1:
            flat = np.array(self.joiner.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
            marks = np.flatnonzero(flat == self.mark_id)
            if len(marks) == len(texts) - 1:
                edges = np.concatenate([[-1], marks, [len(flat)]])
                return np.delete(flat, marks).astype(self.width), np.diff(edges) - 1
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter((i for ids in encoded for i in ids), self.width, int(sizes.sum())), sizes

    def _learn(self, n: int, texts: list[str]) -> None:
        """Stores the ids of texts as units n, n + 1 and so on."""
        if n + len(texts) > len(self.start):
            size = max(2 * len(self.start), n + len(texts))
            self.start, self.length = np.resize(self.start, size), np.resize(self.length, size)
        flat, sizes = self._encode_units(texts)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, max(2 * len(self.ids), self.used + len(flat)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[n : n + len(texts)] = self.used + np.cumsum(sizes) - sizes
        self.length[n : n + len(texts)] = sizes
        self.used += len(flat)

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.drops_blanks:
            words = Words(data, offsets)
            return words.start, words.end
        # a unit begins at a text's start and at a blank before a character that is none
        cut = np.zeros(len(data), bool)
        cut[:-1] = (data[:-1] == 32) & ~_SPACE[data[1:]]
        if self.parts_kinds and len(data):
            # fewer distinct units: a word is the same with and without a full stop, and a single line feed is one of its own
            kind = _KIND[data]
            known, line = kind > 0, data == 10
            both = known[:-1] & known[1:]
            cut[1:] |= both & (kind[:-1] != kind[1:]) & ((data[:-1] != 39) | (kind[1:] != 1))
            cut[1:] |= known[:-1] & line[1:]
            cut[2:] |= known[:-2] & line[1:-1] & known[2:]
        ends = offsets[1:]
        cut[ends[(ends > 0) & (ends < len(data))] - 1] = False
        full = offsets[:-1] < offsets[1:]
        cut[offsets[:-1][full]] = True
        start = np.flatnonzero(cut)
        return start, np.append(start[1:], len(data))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and n + 1 places where each text's begin."""
        raw = data.tobytes()
        found = [t for t in self.whole if t in raw]
        if not found:
            return self._encode_plain(data, offsets)
        texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        has = np.array([any(t in x for t in found) for x in texts])
        sizes = np.diff(offsets)
        ids, begin = self._encode_plain(data[np.repeat(~has, sizes)], np.concatenate([[0], np.cumsum(sizes[~has])]))
        plain = iter(np.split(ids, begin[1:-1]) if len(begin) > 2 else [ids])
        parts = [np.array(self.joiner.encode(x.decode(), add_special_tokens=False).ids, self.width) if h else next(plain) for x, h in zip(texts, has, strict=True)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _encode_plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end = self._units(data, offsets)
        hashes, first, back = np.unique(span_hashes(data, start, end, False), return_index=True, return_inverse=True)
        if len(self.keys) + len(hashes) > KEPT_UNITS:
            self._reset()
        place = np.searchsorted(self.keys, hashes)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == hashes[known]
        new, n = np.flatnonzero(~known), len(self.keys)
        raw = data.tobytes()
        for lo in range(0, len(new), 2_000):
            part = first[new[lo : lo + 2_000]]
            self._learn(n + lo, [raw[a:b].decode() for a, b in zip(start[part].tolist(), end[part].tolist(), strict=True)])
        self.slot = np.insert(self.slot, place[new], n + np.arange(len(new)))
        self.keys = np.insert(self.keys, place[new], hashes[new])
        which = self.slot[np.searchsorted(self.keys, hashes)][back]
        size = self.length[which]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.start[which] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(start, offsets)]
