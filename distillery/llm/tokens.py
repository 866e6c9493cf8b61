"""Whole-text encoding by a public vocabulary file, with a bounded table of words.

Pre-tokens of these word vocabularies never span white space, so a text's ids
are the ids of its white-space-separated words in order. Each worker keeps the
ids of recent words: words of up to 16 bytes in a hash table of arrays whose
keys are those bytes, longer ones in a dictionary. A word is found by its bytes
alone; the tokenizers library encodes every word that is not there. Where the
vocabulary states the usual pre-tokens, marks after letters are words too.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np

from .words import GOLDEN, Words, mix

_ENCODERS: dict = {}

#: Words whose ids a worker keeps, bytes of words too long for the table, and ids; beyond one of them it starts afresh.
TABLE_WORDS, LONG_BYTES, KEPT_IDS = 1_000_000, 16_000_000, 16_000_000
#: Bytes of a word that is kept at all.
KEPT_WORD = 1024
#: Bytes of text that are encoded at a time.
GROUP_BYTES = 1_000_000
#: Words that the library gets at a time.
BATCH = 4096
#: Where characters from U+0300 on may combine, or a special token may stand, letters are not lowered beforehand.
_MAY_COMBINE = re.compile(b"[\\xcc-\\xff]")
_MARKS = frozenset(".,;:!?")
#: The pre-tokens and normalizers that make runs of letters words by themselves: what is known of them is used where a vocabulary states just these.
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    def __init__(self, path: str, table_words: int = TABLE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.n_ids = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = "<u2" if self.n_ids <= 1 << 16 else "<u4"
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        ends = [i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if suffix and t.endswith(suffix)]
        self.ends = np.zeros(self.n_ids, bool)
        self.ends[ends] = True
        self.marks, self.letters = self._usual(path) if ends else (None, None)
        self.table_words = table_words
        self.slots = self.first_slots = 1 << (2 * table_words).bit_length()
        self.clear()

    def _usual(self, path: str):
        """Marks that part words after a letter, and the tokenizer for runs of lower-case letters; neither if pre-tokens are others."""
        from tokenizers import Tokenizer, pre_tokenizers

        said = json.loads(self.tokenizer.to_str())
        pre, norm = said["pre_tokenizer"] or {}, said["normalizer"] or {}
        steps = pre.get("pretokenizers") or [{}]
        kinds = [n.get("type") for n in norm.get("normalizers", [])]
        if [x.get("type") for x in steps] != ["Split", "ByteLevel"] or steps[0]["pattern"] != {"Regex": _PRE_TOKENS} or steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or kinds != _NORMALIZERS:
            return None, None
        # A special token is never cut.
        special = {ord(c) for a in said["added_tokens"] for c in a["content"] if c.isascii()}
        marks = np.zeros(256, bool)
        marks[[k for k in range(0x21, 0x7F) if not chr(k).isalnum() and k not in special]] = True
        letters = Tokenizer.from_file(path)
        letters.normalizer = None
        letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return marks, letters

    def clear(self) -> None:
        self.low, self.high = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
        #: Bytes of the word in each slot; 0 where it is free.
        self.length = np.zeros(self.slots, np.uint8)
        self.at, self.size = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int32)
        self.ids = np.zeros(1 << 16, self.dtype)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.n_words = self.n_used = self.long_bytes = 0

    def _slot(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (mix(mix(high * GOLDEN + length.astype(np.uint64)) ^ low) & np.uint64(self.slots - 1)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The slot of each word of up to 16 bytes, or -1."""
        slot = self._slot(low, high, length)
        out = np.full(len(low), -1, np.int64)
        left = np.arange(len(low))
        while len(left):
            at = slot[left]
            hit = (self.low[at] == low[left]) & (self.high[at] == high[left]) & (self.length[at] == length[left])
            out[left[hit]] = at[hit]
            left = left[~hit & (self.length[at] != 0)]
            slot[left] = (slot[left] + 1) & (self.slots - 1)
        return out

    def _append(self, encoded: list[np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keeps ids of words of these sizes; where each word's begin, and how many they are."""
        start, total = self.n_used + np.cumsum(size) - size, int(size.sum())
        while self.n_used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        if total:
            self.ids[self.n_used : self.n_used + total] = np.concatenate(encoded)
        self.n_used += total
        return start, size

    def _put(self, low: np.ndarray, high: np.ndarray, length: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Distinct words that are not in the table yet."""
        self.n_words += len(low)
        while self.n_words > self.slots // 2:
            self._grow()
        slot = self._slot(low, high, length)
        left = np.arange(len(low))
        while len(left):
            free = left[self.length[slot[left]] == 0]
            # Of those that want one slot, the first gets it.
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            at = slot[won]
            self.low[at], self.high[at], self.length[at], self.at[at], self.size[at] = low[won], high[won], length[won], start[won], size[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & (self.slots - 1)

    def _grow(self) -> None:
        """A table of twice as many slots, for a text of more distinct words than it holds."""
        used = np.flatnonzero(self.length)
        held = [x[used] for x in (self.low, self.high, self.length, self.at, self.size)]
        self.slots *= 2
        self.low, self.high = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
        self.length, self.at, self.size = np.zeros(self.slots, np.uint8), np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int32)
        self.n_words -= len(used)
        self._put(*held)

    def _encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Words of letters alone are one pre-token each: a line of them is cut after each id that ends a word."""
        out: list = [None] * len(words)
        plain, marked, odd = [], [], []
        by_letters = bool(self.ends.any())
        for k, w in enumerate(words):
            if by_letters and w.isalpha():
                plain.append((k, w))
            elif by_letters and w[-1] in _MARKS and w[:-1].isalpha():
                marked.append(k)
                plain.append((k, w[:-1]))
            else:
                odd.append(k)
        for a in range(0, len(plain), BATCH):
            lines = [plain[b : b + 256] for b in range(a, min(a + BATCH, len(plain)), 256)]
            for line, encoded in zip(lines, self.tokenizer.encode_batch_fast([" ".join(w for _, w in x) for x in lines], add_special_tokens=False), strict=True):
                ids = np.array(encoded.ids, self.dtype)
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) != len(line) or cuts[-1] != len(ids):
                    odd += [k for k, _ in line]
                    continue
                start = 0
                for (k, _), cut in zip(line, cuts.tolist(), strict=True):
                    out[k] = ids[start:cut]
                    start = cut
        marks = {m: np.array(self.tokenizer.encode(m, add_special_tokens=False).ids, self.dtype) for m in _MARKS} if marked else {}
        for k in marked:
            if out[k] is not None:
                out[k] = np.concatenate([out[k], marks[words[k][-1]]])
        odd = sorted(odd)
        for a in range(0, len(odd), BATCH):
            part = odd[a : a + BATCH]
            for k, encoded in zip(part, self.tokenizer.encode_batch_fast([words[k] for k in part], add_special_tokens=False), strict=True):
                out[k] = np.array(encoded.ids, self.dtype)
        return out

    def _encode_new(self, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes these words and keeps their ids: where each word's begin, and how many they are."""
        start, size = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        low = words.low_letters[which] if self.letters else np.zeros(len(which), bool)
        plain = np.flatnonzero(low)
        for a in range(0, len(plain), BATCH):
            lines = [plain[b : b + 256] for b in range(a, min(a + BATCH, len(plain)), 256)]
            texts = [b" ".join([words.whole[s:e] for s, e in zip(words.starts[which[x]].tolist(), words.ends[which[x]].tolist(), strict=True)]).decode() for x in lines]
            for line, encoded in zip(lines, self.letters.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(encoded.ids, self.dtype)
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) != len(line) or cuts[-1] != len(ids):
                    low[line] = False
                    continue
                start[line], size[line] = self._append([ids], np.diff(cuts, prepend=0))
        other = np.flatnonzero(~low)
        if len(other):
            spans = zip(words.starts[which[other]].tolist(), words.ends[which[other]].tolist(), strict=True)
            encoded = self._encode_words([words.whole[s:e].decode() for s, e in spans])
            start[other], size[other] = self._append(encoded, np.array([len(e) for e in encoded], np.int64))
        return start, size

    def _short(self, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of these words of up to 16 bytes begin, and how many they are."""
        length = (words.ends[which] - words.starts[which]).astype(np.uint8)
        low, high = words.block(which, 0), np.zeros(len(which), np.uint64)
        two = np.flatnonzero(length > 8)
        high[two] = words.block(which[two], 1)
        slot = self._find(low, high, length)
        miss = np.flatnonzero(slot < 0)
        while len(miss):
            # One word of each home slot at a time; the others that lack are found or come in the next round.
            _, one = np.unique(self._slot(low[miss], high[miss], length[miss]), return_index=True)
            new = miss[one]
            self._put(low[new], high[new], length[new], *self._encode_new(words, which[new]))
            lacking = self._find(low[miss], high[miss], length[miss]) < 0
            miss = miss[lacking]
            if not len(miss):
                slot = self._find(low, high, length)
        return self.at[slot], self.size[slot]

    def _longer(self, words: Words, which: np.ndarray) -> tuple[list[int], list[int]]:
        each = [words.whole[s:e] for s, e in zip(words.starts[which].tolist(), words.ends[which].tolist(), strict=True)]
        new = list({w for w in each if w not in self.long})
        found = self.long
        if new:
            encoded = self._encode_words([w.decode() for w in new])
            start, size = self._append(encoded, np.array([len(e) for e in encoded], np.int64))
            places = dict(zip(new, zip(start.tolist(), size.tolist(), strict=True), strict=True))
            kept = {w: p for w, p in places.items() if len(w) <= KEPT_WORD}
            self.long.update(kept)
            self.long_bytes += sum(map(len, kept))
            found = self.long if len(kept) == len(places) else self.long | places
        return [found[w][0] for w in each], [found[w][1] for w in each]

    def _placed(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word's ids begin, how many they are, and each text's first word."""
        if self.n_words > self.table_words or self.n_used > KEPT_IDS or self.long_bytes > LONG_BYTES:
            self.slots = self.first_slots
            self.clear()
        words = Words([t if not t.isascii() and _MAY_COMBINE.search(t) or b"<|" in t else t.lower() for t in texts], self.marks)
        length = words.ends - words.starts
        start, size = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for pick, places in ((length <= 16, self._short), (length > 16, self._longer)):
            which = np.flatnonzero(pick)
            if len(which):
                start[which], size[which] = places(words, which)
        return start, size, words.first

    def joined(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 texts, one after another, and where each text's begin and the last one's end."""
        start, size, first = self._placed(texts)
        end = np.cumsum(size)
        ids = self.ids[np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)]
        return ids, np.concatenate([[0], end])[first]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each UTF-8 text."""
        ids, bounds = self.joined(texts)
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """How many ids each UTF-8 text has."""
        _, size, first = self._placed(texts)
        return np.diff(np.concatenate([[0], np.cumsum(size)])[first])

    def groups(self, ids: list, texts: list[bytes]):
        """(id, ids of the text) of each row, encoding a bounded amount of text at a time."""
        for some in spans(texts):
            yield from zip(ids[some], self.encode(texts[some]), strict=True)


def spans(texts: list[bytes]) -> Iterator[slice]:
    """Which texts to encode at a time."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= GROUP_BYTES or k == len(texts) - 1:
            yield slice(start, k + 1)
            start, size = k + 1, 0


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def forget() -> bool:
    """Drops the process's encoders, with their vocabularies and tables; whether there were any."""
    held = bool(_ENCODERS)
    _ENCODERS.clear()
    return held
