"""The words of many texts at once: where they are, what they are, and hashes of them."""

from __future__ import annotations

from functools import cached_property

import numpy as np

_U = np.uint64
GOLDEN, MIX_1, MIX_2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)

#: The space and the five control characters next to the tab.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII letters, and the bytes that follow LEAD in the letters from U+00C0 to U+00FF.
LETTER, LATIN, LEAD = np.zeros(256, bool), np.zeros(256, bool), 0xC3
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
LATIN[[k for k in range(0x80, 0xC0) if k not in (0x97, 0xB7)]] = True
#: The first n bytes of a block of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * MIX_1
    x = (x ^ (x >> _U(27))) * MIX_2
    return x ^ (x >> _U(31))


class Words:
    """Words are what white space parts: ``starts`` and ``ends`` in ``whole``, and in ``first`` each text's first word and one past the last's.

    ``marks`` says which bytes also begin a word where they follow a letter that is an ASCII one or in ``LATIN``.
    """

    def __init__(self, texts: list[bytes], marks: np.ndarray | None = None):
        self.whole = b"\n" + b"\n".join(texts) + b"\n" + bytes(8)
        data = np.frombuffer(self.whole, np.uint8)[: len(self.whole) - 8]
        gap = SPACE[data]
        if marks is None:
            edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
            self.starts, self.ends = edge[0::2], edge[1::2]
        else:
            letter = LETTER[data]
            at = np.flatnonzero(data[:-1] == LEAD)
            letter[at + 1] = LATIN[data[at + 1]]
            new = letter[:-1] & marks[data[1:]]
            self.starts = np.flatnonzero((gap[:-1] | new) & ~gap[1:]) + 1
            self.ends = np.flatnonzero((gap[1:] | new) & ~gap[:-1]) + 1
        self.first = np.searchsorted(self.starts, np.cumsum([1] + [len(t) + 1 for t in texts]))
        self.eights = np.ndarray((len(data) + 1,), "<u8", self.whole, strides=(1,))

    def block(self, which: np.ndarray | slice, k: int) -> np.ndarray:
        """Bytes 8k to 8k + 7 of these words as a number, zeros past a word's end; all of them begin before byte 8k + 1."""
        start = self.starts[which] + 8 * k
        return self.eights[start] & _FIRST[np.clip(self.ends[which] - start, 0, 8)]

    @cached_property
    def low_letters(self) -> np.ndarray:
        """Which words are letters a to z and U+00DF to U+00FF alone: lower-case ones that no normalising changes."""
        data = np.frombuffer(self.whole, np.uint8)[: len(self.whole) - 8]
        low = LETTER[data] & (data >= 0x61)
        at = np.flatnonzero(data[:-1] == LEAD)
        at = at[LATIN[data[at + 1]] & (data[at + 1] >= 0x9F)]
        low[at] = low[at + 1] = True
        other = np.concatenate([[0], np.cumsum(~low)])
        return other[self.starts] == other[self.ends]

    def hashes(self) -> np.ndarray:
        """A hash of each word's length and bytes, eight at a time, mixed after each step."""
        length = self.ends - self.starts
        h = mix(length.astype(_U) * GOLDEN)
        left, k = slice(None), 0
        while True:
            h[left] = mix((h[left] ^ self.block(left, k)) * GOLDEN + _U(k + 1))
            k += 1
            left = np.flatnonzero(length > 8 * k)
            if not len(left):
                return h
