"""Exact ids of a lower-casing word tokenizer for many texts at once.

The tokenizer file cuts a text into words and encodes each word by itself, so equal words have equal ids. Words are
found on bytes, each distinct word is encoded once by the tokenizer itself and kept under its bytes (a bounded number, see
KEPT), and ids of whole texts are gathered from there. Hashes only group a batch's words; the bytes of each word are then
compared with its group's, and a batch where they differ is grouped by the bytes. Texts with characters from U+0100 up, or with the start of a special
token, go through the tokenizer whole. The result is the tokenizer's own in every case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from fjordframe.llm.textbytes import LONG, Words, flat, lanes

#: Words that a process keeps with their ids before it starts anew.
KEPT = 300_000

_BLANK, _OTHER, _LETTER, _NUMBER = 0, 1, 2, 3
# The characters below U+0100 that are blanks, letters or numbers, as the pattern of the file has them.
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _BLANK
_KIND[0x30:0x3A] = _NUMBER
_KIND[0x61:0x7B] = _LETTER
_AFTER_C2 = np.full(256, _OTHER, np.uint8)
_AFTER_C2[[0x85, 0xA0]] = _BLANK
_AFTER_C2[[0xAA, 0xB5, 0xBA]] = _LETTER
_AFTER_C2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _NUMBER
_AFTER_C3 = np.full(256, _LETTER, np.uint8)
_AFTER_C3[[0x97, 0xB7]] = _OTHER
# Endings that the pattern keeps with their apostrophe.
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def _lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of characters below U+0100."""
    data = data.copy()
    data[(data >= 0x41) & (data <= 0x5A)] += 32
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    data[lead[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)] + 1] += 32
    return data


def cut_words(data: np.ndarray, bounds: np.ndarray) -> Words:
    """The words of texts that hold characters below U+0100 only."""
    data = _lowered(data)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(bounds), np.int64))
    kind = _KIND[data]
    for lead, table in ((0xC2, _AFTER_C2), (0xC3, _AFTER_C3)):
        at = np.flatnonzero(data == lead)
        kind[at] = kind[at + 1] = table[data[at + 1]]
    second = (data & 0xC0) == 0x80
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= (kind == _NUMBER) & ~second
    start[bounds[:-1][bounds[:-1] < n]] = True
    quotes = np.flatnonzero((data == 0x27) & start)
    if len(quotes):
        stop = bounds[np.searchsorted(bounds, quotes, "right")]
        taken = np.zeros(len(quotes), bool)
        for ending in _ENDINGS:
            to = quotes + 1 + len(ending)
            fits = ~taken & (to <= stop)
            for k, c in enumerate(ending):
                fits[fits] = data[quotes[fits] + 1 + k] == c
            taken |= fits
            start[quotes[fits] + 1] = False
            after = to[fits]
            start[after[after < n]] = True
    at = np.flatnonzero(start)
    ends = np.append(at[1:], n)
    word = kind[at] != _BLANK
    at, ends = at[word], ends[word]
    return Words(data, at, ends, np.searchsorted(at, bounds))


def distinct_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different word, and for every word which of those it is; by hash first, then by the bytes."""
    _, one, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
    own, sizes = one[back], words.ends - words.starts
    same = sizes == sizes[own]
    short = np.where(same & (sizes <= LONG), sizes, 0)
    for (at, x), (_, y) in zip(lanes(words.data, words.starts, short), lanes(words.data, words.starts[own], short), strict=True):
        same[at] &= x == y
    if same.all() and not (sizes > LONG).any():
        return one, back
    groups: dict[bytes, int] = {}
    raw = words.data.tobytes()
    back = np.array([groups.setdefault(raw[a:b], len(groups)) for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)], np.int64)
    one = np.zeros(len(groups), np.int64)
    one[back[::-1]] = np.arange(len(back))[::-1]
    return one, back


class WordEncoder:
    """encode() gives the ids of all texts in a row and the offsets of each text's."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        ids = self._whole(" ".join(texts))
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            parts = [self._whole(w) for w in texts]
            ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        sizes = np.diff(ends, prepend=0)
        base = len(self.starts)
        self.place.update(zip(words, range(base, base + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, ends - sizes + len(self.ids)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])

    def _places(self, words: Words) -> np.ndarray:
        """Where each word's ids are kept, encoding those not met before."""
        one, back = distinct_words(words)
        if len(self.place) + len(one) > KEPT:
            self._clear()
        raw = words.data.tobytes()
        keys = [raw[a:b] for a, b in zip(words.starts[one].tolist(), words.ends[one].tolist(), strict=True)]
        known = [self.place.get(k, -1) for k in keys]
        fresh = [k for k, p in zip(keys, known, strict=True) if p < 0]
        if fresh:
            self._learn(fresh)
            known = [self.place[k] for k in keys]
        return np.array(known, np.int64)[back]

    def sizes_of(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        return np.diff(self.encode(texts, want_ids=False)[1])

    def encode(self, texts: pa.Array, want_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        data, bounds = flat(texts)
        n = len(bounds) - 1
        odd = np.zeros(n, bool)
        marks = [np.flatnonzero(data >= 0xC4), np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))]
        for at in marks:
            odd[np.searchsorted(bounds, at, "right") - 1] = True
        if odd.any():
            plain = texts.fill_null("") if texts.null_count else texts
            whole = {int(r): self._whole(plain[int(r)].as_py()) for r in np.flatnonzero(odd)}
            keep = np.repeat(~odd, np.diff(bounds))
            data, bounds = data[keep], np.concatenate([[0], np.cumsum(np.where(odd, 0, np.diff(bounds)))])
        words = cut_words(data, bounds)
        place = self._places(words) if len(words.starts) else np.zeros(0, np.int64)
        sizes = self.sizes[place]
        total = np.concatenate([[0], np.cumsum(sizes)])
        offsets = total[words.first]
        ids = np.zeros(0, np.int32)
        if want_ids:
            ids = self.ids[np.repeat(self.starts[place] - total[:-1], sizes) + np.arange(total[-1])]
        if odd.any():
            own = np.diff(offsets)
            parts = [whole[r] if odd[r] else ids[offsets[r] : offsets[r + 1]] for r in range(n)] if want_ids else []
            for r, x in whole.items():
                own[r] = len(x)
            offsets = np.concatenate([[0], np.cumsum(own)])
            ids = np.concatenate(parts) if parts else ids
        return ids, offsets


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This process's encoder of a tokenizer file; kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_path() -> str:
    """The installed file of the lower-casing word tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
