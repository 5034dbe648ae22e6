"""Token ids of whole texts by the tokenizers library, one pre-token at a time.

The vocabulary `word_bpe_49k.json` cuts text at white space, and between Latin letters and ASCII
marks; what lies between cuts is encoded by itself. So a text's ids are those of its pieces in
order, and a process remembers the ids of pieces under a 64-bit hash. Words with anything else in
them (digits, apostrophes, other scripts, controls) go through the whole tokenizer as one piece.
"""

from __future__ import annotations

import os

import numpy as np

from backhaul.llm.words import LOWER, NOT_SPACE, hash_spans, spans

VOCABULARY = "word_bpe_49k.json"
END = 2
_BITS = 22  # of the table of remembered pieces
_KEPT = 5 << (_BITS - 3)

_LETTER, _MARK, _OTHER = 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[~NOT_SPACE] = 0
_CLASS[0x21:0x7F] = _MARK
_CLASS[0x30:0x3A] = _OTHER
_CLASS[0x27] = _OTHER  # an apostrophe may join what follows it
_CLASS[0x41:0x5B] = _LETTER
_CLASS[0x61:0x7B] = _LETTER
_CLASS[0x80:0xC0] = _LETTER  # second bytes
_CLASS[0xC3:0xC9] = _LETTER  # first bytes of U+00C0 to U+023F


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in shown}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """The bytes, with capitals of plain words made small; bounds and class of the pieces of each row,
    and the first piece of each row."""
    kind = _CLASS[data]
    sign = (data[1:] == 0x97) | (data[1:] == 0xB7)  # the multiplication and division signs
    kind[1:][sign & (data[:-1] == 0xC3)] = _OTHER
    kind[1:][(data[1:] == 0xB0) & (data[:-1] == 0xC4)] = _OTHER  # its small form is two characters
    kind[1:][(data[1:] == 0x7C) & (data[:-1] == 0x3C)] = _OTHER  # special tokens begin so
    starts, ends, _ = spans(data, offsets, NOT_SPACE)
    odd = np.concatenate([[0], np.cumsum(kind == _OTHER)])
    whole = np.flatnonzero(odd[ends] > odd[starts])
    size = (ends - starts)[whole]
    at = np.repeat(starts[whole] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    kind[at] = _OTHER
    data = np.where(kind == _OTHER, data, LOWER[data])
    change = np.empty(len(kind) + 1, bool)
    change[[0, -1]] = True
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    cuts = np.flatnonzero(change)
    begin, end = cuts[:-1], cuts[1:]
    keep = kind[begin] > 0 if len(begin) else np.zeros(0, bool)
    begin, end = begin[keep], end[keep]
    return data, begin, end, kind[begin], np.searchsorted(begin, offsets)


class Encoder:
    """Encodes texts with a tokenizers file and appends the end id to each."""

    def __init__(self, path: str, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.end = end
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << _BITS, np.uint64)
        self.codes = np.zeros(1 << _BITS, np.int32)
        self.ids = np.full(1 << 16, self.end, np.uint32)
        self.at = np.zeros(1 << 16, np.int64)  # piece k has the ids from at[k] to at[k + 1]
        self.at[1] = 1  # piece 0 is the end
        self.known = 1

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Codes of hashes, -1 if not known: open addressing, all hashes at once."""
        out = np.full(len(hashes), -1, np.int64)
        live, place = np.arange(len(hashes)), (hashes >> np.uint64(64 - _BITS)).astype(np.int64)
        while len(live):
            key = self.keys[place]
            hit = key == hashes[live]
            out[live[hit]] = self.codes[place[hit]]
            on = ~hit & (key != 0)
            live, place = live[on], (place[on] + 1) & ((1 << _BITS) - 1)
        return out

    def _keep(self, hashes: np.ndarray, found: list[list[int]]) -> None:
        """Remember the ids of new pieces."""
        size = np.array([len(x) for x in found])
        last, n = self.at[self.known], len(found)
        stop = last + np.cumsum(size)
        if stop[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(int(stop[-1]), len(self.ids)), np.uint32)])
        if self.known + n >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros(max(n, len(self.at)), np.int64)])
        self.ids[last : stop[-1]] = [i for x in found for i in x]
        self.at[self.known + 1 : self.known + n + 1] = stop
        code = np.arange(self.known, self.known + n)
        live, place = np.arange(n), (hashes >> np.uint64(64 - _BITS)).astype(np.int64)
        while len(live):
            free = self.keys[place] == 0
            self.keys[place[free]] = hashes[live[free]]
            mine = self.keys[place] == hashes[live]
            self.codes[place[mine]] = code[live[mine]]
            live, place = live[~mine], (place[~mine] + 1) & ((1 << _BITS) - 1)
        self.known += n

    def _ids(self, piece: bytes, kind: int) -> list[int]:
        if kind == _OTHER:
            return self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids
        if piece.isascii():
            return [t.id for t in self.model.tokenize(piece.decode())]
        letters = self.letters
        mapped = "".join([letters[b] for b in piece.decode().lower().encode()])
        return [t.id for t in self.model.tokenize(mapped)]

    def _codes(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: np.ndarray, hashes: np.ndarray) -> np.ndarray | None:
        """Codes of pieces, the new ones remembered; None if they do not fit into the table."""
        code = self._find(hashes)
        missing = np.flatnonzero(code < 0)
        if len(missing):
            new, pick = np.unique(hashes[missing], return_index=True)
            if self.known + len(new) > _KEPT and self.known > 1:
                self._clear()
                return self._codes(data, begin, end, kind, hashes)
            if len(new) > _KEPT:
                return None
            text, at = data.tobytes(), missing[pick]
            spots = zip(begin[at].tolist(), end[at].tolist(), kind[at].tolist())
            self._keep(new, [self._ids(text[a:b], k) for a, b, k in spots])
            code[missing] = self._find(hashes[missing])
        return code

    def _encode(self, *given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in a row and how many each has. More pieces than the table holds are encoded
        in runs, each with a table of its own."""
        data, *each = given
        code = self._codes(data, *each)
        if code is None:
            half = len(each[0]) // 2
            left = self._encode(data, *[x[:half] for x in each])
            right = self._encode(data, *[x[half:] for x in each])
            return np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]])
        size = self.at[code + 1] - self.at[code]
        before = np.cumsum(size) - size
        place = np.repeat(self.at[code] - before, size)
        place += np.arange(len(place))
        return self.ids[place], size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with its end id, and the bounds of the texts."""
        data, begin, end, kind, first = pieces(data, offsets)
        hashes = hash_spans(data, begin, end)
        hashes[hashes == 0] = 1
        ids, size = self._encode(data, begin, end, kind, hashes)
        last = np.concatenate([[0], np.cumsum(size)])[first]
        return np.insert(ids, last[1:], self.end), last + np.arange(len(last))


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end: int = END) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = Encoder(path, end)
    return _ENCODERS[path, end]
