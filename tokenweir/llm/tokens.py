"""Tokenizer ids of whole texts through the tokenizers library, one call for each distinct stretch of a text.

Neither vocabulary joins characters across white space, but for one leading space in the byte-level one. So a text is cut
at white space into stretches that encode alone as they do in place; distinct stretches go to the library in batches, and
texts are put together from their ids with array operations. Texts are cut and distinct stretches found in the UTF-8 bytes of a
run of texts at once, so that only a run's distinct stretches are looked up one by one. A task keeps a bounded table of stretches.
Most are words of Latin letters, which no rule before the merges changes but for lower-casing: they go to the library's model
without those rules.
"""

from __future__ import annotations

import os
import re
from itertools import accumulate, chain, islice, pairwise

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# The characters of Unicode's White_Space property, which the pre-tokenizers' \s means.
SPACE = "\t-\r \x85\xa0  -     　"
# Latin letters that stay one letter under NFC and lower-casing; a run of them, of digits or of ASCII marks is a stretch where an
# ASCII character or the end follows, as no rule of the pre-tokenizers can then reach across its end. The apostrophe is left out.
_ENDS = r"(?=[\x00-\x7f]|\Z)"
_LETTERS = r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ]"
_RUNS = (rf"{_LETTERS}++{_ENDS}", rf"[0-9]++{_ENDS}", r"[!-&(-/:-@\[-`{-~]++(?=[A-Za-z0-9\t-\r ]|\Z)")
#: Byte-level: a run with one space before it, or the rest up to white space; of white space, all but the last go first.
BYTE_LEVEL = "|".join([*(f" ?{x}" for x in _RUNS), rf" ?[^{SPACE}]+", rf"[{SPACE}]+(?![^{SPACE}])", f"[{SPACE}]"])
#: Word-level: white space has no ids.
WORD_LEVEL = "|".join([*_RUNS, rf"[^{SPACE}]+", rf"[{SPACE}]+"])
#: White space beyond ASCII, in UTF-8.
_WIDE = re.compile(b"|".join(x.encode() for x in re.findall(f"[{SPACE}]", "".join(map(chr, range(0x80, 0x3001)))))).search
# Kinds of bytes. Where all of a word is letters, digits and marks, its runs of one kind are the stretches, as _RUNS has them; any
# other byte in it (the apostrophe, control characters, characters beyond ASCII but for _LETTERS) leaves it whole. The last kind
# is for texts that are cut otherwise.
_BLANK, _LETTER, _DIGIT, _MARK, _OTHER, _APART = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:127] = _MARK
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[39] = _OTHER
_KIND[[*range(9, 14), 32]] = _BLANK
_KEPT = 600_000
_KEPT_CHARS = 16 << 20
#: Stretches that a worker keeps from one task to the next.
_BETWEEN = 100_000


def _alphabet() -> dict[int, str]:
    """The characters that byte-level vocabularies write bytes as: printable ones as they are in Latin-1, others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


_BYTES = _alphabet()


class Places(dict):
    """Numbers its keys in the order in which they are first met."""

    def __missing__(self, key: str | bytes) -> int:
        self[key] = at = len(self)
        return at


class Encoder:
    """Ids of texts. ``path``: a file of the tokenizers library; ``stretch``: where texts may be cut."""

    def __init__(self, path: str, stretch: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.find = re.compile(stretch).findall
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)).encode()).search if added else None
        # byte-level: a line feed is a piece by itself; word-level: so is a bar between spaces
        self.mark = next(m for m in ("\n", " | ") if len(self.tokenizer.encode(m, add_special_tokens=False).ids) == 1)
        self.mark_id = self.tokenizer.encode(self.mark, add_special_tokens=False).ids[0]
        self.spaced = self.mark == "\n"  # white space has ids, and a word may take the space before it
        # a word, with a space before it where one belongs to it, as the merges see it
        self.word = re.compile(f" ?{_LETTERS}+" if self.spaced else f"{_LETTERS}+").fullmatch
        upper, lower = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in "Aa")
        self.cased = upper != lower
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.clear()

    def clear(self) -> None:
        self.place = Places()
        self.chars = 0
        self.hits = np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _learn(self, known: int) -> None:
        """Ids of the stretches that have got a place since there were ``known``."""
        raw = list(islice(self.place, known, None))
        stretches = [s.decode() for s in raw]
        sizes, starts = np.zeros(len(stretches), np.int64), np.zeros(len(stretches), np.int64)
        # many stretches go to the library as one text, with a mark of one id between them; what holds the mark, or could join it, goes alone
        words = [k for k, s in enumerate(stretches) if self.word(s) and not (self.added and self.added(raw[k]))]
        self._words([stretches[k] for k in words], np.array(words, np.int64), sizes, starts)
        rest, mark = set(range(len(stretches))).difference(words), self.mark.strip(" ")
        plain = [k for k in sorted(rest) if mark not in stretches[k] and not stretches[k].isspace() and not (self.added and self.added(raw[k]))]
        alone = rest.difference(plain)
        for first in range(0, len(plain), 20_000):
            own = plain[first : first + 20_000]
            if not self._joined(self.tokenizer, [stretches[k] for k in own], self.mark, np.array(own, np.int64), sizes, starts):
                alone.update(own)
        alone = sorted(alone)
        for k, e in zip(alone, self.tokenizer.encode_batch_fast([stretches[k] for k in alone], add_special_tokens=False), strict=True):
            sizes[k], starts[k] = len(e.ids), self.used
            self._append(np.array(e.ids, np.uint32))
        self._reserve(0)
        self.size[known : known + len(sizes)], self.start[known : known + len(sizes)] = sizes, starts
        self.chars += sum(map(len, raw))

    def _joined(self, tokenizer, texts: list[str], mark: str, at: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> bool:
        """Encode texts with marks between them and note where their ids are; false if the marks cannot be told."""
        runs = [mark.join(texts[i : i + 50]) + mark for i in range(0, len(texts), 50)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in tokenizer.encode_batch_fast(runs, add_special_tokens=False)), np.uint32)
        ends = np.flatnonzero(ids == self.mark_id)
        if len(ends) != len(texts):
            return False
        begin = np.concatenate([[0], ends[:-1] + 1])
        sizes[at], starts[at] = ends - begin, self.used + begin
        self._append(ids)
        return True

    def _words(self, words: list[str], at: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> None:
        keys = Places()
        own = np.array([keys[w if self.cased else w.lower()] for w in words], np.int64)
        seen = [w if w.isascii() and w[0] != " " else w.encode().decode("latin-1").translate(_BYTES) for w in keys]
        # the mark, too, is written as the merges see it
        mark = f" {self.mark.strip(' ').translate(_BYTES)} "
        size, start = np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64)
        for first in range(0, len(seen), 20_000):
            part = seen[first : first + 20_000]
            if not self._joined(self.model, part, mark, np.arange(first, first + len(part)), size, start):
                raise ValueError("a word's ids hold the mark's")
        sizes[at], starts[at] = size[own], start[own]

    def _append(self, ids: np.ndarray) -> None:
        self._reserve(len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _forget(self) -> None:
        """Keep the half that was met most often, if short."""
        hits = self.hits[: len(self.place)]
        self._keep(hits > np.median(hits))

    def shrink(self) -> None:
        """Keep no more than what was met most often, for the next task of this worker."""
        if len(self.place) > _BETWEEN:
            hits = self.hits[: len(self.place)]
            self._keep(hits > np.partition(hits, -_BETWEEN - 1)[-_BETWEEN - 1])

    def _keep(self, kept: np.ndarray) -> None:
        stretches, at = [], []
        for k, x in enumerate(self.place):
            if kept[k] and len(x) < 40:
                stretches.append(x)
                at.append(k)
        at = np.array(at, np.int64)
        size, start = self.size[at], self.start[at]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(start - (ends - size), size) + np.arange(size.sum())]
        # as one string while all others go, so that those left do not lie scattered over the memory that these had
        raw, lengths = b"".join(stretches), [0, *accumulate(map(len, stretches))]
        del stretches, x
        self.clear()
        self.place = Places(zip(map(raw.__getitem__, map(slice, lengths, lengths[1:])), range(len(lengths) - 1)))
        self._append(ids)
        self.size[: len(size)], self.start[: len(size)] = size, ends - size
        self.chars = len(raw)

    def _reserve(self, ids: int) -> None:
        while self.used + ids > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.place) > len(self.start):
            self.start, self.size, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.hits))

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all stretches in a row, where each begins there (and the end), and the number of stretches before each text (and in all)."""
        kind, begins = _KIND[data], np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        # letters of two bytes, but where they follow a digit or a mark
        pair = np.flatnonzero(data - np.uint8(0xC3) <= 0xC9 - 0xC3)
        code, before = data[pair].astype(np.uint16) << 8 | data[pair + 1], _KIND[data[pair - 1]]
        pair = pair[(code <= 0xC98F) & (code != 0xC397) & (code != 0xC3B7) & (code != 0xC4B0) & (begins[pair] | (before != _DIGIT) & (before != _MARK))]
        kind[pair] = kind[pair + 1] = _LETTER
        plain = bool((kind != _OTHER).all())
        if not plain:
            blank = kind == _BLANK
            words = np.flatnonzero(~blank & (begins[:-1] | np.append(True, blank[:-1])))
            whole = np.repeat(np.maximum.reduceat(kind, words) == _OTHER, np.diff(words, append=len(data)))
            kind[words[0] :][whole & ~blank[words[0] :]] = _OTHER
        raw = memoryview(data)
        for at, end in pairwise(offsets.tolist()):
            # an added token ends the text before it, white space too; such a text is one stretch
            if self.added and self.added(raw, at, end):
                kind[at:end] = _APART
            elif not plain and _WIDE(raw, at, end):
                kind[at:end] = _APART
                begins[at + np.cumsum([len(s.encode()) for s in self.find(bytes(raw[at:end]).decode())])] = True
        first = begins[:-1].copy()
        first[1:] |= kind[1:] != kind[:-1]
        if self.spaced:
            blank = kind == _BLANK
            last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~begins[1:-1])
            first[last] = True
            first[last[data[last] == 32] + 1] = False
        else:
            kept = kind != _BLANK
            data, begins[:-1] = data[kept], first & kept
            first = first[kept]
        bounds = np.flatnonzero(np.append(first, True))
        if self.spaced:
            return data, bounds, np.searchsorted(bounds, offsets)
        return data, bounds, np.searchsorted(np.flatnonzero(begins[:-1]), offsets)

    def encode_utf8(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of each text's. ``data``: their UTF-8 bytes; ``offsets``: where each begins, and the end."""
        if len(self.place) > _KEPT or self.chars > _KEPT_CHARS:
            self._forget()
        data, bounds, cuts = self._cut(data, offsets)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        del data, bounds
        distinct, known = coded.dictionary, len(self.place)
        if not len(distinct):
            return np.zeros(0, np.uint32), np.diff(cuts)
        raw, ends = distinct.buffers()[2].to_pybytes(), np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1].tolist()
        at = np.fromiter(map(self.place.__getitem__, map(raw.__getitem__, map(slice, ends, ends[1:]))), np.int64, len(distinct))
        if len(self.place) > known:
            self._learn(known)
        at = at[coded.indices.to_numpy()]
        del coded, distinct, raw, ends
        self.hits[: len(self.place)] += np.bincount(at, minlength=len(self.place))
        size = self.size[at]
        ends = np.append(0, np.cumsum(size))
        place = np.repeat(self.start[at] - ends[:-1], size)
        place += np.arange(len(place))
        return self.flat[place], np.diff(ends[cuts])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode() for t in texts]
        return self.encode_utf8(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, stretch: str) -> Encoder:
    """One for each worker process, kept between tasks."""
    if (path, stretch) not in _ENCODERS:
        _ENCODERS[path, stretch] = Encoder(path, stretch)
    return _ENCODERS[path, stretch]


def vocabulary_file(name: str) -> str:
    """The place of a public vocabulary file; on a cluster every host has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)
