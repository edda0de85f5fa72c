"""Encoding of whole texts by way of their distinct chunks.

A chunk is a run of white space with the run of other characters after it. Both
vocabularies split a text between a character that is not white space and a blank or
newline that follows it, and no rule of theirs looks over that border to the left,
so the ids of a text are the ids of its chunks, one after the other. The marks that
end a run after a Latin letter are a piece of their own in either vocabulary and so a
chunk too.

Borders are found on the bytes of a batch, Arrow numbers its distinct chunks, a
library encodes those a worker hasn't met, and numpy gathers the ids of all.
"""
from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import compress, count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks of a worker's dictionary, and bytes of its chunks; when it grows beyond, those stay that were met again.
CACHE_ENTRIES, CACHE_BYTES = 400_000, 32_000_000
#: Bytes of text that are cut and gathered at once, unless one text has more.
BATCH_BYTES = 8_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[10, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?\"#$%&()*+-/=@[\\]^_`{}~")] = True  # without those of contractions and special tokens
#: Most marks that are cut off the end of a chunk; more stay with it.
MARKS = 16
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
# first two bytes of characters among which are white-space ones: no border is set after any of these
_WIDE = np.zeros(65536, bool)
_WIDE[[0xE19A, 0xE280, 0xE281, 0xE380]] = True


def borders(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte offsets of the chunks of some texts, given by their UTF-8 bytes and their own offsets; the last is the end."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data):
        found = np.flatnonzero(_BLANK[data[1:]] & ~_SPACE[data[:-1]]) + 1
        wide = np.flatnonzero(data[found - 1] >= 0x80)
        if len(wide):
            p = found[wide]
            two, three = data[np.maximum(p - 2, 0)], data[np.maximum(p - 3, 0)]
            found = np.delete(found, wide[(two == 0xC2) | _WIDE[three.astype(np.int64) << 8 | two]])
        cut[found] = True
    cut[at] = True
    last = np.flatnonzero(cut)[1:] - 1  # last bytes of chunks, moved to the first of the marks that end them
    last = last[_MARK[data[last]]]
    last = last[~cut[last]]
    for _ in range(MARKS):
        more = np.flatnonzero(_MARK[data[last - 1]])
        if not len(more):
            break
        last[more] -= 1
        last = np.delete(last, more[cut[last[more]]])
    one, two = data[last - 1], data[np.maximum(last - 2, 0)]
    # U+00C0 to U+017F but for the signs of multiplication and division and the dotted capital I
    latin = ((two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7)) | ((two == 0xC4) & (one >= 0x80) & (one != 0xB0)) | ((two == 0xC5) & (one >= 0x80))
    cut[last[_ASCII_LETTER[one] | latin]] = True
    return np.flatnonzero(cut)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of [start, start + size) of each pair, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class IdStore:
    """Ids of distinct keys in one array; `encode` gives those of keys that it doesn't have, four bytes to an id."""

    def __init__(self, encode: Callable[[list], Iterable[bytes]]):
        self.encode = encode
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str | bytes, int] = {}
        self.bytes = 0
        # number 0 stands for the end of a text
        self.flat, self.start, self.size = np.zeros(1, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.again = np.zeros(1, bool)  # met again since the last sweep

    def _sweep(self) -> None:
        """Keeps the keys that were met again, under new numbers in the old order; none if they are more than half of what may be kept."""
        kept = list(compress(self.known, self.again[1:].tolist()))  # the keys stand in the order of their numbers
        size = sum(map(len, kept))
        if 2 * len(kept) > CACHE_ENTRIES or 2 * size > CACHE_BYTES:
            return self._forget()
        old = np.flatnonzero(self.again)
        ids, at = self.gather(old)
        self.known, self.bytes = dict(zip(kept, count(1))), size
        self.flat = np.concatenate([self.flat[:1], ids])
        self.start = np.concatenate([self.start[:1], 1 + at[:-1]])
        self.size = np.concatenate([self.size[:1], self.size[old]])
        self.again = np.zeros(len(self.start), bool)

    def numbers(self, keys: list) -> np.ndarray:
        """The number of each of some distinct keys."""
        if len(self.known) + len(keys) > CACHE_ENTRIES or self.bytes > CACHE_BYTES:
            self._sweep()
        got = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(got < 0)
        self.again[got[got > 0]] = True
        if len(new):
            names = [keys[i] for i in new.tolist()]
            ids = list(self.encode(names))
            first = len(self.start)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.again = np.concatenate([self.again, np.zeros(len(sizes), bool)])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])
            self.known.update(zip(names, range(first, first + len(names))))
            self.bytes += sum(map(len, names))
            got[new] = np.arange(first, first + len(names))
        return got

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of keys by their numbers, one after the other, and where those of each begin (one more: the end)."""
        sizes = self.size[codes]
        return self.flat[ranges(self.start[codes], sizes)], np.concatenate([[0], np.cumsum(sizes)])


class ChunkEncoder:
    """Whole texts to ids. `encode` turns a list of distinct chunks into as many bytes objects, four bytes to an id."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], drops_space: bool = False):
        self.store, self.drops_space = IdStore(encode), drops_space

    def _numbers(self, distinct: pa.Array) -> np.ndarray:
        """The number of each of some distinct chunks. Where white space is dropped, chunks go by their bare words, ASCII in lower case."""
        if not self.drops_space:
            return self.store.numbers(distinct.to_pylist())
        bare = pc.utf8_trim(distinct, " \n")
        words = pc.if_else(pc.string_is_ascii(bare), pc.ascii_lower(bare), bare).dictionary_encode()
        return self.store.numbers(words.dictionary.to_pylist())[words.indices.to_numpy()]

    def __call__(self, texts: pa.Array, end: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For some texts after some: their number, their ids one after the other, and where each begins (one more: the end).

        Null counts as empty. `end` is an id to put after each text.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        n = len(texts)
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        k = 0
        while k < n:
            stop = max(k + 1, int(np.searchsorted(at, at[k] + BATCH_BYTES, "right")) - 1)
            yield stop - k, *self._some(np.ascontiguousarray(data[at[k] : at[stop]]), at[k : stop + 1] - at[k], end)
            k = stop

    def _some(self, data: np.ndarray, at: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        cuts = borders(data, at)
        dealt = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        codes = self._numbers(dealt.dictionary)[dealt.indices.to_numpy()] if len(dealt) else np.zeros(0, np.int64)
        of_text = np.searchsorted(cuts, at)
        if end is not None:
            self.store.flat[0], self.store.size[0] = end, 1
            codes = np.insert(codes, of_text[1:], 0)
            of_text = of_text + np.arange(len(of_text))
        ids, starts = self.store.gather(codes)
        return ids, starts[of_text]

    def lists(self, texts: pa.Array, end: int | None = None) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for _, ids, at in self(texts, end):
            raw, at = ids.astype("<u4", copy=False).tobytes(), (at * 4).tolist()
            out += [raw[a:e] for a, e in zip(at, at[1:])]
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def library_encoder(file: str) -> ChunkEncoder:
    """The encoder of a worker for a file of the tokenizers library; it lives as long as the worker.

    Special tokens' strings in a text are read as the library reads them by default.
    """
    if file not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(file)
        drops_space = "Replace" in repr(t.normalizer)
        # a vocabulary that drops white space marks the last token of a word, the other the blank before its first
        border = np.zeros(t.get_vocab_size(), bool)
        border[[i for w, i in t.get_vocab().items() if (w.endswith("</w>") if drops_space else w.startswith("Ġ"))]] = True

        def one_by_one(chunks: list[str]) -> list[bytes]:
            return [array("I", e.ids).tobytes() for e in t.encode_batch_fast(chunks, add_special_tokens=False)]

        def latin(word: str) -> bool:
            return word.isascii() or (max(word) < "ɐ" and "İ" not in word)

        def encode(chunks: list[str]) -> Iterable[bytes]:
            return map(distinct(chunks).__getitem__, chunks)

        def distinct(chunks: list[str]) -> dict[str, bytes]:
            # a chunk of Latin letters is one word to the library, so many go into a call and are told apart by the tokens that end or begin a word
            if drops_space:
                plain = [c for c in chunks if c.isalpha() and latin(c)]
            else:
                plain = [c for c in chunks if c[0] == " " and c[1:].isalpha() and latin(c)]
            rest = list(set(chunks).difference(plain))
            found = dict(zip(rest, one_by_one(rest)))
            runs = [plain[k : k + 256] for k in range(0, len(plain), 256)]
            joint = t.encode_batch_fast([(" " if drops_space else "").join(r) for r in runs], add_special_tokens=False)
            for run, e in zip(runs, joint):
                raw = array("I", e.ids).tobytes()
                at = np.flatnonzero(border[np.frombuffer(raw, np.uint32)])
                cuts = [0, *((at + 1) * 4).tolist()] if drops_space else [*(at * 4).tolist(), len(raw)]
                if len(cuts) != len(run) + 1 or cuts[0] or cuts[-1] != len(raw):
                    found.update(zip(run, one_by_one(run)))
                else:
                    found.update(zip(run, [raw[i:j] for i, j in zip(cuts, cuts[1:])]))
            return found

        _ENCODERS[file] = ChunkEncoder(encode, drops_space)
    return _ENCODERS[file]
