"""Exact tokenizer results by pre-token, with numpy: texts are cut into pieces, pieces hashed, hashes looked up.

A tokenizer that drops white space encodes a text as the concatenation of its white-space-delimited words:
neither normalisation nor a special token crosses an ASCII white-space character. If it also parts letters,
digits and marks from each other, words are cut further at those borders, so that few different pieces are
left. A piece is known by a 64-bit hash of its bytes; different pieces share one with a chance of about
n²/2^65 among n, and each is encoded by the library once for as long as a worker remembers it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np

#: Bytes of text that are cut and hashed together; numpy's temporaries take some forty times as much.
SPAN = 1 << 20
#: Entries and ids at which a worker's memory starts anew.
ENTRIES, IDS = 600_000, 4_000_000
#: Pieces that one call of the library encodes, joined by spaces.
TOGETHER = 2048
SPACE, LETTER, DIGIT, MARK, WHOLE = 0, 1, 2, 3, 4
# Fixed value: the pattern of a pre-tokenizer that parts letters, digits and marks.
PARTING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CLASS = np.array([SPACE if b == 32 or 9 <= b <= 13 else DIGIT if 48 <= b <= 57 else LETTER if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else MARK for b in range(256)], np.uint8)
#: Bytes whose words stay whole: the apostrophe, control characters, and all beyond the two-byte letters U+00C0 to U+023F.
HARD = np.array([b == 39 or b < 9 or 13 < b < 32 or b == 127 or b == 0xC2 or b > 0xC8 for b in range(256)], bool)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
GAP = re.compile(rb"[\x20\x09-\x0D]")


class _Powers:
    """Powers of BASE and of its inverse modulo 2^64, as many as the longest buffer so far has bytes."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up, self.down = (np.multiply.accumulate(np.array([1] + [b] * (size - 1), np.uint64)) for b in (BASE, pow(BASE, -1, 1 << 64)))
        return self.up, self.down


_powers = _Powers()


def hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the pieces [start, end) of bytes a; never 0."""
    up, down = _powers.of(len(a) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * MIX
        h ^= h >> np.uint64(32)
        h *= MIX
        h ^= h >> np.uint64(29)
        h *= np.uint64(BASE)
    h[h == 0] = 1
    return h


def spans(texts: list[bytes], limit: int = SPAN) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
    """(numbers of texts, their bytes parted by spaces, where each begins) in runs of about `limit` bytes; longer texts are cut at white space."""
    numbers, parts, size = [], [], 0

    def flush():
        return np.array(numbers), b" ".join(parts) + b" ", np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])

    for k, text in enumerate(texts):
        at = 0
        while at < len(text) or at == 0:
            end = len(text)
            if end - at > limit:
                gap = GAP.search(text, at + limit)
                end = gap.start() if gap else end
            numbers.append(k)
            parts.append(text[at:end])
            size += end - at + 1
            at = end + (end == 0)
            if size >= limit:
                yield flush()
                numbers, parts, size = [], [], 0
    if parts:
        yield flush()


def cut(buffer: bytes, parting: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, kinds) of the pieces of a buffer; where letters, digits and marks aren't parted, all are whole words."""
    a = np.frombuffer(buffer, np.uint8)
    kind = CLASS[a]
    if not parting:
        kind = np.where(kind == SPACE, SPACE, WHOLE).astype(np.uint8)
    else:
        hard = HARD[a]
        # "<|", the two marks among the letters, and the letter whose lower case is two characters
        hard[:-1] |= (a[:-1] == 60) & (a[1:] == 124) | (a[:-1] == 0xC3) & ((a[1:] == 0x97) | (a[1:] == 0xB7)) | (a[:-1] == 0xC4) & (a[1:] == 0xB0)
        if hard.any():
            filled = kind != SPACE
            word = np.cumsum(filled & ~np.concatenate([[False], filled[:-1]]))
            whole = np.zeros(word[-1] + 1, bool)
            whole[word[hard & filled]] = True
            kind = np.where(whole[word] & filled, np.uint8(WHOLE), kind)
    border = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]) | (kind == DIGIT))
    kinds = kind[border]
    real = kinds != SPACE
    return a, border[real], np.append(border[1:], len(a))[real], kinds[real]


def words(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the white-space-delimited words of a buffer."""
    return cut(buffer, False)[:3]


class Places:
    """64-bit keys to places 0, 1, 2, .. in order of their coming: open addressing, many keys at a time."""

    def __init__(self, bits: int = 14):
        self.n = 0
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 for unknown ones."""
        slot = (keys >> self.shift).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == keys, self.at[slot], np.int32(-1))
        rest = np.flatnonzero((there != keys) & (there != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            there, wanted = self.keys[slot[rest]], keys[rest]
            hit = there == wanted
            out[rest[hit]] = self.at[slot[rest[hit]]]
            rest = rest[~hit & (there != 0)]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Give the next places to keys that are all new and different."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old, places = self.keys[self.keys > 0], self.at[self.keys > 0]
            self._make(max(14, (4 * (self.n + len(keys))).bit_length()))
            self._put(old, places)
        self._put(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def _put(self, keys: np.ndarray, places: np.ndarray) -> None:
        slot = (keys >> self.shift).astype(np.int64)
        rest = np.arange(len(keys))
        while len(rest):
            s = slot[rest]
            free = self.keys[s] == 0
            self.keys[s[free]] = keys[rest[free]]
            won = self.keys[s] == keys[rest]
            self.at[s[won]] = places[rest[won]]
            rest = rest[~won]
            slot[rest] = (slot[rest] + 1) & self.mask


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.n, self.held = 0, np.empty(1024, dtype)

    def extend(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.empty(max(len(x), self.n), self.held.dtype)])
        self.held[self.n : self.n + len(x)] = x
        self.n += len(x)

    def __getitem__(self, at):
        return self.held[: self.n][at]


def library_tokenizer(path: str):
    """The tokenizers library's tokenizer of a file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


class Encoder:
    """The library's ids of pieces, and what of its tokenizer the cutting rests on."""

    def __init__(self, path: str):
        self.tok = library_tokenizer(path)
        made = json.loads(self.tok.to_str())
        self.lowers = '"Lowercase"' in json.dumps(made.get("normalizer"))
        self.parting = json.dumps(PARTING) in json.dumps(made.get("pre_tokenizer"))
        suffix = made["model"].get("end_of_word_suffix")
        #: Ids that end a pre-token, where the vocabulary marks them.
        self.ending = np.zeros(self.tok.get_vocab_size(), bool)
        if suffix:
            self.ending[[i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True

    def lowered(self, buffer: bytes) -> bytes:
        return buffer.translate(LOWER) if self.lowers else buffer

    def encode(self, pieces: list[bytes], single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece). `single` pieces are one pre-token each: their ids end where a token ends a word."""
        out: list = [None] * len(pieces)
        for wanted in (np.flatnonzero(single), np.flatnonzero(~single)):
            one_each = len(wanted) and single[wanted[0]] and self.ending.any()
            for at in range(0, len(wanted), TOGETHER):
                part = wanted[at : at + TOGETHER]
                texts = [pieces[k].decode("utf-8", "replace") for k in part]
                enc = self.tok.encode(" ".join(texts), add_special_tokens=False)
                ids = np.array(enc.ids, np.uint32)
                ends = np.flatnonzero(self.ending[ids]) + 1 if one_each else np.empty(0, np.int64)
                if len(ends) == len(part) and ends[-1:] == [len(ids)]:
                    cuts = np.concatenate([[0], ends])
                else:
                    starts = np.cumsum([0, *(len(w) + 1 for w in texts)])
                    own = np.searchsorted(starts, np.array(enc.offsets, np.int64).reshape(-1, 2)[:, 0], "right") - 1
                    cuts = np.searchsorted(own, np.arange(len(part) + 1))
                for k, i, j in zip(part.tolist(), cuts.tolist(), cuts[1:].tolist(), strict=False):
                    out[k] = ids[i:j]
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        return (np.concatenate(out) if out else np.empty(0, np.uint32)), lengths


class Memory:
    """What a worker knows of pieces: their numbers of ids and, with `keep_ids`, the ids. `frequent`, a first tier, holds (hashes, numbers of ids)."""

    def __init__(self, path: str, keep_ids: bool, dtype=np.uint32, frequent: tuple[np.ndarray, np.ndarray] | None = None, entries: int = ENTRIES):
        self.encoder, self.keep_ids, self.dtype, self.entries = Encoder(path), keep_ids, dtype, entries
        self.first, self.first_lengths = Places(), np.empty(0, np.int64)
        if frequent is not None:
            self.first.add(frequent[0])
            self.first_lengths = frequent[1].astype(np.int64)
        self._clear()

    def _clear(self) -> None:
        self.places, self.lengths, self.starts, self.ids = Places(), Grown(np.int32), Grown(np.int64), Grown(self.dtype)

    def learn(self, buffer: bytes, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Places of the keys in the second tier, after encoding those that it lacked."""
        if self.places.n > self.entries or self.ids.n > IDS:
            self._clear()
        at = self.places.find(keys)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            new, first = np.unique(keys[unknown], return_index=True)
            first = unknown[first]
            pieces = [buffer[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            ids, lengths = self.encoder.encode(pieces, kinds[first] != WHOLE)
            if self.keep_ids:
                self.starts.extend(self.ids.n + np.cumsum(lengths) - lengths)
                self.ids.extend(ids.astype(self.dtype))
            self.lengths.extend(lengths)
            self.places.add(new)
            at[unknown] = self.places.find(keys[unknown])
        return at

    def pieces(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(owners, buffer, starts, ends, kinds, hashes) of the pieces of runs of texts."""
        for numbers, raw, begins in spans(texts):
            buffer = self.encoder.lowered(raw)
            a, starts, ends, kinds = cut(buffer, self.encoder.parting)
            owner = numbers[np.searchsorted(begins, starts, "right") - 1]
            yield owner, buffer, starts, ends, kinds, hashes(a, starts, ends)

    def count(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: its number of ids, of pieces, and of pieces that the first tier knows."""
        n, all_pieces, known = (np.zeros(len(texts), np.int64) for _ in range(3))
        for owner, buffer, starts, ends, kinds, keys in self.pieces(texts):
            at = self.first.find(keys)
            lengths = np.zeros(len(keys), np.int64)
            hit = at >= 0
            lengths[hit] = self.first_lengths[at[hit]]
            miss = np.flatnonzero(~hit)
            at = self.learn(buffer, starts[miss], ends[miss], kinds[miss], keys[miss])
            lengths[miss] = self.lengths[at]
            for total, x in ((n, lengths), (all_pieces, None), (known, hit)):
                total += np.bincount(owner, x, len(texts)).astype(np.int64)
        return n, all_pieces, known

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end id; each text's number of them)."""
        out, total = [], np.zeros(len(texts), np.int64)
        last = 0
        for owner, buffer, starts, ends, kinds, keys in self.pieces(texts):
            at = self.learn(buffer, starts, ends, kinds, keys)
            lengths = self.lengths[at].astype(np.int64)
            upto = np.cumsum(lengths)
            ids = self.ids[np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.starts[at] - upto + lengths, lengths)]
            total += np.bincount(owner, lengths, len(texts)).astype(np.int64)
            # An end follows each text that is over before this run's last one.
            new = int(owner[-1]) if len(owner) else last
            places = np.concatenate([[0], upto])[np.searchsorted(owner, np.arange(last + 1, new + 1))]
            out.append(np.insert(ids, places, end))
            last = new
        out.append(np.full(len(texts) - last if texts else 0, end, self.dtype))
        return np.concatenate(out).astype(self.dtype, copy=False), total + 1
