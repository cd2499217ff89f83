"""Token ids of whole texts, made per process from a tokenizer file.

Texts are cut where no token crosses.  Each distinct word is encoded once by the
library and kept; words are found, looked up and put together by NumPy for many texts
at once, which is several times faster than encoding each text, with the library's
own ids.
"""

from __future__ import annotations

import os
from array import array

import numpy as np

from .worker import held

#: Words, ids and bytes of long units that a process keeps at most, besides those of one
#: group of texts, and bytes of a group.
MAX_WORDS, MAX_IDS, MAX_NAMED, GROUP_BYTES = 800_000, 8 << 20, 32 << 20, 1 << 20
#: Unknown words strung together for one call of the library; longer texts cost more a word.
_STRUNG = 200


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


_WHITE, _LETTER, _SIGN, _LEAD, _OTHER = range(5)
#: Kinds of bytes: ASCII white space, A-Z and a-z, signs (no quote, and no < as it may begin
#: a special string), first bytes of Latin letters beyond ASCII.
_KINDS = bytearray([_OTHER] * 256)
for _bytes, _kind in ((b" \t\n\r\x0b\x0c", _WHITE), (bytes([*range(65, 91), *range(97, 123)]), _LETTER), (b'!"#$%&()*+,-./:;=>?@[\\]^_`{|}~', _SIGN), (bytes(range(0xC3, 0xCA)), _LEAD)):
    for _byte in _bytes:
        _KINDS[_byte] = _kind
#: Letters U+00C0 to U+024F, U+0130 aside, whose lower case is no letter alone.
_LATIN = np.zeros(1 << 16, bool)
_LATIN[[int.from_bytes(chr(c).encode(), "big") for c in range(0xC0, 0x250) if c not in (0xD7, 0xF7, 0x130)]] = True

#: Words of up to 16 bytes are told apart by these bytes themselves, as two numbers.
_KEY, _SEAT_BITS = 16, 21
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """``a``, longer if it has not ``n`` rows."""
    return a if len(a) >= n else np.concatenate([a, np.empty((max(n, 2 * len(a)) - len(a), *a.shape[1:]), a.dtype)])


class WordIds:
    """For BPE on words, white space dropped, A-Z lower-cased: ASCII white space is never
    part of a token nor of any normal form, so texts are cut there into units.

    In a unit of Latin letters and signs, each run of letters and each of signs is a
    word for the library.  Unknown ones are strung together and encoded at once; the
    ids themselves show where each ends.  Other units are encoded singly."""

    def __init__(self, file: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.bits = _SEAT_BITS
        self.seats = np.full(1 << self.bits, -1, np.int32)  # open addressing: seat -> entry
        self.low, self.high = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)  # an entry's key; 0: none
        self.first, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)  # an entry's ids in the pool
        self.pool, self.entries, self.used = np.zeros(1 << 16, "<u4"), 0, 0
        self.others: dict[bytes, int] = {}  # longer words and other units
        self.named = 0  # bytes of these

    def encode(self, texts: list[str | None]) -> list[bytes]:
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        out: list[bytes] = []
        at = 0
        while at < len(raw):
            upto, n = at, 0
            while upto < len(raw) and (upto == at or n + len(raw[upto]) < GROUP_BYTES):
                n += len(raw[upto])
                upto += 1
            out += self._group(raw[at:upto])
            at = upto
        return out

    def _group(self, raw: list[bytes]) -> list[bytes]:
        if self.entries > MAX_WORDS or self.used > MAX_IDS or self.named > MAX_NAMED:
            self.clear()
        text = b"\n".join(raw) + b"\n"
        data, kinds = np.frombuffer(text, np.uint8), np.frombuffer(bytearray(text.translate(_KINDS)), np.uint8)
        lead = np.flatnonzero(kinds == _LEAD)
        latin = _LATIN[data[lead].astype(np.int64) << 8 | data[lead + 1]]
        kinds[lead] = np.where(latin, _LETTER, _OTHER)
        kinds[lead[latin] + 1] = _LETTER
        edges = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(text)]])
        kind = kinds[starts]
        white = kind == _WHITE
        unit = np.cumsum(white)  # the same for all runs of a unit
        odd = np.zeros(int(unit[-1]) + 1, bool)
        odd[unit[kind == _OTHER]] = True
        whole = odd[unit] & ~white
        entry = np.full(len(starts), -1, np.int64)
        runs = np.flatnonzero(~white & ~whole)
        entry[runs] = self._words(text.lower(), starts[runs], ends[runs])
        runs = np.flatnonzero(whole)
        if len(runs):
            begins = np.flatnonzero(np.diff(unit[runs], prepend=-1))
            last = np.append(begins[1:], len(runs)) - 1
            units = [text[a:b] for a, b in zip(starts[runs[begins]].tolist(), ends[runs[last]].tolist())]
            entry[runs[begins]] = self._named(units, self._single)
        return self._joined(raw, entry, starts)

    def _joined(self, raw: list[bytes], entry: np.ndarray, starts: np.ndarray) -> list[bytes]:
        at = np.flatnonzero(entry >= 0)
        entry = entry[at]
        count = self.count.take(entry)
        upto = np.cumsum(np.append(0, count))
        ids = self.pool.take(np.repeat(self.first.take(entry) - upto[:-1], count) + np.arange(upto[-1]))
        bounds = np.searchsorted(starts[at], np.cumsum([0, *(len(r) + 1 for r in raw)]))
        cuts = upto[bounds].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def _words(self, lower: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each word."""
        padded = lower + bytes(_KEY)
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))  # the 8 bytes from each place on
        length = ends - starts
        low = eight[starts] & _FIRST[np.minimum(length, 8)]
        high = eight[np.minimum(starts + 8, len(eight) - 1)] & _FIRST[np.clip(length - 8, 0, 8)]
        entry = self._find(low, high)
        entry[length > _KEY] = -1
        missing = np.flatnonzero(entry < 0)
        if not len(missing):
            return entry
        words = [lower[a:b] for a, b in zip(starts[missing].tolist(), ends[missing].tolist())]
        short = length[missing] <= _KEY
        fresh = dict(zip((w for w, s in zip(words, short.tolist()) if s), missing[short].tolist()))
        if fresh:
            at = np.array(list(fresh.values()))
            self._settle(self._add(self._strung(list(fresh)), low[at], high[at]))
            own = missing[short]
            entry[own] = self._find(low[own], high[own])
        if not short.all():
            entry[missing[~short]] = self._named([w for w, s in zip(words, short.tolist()) if not s], self._strung)
        return entry

    def _seat(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 for those that have none."""
        seat = self._seat(low, high)
        entry = self.seats.take(seat).astype(np.int64)
        going = np.flatnonzero((entry >= 0) & ((self.low.take(entry) != low) | (self.high.take(entry) != high)))
        seat = seat.take(going)
        while len(going):
            seat = (seat + 1) & ((1 << self.bits) - 1)
            found = self.seats.take(seat)
            entry[going] = found
            more = (found >= 0) & ((self.low.take(found) != low.take(going)) | (self.high.take(found) != high.take(going)))
            going, seat = going[more], seat[more]
        return entry

    def _settle(self, entry: np.ndarray) -> None:
        """Give the entries seats; a quarter of all stays free."""
        if 4 * self.entries > 3 << self.bits:
            while 4 * self.entries > 3 << self.bits:
                self.bits += 1
            self.seats = np.full(1 << self.bits, -1, np.int32)
            entry = np.flatnonzero(self.low[: self.entries])
        seat = self._seat(self.low[entry], self.high[entry])
        while len(entry):
            free = self.seats.take(seat) < 0
            self.seats[seat[free]] = entry[free]
            left = self.seats.take(seat) != entry
            seat, entry = (seat[left] + 1) & ((1 << self.bits) - 1), entry[left]

    def _add(self, found: list[bytes], low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """New entries with these ids."""
        ids, n = np.frombuffer(b"".join(found), "<u4"), self.entries + len(found)
        count = np.array([len(f) for f in found], np.int64) // 4
        self.low, self.high, self.first, self.count = (_room(a, n) for a in (self.low, self.high, self.first, self.count))
        self.pool = _room(self.pool, self.used + len(ids))
        self.pool[self.used : self.used + len(ids)] = ids
        new = slice(self.entries, n)
        self.first[new], self.count[new] = self.used + np.cumsum(count) - count, count
        self.low[new], self.high[new] = (0, 0) if low is None else (low, high)
        self.entries, self.used = n, self.used + len(ids)
        return np.arange(new.start, n)

    def _named(self, units: list[bytes], encode) -> list[int]:
        fresh = list(dict.fromkeys(u for u in units if u not in self.others))
        if fresh:
            self.others.update(zip(fresh, self._add(encode(fresh)).tolist()))
            self.named += sum(map(len, fresh))
        return [self.others[u] for u in units]

    def _single(self, units: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(units), 5000):
            some = self.tokenizer.encode_batch_fast([u.decode() for u in units[at : at + 5000]], add_special_tokens=False)
            out += [array("I", e.ids).tobytes() for e in some]
        return out

    def _strung(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), _STRUNG):
            part = words[at : at + _STRUNG]
            found = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[found])
            if len(ends) != len(part):
                out += self._single(part)
                continue
            raw, bounds = found.tobytes(), [0, *(4 * ends + 4).tolist()]
            out += [raw[i:j] for i, j in zip(bounds, bounds[1:])]
        return out


class LibraryIds:
    """The library alone, slower than a compiled or cached form, but it holds nothing
    but the vocabulary and what it makes of one text: that is some 100 bytes a token,
    so texts are handed over one by one."""

    def __init__(self, file: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        encode = self.tokenizer.encode_batch_fast
        return [array("I", encode([t or ""], add_special_tokens=False)[0].ids).tobytes() for t in texts]


def library(file: str) -> LibraryIds:
    return held(("library", file), lambda: LibraryIds(file))


def word_level(file: str) -> WordIds:
    return held(("words", file), lambda: WordIds(file))
