"""Which of many terms occur in texts, and in blocks of texts which rows a list of terms meets.

A text is cut at white space. A term without any occurs in a text where it occurs in one of its words; words repeat, so what
a word holds is remembered. All runs of characters of new words are looked up at once, by a hash that is then verified. Of any
other term a piece is looked up, and the term verified in the text. Results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters of a piece that is looked up, at most.
_LONGEST = 24
#: Words whose terms are remembered, and characters of words that are looked up at a time.
_WORDS_KEPT, _CHARACTERS_AT_ONCE = 150_000, 200_000
_BASE, _MIX = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _distinct(numbers: np.ndarray) -> np.ndarray:
    numbers = np.sort(numbers)
    return numbers[np.concatenate((numbers[:1] == numbers[:1], numbers[1:] != numbers[:-1]))]


class Lookup:
    """The numbers of the terms, those of their place in ``terms``, that occur in texts; both are folded already."""

    def __init__(self, terms: pa.Array):
        places: dict[str, int] = {}
        self.own = []  # the term that each piece is, or -1
        #: Terms to be verified in a text, by the piece that is looked up; ``bare`` ones have no piece.
        self.more: dict[int, list[tuple[int, str]]] = {}
        self.bare: list[tuple[int, str]] = []
        for number, term in enumerate(terms.to_pylist()):
            piece = max(term.split(), key=len, default="")[:_LONGEST]
            if not piece:
                self.bare.append((number, term))
                continue
            place = places.setdefault(piece, len(places))
            if place == len(self.own):
                self.own.append(-1)
            if piece == term:
                self.own[place] = number
            else:
                self.more.setdefault(place, []).append((number, term))
        self.own = np.array(self.own, np.int64)
        self._known: dict[str, tuple[int, ...]] = {}
        self._table(list(places))

    def _slots(self, hashes: np.ndarray, size: int) -> np.ndarray:
        return ((hashes + np.uint64(size)) * _MIX) >> np.uint64(64 - self.bits)

    def _table(self, pieces: list[str]) -> None:
        self.bits = min(24, len(pieces).bit_length() + 3)  # eight slots or more for a piece
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        letters, starts = _codes("".join(pieces)), np.concatenate(([0], np.cumsum(sizes)))[:-1]
        hashes, slots = np.zeros(len(pieces), np.uint64), np.zeros(len(pieces), np.uint64)
        for size in np.unique(sizes):
            some = np.flatnonzero(sizes == size)
            for i in range(size):
                hashes[some] = hashes[some] * _BASE + letters[starts[some] + i]
            slots[some] = self._slots(hashes[some], size)
        order = np.argsort(slots, kind="stable")
        self.sizes = set(sizes.tolist())
        self.pieces, self.hashes, self.lengths, self.starts, self.letters = order, hashes[order], sizes[order], starts[order], letters
        self.first = np.zeros((1 << self.bits) + 1, np.int32)
        np.cumsum(np.bincount(slots.astype(np.int64), minlength=1 << self.bits), out=self.first[1:])
        self.filled = self.first[1:] > self.first[:-1]

    def _found(self, words: list[str]) -> Iterator[tuple[int, ...]]:
        """Of each word the pieces it holds."""
        text = _codes("\n".join(words) + "\n")
        breaks = np.flatnonzero(text == 10)
        word = np.repeat(np.arange(len(words)), np.diff(breaks, prepend=-1))
        at = np.arange(len(text))
        left, hashes = breaks[word] - at, np.zeros(len(text), np.uint64)
        where, what = [], []
        for size in range(1, max(self.sizes, default=0) + 1):
            fits = left >= size
            at, left, hashes = at[fits], left[fits], hashes[fits]
            hashes = hashes * _BASE + text[at + (size - 1)]
            if size not in self.sizes:
                continue
            slots = self._slots(hashes, size)
            some = np.flatnonzero(self.filled[slots])
            place, end = self.first[slots[some]], self.first[slots[some] + np.uint64(1)]
            while len(some):
                same = np.flatnonzero((self.hashes[place] == hashes[some]) & (self.lengths[place] == size))
                begin, entry = at[some[same]], place[same]
                for i in range(size):
                    right = self.letters[self.starts[entry] + i] == text[begin + i]
                    if not right.all():
                        begin, entry = begin[right], entry[right]
                where.append(word[begin])
                what.append(self.pieces[entry])
                again = np.flatnonzero(place + 1 < end)
                some, place, end = some[again], place[again] + 1, end[again]
        if not where:
            yield from (() for _ in words)
            return
        pairs = _distinct(np.concatenate(where) * len(self.own) + np.concatenate(what))
        owner, piece = np.divmod(pairs, max(len(self.own), 1))
        ends, piece, low = np.searchsorted(owner, np.arange(len(words)), side="right").tolist(), piece.tolist(), 0
        for high in ends:
            yield tuple(piece[low:high])
            low = high

    def numbers(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Of each text the sorted numbers of its terms."""
        if len(self._known) > _WORDS_KEPT:
            self._known.clear()
        split = [set(text.split()) for text in texts]
        new = list(set().union(*split).difference(self._known))
        low = 0
        while low < len(new):
            high, characters = low, 0
            while high < len(new) and characters < _CHARACTERS_AT_ONCE:
                characters += len(new[high])
                high += 1
            self._known.update(zip(new[low:high], self._found(new[low:high])))
            low = high
        for text, words in zip(texts, split):
            pieces = set().union(*map(self._known.__getitem__, words))
            met = self.own[np.fromiter(pieces, np.int64, len(pieces))]
            rest = [n for piece in pieces.intersection(self.more) for n, term in self.more[piece] if term in text]
            rest += [n for n, term in self.bare if term in text]
            yield np.sort(np.concatenate((met[met >= 0], np.array(rest, np.int64))))


# --- numbers as bytes, and blocks of rows --------------------------------------------------------------

def packed(numbers: np.ndarray) -> bytes:
    """Steps between the numbers, their low bytes first: few bytes once compressed."""
    steps = np.diff(numbers, prepend=numbers.dtype.type(0))
    return steps.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def unpacked(data: bytes, kind: type) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(steps.T).view(kind).reshape(-1), dtype=kind)


#: Lists of terms that meet a block at a time, and terms whose rows are unpacked.
_LISTS_AT_ONCE, _TERMS_AT_ONCE = 1024, 512


class Block:
    """The rows, up to 65,536, in which each term occurs: bits of a frequent term, numbers of the rows of any other."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray, rows: np.ndarray, size: int):
        self.terms, self.ends, self.rows, self.size = terms, ends.astype(np.int64), rows, size

    @staticmethod
    def of(lists: list[np.ndarray]) -> "Block":
        """Of the numbers of the terms of each row."""
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        entries = np.sort(np.concatenate([*lists, np.empty(0, np.int64)]).astype(np.int64) << 16 | row)
        term = entries >> 16
        ends = np.append(np.flatnonzero(np.diff(term)) + 1, len(term))[: len(term)]
        return Block(term[ends - 1].astype(np.uint32), ends, (entries & 0xFFFF).astype(np.uint16), len(lists))

    def met(self, lists: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """For some lists at a time the number of the first, and of each the bits of the rows that have any of its terms.

        ``lists`` are where each one ends in the terms of all, and these.
        """
        stops, terms = lists
        counts, wide = np.diff(self.ends, prepend=0), -(-self.size // 64)
        frequent = counts > self.size // 16
        place = np.full(int(max(terms.max(initial=0), self.terms.max(initial=0))) + 1, -1, np.int64)
        often, seldom = np.flatnonzero(frequent), np.flatnonzero(~frequent)
        place[self.terms[often]], place[self.terms[seldom]] = np.arange(len(often)), len(often) + np.arange(len(seldom))
        bits = np.zeros((len(often), wide), np.uint64)
        for low in range(0, len(often), _TERMS_AT_ONCE):
            some = often[low : low + _TERMS_AT_ONCE]
            flags = np.zeros((len(some), wide * 64), np.bool_)
            for i, term in enumerate(some):
                flags[i, self.rows[self.ends[term] - counts[term] : self.ends[term]]] = True
            bits[low : low + len(some)] = np.packbits(flags, axis=1).view(np.uint64)
        begins, lengths = self.ends[seldom] - counts[seldom], counts[seldom]
        for low in range(0, len(stops), _LISTS_AT_ONCE):
            high = min(low + _LISTS_AT_ONCE, len(stops))
            begin = stops[low - 1] if low else 0
            own = np.repeat(np.arange(high - low), np.diff(stops[low:high], prepend=begin))
            entry = place[terms[begin : stops[high - 1]]]
            met = np.zeros((high - low, wide), np.uint64)
            known = (entry >= 0) & (entry < len(often))
            if known.any():
                mine = own[known]
                firsts = np.flatnonzero(np.diff(mine, prepend=-1))
                met[mine[firsts]] = np.bitwise_or.reduceat(bits[entry[known]], firsts, axis=0)
            rare = np.flatnonzero(entry >= len(often))
            if len(rare):
                term = entry[rare] - len(often)
                n = lengths[term]
                at = np.arange(n.sum()) + np.repeat(begins[term] - np.cumsum(n) + n, n)
                row, mine = self.rows[at].astype(np.int64), np.repeat(own[rare], n)
                np.bitwise_or.at(met.view(np.uint8).reshape(-1), mine * (wide * 8) + (row >> 3), np.uint8(128) >> (row & 7).astype(np.uint8))
            yield low, met


def first_rows(met: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the bits of each list the first ``wanted`` rows: the number of the list, and the row."""
    owner, row = np.nonzero(np.unpackbits(met.view(np.uint8), axis=1).view(np.bool_))
    starts = np.searchsorted(owner, np.arange(len(met)))
    kept = np.arange(len(owner)) - starts[owner] < wanted[owner]
    return owner[kept], row[kept]
