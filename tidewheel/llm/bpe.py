"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A token sequence is the BPE encoding of a piece exactly when every adjacent pair of tokens is compatible,
that is, when merging the pair's bytes gives back the pair. So a piece is encoded by taking the longest token
that starts at each place (an Aho-Corasick automaton over the vocabulary, bytes mapped to Latin-1 characters)
and, where it is not compatible with the token before it, the next shorter one, or backing up; a place that
was left is never entered again, which bounds the work by piece length times token length. Compatibility is
memoised per pair of ids, in a table of fixed size.

Arrow batches are encoded as a whole: distinct pieces once, all of them in step, ids gathered by offsets.
Memos are bounded in bytes and kept between tasks. The pieces of a text are the matches of a pattern; a piece
that is itself a token is that token, as the tiktoken library has it.

Null and empty texts have no ids; an empty table gives an empty one; repeated rows are encoded alike. A very
long text is encoded in blocks cut where a piece ends. Input columns named like an added one are replaced.
Ids that the vocabulary lacks are an error in decoding.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._text import KEPT, Slice, mix64, released, slices, small_batches

#: Memo of pieces: bits of the number of slots (21 bytes each), bytes of a piece that has one, ids that are kept before it starts again.
PIECE_BITS, KEY_BYTES, KNOWN_IDS = 19, 15, 2 << 20
#: Slots of the memo of pairs (8 bytes each).
PAIR_SLOTS = 1 << 19
#: Bytes of text that are split at once; a longer text is cut where a piece ends.
BLOCK = 1 << 19
#: Pieces longer than this are encoded one by one, as are the last few of a batch.
LONG_PIECE, FEW = 64, 24
#: The pattern whose pieces are found without the regex engine (fixed value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points, first and last, that the regex module has as letters or numbers and the Unicode tables that tiktoken splits by do not (fixed values).
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_LETTER, _NUMBER, _BLANK = 1, 2, 3
PIECE_SLOTS = 1 << PIECE_BITS
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: base64 of the token's bytes and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


@functools.cache
def character_kinds() -> np.ndarray:
    """Letter, number, white space or none of them, for each code point, as tiktoken tells them apart."""
    kinds = np.zeros(0x110000, np.uint8)
    for first in range(0, 0x110000, 0x10000):
        some = "".join(map(chr, (c for c in range(first, first + 0x10000) if not 0xD800 <= c < 0xE000)))
        for kind, name in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\s+")):
            kinds[np.frombuffer("".join(regex.findall(name, some)).encode("utf-32-le"), np.uint32)] = kind
    for first, last in LATER:
        kinds[first : last + 1] = 0
    return kinds


def word_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes at which the pieces of ``WORDS`` start, in texts that lie at ``offsets`` of ``buf``."""
    begins = np.flatnonzero((buf & 0xC0) != 0x80)
    cp = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind, n = character_kinds()[cp], len(cp)
    fresh = np.zeros(n + 3, bool)
    fresh[np.searchsorted(begins, offsets[:-1][np.diff(offsets) > 0])] = True
    fresh[n:] = True
    cut = fresh[:n].copy()
    cut[1:] |= kind[1:] != kind[:-1]
    blank = kind == _BLANK
    # the last blank before a word starts a piece; a space takes the word along
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~fresh[1:n])
    cut[last] = True
    cut[last[cp[last] == 0x20] + 1] = False
    quote = np.flatnonzero((cp == 0x27) & cut)
    after = np.append(cp, np.zeros(2, np.uint32))
    one, two = np.where(fresh[quote + 1], 0, after[quote + 1]), np.where(fresh[quote + 1] | fresh[quote + 2], 0, after[np.minimum(quote + 2, n + 1)])
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
    for x, y in ("re", "ve", "ll"):
        size[(one == ord(x)) & (two == ord(y))] = 3
    quote, size = quote[size > 0], size[size > 0]
    cut[quote + 1] = False
    end = quote + size
    cut[end[end < n]] = True
    return begins[cut]


class BytePairCodec:
    """Encodes and decodes by a vocabulary of ranks; ``pattern`` splits texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.plain = ranks, regex.compile(pattern), pattern == WORDS
        self.bytes_of = {i: t for t, i in ranks.items()}
        self._halves()
        reachable = [t for t in ranks if len(t) == 1 or t in self.halves]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        # a node's children are searched in the order of their insertion: frequent characters first
        for t in sorted(reachable, key=lambda t: (len(t) == 1, ranks[t])):
            # reversed, so that a match's end in the reversed piece is its start in the piece
            self.automaton.add_word(t[::-1].decode("latin-1"), ranks[t] + 1)
        self.automaton.make_automaton()
        self._tables(reachable)
        self.pair_memo = np.full(PAIR_SLOTS, -1, np.int64)
        self.forget()

    def _halves(self) -> None:
        """The last merge that makes each token; tokens that no merges make are left out."""
        ranks, self.halves = self.ranks, {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._merge(token, rank)
                if len(parts) == 2:
                    self.halves[token] = (parts[0], parts[1])

    def _merge(self, piece: bytes, below: float = float("inf")) -> list[bytes]:
        """Plain merging, lowest rank first and leftmost among equals, with ranks under ``below``."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                if (r := self.ranks.get(parts[i] + parts[i + 1], below)) < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _tables(self, reachable: list[bytes]) -> None:
        """By id: byte length, halves, next shorter reachable token (-1: none); and what each two ids merge to."""
        ranks, most = self.ranks, max(self.ranks.values(), default=0) + 1
        self.size, self.left, self.right, self.shorter = (np.full(most, x, np.int64) for x in (0, -1, -1, -1))
        usable = set(reachable)
        for t, i in ranks.items():
            self.size[i] = len(t)
        for t, (a, b) in self.halves.items():
            self.left[ranks[t]], self.right[ranks[t]] = ranks[a], ranks[b]
        for t in reachable:
            self.shorter[ranks[t]] = next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in usable), -1)
        merges = array("q")
        for t, i in ranks.items():
            for n in range(1, len(t)):
                if t[:n] in ranks and t[n:] in ranks:
                    merges.extend((ranks[t[:n]] << 32 | ranks[t[n:]], i))
        pairs = np.frombuffer(merges, np.int64).reshape(-1, 2)
        order = np.argsort(pairs[:, 0])
        self.merge_key, self.merge_rank = pairs[order, 0], pairs[order, 1]
        spelled = [self.bytes_of.get(i, b"") for i in range(most)]
        self.spelling = pa.array(spelled, pa.binary())

    def compatible(self, a: bytes, b: bytes) -> bool:
        """Whether merging ``a + b`` from bytes ends with exactly these two tokens."""
        return bool(self._compatible(np.array([self.ranks[a]]), np.array([self.ranks[b]]))[0])

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` for arrays of ids, through the memo of pairs."""
        key = a << 32 | b
        slot = (((key ^ key >> 29) * np.int64(0x1E3779B97F4A7C15)) >> 40) & (PAIR_SLOTS - 1)
        known = self.pair_memo[slot]
        holds, new = (known & 1).astype(bool), known >> 1 != key
        if new.any():
            keys, back = np.unique(key[new], return_inverse=True)
            found = self._holds(keys >> 32, keys & 0xFFFFFFFF)
            holds[new] = found[back]
            self.pair_memo[slot[new]] = key[new] << 1 | holds[new]
        return holds

    def _holds(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Undo the merges beside each border, latest first: none of the pairs that met there may merge earlier."""
        holds, alive = np.ones(len(x), bool), np.arange(len(x))
        limit = np.full(len(x), np.iinfo(np.int64).max)
        top = len(self.merge_key) - 1
        while len(alive):
            if top >= 0:
                key = x << 32 | y
                at = np.minimum(np.searchsorted(self.merge_key, key), top)
                merged = (self.merge_key[at] == key) & (self.merge_rank[at] < limit)
                holds[alive[merged]] = False
            else:
                merged = np.zeros(len(alive), bool)
            left, right = self.left[x], self.right[y]
            stay = ~merged & ((left >= 0) | (right >= 0))
            # the later of both merges is undone; of equal ranks the leftmost merges first, which is the one across the border
            undo_left = ((right < 0) | ((left >= 0) & (x > y)))[stay]
            alive, x, y, left, right = alive[stay], x[stay], y[stay], left[stay], right[stay]
            limit = np.where(undo_left, x, y + 1)
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
        return holds

    def _longest(self, data: bytes) -> np.ndarray:
        """The longest reachable token at each place of pieces that are parted by a character outside Latin-1."""
        n = len(data)
        out = np.full(n, -1, np.int64)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(data[::-1].decode("latin-1"))), np.int64)
        place, token = n - 1 - found[::2], found[1::2] - 1
        # matches that end at one character come longest first
        out[place[::-1]] = token[::-1]
        return out

    def _encode_one(self, piece: bytes) -> list[int]:
        """Ids of one piece, place by place."""
        n = len(piece)
        longest, size, shorter = self._longest(piece).tolist(), self.size, self.shorter
        out: list[int] = []
        at, token, left = 0, longest[0], bytearray(n + 1)
        while at < n:
            while token >= 0 and (left[at + size[token]] or (out and not self._known(out[-1], token))):
                token = int(shorter[token])
            if token < 0:
                if not out:
                    raise ValueError("the vocabulary can't spell this piece")
                # nothing fits from here: this place is closed and the token before it shortened
                left[at] = 1
                token = out.pop()
                at -= int(size[token])
                token = int(shorter[token])
            else:
                out.append(token)
                at += int(size[token])
                token = longest[at] if at < n else -1
        return out

    def _known(self, a: int, b: int) -> bool:
        known = self.one_pairs.get((a, b))
        if known is None:
            if len(self.one_pairs) >= PAIR_SLOTS >> 4:
                self.one_pairs.clear()
            known = self.one_pairs[a, b] = bool(self._compatible(np.array([a]), np.array([b]))[0])
        return known

    def _encode_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and all ids: the pieces' backtracking runs in step."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        end = np.cumsum(sizes)
        start = end - sizes
        longest = self._aligned(pieces, sizes)
        ended = np.full(len(longest) + 1, -1, np.int64)
        closed = np.zeros(len(longest) + 1, bool)
        who = np.flatnonzero(sizes <= LONG_PIECE)
        slow = np.flatnonzero(sizes > LONG_PIECE).tolist()
        at, token = start[who], longest[start[who]]
        while len(who):
            if len(who) <= FEW:
                slow += who.tolist()
                break
            none = token < 0
            if none.any():
                x = np.flatnonzero(none)
                if (at[x] == start[who[x]]).any():
                    raise ValueError("the vocabulary can't spell this piece")
                closed[at[x]] = True
                token[x] = ended[at[x]]
                at[x] -= self.size[token[x]]
                token[x] = self.shorter[token[x]]
                x = np.flatnonzero(~none)
            else:
                x = np.arange(len(who))
            to = at[x] + self.size[token[x]]
            # a piece's end is the next one's start, which is never closed
            fits = ~closed[to]
            inner = np.flatnonzero(fits & (at[x] > start[who[x]]))
            fits[inner] = self._compatible(ended[at[x[inner]]], token[x[inner]])
            bad, x, to = x[~fits], x[fits], to[fits]
            ended[to] = token[x]
            at[x] = to
            token[bad] = self.shorter[token[bad]]
            over = at == end[who]
            if over.any():
                who, at, token = who[~over], at[~over], token[~over]
                moved = np.zeros(len(over), bool)
                moved[x] = True
                moved = moved[~over]
            else:
                moved = np.zeros(len(over), bool)
                moved[x] = True
            token[moved] = longest[at[moved]]
        return self._read(pieces, sizes, start, end, ended, slow)

    def _aligned(self, pieces: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """``_longest`` of all pieces at once; no match crosses from one into another."""
        joined = "Ā".join(p[::-1].decode("latin-1") for p in reversed(pieces))
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64)
        place, token = len(joined) - 1 - found[::2], found[1::2] - 1
        with_gaps = np.full(len(joined), -1, np.int64)
        with_gaps[place[::-1]] = token[::-1]
        inside = np.ones(len(joined), bool)
        inside[np.cumsum(sizes + 1)[:-1] - 1] = False
        return with_gaps[inside]

    def _read(self, pieces, sizes, start, end, ended, slow) -> tuple[np.ndarray, np.ndarray]:
        """Ids from the token that ended at each place of the last path, back from the ends."""
        count, keep = np.zeros(len(pieces), np.int64), np.ones(len(pieces), bool)
        keep[slow] = False
        who = np.flatnonzero(keep)
        at, owners, places, tokens = end[who], [], [], []
        # a piece's last place is shared with the next one's first, where no token ends
        while len(who):
            t = ended[at]
            at = at - self.size[t]
            owners.append(who), places.append(at), tokens.append(t)
            count[who] += 1
            on = at > start[who]
            who, at = who[on], at[on]
        for i in slow:
            t = np.array(self._encode_one(pieces[i]), np.int64)
            count[i] = len(t)
            owners.append(np.full(len(t), i)), places.append(start[i] + np.cumsum(self.size[t]) - self.size[t]), tokens.append(t)
        if not tokens:
            return count, np.zeros(0, np.int32)
        places, tokens = np.concatenate(places), np.concatenate(tokens)
        return count, tokens[np.argsort(places)].astype(np.int32)

    def forget(self) -> None:
        """Empty the memo of pieces."""
        self.low, self.high = np.zeros(PIECE_SLOTS, np.uint64), np.zeros(PIECE_SLOTS, np.uint64)
        self.begin, self.count = np.zeros(PIECE_SLOTS, np.int32), np.zeros(PIECE_SLOTS, np.uint8)
        self.known = np.zeros(0, np.int32)
        self.one_pairs: dict[tuple[int, int], bool] = {}

    def _new_ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each of some distinct pieces, and all ids."""
        rank = self.ranks.get
        whole = np.fromiter((rank(p, -1) for p in pieces), np.int64, len(pieces))
        rest = np.flatnonzero(whole < 0)
        count = np.ones(len(pieces), np.int64)
        some, ids = self._encode_many([pieces[i] for i in rest.tolist()]) if len(rest) else (count[:0], np.zeros(0, np.int32))
        count[rest] = some
        out = np.empty(count.sum(), np.int32)
        direct = np.repeat(whole >= 0, count)
        out[direct], out[~direct] = whole[whole >= 0], ids
        return count, out

    def _ids_of(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece ``buf[start:end]``, and all ids; new pieces are encoded once and remembered."""
        if len(self.known) > KNOWN_IDS:
            self.forget()
        size = end - start
        count, begin = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        short = np.flatnonzero(size <= KEY_BYTES)
        # a short piece and its length are its key
        padded = np.concatenate([buf, np.zeros(16, np.uint8)])
        words = np.ndarray(len(buf) + 9, "<u8", padded, strides=(1,))
        s, n = start[short], size[short]
        low = words[s] & _MASK[np.minimum(n, 8)]
        high = words[s + 8] & _MASK[np.maximum(n - 8, 0)] | n.astype(np.uint64) << np.uint64(56)
        slot = (mix64(low ^ mix64(high)) >> np.uint64(64 - PIECE_BITS)).astype(np.int64)
        hit = (self.low[slot] == low) & (self.high[slot] == high)
        begin[short], count[short] = self.begin[slot], self.count[slot]
        new = np.flatnonzero(~hit)
        store, used, raw = [self.known], len(self.known), None
        if len(new):
            new = new[np.lexsort((low[new], high[new]))]
            first = np.append(True, (np.diff(low[new]) != 0) | (np.diff(high[new]) != 0))
            one, group = new[first], np.cumsum(first) - 1
            raw = buf.tobytes()
            n, ids = self._new_ids([raw[a:z] for a, z in zip(s[one].tolist(), end[short[one]].tolist(), strict=True)])
            at = used + np.cumsum(n) - n
            begin[short[new]], count[short[new]] = at[group], n[group]
            self.low[slot[one]], self.high[slot[one]], self.begin[slot[one]], self.count[slot[one]] = low[one], high[one], at, n
            store.append(ids)
            used += len(ids)
            self.known = np.concatenate(store)
        long = np.flatnonzero(size > KEY_BYTES)
        if len(long):
            raw = raw or buf.tobytes()
            seen: dict[bytes, int] = {}
            of = np.array([seen.setdefault(raw[a:z], len(seen)) for a, z in zip(start[long].tolist(), end[long].tolist(), strict=True)])
            n, ids = self._new_ids(list(seen))
            begin[long], count[long] = (used + np.cumsum(n) - n)[of], n[of]
            store.append(ids)
        total = np.cumsum(count)
        return count, np.concatenate(store)[np.repeat(begin - total + count, count) + np.arange(total[-1])]

    def _blocks(self, buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """Cuts of a buffer: between texts, and inside a long one before a space that parts two ASCII letters."""
        at, n = 0, len(buf)
        while n - at > BLOCK:
            to = int(offsets[np.searchsorted(offsets, at + BLOCK, side="right") - 1])
            if to <= at:
                to = at + BLOCK
                while to < n:
                    part = buf[to - 2 : min(to + (1 << 16), n)]
                    letter = ((part | 0x20) >= 0x61) & ((part | 0x20) <= 0x7A)
                    hit = np.flatnonzero(letter[:-2] & (part[1:-1] == 0x20) & letter[2:])
                    if len(hit):
                        to += int(hit[0]) - 1
                        break
                    to += 1 << 16
                to = min(to, n, int(offsets[np.searchsorted(offsets, at, side="right")]))
            yield at, to
            at = to
        yield at, n

    def encode_slice(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """``(offsets, ids)``: the ids of text ``i`` are ``ids[offsets[i]:offsets[i + 1]]``."""
        counts, out = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        starts = [np.zeros(0, np.int64)]
        if self.plain:
            for a, z in self._blocks(s.buf, s.offsets) if len(s.buf) else ():
                own = s.offsets[(s.offsets > a) & (s.offsets < z)]
                starts.append(a + word_starts(s.buf[a:z], np.concatenate([[0], own - a, [z - a]])))
        else:
            for i in range(s.n):
                base = int(s.offsets[i])
                sizes = [len(p.encode("utf-8")) for p in self.pattern.findall(s.text(i).decode("utf-8"))]
                starts.append(base + np.cumsum(sizes, dtype=np.int64) - np.array(sizes, np.int64))
                if sum(sizes) != s.offsets[i + 1] - base:
                    raise ValueError("the pattern leaves a part of a text out")
        start = np.concatenate(starts)
        ends = np.append(start[1:], len(s.buf))
        for x in range(0, len(start), BLOCK):
            a, z = int(start[x]), int(ends[min(x + BLOCK, len(start)) - 1])
            n, ids = self._ids_of(s.buf[a:z], start[x : x + BLOCK] - a, ends[x : x + BLOCK] - a)
            counts.append(n), out.append(ids)
        total = np.append(0, np.cumsum(np.concatenate(counts)))
        return total[np.searchsorted(start, s.offsets)], np.concatenate(out)

    def encode(self, text: str) -> list[int]:
        batch = pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["text"])
        return self.encode_slice(Slice(batch, "text"))[1].tolist()

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, pa.Buffer]:
        """Ends of the ids' bytes in the returned buffer, which holds them one after another."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or not self.size[ids].all()):
            raise ValueError("an id that the vocabulary lacks")
        ends = np.append(0, np.cumsum(self.size[ids]))
        if not len(ids):
            return ends, pa.py_buffer(b"")
        spelled = pc.take(self.spelling.cast(pa.large_binary()) if ends[-1] >= 2**31 - 1 else self.spelling, pa.array(ids))
        return ends, spelled.buffers()[2]

    def decode(self, ids: Iterable[int]) -> bytes:
        return self.spell(np.fromiter(ids, np.int64))[1].to_pybytes()


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BytePairCodec:
    """One codec for each Python worker, whatever number of tasks it runs."""
    return BytePairCodec(read_ranks(path), pattern)


KEPT["bpe"] = codec.cache_clear

def _digests(data, offsets: np.ndarray) -> pa.Array:
    """SHA-256 of the stretches of a buffer."""
    view, cuts = memoryview(data).cast("B"), offsets.tolist()
    return pa.array([hashlib.sha256(view[a:z]).hexdigest() for a, z in zip(cuts, cuts[1:], strict=False)], pa.string())


def encode(docs: DataFrame, path: str, pattern: str, text_column: str = "text", ids_column: str = "ids", digest_column: str | None = None) -> DataFrame:
    """``docs`` with the ids of each text as an array; the vocabulary file must be on every worker.

    ``digest_column``: the SHA-256 of the bytes that the ids decode to, by the same worker's codec.
    """
    made = [ids_column, *([digest_column] if digest_column else [])]
    ids = f"`{ids_column}` array<int>" + (f", `{digest_column}` string" if digest_column else "")
    kept = [f for f in docs.schema if f.name not in made]
    names = [f.name for f in kept]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches):
        c = codec(path, pattern)
        for s in slices(batches, text_column, BLOCK):
            offsets, flat = c.encode_slice(s)
            new = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))]
            if digest_column:
                ends, data = c.spell(flat)
                new.append(_digests(data, ends[offsets]))
            yield pa.RecordBatch.from_arrays([*s.rows.columns, *new], [*names, *made])

    return small_batches(docs.select(*[F.col(f"`{c}`") for c in names])).mapInArrow(released(run, "bpe"), f"{kinds}, {ids}")


def decode(tokens: DataFrame, path: str, pattern: str, ids_column: str = "ids", bytes_column: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes that each row's ids spell; a null list spells nothing."""
    kept = [f for f in tokens.schema if f.name != bytes_column]
    names = [f.name for f in kept]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    at = names.index(ids_column)

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            lists = batch.column(at)
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            ends, data = c.spell(pc.list_flatten(lists).to_numpy(zero_copy_only=False))
            cuts = ends[np.append(0, np.cumsum(sizes))].tolist()
            rows = [data[a:z].to_pybytes() if z > a else b"" for a, z in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.binary())], [*names, bytes_column])

    return tokens.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(released(run, "bpe"), f"{kinds}, `{bytes_column}` binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: encodes, then decodes the ids, without shipping either."""
    id_kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        c = codec(path, pattern)
        for s in slices(batches, "__text", BLOCK):
            offsets, ids = c.encode_slice(s)
            ends, data = c.spell(ids)
            yield pa.RecordBatch.from_arrays(
                [s.rows.column(0), pa.array(np.diff(offsets), pa.int64()), _digests(np.ascontiguousarray(ids, "<u4"), 4 * offsets), _digests(data, ends[offsets])],
                [id_column, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    picked = docs.select(F.col(id_column), F.col(text_column).alias("__text"))
    return small_batches(picked).mapInArrow(released(run, "bpe"), f"`{id_column}` {id_kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
