"""Licence scans by a positional rare-token index over licence texts.

The index holds the positions of every template's words with the highest inverse document frequency among the
templates. A file's words that are such licence words are looked up in one pass; each occurrence votes for a
template at one relative position (place in the file less place in the template).

* Whole texts and notices tolerate gaps: votes are gathered in bands of relative positions, each an eighth of the
  template wide and overlapping the next. A band that holds enough different rare words is a candidate; its words
  are aligned with the template's by the longest chain that rises in both, and it is kept if the chain has
  ``SHARE`` of the template and half of the template's key phrases, its rarest runs of three words, stand in it.
  Of candidates at one place that differ in label the most alike is kept.
* Phrases and short statements count only where all their words stand together.

Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased. Null and empty texts
have no words, no places, no labels and score 0; an empty table gives an empty one; repeated rows are scanned
alike; ties between candidates go to the earlier template. A text is held whole, however long. Input columns named
like an added one are replaced, others keep their place.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import license_texts
from tidewheel.llm._text import ALNUM, byte_table, prefix_sums, released, slices, small_batches, span_hash

_TABLE = byte_table(41, lower=True)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Share of a template's words that must stand in order, and of its rare words that make a candidate.
SHARE, QUORUM = 0.6, 0.4
#: Rare words of a template (at least, at most, else a third of it), and its key phrases.
RARE, KEY_PHRASES = (8, 400), 8
ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")


@dataclass(frozen=True)
class Template:
    """A licence's wording. ``together``: a short statement, all of whose words must stand together; ``base``: and which counts as such."""

    label: str
    text: str
    together: bool = False
    base: bool = False


def templates(folder: str | None = None) -> tuple[Template, ...]:
    """The known wordings, and the whole licences of a folder if there is one."""
    known = [Template(a, b, True, True) for a, b in license_texts.PHRASES]
    known += [Template(a, b, True) for a, b in license_texts.STATEMENTS]
    return (*known, *(Template(a, b) for a, b in [*license_texts.TEXTS, *license_texts.texts_in(folder)]))


def words_of(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def _hash_words(words: list[str]) -> np.ndarray:
    buf = np.frombuffer(" ".join(words).encode(), np.uint8)
    sizes = np.array([len(w.encode()) for w in words], np.int64)
    end = np.cumsum(sizes + 1) - 1
    return span_hash(prefix_sums(buf, _TABLE), end - sizes, end)


class PositionalIndex:
    """Rare words of templates with their positions, as one sorted list of postings."""

    def __init__(self, known: tuple[Template, ...]):
        self.templates = known
        words = [words_of(t.text) for t in known]
        frequency = Counter(w for ws in words for w in set(ws))
        idf = {w: math.log((1 + len(words)) / n) for w, n in frequency.items()}
        self.sequence = [_hash_words(ws) for ws in words]
        self.length = np.array([len(ws) for ws in words])
        self.band = np.maximum(8, self.length // 8)
        self.together = np.array([t.together for t in known])
        self.needed, self.phrases, postings = [], [], []
        for k, ws in enumerate(words):
            rarest = sorted(range(len(ws)), key=lambda i, ws=ws: (-idf[ws[i]], i))
            places = rarest[: 1 if self.together[k] else min(len(ws), max(RARE[0], min(RARE[1], len(ws) // 3)))]
            postings += [(int(self.sequence[k][i]), k, i) for i in places]
            self.needed.append(math.ceil(QUORUM * len(places)))
            self.phrases.append(self._key_phrases(ws, idf))
        postings.sort()
        hashes = np.array([p[0] for p in postings], np.uint64)
        self.keys, self.first = np.unique(hashes, return_index=True)
        self.first = np.append(self.first, len(postings))
        self.of, self.at = (np.array([p[c] for p in postings], np.int64) for c in (1, 2))
        self.needed = np.array(self.needed)
        self.mask = np.zeros(1 << 16, bool)
        self.mask[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def _key_phrases(self, ws: list[str], idf: dict[str, float]) -> list[np.ndarray]:
        """The rarest runs of three words that don't overlap."""
        taken, out = set(), []
        for i in sorted(range(len(ws) - 2), key=lambda i: (-sum(idf[w] for w in ws[i : i + 3]), i)):
            if not taken & {i, i + 1, i + 2}:
                taken |= {i, i + 1, i + 2}
                out.append(_hash_words(ws[i : i + 3]))
            if len(out) == min(KEY_PHRASES, max(1, len(ws) // 4)):
                break
        return out

    def votes(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """(template, template place, text, place in the text) of each posting that a word meets."""
        maybe = np.flatnonzero(self.mask[(words >> np.uint64(48)).astype(np.int64)])
        key = np.minimum(np.searchsorted(self.keys, words[maybe]), len(self.keys) - 1)
        hit = self.keys[key] == words[maybe]
        place, key = maybe[hit], key[hit]
        n = self.first[key + 1] - self.first[key]
        posting = np.repeat(self.first[key] - np.cumsum(n) + n, n) + np.arange(n.sum())
        place = np.repeat(place, n)
        doc = np.searchsorted(first, place, side="right") - 1
        return self.of[posting], self.at[posting], doc, place - first[doc]

    def scan(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """``(text, template, start, words, share)`` of each verified match."""
        if not len(words):
            return []
        template, at, doc, place = self.votes(words, first)
        short = self.together[template]
        out = self._standing_together(words, first, template[short], doc[short], (place - at)[short])
        out += self._in_order(words, first, template[~short], at[~short], doc[~short], place[~short])
        return out

    def _standing_together(self, words, first, template, doc, start) -> list:
        out = []
        for k in np.unique(template).tolist():
            mine = template == k
            d, s, size = doc[mine], start[mine], int(self.length[k])
            fits = (s >= 0) & (s + size <= (first[d + 1] - first[d]))
            d, s = d[fits], s[fits]
            same = (words[(first[d] + s)[:, None] + np.arange(size)] == self.sequence[k]).all(axis=1)
            out += [(x, k, y, size, 1.0) for x, y in zip(d[same].tolist(), s[same].tolist(), strict=True)]
        return out

    def _in_order(self, words, first, template, at, doc, place) -> list:
        if not len(template):
            return []
        # band b holds relative positions from (b - 1) to (b + 1) widths, counted from minus the template's length
        band = (place - at + self.length[template]) // self.band[template]
        bands = int(band.max()) + 2
        code = (doc * len(self.templates) + template) * bands + band
        most = int(self.length.max()) + 1
        code = np.unique(np.concatenate([code, code + 1]) * most + np.concatenate([at, at])) // most
        code, n = np.unique(code, return_counts=True)
        enough = n >= self.needed[code // bands % len(self.templates)]
        code, n = code[enough], n[enough]
        found: dict[int, list[tuple]] = {}
        run = np.cumsum(np.append(True, np.diff(code) != 1)) if len(code) else code
        for r in np.unique(run):
            mine = np.flatnonzero(run == r)
            best = int(code[mine[np.argmax(n[mine])]])
            d, k, b = best // bands // len(self.templates), best // bands % len(self.templates), best % bands
            width, size = int(self.band[k]), int(self.length[k])
            low = (b - 1) * width - size
            a, z = max(0, low), min(int(first[d + 1] - first[d]), low + 2 * width + size)
            text = words[first[d] + a : first[d] + z]
            chain = rising_chain(self.sequence[k], text, low - a, low - a + 2 * width)
            phrases = sum(_stands(p, text) for p in self.phrases[k])
            if chain and len(chain) >= SHARE * size and 2 * phrases >= len(self.phrases[k]):
                start, span = a + chain[0], chain[-1] - chain[0] + 1
                found.setdefault(d, []).append((2 * len(chain) / (size + span), d, k, start, span, len(chain) / size))
        return [m[1:] for ms in found.values() for m in self._most_alike(ms)]

    def _most_alike(self, matches: list[tuple]) -> list[tuple]:
        """Of matches of different labels that share most of a place, the most alike."""
        kept: list[tuple] = []
        for m in sorted(matches, key=lambda m: (-m[0], m[2])):
            label, a, z = self.templates[m[2]].label, m[3], m[3] + m[4]
            if not any(self.templates[o[2]].label != label and 2 * (min(z, o[3] + o[4]) - max(a, o[3])) > z - a for o in kept):
                kept.append(m)
        return kept


def rising_chain(template: np.ndarray, text: np.ndarray, low: int, high: int) -> list[int]:
    """Places in the text of the longest chain of equal words that rises in both, with relative positions in a band."""
    order = np.argsort(text, kind="stable")
    begin, end = (np.searchsorted(text[order], template, side=x) for x in ("left", "right"))
    n = end - begin
    i = np.repeat(np.arange(len(template)), n)
    f = order[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())]
    inside = (f - i >= low) & (f - i <= high)
    i, f = i[inside], f[inside]
    order = np.lexsort((-f, i))
    tails, last, back = [], [], []
    places = f[order].tolist()
    for p, x in enumerate(places):
        k = bisect_left(tails, x)
        back.append(last[k - 1] if k else -1)
        if k == len(tails):
            tails.append(x), last.append(p)
        else:
            tails[k], last[k] = x, p
    chain, p = [], last[-1] if last else -1
    while p >= 0:
        chain.append(places[p])
        p = back[p]
    return chain[::-1]


def _stands(phrase: np.ndarray, text: np.ndarray) -> bool:
    size = len(text) - len(phrase) + 1
    return size > 0 and bool(np.logical_and.reduce([text[k : k + size] == w for k, w in enumerate(phrase)]).any())


def scan(docs: DataFrame, text_column: str = "text", known: tuple[Template, ...] | None = None) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score, matches added.

    ``known``: the wordings, ``templates()`` if not given; they are sent to every task and must be few.
    """
    known = templates() if known is None else known
    if (size := sum(len(t.text) for t in known)) > 32 << 20:
        raise ValueError(f"{size} characters of licences are too many to send to every task")
    columns = [c for c in docs.columns if c not in ADDED]
    match_kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int32()), ("share", pa.float64())]))

    def run(batches):
        index = PositionalIndex(known)
        for s in slices(batches, text_column):
            start, end, first = s.words(ALNUM)
            words = span_hash(prefix_sums(s.buf, _TABLE), start, end)
            found: list[list] = [[] for _ in range(s.n)]
            for d, k, p, n, x in index.scan(words, first):
                found[d].append((p, k, n, x))
            rows = {c: [] for c in ADDED[1:]}
            for f in found:
                base = sorted(p for p, k, _, _ in f if known[k].base)
                rows["n_base"].append(len(base))
                rows["first_word"].append(base[0] if base else None)
                rows["last_word"].append(base[-1] if base else None)
                rows["base_labels"].append(",".join(sorted({known[k].label for _, k, _, _ in f if known[k].base})))
                rows["labels"].append(",".join(sorted({known[k].label for _, k, _, _ in f})))
                # a bare phrase is weaker evidence than a statement, a notice or a whole text
                rows["score"].append(max((x * (0.5 if known[k].base else 1.0) for _, k, _, x in f), default=0.0))
                rows["matches"].append([{"label": known[k].label, "start": p, "words": n, "share": x} for p, k, n, x in sorted(f)])
            kinds = dict(zip(ADDED, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), match_kind), strict=True))
            added = [pa.array(np.diff(first).astype(np.int64)), *(pa.array(rows[c], kinds[c]) for c in ADDED[1:])]
            yield pa.RecordBatch.from_arrays([*s.rows.columns, *added], [*columns, *ADDED])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns)
    return small_batches(docs.select(*[F.col(f"`{c}`") for c in columns])).mapInArrow(
        released(run),
        f"{kinds}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
        " matches array<struct<label:string,start:long,words:int,share:double>>",
    )
