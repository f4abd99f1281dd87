"""Phrase collocation mining by pivot partitioning, as in MG-FSM (Miliaraki et al. 2013).

Words are numbered by falling frequency within the whole corpus; words too rare for any phrase are blank. The pivot of an n-gram is
its rarest word, at its leftmost place. Around every word a text is rewritten for that word as pivot: up to ``longest - 1``
words to either side, cut at the first one that is blank, rarer, or (to the left) equal, so the fragment holds just the
n-grams that this place owns. Equal fragments are counted before they travel, packed by bucket, to their pivot's
bucket; that mines its fragments alone and emits the n-grams it owns, each of which no other bucket has. Fragments of
the few pivots that would fill a bucket are spread over all buckets and their n-grams' counts added up.

Everything is counted by language (null: ``und``). Texts are lower-cased in A-Z, split at ``[.,;:!?\\x0A-\\x0D]`` and those
pieces into words ``[^\\x20\\x09]+``; null texts are empty. A phrase's score is ``floor(1000000 * a * a / (l * r))`` of its
weakest cut, exact for counts up to 10**15. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm._text import Slice, byte_table, mix64, prefix_sums, released, shuffle_parts, slices, small_batches, span_hash, word_table
from tidewheel.operators.components import checkpointed
from tidewheel.operators.ordering import numbered

_ENDS = bytes([*b".,;:!?", *range(0x0A, 0x0E)])
_WORD, _END = word_table(b" \t" + _ENDS), ~word_table(_ENDS)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HASH = byte_table(12, False)

#: Words and bytes of a vocabulary that is sent to every task; a larger one is joined.
SHIPPED_WORDS, SHIPPED_BYTES = 2_000_000, 64 << 20
#: Fragments that a task holds before it packs them, words that stand for a bucket, and distinct words a task counts at once.
HELD, BUCKET_WORDS, COUNTED = 1 << 19, 1 << 19, 100_000
#: Ranges by phrase in which a language's rows are cut to the first ones before they meet.
SALTS = 16


def tokens(text: Slice) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``(distinct words, place of each word among them, whether a word and the next stand in one piece)``."""
    start, end, first = text.words(_WORD)
    lower = _LOWER[text.buf]
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(lower[_WORD[text.buf]])]).dictionary_encode()
    piece = np.cumsum(_END[text.buf])[start] if len(start) else np.zeros(0, np.int64)
    joined = np.zeros(len(start), bool)
    joined[:-1] = piece[1:] == piece[:-1]
    cuts = first[1:-1]
    joined[cuts[cuts > 0] - 1] = False
    return words.dictionary, words.indices.to_numpy(), joined


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Slice]]:
    """The texts of each slice of ``(lang, text)``, language by language."""
    for s in slices(batches, "text", 2 << 20):
        langs = s.rows.column(0).dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            if len(langs.dictionary) == 1:
                yield lang, s
            else:
                yield lang, Slice(s.rows.take(pa.array(np.flatnonzero(langs.indices.to_numpy() == k))), "text")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    size = 0

    def out():
        for lang, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64())], ["lang", "word", "n"])

    for lang, s in _by_language(batches):
        words, indices, _ = tokens(s)
        own = held.setdefault(lang, {})
        size -= len(own)
        for word, n in zip(words.to_pylist(), np.bincount(indices, minlength=len(words)).tolist(), strict=True):
            own[word] = own.get(word, 0) + n
        size += len(own)
        if size > COUNTED:
            yield from out()
            held, size = {}, 0
    yield from out()


class Vocabulary:
    """Numbers of words, by a hash that the words themselves confirm."""

    def __init__(self, words: pa.Array, ids: np.ndarray):
        self.words = words.cast(pa.large_binary())
        hashes = self._hashes(self.words)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.words, self.ids = hashes[order], self.words.take(pa.array(order)), ids[order]
        twice = np.zeros(len(order) + 1, bool)
        twice[1:-1] = self.hashes[1:] == self.hashes[:-1]
        shared = np.flatnonzero(twice[1:] | twice[:-1])
        self.shared = dict(zip(self.words.take(pa.array(shared)).to_pylist(), self.ids[shared].tolist(), strict=True))

    @staticmethod
    def _hashes(words: pa.Array) -> np.ndarray:
        if not len(words):
            return np.zeros(0, np.uint64)
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        buf = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        at = offsets - offsets[0]
        out = np.zeros(len(words), np.uint64)
        low = 0
        while low < len(words):  # the hash's powers are kept for a few megabytes
            high = max(low + 1, int(np.searchsorted(at, at[low] + (4 << 20), side="right")) - 1)
            sums = prefix_sums(buf[at[low] : at[high]], _HASH)
            out[low:high] = span_hash(sums, at[low:high] - at[low], at[low + 1 : high + 1] - at[low])
            low = high
        return out

    def find(self, words: pa.Array) -> np.ndarray:
        """The number of each word, 0 for one that is not here."""
        if not len(self.ids) or not len(words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, self._hashes(words)), len(self.ids) - 1)
        same = pc.equal(self.words.take(pa.array(at)), words).to_numpy(zero_copy_only=False)
        out = np.where(same, self.ids[at], 0)
        if self.shared:
            for i in np.flatnonzero(~same):
                out[i] = self.shared.get(words[i].as_py(), 0)
        return out


def fragments(ids: np.ndarray, joined: np.ndarray, longest: int) -> np.ndarray:
    """Rewritten fragments, a row a pivot: ``longest - 1`` places before it, itself, and as many behind; 0 is blank."""
    n, mid = len(ids), longest - 1
    out = np.zeros((2 * longest - 1, n), np.int64)
    out[mid] = ids
    left = right = ids > 0
    any_ = np.zeros(n, bool)
    for s in range(1, min(longest, n)):
        on = np.zeros(n, bool)
        on[:-s] = right[:-s] & joined[s - 1 : n - 1] & (ids[s:] > 0) & (ids[s:] <= ids[:-s])
        out[mid + s, :-s] = np.where(on[:-s], ids[s:], 0)
        back = np.zeros(n, bool)
        back[s:] = left[s:] & joined[: n - s] & (ids[:-s] > 0) & (ids[:-s] < ids[s:])
        out[mid - s, s:] = np.where(back[s:], ids[:-s], 0)
        right, left = on, back
        any_ |= on | back
    return out[:, any_]


def _counted(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows and the sum of their counts."""
    names = [f"k{i}" for i in range(len(columns))]
    made = pa.table([*columns, counts], names=[*names, "c"]).group_by(names, use_threads=False).aggregate([("c", "sum")])
    return [made.column(x).to_numpy() for x in names], made.column("c_sum").to_numpy().astype(np.int64)


class _Packer:
    """Fragments of a task: counted when many are held, then packed by bucket as ``(bucket, n, data)``."""

    def __init__(self, buckets: int, hot: int, longest: int):
        self.buckets, self.hot, self.longest = buckets, hot, longest
        self.held: list = []
        self.rows = 0

    def add(self, made: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((list(made.astype(np.uint32)), np.ones(made.shape[1], np.int64)))
        self.rows += made.shape[1]
        if self.rows >= HELD:
            columns, counts = self._count()
            if len(counts) > HELD // 4:
                yield from self._pack(columns, counts)
                self.held, self.rows = [], 0
            else:
                self.held, self.rows = [(columns, counts)], len(counts)

    def _count(self):
        return _counted([np.concatenate([c[k] for c, _ in self.held]) for k in range(2 * self.longest - 1)], np.concatenate([n for _, n in self.held]))

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield from self._pack(*self._count())
            self.held, self.rows = [], 0

    def _pack(self, columns: list[np.ndarray], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        pivot = columns[self.longest - 1].astype(np.uint64)
        with np.errstate(over="ignore"):
            key = mix64(pivot)
            mixed = key
            for c in columns:
                mixed = mix64(mixed * np.uint64(31) + c.astype(np.uint64))
        bucket = np.where(pivot <= self.hot, mixed, key) % np.uint64(self.buckets)
        order = np.argsort((bucket << np.uint64(40)) | pivot)
        bucket = bucket[order].astype(np.int64)
        block = np.stack([c[order] for c in columns])
        counts = counts[order]
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = np.append(cuts[1:], len(bucket))
        data = [block[:, a:z].tobytes() + counts[a:z].tobytes() for a, z in zip(cuts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int64()), pa.array(ends - cuts, pa.int32()), pa.array(data, pa.binary())], ["bucket", "n", "data"])


def _mine(columns: list[np.ndarray], counts: np.ndarray, least: int, hot: int, longest: int) -> Iterator[pa.RecordBatch]:
    """N-grams that fragments own, with their counts: those of hot pivots in part, of the others the frequent ones."""
    for n in range(2, longest + 1):
        for before in range(n):
            some = columns[longest - 1 - before : longest - 1 - before + n]
            there = np.flatnonzero((some[0] > 0) & (some[-1] > 0))
            if not len(there):
                continue
            words, a = _counted([c[there] for c in some], counts[there])
            keep = (a >= least) | (np.max(words, axis=0) <= hot)
            flat = np.stack(words, axis=1)[keep].ravel().astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([made, pa.array(a[keep])], ["g", "a"])


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return small_batches(docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")))


def _by_shipped(texts: DataFrame, frequent: DataFrame, packer: tuple) -> DataFrame:
    """Packed fragments, the vocabulary sent to every task."""
    table = frequent.select("lang", "word", "id").toArrow()
    langs = {lang: table.filter(pc.equal(table["lang"], lang)) for lang in pc.unique(table["lang"]).to_pylist()}
    sent = texts.sparkSession.sparkContext.broadcast({k: (t["word"].combine_chunks(), t["id"].to_numpy()) for k, t in langs.items()})
    mark = uuid.uuid4().hex

    def run(batches):
        known = _VOCABULARIES.get(mark)
        if known is None:
            _VOCABULARIES.clear()
            known = _VOCABULARIES[mark] = {k: Vocabulary(*v) for k, v in sent.value.items()}
        packed = _Packer(*packer)
        for lang, s in _by_language(batches):
            words, indices, joined = tokens(s)
            if lang in known and len(indices):
                yield from packed.add(fragments(known[lang].find(words)[indices], joined, packer[2]))
        yield from packed.rest()

    return texts.mapInArrow(released(run), "bucket bigint, n int, data binary")


#: The vocabulary that a worker has last built, by its broadcast.
_VOCABULARIES: dict = {}


def _by_joined(texts: DataFrame, frequent: DataFrame, packer: tuple) -> DataFrame:
    """Packed fragments where the vocabulary is too large to send: each block of texts asks for its own distinct words."""

    def cut(batches):
        part = TaskContext.get().partitionId()
        for k, (lang, s) in enumerate(_by_language(batches)):
            words, indices, joined = tokens(s)
            values = [pa.array([f"{part}-{k}"]), pa.array([lang]), pa.array([words.cast(pa.large_string()).to_pylist()], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*values, pa.array([indices.astype(np.int32).tobytes()], pa.binary()), pa.array([joined.tobytes()], pa.binary())], ["block", "lang", "words", "places", "joined"])

    blocks = checkpointed(texts.mapInArrow(released(cut), "block string, lang string, words array<string>, places binary, joined binary"))
    asked = blocks.select("block", "lang", F.posexplode("words").alias("at", "word"))
    known = asked.join(frequent.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("at", "id")).alias("known"))

    def run(batches):
        packed = _Packer(*packer)
        for batch in batches:
            for size, places, joined, known in zip(*(batch.column(k) for k in range(4)), strict=True):
                ids = np.zeros(size.as_py(), np.int64)
                ids[known.values.field(0).to_numpy()] = known.values.field(1).to_numpy()
                at = np.frombuffer(places.as_buffer(), np.int32)
                if len(at):
                    yield from packed.add(fragments(ids[at], np.frombuffer(joined.as_buffer(), bool), packer[2]))
        yield from packed.rest()

    whole = blocks.join(known, "block").select(F.size("words").alias("size"), "places", "joined", "known")
    return whole.mapInArrow(released(run), "bucket bigint, n int, data binary")


def phrases(docs: DataFrame, longest: int = 3, least: int = 10, text: str = "text", lang: str = "lang", shipped: int = SHIPPED_WORDS, bucket_words: int = BUCKET_WORDS) -> tuple[DataFrame, DataFrame]:
    """``(words, phrases)``: every word that occurs ``least`` times as (lang, word, id, f) and every such n-gram of 2 to ``longest`` words as (g, a).

    ``g`` holds word ids, which rise as words get rarer. Both are written out.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words or more and occur once or more")
    texts = _texts(docs, text, lang)
    counts = checkpointed(texts.mapInArrow(released(_count_words), "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("f")))
    words = checkpointed(numbered(counts.filter(F.col("f") >= least), [F.desc("f"), F.col("lang"), F.col("word")], "id"))
    size = words.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("bytes")).first()
    total = counts.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    buckets = max(shuffle_parts(docs), total // bucket_words)
    hot = words.filter(F.col("f") > max(least, total // (4 * buckets))).count()  # at most four a bucket
    packer = (buckets, hot, longest)
    packed = (_by_shipped if size["n"] <= shipped and size["bytes"] <= SHIPPED_BYTES else _by_joined)(texts, words, packer)
    dealt = packed.repartition(shuffle_parts(docs), "bucket").sortWithinPartitions("bucket")

    def run(batches):
        now, held = None, []

        def done():
            columns, counts = [np.concatenate([c[k] for c, _ in held]) for k in range(2 * longest - 1)], np.concatenate([n for _, n in held])
            yield from _mine(columns, counts, least, hot, longest)

        for batch in batches:
            for bucket, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket != now and held:
                    yield from done()
                    held = []
                now, view = bucket, data.as_buffer()
                width = 4 * n * (2 * longest - 1)
                held.append((list(np.frombuffer(view, np.uint32, n * (2 * longest - 1)).reshape(-1, n).copy()), np.frombuffer(view, np.int64, n, width).copy()))
        if held:
            yield from done()

    mined = dealt.mapInArrow(released(run), "g array<int>, a bigint")
    found = checkpointed(mined.groupBy("g").agg(F.sum("a").alias("a")).filter(F.col("a") >= least))
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    return words.join(totals, "lang"), found


def with_score(cuts: DataFrame) -> DataFrame:
    """``cuts`` with ``score``, ``floor(1000000 * a * a / (l * r))`` in whole numbers of up to 38 digits."""
    exact = {c: f"cast({c} as decimal(18,0))" for c in ("a", "l", "r")}
    wide = cuts.withColumn("__up", F.expr("{a} * {a} * cast(1000000 as decimal(7,0))".format(**exact))).withColumn("__down", F.expr("{l} * {r}".format(**exact)))
    return wide.withColumn("score", F.expr("__up div __down")).drop("__up", "__down")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int | None = 2000, inside: int = 50, text: str = "text", lang: str = "lang", **sizes) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's phrases by score, count and text, the first ``top`` of them.

    A phrase leaves where a longer one that holds its words together occurs ``inside`` percent as often or more. ``n``
    counts the language's words; ``l`` and ``r`` are the counts of the two sides of the weakest cut, the leftmost of equals.
    """
    words, found = phrases(docs, longest, least, text, lang, **sizes)
    known = found.unionByName(words.select(F.array("id").alias("g"), F.col("f").alias("a")))
    size = F.size("g")
    cuts = found.select("g", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    sided = cuts.withColumn("left", F.slice("g", 1, F.col("k"))).withColumn("right", F.slice("g", F.col("k") + 1, size - F.col("k")))
    for side, name in (("left", "l"), ("right", "r")):
        sided = sided.join(known.select(F.col("g").alias(side), F.col("a").alias(name)), side)
    weakest = with_score(sided).groupBy("g").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c")).select("g", "c.*")
    longer = found.filter(size > 2).select("a", "g", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    parts = longer.select("a", F.explode(F.transform(F.sequence(F.lit(1), size - F.col("m") + 1), lambda i: F.slice("g", i, F.col("m")))).alias("g"))
    held = parts.groupBy("g").agg(F.max("a").alias("most"))
    kept = weakest.join(held, "g", "left").filter(F.col("most").isNull() | (100 * F.col("most") < inside * F.col("a"))).drop("most", "k")
    spelled = kept.select("*", F.posexplode("g").alias("at", "id")).join(words, "id")
    row = F.struct("score", "a", "l", "r", "n", "lang")
    made = spelled.groupBy("g").agg(F.any_value(row).alias("c"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    named = made.select("c.*", F.array_join(F.col("w.word"), " ").alias("phrase"))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    if top is not None:
        # a range by phrase at a time first, so that what meets in one task is bounded
        near = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
        named = named.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("near", near).filter(F.col("near") <= top).drop("salt", "near")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = 10, top: int = 2000, inside: int = 50) -> str:
    """DuckDB SQL of the query's rows, for phrases of two and three words."""
    return f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
ws AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
g1 AS (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(w) AS w FROM ws) GROUP BY lang, w),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM g1 GROUP BY lang),
g2 AS (SELECT lang, x[1] AS w1, x[2] AS w2, count(*) AS a FROM (SELECT lang, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: [w[i], w[i + 1]])) AS x FROM ws WHERE len(w) > 1) GROUP BY ALL HAVING count(*) >= {least}),
g3 AS (SELECT lang, x[1] AS w1, x[2] AS w2, x[3] AS w3, count(*) AS a FROM (SELECT lang, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: [w[i], w[i + 1], w[i + 2]])) AS x FROM ws WHERE len(w) > 2) GROUP BY ALL HAVING count(*) >= {least}),
cut AS (
  SELECT g2.lang, g2.w1 || ' ' || g2.w2 AS phrase, a, x.f AS l, y.f AS r, 1 AS k FROM g2 JOIN g1 x ON x.lang = g2.lang AND x.w = w1 JOIN g1 y ON y.lang = g2.lang AND y.w = w2
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.a, x.f, y.a, 1 FROM g3 t JOIN g1 x ON x.lang = t.lang AND x.w = t.w1 JOIN g2 y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.a, x.a, y.f, 2 FROM g3 t JOIN g2 x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN g1 y ON y.lang = t.lang AND y.w = t.w3),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cut),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, p, max(a) AS most FROM (SELECT lang, w1 || ' ' || w2 AS p, a FROM g3 UNION ALL SELECT lang, w2 || ' ' || w3, a FROM g3) GROUP BY lang, p),
kept AS (SELECT w.* FROM weakest w LEFT JOIN longer o ON o.lang = w.lang AND o.p = w.phrase WHERE o.most IS NULL OR 100 * o.most < {inside} * w.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN total USING (lang)
QUALIFY rank <= {top}
"""
