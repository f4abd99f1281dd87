"""Exact top-k search with BM25: an inverted index per shard, block-max dynamic pruning, exact merging.

Global statistics (documents, mean length, document frequencies of the queried words) come from one pass over
all documents. Each task is a shard: it inverts its documents in pieces, orders a piece's documents by their most
frequent common word, then by length, and cuts them into blocks, so that a block's words are mostly those of one language. A block's maxima of every word's term weight bound all its scores; a query
without k documents yet has the block with its best bound scored first, and then only blocks whose bound reaches the query's k-th best
score so far are scored, as in block-max WAND. Bounds and scores of the commonest words are dense products, a few blocks at once, those of
the others come from postings, a few thousand at once. Where documents are many, a search of a few of them comes first: a query's k-th best there is
at most its k-th best of all, so that no shard starts from nothing and none tells what cannot be among the k. What may enter a top-k is scored again in double precision, words in a fixed
order, so that results do not depend on how documents were dealt. Shards' top-k lists merge by score and id.

A query is a whole text: its distinct words weigh idf * (k3 + 1) * qtf / (k3 + qtf). Queries are taken in
blocks of about ``block_terms`` words and ``block_queries`` queries, one pass over the documents each, and only a
block's words are broadcast, so a worker's memory is bounded whether queries are long or many. Null and empty texts have no words: as queries they find nothing, as documents they are never found.
Only documents that share a word with a query score. Rows with a null id are neither asked nor found; repeated rows are
found each; an id that is asked twice is asked once, with the least of its texts. Ties are broken by the smaller id. Empty tables give no
answers; other columns, whatever their names, are not looked at. Ids must be integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm._text import ALNUM, byte_table, from_binary, integer_ids, prefix_sums, released, slices, small_batches, span_hash
from tidewheel.operators.components import checkpointed

_TABLE = byte_table(53, lower=True)
K1, B, K3 = 1.2, 0.75, 7.0
BLOCK_DOCS = 32
#: Words with dense columns, and bytes of text that one piece of a shard's index holds.
DENSE, PIECE_BYTES = 1024, 6 << 20
#: Blocks that one product scores, and pairs of postings that are added up at once.
TILE_BLOCKS, PAIRS = 8, 1 << 15
#: About how many documents are searched first for a floor of the scores, and the documents from which that pays.
FIRST_DOCS, FIRST_FROM = 16_384, 131_072


def _bag(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).filter("id is not null")


def _words(s) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = s.words(ALNUM)
    return span_hash(prefix_sums(s.buf, _TABLE), start, end), first


def query_terms(queries: DataFrame) -> DataFrame:
    """``(id, terms, counts, n)``: distinct word hashes of each query, packed."""

    def run(batches):
        for s in slices(batches, "text"):
            words, first = _words(s)
            terms, counts, n = [], [], []
            for i in range(s.n):
                t, c = np.unique(words[first[i] : first[i + 1]], return_counts=True)
                terms.append(t.tobytes()), counts.append(c.astype(np.uint32).tobytes()), n.append(len(t))
            yield pa.RecordBatch.from_arrays([s.rows.column(0), pa.array(terms, pa.binary()), pa.array(counts, pa.binary()), pa.array(n, pa.int64())], ["id", "terms", "counts", "n"])

    return queries.mapInArrow(released(run), "id long, terms binary, counts binary, n long")


class Vocabulary:
    """Word hashes of a block of queries, sorted; place of each of many hashes or -1."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        bits = min(22, max(10, len(terms).bit_length() + 1))
        self.shift = np.uint64(64 - bits)
        #: first place of the terms that begin with each value of so many bits
        self.first = np.searchsorted((terms >> self.shift).astype(np.int64), np.arange((1 << bits) + 1)).astype(np.int32)

    def find(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), -1, np.int64)
        head = (words >> self.shift).astype(np.int64)
        at, end = self.first[head], self.first[head + 1]
        some = np.flatnonzero(at < end)
        at, end = at[some], end[some]
        while len(some):
            hit = self.terms[at] == words[some]
            out[some[hit]] = at[hit]
            more = np.flatnonzero(~hit & (at + 1 < end))
            some, at, end = some[more], at[more] + 1, end[more]
        return out


def _cells(s, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents, word numbers and counts of a slice's known words, and all documents' lengths."""
    words, first = _words(s)
    length = np.diff(first)
    at = vocabulary.find(words)
    known = at >= 0
    doc = np.repeat(np.arange(s.n), length)[known]
    cell, count = np.unique(doc * max(1, len(vocabulary.terms)) + at[known], return_counts=True)
    return cell // max(1, len(vocabulary.terms)), cell % max(1, len(vocabulary.terms)), count, length


def statistics(docs: DataFrame, terms: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Documents, words, and document frequencies of ``terms``, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        vocabulary = Vocabulary(shared.value)
        total, n, words = np.zeros(len(shared.value), np.int64), 0, 0
        for s in slices(batches, "text"):
            _, term, _, length = _cells(s, vocabulary)
            total += np.bincount(term, minlength=len(total))
            n, words = n + s.n, words + int(length.sum())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(total[some], [n, words]))], ["t", "n"])

    got = docs.select("text").mapInArrow(released(run), "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    t, n = got.column(0).to_numpy(), got.column(1).to_numpy()
    frequency = np.zeros(len(terms), np.int64)
    frequency[t[t >= 0]] = n[t >= 0]
    return int(n[t == -1].sum()), int(n[t == -2].sum()), frequency


class Queries:
    """A block of queries as weights by word: dense for the commonest words, postings for the others."""

    def __init__(self, ids, terms, weights, vocabulary_size: int, frequency: np.ndarray):
        self.ids, self.terms, self.weights = np.asarray(ids), terms, weights
        common = np.argsort(-frequency, kind="stable")[:DENSE]
        self.column = np.full(vocabulary_size, -1, np.int64)
        self.column[common] = np.arange(len(common))
        #: a row a common word, so that the words of a block are picked out as whole rows
        self.dense = np.zeros((len(common), len(ids)), np.float32)
        owner = np.repeat(np.arange(len(ids)), [len(t) for t in terms])
        term, weight = np.concatenate(terms), np.concatenate(weights)
        rare = self.column[term] < 0
        self.dense[self.column[term[~rare]], owner[~rare]] = weight[~rare]
        #: weights of one query by word, all zero between calls of ``exact``
        self.by_word = np.zeros(vocabulary_size)
        order = np.argsort(term[rare], kind="stable")
        self.rare_owner, self.rare_weight = owner[rare][order].astype(np.int32), weight[rare][order].astype(np.float32)
        self.rare_ptr = np.searchsorted(term[rare][order], np.arange(vocabulary_size + 1))

    def add_rare(self, out: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """Add the products of cells with rare words, ordered by row, to a row of ``out`` for every query that has the word.

        A few thousand pairs are made at once, so that they stay in the processor's cache.
        """
        asked, n = len(self.ids), self.rare_ptr[term + 1] - self.rare_ptr[term]
        some = np.flatnonzero(n)
        if not len(some):
            return
        row, weight, lo, n = row[some], weight[some], self.rare_ptr[term[some]], n[some]
        end = np.cumsum(n)
        cuts = np.unique(np.append(np.searchsorted(end, np.arange(0, end[-1], PAIRS)), len(n)))
        number = np.arange(PAIRS + n.max())
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            many = n[a:z]
            start = end[a:z] - many
            take = np.repeat(lo[a:z] - start + start[0], many)
            take += number[: len(take)]
            first, last = row[a], row[z - 1] + 1
            flat = np.repeat((row[a:z] - first) * asked, many)
            flat += self.rare_owner[take]
            part = np.repeat(weight[a:z], many)
            part *= self.rare_weight[take]
            out[first:last] += np.bincount(flat, weights=part, minlength=(last - first) * asked).reshape(-1, asked)


class TopK:
    """The k best (score, id) of each query, ties to the smaller id. ``floor``: scores that a query's k-th best of all documents is known to reach."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k, self.floor = k, np.full(queries, -np.inf) if floor is None else floor
        self.score, self.id = np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def threshold(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.append(self.score[q], score), np.append(self.id[q], ids)
        best = np.lexsort((i, -s))[: self.k]
        self.score[q], self.id[q] = s[best], i[best]


class PieceIndex:
    """Inverted index of some documents, in blocks of documents of like words and length. Cells come in order of document, then word."""

    def __init__(self, ids, doc, term, tf, length, mean: float, queries: Queries):
        order = self._alike(len(ids), doc, term, tf, length, queries)
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
        given = np.searchsorted(doc, np.arange(len(ids) + 1))
        many = np.diff(given)[order]
        self.ids, self.ptr = ids[order], np.append(0, np.cumsum(many))
        # a document's cells move as a whole
        moved = np.repeat(given[order] - self.ptr[:-1], many) + np.arange(len(doc))
        self.doc, self.term, self.weight = np.repeat(np.arange(len(ids)), many), term[moved], weight[moved]
        column = queries.column[self.term]
        common = column >= 0
        blocks = self.blocks = -(-len(ids) // BLOCK_DOCS)
        self.dense = np.zeros((blocks * BLOCK_DOCS, len(queries.dense)), np.float32)
        self.dense[self.doc[common], column[common]] = self.weight[common]
        self.block_max = self.dense.reshape(blocks, BLOCK_DOCS, -1).max(axis=1)
        rare = ~common
        self.rare_doc, self.rare_term, self.rare_weight = self.doc[rare], self.term[rare], self.weight[rare].astype(np.float32)
        self.rare_ptr = np.searchsorted(self.rare_doc, np.arange(blocks + 1) * BLOCK_DOCS)

    @staticmethod
    def _alike(n: int, doc, term, tf, length, queries: Queries) -> np.ndarray:
        """Documents in the order of their most frequent common word, then of length, so that a block's documents are mostly of one language."""
        column = queries.column[term]
        common = np.flatnonzero(column >= 0)
        columns = len(queries.dense)
        top = np.full(n, columns)
        if len(common):
            of = doc[common]
            head = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            most = np.maximum.reduceat(tf[common] * columns + (columns - 1 - column[common]), head)
            top[of[head]] = columns - 1 - most % columns
        return np.lexsort((length, top))

    def bounds(self, queries: Queries) -> np.ndarray:
        """Upper bounds of the scores in each block for each query."""
        out = self.block_max @ queries.dense
        block = self.rare_doc // BLOCK_DOCS
        order = np.lexsort((self.rare_term, block))
        b, t, w = block[order], self.rare_term[order], self.rare_weight[order]
        if len(b):
            head = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (t[1:] != t[:-1])))
            queries.add_rare(out, b[head], t[head], np.maximum.reduceat(w, head))
        return out

    def scores(self, first: int, last: int, who: np.ndarray, queries: Queries) -> np.ndarray:
        """Single-precision scores of the documents of blocks ``first`` to ``last - 1`` for the queries ``who``."""
        at = slice(first * BLOCK_DOCS, min(last * BLOCK_DOCS, len(self.ids)))
        some = np.flatnonzero(self.block_max[first:last].any(axis=0))
        everyone = len(who) == len(queries.ids)
        weights = queries.dense[some] if everyone else queries.dense[np.ix_(some, who)]
        out = self.dense[at, some] @ weights
        a, z = self.rare_ptr[first], self.rare_ptr[last]
        if z > a:
            rare = out if everyone else np.zeros((len(out), len(queries.ids)), np.float32)
            queries.add_rare(rare, self.rare_doc[a:z] - at.start, self.rare_term[a:z], self.rare_weight[a:z])
            if not everyone:
                out += rare[:, who]
        return out

    def exact(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray, by_word: np.ndarray) -> np.ndarray:
        """Double-precision scores of some documents for one query, words in order of their number. ``by_word``: zeros, left as zeros."""
        n = self.ptr[docs + 1] - self.ptr[docs]
        take = np.repeat(self.ptr[docs] - np.cumsum(n) + n, n) + np.arange(n.sum())
        by_word[terms] = weights
        part = by_word[self.term[take]] * self.weight[take]
        by_word[terms] = 0.0
        # added one after another, so a score does not depend on what else is scored
        return np.bincount(np.repeat(np.arange(len(docs)), n), weights=part, minlength=len(docs))

    def search(self, queries: Queries, best: TopK) -> None:
        bound = self.bounds(queries)
        slack = 1e-4
        floor = best.threshold().astype(np.float32)
        rest = bound >= np.maximum(floor * (1 - slack), 1e-9)
        pool: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        new = np.flatnonzero(np.isneginf(floor))
        first = bound[:, new].argmax(axis=0)
        for b in np.unique(first):
            who = new[first == b]
            self._score(b, b + 1, who, queries, floor, slack, pool, best.k)
            rest[b, who] = False
        tiles = range(0, self.blocks, TILE_BLOCKS)
        for a in sorted(tiles, key=lambda a: -bound[a : a + TILE_BLOCKS].max()):
            z = min(a + TILE_BLOCKS, self.blocks)
            who = np.flatnonzero((rest[a:z] & (bound[a:z] >= floor * (1 - slack))).any(axis=0))
            if 2 * len(who) > len(floor):
                # most queries are asked: scoring all costs less than picking their weights out
                who = np.arange(len(floor))
            if len(who):
                self._score(a, z, who, queries, floor, slack, pool, best.k)
        if not pool:
            return
        q, doc, approximate = (np.concatenate(x) for x in zip(*pool, strict=True))
        keep = np.flatnonzero(approximate >= floor[q] * (1 - slack))
        # a query's best block is scored again with its neighbours: each document counts once
        keep = keep[np.unique(q[keep] * len(self.ids) + doc[keep], return_index=True)[1]]
        q, doc, approximate = q[keep], doc[keep], approximate[keep]
        for part in np.split(np.arange(len(q)), np.flatnonzero(np.diff(q)) + 1):
            if len(part):
                # only what is near the k-th best of all that was found so far is worth scoring exactly
                who = q[part[0]]
                seen = np.concatenate([best.score[who], approximate[part]])
                part = part[approximate[part] >= np.partition(seen, len(seen) - best.k)[len(seen) - best.k] * (1 - slack)]
            if len(part):
                best.add(who, self.exact(doc[part], queries.terms[who], queries.weights[who], queries.by_word), self.ids[doc[part]])

    def _score(self, first: int, last: int, who: np.ndarray, queries: Queries, floor: np.ndarray, slack: float, pool: list, k: int) -> None:
        """Score blocks, pool what may enter, and raise the floor to the k-th best of the blocks where that is higher."""
        got = self.scores(first, last, who, queries)
        may = (got >= floor[who] * (1 - slack)) & (got > 0)
        many = np.flatnonzero(may.sum(axis=0) > k)
        if len(many):
            kth = np.partition(got[:, many], len(got) - k, axis=0)[len(got) - k]
            floor[who[many]] = np.maximum(floor[who[many]], kth * (1 - slack))
            may[:, many] &= got[:, many] >= floor[who[many]] * (1 - slack)
        d, j = np.divmod(np.flatnonzero(may.ravel()), len(who))
        pool.append((who[j], d + first * BLOCK_DOCS, got[d, j]))


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary):
    held, size, n = [], 0, 0

    def joined():
        ids, doc, term, tf, length = (np.concatenate(x) for x in zip(*held, strict=True))
        return ids, doc, term, tf, length

    for s in slices(batches, "text"):
        doc, term, tf, length = _cells(s, vocabulary)
        held.append((s.rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64), doc + n, term, tf, length))
        size, n = size + len(s.buf), n + s.n
        if size >= PIECE_BYTES:
            yield joined()
            held, size, n = [], 0, 0
    if held:
        yield joined()


def search(
    docs: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "doc_id", text_column: str = "text", block_terms: int = 2_000_000, block_queries: int = 8192
) -> DataFrame:
    """``(query_id, rank, doc_id, score)``: for each row of ``queries`` its k best rows of ``docs``."""
    integer_ids(docs, id_column)
    small_batches(docs)
    bags = _bag(docs, id_column, text_column)
    once = _bag(queries, id_column, text_column).groupBy("id").agg(F.min("text").alias("text"))
    asked = checkpointed(query_terms(once).filter("n > 0"))
    size = asked.agg(F.sum("n").alias("n"), F.count("*").alias("queries")).first()
    parts = max(1, -(-(size["n"] or 0) // block_terms), -(-size["queries"] // block_queries))
    out = None
    for part in range(parts):
        block = asked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).orderBy("id").toArrow()
        if block.num_rows:
            found = _search_block(bags, block, k)
            found = found if parts == 1 else checkpointed(found)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    return out


def _search_block(bags: DataFrame, block: pa.Table, k: int) -> DataFrame:
    ids = block.column("id").to_numpy()
    terms = from_binary(block.column("terms").combine_chunks(), np.uint64)
    counts = from_binary(block.column("counts").combine_chunks(), np.uint32)
    vocabulary = np.unique(np.concatenate(terms))
    documents, words, frequency = statistics(bags, vocabulary)
    idf = np.log1p((documents - frequency + 0.5) / (frequency + 0.5))
    numbers = [np.searchsorted(vocabulary, t) for t in terms]
    weights = [idf[t] * (K3 + 1) * c / (K3 + c) for t, c in zip(numbers, counts, strict=True)]
    mean = max(1.0, words / max(1, documents))
    context = bags.sparkSession.sparkContext
    shared = context.broadcast((vocabulary, ids, numbers, weights, frequency))

    def found_in(some: DataFrame, floor: np.ndarray | None) -> DataFrame:
        def run(batches):
            vocabulary, ids, numbers, weights, frequency = shared.value
            known = Vocabulary(vocabulary)
            asked = Queries(ids, numbers, weights, len(vocabulary), frequency)
            best = TopK(len(ids), k, floor)
            for piece in _pieces(batches, known):
                PieceIndex(*piece, mean, asked).search(asked, best)
            q, j = np.nonzero(np.isfinite(best.score))
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best.id[q, j]), pa.array(best.score[q, j])], ["query_id", "doc_id", "score"])

        found = some.mapInArrow(released(run), "query_id long, doc_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")

    floor = None
    if documents >= FIRST_FROM:
        few = bags.filter(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(documents // FIRST_DOCS)) == 0).repartition(min(context.defaultParallelism, 8))
        kth = found_in(few, None).filter(F.col("rank") == k).select("query_id", "score").toArrow()  # a row a query of the block
        floor = np.full(len(ids), -np.inf)
        floor[np.searchsorted(ids, kth.column(0).to_numpy())] = kth.column(1).to_numpy()
    return found_in(bags, floor)
