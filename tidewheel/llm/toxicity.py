"""Toxicity by multiple-instance learning: sentences score, noisy-or combines, document labels teach.

A sentence's logit is a bias plus the weights of its features, lower-cased words and their byte prefixes. A
document is toxic with probability 1 - prod(1 - p_sentence). Weights minimise the weighted log loss of the
document labels; the sentence scores come out of it and locate what offends.

Fitting uses a bounded sample of labelled rows (``max_per_class`` of each class, chosen by hash of the id);
sample, feature counts and screening by odds run on the executors, and only features that pass the screening,
those with the best odds up to ``max_features``, reach the driver. Scoring needs no shuffle.

Null and empty texts hold no sentence and get the score of one sentence without features. Labels that are
null are ignored, as are labels without a document; a document labelled twice counts twice, repeated rows score
alike. Features of equal odds are taken in the order of their counts and hashes. Without labelled documents of both
kinds all texts get the prior's score. A text is held whole, however long; an empty table gives an empty one. Input columns named
``score`` or ``offending`` are replaced, others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._text import ALNUM, byte_table, prefix_sums, released, slices, small_batches, span_hash
from tidewheel.operators.components import checkpointed

_TABLE = byte_table(31, lower=True)
#: Accented capitals of Latin-1 count as their small letters: continuation bytes 80-9E as A0-BE.
_TABLE[0x80:0x9F] = _TABLE[0xA0:0xBF]
PREFIXES = (4, 5, 6, 7, 8)
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".!?\n")] = True
#: Hash bits of the filter that most features without a weight fail.
FILTER_BITS = 20


@dataclass
class Model:
    """Sorted feature hashes with their weights, and the bias of every sentence."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.mask = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.mask[(self.features >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` that have a weight, and which."""
        maybe = np.flatnonzero(self.mask[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(maybe) or not len(self.features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.features, hashes[maybe]), len(self.features) - 1)
        hit = self.features[at] == hashes[maybe]
        return maybe[hit], at[hit]


def _features(s):
    """Words of a slice and, for the whole word and each prefix, (word numbers, hashes)."""
    start, end, first = s.words(ALNUM)
    sums = prefix_sums(s.buf, _TABLE)
    found = [(np.arange(len(start)), span_hash(sums, start, end))]
    for n in PREFIXES:
        long = np.flatnonzero(end - start >= n)
        with np.errstate(over="ignore"):
            found.append((long, span_hash(sums, start[long], start[long] + n) + np.uint64(n)))
    return start, first, found


def _sentences(s, start: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document and sentence number of each word, and sentence counts; only sentences with a word count."""
    ends = np.cumsum(_ENDS[s.buf])
    doc = np.repeat(np.arange(s.n), np.diff(first))
    raw = ends[start] if len(start) else np.zeros(0, np.int64)
    new = np.append(True, (raw[1:] != raw[:-1]) | (doc[1:] != doc[:-1])) if len(start) else np.zeros(0, bool)
    sentence = np.cumsum(new) - 1
    opens = np.flatnonzero(new)
    return doc, sentence, opens, np.bincount(doc[opens], minlength=s.n)


def fold(id_column: str):
    """``crc32(id as text) mod 3``; rows where this is 1 are held out."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 3


def _count(sample: DataFrame, label: int) -> DataFrame:
    """Documents of one label with each feature."""

    def run(batches):
        for s in slices(batches, "text"):
            start, first, found = _features(s)
            doc = np.repeat(np.arange(s.n), np.diff(first))
            pairs = [np.stack([doc[word].astype(np.uint64), h]) for word, h in found]
            pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
            h, n = np.unique(pairs[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return sample.filter(F.col("label") == label).select("text").mapInArrow(released(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    max_per_class: int = 3000,
    max_features: int = 20_000,
    least_documents: int = 4,
    least_odds: float = 4.0,
    rounds: int = 300,
    l2: float = 0.05,
) -> Model:
    """Learn from the rows of ``labels``, which the caller has restricted to those that may be learned from.

    At most ``max_per_class`` labelled rows of each class are used, those with the smallest hash of the id;
    classes are weighted back to their shares among all labelled rows.
    """
    small_batches(docs)
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).filter("label in (0, 1) and id is not null")
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picks = [known.filter(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(max_per_class) for y in (0, 1)]
    picked = picks[0].unionByName(picks[1])
    text = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    sample = checkpointed(text.join(F.broadcast(picked), "id").select("text", "label"))  # at most 2 * max_per_class ids
    used = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not used.get(1) or not used.get(0):
        share = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))

    seen = _count(sample, 1).filter(F.col("n") >= least_documents).withColumnRenamed("n", "pos")
    both = seen.join(_count(sample, 0).withColumnRenamed("n", "neg"), "h", "left").fillna(0, ["neg"])
    odds = ((F.col("pos") + 0.5) / (used.get(1, 0) + 1)) / ((F.col("neg") + 0.5) / (used.get(0, 0) + 1))
    kept = both.withColumn("odds", odds).filter(F.col("odds") >= least_odds).orderBy(F.desc("odds"), F.desc("pos"), "h").limit(max_features)
    hashes = np.sort(np.array([r["h"] for r in kept.select("h").collect()], np.int64).view(np.uint64))
    chosen = Model(hashes, np.zeros(len(hashes)), 0.0)

    def instances(batches):
        for s in slices(batches, "text"):
            start, first, found = _features(s)
            doc, sentence, opens, count = _sentences(s, start, first)
            cells = []
            for word, h in found:
                hit, at = chosen.find(h)
                cells.append(np.stack([sentence[word[hit]], at]))
            cells = np.unique(np.concatenate(cells, axis=1), axis=1)
            owner = doc[opens[cells[0]]] if cells.shape[1] else np.zeros(0, np.int64)
            label = s.rows.column(1).to_pylist()
            for i in range(s.n):
                mine = owner == i
                yield pa.RecordBatch.from_pylist(
                    [{"label": label[i], "sentences": int(count[i]), "sentence": cells[0, mine].tolist(), "feature": cells[1, mine].tolist()}],
                    schema=kinds,
                )

    kinds = pa.schema([("label", pa.int32()), ("sentences", pa.int64()), ("sentence", pa.list_(pa.int64())), ("feature", pa.list_(pa.int64()))])
    table = sample.mapInArrow(released(instances), "label int, sentences long, sentence array<long>, feature array<long>").collect()
    return _train(table, chosen.features, totals, rounds, l2)


def _train(table: list, features: np.ndarray, totals: dict, rounds: int, l2: float) -> Model:
    """Full-batch Adam on the noisy-or log loss; sentences without features share one term per document."""
    y = np.array([r["label"] for r in table], float)
    plain, cell_s, cell_f, sent_doc = [], [], [], []
    for d, r in enumerate(table):
        new, inverse = np.unique(np.array(r["sentence"], np.int64), return_inverse=True)
        cell_s.append(inverse + len(sent_doc))
        cell_f.append(np.array(r["feature"], np.int64))
        sent_doc += [d] * len(new)
        plain.append(max(1, r["sentences"]) - len(new))
    cell_s, cell_f = np.concatenate(cell_s).astype(np.int64), np.concatenate(cell_f).astype(np.int64)
    sent_doc, plain = np.array(sent_doc, np.int64), np.array(plain, float)
    share = np.array([totals[0], totals[1]], float) / max(1, totals[0] + totals[1])
    used = np.array([(y == 0).sum(), (y == 1).sum()], float)
    weight = np.where(y == 1, share[1] / used[1], share[0] / used[0])
    theta = np.zeros(len(features) + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        w, b = theta[:-1], theta[-1]
        z = b + np.bincount(cell_s, weights=w[cell_f], minlength=len(sent_doc))
        soft = np.logaddexp(0, z)
        silent = np.bincount(sent_doc, weights=soft, minlength=len(y)) + plain * np.logaddexp(0, b)
        p = -np.expm1(-silent)
        pull = np.where(y == 1, -np.exp(-silent) / np.maximum(p, 1e-9), 1.0) * weight  # dLoss / d(silent)
        dz = pull[sent_doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(cell_f, weights=dz[cell_s], minlength=len(features)), dz.sum() + (pull * plain).sum() / (1 + np.exp(-b)))
        grad[:-1] += l2 * w / max(1, len(y)) * 0.1
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    kept = np.abs(theta[:-1]) > 1e-3
    return Model(features[kept], theta[:-1][kept], float(theta[-1]))


def score(docs: DataFrame, model: Model, text_column: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` and ``offending``: byte spans of sentences that score ``least`` or more."""
    small_batches(docs)
    columns = [c for c in docs.columns if c not in ("score", "offending")]
    at = columns.index(text_column)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        base = np.logaddexp(0, model.bias)
        for s in slices(batches, columns[at]):
            start, first, found = _features(s)
            doc, sentence, opens, count = _sentences(s, start, first)
            cells = []
            for word, h in found:
                hit, which = model.find(h)
                cells.append(np.stack([sentence[word[hit]], which]))
            cells = np.unique(np.concatenate(cells, axis=1), axis=1)
            busy, inverse = np.unique(cells[0], return_inverse=True)
            z = model.bias + np.bincount(inverse, weights=model.weights[cells[1]], minlength=len(busy))
            owner = doc[opens[busy]] if len(busy) else np.zeros(0, np.int64)
            silent = np.maximum(count, 1) * base + np.bincount(owner, weights=np.logaddexp(0, z) - base, minlength=s.n)
            p = 1 / (1 + np.exp(-z))
            offending: list[list] = [[] for _ in range(s.n)]
            stops = np.flatnonzero(_ENDS[s.buf])
            for k in np.flatnonzero(p >= least):
                d, begin = owner[k], start[opens[busy[k]]]
                stop = np.searchsorted(stops, begin)
                end = min(int(stops[stop]) + 1 if stop < len(stops) else len(s.buf), int(s.offsets[d + 1]))
                offending[d].append({"start": int(begin - s.offsets[d]), "end": int(end - s.offsets[d]), "score": float(p[k])})
            yield pa.RecordBatch.from_arrays(
                [*s.rows.columns, pa.array(np.clip(-np.expm1(-silent), 0.0, 1.0)), pa.array(offending, span)], [*columns, "score", "offending"]
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns)
    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(released(run), f"{kinds}, score double, offending array<struct<start:int,end:int,score:double>>")
