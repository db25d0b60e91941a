"""Quality classifier by co-training: a text-content view and a page-metadata view teach each other.

The content view sees the words of the whole text: word and word-pair n-grams hashed into bins, how much of the text
repeats itself (shares of different words and of different word triples, of the most frequent word), and shape features
(shares of character classes, word lengths, symbols at word ends). The metadata view sees source, language and recorded
size. Both are ridge logistic models fitted on a bounded
sample of labelled rows (``labelled_rows``, the smallest hashes of doc_id). In each round every document is scored by
both views, and the most confident unlabelled ones (calibrated probability of at least ``confident``, at most
``pseudo_rows`` for each view and class) are handed to the other view as pseudo-labels. At the end both views are
calibrated on held-out labelled rows and combined there by a small logistic model, which scores all documents.

What grows with the corpus stays distributed: features are one pass over the texts, scoring is arithmetic on them; only
the bounded samples and the models meet on the driver.

Defined results: a null or empty text has features of zero length; a document counts as labelled if its labels agree
(conflicting or null labels are ignored; of rows that repeat its id one teaches, and rows without an id teach nothing); with fewer than two labelled
documents of a class nothing can be learnt: a warning is given, and every document is kept with score 0.5;
repeated rows get equal scores; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.shared import Stored, plain, small_batches, text_buffer, text_slices
from papyra.llm.word_hashes import LOWER, Words, run_hashes

SHAPE, META, CLASSES = 16, 64, 10
#: Bins of hashed words and of hashed word pairs.
BINS = 128
#: Rows that a fit holds as doubles at a time.
STRIP = 1024
REPEAT = 3
#: Words that a text's bins are diluted by, so that those of a few words say little.
PRIOR = 1
CONTENT = SHAPE + REPEAT + 2 * BINS
FEATURES = "doc_id bigint, content array<float>, meta array<float>"


@dataclass(frozen=True)
class CoTrainingSetting:
    labelled_rows: int = 20_000
    pseudo_rows: int = 1_000
    confident: float = 0.97
    rounds: int = 2
    keep: float = 0.25  # a document goes if the odds are 3 to 1 that it is bad
    ridge: float = 0.1


def _byte_classes() -> np.ndarray:
    """Class of every byte: 0 other, 1 a-z, 2 A-Z, 3 0-9, 4 space, 5 line end, 6 plain stops, 7 bar or tab, 8 other ASCII signs, 9 beyond ASCII."""
    t = np.zeros(256, np.uint8)
    t[33:127] = 8
    t[ord("a") : ord("z") + 1], t[ord("A") : ord("Z") + 1], t[ord("0") : ord("9") + 1] = 1, 2, 3
    t[32], t[[10, 13]], t[[ord(c) for c in ".,'-"]], t[[9, ord("|")]], t[128:] = 4, 5, 6, 7, 9
    return t


BYTE_CLASSES = _byte_classes()


def content_features(texts: pa.Array) -> np.ndarray:
    """(rows, CONTENT) from whole texts; a fixed number of passes over the bytes, no Python step for each word."""
    raw, offsets = text_buffer(texts)
    return np.hstack([shape_features(raw, offsets), word_features(raw, offsets)])


def _different(doc: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document the number of different values and how often its most frequent one occurs."""
    if not len(doc):
        return np.zeros(n), np.zeros(n)
    # one sort of 64-bit numbers: the document in the upper bits, 40 bits of the hash below
    key = np.sort(doc.astype(np.uint64) << np.uint64(40) | values >> np.uint64(24))
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    owner = (key[begin] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, owner, np.diff(np.append(begin, len(key))))
    return np.bincount(owner, minlength=n).astype(float), most


def word_features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, REPEAT + 2 * BINS): shares of different words and word triples and of the most frequent word; then bins of
    hashed words and of hashed word pairs, square roots of their shares among the text's words and PRIOR more. Words are lower-cased (A-Z)."""
    words = Words(LOWER[raw], offsets)
    h, n = words.hashes(), len(offsets) - 1
    out = np.zeros((n, REPEAT + 2 * BINS), np.float32)
    some = np.maximum(words.count, 1)
    different, most = _different(words.doc, h, n)
    out[:, 0], out[:, 2] = different / some, most / some
    inside = lambda k: np.flatnonzero(words.doc[: max(0, len(h) - k + 1)] == words.doc[k - 1 :][: max(0, len(h) - k + 1)])
    at = inside(3)
    out[:, 1] = _different(words.doc[at], run_hashes(h, 3)[at], n)[0] / np.maximum(words.count - 2, 1)
    for k, first in ((1, REPEAT), (2, REPEAT + BINS)):
        at = inside(k)
        value = (h if k == 1 else run_hashes(h, k))[at]
        share = np.bincount(words.doc[at] * BINS + (value % np.uint64(BINS)).astype(np.int64), minlength=n * BINS).reshape(n, BINS) / (words.count + PRIOR)[:, None]
        out[:, first : first + BINS] = np.sqrt(share)
    return out


def shape_features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    kinds = BYTE_CLASSES[raw]
    size = np.diff(offsets)
    total = np.zeros((n, CLASSES))
    for k in range(CLASSES):
        total[:, k] = np.diff(np.concatenate([[0], np.cumsum(kinds == k)])[offsets])
    before = np.concatenate([[4], kinds[:-1]]) if len(kinds) else kinds
    if len(kinds):
        before[offsets[:-1][size > 0]] = 4
    blank = lambda k: (k == 4) | (k == 5)
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    words = count(blank(before) & ~blank(kinds))
    signs = count((before == 8) & (kinds == 8))
    capitals = count((before == 2) & (kinds == 2))
    signed = count((before == 8) & blank(kinds))
    some, many = np.maximum(size, 1)[:, None], np.maximum(words, 1)
    out = np.empty((n, SHAPE), np.float32)
    out[:, :CLASSES] = total / some
    out[:, 10], out[:, 11] = np.log1p(size) / 10, np.minimum((size - total[:, 4] - total[:, 5]) / many / 10, 5)
    out[:, 12], out[:, 13], out[:, 14], out[:, 15] = signs / some[:, 0], capitals / some[:, 0], signed / many, total[:, 7] / many
    return out


def meta_features(batch: pa.RecordBatch) -> np.ndarray:
    """(rows, META): source and language by hash, recorded size in steps of powers of two."""
    out = np.zeros((batch.num_rows, META), np.float32)
    for column, at, width in (("source", 0, 32), ("lang", 32, 16)):
        coded = batch.column(column).dictionary_encode()
        slots = np.asarray([zlib.crc32(str(v).encode()) % width for v in coded.dictionary.to_pylist()] + [zlib.crc32(b"\0null") % width])
        out[np.arange(len(out)), at + slots[np.asarray(pc.fill_null(coded.indices, len(coded.dictionary)))]] = 1
    steps = np.log2(1 + np.maximum(0, np.asarray(pc.fill_null(batch.column("n_chars").cast(pa.float64()), 0.0))))
    out[np.arange(len(out)), 48 + np.minimum(15, steps).astype(int)] = 1
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Logistic:
    """Ridge logistic regression by Newton steps, features scaled by their own deviations."""

    w: np.ndarray = field(default_factory=lambda: np.zeros(1))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))

    def _in(self, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Scaled rows with a constant, a strip at a time."""
        for at in range(0, len(x), STRIP):
            cut = slice(at, at + STRIP)
            yield cut, np.hstack([(x[cut] - self.mean) / self.scale, np.ones((len(x[cut]), 1))])

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float) -> Logistic:
        self.mean = x.mean(0, dtype=np.float64)
        self.scale = np.sqrt(sum(((x[at : at + STRIP] - self.mean) ** 2).sum(0) for at in range(0, len(x), STRIP)) / len(x)) + 1e-6
        self.w = np.zeros(x.shape[1] + 1)
        for _ in range(25):
            grad = ridge * len(y) * np.append(self.w[:-1], 0)
            hess = ridge * len(y) * np.eye(len(self.w)) * np.append(np.ones(len(self.w) - 1), 1e-6)
            for cut, a in self._in(x):
                p = sigmoid(a @ self.w)
                grad += a.T @ (p - y[cut])
                hess += (a * (p * (1 - p) + 1e-9)[:, None]).T @ a
            step = np.linalg.solve(hess, grad)
            self.w = self.w - step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for cut, a in self._in(x):
            out[cut] = a @ self.w
        return out


@dataclass
class Views:
    """Both views, their calibrations (slope and shift of the logit), and the weights that combine them."""

    content: Logistic
    meta: Logistic
    calibrations: tuple[Logistic, Logistic]
    combined: Logistic

    def calibrated(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        logits = (self.content.logit(content), self.meta.logit(meta))
        return tuple(c.logit(z[:, None]) for c, z in zip(self.calibrations, logits))

    def score(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.calibrated(content, meta)
        return sigmoid(a), sigmoid(b), sigmoid(self.combined.logit(np.stack([a, b], axis=1)))


def fit_views(content: np.ndarray, meta: np.ndarray, y: np.ndarray, held: np.ndarray, more: list[tuple[np.ndarray, np.ndarray]], ridge: float) -> Views:
    """``held``: rows for calibration and combination. ``more``: pseudo-labelled rows of each view."""
    models = []
    for x, (px, py) in zip((content, meta), more):
        fx, fy = np.concatenate([x[~held], px]), np.concatenate([y[~held], py])
        models.append(Logistic().fit(fx, fy, ridge))
    logits = [m.logit(x[held]) for m, x in zip(models, (content, meta))]
    calibrations = tuple(Logistic().fit(z[:, None], y[held], 1e-3) for z in logits)
    both = np.stack([c.logit(z[:, None]) for c, z in zip(calibrations, logits)], axis=1)
    return Views(models[0], models[1], calibrations, Logistic().fit(both, y[held], 1e-3))


FEATURE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("content", pa.list_(pa.float32())), ("meta", pa.list_(pa.float32()))])


def _rows(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cut in text_slices(batch):
            yield pa.RecordBatch.from_arrays([cut.column("doc_id"), _rows(content_features(cut.column("text"))), _rows(meta_features(cut))], schema=FEATURE_SCHEMA)


def document_features(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return plain(docs, ("doc_id", "text", "lang", "source", "n_chars")).mapInArrow(_features, FEATURES)


SCORES = "doc_id bigint, content_score double, meta_score double, score double"


def _score(views: Views | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if views is None or not b.num_rows:
                scores = [np.full(b.num_rows, 0.5)] * 3
            else:
                scores = views.score(_matrix(b.column("content"), CONTENT), _matrix(b.column("meta"), META))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, scores)], names=["doc_id", "content_score", "meta_score", "score"])

    return run


def _collected(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and labels of a bounded number of rows."""
    t = df.orderBy("doc_id").toArrow().combine_chunks()
    if not t.num_rows:
        return np.zeros((0, CONTENT), np.float32), np.zeros((0, META), np.float32), np.zeros(0)
    batch = t.to_batches()[0]
    return _matrix(batch.column("content"), CONTENT), _matrix(batch.column("meta"), META), np.asarray(batch.column("y")).astype(float)


def train(features: DataFrame, labels: DataFrame, setting: CoTrainingSetting = CoTrainingSetting(), label: str = "quality") -> Views | None:
    """Co-trained views, fitted with what labels there are; None, with a warning, if fewer than two of a class have documents (one to fit, one to calibrate).

    ``features`` is read twice for each round.
    """
    agreed = plain(labels, ("doc_id", label)).where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
    agreed = agreed.agg(F.min(label).alias("y"), F.max(label).alias("top")).where("y = top").select("doc_id", "y")
    # labelled rows without a document can't teach, so the sample is taken after the join; one row for each id
    first = features.join(agreed, "doc_id").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(setting.labelled_rows)
    sample = Stored(first, "labelled")
    content, meta, y = _collected(sample.read())
    y = (y > 0).astype(float)
    if not 2 <= y.sum() <= len(y) - 2:
        warnings.warn("fewer than two labelled documents of a class: nothing is learnt, and all documents score 0.5", stacklevel=2)
        return None
    held = np.zeros(len(y), bool)
    for c in (0, 1):  # a third of each class, spread over the sample
        held[np.flatnonzero(y == c)[::3]] = True
    none = lambda width: (np.zeros((0, width), np.float32), np.zeros(0))
    views = fit_views(content, meta, y, held, [none(CONTENT), none(META)], setting.ridge)
    others = features.join(F.broadcast(sample.read().select("doc_id")), "doc_id", "left_anti")  # labelled_rows ids at most
    for _ in range(setting.rounds):
        # one pass scores all; the lists are picked from the scores, and the features of the few picked are fetched
        scores = Stored(others.where("doc_id is not null").mapInArrow(_score(views), SCORES).drop("score"), "scores")
        picked = []
        for place, (teacher, good) in enumerate((t, g) for t in ("meta_score", "content_score") for g in (True, False)):
            sure = F.col(teacher) >= setting.confident if good else F.col(teacher) <= 1 - setting.confident
            ordered = scores.read().where(sure).orderBy(F.desc(teacher) if good else F.asc(teacher), F.xxhash64("doc_id"), "doc_id")
            picked.append(ordered.limit(setting.pseudo_rows).select("doc_id", F.lit(place).alias("list")))
        picks = Stored(reduce(DataFrame.union, picked).distinct(), "picked")
        taken = Stored(features.join(F.broadcast(picks.read()), "doc_id").dropDuplicates(["doc_id", "list"]), "pseudo")  # 4 * pseudo_rows ids at most
        more = []
        for taught in (0, 1):
            rows = _collected(taken.read().where(F.col("list").isin(2 * taught, 2 * taught + 1)).withColumn("y", F.when(F.col("list") % 2 == 0, 1).otherwise(0)))
            more.append((rows[taught], rows[2]))
        for table in (scores, picks, taken):
            table.drop()
        views = fit_views(content, meta, y, held, more, setting.ridge)
    sample.drop()
    return views


def score_documents(docs: DataFrame, labels: DataFrame, setting: CoTrainingSetting = CoTrainingSetting(), label: str = "quality") -> DataFrame:
    """doc_id, content_score, meta_score, score and keep of every row of ``docs``."""
    features = Stored(document_features(docs), "features")
    views = train(features.read(), labels, setting, label)
    scored = features.read().mapInArrow(_score(views), SCORES)
    return scored.withColumn("keep", F.col("score") >= setting.keep)


def _kept(views: Views | None, keep: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in text_slices(batch):
                if views is not None:
                    cut = cut.filter(pa.array(views.score(content_features(cut.column("text")), meta_features(cut))[2] >= keep))
                yield cut

    return run


def keep_good(docs: DataFrame, labels: DataFrame, setting: CoTrainingSetting = CoTrainingSetting(), label: str = "quality") -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source, n_chars) that the combined classifier keeps; texts are not shuffled."""
    features = Stored(document_features(docs), "features")
    views = train(features.read(), labels, setting, label)
    features.drop()
    names = ("doc_id", "text", "lang", "source", "n_chars")
    return plain(docs, names).mapInArrow(_kept(views, setting.keep), plain(docs, names).schema)
