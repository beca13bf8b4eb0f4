"""Toxicity: counterfactual-regularised classifier.

A text's features are its words and their beginnings (3 to 8 bytes), each present or absent.  A logistic
regression is fitted on a bounded sample of labelled texts (``SAMPLE`` rows, those of smallest hashed doc_id):

* counts of every feature by label come from an aggregate over the sample; the ``FEATURES`` of largest
  chi-square that pass ``CHI2`` are the model's inputs;
* every sampled text with identity terms gets a twin in which they are swapped for other ones; besides the log
  loss, the squared difference of the two log-odds is penalised, so that naming a group moves no score;
* a proximal gradient step with an L1 penalty keeps the weights few.

Scoring is one pass over all texts with the weights (at most ``FEATURES`` numbers) sent along; texts never move.

Defined results: null text counts as empty and gets the score of a text without features; null labels and labels
without a document are not learnt from; of repeated labels the larger counts; with one class in the sample
every score is 0.0 or 1.0, its label, without labels 0.0; extra columns are ignored by ``score`` and carried
by ``drop_toxic``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunewright.llm.common import BYTE_BASE, flat_bytes, fresh, mix64, powers, steps, text_or_empty, words

#: bound of the labelled sample, and of the features kept
SAMPLE, FEATURES = 12_000, 32_768
#: least chi-square of a feature (one degree of freedom; p about 1e-5)
CHI2 = 19.5
#: bytes of the beginnings that are features besides the word itself
BEGINNINGS = (3, 4, 5, 6, 8)
THRESHOLD = 0.3

# Identity terms by kind; a term is swapped for the next one of its kind and language.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("she", "he"), ("her", "his"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"), ("gay", "straight"), ("transgender", "cisgender"),
    ("immigrants", "natives"), ("immigrant", "native"), ("disabled", "abled"), ("old", "young"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("immigrés", "natifs"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "inländer"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("inmigrantes", "nativos"),
)


def swap_identity(text: str, kinds: tuple[tuple[str, ...], ...] = IDENTITY) -> str:
    """Lower-cased text with every identity term replaced by the next of its kind."""
    other = {w: k[(i + 1) % len(k)] for k in kinds for i, w in enumerate(k)}
    find = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(other, key=len, reverse=True))) + r")\b")
    return find.sub(lambda m: other[m[0]], text.lower())


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word and beginning, repeats included."""
    data, at = flat_bytes(pc.utf8_lower(pc.fill_null(column, "")))
    letter = (data >= 0x80) | ((data >= 0x30) & (data <= 0x39)) | ((data >= 0x61) & (data <= 0x7A))
    start, length = words(data, letter)
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    row = np.searchsorted(at, start, "right") - 1
    inside = data[letter].astype(np.uint64) + np.uint64(1)
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(len(inside)) - np.repeat(first, length)
    term = inside * powers(BYTE_BASE, int(length.max()))[place]
    rows, feats = [row], [mix64(np.add.reduceat(term, first) + np.uint64(1 << 40))]
    total = np.zeros(len(start), np.uint64)
    for k in range(max(BEGINNINGS)):
        has = length > k
        total[has] += term[first[has] + k]
        if k + 1 in BEGINNINGS:
            rows.append(row[has])
            feats.append(mix64(total[has] + np.uint64(k + 1)))
    return np.concatenate(rows), np.concatenate(feats)


def present(column: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, place in ``known``) pairs; ``known`` is sorted."""
    row, feat = features(column)
    if not len(known) or not len(row):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place = np.minimum(np.searchsorted(known, feat), len(known) - 1)
    hit = known[place] == feat
    pair = np.unique(row[hit] * len(known) + place[hit])
    return pair // len(known), pair % len(known)


@dataclass
class ToxicityModel:
    """Sorted feature hashes, their weights and the bias."""
    known: np.ndarray
    weights: np.ndarray
    bias: float

    def log_odds(self, column: pa.Array) -> np.ndarray:
        row, place = present(column, self.known)
        return self.bias + np.bincount(row, self.weights[place], len(column))

    def scores(self, column: pa.Array) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-self.log_odds(column)))


def _csr(rows: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(n), [len(r) for r in rows]), (np.concatenate(rows) if rows else np.empty(0, np.int64))


def fit_weights(own: list[np.ndarray], twin: list[np.ndarray | None], label: np.ndarray, size: int,
                fairness: float = 4.0, l1: float = 2e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for mean log loss + fairness * mean (log-odds gap)^2 + l1 * |w|."""
    n = len(label)
    r, c = _csr(own, n)
    pairs = [i for i, t in enumerate(twin) if t is not None]
    gr, gc, gv = [], [], []
    for k, i in enumerate(pairs):
        only, new = np.setdiff1d(own[i], twin[i]), np.setdiff1d(twin[i], own[i])
        gr += [np.full(len(only) + len(new), k)]
        gc += [only, new]
        gv += [np.ones(len(only)), -np.ones(len(new))]
    gr, gc, gv = (np.concatenate(x) if x else np.empty(0) for x in (gr, gc, gv))
    gr, gc = gr.astype(np.int64), gc.astype(np.int64)
    m = max(1, len(pairs))

    def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float, float]:
        z = b + np.bincount(r, w[c], n)
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))
        g = np.bincount(c, ((p - label) / n)[r], size)
        loss = float(np.mean(np.logaddexp(0, z) - label * z))
        if len(gr):
            gap = np.bincount(gr, w[gc] * gv, len(pairs))
            g += np.bincount(gc, 2 * fairness * gap[gr] * gv / m, size)
            loss += fairness * float(np.sum(gap * gap)) / m
        return g, float(np.mean(p - label)), loss

    share = np.clip(label.mean(), 1e-6, 1 - 1e-6)
    w, b = np.zeros(size), float(np.log(share / (1 - share)))
    yw, yb, t, step = w, b, 1.0, 4.0
    for _ in range(rounds):
        g, gb, loss = gradient(yw, yb)
        while True:
            nw = yw - step * g
            nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0)
            nb = yb - step * gb
            dw, db = nw - yw, nb - yb
            if gradient(nw, nb)[2] <= loss + g @ dw + gb * db + (dw @ dw + db * db) / (2 * step) + 1e-12:
                break
            step /= 2
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        yw, yb = nw + (t - 1) / s * (nw - w), nb + (t - 1) / s * (nb - b)
        done = max(np.max(np.abs(nw - w), initial=0.0), abs(nb - b)) < 1e-5
        w, b, t, step = nw, nb, s, step * 1.1
        if done:
            break
    return w, b


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, learn: Column | None = None) -> DataFrame:
    """doc_id, text, toxic of the ``rows`` labelled documents of smallest hashed doc_id among ``learn``."""
    own = labels.where("toxic is not null and doc_id is not null")
    own = own if learn is None else own.where(learn)
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"))
    return text.join(F.broadcast(own), "doc_id")  # at most ``rows`` pairs of integers


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, rows: int = SAMPLE,
        fairness: float = 4.0) -> ToxicityModel:
    sample = labelled_sample(docs, labels, rows, learn)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            row, feat = features(b.column("text"))
            toxic = b.column("toxic").to_numpy(zero_copy_only=False) > 0
            order = np.lexsort((row, feat))
            row, feat = row[order], feat[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (feat[1:] != feat[:-1])
            keys, back = np.unique(feat[new], return_inverse=True)
            bad = np.bincount(back, toxic[row[new]], len(keys)).astype(np.int64)
            all_ = np.bincount(back, minlength=len(keys)).astype(np.int64)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(all_), pa.array(bad)],
                                  names=["feature", "n", "bad"])

    size = sample.agg(F.count("*").alias("n"), F.sum((F.col("toxic") > 0).cast("long")).alias("bad")).first()
    n, bad = float(size["n"]), float(size["bad"] or 0)
    share = bad / n if n else 0.0
    if not 0 < bad < n:
        return ToxicityModel(np.empty(0, np.uint64), np.empty(0), np.inf if share else -np.inf)
    found = sample.mapInArrow(count, "feature long, n long, bad long").groupBy("feature").agg(
        F.sum("n").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad")).where("n >= 3")
    gap = F.col("bad") * F.lit(n) - F.col("n") * F.lit(bad)
    chi2 = F.lit(n) * gap / (F.col("n") * F.lit(bad)) * gap / ((F.lit(n) - F.col("n")) * F.lit(n - bad))
    best = found.where(F.col("n") < n).withColumn("chi2", chi2).where(
        (F.col("chi2") >= CHI2) & (F.col("bad") * F.lit(n) != F.col("n") * F.lit(bad)))
    chosen = best.orderBy(F.desc("chi2"), "feature").limit(FEATURES).select("feature").toArrow()
    known = np.sort(chosen.column("feature").to_numpy().view(np.uint64))

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            text = b.column("text")
            swapped = pa.array([swap_identity(t) for t in text.to_pylist()], pa.string())
            moved = pc.not_equal(swapped, pc.utf8_lower(text)).to_numpy(zero_copy_only=False)
            out = []
            for col in (text, swapped):
                row, place = present(col, known)
                cut = np.searchsorted(row, np.arange(len(col) + 1))
                out.append([place[cut[i]:cut[i + 1]].astype(np.int32) for i in range(len(col))])
            twins = [t if m else None for t, m in zip(out[1], moved, strict=True)]
            kind = pa.list_(pa.int32())
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), pa.array(b.column("toxic").to_numpy(
                zero_copy_only=False) > 0).cast(pa.float64()), pa.array(out[0], kind), pa.array(twins, kind)],
                names=["doc_id", "label", "own", "twin"])

    got = sample.mapInArrow(inputs, "doc_id long, label double, own array<int>, twin array<int>").orderBy(
        "doc_id").toArrow()
    own = [np.asarray(x, np.int64) for x in got.column("own").to_pylist()]
    twin = [None if x is None else np.asarray(x, np.int64) for x in got.column("twin").to_pylist()]
    w, b = fit_weights(own, twin, got.column("label").to_numpy(), len(known), fairness)
    live = w != 0
    return ToxicityModel(known[live], w[live], b)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            yield pa.record_batch([b.column("doc_id"), pa.array(model.scores(b.column("text")))],
                                  names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty(F.col("text")).alias("text")).mapInArrow(
        run, f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; all columns stay."""
    text, = fresh(docs, "toxicity_text")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, text):
            clean = model.scores(b.column(text)) < threshold
            yield b.select(names).filter(pa.array(clean))

    return docs.withColumn(text, text_or_empty(F.col("text"))).mapInArrow(run, docs.schema)
