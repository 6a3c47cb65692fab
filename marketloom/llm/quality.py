"""Document quality by a factorisation machine.

Features of a document: its hashed words (share of the document's words), one bucket
of each structure statistic of the text, and one of the row's metadata (``n_chars``).
The score is ``sigmoid(a * fm(x) + b)`` with

    fm(x) = w0 + sum_j w_j x_j + 1/2 sum_f [(sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2]

so all pairwise interactions cost time linear in the document (the sum-of-squares
identity).  Weights are trained with Adagrad in numpy on a bounded labelled sample;
``a`` and ``b`` (Platt scaling) come from scores of the sample across ``FOLDS`` folds.

Defined results: null and empty texts are scored from their structure buckets alone;
a null id is kept and never held out; null metadata has a bucket of its own; repeated
rows each get a row; without any usable label every score is 0.5.  Only the named
columns are read, so extra columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import textcore, workers

#: Upper bounds of the buckets of a share between 0 and 1.
SHARES = np.array([0.0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.999])
STATS = ("letters", "upper", "digits", "spaces", "newlines", "stops", "symbols", "doubled_symbols", "pipes", "non_ascii", "distinct_words", "echoed_words", "word_length", "words", "line_length", "metadata")
FOLDS = 3
_WIDTH = 32  # buckets kept for each statistic


@dataclass(frozen=True)
class QualityModel:
    w0: float
    w: np.ndarray
    v: np.ndarray
    bits: int
    scale: float
    shift: float


def _flags() -> dict[str, np.ndarray]:
    code = np.arange(256)
    upper = (code >= 65) & (code <= 90)
    lower = (code >= 97) & (code <= 122)
    digit = (code >= 48) & (code <= 57)
    stop = np.isin(code, [ord(c) for c in ".,;:'?-"])
    symbol = (code > 32) & (code < 127) & ~upper & ~lower & ~digit & ~stop
    return {"letters": upper | lower, "upper": upper, "digits": digit, "spaces": code == 32, "newlines": code == 10, "stops": stop, "symbols": symbol, "pipes": code == 124, "non_ascii": code >= 128}


_FLAGS = _flags()


def features(column: pa.Array, chars: np.ndarray, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets, feature ids, values) block by block; ids are distinct in a document."""
    base = 1 << bits
    for first, end, data, offsets in textcore.blocks(column):
        n = end - first
        size = np.maximum(np.diff(offsets), 1)
        hashes, word_offsets = textcore.words(data, offsets)
        n_words = np.diff(word_offsets)
        doc = np.repeat(np.arange(n), n_words)
        key, count = np.unique(doc << bits | (hashes >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
        owner = key >> bits
        stat: dict[str, np.ndarray] = {}
        flagged = {k: f[data] for k, f in _FLAGS.items()}
        for k, x in flagged.items():
            stat[k] = textcore.sum_by_document(x, offsets) / size
        doubled = flagged["symbols"].copy()
        doubled[1:] &= data[1:] == data[:-1]
        doubled[:1] = False
        stat["doubled_symbols"] = textcore.sum_by_document(doubled, offsets) / size
        stat["upper"] = stat["upper"] / np.maximum(stat["letters"], 1e-9)
        stat["distinct_words"] = np.bincount(owner, minlength=n) / np.maximum(n_words, 1)
        echo = np.zeros(len(hashes), dtype=bool)
        echo[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        stat["echoed_words"] = np.bincount(doc[echo], minlength=n) / np.maximum(n_words, 1)
        bucket = {k: np.searchsorted(SHARES, x, side="left") for k, x in stat.items()}
        lines = stat["newlines"] * size + 1
        for k, x in (("word_length", size / np.maximum(n_words, 1)), ("words", n_words), ("line_length", size / lines)):
            bucket[k] = np.clip(np.log2(1 + x) * 2, 0, _WIDTH - 1).astype(int)
        meta = chars[first:end]
        bucket["metadata"] = np.where(np.isnan(meta), _WIDTH - 1, np.clip(np.log2(1 + np.maximum(np.nan_to_num(meta), 0)), 0, _WIDTH - 2)).astype(int)
        dense = np.stack([base + i * _WIDTH + np.minimum(bucket[k], _WIDTH - 1) for i, k in enumerate(STATS)], 1)
        value = count / np.maximum(n_words, 1)[owner]
        all_owner = np.concatenate([owner, np.repeat(np.arange(n), len(STATS))])
        order = np.argsort(all_owner, kind="stable")
        ids = np.concatenate([key & (base - 1), dense.ravel()])[order]
        values = np.concatenate([value, np.full(n * len(STATS), 0.25)])[order]
        yield first, end, np.concatenate([[0], np.cumsum(np.bincount(all_owner, minlength=n))]), ids, values


def _raw(model_w0: float, w: np.ndarray, v: np.ndarray, offsets: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """fm(x) of each document and the sums of v x that its gradient needs."""
    vx = v[ids] * x[:, None]
    total = textcore.sum_by_document(vx, offsets)
    squares = textcore.sum_by_document(np.einsum("ij,ij->i", vx, vx), offsets)
    linear = textcore.sum_by_document(w[ids] * x, offsets)
    return model_w0 + linear + 0.5 * ((total**2).sum(1) - squares), total


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[str | None], chars: list[float | None], labels: list[int], bits: int = 15, rank: int = 8, epochs: int = 12, rate: float = 0.15, seed: int = 3) -> QualityModel:
    size = (1 << bits) + len(STATS) * _WIDTH
    rng = np.random.default_rng(seed)
    first = rng.normal(0, 0.05, (size, rank))
    y = np.asarray(labels, dtype=float)
    if len(y) < 10 or y.min() == y.max():
        prior = y.mean() if len(y) else 0.5
        return QualityModel(float(np.log((prior + 0.01) / (1.01 - prior))), np.zeros(size), first * 0, bits, 1.0, 0.0)
    rows = []
    for _, _, offsets, ids, x in features(pa.array(texts, pa.large_string()), np.array(chars, dtype=float), bits):
        rows += [(ids[a:b], x[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))

    def batch(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = [len(rows[i][0]) for i in chosen]
        return np.concatenate([[0], np.cumsum(n)]), np.concatenate([rows[i][0] for i in chosen]), np.concatenate([rows[i][1] for i in chosen])

    def fitted(fit: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        w0, w, v = 0.0, np.zeros(size), first.copy()
        gw, gv, g0 = np.full(size, 1e-6), np.full((size, rank), 1e-6), 1e-6
        for _ in range(epochs):
            fit = rng.permutation(fit)
            for start in range(0, len(fit), 32):
                chosen = fit[start : start + 32]
                offsets, ids, x = batch(chosen)
                z, total = _raw(w0, w, v, offsets, ids, x)
                err = (_sigmoid(z) - y[chosen]) * weight[chosen] / len(chosen)
                owner = np.repeat(np.arange(len(chosen)), np.diff(offsets))
                d = (err[owner] * x)[:, None]
                touched, inverse = np.unique(ids, return_inverse=True)
                dw = np.bincount(inverse, d[:, 0], len(touched)) + 1e-5 * w[touched]
                dv = np.zeros((len(touched), rank))
                np.add.at(dv, inverse, d * (total[owner] - v[ids] * x[:, None]))
                dv += 1e-5 * v[touched]
                g0 += err.sum() ** 2
                gw[touched] += dw**2
                gv[touched] += dv**2
                w0 -= rate * err.sum() / np.sqrt(g0)
                w[touched] -= rate * dw / np.sqrt(gw[touched])
                v[touched] -= 0.3 * rate * dv / np.sqrt(gv[touched])
        return w0, w, v

    order = rng.permutation(len(rows))
    order = order[np.argsort(y[order], kind="stable")]  # each class is dealt evenly
    gold, z = y, np.zeros(len(y))
    for part in range(FOLDS):  # every row is scored by a machine that has not seen it
        held = order[part::FOLDS]
        z[held] = _raw(*fitted(np.setdiff1d(order, held)), *batch(held))[0]
    w0, w, v = fitted(order)
    a, b = 1.0, 0.0
    for _ in range(500):  # Platt scaling; smoothed targets keep it finite when the classes separate
        n1, n0 = gold.sum(), len(gold) - gold.sum()
        err = _sigmoid(a * z + b) - np.where(gold == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        a, b = max(0.05, a - 0.05 * float((err * z).mean())), b - 0.05 * float(err.mean())
    return QualityModel(float(w0), w, v, bits, a, b)


def fit_quality_model(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_col: str = "n_chars", label_col: str = "quality", most_per_class: int = 1500, **options) -> QualityModel:
    """Train on about ``most_per_class`` labelled documents of each class (the documented bound)."""
    from marketloom.llm.sampling import bounded_sample

    one = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("k")).agg(F.min(label_col).alias("y"))
    chosen = bounded_sample(one, "y", most_per_class)
    texts = documents.select(F.col(id_col).alias("k"), F.col(text_col).alias("x"), F.col(meta_col).cast("double").alias("m"))
    joined = texts.join(F.broadcast(chosen), "k")  # ids that repeat are drawn once more, by row
    sample = sorted((r.k, r.x or "", -1.0 if r.m is None else r.m, r.y) for r in bounded_sample(joined, "y", most_per_class).collect())
    return train([r[1] for r in sample], [None if r[2] < 0 else r[2] for r in sample], [r[3] for r in sample], **options)


def score(documents: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", meta_col: str = "n_chars", keep: bool = False) -> DataFrame:
    """id and score of each row in one pass without a shuffle; with ``keep`` all columns and ``quality_score``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # its size is fixed by bits and rank
    schema = documents.schema if keep else documents.select(F.col(id_col)).schema
    schema = type(schema)(schema.fields[:]).add("quality_score" if keep else "score", "double")
    columns = documents.columns if keep else [id_col]
    inputs = documents.select(*[F.col(c) for c in columns], F.col(text_col).alias("__text"), F.col(meta_col).cast("double").alias("__meta"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in batches:
            out = np.zeros(part.num_rows)
            chars = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False).astype(float)
            for first, end, offsets, ids, x in features(part.column(part.num_columns - 2), chars, m.bits):
                out[first:end] = _sigmoid(m.scale * _raw(m.w0, m.w, m.v, offsets, ids, x)[0] + m.shift)
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(out)], names=schema.names)

    return inputs.mapInArrow(workers.tidy(run, "quality"), schema)
