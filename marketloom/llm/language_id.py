"""Language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its hashed 2- to 4-byte subwords; a linear
softmax on top gives the languages.  Both are trained together by stochastic gradient
descent in numpy on a bounded labelled sample.  A temperature fitted on a part kept
back calibrates the scores, and the lowest score whose accepted predictions reach
``target_precision`` on that part becomes the rejection threshold.

At prediction the embedding table times the softmax weights is one table of class
scores per subword (the mean commutes with the linear layer), so a text costs one
gather per subword.

Defined results: a null text or a text without any letter is ``und`` with score 0 and
not accepted; a null id stays null; repeated rows each get their own row; an empty
table gives an empty result; a sample without labels gives ``und`` everywhere.
Only the id and text columns are read, so extra columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import textcore

SIZES = (2, 3, 4)


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    table: np.ndarray  # buckets x labels: embeddings times softmax weights
    bias: np.ndarray
    bits: int
    temperature: float
    threshold: float


def _prepared(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


_KEEP = np.full(256, 32, dtype=np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def subwords(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords and the document of each; none crosses a word's inside."""
    text = _KEEP[data]
    gap = text == 32
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    code = text.astype(np.uint32)
    buckets, docs = [], []
    for n in SIZES:
        m = len(text) - n + 1
        if m <= 0:
            continue
        value = code[:m].copy()
        ok = doc[:m] == doc[n - 1 :]
        for j in range(1, n):
            value = (value << np.uint32(8)) | code[j : j + m]
            if j < n - 1:
                ok &= ~gap[j : j + m]
        ok &= ~(gap[:m] & gap[n - 1 :])
        at = np.flatnonzero(ok)
        value = (value[at] ^ np.uint32(0x85EBCA6B * n & 0xFFFFFFFF)) * np.uint32(2654435769)
        buckets.append(value >> np.uint32(32 - bits))
        docs.append(doc[at])
    if not buckets:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    return np.concatenate(buckets), np.concatenate(docs)


def train(texts: list[str], langs: list[str], bits: int = 16, dim: int = 16, epochs: int = 5, rate: float = 40.0, seed: int = 7, target_precision: float = 0.99) -> LanguageModel:
    """Fit embeddings and softmax on four fifths of the sample, calibrate on the rest."""
    labels = tuple(sorted(set(langs)))
    if not labels:
        return LanguageModel((), np.zeros((1 << bits, 0), np.float32), np.zeros(0), bits, 1.0, 1.0)
    target = np.searchsorted(labels, langs)
    rows = []  # (buckets, weights) of each text
    for _, _, data, offsets in textcore.blocks(_prepared(pa.array(texts, pa.large_string()))):
        bucket, doc = subwords(data, offsets, bits)
        key, count = np.unique(doc.astype(np.int64) << bits | bucket, return_counts=True)
        cut = np.searchsorted(key >> bits, np.arange(len(offsets)))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            rows.append((key[a:b] & ((1 << bits) - 1), count[a:b] / max(1, count[a:b].sum())))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    part = max(1, len(rows) // 5) if len(rows) >= 10 else 0
    held, fit = order[:part], order[part:]
    emb = rng.normal(0, 0.1, (1 << bits, dim))
    out = rng.normal(0, 0.1, (dim, len(labels)))
    bias = np.zeros(len(labels))

    def pooled(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([len(rows[i][0]) for i in ids])
        bucket = np.concatenate([rows[i][0] for i in ids])
        weight = np.concatenate([rows[i][1] for i in ids])
        owner = np.repeat(np.arange(len(ids)), n)
        mean = textcore.sum_by_document(emb[bucket] * weight[:, None], np.concatenate([[0], np.cumsum(n)]))
        return bucket, weight, owner, mean

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for start in range(0, len(fit), 32):
            ids = fit[start : start + 32]
            if (len(ids) > 1 or len(fit) == 1) and any(len(rows[i][0]) for i in ids):
                bucket, weight, owner, mean = pooled(ids)
                logits = mean @ out + bias
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(ids)), target[ids]] -= 1
                p /= len(ids)
                back = p @ out.T
                out -= step / 8 * (mean.T @ p)
                bias -= step / 80 * p.sum(0)
                np.add.at(emb, bucket, -step * weight[:, None] * back[owner])
    table, temperature, threshold = (emb @ out).astype(np.float32), 1.0, 0.0
    if part:
        logits = np.concatenate([pooled(np.array([i]))[3] @ out + bias for i in held])
        gold = target[held]

        def probs(t: float) -> np.ndarray:
            z = np.exp((logits - logits.max(1, keepdims=True)) / t)
            return z / z.sum(1, keepdims=True)

        grid = np.geomspace(0.02, 10, 80)
        temperature = float(grid[np.argmin([-np.log(probs(t)[np.arange(len(gold)), gold] + 1e-12).sum() for t in grid])])
        p = probs(temperature)
        best = np.argsort(-p.max(1), kind="stable")
        precision = np.cumsum((p.argmax(1) == gold)[best]) / np.arange(1, len(best) + 1)
        good = np.flatnonzero(precision >= target_precision)
        threshold = float(p.max(1)[best][good[-1]]) if len(good) else 1.0
    return LanguageModel(labels, table, bias, bits, temperature, threshold)


def predict_column(model: LanguageModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Class index and calibrated score of each text."""
    best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
    for first, end, data, offsets in textcore.blocks(_prepared(column)):
        n = end - first
        bucket, doc = subwords(data, offsets, model.bits)
        gathered = model.table[bucket]
        count = np.maximum(np.bincount(doc, minlength=n), 1)
        logits = np.stack([np.bincount(doc, gathered[:, c], minlength=n) for c in range(len(model.labels))], 1) / count[:, None] + model.bias
        z = np.exp((logits - logits.max(1, keepdims=True)) / model.temperature)
        z /= z.sum(1, keepdims=True)
        best.append(z.argmax(1))
        score.append(z.max(1))
    return np.concatenate(best), np.concatenate(score)


def fit_language_model(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", most_per_language: int = 400, **options) -> LanguageModel:
    """Train on about ``most_per_language`` labelled rows of each language (the documented bound)."""
    from marketloom.llm.sampling import bounded_sample

    labelled = documents.select(F.col(key_col).alias("k"), F.col(lang_col).alias("l"), F.col(text_col).alias("x")).filter(F.col("l").isNotNull() & F.col("x").isNotNull())
    sample = sorted((r.k is None, r.k or 0, r.l, r.x) for r in bounded_sample(labelled, "l", most_per_language).collect())
    return train([r[3] for r in sample], [r[2] for r in sample], **options)


def identify(documents: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, accepted for each row; whole texts, one pass, no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # its size is fixed by bits and labels
    schema = documents.select(F.col(id_col)).schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.labels, "und"], dtype=object)
        for batch in batches:
            letters = np.asarray(batch.column(2).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
            if model.labels:
                best, score = predict_column(model, batch.column(1))
                best, score = np.where(letters, best, len(names) - 1), np.where(letters, np.clip(score, 0.0, 1.0), 0.0)
            else:
                best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(letters & (score >= model.threshold))], names=schema.names)

    texts = documents.select(F.col(id_col), F.col(text_col).alias("x"), F.col(text_col).rlike(r"\p{L}").alias("letters"))
    return texts.mapInArrow(run, schema)
