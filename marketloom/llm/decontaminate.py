"""Benchmark decontamination by greedy string tiling.

Texts become lower-cased words of letters, marks and digits, so case and punctuation,
typographic marks too, do not matter; in scripts written without spaces each character
is a word.  A document and a benchmark item that share a seed, ``min_words`` equal words
in a row, are tiled: matching runs are found with running Karp-Rabin hashes, the
longest unmarked match is marked again and again, no word twice, until no match of
``min_words`` is left.  The share of the item's words under tiles is its coverage;
tiles may lie in any order, so reordered passages count in full.  A document with
coverage of ``threshold`` or more of any item is contaminated.

Seeds of the benchmark are broadcast only if its number of words, counted first, is at
most ``broadcast_words``; a larger benchmark is joined with the documents' seeds, and
texts are told apart by 128 bits of hash.  Both ways give the same rows.

Defined results: null and empty texts and items match nothing; an item of fewer words
than ``min_words`` is matched as a whole, so an item of one word is covered by every
document holding it; contamination depends on a row's text alone, so repeated rows and
rows that share an id, or have none, are judged one by one; a null id is carried as
null; only the named columns are read, and ``remove`` keeps all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm import textcore, workers
from marketloom.llm.scratch import Scratch
from marketloom.llm.skew import spread_join

MIN_WORDS = 5
THRESHOLD = 0.5
BROADCAST_WORDS = 4_000_000
_PAIRS = "covered int, item_words int, coverage double"


def tiles(pattern: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (pattern position, text position, length), each at least ``least`` long."""
    free_p, free_t = [True] * len(pattern), [True] * len(text)
    found: list[tuple[int, int, int]] = []
    length = max(least, min(len(pattern), len(text)))
    while True:
        matches, longest = _scan(pattern, text, free_p, free_t, length)
        if longest > 2 * length:
            length = longest
            continue
        for n, p, t in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if all(free_p[p : p + n]) and all(free_t[t : t + n]):
                free_p[p : p + n] = free_t[t : t + n] = [False] * n
                found.append((p, t, n))
                matches = None
        if matches is None:
            continue  # what overlapped a marked tile may still hold a match of this length
        if length <= least:
            return found
        length = max(least, length // 2)


def _scan(pattern: list[int], text: list[int], free_p: list[bool], free_t: list[bool], length: int) -> tuple[list[tuple[int, int, int]], int]:
    """Maximal unmarked matches of ``length`` or more, by a rolling hash of that many words."""
    index: dict[int, list[int]] = {}
    for start, value in _rolling(pattern, free_p, length):
        index.setdefault(value, []).append(start)
    matches, longest = [], 0
    for t, value in _rolling(text, free_t, length):
        for p in index.get(value, ()):
            if p and t and free_p[p - 1] and free_t[t - 1] and pattern[p - 1] == text[t - 1]:
                continue  # part of a match that began earlier
            n = 0
            while p + n < len(pattern) and t + n < len(text) and free_p[p + n] and free_t[t + n] and pattern[p + n] == text[t + n]:
                n += 1
            if n >= length:
                matches.append((n, p, t))
                longest = max(longest, n)
    return matches, longest


_KR_BASE, _KR_MOD = 1_000_003, (1 << 61) - 1


def _rolling(words: list[int], free: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of each window of ``length`` free words."""
    lead = pow(_KR_BASE, length - 1, _KR_MOD)
    value = run = 0
    for i, word in enumerate(words):
        if not free[i]:
            value = run = 0
            continue
        if run == length:
            value = (value - words[i - length] * lead) % _KR_MOD
            run -= 1
        value = (value * _KR_BASE + word) % _KR_MOD
        run += 1
        if run == length:
            yield i - length + 1, value


@dataclass(frozen=True)
class SeedIndex:
    """Seeds of a benchmark of bounded size, and its items' words."""

    lengths: tuple[int, ...]  # min_words, and shorter ones for shorter items
    seeds: np.ndarray  # sorted
    owners: np.ndarray  # item position of each seed
    ids: list[int | None]
    flat: np.ndarray  # words of all items
    cuts: np.ndarray
    marks: np.ndarray  # bit table over the seeds' upper bits

    def size(self, item: int) -> int:
        return int(self.cuts[item + 1] - self.cuts[item])

    def words(self, item: int) -> list[int]:
        return self.flat[self.cuts[item] : self.cuts[item + 1]].tolist()


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, end, data, offsets in textcore.blocks(textcore.spaced(column)):
        hashes, cut = textcore.words(data, offsets, wordlike=True)
        yield first, end, hashes >> np.uint64(4), cut  # below the Karp-Rabin modulus


def _seed_values(hashes: np.ndarray, k: int) -> np.ndarray:
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    value = np.full(len(hashes) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        value = textcore.mix64(value * np.uint64(0xD6E8FEB86659FD93) + hashes[j : len(hashes) - k + 1 + j])
    return value


def seed_index(ids: list[int | None], texts: list[str | None], min_words: int) -> SeedIndex:
    words: list[np.ndarray] = []
    for _, _, hashes, cut in _words(pa.array(texts, pa.large_string())):
        words += [hashes[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    lengths = tuple(sorted({min(min_words, len(w)) for w in words if len(w)}))
    seeds = [textcore.distinct(_seed_values(w, min(min_words, len(w)))) if len(w) else np.zeros(0, np.uint64) for w in words]
    owners = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
    flat = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    marks = np.zeros(1 << 20, dtype=bool)
    marks[(flat >> np.uint64(44)).astype(np.int64)] = True
    cuts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return SeedIndex(lengths, flat[order], owners[order], ids, np.concatenate([np.zeros(0, np.uint64), *words]), cuts, marks)


def coverages(index: SeedIndex, column: pa.Array, min_words: int) -> Iterator[tuple[int, int, int, int]]:
    """(row, item position, covered words, item words) of every row and item that share a seed."""
    for first, _, hashes, cut in _words(column):
        hit_at: dict[int, list[tuple[int, int, int]]] = {}
        for k in index.lengths:
            value = _seed_values(hashes, k)
            at = np.flatnonzero(index.marks[(value >> np.uint64(44)).astype(np.int64)])
            low = np.searchsorted(index.seeds, value[at], side="left")
            high = np.searchsorted(index.seeds, value[at], side="right")
            row = np.searchsorted(cut, at, side="right") - 1
            ok = np.flatnonzero((high > low) & (at + k <= cut[np.minimum(row + 1, len(cut) - 1)]))
            for i in ok.tolist():
                for item in index.owners[low[i] : high[i]].tolist():
                    if min(min_words, index.size(item)) == k:
                        hit_at.setdefault(int(row[i]), []).append((item, int(at[i]), k))
        for row, hits in sorted(hit_at.items()):
            spans: dict[int, list[tuple[int, int]]] = {}
            for item, at, k in sorted(hits):
                runs = spans.setdefault(item, [])
                if runs and at <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], max(runs[-1][1], at + k))
                else:
                    runs.append((at, at + k))
            for item, runs in spans.items():
                pattern = index.words(item)
                pieces = [hashes[a:b].tolist() for a, b in runs]
                # more copies of a piece than the item has room for cannot add tiles
                room: dict[tuple, int] = {}
                text: list[int] = []
                for piece in pieces:
                    key = tuple(piece)
                    room[key] = room.get(key, 0) + 1
                    if room[key] <= -(-len(pattern) // min(min_words, len(pattern))):
                        text += [-1, *piece]  # -1 matches no word
                covered = sum(n for _, _, n in tiles(pattern, text, min(min_words, len(pattern))))
                yield first + row, item, covered, len(pattern)


def _bounded_index(benchmark: DataFrame, min_words: int, broadcast_words: int) -> SeedIndex | None:
    size = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count(F.lit(1))).first()
    if size[0] > 2 * broadcast_words or size[1] > broadcast_words:  # a word takes two characters or more with its gap
        return None
    rows = benchmark.orderBy("item", "text").collect()
    return seed_index([r.item for r in rows], [r.text for r in rows], min_words)


def contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = MIN_WORDS, threshold: float = THRESHOLD, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(id, item, covered, item_words, coverage) of the pairs at or above the threshold."""
    slim = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    index = _bounded_index(items, min_words, broadcast_words)
    if index is None:
        found = _joined(slim, items, min_words).filter(F.col("coverage") >= threshold)
        pairs = spread_join(slim.select("id", *_text_key()), found, ["h", "g"]).select("id", "item", "covered", "item_words", "coverage")
    else:
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(coverages(shared.value, batch.column(1), min_words))
                rows = pa.array([x[0] for x in found], pa.int64())
                items = pa.array([shared.value.ids[x[1]] for x in found], pa.int64())
                covered, total = (pa.array([x[i] for x in found], pa.int32()) for i in (2, 3))
                share = pa.array([x[2] / x[3] for x in found], pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), items, covered, total, share], names=["id", "item", "covered", "item_words", "coverage"])

        pairs = slim.mapInArrow(workers.tidy(run, "decontamination"), f"id long, item long, {_PAIRS}")
    return pairs.filter(F.col("coverage") >= threshold).withColumnsRenamed({"id": id_col, "item": item_col})


def _text_key() -> list[Column]:
    """128 bits of the text."""
    return [F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), F.col("text")).alias("g")]


def _seed_rows(lengths: list[int] | None, min_words: int):
    """Distinct seeds of each text (text, h, g): of the given lengths, or of the item's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, hashes, cut in _words(batch.column(0)):
                values, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                    for k in [min(min_words, b - a)] if lengths is None else lengths:
                        if 0 < k <= b - a:
                            values.append(textcore.distinct(_seed_values(hashes[a:b], k)))
                            rows.append(np.full(len(values[-1]), first + i))
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch.column(1).take(take), batch.column(2).take(take), pa.array(np.concatenate(values).view(np.int64))], names=["h", "g", "seed"])

    return run


def _joined(documents: DataFrame, items: DataFrame, min_words: int) -> DataFrame:
    """(h, g, item, covered, item_words, coverage) of the texts and items that share a seed, for a benchmark of any size.

    Seeds meet in an equi-join, each pair of different texts is tiled once in a task.
    """

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, cut in _words(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.minimum(np.diff(cut), min_words)).astype(np.int32))], names=["k"])

    lengths = sorted(r.k for r in items.select("text").mapInArrow(sizes, "k int").distinct().collect() if r.k)  # min_words values at most
    keyed = documents.select("text", *_text_key())
    own = items.select("item", "text", *_text_key())
    left = keyed.mapInArrow(_seed_rows(lengths, min_words), "h long, g long, seed long")
    right = own.select("text", "h", "g").mapInArrow(_seed_rows(None, min_words), "h long, g long, seed long").toDF("ih", "ig", "seed").distinct()
    met = spread_join(left, right, "seed").select("h", "g", "ih", "ig").distinct()  # a common phrase is in many texts
    met = Scratch(documents.sparkSession, "tiling").save(met, "met")  # counted and joined below
    texts = met.select("h", "g").distinct().join(keyed, ["h", "g"]).groupBy("h", "g").agg(F.min("text").alias("t"))
    itexts = own.groupBy(F.col("h").alias("ih"), F.col("g").alias("ig")).agg(F.min("text").alias("it"))
    full = spread_join(spread_join(met, texts, ["h", "g"]), itexts, ["ih", "ig"])  # so may be an item, or a text of many items

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (text, itext) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                for _, _, covered, total in coverages(seed_index([None], [itext], min_words), pa.array([text], pa.large_string()), min_words):
                    out.append((i, covered, total, covered / total))
            take = pa.array([x[0] for x in out], pa.int64())
            kinds = (pa.int32(), pa.int32(), pa.float64())
            names = ["h", "g", "ih", "ig", "covered", "item_words", "coverage"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(4)), *(pa.array([x[i + 1] for x in out], t) for i, t in enumerate(kinds))], names=names)

    tiled = full.select("h", "g", "ih", "ig", "t", "it").mapInArrow(tile, f"h long, g long, ih long, ig long, {_PAIRS}")
    return tiled.join(own.select("item", F.col("h").alias("ih"), F.col("g").alias("ig")), ["ih", "ig"]).drop("ih", "ig")


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = MIN_WORDS, threshold: float = THRESHOLD, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``documents`` without the contaminated rows; with a bounded benchmark no row is shuffled."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    index = _bounded_index(items, min_words, broadcast_words)
    if index is None:
        bad = _joined(documents.select(F.col(text_col).alias("text")), items, min_words).filter(F.col("coverage") >= threshold)
        bad = bad.select(F.col("h").alias("__h"), F.col("g").alias("__g")).distinct()
        h, g = (F.xxhash64(text_col), F.xxhash64(F.lit(1), F.col(text_col)))
        return documents.join(bad, (h == F.col("__h")) & (g == F.col("__g")), "left_anti")
    shared = documents.sparkSession.sparkContext.broadcast(index)
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            for row, _, covered, total in coverages(shared.value, batch.column(at), min_words):
                clean[row] &= covered < threshold * total
            yield batch.filter(pa.array(clean))

    return documents.mapInArrow(workers.tidy(run, "decontamination"), documents.schema)
