"""Best-fit packing of tokenised documents into training sequences.

Documents are tokenised whole and end with ``end_id``.  A document longer than the
capacity is cut into pieces of exactly that many tokens, its first piece being the
shorter one.  Full pieces are sequences of their own; the others are dealt evenly into
groups of about ``items_per_group`` and packed group by group, largest first, by vector
best fit: a bin has residual token, document-count and attention-cost (sum of squared
lengths) capacities, a piece fits only if all three hold it, and among the bins that
fit the one with the smallest weighted residual norm (or weighted dot product of demand
and residual) is taken.  The groups leave one partly filled bin in thousands.

Tokenising cuts the text at single spaces, where byte-level BPE never merges, and
``tokenizers`` encodes each distinct chunk of a task once, many chunks at a call; the
bytes of each token tell where a chunk's ids end.  Chunks that white space could join to a
neighbour are encoded apart, and where no token ends at a chunk's end its whole call is
encoded chunk by chunk, so ids never depend on what else is encoded.  Chunks are found
by hash and compared byte by byte.

Defined results: null and empty texts are one piece holding ``end_id`` alone; repeated
rows are packed one by one; a null id is kept; an empty table gives an empty result;
only the named columns are read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import textcore, workers
from marketloom.llm.scratch import Scratch

ITEMS_PER_GROUP = 8192
_MOST_TASKS = 20_000
_BLOCK = 1 << 20
_CACHE = 1_000_000  # distinct chunks a worker remembers
_RUN = 500  # chunks that one call encodes as one text

_AFTER = np.ones(256, dtype=bool)  # bytes that may follow a space at which a chunk begins
_AFTER[[9, 10, 11, 12, 13, 32]] = False
_PLAIN = np.zeros(256, dtype=bool)  # ASCII that is not white space
_PLAIN[33:127] = True


def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ChunkTokenizer:
    """Encodes columns of texts with a byte-level BPE file of ``tokenizers``, each distinct chunk once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        if self.tokenizer.normalizer or kind.get("type") != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"]:
            raise ValueError("chunks at spaces need a byte-level tokenizer without normalizer and prefix space")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        of = _byte_characters()
        self.token_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.token_bytes[i] = len(token) if all(c in of for c in token) else len(token.encode())
        self._clear()

    def _ids(self, texts: list[str], at_once: int) -> Iterator[np.ndarray]:
        for i in range(0, len(texts), at_once):  # encodings are far larger than ids
            for e in self.tokenizer.encode_batch_fast(texts[i : i + at_once], add_special_tokens=False):
                yield np.array(e.ids, np.uint32)

    def _encoded(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chunks' numbers in another order, all their ids in a row, and the number of each one's ids."""
        added = [a.encode() for a in self.added]
        whole = b"".join(chunks)
        added = [a for a in added if a in whole]  # hardly ever one
        joined, apart = [], []
        for i, c in enumerate(chunks):
            # white space before " x" ends a token; only a second character of white space could join what comes before
            alone = c[0] != 32 or len(c) < 2 or c[1] <= 32 or c[1] > 127 and c.decode()[1].isspace()
            (apart if alone or added and any(a in c for a in added) else joined).append(i)
        runs = [joined[i : i + _RUN] for i in range(0, len(joined), _RUN)]
        order, ids, sizes = [], [], []
        for run, made in zip(runs, self._ids([b"".join(chunks[i] for i in run).decode() for run in runs], 20), strict=True):
            ends, reached = np.cumsum([len(chunks[i]) for i in run]), np.cumsum(self.token_bytes[made])
            at = np.searchsorted(reached, ends)
            if len(made) == 0 or at[-1] >= len(made) or (reached[at] != ends).any():
                apart += run
                continue
            order += run
            ids.append(made)
            sizes.append(np.diff(at + 1, prepend=0))
        for made in self._ids([chunks[i].decode() for i in apart], 20 * _RUN):
            ids.append(made)
            sizes.append(np.array([len(made)]))
        return np.array(order + apart, np.int64), np.concatenate(ids), np.concatenate(sizes)

    def _clear(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes of the chunks known, and their places below
        self.known = 0
        self.starts, self.sizes = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.flat, self.used = np.zeros(1 << 14, np.uint32), 0
        self.places, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.text, self.filled = np.zeros(1 << 14, np.uint8), 0

    def _found(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each chunk data[start:end], -1 if its hash is new; and whether another chunk has its hash."""
        slot, other = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), dtype=bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == hashes)
            slot[hit] = self.slots[at[hit]]
            size = ends[hit] - starts[hit]
            other[hit] = self.lengths[slot[hit]] != size
            hit, size = hit[~other[hit]], size[~other[hit]]
            shift = np.cumsum(size) - size
            place = np.arange(int(size.sum()))
            differs = np.flatnonzero(data[np.repeat(starts[hit] - shift, size) + place] != self.text[np.repeat(self.places[slot[hit]] - shift, size) + place])
            other[hit[np.searchsorted(shift, differs, side="right") - 1]] = True
        return slot, other

    def _remember(self, chunks: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """Encode the chunks, of which the first ones have these hashes, and return their slots."""
        order, new, sizes = self._encoded(chunks)
        first, n = self.known, len(chunks)
        lengths = np.array([len(chunks[i]) for i in order.tolist()], np.int64)
        text = np.frombuffer(b"".join(chunks[i] for i in order.tolist()), np.uint8)
        for name, used, value in (
            ("starts", first, self.used + np.cumsum(sizes) - sizes), ("sizes", first, sizes), ("places", first, self.filled + np.cumsum(lengths) - lengths), ("lengths", first, lengths),
            ("flat", self.used, new), ("text", self.filled, text),
        ):
            array = getattr(self, name)
            if len(array) < used + len(value):
                grown = np.empty(max(2 * len(array), used + len(value)), array.dtype)
                grown[:used] = array[:used]
                setattr(self, name, array := grown)
            array[used : used + len(value)] = value
        self.known, self.used, self.filled = first + n, self.used + len(new), self.filled + len(text)
        slot = np.empty(n, np.int64)
        slot[order] = np.arange(first, first + n)
        turn = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[turn])
        self.hashes, self.slots = np.insert(self.hashes, at, hashes[turn]), np.insert(self.slots, at, slot[: len(hashes)][turn].astype(np.int32))
        return slot

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, offsets) block by block."""
        for first, end, data, offsets in textcore.blocks(column, _BLOCK):
            space = np.flatnonzero(data[:-1] == 32) if len(data) > 1 else np.zeros(0, np.int64)
            space = space[space > 0]
            before, after = data[space - 1], data[space + 1]
            space = space[_AFTER[after] & (_PLAIN[before] | _PLAIN[after])]
            border = offsets[:-1]
            starts = textcore.distinct(np.concatenate([space, border[border < len(data)]]))
            ends = np.append(starts[1:], len(data)) if len(starts) else starts
            hashes = textcore.span_hashes(data, starts, ends)
            # groups of equal hashes through a hash table, in order of their first chunks
            inverse = pa.array(hashes).dictionary_encode().indices.to_numpy().astype(np.int64)
            at = np.empty(int(inverse.max(initial=-1)) + 1, np.int64)
            at[inverse[::-1]] = np.arange(len(inverse))[::-1]
            # a chunk that only hashes like its group's first one, or like a known one, is encoded on its own
            same = ends - starts == (ends - starts)[at][inverse]
            index = np.int32 if len(data) < 1 << 31 else np.int64
            place = np.repeat((starts[at][inverse] - starts).astype(index), ends - starts) + np.arange(len(data), dtype=index)
            differs = np.flatnonzero(data != data.take(place, mode="clip"))
            same[np.searchsorted(starts, differs, side="right") - 1] = False
            of, other = self._found(hashes[at], data, starts[at], ends[at])
            if self.known and self.known + int((of < 0).sum()) > _CACHE:
                self._clear()
                of, other = self._found(hashes[at], data, starts[at], ends[at])
            new = np.flatnonzero(of < 0)
            odd = np.flatnonzero(~same | other[inverse])
            slot = of[inverse]
            if len(new) or len(odd):
                raw, chosen = data.tobytes(), np.concatenate([at[new], odd])
                made = self._remember([raw[a:b] for a, b in zip(starts[chosen].tolist(), ends[chosen].tolist(), strict=True)], hashes[at[new]])
                of[new] = made[: len(new)]
                slot = of[inverse]
                slot[odd] = made[len(new) :]
            sizes = self.sizes[slot]
            total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            ids = self.flat[np.repeat(self.starts[slot] - total[:-1], sizes) + np.arange(total[-1])]
            yield first, end, ids, total[np.searchsorted(starts, offsets)]


_tokenizers: dict[str, ChunkTokenizer] = {}


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """The tokenizer of this Python worker, with its chunks until another operator's task."""
    workers.hold("packing", _tokenizers.clear)
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def piece_starts(length: int, capacity: int) -> list[int]:
    """Starts of a document's pieces; only the first may be shorter than the capacity."""
    count = max(1, -(-length // capacity))
    head = length - capacity * (count - 1)
    return [0] + [head + capacity * i for i in range(count - 1)]


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, serial[, ids]) of each piece; serial tells all rows apart."""
    slim = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, serial = chunk_tokenizer(tokenizer_path), TaskContext.get().partitionId() << 36
        for batch in batches:
            for first, end, ids, offsets in tokenizer.encode(batch.column(1)):
                rows, number, start, length, crc, kept = [], [], [], [], [], []
                for i in range(end - first):
                    own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                    cuts = piece_starts(len(own), capacity)
                    for n, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(own)], strict=True)):
                        rows.append(first + i)
                        number.append(n)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(own[a:b].tobytes()))
                        if with_ids:
                            kept.append(own[a:b].astype(np.int32))
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(np.arange(serial, serial + len(rows)))]
                serial += len(rows)
                names = ["id", "piece", "start", "length", "ids_crc32", "serial"]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.list_(pa.int32()))] if with_ids else []), names=names + ["ids"] * with_ids)

    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long, serial long" + ", ids array<int>" * with_ids
    return slim.mapInArrow(workers.tidy(run, "packing"), schema)


def vector_best_fit(lengths: np.ndarray, capacities: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 1.0, 1.0), measure: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item of the given token lengths.

    Capacities and weights are of tokens, documents and attention cost.  An item that
    fits no empty bin in count or attention cost still gets a bin of its own.
    """
    scale = np.array(capacities, dtype=float)
    demand = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], 1) / scale
    weight = np.array(weights, dtype=float)
    residual = np.zeros((len(lengths), 3))
    fill = np.zeros(len(lengths), np.int64)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    smallest = demand.min(axis=0) if len(lengths) else None
    live = np.zeros(0, dtype=np.int64)
    count = 0
    for i in np.argsort(-lengths, kind="stable"):
        need = demand[i]
        left = residual[live]
        fits = np.flatnonzero((left + 1e-12 >= need).all(axis=1))
        if len(fits):
            after = left[fits] - need
            rank = (after**2 @ weight) if measure == "norm" else (left[fits] * need) @ weight
            chosen = live[fits[rank.argmin()]]
        else:
            chosen, count = count, count + 1
            residual[chosen] = 1.0
            live = np.append(live, chosen)
        residual[chosen] -= need
        bins[i], offsets[i] = chosen, fill[chosen]
        fill[chosen] += lengths[i]
        if (residual[chosen] + 1e-12 < smallest).any():
            live = live[live != chosen]
    return bins, offsets


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, max_documents: int | None = None, max_attention: float | None = None, measure: str = "norm", id_col: str = "doc_id", text_col: str = "text", items_per_group: int = ITEMS_PER_GROUP, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset[, ids] of each piece.

    ``max_documents`` and ``max_attention`` bound a sequence's pieces and the sum of
    their squared lengths; without them they are what ``capacity`` tokens can hold at most.
    """
    scratch = Scratch(documents.sparkSession, "pack")
    cut = scratch.save(pieces(documents, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    bounds = (float(capacity), float(max_documents or capacity), float(max_attention or capacity**2))
    short = cut.filter(F.col("length") < capacity)
    groups = max(1, -(-short.count() // items_per_group))
    keyed = short.select("serial", "length", F.pmod(F.xxhash64("serial"), F.lit(groups)).alias("group"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("serial").to_numpy())
        serial, length = (table.column(c).to_numpy()[order] for c in ("serial", "length"))
        bins, offsets = vector_best_fit(length, bounds, measure=measure)
        return pa.table({"serial": serial, "sequence_id": (np.int64(key[0].as_py()) << 32) + bins, "offset": offsets})

    # asked for by number, or small groups would be merged into a task or two
    placed = keyed.repartition(min(groups, _MOST_TASKS), "group").groupBy("group").applyInArrow(run, "serial long, sequence_id long, offset long")
    full = cut.filter(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.col("serial"), "offset": F.lit(0).cast("long")})
    done = short.join(placed, "serial").select(*full.columns).unionByName(full)
    return done.drop("serial").withColumnRenamed("id", id_col)
