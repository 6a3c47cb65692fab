"""Vectorised byte-level text kernels shared by the operators of this subpackage.

All kernels run inside Arrow batches of Spark tasks.  A batch is cut into
document-aligned blocks of about ``BLOCK`` bytes, so that temporary arrays stay
small whatever the batch or document size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK = 1 << 20

_U = np.uint64
#: (prime, base) of the two polynomials of a span's hash.
_FIELDS = ((2_147_483_647, 1_181_783_497), (2_147_483_629, 1_540_483_477))
_LONG = 4096  # longer spans are hashed one by one

#: A-Z lowered, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes 0x09-0x0D and 0x20.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: ASCII letters and digits and every byte of a non-ASCII character.
WORDLIKE = np.zeros(256, dtype=bool)
WORDLIKE[48:58] = WORDLIKE[65:91] = WORDLIKE[97:123] = WORDLIKE[128:] = True

#: Non-ASCII characters that are no letter, mark or digit, and scripts written without spaces (RE2).
_NO_WORD = r"[^\x00-\x7F\p{L}\p{M}\p{N}]+"
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def spaced(column: pa.Array) -> pa.Array:
    """Lower-cased texts in which ``wordlike`` words are runs of letters, marks and digits.

    Other non-ASCII characters become spaces, and each character of a script that is
    written without spaces becomes a word.
    """
    column = pc.replace_substring_regex(pc.utf8_lower(column), _NO_WORD, " ")
    if pc.any(pc.match_substring_regex(column, _UNSPACED)).as_py():
        column = pc.replace_substring_regex(column, _UNSPACED, r" \1 ")
    return column


def _powers(field: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo the prime of a field for i < n, in 32 bits; as many as a block of some power of two takes."""
    if field not in _tables or len(_tables[field][0]) < n:
        prime, base = _FIELDS[field]
        n = 1 + (1 << max(n - 2, 0).bit_length())
        made = []
        for b in (base, pow(base, -1, prime)):
            table, step = np.ones(1, _U), b
            while len(table) < n:  # doubling: table[i + len] = table[i] * base**len
                table = np.concatenate([table, table[: n - len(table)] * _U(step) % _U(prime)])
                step = step * step % prime
            made.append(table.astype(np.uint32))
        _tables[field] = (made[0], made[1])
    return _tables[field]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting: faster here than a hash table."""
    if not len(values):
        return values
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


def turned(serial: int, choices: int) -> int:
    """A number below ``choices`` that follows from a serial number."""
    return (serial * 0x9E3779B1 & 0xFFFFFFFF) * choices >> 32


def string_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (n+1) of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of document-aligned blocks; every row is in one."""
    data, offsets = string_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def segments(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, none of which crosses a document's border."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    border = offsets[1:-1]
    border = border[border < len(inside)]
    start[border] |= inside[border]
    end = np.zeros(len(inside) + 1, dtype=bool)
    end[1:] = inside
    end[1:-1] &= ~inside[1:]
    end[border] |= (border > 0) & inside[border - 1]
    return np.flatnonzero(start), np.flatnonzero(end)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span.

    Two polynomials over prime fields, from prefix sums; long spans by XXH3.  (Modulo a
    power of two some short texts would collide whatever the base.)
    """
    value = (ends - starts).astype(_U)
    for field, (prime, _) in enumerate(_FIELDS):
        power, inverse = _powers(field, len(data) + 1)
        prefix = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)], out=prefix[1:])  # may wrap; the differences of short spans do not
        part = (prefix[ends] - prefix[starts]) % _U(prime) * inverse[starts] % _U(prime)
        value = mix64(value * _U(0xD6E8FEB86659FD93) + part)
    for i in np.flatnonzero(ends - starts > _LONG).tolist():
        value[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return value


def words(data: np.ndarray, offsets: np.ndarray, wordlike: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the word offsets (n+1) of the documents.

    Words are runs of bytes that are not white space, A-Z lowered; with
    ``wordlike`` runs of ASCII letters and digits and of non-ASCII bytes (see ``spaced``).
    """
    inside = WORDLIKE[data] if wordlike else ~SPACE[data]
    starts, ends = segments(inside, offsets)
    return span_hashes(LOWER[data], starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-word shingle hashes and offsets; a shorter document has its whole sequence as one."""
    n = np.diff(offsets)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_offsets = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    first = offsets[doc] + np.arange(len(doc)) - out_offsets[doc]
    size = np.minimum(n, k)[doc]
    value = size.astype(_U)
    padded = np.concatenate([hashes, np.zeros(k, _U)])
    for j in range(k):
        value = np.where(j < size, mix64(value * _U(0xD6E8FEB86659FD93) + padded[first + j]), value)
    return value, out_offsets


def sum_by_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``values`` between consecutive offsets; 0 for empty documents."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), dtype=np.float64)
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        out[filled] = np.add.reduceat(values, offsets[filled], axis=0, dtype=np.float64)
    return out
