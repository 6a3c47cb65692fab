"""What a Python worker keeps from one operator's task to the next."""

import numpy as np
import pyarrow as pa

from marketloom.llm import packing, textcore, workers
from marketloom.llm.queries import tokenizer_path


def test_chunks_live_until_another_operator_begins():
    tokenizer = packing.chunk_tokenizer(tokenizer_path())
    list(tokenizer.encode(pa.array(["a chunk or two", None, ""])))
    same = list(workers.tidy(lambda batches: batches, "packing")(iter([1, 2])))
    assert same == [1, 2] and packing.chunk_tokenizer(tokenizer_path()) is tokenizer
    assert list(workers.tidy(lambda batches: batches, "near_dedup")(iter([3]))) == [3]
    assert not packing._tokenizers


def test_power_tables_are_as_long_as_a_block_and_of_32_bits():
    textcore._tables.clear()
    data = np.full(1 << 12, 97, np.uint8)
    starts = np.array([0, 5, 4000])
    textcore.span_hashes(data, starts, starts + 7)
    assert all(t.dtype == np.uint32 and len(t) == (1 << 12) + 1 for pair in textcore._tables.values() for t in pair)
    for field, (prime, base) in enumerate(textcore._FIELDS):
        power, inverse = textcore._tables[field]
        assert [int(power[i]) for i in (0, 1, 4096)] == [1, base, pow(base, 4096, prime)]
        assert int(power[4096]) * int(inverse[4096]) % prime == 1


def test_known_chunks_take_little_memory_and_equal_hashes_are_told_apart(monkeypatch):
    texts = pa.array([" ".join(f"w{i * 7919 % 100_003}" for i in range(a, a + 500)) for a in range(0, 30_000, 250)])
    tokenizer = packing.ChunkTokenizer(tokenizer_path())
    plain = [tokenizer.tokenizer.encode(x, add_special_tokens=False).ids for x in texts.to_pylist()]

    def encoded(column):
        return [ids[a:b].tolist() for _, _, ids, at in tokenizer.encode(column) for a, b in zip(at[:-1], at[1:], strict=True)]

    assert encoded(texts) == plain and encoded(texts) == plain
    held = sum(x.nbytes for x in vars(tokenizer).values() if isinstance(x, np.ndarray)) - tokenizer.token_bytes.nbytes
    assert tokenizer.known > 20_000 and held < 120 * tokenizer.known and not any(isinstance(x, dict) for x in vars(tokenizer).values())
    tokenizer._clear()
    hashes = textcore.span_hashes
    monkeypatch.setattr(textcore, "span_hashes", lambda *spans: hashes(*spans) % np.uint64(50))
    few = texts.slice(0, 6)
    assert encoded(few) == plain[:6] and encoded(texts.slice(3, 6)) == plain[3:9]
