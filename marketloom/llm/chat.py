"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: each turn is ``<turn>``, the role, a line feed, the
text and ``</turn>`` with a line feed.  Backslashes, and ``<turn`` or ``</turn`` inside
roles and texts, get a backslash in front (a role's line feed becomes ``\\n``), which
the reader takes away again.  The rendering is encoded once; the spans of assistant
texts and the spans of tokens are both sorted, so binary search finds the tokens of
each text.  A token carries loss if it holds part of an assistant text, and the part it
holds is kept as a character span, so a token across a border never leaks.

A conversation is the unit of work: its rows meet in one task, its rendering in one
string.  Defined results: a null text or role is empty; turns are ordered by (turn,
role, text), nulls first, so repeated and tied rows have a fixed order; rows with a
null id form one conversation; further columns, whatever their names, are not read; an
empty table gives an empty result.  Reading back keeps no state beyond the text, so a
conversation of millions of characters takes its own size a few times over.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPEN, _CLOSE = "<turn>", "</turn>\n"
_CONTROL = re.compile(r"\\|<(?=/?turn)")
# possessive throughout: no state is kept for a way back, so memory does not grow with a turn
_TURN = re.compile(r"<turn>((?:[^\\\n]++|\\.)*+)\n((?:[^\\<]++|\\.|<(?!/?turn))*+)</turn>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """The rendering and the (start, end, role) spans of the texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = _OPEN + escape(role).replace("\n", "\\n") + "\n"
        body = escape(text)
        spans.append((at + len(head), at + len(head) + len(body), role))
        parts += [head, body, _CLOSE]
        at += len(head) + len(body) + len(_CLOSE)
    return "".join(parts), spans


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns of a rendering; raises ValueError if it is not one."""
    turns, at = [], 0
    while at < len(rendered):
        m = _TURN.match(rendered, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m.group(1)), unescape(m.group(2))))
        at = m.end()
    return turns


def loss_parts(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Mask of the tokens that hold part of a span, and the merged character parts they hold.

    Spans are disjoint and sorted, and so are the starts and the ends of tokens.
    """
    mask = np.zeros(len(starts), dtype=bool)
    parts: list[tuple[int, int]] = []
    for a, b in spans:
        first, last = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(starts, b, side="left"))
        reached = None
        for s, e in zip(starts[first:last].tolist(), ends[first:last].tolist(), strict=True):
            s, e = max(s, a), min(e, b)
            if s >= e:
                continue
            if reached is not None and s <= parts[-1][1]:
                parts[-1] = (parts[-1][0], max(parts[-1][1], e))
            else:
                parts.append((s, e))
            reached = e
        mask[first:last] |= (np.minimum(ends[first:last], b) > np.maximum(starts[first:last], a))
    return mask, parts


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True  # control strings of the vocabulary are ordinary text here
    return made


def format_conversations(rows: DataFrame, tokenizer_path: str, loss_roles: tuple[str, ...] = ("assistant",), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id, formatted, token_ids, loss_mask (one 0 or 1 a token) and loss_spans of each conversation."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    whole = rows.groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    schema = whole.select(F.col("id").alias(id_col)).schema
    ints = T.ArrayType(T.IntegerType())
    schema = schema.add("formatted", "string").add("token_ids", ints).add("loss_mask", ints).add("loss_spans", T.ArrayType(ints))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                made = [render([(t["role"] or "", t["text"] or "") for t in turns]) for turns in part.column(1).to_pylist()]
                encoded = tokenizer.encode_batch([m[0] for m in made], add_special_tokens=False)
                ids, masks, spans = [], [], []
                for (_, marked), e in zip(made, encoded, strict=True):
                    offsets = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
                    mask, parts = loss_parts([(a, b) for a, b, role in marked if role in loss_roles and b > a], offsets[:, 0], offsets[:, 1])
                    ids.append(e.ids)
                    masks.append(mask.astype(np.int32))
                    spans.append([list(p) for p in parts])
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m[0] for m in made], pa.string()), pa.array(ids, ints), pa.array(masks, ints), pa.array(spans, pa.list_(ints))], names=schema.names)

    return whole.mapInArrow(run, schema)


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the output."""
    inputs = formatted.select(id_col, "formatted", "loss_spans")
    schema = formatted.select(id_col).schema.add("n_turns", "long").add("turns_sha256", "string").add("loss_chars", "long").add("loss_sha256", "string").add("formatted_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[a:b]) for a, b in spans)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append((len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], t) for i, t in enumerate(kinds))], names=schema.names)

    return inputs.mapInArrow(run, schema)
