"""Chat formatting by columnar byte assembly.

A turn is written as  <s>[INST] role [/INST] text </s>  without the blanks shown: control strings mark where role and
text begin and end. Inside roles and texts a backslash is doubled and one is put into every control string after its
first letter, so no text can end a turn and unescaping gives back exactly what went in. Whole columns of texts become
bytes at once: segment lengths, cumulative offsets and scatter indices are computed in numpy, and headers and contents
are copied into one preallocated Arrow buffer.

Null role or text: empty. Turns of a conversation are ordered by (turn, role, text), nulls first; repeated rows stay.
The loss mask covers the texts of assistant turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Control strings of the template, in the order written (fixed values).
OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
CONTROLS = ["</s>", "<s>", "[/INST]", "[INST]"]
LEARNED = "assistant"

SCHEMA = "conv_id long, n_turns long, formatted string, loss_start array<long>, loss_end array<long>"


def escape(texts: pa.Array) -> pa.Array:
    out = pc.replace_substring(texts, "\\", "\\\\")
    for c in CONTROLS:
        out = pc.replace_substring(out, c, c[0] + "\\" + c[1:])
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, start, length) of a large_string array without nulls."""
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and a.buffers()[2].size else np.empty(0, np.uint8)
    return data, offsets[:-1], np.diff(offsets)


def assemble(columns: list[pa.Array]) -> tuple[pa.Buffer, np.ndarray]:
    """Rows made of one segment from each column, one after another, in one buffer; and the offsets of the rows."""
    parts = [_bytes(c.cast(pa.large_string())) for c in columns]
    lengths = np.stack([p[2] for p in parts], axis=1)  # rows x segments
    starts = np.concatenate(([0], np.cumsum(lengths.ravel())))
    total = int(starts[-1])
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    at = starts[:-1].reshape(lengths.shape)
    for j, (data, begin, length) in enumerate(parts):
        within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(at[:, j], length) + within] = data[np.repeat(begin, length) + within]
    return buffer, starts[:: len(columns)]


def _turns(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted turns, and the code points before and in the text of each."""
    n = batch.num_rows
    role, text = escape(batch.column(2)), escape(batch.column(3))
    same = lambda s: pa.array([s] * n, pa.string())
    buffer, offsets = assemble([same(OPEN), role, same(MIDDLE), text, same(CLOSE)])
    turns = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), buffer])
    before = np.asarray(pc.utf8_length(role)) + len(OPEN) + len(MIDDLE)
    return turns, before, np.asarray(pc.utf8_length(text))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted text, and the loss mask as code point spans of it.

    turns: conv_id, turn, role, text. Rows are dealt by conv_id and sorted; a conversation is put together while its
    turns stream by, so a task holds one conversation and one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, pieces, chars, count, masks, done = None, [], 0, 0, [], []

        def ended() -> tuple:
            return conv, count, "".join(pieces), [m[0] for m in masks], [m[1] for m in masks]

        for batch in batches:
            if not batch.num_rows:
                continue
            formatted, before, inside = _turns(batch)
            whole = np.asarray(pc.utf8_length(formatted))
            for i, (c, role, piece) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), formatted.to_pylist(), strict=True)):
                if count and c != conv:
                    done.append(ended())
                    pieces, chars, count, masks = [], 0, 0, []
                conv = c
                if role == LEARNED:
                    masks.append((chars + int(before[i]), chars + int(before[i] + inside[i])))
                pieces.append(piece)
                chars += int(whole[i])
                count += 1
            if len(done) >= 500:
                yield rows(done)
                done = []
        if count:
            done.append(ended())
        if done:
            yield rows(done)

    def rows(done: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "formatted", "loss_start", "loss_end"])

    dealt = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    )
    return dealt.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SCHEMA)


_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(CLOSE), re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Digests of turns and loss text, read back from the formatted text and its mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for conv, _, text, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = read_back(text)
                whole = hashlib.sha256()
                for role, said in turns:
                    whole.update(f"{role}\n{said}\n".encode())
                learned = "".join(unescape(text[a:b]) for a, b in zip(start, end, strict=True))
                out.append((conv, len(turns), whole.hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
