"""Chat formatting, assembled at token level.

Every segment (a role, a text) is encoded by itself, so no token straddles a mark of the
template, and the marks are spliced in as reserved ids that no text can produce. The loss
mask is the prefix sum of +1 where an assistant's text begins and -1 where it ends. In
the rendered form the template's control strings are reserved too: where they occur in a
role or a text they are escaped, reversibly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.bpe import encoding

#: The template's marks, and the control strings of common templates.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
CONTROL = (TURN, BODY, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Reserved ids stand behind the vocabulary, in this order.
MARKS = (TURN, BODY, END)
LOSS_ROLE = "assistant"

_ESCAPE = re.compile("|".join([r"\\", *map(re.escape, sorted(CONTROL, key=len, reverse=True))]))
_UNESCAPE = re.compile(r"\\([\\:])")


def escape(text: str) -> str:
    """Doubles every backslash and puts ``\\:`` behind the first character of every control
    string, so the result holds none."""
    return _ESCAPE.sub(lambda m: r"\\" if m[0] == "\\" else f"{m[0][0]}\\:{m[0][1:]}", text)


def unescape(text: str) -> str:
    """The text that ``escape`` was given."""
    return _UNESCAPE.sub(lambda m: "\\" if m[1] == "\\" else "", text)


TURN_SCHEMA = "conv_id long, turn long, row_order string, input_ids binary, loss_mask binary, n_tokens long"


def format_turns(rows: DataFrame, vocabulary: str, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per turn: its ids (little-endian unsigned 32-bit) and its loss mask (a byte
    per id), TURN role BODY text END. Runs where the rows lie: nothing is shuffled, and a
    conversation that holds a large share of all rows is formatted by many tasks.

    A null role or text is empty. Only the text of ``loss_role``'s turns is under the mask.
    ``row_order`` tells repeated (conv_id, turn) apart by role and text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        first = max(enc.n_vocab, enc.max_token_value + 1)
        turn_id, body_id, end_id = range(first, first + len(MARKS))
        for batch in batches:
            conv, turn, roles, texts = (c.to_pylist() for c in batch.columns)
            ids, masks, sizes, order = [], [], [], []
            for role, text in zip(roles, texts, strict=True):
                role, text = role or "", text or ""
                a, b = enc.encode_ordinary(escape(role)), enc.encode_ordinary(escape(text))
                row = np.array([turn_id, *a, body_id, *b, end_id], dtype="<u4")
                steps = np.zeros(len(row) + 1, dtype=np.int8)
                if role == loss_role:
                    begin = len(a) + 2
                    steps[begin] += 1
                    steps[begin + len(b)] -= 1
                ids.append(row.tobytes())
                masks.append(np.cumsum(steps[:-1], dtype=np.int8).tobytes())
                sizes.append(len(row))
                order.append(hashlib.md5(f"{role}\0{text}".encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv, pa.int64()), pa.array(turn, pa.int64()), pa.array(order, pa.string()),
                 pa.array(ids, pa.binary()), pa.array(masks, pa.binary()), pa.array(sizes, pa.int64())],
                ["conv_id", "turn", "row_order", "input_ids", "loss_mask", "n_tokens"],
            )

    slim = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    return slim.mapInArrow(run, TURN_SCHEMA)


def assemble(turns: DataFrame) -> DataFrame:
    """The turns of each conversation in order, in one partition: sorted by turn (nulls
    first), then by ``row_order``. A conversation's sequence is the ids of its rows one after
    another; it is never put into one row, so its length has no bound."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return turns.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "row_order")


READ_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_tokens long, loss_tokens long"
)


def decode_turn(enc, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, str]:
    """(rendered, role, text, text under the mask) of one turn's ids; the last three unescaped."""
    first = max(enc.n_vocab, enc.max_token_value + 1)
    marks = np.flatnonzero(ids >= first)
    if ids[marks].tolist() != list(range(first, first + len(MARKS))) or marks[0] != 0 or marks[-1] != len(ids) - 1:
        raise ValueError("not one formatted turn")

    def words(part: np.ndarray) -> str:
        return enc.decode_bytes(part.tolist()).decode("utf-8", "surrogatepass")

    role, body = words(ids[1 : marks[1]]), words(ids[marks[1] + 1 : -1])
    under = words(ids[np.flatnonzero(mask)])
    return f"{TURN}{role}{BODY}{body}{END}", unescape(role), unescape(body), unescape(under)


def read_back(assembled: DataFrame, vocabulary: str) -> DataFrame:
    """A row per conversation, decoded from its ids and mask alone: number of turns, digest
    of role, newline, text, newline for each turn, code points and digest of the
    text under the mask, code points of the rendered form. Digests are fed turn by turn, so a
    task holds one turn at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        now, state, out = None, None, []

        def close() -> None:
            n, turns, chars, loss, rendered, tokens, masked = state
            out.append((now[0], n, turns.hexdigest(), chars, loss.hexdigest(), rendered, tokens, masked))

        for batch in batches:
            for conv, raw, bits in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if now != (conv,):
                    if now is not None:
                        close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                ids, mask = np.frombuffer(raw, dtype="<u4"), np.frombuffer(bits, dtype=np.int8)
                rendered, role, text, under = decode_turn(enc, ids, mask)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[2] += len(under)
                state[3].update(under.encode("utf-8", "surrogatepass"))
                state[4] += len(rendered)
                state[5] += len(ids)
                state[6] += int(mask.sum(dtype=np.int64))
            if len(out) >= 2000:
                yield _batch(out)
                out.clear()
        if now is not None:
            close()
        if out:
            yield _batch(out)

    return assembled.select("conv_id", "input_ids", "loss_mask").mapInArrow(run, READ_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in READ_SCHEMA.split(", ")), strict=True)
    kinds = [pa.int64() if k == "long" else pa.string() for k in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
