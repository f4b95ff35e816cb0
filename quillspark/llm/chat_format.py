"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: the template over all turns up
to it, with a loss mask over that reply alone.  Turns after the last reply (or a
conversation without one) are kept in a closing row without loss, so the output
holds every turn.

Template: ``<|turn|>role<|text|>text</s>``.  Inside roles and texts the characters
``<``, ``[`` and ``\\`` are followed by a backslash, so no control string
(``<|..|>``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) can appear in them, and
taking that backslash away restores them.

Conversations are streamed in turn order, so a conversation of any length is never
held as rows; the text so far is, since each example repeats it.

Defined cases: null text or role is empty; a null turn comes first; rows of one
turn are ordered by role and text, and all kept; null conv_ids are one
conversation; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

_TURN, _TEXT, _END = "<|turn|>", "<|text|>", "</s>"
_EXAMPLE = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("turn", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("last", pa.bool_())])
_EXAMPLE_SQL = "conv_id long, example long, turn long, text string, loss_start long, loss_end long, last boolean"


def escape(text: str) -> str:
    return re.sub(r"([<\[\\])", r"\1\\", text)


def unescape(text: str) -> str:
    return re.sub(r"([<\[\\])\\", r"\1", text)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    out = []
    for part in formatted.split(_TURN)[1:]:
        role, _, rest = part.partition(_TEXT)
        out.append((unescape(role), unescape(rest[: -len(_END)])))
    return out


def _expand(batches):
    rows, size = [], 0
    conv, some = None, False
    text, length, turn, number, pending = [], 0, None, 0, None

    def flush():
        nonlocal rows, size
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_EXAMPLE)], schema=_EXAMPLE)
        rows, size = [], 0
        return out

    def close():
        """The conversation's last row: its last example, or the turns after it."""
        nonlocal pending, size
        if pending and pending[5] + len(_END) == length:
            rows.append((*pending, True))
        else:
            if pending:
                rows.append((*pending, False))
            rows.append((conv, number, turn, "".join(text), -1, -1, True))
        size += length
        pending = None

    for b in batches:
        for c, t, role, said in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if some and c != conv:
                close()
                text, length, number = [], 0, 0
            conv, some, turn = c, True, t
            head, body = f"{_TURN}{escape(role)}{_TEXT}", escape(said)
            text.append(head + body + _END)
            start = length + len(head)
            length += len(text[-1])
            if role == "assistant":
                if pending:
                    rows.append((*pending, False))
                    size += len(pending[3])
                text = ["".join(text)]
                pending = (conv, number, t, text[0], start, start + len(body))
                number += 1
            if size > 1 << 22:
                yield flush()
    if some:
        close()
    if rows:
        yield flush()


def chat_examples(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, example, turn, text, loss_start, loss_end, last); offsets in code points."""
    bounded_batches(df.sparkSession)
    rows = df.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_expand, _EXAMPLE_SQL)


_PART = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("loss", pa.string()), ("chars", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string())])


def _parts(batches):
    for b in batches:
        out = {k: [] for k in _PART.names}
        for conv, number, text, a, z, last in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            digest, n = None, None
            if last:
                turns = turns_of(text)
                n, digest = len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
            for k, v in zip(_PART.names, (conv, number, unescape(text[a:z]) if a >= 0 else "", len(text), n, digest), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _PART], schema=_PART)


_SUM = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())])


def _sums(batches):
    """Parts in (conv_id, example) order -> one row per conversation, by running digests."""
    rows, some, conv = [], False, None
    for b in batches:
        for c, _, loss, chars, n, digest in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if not some or c != conv:
                if some:
                    rows.append((conv, turns, sha, loss_chars, run.hexdigest(), total, count))
                conv, some, run, loss_chars, total, count = c, True, hashlib.sha256(), 0, 0, 0
            run.update(loss.encode())
            loss_chars, total, count = loss_chars + len(loss), total + chars, count + 1
            if n is not None:
                turns, sha = n, digest
        if len(rows) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SUM)], schema=_SUM)
            rows = []
    if some:
        rows.append((conv, turns, sha, loss_chars, run.hexdigest(), total, count))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SUM)], schema=_SUM)


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of the turns, the loss text and the sizes, from the examples alone."""
    parts = examples.select("conv_id", "example", "text", "loss_start", "loss_end", "last").mapInArrow(_parts, "conv_id long, example long, loss string, chars long, n_turns long, turns_sha256 string")
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "example").mapInArrow(_sums, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")
