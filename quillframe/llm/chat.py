"""Chat formatting by columnar byte assembly.

A turn becomes ``### role: text</turn>`` and a line break; ``\\``, ``#``, ``<`` (and ``:`` in a role) get a backslash before
them, so no text can hold a mark and all texts can be had back. For a batch of turns, the lengths of all segments, their cumulative
offsets and the places of every byte are computed in numpy, and headers and contents are copied into one preallocated Arrow
buffer. The loss mask is a list of code-point ranges: the assistant's texts without marks.

Defined results: null texts and roles are empty; turns go by turn (null first), then role, then text; a null conv_id is a
conversation of its own; repeated rows are turns of their own; other columns are ignored. A conversation is one string, as
its readers need, so its own size is the bound of a task's memory; the rows of all others pass by in batches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t
from .fm import interval_rows

HEAD, MIDDLE, TAIL = b"### ", b": ", b"</turn>\n"
LEARNED_ROLE = "assistant"
PROBE = "\\### Assistant: </turn> ok"
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<])*)</turn>\n", re.S)


def _escaped(data: np.ndarray, offsets: np.ndarray, special: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the rows with a backslash before each special byte."""
    mark = np.isin(data, np.frombuffer(special, np.uint8))
    before = np.concatenate([[0], np.cumsum(mark)])
    out = np.full(len(data) + before[-1], 0x5C, np.uint8)
    out[np.arange(len(data)) + before[1:]] = data
    return out, offsets + before[offsets]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of all turns, the turns' offsets in them, and first and last byte of each turn's text."""
    role, role_at = _escaped(*t.text_buffers(roles), b"\\#<:")
    text, text_at = _escaped(*t.text_buffers(texts), b"\\#<")
    role_n, text_n = np.diff(role_at), np.diff(text_at)
    length = len(HEAD) + role_n + len(MIDDLE) + text_n + len(TAIL)
    at = np.concatenate([[0], np.cumsum(length)])
    out = np.empty(at[-1], np.uint8)

    def put(place: np.ndarray, what: bytes) -> None:
        out[place[:, None] + np.arange(len(what))] = np.frombuffer(what, np.uint8)

    role_to = at[:-1] + len(HEAD)
    text_to = role_to + role_n + len(MIDDLE)
    put(at[:-1], HEAD)
    put(role_to + role_n, MIDDLE)
    put(text_to + text_n, TAIL)
    for source, source_at, to, n in ((role, role_at, role_to, role_n), (text, text_at, text_to, text_n)):
        out[interval_rows(to, to + n)[1]] = source[source_at[0] : source_at[-1]]
    return out, at, text_to, text_to + text_n


def _format(kind: pa.DataType):
    spans = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            conv, role = rows.column("conv_id"), rows.column("role").combine_chunks()
            data, at, first, last = assemble(role, rows.column("text").combine_chunks())
            number, empty = conv.to_numpy(), np.asarray(conv.is_null())
            number = np.where(empty, 0, np.nan_to_num(number)).astype(np.int64)
            new = np.concatenate([[0], np.flatnonzero((number[1:] != number[:-1]) | (empty[1:] != empty[:-1])) + 1])
            edge = np.concatenate([new, [len(number)]])
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            learned = np.flatnonzero(np.asarray(pa.compute.fill_null(pa.compute.equal(role, LEARNED_ROLE), False)))
            base = points[at[edge[np.searchsorted(edge, learned, "right") - 1]]]
            ranges = pa.StructArray.from_arrays([pa.array(points[first[learned]] - base), pa.array(points[last[learned]] - base)], names=["first", "last"])
            formatted = pa.LargeStringArray.from_buffers(len(new), pa.py_buffer(at[edge].astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
            loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(learned, edge), pa.int32()), ranges)
            return pa.RecordBatch.from_arrays([conv.take(pa.array(new)).combine_chunks(), formatted, loss.cast(spans)], names=["conv_id", "formatted", "loss"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column("conv_id").to_pylist()
            cut = len(conv) - 1
            while cut > 0 and conv[cut - 1] == conv[-1]:
                cut -= 1
            if held and (cut or held[-1].column("conv_id")[-1].as_py() != conv[0]):
                yield out(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            elif cut:
                yield out(pa.Table.from_batches([b.slice(0, cut)]))
            held.append(b.slice(cut) if cut else b)
        if held:
            yield out(pa.Table.from_batches(held))

    return run


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, loss (ranges of code points) of every conversation."""
    rows = turns.select(F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(_format(pa.int64()), "conv_id bigint, formatted string, loss array<struct<first:bigint,last:bigint>>")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    out, at, plain = [], 0, lambda s: re.sub(r"\\(.)", r"\1", s, flags=re.S)
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((plain(m[1]), plain(m[2])))
        at = m.end()
    return out


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of what the formatted strings and the loss ranges hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for formatted, loss in zip(b.column("formatted").to_pylist(), b.column("loss").to_pylist(), strict=True):
                turns = parse(formatted)
                learned = "".join(re.sub(r"\\(.)", r"\1", formatted[x["first"] : x["last"]], flags=re.S) for x in loss)
                rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{s}\n" for r, s in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted)))
            n, turns_sha, chars, loss_sha, size = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(n, pa.int64()), pa.array(turns_sha, pa.string()), pa.array(chars, pa.int64()), pa.array(loss_sha, pa.string()), pa.array(size, pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op3_query(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_chats(turns.unionByName(probe)))


OP3_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')))::BIGINT AS formatted_chars
FROM rows_ GROUP BY conv_id
"""
