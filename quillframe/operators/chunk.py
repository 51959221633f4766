"""Records for language models: repaired text, and chunks under a budget of tokens."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import utf16_len

CHUNK = "chunk_no int, start_row bigint, end_row bigint, token_count bigint, content string"


def repair_text(c: Column, quote: str = '"', escape: str = "\\") -> Column:
    """Text as a model may give it: the inside of the first fence, without a dangling escape, with quotes in balance."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    fence = F.instr(text, "```")
    after = F.substring(text, fence + 3, F.length(text))
    line = F.instr(after, "\n")
    body = F.when(line > 0, F.substring(after, line + 1, F.length(after))).otherwise(F.lit(""))
    close = F.instr(body, "```")
    inner = F.when(close > 0, F.substring(body, F.lit(1), close - 1)).otherwise(body)
    text = F.regexp_replace(F.when(fence > 0, inner).otherwise(text), r"^\s+|\s+$", "")
    e, q = re.escape(escape), re.escape(quote)
    odd = F.length(F.regexp_extract(text, f"({e}*)$", 1)) % 2 == 1
    text = F.when(odd, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    bare = F.regexp_replace(text, f"{e}.", "")
    open_ = F.length(F.regexp_replace(bare, f"[^{q}]", "")) % 2 == 1
    return F.when(open_, F.concat(text, F.lit(quote + "\n"))).otherwise(text)


def sanitize_bytes(c: Column) -> Column:
    """Bytes as text, with a replacement sign for what is not UTF-8."""
    return F.make_valid_utf8(F.decode(c, "UTF-8"))


def tokens(text: Column) -> Column:
    """A quarter of the UTF-16 units, rounded up."""
    return F.ceil(utf16_len(text) / 4).cast("bigint")


def markdown_row(columns: Sequence[Column]) -> Column:
    cells = [F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]", " ") for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def template_row(template: str, columns: dict[str, Column]) -> Column:
    """``{name}`` in any case; unknown names and unclosed braces stay."""
    known, parts, at = {k.lower(): c for k, c in columns.items()}, [], 0
    for m in re.finditer(r"\{([^{}]*)\}", template):
        if m[1].lower() in known:
            parts += [F.lit(template[at : m.start()]), F.coalesce(known[m[1].lower()].cast("string"), F.lit(""))]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def _greedy(rows: Iterator[tuple[int, str, int]], budget: int, head: str, head_tokens: int, joiner: str) -> Iterator[tuple]:
    """Rows packed in order; a row over the budget is a chunk of its own."""
    no, start, end, now, held = 0, 0, 0, 0, []
    for number, text, size in rows:
        if held and now + size > budget:
            no += 1
            yield no, start, end, now, head + joiner.join(held)
            held, now = [], 0
        if not held:
            start, now = number, head_tokens
        held.append(text)
        now += size
        end = number
    if held:
        no += 1
        yield no, start, end, now, head + joiner.join(held)


def _json_greedy(rows: Iterator[tuple[int, str, int]], budget: int) -> Iterator[tuple]:
    """``[a,b]``: a running estimate, counted anew only where it passes the budget."""
    count = lambda held: -(-(sum(map(_units, held)) + len(held) + 1) // 4)
    no, start, end, now, held = 0, 0, 0, 0, []
    for number, text, _ in rows:
        guess = (_units(text) + 2) // 2
        if held and now + guess > budget:
            exact = count([*held, text])
            if exact > budget:
                no += 1
                yield no, start, end, count(held), "[" + ",".join(held) + "]"
                held, now = [], 0
            else:
                now = exact - guess
        if not held:
            start = number
        held.append(text)
        now = now + guess if len(held) > 1 else guess
        end = number
    if held:
        no += 1
        yield no, start, end, count(held), "[" + ",".join(held) + "]"


def _units(s: str) -> int:
    return len(s) + sum(c > "￿" for c in s)


def chunks(rows: DataFrame, text: Column, order: str, group: Sequence[str] = (), budget: int = 1000, head: str = "", joiner: str = "\n", kind: str = "text", count: Callable[[Column], Column] = tokens) -> DataFrame:
    """Chunks of the rows' texts, in order within each group. The fold runs over sorted rows as they stream by; one group at a
    time is open in a task, and of it one chunk."""
    size = count(F.concat(text, F.lit("\n")) if kind == "text" else text)
    head_tokens = -(-_units(head) // 4)
    base = rows.select(*group, F.col(order).cast("bigint").alias("_at"), text.alias("_text"), size.alias("_size"))
    base = (base.repartition(*group) if group else base.repartition(1)).sortWithinPartitions(*group, "_at")
    schema = ", ".join([*(f"{g} {dict(rows.dtypes)[g]}" for g in group), CHUNK])

    def run(batches):
        import pyarrow as pa
        from itertools import groupby

        kinds = None

        def stream():
            nonlocal kinds
            for b in batches:
                kinds = kinds or [b.schema.field(g).type for g in group]
                columns = [b.column(k).to_pylist() for k in range(b.num_columns)]
                yield from zip(*columns, strict=True)

        names = [*group, "chunk_no", "start_row", "end_row", "token_count", "content"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), [*kinds, *types], strict=True)], names=names)

        found = []
        for key, members in groupby(stream(), key=lambda r: r[: len(group)]):
            numbered = ((k, r[-2], r[-1]) for k, r in enumerate(members, 1))
            for c in _json_greedy(numbered, budget) if kind == "json" else _greedy(numbered, budget, head, head_tokens, joiner):
                found.append((*key, *c))
                if len(found) >= 1000:
                    yield out(found)
                    found = []
        if found:
            yield out(found)

    return base.mapInArrow(run, schema)


def markdown_chunks(rows: DataFrame, columns: Sequence[str], order: str, group: Sequence[str] = (), budget: int = 1000, repeat_header: bool = True) -> DataFrame:
    head = "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |\n"
    return chunks(rows, markdown_row([F.col(c) for c in columns]), order, group, budget, head if repeat_header else "")


def json_chunks(rows: DataFrame, columns: Sequence[str], order: str, group: Sequence[str] = (), budget: int = 1000) -> DataFrame:
    return chunks(rows, F.to_json(F.struct(*columns)), order, group, budget, kind="json")


def embed(texts: DataFrame, column: str, embedder: Callable[[list[str]], list[list[float]]], batch: int = 16) -> DataFrame:
    """Adds ``embedding``: the embedder gets so many texts at a time and must give as many vectors."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            values, out = b.column(column).to_pylist(), []
            for k in range(0, len(values), batch):
                part = values[k : k + batch]
                got = embedder(part)
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                out += got
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32()))], names=[*b.schema.names, "embedding"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.mapInArrow(run, f"{fields}, embedding array<float>")


def prompt(profile_lines: DataFrame, sample: DataFrame, columns: Sequence[str], question: str) -> str:
    """A card, a few rows and a question, for a model that the caller runs."""
    card = "\n".join(r.line for r in profile_lines.orderBy("line_no").collect())
    rows = "\n".join(r[0] for r in sample.limit(10).select(markdown_row([F.col(c) for c in columns])).collect())
    return f"{card}\n\n| {' | '.join(columns)} |\n{rows}\n\n{question}"
