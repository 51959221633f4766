"""Files that mix several kinds of record, told apart by one column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import Bound, Field, HeaderError, bind, field_errors, parsed


class Routed:
    """One kind of record for each tag; rows of no kind are skipped, or fail."""

    def __init__(self, cells: DataFrame, tag: int | str, kinds: dict[str, Sequence[Field]], header: Sequence[str] | None = None, ignore_case: bool = False, unmatched: str = "skip", **binding) -> None:
        if isinstance(tag, str):
            same = (lambda a, b: a.lower() == b.lower()) if ignore_case else (lambda a, b: a == b)
            if header is None or not any(same(h, tag) for h in header):
                raise HeaderError(f"no column {tag} in the header")
            tag = next(i for i, h in enumerate(header) if same(h, tag))
        if unmatched not in ("skip", "throw"):
            raise ValueError("unmatched is skip or throw")
        text = F.try_element_at("cells", F.lit(tag + 1))
        self.tag = F.lower(text) if ignore_case else text
        self.kinds = {k.lower() if ignore_case else k: v for k, v in kinds.items()}
        self.header, self.binding, self.cells = header, binding, cells
        if unmatched == "throw":  # in the tag itself, which every row's filter asks for
            failed = F.raise_error(F.concat(F.lit("no kind for row "), F.col("row_number").cast("string"))).cast("string")
            self.tag = F.when(F.coalesce(self.tag.isin(*self.kinds), F.lit(False)), self.tag).otherwise(failed)

    def of(self, tag: str) -> Bound:
        """The records of one kind, typed and checked."""
        return bind(self.cells.where(self.tag == tag), self.kinds[tag], self.header, keep=["row_number"], **self.binding)

    def unmatched(self) -> DataFrame:
        return self.cells.where(~F.coalesce(self.tag.isin(*self.kinds), F.lit(False)))

    def together(self) -> DataFrame:
        """row_number, tag and one struct a kind (null for the others), in one pass: order is kept by row_number, rows in error are left out."""
        source = "raw" if self.binding.get("raw_quotes") and "raw" in self.cells.columns else "cells"
        options = {k: v for k, v in self.binding.items() if k in ("allow_missing", "nulls", "trim")}
        places, parts = {}, []
        for n, (k, spec) in enumerate(self.kinds.items()):
            places[k], texts, values = parsed(source, spec, self.header, **options)
            mine = F.col("_tag") == k
            parts += [F.when(mine, texts).alias(f"t{n}"), F.when(mine, values).alias(f"v{n}")]
        opaque = F.when(F.monotonically_increasing_id() >= 0, F.struct(*parts))
        rows = self.cells.select("row_number", source, self.tag.alias("_tag")).where(F.col("_tag").isin(*self.kinds)).select("row_number", "_tag", opaque.alias("_p"))
        errors = F.lit(False)
        out = []
        for n, (k, spec) in enumerate(self.kinds.items()):
            mine = F.col("_tag") == k
            errors = errors | (mine & (F.size(field_errors(spec, places[k], f"_p.t{n}", f"_p.v{n}")) > 0))
            out.append(F.when(mine, F.struct(*[F.col(f"_p.v{n}.c{i}").alias(f.name) for i, f in enumerate(spec)])).alias(k))
        return rows.where(~errors).select("row_number", F.col("_tag").alias("tag"), *out)


def tag_counts(cells: DataFrame, tag: Column) -> DataFrame:
    return cells.groupBy(tag.alias("tag")).agg(F.count("*").alias("n"))
