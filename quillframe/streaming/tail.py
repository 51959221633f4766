"""Text that keeps coming: new files of a folder, as rows of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import Field
from ..sources.delimited import Dialect, cells_of, is_data
from ..functions import scalars as s


def tail_lines(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder)


def tail_records(spark: SparkSession, folder: str, spec: Sequence[Field], d: Dialect = Dialect(), **options) -> DataFrame:
    """Typed columns of each line, by index; a line that does not fit has nulls."""
    lines = tail_lines(spark, folder, **options).where(is_data(F.col("value"), d))
    cells = F.transform(cells_of(F.col("value"), d), lambda x: s.unquote(x, d.quote or '"'))
    rows = lines.select(cells.alias("cells"))
    return rows.select(*[f.value(F.try_element_at("cells", F.lit((k if f.index is None else f.index) + 1))).alias(f.name) for k, f in enumerate(spec)])
