"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions alone.

Tokens are summed by cell (source, language, topic). Targets are a table of weights (marginal, name, weight), or the marginals' shares to
a power below one, which lifts the small. Each round scales the cells to the targets of one marginal after the other, until what
the marginals miss is below a tolerance: a step sums the weights by name, and a cell's weight is its mass times the factors of its names. The fitted weights are then scaled so that a stated share of
all tokens is kept: cells whose probability would pass 1 are kept whole and the rest is scaled anew, so that a tiny cell does
not set the rate of the others. A hash of a document's id decides. Cells are summed, joined and counted as tables, however many
sources there are; the driver sees totals, and the names of marginals that have few. Cells are joined back by a plain join, which Spark broadcasts only where
it finds them small and splits where a source is large. The topic is worked out again for that join: the text is read anyway,
and writing it with its cell would cost the corpus once more.

Defined results: null source or language counts as an empty name; a null id as an empty one; documents of cells without tokens
are kept (probability 1); a name that a table of targets lacks has target 0, and its documents with tokens go; names that no document has
are passed over; targets that the cells cannot meet give a warning with what is missed, or an error (``strict``); rows that
repeat share their fate; an empty table gives no rows; other columns are kept by ``sample``, whatever their names.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Powers of the marginals' shares that make the targets; 1 keeps a marginal as it is.
POWERS = {"source": 0.8, "lang": 0.9, "topic": 0.95}
#: Rounds at most, and the share of all tokens that marginals may miss for the fit to end.
ROUNDS, TOLERANCE, SALT = 20, 1e-9, ":mix"
#: A marginal of no more names than this keeps its factors on the driver, a greater one as a table.
FEW = 10_000
#: No more cells than this are fitted in one task, so many rounds in a plan.
AT_ONCE, TOGETHER = 100_000, 5
#: The share of all tokens that a sample is expected to keep, and what it may miss of its targets without a warning.
KEEP, MISSED = 0.75, 1e-3
#: A topic is the first whose mark the text holds; callers may give a column of their own.
TOPICS = (("table", "|"), ("web", "http"), ("contact", "@"), ("markup", "###"))


def topic(text: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, mark in TOPICS:
        out = out.when(F.contains(text, F.lit(mark)), F.lit(name))
    return F.coalesce(out, F.lit("prose"))


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def chance(doc_id: Column) -> Column:
    """Uniform in [0, 1), from the id alone."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(SALT)).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


class _Marginal:
    """The names of one marginal with what they are to have and the factor of their cells: rows on the driver while few, else tables."""

    def __init__(self, name: str, wanted: DataFrame, total: float, few: int) -> None:
        self.name, self.spark, self.schema = name, wanted.sparkSession, wanted.schema
        wanted = written(wanted)
        n, every, least = wanted.agg(F.count("*"), F.sum("wanted"), F.min("wanted")).first()
        if total and not (every or 0) > 0 or (least or 0) < 0:
            raise ValueError(f"targets of {name} must be positive for some name that occurs, and not negative")
        self.few = n <= few
        targets = wanted.select(name, (F.col("wanted") / F.lit(float(every or 1)) * F.lit(total)).alias("target"), F.lit(1.0).alias("factor"))
        self.table_ = targets
        self.rows = {r[name]: (r.target, 1.0) for r in targets.collect()} if self.few else {}

    def table(self) -> DataFrame:
        """(name, factor)"""
        if not self.few:
            return self.table_.select(self.name, F.col("factor").alias(f"factor_{self.name}"))
        return self.spark.createDataFrame([(k, f) for k, (_, f) in self.rows.items()], f"{self.name} string, factor_{self.name} double")

    def scale(self, sums: DataFrame) -> float:
        """Sets the factors from the sums by name without them; gives what a name missed before at most."""
        if self.few:
            gaps = [0.0]
            for r in sums.collect():
                target, factor = self.rows[r[self.name]]
                gaps.append(abs(r.sum * factor - target))
                self.rows[r[self.name]] = target, target / r.sum if r.sum > 0 else 0.0
            return max(gaps)
        both = self.table_.join(sums, self.name)
        self.table_ = written(both.select(self.name, "target", F.when(F.col("sum") > 0, F.col("target") / F.col("sum")).otherwise(0.0).alias("factor"), F.abs(F.col("sum") * F.col("factor") - F.col("target")).alias("gap")))
        return float(self.table_.agg(F.max("gap")).first()[0] or 0)


def _weighted(cells: DataFrame, marginals: list[_Marginal]) -> DataFrame:
    weight = F.col("mass")
    for m in marginals:
        cells, weight = cells.join(m.table(), m.name), weight * F.col(f"factor_{m.name}")
    return cells.withColumn("weight", weight)


def _raked_at_once(cells: DataFrame, marginals: list[_Marginal], rounds: int, tolerance: float, total: float) -> tuple[DataFrame, float]:
    """The same rounds for cells that are known to be few: sums by window in one task, some rounds in a plan."""
    now, missed = cells, 0.0
    for m in marginals:
        now = now.join(m.table_.select(m.name, F.col("target").alias(f"target_{m.name}")), m.name)
    now = now.withColumn("weight", F.col("mass")).coalesce(1)
    for done in range(0, rounds, TOGETHER):
        for _ in range(min(TOGETHER, rounds - done)):
            for m in marginals:
                now = now.withColumn("sum", F.sum("weight").over(Window.partitionBy(m.name)))
                now = now.withColumn("gap" + m.name, F.abs(F.col("sum") - F.col(f"target_{m.name}"))).withColumn("weight", F.when(F.col("sum") > 0, F.col("weight") * F.col(f"target_{m.name}") / F.col("sum")).otherwise(0.0))
        now = written(now.drop("sum")).coalesce(1)
        gaps = now.agg(*[F.max("gap" + m.name) for m in marginals]).first()
        missed = max(float(x or 0) for x in gaps) / total if total else 0.0
        if missed <= tolerance:
            break
    return now.select(*[m.name for m in marginals], "mass", "weight"), missed


def rake(cells: DataFrame, powers: dict[str, float] = POWERS, targets: DataFrame | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE, few: int = FEW, at_once: int = AT_ONCE) -> tuple[DataFrame, float]:
    """cells (the marginals' columns and mass, over 0) with weight, and the share of the total that a name missed at most when it was last scaled."""
    total, n = cells.agg(F.coalesce(F.sum("mass"), F.lit(0.0)), F.count("*")).first()
    given = {r[0] for r in targets.select("marginal").distinct().limit(len(powers) + 1).collect()} if targets is not None else set()
    if not given <= set(powers):
        raise ValueError(f"targets of unknown marginals: {sorted(given - set(powers), key=str)}")
    marginals = []
    for k, power in powers.items():
        sums = cells.groupBy(k).agg(F.sum("mass").alias("own"))
        if k in given:
            own = targets.where(F.col("marginal") == k).groupBy(F.coalesce("name", F.lit("")).alias(k)).agg(F.sum("weight").cast("double").alias("wanted"))
            wanted = sums.join(own, k, "left").select(k, F.coalesce("wanted", F.lit(0.0)).alias("wanted"))
        else:
            wanted = sums.select(k, F.pow("own", F.lit(power)).alias("wanted"))
        marginals.append(_Marginal(k, wanted, total, few))
    if n <= at_once:
        return _raked_at_once(cells, marginals, rounds, tolerance, total)
    missed = 0.0
    for _ in range(rounds):
        gaps = [m.scale(_weighted(cells, [x for x in marginals if x is not m]).groupBy(m.name).agg(F.sum("weight").alias("sum"))) for m in marginals]
        missed = max(gaps, default=0.0) / total if total else 0.0
        if missed <= tolerance:
            break
    return _weighted(cells, marginals).select(*powers, "mass", "weight"), missed


def fitted(cells: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, keep: float = KEEP, targets: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """The marginals' columns with probability: that keep this share of the mass, in the proportions of the targets."""
    out, missed = rake(cells, powers, targets, rounds)
    if missed > MISSED:
        text = f"the cells miss their targets by up to {missed:.2%} of all tokens"
        if strict:
            raise ValueError(text)
        warnings.warn(text, stacklevel=2)
    # with some cells kept whole, the rest's scale; it grows with each cell that has to be whole, until none has
    factor, scale, total = F.col("weight") / F.col("mass"), 0.0, None
    while True:
        whole = factor * F.lit(scale) >= 1
        mass, of_whole, rest = out.agg(F.sum("mass"), F.sum(F.when(whole, F.col("mass")).otherwise(0.0)), F.sum(F.when(whole, 0.0).otherwise(F.col("weight")))).first()
        total = total or float(mass or 0)
        more = (keep * total - of_whole) / rest if total and rest else scale
        if more <= scale * (1 + 1e-12):  # sums of the same rows may differ in their last digits
            break
        scale = more
    return out.select(*powers, F.least(F.lit(1.0), factor * F.lit(scale)).alias("probability"))


def _cell(docs: DataFrame, text: str, of_topic: Column | None) -> list[Column]:
    return [F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), (topic(F.col(text)) if of_topic is None else F.coalesce(of_topic.cast("string"), F.lit(""))).alias("topic")]


def _cells(rows: DataFrame, powers: dict[str, float]) -> DataFrame:
    return written(rows.groupBy(*powers).agg(F.sum("tokens").cast("double").alias("mass")).where("mass > 0"))


def probabilities(docs: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, keep: float = KEEP, targets: DataFrame | None = None, of_topic: Column | None = None, strict: bool = False) -> DataFrame:
    """doc_id, tokens, probability, selected of every row."""
    rows = written(docs.select("doc_id", *_cell(docs, "text", of_topic), tokens(F.col("text")).alias("tokens")))
    out = rows.join(written(fitted(_cells(rows, powers), powers, rounds, keep, targets, strict)), list(powers), "left").withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    return out.select("doc_id", "tokens", F.round("probability", 6).alias("probability"), (chance(F.col("doc_id")) < F.col("probability")).alias("selected"))


def free_name(name: str, columns: list[str]) -> str:
    """The name, with underscores before it as long as a column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def sample(docs: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, keep: float = KEEP, targets: DataFrame | None = None, of_topic: Column | None = None, strict: bool = False) -> DataFrame:
    """The chosen documents, all columns, with that share of the tokens to be expected."""
    rows = written(docs.select(*_cell(docs, "text", of_topic), tokens(F.col("text")).alias("tokens")))
    cell, share = free_name("__cell", docs.columns), free_name("__probability", docs.columns)
    cells = written(fitted(_cells(rows, powers), powers, rounds, keep, targets, strict)).select(F.struct(*[k for k in ("source", "lang", "topic") if k in powers]).alias(cell), F.col("probability").alias(share))
    joined = docs.withColumn(cell, F.struct(*[c for k, c in zip(("source", "lang", "topic"), _cell(docs, "text", of_topic), strict=True) if k in powers])).join(cells, cell, "left")
    return joined.where(chance(F.col("doc_id")) < F.coalesce(share, F.lit(1.0))).select(*docs.columns)


def op4_query(spark, sf_dir: str) -> DataFrame:
    return probabilities(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(powers: dict[str, float] = POWERS, rounds: int = ROUNDS, keep: float = KEEP) -> str:
    """The same in DuckDB SQL."""
    marks = " ".join(f"WHEN contains(text, '{mark}') THEN '{name}'" for name, mark in TOPICS)
    out = [
        f"d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {marks} ELSE 'prose' END AS topic, coalesce(length(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens FROM documents)",
        "c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS mass, sum(tokens)::DOUBLE AS weight FROM d GROUP BY ALL HAVING sum(tokens) > 0)",
    ]
    for k in powers:
        out.append(f"m_{k} AS (SELECT {k}, pow(sum(mass), {powers[k]}) AS lifted FROM c GROUP BY {k})")
        out.append(f"t_{k} AS (SELECT {k}, lifted / (SELECT sum(lifted) FROM m_{k}) * (SELECT sum(mass) FROM c) AS target_{k} FROM m_{k})")
    out.append(f"r0 AS (SELECT * FROM c {' '.join(f'JOIN t_{k} USING ({k})' for k in powers)})")
    step = 0
    for _ in range(rounds):
        for k in powers:
            step += 1
            out.append(f"r{step} AS MATERIALIZED (SELECT * REPLACE (weight * target_{k} / sum(weight) OVER (PARTITION BY {k}) AS weight) FROM r{step - 1})")
    # with the cells of the greatest factors kept whole, the rest's scale; with one too many or too few kept whole, it is less than the right one
    out.append(f"g AS (SELECT source, lang, topic, mass, weight, weight / mass AS factor, coalesce(sum(mass) OVER (ORDER BY weight / mass DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS whole, sum(weight) OVER (ORDER BY weight / mass DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r{step})")
    out.append(f"f AS (SELECT source, lang, topic, least(1.0, factor * (SELECT max(({keep} * (SELECT sum(mass) FROM g) - whole) / rest) FROM g)) AS probability FROM g)")
    u = f"(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '{SALT}'), 1, 8))::UBIGINT)::DOUBLE / 4294967296"
    return f"WITH {', '.join(out)} SELECT doc_id, tokens, round(coalesce(probability, 1.0), 6) AS probability, {u} < coalesce(probability, 1.0) AS selected FROM d LEFT JOIN f USING (source, lang, topic)"
