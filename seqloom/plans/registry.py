"""The registry of queries and their SQL.

:func:`sql` registers a query said once: the text reads base tables and grains
(:mod:`seqloom.operators.grain`), which are views in Spark and common table
expressions for the oracle.  :func:`query` registers a function beside its own SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqloom.operators.grain import GRAINS, NEEDS, TABLES

Query = Callable[[SparkSession, str], DataFrame]

SPREAD_BYTES = 1 << 20
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: query -> the inventory rows it covers
COVERS: dict[str, tuple[str, ...]] = {}


def _grains(text: str) -> list[str]:
    """The grains that a text reads, each after those it is made of."""
    out: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, ()):
            add(other)
        if name not in out:
            out.append(name)

    for name in GRAINS:
        if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.I):
            add(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table.  One that its files would leave to fewer tasks than there are cores is
    dealt to all of them; where the input has at least as many parts, nothing is moved."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plan, cores = df._jdf.queryExecution(), spark.sparkContext.defaultParallelism
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) >= SPREAD_BYTES and plan.toRdd().getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Temporary views of the base tables and grains that a text reads."""
    own = _grains(text)
    every = text + " ".join(GRAINS[g][0] for g in own)
    for t in TABLES:
        if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", every, re.I):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    for g in own:
        spark.sql(GRAINS[g][0]).createOrReplaceTempView(g)


def oracle_text(text: str) -> str:
    """The text with its grains as common table expressions."""
    own = _grains(text)
    if not own:
        return text
    parts = ", ".join(f"{g} AS ({GRAINS[g][1]})" for g in own)
    text = text.strip()
    return f"WITH {parts}, {text[4:].strip()}" if text[:4].upper() == "WITH" else f"WITH {parts} {text}"


def sql(name: str, covers: str, text: str, spark_text: str | None = None, oracle: str | None = "") -> None:
    """Register a query by SQL; ``spark_text`` and ``oracle`` only where a dialect needs its own."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, spark_text or text)
        return spark.sql(spark_text or text)

    run.__name__ = name
    run.__doc__ = text
    QUERIES[name], COVERS[name] = run, tuple(covers.split())
    if oracle is not None:
        ORACLES[name] = oracle_text(oracle or text)


def query(name: str, covers: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function beside the SQL that says the same; none where SQL can't."""

    def put(function: Query) -> Query:
        QUERIES[name], COVERS[name] = function, tuple(covers.split())
        if oracle is not None:
            ORACLES[name] = oracle_text(oracle)
        return function

    return put


def load() -> None:
    """Import every module that registers queries."""
    from seqloom.functions import scalars  # noqa: F401
    from seqloom.operators import contexts, corpus, detect, dictionary, framing, learners, markup, match, media, statistics, text, transforms  # noqa: F401
    from seqloom.sources import archive  # noqa: F401
    from seqloom.streaming import folds  # noqa: F401
