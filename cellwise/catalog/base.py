"""Registration of checked queries: a Spark callable with its oracle text."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import micro
from ..sources import derived as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """The derived views of one data folder, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return D.table(self.spark, self.dir, name)

    @cached_property
    def sites(self) -> DataFrame:
        return D.sites(self.spark, self.dir)

    @cached_property
    def infra(self) -> DataFrame:
        return D.infra(self.spark, self.dir)

    @cached_property
    def lines(self) -> DataFrame:
        return D.lines(self.spark, self.dir)

    @cached_property
    def zone_edges(self) -> DataFrame:
        return D.zone_edges(self.spark, self.dir)

    @cached_property
    def cells(self) -> DataFrame:
        return D.cells(self.spark, self.dir)

    @cached_property
    def centred(self) -> DataFrame:
        return D.centred(self.cells)

    @cached_property
    def grid(self):
        return D.grid(self.spark, self.dir)

    @cached_property
    def space(self) -> DataFrame:
        return D.feature_space(self.spark, self.dir)


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Register a function of :class:`Inputs`; ``sql`` may start with more CTEs."""
    def register(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = D.with_views(sql, recursive)
        return fn
    return register


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Round the named columns (all doubles by default) at six decimals."""
    names = names or tuple(f.name for f in df.schema.fields if f.dataType.simpleString() == "double")
    return df.select(*[micro(c).alias(c) if c in names else F.col(c) for c in df.columns])


def M(expr: str) -> str:
    """Six-decimal rounding as oracle text."""
    return f"(floor(({expr})*1e6+0.5)/1e6)"
