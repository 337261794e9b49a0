"""Registering a query with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from specmine.plans.bind import SQL, TABLES, bound, prelude, reads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """``t("lines")`` is a derived table, ``t("documents")`` a given one. ``base``, the windows over ``lineitem``, is written
    once for a query whose derived table reads it more than once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.ready: dict[str, str] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in SQL:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in self.ready and reads(name, "base") > 1:
            self.kept("base")
        return bound(self.spark, self.sf_dir, name, self.ready)

    def kept(self, name: str) -> DataFrame:
        """A derived table that a query reads several times: written once, by buckets of ``doc_id``, so that no read of it
        computes it or moves its rows again."""
        if name not in self.ready:
            table, df = f"specmine_{name}_{uuid.uuid4().hex}", self(name)
            buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            df.write.bucketBy(buckets, "doc_id").option("path", self.folder(name)).saveAsTable(table)
            self.ready[name] = table
        return self(name)

    def written(self, df: DataFrame) -> DataFrame:
        """A step that a query reads more than once, written once."""
        path = self.folder("step")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        """A new folder among those that the driver and all executors share."""
        top = self.spark.sparkContext.getConf().get("spark.checkpoint.dir") or self.spark.conf.get("spark.sql.warehouse.dir")
        return f"{top.rstrip('/')}/specmine-{name}-{uuid.uuid4().hex}"


def case(name: str, fn: Callable[[Tables], DataFrame], needs: str = "", sql: str | None = None) -> None:
    """``sql`` is a select, or ``x as (...), ... select``, over the derived tables in ``needs``."""
    QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
    if sql is None:
        return
    sql = sql.strip()
    parts = [p for p in (prelude(needs.split()), "") if p]
    for derived in needs.split():
        assert derived in SQL or derived in TABLES, derived
    if sql.startswith("select"):
        ORACLES[name] = f"with {', '.join(parts)} {sql}" if parts else sql
    else:
        recursive = "recursive " if sql.startswith("recursive ") else ""
        ORACLES[name] = f"with {recursive}{', '.join([*parts, sql.removeprefix('recursive ')])}"
