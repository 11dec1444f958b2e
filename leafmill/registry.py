"""Registry of named queries: Spark callable, coverage ids and oracle SQL."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from leafmill.sources.tables import read_table
from leafmill.sources.views import VIEWS, duckdb_ctes, spark_view

PLAN_MODULES = (
    "executions",
    "catalogs",
    "documents",
    "logs",
    "rules",
    "classification",
    "imaging",
    "records",
    "streams",
)


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[["Inputs"], DataFrame]
    oracle: str | None


class Inputs:
    """Tables of one data directory, raw (``table``) or derived (``view``)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        self._opened: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.path, name)

    def view(self, name: str) -> DataFrame:
        return spark_view(self.spark, self.path, name, self._opened)


QUERIES: dict[str, Query] = {}


def query(name: str, covers: tuple[str, ...] | list[str], oracle: str | None = None):
    def register(build: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Query(name, tuple(covers), build, oracle)
        return build

    return register


def load_all() -> dict[str, Query]:
    for module in PLAN_MODULES:
        importlib.import_module(f"leafmill.plans.{module}")
    return QUERIES


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(item: Query):
        return lambda spark, path: item.build(Inputs(spark, path))

    return {name: bind(item) for name, item in load_all().items()}


def oracle_texts() -> dict[str, str]:
    return {name: full_oracle(item.oracle) for name, item in load_all().items() if item.oracle}


def stripped(text: str) -> str:
    """DuckDB text without white space of any Unicode kind at its edges."""
    blank = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    return f"regexp_replace({text}, '^{blank}+|{blank}+$', '', 'g')"


def full_oracle(sql: str) -> str:
    """Prefix the derived views that ``sql`` mentions as common table expressions;
    ``<strip:x>`` stands for ``stripped("x")``."""
    sql = re.sub(r"<strip:(\w+)>", lambda m: stripped(m[1]), sql)
    words = set(re.findall(r"\b[a-z_0-9]+\b", sql))
    ctes = duckdb_ctes([name for name in VIEWS if name in words])
    body = sql.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
