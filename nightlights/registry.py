"""All queries of the library over the given tables, with their SQL, through lenses that both engines read."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightlights.lenses import LENSES, needed

_FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
MODULES = ("states", "edges", "masks", "stacks", "templates", "registration", "world", "learning", "sources")


class Views:
    """The given tables and the lenses on them, as attributes, each made on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in LENSES:
                text = LENSES[name]
                self._made[name] = self.spark.sql(text, **{x: getattr(self, x) for x in needed(text)})
            else:
                self._made[name] = self.spark.read.parquet(f"{self._dir}/{name}.parquet")
        return self._made[name]


def lens_sql(names: str) -> str:
    """WITH list of the lenses named and those they read, for SQL engines that know the tables by name."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        if name in LENSES and name not in out:
            for x in needed(LENSES[name]):
                add(x)
            out[name] = LENSES[name].format(**{x: x for x in needed(LENSES[name])})

    for name in names.split():
        add(name)
    return ", ".join(f"{k} AS ({v})" for k, v in out.items())


def query(name: str, lenses: str = "", sql: str | None = None, doubles: str = "", digits: int = 6):
    """Registers a function of Views. Columns named in doubles are rounded here and in sql, since sums depend on the order of rows.

    sql follows WITH: it may begin with further common tables; None where SQL can't express the operation.
    """

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Views(spark, sf_dir))
            return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in doubles.split()}) if doubles else df

        _FOUND[name] = run
        if sql is not None:
            before = lens_sql(lenses)
            *ctes, body = sql.split("---")
            parts = ", ".join(x for x in (before, *(c.strip().rstrip(",") for c in ctes)) if x)
            whole = (f"WITH RECURSIVE {parts} " if parts else "") + body
            _SQL[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) + 0.0 AS {c}' for c in doubles.split())}) FROM ({whole})" if doubles else whole
        return f

    return add


def _load() -> None:
    for m in MODULES:
        import_module(f"nightlights.jobs.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_FOUND)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
