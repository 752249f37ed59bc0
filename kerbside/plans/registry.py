"""Queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from .bindings import Tables, with_bindings

BUILDERS: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DATES: dict[str, tuple] = {}


def query(oracle: str | None = None, dates: tuple = ()):
    """Register a function of the tables under its own name. Columns of ``dates`` are given as
    ISO text, so that both engines write them alike."""

    def register(build):
        BUILDERS[build.__name__] = build
        DATES[build.__name__] = dates
        if oracle is not None:
            sql = with_bindings(oracle)
            texts = ", ".join(f"cast({d} as varchar) as {d}" for d in dates)
            ORACLES[build.__name__] = f"select * replace ({texts}) from ({sql})" if dates else sql
        return build

    return register


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    out = BUILDERS[name](Tables(spark, sf_dir))
    return out.withColumns({d: out[d].cast("string") for d in DATES[name]})


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(run, name) for name in BUILDERS}
