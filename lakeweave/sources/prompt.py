"""ASK_GPT: the CSV reply of a language model, through a client that must be set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..errors import QueryError
from .sheet import string_table

_client: list[Callable[[str], str] | None] = [None]


def set_client(client: Callable[[str], str] | None) -> None:
    """client(prompt) -> reply: lines of comma-separated values, names first."""
    _client[0] = client


def ask(spark: SparkSession, prompt: str) -> DataFrame:
    if _client[0] is None:
        raise QueryError("ASK_GPT needs a client (sources.prompt.set_client)")
    lines = [x for x in _client[0](str(prompt)).splitlines() if x.strip()]
    return string_table(spark, [[cell.strip() for cell in line.split(",")] for line in lines])
