"""Table functions: make(spark, constant arguments) -> DataFrame. They are expanded when a query is planned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..errors import QueryError
from ..sources import midi, prompt, series, sheet

TABLES: dict[str, Callable[[SparkSession, list], DataFrame]] = {}


def register_table(name: str, counts: tuple[int, ...], make: Callable[..., DataFrame]) -> None:
    def checked(spark: SparkSession, args: list) -> DataFrame:
        if len(args) not in counts:
            raise QueryError(f"{name.upper()} takes {' or '.join(map(str, counts))} argument(s), not {len(args)}")
        return make(spark, *args)

    TABLES[name.upper()] = checked


register_table("GENERATE_SERIES", (1, 2), series.generate_series)
register_table("GOOGLE_SHEET", (1, 2), sheet.read_sheet)
register_table("MIDI", (1,), midi.read_midi)
register_table("ASK_GPT", (1,), prompt.ask)
