"""Small helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.plans.domain import EVENTS_NOW, FINDINGS_NOW, LEDGER_NOW


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def findings_now() -> Column:
    return instant(FINDINGS_NOW)


def events_now() -> Column:
    return instant(EVENTS_NOW)


def ledger_now() -> Column:
    return instant(LEDGER_NOW)


def stamp(name: str, alias: str | None = None) -> Column:
    """A timestamp as text with whole seconds, so both engines print it alike."""
    return F.date_format(F.col(name), "yyyy-MM-dd HH:mm:ss").alias(alias or name)


def listing(name: str, alias: str | None = None) -> Column:
    """An array as sorted, comma-joined text."""
    return F.array_join(F.array_sort(F.col(name)), ",").alias(alias or name)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt over all tasks: a small file that holds very many packages is read by a few."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
