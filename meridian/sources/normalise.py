"""Raw tables to the panel's and the events' columns: the offline half of the sources. Nothing here reads a network."""

from __future__ import annotations

import json
import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close", "adj_close", "volume", "amount", "turn")
EVENTS = {"code": "string", "report_date": "date", "pub_date": "date", "value": "double"}


def load_config(path: str) -> dict:
    """A YAML or JSON file; under ``paths``, relative entries are taken from the file's folder. YAML needs its library."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        import yaml

        found = yaml.safe_load(text)
    home = os.path.dirname(os.path.abspath(path))
    found["paths"] = {k: os.path.normpath(os.path.join(home, v)) for k, v in (found.get("paths") or {}).items()}
    return found


def union_of_lists(*lists: DataFrame) -> DataFrame:
    """``code``: every name of any list once, in order."""
    return reduce(DataFrame.unionByName, [x.select("code") for x in lists]).where("code IS NOT NULL").distinct().orderBy("code")


def with_adjusted(raw: DataFrame, adjusted: DataFrame) -> DataFrame:
    """Raw bars with ``adj_close`` from adjusted bars' ``close`` by (date, code); bars without an adjusted one stay, with null."""
    return raw.join(adjusted.select("date", "code", F.col("close").alias("adj_close")), ["date", "code"], "left")


def normalised_bars(bars: DataFrame) -> DataFrame:
    """The long daily table from bars as text (``tradestatus`` and ``isST`` are "1" or not, ``turn`` is in per cent).

    What is no number becomes null. Turnover is a share between 0 and 1, 0 where missing or not trading. The flags become ``is_trading`` and ``is_st``.
    """
    numbers = {c: F.col(c).try_cast("double") for c in PRICES if c in bars.columns}
    trading, st = F.coalesce(F.col("tradestatus") == "1", F.lit(False)), F.coalesce(F.col("isST") == "1", F.lit(False))
    share = F.least(F.greatest(F.coalesce(F.col("turn").try_cast("double") / 100, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    out = bars.withColumns(numbers | {"date": F.col("date").try_cast("date"), "turn": F.when(trading, share).otherwise(0.0), "is_st": st.cast("byte"), "is_trading": trading.cast("byte")})
    return out.drop("tradestatus", "isST")


def merged_parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Part files of raw bars as one normalised long table; columns that a part lacks are null there."""
    parts = [spark.read.parquet(p) for p in paths]
    return normalised_bars(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def normalised_fundamentals(raw: DataFrame, report_date: str, names: dict[str, str]) -> DataFrame:
    """Event rows of one report period from a raw page: ``names`` maps ``code``, ``value`` and ``pub_date`` to its columns.

    Codes are padded to six digits. Rows without a number or a date are dropped; negative values stay.
    """
    code = F.lpad(F.col(names["code"]).cast("string"), 6, "0")
    rows = raw.select(code.alias("code"), F.lit(report_date).cast("date").alias("report_date"), F.col(names["pub_date"]).try_cast("date").alias("pub_date"), F.col(names["value"]).try_cast("double").alias("value"))
    return canonical_events(rows.dropna(subset=["value", "pub_date"]))


def canonical_events(events: DataFrame) -> DataFrame:
    """The event table's columns in their order and types."""
    return events.select(*[F.col(c).cast(t).alias(c) for c, t in EVENTS.items()])


def exchange_code(code: Column) -> Column:
    """A six-digit code with its exchange: 6 is ``sh.``, 0 and 3 are ``sz.``, others are null."""
    first = F.substring(code, 1, 1)
    return F.when(first == "6", F.concat(F.lit("sh."), code)).when(first.isin("0", "3"), F.concat(F.lit("sz."), code))


def report_quarters(first: str, last: str) -> list[str]:
    """Quarter ends from ``first`` to ``last`` (ISO dates), as ISO dates."""
    year, out = int(first[:4]), []
    while year <= int(last[:4]):
        out += [d for d in (f"{year}-03-31", f"{year}-06-30", f"{year}-09-30", f"{year}-12-31") if first <= d <= last]
        year += 1
    return out
