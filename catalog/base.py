"""Registration of queries and the views of the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline.params import OK_CODE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TYPES = ("click", "error", "purchase", "signup", "view")
TARGET = 102
PLANT = "plant"  # the one machine that owns all rows where the whole stream is one timeline


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name; ``sql`` states the same result for another engine."""
    def register(build: Query) -> Query:
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Results are compared after rounding: six decimals, two from 1000 on. The small offset keeps values that
# lie exactly between two roundings (the inputs have two decimals) from falling to either side.
_SMALL, _LARGE = 3.1415e-8, 3.1415e-4


def r6(c: Column) -> Column:
    near = F.round(c + F.lit(_SMALL), 6)
    return F.when(F.abs(c) >= 1000, F.round(c + F.lit(_LARGE), 2)).otherwise(near) + F.lit(0.0)


def sql_r6(expr: str) -> str:
    return f"(CASE WHEN abs({expr}) >= 1000 THEN round({expr} + {_LARGE!r}, 2) ELSE round({expr} + {_SMALL!r}, 6) END + 0.0)"


def log(spark: SparkSession, sf_dir: str, machine: str | None = None) -> DataFrame:
    """``events`` as a machine log: (machine_id, ts, event_id, event_type, value, code).

    The code is 100 + k mod 10 for errors and the OK code otherwise; ``machine`` None makes every user a machine.
    """
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    owner = F.col("user_id") if machine is None else F.lit(machine)
    return table(spark, sf_dir, "events").select(
        owner.alias("machine_id"), "ts", "event_id", "event_type", "value",
        F.when(F.col("event_type") == "error", 100 + k % 10).otherwise(F.lit(OK_CODE)).cast("bigint").alias("code"),
    )


def wide(spark: SparkSession, sf_dir: str, machine: str | None = PLANT) -> DataFrame:
    """The log with one numeric column per event type."""
    rows = log(spark, sf_dir, machine)
    return rows.select("machine_id", "ts", "event_id", *[F.when(F.col("event_type") == t, F.col("value")).alias(t) for t in TYPES])


# The same views for the other engine, to be put behind WITH.
LOG_SQL = f"""log AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(CASE WHEN event_type = 'error' THEN 100 + CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 10
                   ELSE {OK_CODE} END AS BIGINT) AS code
  FROM events)"""

WIDE_SQL = "wide AS (SELECT event_id, ts, user_id, " + ", ".join(
    f"CASE WHEN event_type = '{t}' THEN value END AS {t}" for t in TYPES) + " FROM events)"
