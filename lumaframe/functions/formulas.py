"""Named formulas: groups of SQL expressions that are added to a DataFrame as columns.

A formula is written once in the SQL that Spark and other engines share. Each group may
use the columns of the groups before it, so long series are computed once and read by
name; everything stays in JVM expressions and whole-stage code.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The largest method, in bytes, that a JVM compiles; larger ones are interpreted.
COMPILED = 8000


def keep_compiled(spark: SparkSession) -> None:
    """Lowers the session's limit for generated methods to what a JVM compiles, when it is higher.

    A long formula in one generated method is interpreted for every row; above the limit
    Spark evaluates it in parts, each of which is compiled.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > COMPILED:
        spark.conf.set(name, str(COMPILED))


def _doubles(text: str) -> str:
    """Decimal literals as doubles."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\de.])", r"\1e0", text)


class Formula:
    """groups: expressions by name, group by group. out: the names that stay; names of the input stay too."""

    def __init__(self, groups: list[dict[str, str]], out: list[str]):
        self.groups, self.out = [{k: _doubles(v) for k, v in g.items()} for g in groups], out

    def on(self, df: DataFrame) -> DataFrame:
        """df with the formula's results appended."""
        keep_compiled(df.sparkSession)
        keep = [f"`{c}`" for c in df.columns]
        for group in self.groups:
            df = df.selectExpr("*", *[f"{v} AS {k}" for k, v in group.items()])
        return df.selectExpr(*keep, *self.out)

    def sql(self, source: str) -> str:
        """The same as nested SELECTs over source."""
        for group in self.groups:
            source = f"(SELECT *, {', '.join(f'{v} AS {k}' for k, v in group.items())} FROM {source})"
        return source


def turn(x: str) -> str:
    """x in degrees, from 0 up to 360."""
    return f"(({x}) - 360 * floor(({x}) / 360e0))"


def sind(x: str) -> str:
    return f"sin(radians({x}))"


def cosd(x: str) -> str:
    return f"cos(radians({x}))"


def clip(x: str, low: str, high: str) -> str:
    """x within low and high; null stays null, which least and greatest would drop."""
    return f"(CASE WHEN ({x}) < {low} THEN {low} WHEN ({x}) > {high} THEN {high} ELSE ({x}) END)"


def up(x: str, digits: int) -> str:
    """Rounded with halves upward."""
    return f"(floor(({x}) * {10**digits}e0 + 0.5) / {10**digits}e0)"
