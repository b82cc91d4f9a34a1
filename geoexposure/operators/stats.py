"""National series, population groups, code columns, formula variables."""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def age_group(age: Column) -> Column:
    """child 0 to 14, active 15 to 64, elderly 65 to 100."""
    return F.when(age.between(0, 14), "child").when(age.between(15, 64), "active").when(age.between(65, 100), "elderly")


def population_groups(people: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Sums by sex and age group, sex, age group and in total (12 combinations of two sexes and three groups); totals have nulls."""
    rows = people.select(*by, "sex", age_group(F.col("age")).alias("grp"), value.alias("_v")).where("grp IS NOT NULL")
    sets = [[*map(F.col, by), *map(F.col, s)] for s in (("sex", "grp"), ("sex",), ("grp",), ())]
    return rows.groupingSets(sets, *by, "sex", "grp").agg(F.sum("_v").alias("value"))


def growth_rate(series: DataFrame) -> DataFrame:
    """(iso3, rate): slope of the logarithm of the population by year; null unless there are two points or more and all are above 0."""
    sound = (F.count("*") >= 2) & (F.min("pop") > 0)
    log = F.when(F.col("pop") > 0, F.log("pop"))
    return series.groupBy("iso3").agg(F.when(sound, F.regr_slope(log, F.col("yr"))).alias("rate"))


def project_population(series: DataFrame, year: int) -> DataFrame:
    """(iso3, pop): of the year if it is there, else the latest one grown to it, truncated."""
    latest = series.groupBy("iso3").agg(F.max_by("pop", "yr").alias("_pop"), F.max("yr").alias("_yr"), F.max(F.when(F.col("yr") == year, F.col("pop"))).alias("_exact"))
    grown = F.col("_pop") * F.pow(F.col("rate") + 1, F.lit(year) - F.col("_yr"))
    return latest.join(growth_rate(series), "iso3").select("iso3", F.coalesce(F.col("_exact"), grown).cast("long").alias("pop"))


def growth_coefficient(series: DataFrame, base: int, target: int) -> DataFrame:
    """(iso3, coefficient): projected population of one year over another's."""
    a, b = project_population(series, base).withColumnRenamed("pop", "_a"), project_population(series, target).withColumnRenamed("pop", "_b")
    return a.join(b, "iso3").select("iso3", F.try_divide(F.col("_b").cast("double"), F.col("_a").cast("double")).alias("coefficient"))


def linear_population(series: DataFrame, year: int) -> DataFrame:
    """(iso3, pop) on the least-squares line."""
    line = F.regr_slope("pop", "yr") * year + F.regr_intercept("pop", "yr")
    return series.groupBy("iso3").agg(line.alias("pop"))


def detect_code_column(table: DataFrame, codes: list[str]) -> DataFrame:
    """(column, share): the string column with the largest share of distinct upper-cased values that are codes; the first by name of equals.

    ``codes`` is a fixed list of a few hundred entries.
    """
    strings = sorted(f.name for f in table.schema if f.dataType.typeName() == "string")
    long = table.unpivot([], strings, "column", "v") if strings else table.sparkSession.createDataFrame([], "column string, v string")
    distinct = long.where("v IS NOT NULL").select("column", F.upper("v").alias("v")).distinct()
    share = distinct.groupBy("column").agg(F.avg(F.col("v").isin(codes).cast("double")).alias("share"))
    return share.orderBy(F.desc("share"), "column").limit(1)


def extent_by_code(boxes: DataFrame, by: str | None = "iso3") -> DataFrame:
    """Extent of all boxes of each code, or of everything."""
    agg = [F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax")]
    return boxes.groupBy(by).agg(*agg) if by else boxes.agg(*agg)


#: What a formula may hold besides names, numbers and functions; a division by zero gives null.
_OPERATIONS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: F.try_divide, ast.Pow: F.pow}


def formula(expression: str, names: dict[str, str] | None = None) -> Column:
    """The column of a formula of names, numbers, + - * / **, and functions; ``names`` says which columns stand for them. Dividing by zero gives null."""

    def column(node: ast.AST) -> Column:
        match node:
            case ast.BinOp(left, op, right) if type(op) in _OPERATIONS:
                return _OPERATIONS[type(op)](column(left), column(right))
            case ast.UnaryOp(ast.USub(), value):
                return -column(value)
            case ast.Name(name):
                return F.col(f"`{(names or {}).get(name, name)}`")
            case ast.Constant(int() | float() as value):
                return F.lit(value)
            case ast.Call(ast.Name(name), args, []):
                return F.call_function(name, *map(column, args))
        raise ValueError(f"a formula can't hold {ast.unparse(node)!r}")

    return column(ast.parse(expression.strip(), mode="eval").body)


def derive(df: DataFrame, name: str, expression: str, suffix: str = "") -> DataFrame:
    """Add a variable by its formula; with a suffix the formula's names get it as whole names (never parts of them). A division by zero gives null."""
    names = {c.removesuffix(suffix): c for c in df.columns if c.endswith(suffix)} if suffix else {}
    return df.withColumn(f"{name}{suffix}", formula(expression, names))
