"""Turning raw lines into string collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweave.functions.strings import field_after, json_field, quoted_literal, strip


def second_column(lines: DataFrame, value: str = "value") -> DataFrame:
    """Queries: what follows the first tab, stripped, where there is anything left."""
    return lines.withColumn(value, strip(field_after(F.col(value), "\t", 1, 1))).where(F.length(value) > 0)


def url_column(lines: DataFrame, value: str = "value", prefix: str = "http") -> DataFrame:
    """URLs: the second of three or more tab-separated fields, not stripped, where it begins with `prefix`."""
    return lines.withColumn(value, field_after(F.col(value), "\t", 1, 2)).where(F.col(value).startswith(prefix))


def json_titles(lines: DataFrame, value: str = "value", field: str = "title") -> DataFrame:
    """Titles: a JSON field, stripped; malformed lines and blank or missing titles are dropped."""
    return lines.withColumn(value, strip(json_field(F.col(value), field))).where(F.length(value) > 0)


def literals(lines: DataFrame, value: str = "value", limit: int | None = None, order: str | None = None) -> DataFrame:
    """Abstracts: the quoted English literal of each statement that isn't blank or a comment; the first `limit` by `order`."""
    kept = lines.where(~F.col(value).startswith("#") & (F.length(strip(F.col(value))) > 0))
    found = kept.withColumn(value, quoted_literal(F.col(value))).where(F.col(value).isNotNull())
    return found if limit is None else found.orderBy(order).limit(limit)


def is_comment(v: Column) -> Column:
    return v.startswith("#") | (F.length(strip(v)) == 0)
