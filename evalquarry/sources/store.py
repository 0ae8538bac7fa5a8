"""Stored tables: appends, latest versions, pages, purges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append_new(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """stored and those rows of new whose key it lacks, one of each; nulls are equal."""
    once = new.dropDuplicates(key)
    same = F.lit(True)
    for k in key:
        same = same & once[k].eqNullSafe(stored[k])
    return stored.unionByName(once.join(stored.select(*key), same, "left_anti"))


def latest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """The newest version of each record."""
    w = Window.partitionBy(*key).orderBy(F.desc(version))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, new: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """Insert or replace by key: of equal keys the row of the largest sequence stays."""
    return latest(stored.unionByName(new), key, sequence)


def after(cursor: dict[str, object]) -> Column:
    """Rows whose keys come after the cursor's."""
    return F.struct(*cursor) > F.struct(*(F.lit(v).alias(k) for k, v in cursor.items()))


def keyset_page(rows: DataFrame, cursor: dict[str, object] | None, size: int) -> DataFrame:
    """The next size rows by the cursor's keys, and one more if there are more."""
    keys = list(cursor or {}) or rows.columns
    return (rows if cursor is None else rows.where(after(cursor))).orderBy(*keys).limit(size + 1)


def where_equal(rows: DataFrame, **values: object) -> DataFrame:
    """Conjunction of the equality filters that are given."""
    for k, v in values.items():
        if v is not None:
            rows = rows.where(F.col(k) == F.lit(v))
    return rows


def purge(rows: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """(what stays, how many rows go)."""
    return rows.where(~F.coalesce(condition, F.lit(False))), rows.where(condition).count()
