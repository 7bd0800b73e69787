"""An inverted index of object paths: prunes by key existence and containment, then always rechecks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import binary, values
from ..text import parse
from .containment import contains


def build(df: DataFrame, key: str, d: str) -> DataFrame:
    """(path, key) of every object path of the canonical column ``d``. Write it sorted or bucketed by path."""
    @F.pandas_udf("array<string>")
    def paths(column):
        return column.map(lambda b: list(dict.fromkeys(values.paths(binary.decode(bytes(b))))) if b is not None else None)

    return df.select(F.explode(paths(d)).alias("path"), F.col(key))


def write(index: DataFrame, path: str) -> None:
    """Range-partitioned and sorted by path, so that row-group statistics prune."""
    index.repartitionByRange("path").sortWithinPartitions("path").write.mode("overwrite").parquet(path)


def with_paths(df: DataFrame, index: DataFrame, key: str, wanted: list[str], any_: bool = False) -> DataFrame:
    """Rows that the index says have all (or any) of the paths."""
    if not wanted:
        return df.limit(0) if any_ else df
    hits = index.where(F.col("path").isin(wanted))
    if not any_ and len(set(wanted)) > 1:  # one shuffle by key, which the join then uses: a key's rows are few, and paths that stand there twice count once
        has = [F.max(F.col("path") == p).alias(f"__{k}") for k, p in enumerate(sorted(set(wanted)))]
        hits = hits.groupBy(key).agg(*has).where(" AND ".join(f"__{k}" for k in range(len(has))))
    return df.join(hits.select(key), key, "left_semi")


def where_exists(df: DataFrame, index: DataFrame, key: str, v: str, names: list[str], any_: bool = False) -> DataFrame:
    from ..functions.register import call

    recheck: Column = call("exists_any" if any_ else "exists_all", F.col(v), names)
    return with_paths(df, index, key, names, any_).where(recheck)


def where_contains(df: DataFrame, index: DataFrame, key: str, v: str, doc) -> DataFrame:
    doc = parse(doc) if isinstance(doc, str) else doc
    wanted = [p for p in values.paths(doc) if "[" not in p]  # array positions don't matter to containment
    return with_paths(df, index, key, wanted).where(contains(v, doc))
