"""Applying an operator's verdicts to the documents themselves, columns and all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, own, stash


def keep_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids`` (column ``id``, nulls equal)."""
    name = own("_id", docs)
    return docs.join(ids.select(F.col("id").alias(name)).distinct(), F.col(id_col).eqNullSafe(F.col(name)), "left_semi")


def _first(rows: DataFrame, by: list[Column], order: list[Column]) -> DataFrame:
    """One row of each group: the first in ``order``, then by all columns as text, so that reruns choose alike."""
    place = own("_place", rows)
    every = [F.to_json(F.struct(F.col(f"`{c}`").alias("c"))) for c in rows.columns]
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order, *every))).filter(F.col(place) == 1).drop(place)


def after_exact(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that exact dedup keeps. Where ids repeat, rows are told apart by their squeezed text, its longest form first, then by all columns."""
    verdicts = stash(verdicts.select(F.col(id_col).alias("id"), "kept", "text_sha256"), "verdicts")
    many = stash(verdicts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "repeated")
    if not many.limit(1).count():
        return keep_ids(docs, verdicts.filter("kept"), id_col)
    single = verdicts.filter("kept").join(many.withColumnRenamed("id", "_many"), F.col("id").eqNullSafe(F.col("_many")), "left_anti")
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.regexp_replace(text, f"[{WHITE}]", "").cast("binary"), 256)
    rows = keep_ids(docs, many, id_col)
    name, sha = own("_id", docs), own("_sha", docs)
    kept = verdicts.filter("kept").select(F.col("id").alias(name), F.col("text_sha256").alias(sha))
    rows = rows.join(kept, F.col(id_col).eqNullSafe(F.col(name)) & (digest == F.col(sha)), "left_semi")
    return keep_ids(docs, single, id_col).unionByName(_first(rows, [F.col(id_col), digest], [F.desc(F.length(text))]))


def after_near(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that of its smallest id, the first by text and all columns. Rows without an id stay unless a row with one represents them."""
    verdicts = stash(verdicts.select(F.col(id_col).alias("id"), F.col("component_id").eqNullSafe(F.col(id_col)).alias("kept")), "verdicts")
    out = keep_ids(docs, verdicts.filter("kept"), id_col)
    if not verdicts.filter("kept and id is not null").groupBy("id").count().filter("count > 1").limit(1).count():
        return out
    first = _first(out.filter(F.col(id_col).isNotNull()), [F.col(id_col)], [F.col(text_col)])
    return first.unionByName(out.filter(F.col(id_col).isNull()))


def after_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Each row as often as the mix takes it, to the nearest whole number of times; rows of one id and source share their mean."""
    name, source, times, copy = (own(c, docs) for c in ("_id", "_source", "_times", "_copy"))
    count = mixed.groupBy(F.col(id_col).alias(name), F.col(source_col).alias(source)).agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
    count = count.filter("2 * _taken >= _size and _size > 0").select(name, source, F.expr("(2 * _taken + _size) div (2 * _size)").cast("int").alias(times))
    met = docs.join(count, F.col(id_col).eqNullSafe(F.col(name)) & F.col(source_col).eqNullSafe(F.col(source)))
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select([F.col(f"`{c}`") for c in docs.columns])
