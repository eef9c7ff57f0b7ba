"""Keep-first dedup by content hash; the order of arrival is a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import normalise_for_dedup, strip


def content_key(*parts, separator: str = "||") -> Column:
    return F.sha2(F.concat_ws(separator, *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary"), 256)


def keep_first(df: DataFrame, key: Column | list[str], order, last: bool = False) -> DataFrame:
    """One row of each key: the first (or last) in the given order. One shuffle, on the key; none if df is bucketed by the key's columns."""
    order = F.col(order) if isinstance(order, str) else order
    rank = F.row_number().over(Window.partitionBy(*(key if isinstance(key, list) else [key])).orderBy(order.desc() if last else order.asc()))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def prompt_answer_key(prompt, answer, unicode_safe: bool = False) -> Column:
    """Key of the normal forms of prompt and answer: exact after normalising, not near-duplicate detection."""
    return content_key(normalise_for_dedup(prompt, unicode_safe), normalise_for_dedup(answer, unicode_safe))


def task_key(prompt, tests) -> Column:
    return content_key(strip(F.coalesce(prompt, F.lit(""))), strip(F.coalesce(tests, F.lit(""))), separator="\n---\n")


def pair_key(prompt, chosen, rejected) -> Column:
    return content_key(strip(prompt), strip(chosen), strip(rejected), separator="\n")


def distinct_chunks(chunks) -> Column:
    """The non-blank strings of an array, stripped; of those that only differ in case and blanks the first."""
    stripped = F.filter(F.transform(chunks, lambda c: strip(F.coalesce(c, F.lit("")))), lambda c: c != "")
    normal = lambda c: F.lower(F.regexp_replace(c, r"(?U)\s+", " "))
    forms = F.transform(stripped, normal)
    return F.filter(stripped, lambda c, i: F.array_position(forms, normal(c)) == i + 1)
