"""Values of JSON texts, with texts that are numbers as numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled


def coerced(v: Column) -> list[Column]:
    """A text as whole number, else as decimal number, else as it is: three columns, one of them set."""
    is_whole, is_number = v.rlike(r"^\s*[+-]?[0-9]+\s*$"), v.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$")
    return [
        F.when(is_whole, F.trim(v).try_cast("bigint")),
        F.when(~is_whole & is_number, F.trim(v).try_cast("double")),
        F.when(~is_whole & ~is_number, v),
    ]


def leaves(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, whole, number, text, truth) of every leaf of a JSON column, however deep; one of the last four is set, none for null.

    A path is written as ``$.name[position]``; names stay as they are, and only texts are coerced. Empty objects and lists
    have no leaf, a text that is no JSON has none either. Each round opens one level for all rows at once.
    """
    front = rows.select(F.col(key), F.lit("$").alias("path"), F.try_parse_json(text).alias("v")).where("v is not null")
    done = None
    while True:
        front = settled(front.withColumn("shape", F.substring_index(F.schema_of_variant("v"), "<", 1)))
        flat = front.where("shape not in ('OBJECT', 'ARRAY')").drop("shape")
        done = flat if done is None else done.unionByName(flat)
        deep = front.where("shape in ('OBJECT', 'ARRAY')")
        if deep.isEmpty():
            break
        inner = deep.lateralJoin(deep.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "name", "inner"))
        step = F.when(F.col("name").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("name")))
        front = inner.select(key, F.concat("path", step).alias("path"), F.col("inner").alias("v"))
    own = done.withColumn("kind", F.schema_of_variant("v")).withColumn("s", F.when(F.col("kind") == "STRING", F.try_variant_get("v", "$", "string")))
    whole, number, words = coerced(F.col("s"))
    is_whole, is_number = F.col("kind") == "BIGINT", (F.col("kind") == "DOUBLE") | F.startswith("kind", F.lit("DECIMAL"))
    return own.select(
        key, "path", F.coalesce(whole, F.when(is_whole, F.try_variant_get("v", "$", "bigint"))).alias("whole"),
        F.coalesce(number, F.when(is_number, F.try_variant_get("v", "$", "double"))).alias("number"), words.alias("text"), F.when(F.col("kind") == "BOOLEAN", F.try_variant_get("v", "$", "boolean")).alias("truth"),
    )
