"""Nested properties as VARIANT: numbers stay numbers, and paths are read without parsing text again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import DEFAULT_TYPE


def parsed(rows: DataFrame, column: str, to: str = "props") -> DataFrame:
    """rows with a JSON text as VARIANT, and malformed: whether there is a text that is no JSON; its value is null then."""
    value = F.try_parse_json(F.col(column))
    return rows.withColumn("_v", value).withColumn("malformed", F.col(column).isNotNull() & F.col("_v").isNull()).drop(*({to} & set(rows.columns))).withColumnRenamed("_v", to)


def number(props: str | Column, path: str) -> Column:
    """The number at a path such as $.a.b[0], null where there is none."""
    return F.try_variant_get(props, path, "double")


def text(props: str | Column, path: str) -> Column:
    return F.try_variant_get(props, path, "string")


def kinds(rows: DataFrame, column: str = "props") -> DataFrame:
    """(kind, n): the shapes that the properties have."""
    return rows.groupBy(F.schema_of_variant(column).alias("kind")).agg(F.count("*").alias("n"))


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """sources.graphs.read_json with properties as VARIANT, nested ones and all."""
    schema = "name string, nodes array<struct<id:string,type:string,props:variant>>, edges array<struct<source:string,relation:string,target:string,props:variant>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.id", F.coalesce("n.type", F.lit(DEFAULT_TYPE)).alias("type"), "n.props").dropDuplicates(["id"])
    edges = doc.select(F.explode("edges").alias("e")).select(F.col("e.source").alias("src"), F.col("e.relation").alias("rel"), F.col("e.target").alias("dst"), "e.props")
    return nodes, edges.dropDuplicates(["src", "rel", "dst"])


def write(rows: DataFrame, path: str) -> None:
    """Parquet; frequent paths become columns of their own (shredding), which a later read of these paths alone reads."""
    spark = rows.sparkSession
    names = ("spark.sql.variant.writeShredding.enabled", "spark.sql.variant.inferShreddingSchema")
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k in names:
            spark.conf.set(k, "true")
        rows.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
