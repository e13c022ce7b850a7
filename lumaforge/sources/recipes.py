"""Recipe files: JSON documents that hold a named, ordered list of actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaforge.plans.steps import name_error
from lumaforge.schemas import RECIPES, recipe_schema


def read_recipes(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """One row per file ``(file, name, actions, metadata, error)``; broken files keep a message."""
    raw = (
        spark.read.schema(recipe_schema(with_corrupt=True))
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", pattern)
        .json(folder)
        .withColumn("file", F.input_file_name())
    )
    return _defaults(raw).select("file", "name", "actions", "metadata", recipe_error().alias("error"))


def recipes_from_text(df: DataFrame, column: str) -> DataFrame:
    """Parse a JSON column into ``name, actions, metadata, error`` next to the other columns."""
    schema = RECIPES + ", _corrupt_record string"
    parsed = df.withColumn("_r", F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    others = [c for c in df.columns if c != column]
    wide = parsed.select(*others, "_r.name", "_r.actions", "_r.metadata", "_r._corrupt_record")
    return _defaults(wide).select(*others, "name", "actions", "metadata", recipe_error().alias("error"))


def _defaults(df: DataFrame) -> DataFrame:
    """Fill the parts of an action that a file may leave out."""
    empty = F.create_map().cast("map<string,string>")
    actions = F.transform(
        F.col("actions"),
        lambda a: F.struct(
            a["name"].alias("name"), F.coalesce(a["parameters"], empty).alias("parameters"),
            F.coalesce(a["enabled"], F.lit(True)).alias("enabled"),
            F.coalesce(a["description"], F.lit("")).alias("description"),
        ),
    )
    none = F.array().cast("array<struct<name:string,parameters:map<string,string>,enabled:boolean,description:string>>")
    return df.withColumns({"actions": F.coalesce(actions, none), "metadata": F.coalesce("metadata", empty)})


def recipe_error() -> Column:
    """Why a recipe row is not usable, or null."""
    bad = F.filter(F.transform("actions", lambda a: name_error(a["name"])), lambda e: e.isNotNull())
    return (
        F.when(F.col("_corrupt_record").isNotNull(), "Error loading: not a valid document")
        .when(F.coalesce(F.col("name"), F.lit("")) == "", "Pipeline name cannot be empty")
        .when(F.size(bad) > 0, F.get(bad, F.lit(0)))
    )


def validate_files(spark: SparkSession, folder: str) -> DataFrame:
    return read_recipes(spark, folder).select("file", F.col("error").isNull().alias("valid"), "error")


def to_document(recipe: DataFrame) -> DataFrame:
    """Add ``document``: the recipe as JSON with keys in sorted order."""
    actions = F.transform(
        F.col("actions"),
        lambda a: F.struct(
            a["description"].alias("description"), a["enabled"].alias("enabled"), a["name"].alias("name"),
            _sorted_map(a["parameters"]).alias("parameters"),
        ),
    )
    doc = F.struct(actions.alias("actions"), _sorted_map(F.col("metadata")).alias("metadata"), F.col("name"))
    return recipe.withColumn("document", F.to_json(doc, {"ignoreNullFields": "false"}))


def _sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def write_recipes(recipe: DataFrame, folder: str) -> None:
    """One JSON line per recipe. Which rows share a file is Spark's choice."""
    to_document(recipe).select("document").write.mode("errorifexists").text(folder)
