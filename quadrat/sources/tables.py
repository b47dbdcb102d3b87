"""Parquet and CSV sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quadrat.functions.names import clean_names

NULL_MARKER = "NA"


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header row; ``NA`` and empty cells are null, names come out in snake case.

    A declared schema avoids the extra pass over the file; without one every row
    is looked at, so a column whose early rows are all missing still gets its type.
    """
    reader = spark.read.option("header", True).option("nullValue", NULL_MARKER)
    reader = reader.option("quote", '"').option("escape", '"').option("multiLine", True)
    if schema is not None:
        return clean_names(reader.schema(schema).csv(path))
    return clean_names(reader.option("inferSchema", True).option("samplingRatio", 1.0).csv(path))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV folder with a header row and ``NA`` for missing cells."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("nullValue", NULL_MARKER)
        .option("emptyValue", "")
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A lookup table typed into the program (rules, overrides, labels)."""
    return spark.createDataFrame(rows, schema)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Schema check between stages."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
