"""The corpus as tables, stored as Parquet or JSON."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Parquet files are sorted by these columns, so look-ups by document or number skip row groups.
LAYOUT = {
    "parents": ["document", "page", "p_idx"],
    "children": ["document", "page", "p_idx", "c_idx"],
    "number_index": ["number", "document", "page"],
    "files": ["file"],
    "manifest": ["updated"],
}


@dataclass
class Corpus:
    parents: DataFrame
    children: DataFrame
    number_index: DataFrame
    files: DataFrame
    manifest: DataFrame

    def save(self, path: str) -> None:
        """Write Parquet tables, replacing what is there."""
        for name, order in LAYOUT.items():
            table = getattr(self, name)
            table.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(
                f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Corpus":
        return cls(**{name: spark.read.parquet(f"{path}/{name}") for name in LAYOUT})

    def save_json(self, path: str) -> None:
        """Write the same tables as JSON lines, plus their schemas for an exact read."""
        spark = self.parents.sparkSession
        for name in LAYOUT:
            table = getattr(self, name)
            table.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")
            spark.createDataFrame([(table.schema.json(),)], "value string").coalesce(1).write.mode(
                "overwrite").text(f"{path}/{name}_schema")

    @classmethod
    def load_json(cls, spark: SparkSession, path: str) -> "Corpus":
        import json

        from pyspark.sql.types import StructType

        tables = {}
        for name in LAYOUT:
            schema = StructType.fromJson(json.loads(spark.read.text(f"{path}/{name}_schema").first()[0]))
            tables[name] = spark.read.schema(schema).json(f"{path}/{name}")
        return cls(**tables)
