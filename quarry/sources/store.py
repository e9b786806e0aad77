"""Collections of chunks in a folder, kept apart by tenant and database where these are named."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class CollectionStore:
    """`format` is any batch format of Spark; `options` go to its reader and writer (credentials, compression)."""

    base: str
    tenant: str = ""
    database: str = ""
    format: str = "parquet"
    options: tuple[tuple[str, str], ...] = ()

    def path(self, collection: str) -> str:
        return "/".join([self.base.rstrip("/"), *(p for p in (self.tenant, self.database) if p), collection])

    def overwrite(self, rows: DataFrame, collection: str) -> None:
        """Drops the collection, if there is one, and adds all rows."""
        rows.write.format(self.format).options(**dict(self.options)).mode("overwrite").save(self.path(collection))

    def read(self, spark: SparkSession, collection: str) -> DataFrame:
        """All rows; errors if the collection does not exist."""
        return spark.read.format(self.format).options(**dict(self.options)).load(self.path(collection))
