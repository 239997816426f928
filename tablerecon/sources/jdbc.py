"""SQL datasets over JDBC: a table, or a query as the dataset."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tablerecon.errors import ValidationError
from tablerecon.sources.files import WRITE_MODES

@dataclass(frozen=True)
class Connection:
    """A named set of reader options; a connection without a URL is Spark itself."""

    name: str
    options: Mapping[str, str]

    @property
    def is_spark(self) -> bool:
        return "url" not in self.options


@dataclass(frozen=True)
class Split:
    """Range split of a JDBC read, so that many tasks share it."""

    column: str
    lower: str
    upper: str
    partitions: int

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": self.column,
            "lowerBound": self.lower,
            "upperBound": self.upper,
            "numPartitions": str(self.partitions),
        }


def qualified(schema: str | None, table: str, catalog: str | None = None) -> str:
    return ".".join(p for p in (catalog, schema, table) if p)


@dataclass(frozen=True)
class SqlDataset:
    """A table, or a query, on a connection."""

    connection: Connection
    mode: str = "table"
    schema_name: str | None = None
    table: str | None = None
    query: str | None = None
    catalog: str | None = None
    write_mode: str = "OVERWRITE"
    split: Split | None = None

    def __post_init__(self) -> None:
        problems = []
        if self.mode == "table":
            if not self.table:
                problems.append("table mode needs a table")
            if self.query is not None:
                problems.append("table mode takes no query")
        elif self.mode == "query":
            if not self.query:
                problems.append("query mode needs a query")
            if self.table is not None:
                problems.append("query mode takes no table")
        else:
            problems.append(f"unknown mode {self.mode!r}")
        if self.write_mode not in WRITE_MODES:
            problems.append(f"unknown write mode {self.write_mode!r}")
        if problems:
            raise ValidationError(problems)

    @property
    def name(self) -> str:
        return qualified(self.schema_name, self.table or "", self.catalog)

    def read_options(self) -> dict[str, str]:
        out = dict(self.connection.options)
        split = self.split.options() if self.split else {}
        if self.mode == "table":
            return {**out, "dbtable": self.name, **split}
        if split:
            # Spark splits only named tables; a query becomes a derived one.
            return {**out, "dbtable": f"({self.query}) q", **split}
        return {**out, "query": str(self.query)}

    def write_options(self) -> dict[str, str]:
        out = {**self.connection.options, "dbtable": self.name}
        return {**out, "truncate": "true"} if self.write_mode == "TRUNCATE" else out

    def read(self, spark: SparkSession) -> DataFrame:
        if self.connection.is_spark:
            return spark.sql(str(self.query)) if self.mode == "query" else spark.table(self.name)
        return spark.read.format("jdbc").options(**self.read_options()).load()

    def write(self, df: DataFrame) -> None:
        if self.mode != "table":
            raise ValidationError(["a query dataset cannot be written"])
        mode = "append" if self.write_mode == "APPEND" else "overwrite"
        df.write.format("jdbc").options(**self.write_options()).mode(mode).save()


def read_jdbc_table(
    spark: SparkSession,
    connection: Connection,
    schema: str | None,
    table: str,
    catalog: str | None = None,
    split: Split | None = None,
) -> DataFrame:
    return SqlDataset(connection, "table", schema, table, None, catalog, split=split).read(spark)


def read_query(spark: SparkSession, connection: Connection, query: str) -> DataFrame:
    return SqlDataset(connection, "query", query=query).read(spark)
