"""The tables beside the chunks: users, sessions, chats, messages, documents, question sets, runs and their items.

Each is a folder of Parquet under one root, with a declared schema. Rows are appended, updates too (relational.latest_state
makes the present state of them). A table whose files are of an older schema is read by the present one: columns that were
added since are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SCHEMAS = {
    "users": "user_id string, email string, password_hash string, created_at double",
    "sessions": "session_id string, user_id string, created_at double, expires_at double, revoked int",
    "documents": "document_id string, user_id string, filename string, stored_path string, pages int, chunks int, upload_time double, session_id string",
    "chats": "chat_id string, user_id string, title string, scope string, created_at double, updated_at double",
    "messages": "message_id string, chat_id string, user_id string, role string, content string, sources string, created_at double, seq long",
    "datasets": "dataset_id string, user_id string, name string, questions_json string, created_at double",
    "runs": "run_id string, user_id string, sweep_id string, config_json string, status string, aggregate_json string, created_at double, finished_at double",
    "run_items": "run_id string, item int, question string, answer string, metrics_json string, error string",
}


class Catalog:
    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str] | None = None) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.schemas = {name: StructType.fromDDL(ddl) for name, ddl in (schemas or SCHEMAS).items()}

    def open(self) -> None:
        """Make the tables that aren't there, and name all of them as temporary views."""
        for name, schema in self.schemas.items():
            self.spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.root}/{name}")
            self.table(name).createOrReplaceTempView(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{name}")

    def insert(self, name: str, rows: DataFrame | Sequence[dict]) -> None:
        """Append rows; a column that isn't the table's is an error, one that is left out is null."""
        schema = self.schemas[name]
        if isinstance(rows, DataFrame):
            empty = self.spark.createDataFrame([], schema)
            rows = empty.unionByName(rows, allowMissingColumns=True)
            if rows.columns != schema.names:
                raise ValueError(f"{name} has no columns {sorted(set(rows.columns) - set(schema.names))}")
        else:
            if unknown := {c for r in rows for c in r} - set(schema.names):
                raise ValueError(f"{name} has no columns {sorted(unknown)}")
            rows = self.spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows], schema)
        rows.write.mode("append").parquet(f"{self.root}/{name}")
        self.table(name).createOrReplaceTempView(name)
