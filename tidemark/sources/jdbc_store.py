"""Snapshot store in a database: rows carry their run and the token of the attempt that wrote them; one insert commits."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.store import TABLES, Run, StoreError

#: Tables of the store's own, with their columns.
OWN = {
    "registered": "run_id VARCHAR(128) NOT NULL PRIMARY KEY, told VARCHAR(4000)",
    "claims": "run_id VARCHAR(128) NOT NULL PRIMARY KEY, token VARCHAR(64)",
    "runs": "run_id VARCHAR(128) NOT NULL PRIMARY KEY, token VARCHAR(64), manifest VARCHAR(8000)",
    "stages": "run_id VARCHAR(128) NOT NULL, stage VARCHAR(64) NOT NULL, facts VARCHAR(4000), PRIMARY KEY (run_id, stage)",
}
IDS = "run_id VARCHAR(128), token VARCHAR(64)"


class JdbcStore:
    """The same calls as ParquetStore, over any database that Spark's JDBC source knows.

    Rows of an attempt that ended early carry another token than the committed one, so no read sees them.
    """

    def __init__(self, spark: SparkSession, options: dict[str, str], prefix: str = "tidemark_"):
        self.spark, self.options, self.prefix = spark, options, prefix
        for name, columns in OWN.items():
            if not self._there(self.prefix + name):
                self._run(f"CREATE TABLE {self.prefix}{name} ({columns})")

    def _connection(self):
        gateway, jvm = self.spark.sparkContext._gateway, self.spark._jvm
        loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
        driver = loader.loadClass(self.options["driver"]).getDeclaredConstructor(gateway.new_array(jvm.java.lang.Class, 0)).newInstance(gateway.new_array(jvm.java.lang.Object, 0))
        given = jvm.java.util.Properties()
        for k, v in self.options.items():
            given.setProperty(k, v)
        return driver.connect(self.options["url"], given)

    def _there(self, table: str) -> bool:
        connection = self._connection()
        try:
            found = connection.getMetaData().getTables(None, None, "%", None)
            while found.next():
                if found.getString("TABLE_NAME").casefold() == table.casefold():
                    return True
            return False
        finally:
            connection.close()

    def _run(self, sql: str, *values: str) -> None:
        connection = self._connection()
        try:
            statement = connection.prepareStatement(sql)
            for i, v in enumerate(values):
                statement.setString(i + 1, v)
            statement.executeUpdate()
        finally:
            connection.close()

    def _rows(self, sql: str, *values: str) -> list[tuple]:
        connection = self._connection()
        try:
            statement = connection.prepareStatement(sql)
            for i, v in enumerate(values):
                statement.setString(i + 1, v)
            found, out = statement.executeQuery(), []
            n = found.getMetaData().getColumnCount()
            while found.next():
                out.append(tuple(found.getString(i + 1) for i in range(n)))
            return out
        finally:
            connection.close()

    def register(self, run: Run) -> None:
        """Keep the identity, so that a resumed run has the same clock and window; another identity is an error."""
        old = self.registered(run.run_id)
        if old is None:
            self._run(f"INSERT INTO {self.prefix}registered (run_id, told) VALUES (?, ?)", run.run_id, json.dumps(asdict(run)))
        elif {k: v for k, v in asdict(old).items() if k != "started_at"} != {k: v for k, v in asdict(run).items() if k != "started_at"}:
            raise StoreError(f"run {run.run_id} is registered with another identity")

    def registered(self, run_id: str) -> Run | None:
        found = self._rows(f"SELECT told FROM {self.prefix}registered WHERE run_id = ?", run_id)
        return Run(**json.loads(found[0][0])) if found else None

    def begin(self, run: Run) -> str:
        """Claim the run; the token must be shown to commit."""
        if self.committed(run.run_id):
            raise StoreError(f"run {run.run_id} is committed")
        self.abort(run.run_id)
        token = uuid.uuid4().hex
        self._run(f"INSERT INTO {self.prefix}claims (run_id, token) VALUES (?, ?)", run.run_id, token)
        return token

    def _claimed(self, run: Run, token: str) -> None:
        if self._rows(f"SELECT token FROM {self.prefix}claims WHERE run_id = ?", run.run_id) != [(token,)]:
            raise StoreError(f"run {run.run_id} is claimed by another process")

    def write_table(self, run: Run, token: str, name: str, rows: list[dict]) -> None:
        """Stamp and write rows with the table's own types, which are never inferred."""
        self._claimed(run, token)
        kind = TABLES[name]
        names = [x.split()[0].strip("`") for x in kind.split(", ")]
        df = self.spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], kind)
        for stamp, value in asdict(run).items():
            df = df.withColumn(stamp, F.lit(value).cast("string"))
        df = df.withColumn("token", F.lit(token))
        df.coalesce(1).write.format("jdbc").options(**self.options).option("dbtable", self.prefix + name).option("createTableColumnTypes", IDS).mode("append").save()

    def commit(self, run: Run, token: str, manifest: dict) -> None:
        self._claimed(run, token)
        if self.committed(run.run_id):
            raise StoreError(f"run {run.run_id} is committed")
        text = json.dumps(manifest | {"run": asdict(run), "tables": sorted(TABLES)}, default=str)
        self._run(f"INSERT INTO {self.prefix}runs (run_id, token, manifest) VALUES (?, ?, ?)", run.run_id, token, text)
        self._run(f"DELETE FROM {self.prefix}claims WHERE run_id = ?", run.run_id)

    def abort(self, run_id: str) -> None:
        """Give up the claim of a run; rows of its token are deleted."""
        for (token,) in self._rows(f"SELECT token FROM {self.prefix}claims WHERE run_id = ?", run_id):
            self._run(f"DELETE FROM {self.prefix}claims WHERE run_id = ?", run_id)
            self._forget(token)

    def _forget(self, token: str) -> None:
        """Delete the rows of an attempt; columns are quoted as Spark wrote them."""
        column = self.spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.options["url"]).quoteIdentifier("token")
        for name in TABLES:
            if self._there(self.prefix + name):
                self._run(f"DELETE FROM {self.prefix}{name} WHERE {column} = ?", token)

    def committed(self, run_id: str) -> bool:
        return bool(self._rows(f"SELECT run_id FROM {self.prefix}runs WHERE run_id = ?", run_id))

    def list_runs(self) -> list[str]:
        """Committed runs, oldest start first."""
        found = self._rows(f"SELECT run_id, manifest FROM {self.prefix}runs")
        return [r for r, _ in sorted(found, key=lambda x: (json.loads(x[1])["run"]["started_at"], x[0]))]

    def manifest(self, run_id: str) -> dict:
        found = self._rows(f"SELECT manifest FROM {self.prefix}runs WHERE run_id = ?", run_id)
        if not found:
            raise StoreError(f"run {run_id} is not committed")
        return json.loads(found[0][0])

    def record_stage(self, run_id: str, stage: str, facts: dict) -> None:
        """Note that a stage after analysis is done; a resumed run leaves it out."""
        self._run(f"DELETE FROM {self.prefix}stages WHERE run_id = ? AND stage = ?", run_id, stage)
        self._run(f"INSERT INTO {self.prefix}stages (run_id, stage, facts) VALUES (?, ?, ?)", run_id, stage, json.dumps(facts))

    def stages(self, run_id: str) -> list[str]:
        """Stages of a run that are done."""
        return ["analysis"] * self.committed(run_id) + [s for (s,) in self._rows(f"SELECT stage FROM {self.prefix}stages WHERE run_id = ? ORDER BY stage", run_id)]

    def read_table(self, run_id: str, name: str) -> DataFrame:
        found = self._rows(f"SELECT token FROM {self.prefix}runs WHERE run_id = ?", run_id)
        if not found:
            raise StoreError(f"run {run_id} is not committed")
        every = self.spark.read.format("jdbc").options(**self.options).option("dbtable", self.prefix + name).load()
        return every.where(F.col("token") == found[0][0]).drop("token")

    def prune(self, keep: int, protect: tuple[str, ...] = ()) -> list[str]:
        """Delete all but the newest runs and the protected ones."""
        gone = [r for r in self.list_runs()[: -keep or None] if r not in protect] if keep else []
        for run_id in gone:
            token = self._rows(f"SELECT token FROM {self.prefix}runs WHERE run_id = ?", run_id)[0][0]
            self._run(f"DELETE FROM {self.prefix}runs WHERE run_id = ?", run_id)
            self._run(f"DELETE FROM {self.prefix}stages WHERE run_id = ?", run_id)
            self._forget(token)
        return gone
