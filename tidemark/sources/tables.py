"""Source tables, their columns, and what their names say about their roles."""

from __future__ import annotations

import json
import re

from py4j.java_gateway import is_instance_of
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from tidemark.config import redact

#: Parts of column names by role, strongest first (fixed values); the batch role takes columns of any type.
NEEDLES = {
    "load_time": ("load", "ingest", "arriv", "etl", "landed", "imported", "dw_"),
    "source_insert_time": ("created", "insert", "source"),
    "event_time": ("event", "occur", "recorded", "effective", "activity", "order", "date", "time", "_at"),
    "batch_col": ("batch", "run", "job", "file"),
}
TIMES = ("load_time", "source_insert_time", "event_time")


def read_table(spark: SparkSession, source: dict, name: str) -> DataFrame:
    """A table by the source's kind: a folder of parquet, a catalog, or JDBC."""
    kind = source.get("kind", "parquet")
    if kind == "parquet":
        return spark.read.parquet(f"{source['path'].rstrip('/')}/{name}.parquet")
    if kind == "catalog":
        return spark.table(".".join(x for x in (source.get("database"), source.get("schema"), name) if x))
    if kind == "jdbc":
        return spark.read.format("jdbc").options(**source["options"]).option("dbtable", name).load()
    raise ValueError(f"source kind {kind} is not supported")


def sql_class(spark: SparkSession, error) -> str | None:
    """First two characters of the state that a database, or the engine for it, gives an error."""
    gateway = spark.sparkContext._gateway
    while error is not None:
        if is_instance_of(gateway, error, "java.sql.SQLException") and error.getSQLState():
            return error.getSQLState()[:2]
        if is_instance_of(gateway, error, "org.apache.spark.SparkThrowable") and error.getSqlState():
            return error.getSqlState()[:2]
        error = error.getCause()
    return None


def table_exists(spark: SparkSession, source: dict, name: str) -> bool:
    """Whether a read would find the table; other errors are raised."""
    if source.get("kind", "parquet") == "catalog":
        return spark.catalog.tableExists(".".join(x for x in (source.get("database"), source.get("schema"), name) if x))
    if source.get("kind", "parquet") == "jdbc":
        try:
            spark.read.format("jdbc").options(**source["options"]).option("dbtable", name).load()
        except Py4JJavaError as e:
            if sql_class(spark, e.java_exception) != "42":  # of statements that name what is not there
                raise
            return False
        return True
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{source['path'].rstrip('/')}/{name}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def column_types(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Type of each column, found whatever the case of its name; a missing one is an error."""
    have = {f.name.casefold(): f.dataType.simpleString() for f in df.schema}
    if missing := [c for c in columns if c.casefold() not in have]:
        raise KeyError(", ".join(missing))
    return {c: have[c.casefold()] for c in columns}


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType))]


def candidates(df: DataFrame, needles: dict[str, tuple[str, ...]] | None = None) -> dict[str, list[str]]:
    """Columns that may have each role, the likeliest first: by the strongest part that the name holds, then by place.

    Time roles take columns of dates and times alone. needles overrides the parts of some roles, in any case of letters.
    """
    times, out = set(time_columns(df)), {}
    for role, parts in (NEEDLES | (needles or {})).items():
        ranked = []
        for place, name in enumerate(df.columns):
            strength = next((i for i, part in enumerate(parts) if part.casefold() in name.casefold()), None)
            if strength is not None and (role not in TIMES or name in times):
                ranked.append((strength, place, name))
        out[role] = [name for _, _, name in sorted(ranked)]
    return out


def match_roles(df: DataFrame, needles: dict[str, tuple[str, ...]] | None = None) -> dict[str, list[str]]:
    """Candidates with each column in one role: the first of load, source and event that has it foremost takes it."""
    ranked, taken, out = candidates(df, needles), set(), {}
    for role, names in ranked.items():
        out[role] = [c for c in names if c not in taken]
        taken |= set(out[role][:1])
    return out


def list_tables(spark: SparkSession, source: dict) -> list[str]:
    """Names of all tables of a source: parquet tables of a folder, tables of a catalog's schema, or those a database lists."""
    kind = source.get("kind", "parquet")
    if kind == "parquet":
        path = spark._jvm.org.apache.hadoop.fs.Path(source["path"])
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        names = [f.getPath().getName() for f in found]
        return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet") and not n.startswith(("_", ".")))
    if kind == "catalog":
        where = ".".join(x for x in (source.get("database"), source.get("schema")) if x) or None
        return sorted(t.name for t in spark.catalog.listTables(where) if not t.isTemporary)
    if kind == "jdbc":
        names = source.get("tables_query", "SELECT table_schema || '.' || table_name AS name FROM information_schema.tables")
        rows = spark.read.format("jdbc").options(**source["options"]).option("query", names).load().collect()
        return sorted(r[0] for r in rows)
    raise ValueError(f"source kind {kind} is not supported")


def inventory(tables: dict[str, DataFrame]) -> list[dict]:
    """Rows (table, ordinal, column, type) of all columns, in order."""
    return [{"table": t, "ordinal": i, "column": f.name, "type": f.dataType.simpleString()} for t, df in sorted(tables.items()) for i, f in enumerate(df.schema)]


def draft_config(tables: dict[str, DataFrame], source: dict, needles: dict[str, tuple[str, ...]] | None = None) -> str:
    """A configuration to complete: one probe a table with time columns, the likeliest roles by name, FIXME where none fits.

    Other candidates stand in comments, and so do roles that only help, to be enabled where they are right.
    """
    lines = ["schema_version: 4", "source:", *(f"  {k}: {json.dumps(redact(v, k))}" for k, v in source.items()), "store: {backend: parquet, path: runs}", "probes:"]
    used: set[str] = set()
    for table, df in sorted(tables.items()):
        if not (times := time_columns(df)):
            continue
        base = name = re.sub(r"[^A-Za-z0-9_.-]+", "_", table).lstrip("_.-") or "table"
        n = 1
        while name in used:
            n += 1
            name = f"{base}_{n}"
        used.add(name)
        roles, types = match_roles(df, needles), {f.name: f.dataType for f in df.schema}
        lines += [f"  # time columns: {', '.join(f'{c} ({types[c].simpleString()})' for c in times)}".replace("\n", " "), f"  - name: {json.dumps(name)}", f"    table: {json.dumps(table)}"]
        for role in ("event_time", "load_time"):
            first, *others = roles[role] or [None]
            if first is None:
                lines.append(f"    {role}: FIXME  # one of: {', '.join(times)}")
                continue
            lines.append(f"    {role}: {json.dumps(first)}" + f"  # other candidates: {', '.join(others)}" * bool(others))
            if isinstance(types[first], DateType):
                lines.append(f"    {role.replace('time', 'resolution')}: date")
        lines += [f"    # {role}: {json.dumps(roles[role][0])}  # candidate, to be enabled where it is right" for role in ("source_insert_time", "batch_col") if roles[role]]
    return "\n".join(lines) + "\n"
