"""Registered DataFrames and what is declared about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .model import ColumnModel, Relationship, SchemaModel, TableModel, Unit


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    for cls, name in ((T.DateType, "date"), (T.BooleanType, "boolean"), (T.StringType, "text"), (T.ArrayType, "array"), (T.DayTimeIntervalType, "interval"), (T.VariantType, "json")):
        if isinstance(t, cls):
            return name
    return "other"


def plain_names(df: DataFrame) -> DataFrame:
    """Dots and backticks in column names become underscores (numbered where that clashes): a reference is table.column."""
    names: list[str] = []
    for n in df.columns:
        plain = base = n.replace(".", "_").replace("`", "_")
        i = 2
        while plain in names or (plain != n and plain in df.columns):
            plain, i = f"{base}_{i}", i + 1
        names.append(plain)
    return df if names == df.columns else df.toDF(*names)


def parquet_frames(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The Parquet tables of a folder, in any file system that Spark reads, by name without the ending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/*.parquet")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return {s.getPath().getName()[: -len(".parquet")].replace(".", "_"): plain_names(spark.read.parquet(s.getPath().toString())) for s in found}


def columns_of(df: DataFrame) -> dict[str, ColumnModel]:
    return {f.name: ColumnModel(f.name, kind_of(f.dataType), f.dataType.simpleString(), f.nullable) for f in df.schema.fields}


def declare(frames, keys, references, display, times, money, additive, nonadditive) -> SchemaModel:
    """A model from declarations alone: no data is read."""
    model = SchemaModel()
    for name, df in frames.items():
        t = TableModel(name, columns_of(plain_names(df)), tuple(k for k in (keys.get(name),) if k), tuple(d for d in (display.get(name),) if d), times.get(name))
        for c in t.columns.values():
            if c.name in t.pk:
                c.role, c.primary, c.unique = "identifier", True, True
            elif c.name in money:
                c.role, c.unit = "measure_additive", Unit("money")
            elif c.name in additive:
                c.role = "measure_additive"
            elif c.name in nonadditive:
                c.role = "measure_nonadditive"
            elif c.kind in ("timestamp", "date"):
                c.role = "timestamp_event"
            elif c.kind == "text":
                c.role, c.searchable = "dimension_categorical", True
        model.tables[name] = t
    for child, col, parent, key in references:
        if child in model.tables and parent in model.tables:
            model.tables[child].columns[col].role = "foreign_key"
            model.relationships.append(Relationship(child, (col,), parent, (key,)))
    return model


def broken_keys(model: SchemaModel, frames: dict[str, DataFrame]) -> dict[str, tuple[int, int]]:
    """Declared primary keys that the data contradicts: (rows, distinct keys). One pass over the key columns of each table."""
    out = {}
    for name, t in model.tables.items():
        if t.pk:
            n, d = frames[name].agg(F.count("*"), F.count_distinct(*(F.col(c) for c in t.pk))).first()
            if n != d:
                out[name] = (n, d)
    return out


def drop_broken_keys(model: SchemaModel, frames: dict[str, DataFrame]) -> list[str]:
    """Tables whose declared key is not one lose it: a wrong key would let joins multiply rows."""
    bad = sorted(broken_keys(model, frames))
    for name in bad:
        for c in model.tables[name].pk:
            model.tables[name].columns[c].primary = model.tables[name].columns[c].unique = False
        model.tables[name].pk = ()
        model.relationships = [r for r in model.relationships if r.parent != name]
    return bad
