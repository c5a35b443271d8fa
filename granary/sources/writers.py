"""Sinks: frozen splits, JSON and CSV reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def freeze(df: DataFrame, path: str, by: str = "split") -> None:
    """Parquet with a folder for each split; each split's rows meet first, so files are few."""
    df.repartition(by).write.mode("error").partitionBy(by).parquet(path)


def json_report(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def csv_report(df: DataFrame, path: str) -> None:
    """A report (few rows) as one CSV with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def sqlite_file(df: DataFrame, path: str, table: str) -> None:
    """A report (few rows) as a table of one SQLite file."""
    import sqlite3

    db = sqlite3.connect(":memory:")
    names = ", ".join(f'"{c}"' for c in df.columns)
    db.execute(f'CREATE TABLE "{table}" ({names})')
    db.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(df.columns))})', [tuple(r) for r in df.collect()])
    db.commit()
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    out.write(bytearray(db.serialize()))
    out.close()
    db.close()
