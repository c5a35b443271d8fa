"""Readers: delimited text split at the last separator, CSV, JSON lines, metrics documents, manifests, JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS_LINE = r"^(.*);([^;]*)$"
CONVERSATION = T.StructType([T.StructField(c, T.StringType()) for c in ("system", "user", "assistant")])
MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in ("origin", "skill", "dataset_slug", "evidence")])
DEFAULT_SYSTEM = "You are a concise, helpful assistant."


def split_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """text and label of lines `text;label`, split at the last `;`. Blank lines are skipped; a line without a separator has nulls and its text in `malformed`."""
    v = F.col(value)
    ok = v.rlike(CORPUS_LINE)
    return lines.where(F.trim(v) != "").select(F.when(ok, F.regexp_extract(v, CORPUS_LINE, 1)).alias("text"), F.when(ok, F.regexp_extract(v, CORPUS_LINE, 2)).alias("label"), F.when(~ok, v).alias("malformed"))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    return split_lines(spark.read.text(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None, sep: str = ",") -> DataFrame:
    """A typed CSV of which only the named columns are parsed."""
    df = spark.read.csv(path, schema=schema, header=True, sep=sep)
    return df.select(*columns) if columns else df


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an explicit order, as input order isn't one."""
    return df.orderBy(*order).limit(n)


def sniff(spark: SparkSession, path: str, candidates: str = ",;\t|") -> str:
    """The separator that the header line has most of."""
    head = spark.read.text(path).limit(1).first()
    return max(candidates, key=lambda c: (head["value"].count(c), -candidates.index(c))) if head else candidates[0]


def read_sniffed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, sep=sniff(spark, path))


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of system (optional), user, assistant."""
    return spark.read.json(path, schema=CONVERSATION).withColumn("system", F.coalesce("system", F.lit(DEFAULT_SYSTEM)))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON documents with the file that each came from."""
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=MANIFEST, header=True)


def read_sqlite(spark: SparkSession, url: str, table: str, driver: str = "org.sqlite.JDBC") -> DataFrame:
    """A table through JDBC; the driver's jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, driver=driver).load()


def read_sqlite_files(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """A table of SQLite files, each read by one task from its bytes, so they can lie in any store that Spark reads. Columns go by the schema's order."""
    import sqlite3

    import pyarrow as pa

    fields = T._parse_datatype_string(schema)
    names = ", ".join(f'"{f.name}"' for f in fields)

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                db = sqlite3.connect(":memory:")
                db.deserialize(data)
                rows = db.execute(f'SELECT {names} FROM "{table}"')
                while some := rows.fetchmany(10_000):
                    yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r, strict=True)) for r in some], out)
                db.close()

    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(fields)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, fields)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Dense vectors kept as array<float> in Parquet, widened for exact products."""
    df = spark.read.parquet(path)
    return df.select(*[F.col(c).cast("array<double>").alias(c) if k == "array<float>" else c for c, k in df.dtypes])


def many_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that fails at run time where the right side repeats a key."""
    unique = right.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in right.columns if c != key])
    checked = unique.where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("key repeats: "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))).drop("_n")
    return left.join(checked, key)
