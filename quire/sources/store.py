"""Tables in which a run replaces all that it had of its documents.

A table is a folder. rows/ has the current rows in buckets by a hash of the document's id. A replacement reads the buckets that its documents fall in, leaves these documents' rows out, adds the new ones, and
overwrites those buckets alone (partitionOverwriteMode=dynamic). What comes back is said by a list of documents, not by the rows, so a document without rows is emptied.

Where runs are small and many, as those of a stream, each would write whole buckets for a few documents. They append instead: runs/ has rows, and lists/, written after them, the documents of each run.
A run without its list isn't there yet. current() lets the last run of a document hide its rows, and fold() replaces the documents of all runs at once, after which a read touches no superseded row.

What goes into the buckets is written to next/ before they are touched, so an overwrite that was broken off is made again by whoever comes next. One writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

BUCKETS, BUCKET, RUN = 256, "bucket", "run"


def _system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _system(spark, path)
    return system.exists(at)


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        system, at = _system(spark, path)
        system.delete(at, True)


def _placed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int"))


def _read(spark: SparkSession, path: str, form: str, schema: StructType | None) -> DataFrame | None:
    """A folder's table with its own columns by schema and the folders' one; None if there is none."""
    if not exists(spark, path):
        return None
    reader = spark.read.option("basePath", path)
    if schema is not None:
        folder = StructField(BUCKET, IntegerType()) if path.endswith("/rows") else StructField(RUN, StringType())
        return reader.schema(StructType([*[f for f in schema.fields if f.name != folder.name], folder])).format(form).load(path)
    return reader.format(form).load(path)


def _table(spark: SparkSession, root: str) -> tuple[int, StructType] | None:
    """Number of buckets and columns of a table, which it keeps beside its rows; files needn't be asked."""
    if not exists(spark, f"{root}/table"):
        return None
    known = json.loads(spark.read.text(f"{root}/table", wholetext=True).first()[0])
    return known["buckets"], StructType.fromJson(known["schema"])


def _note(spark: SparkSession, root: str, buckets: int, schema: StructType) -> None:
    said = json.dumps({"buckets": buckets, "schema": schema.jsonValue()})
    spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/table")


def _overwrite(spark: SparkSession, root: str, form: str, touched: list[int]) -> None:
    """Put next/ into its buckets; those that it has nothing for are emptied. Doing it twice is doing it once."""
    fresh = spark.read.format("parquet").load(f"{root}/next/rows")
    filled = [r[0] for r in fresh.select(BUCKET).distinct().collect()]  # of the table's number of buckets at most
    fresh = fresh.select("value", BUCKET) if form == "json" else fresh
    kind = "text" if form == "json" else form
    fresh.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).format(kind).save(f"{root}/rows")
    drop(spark, *[f"{root}/rows/{BUCKET}={b}" for b in set(touched) - set(filled)])
    done = [r[0] for r in spark.read.text(f"{root}/next/runs").collect()] if exists(spark, f"{root}/next/runs") else []
    drop(spark, *[f"{root}/{kind}/{RUN}={run}" for run in done for kind in ("lists", "runs")])
    drop(spark, f"{root}/next")


def recover(spark: SparkSession, root: str, form: str = "parquet") -> None:
    """Finish a replacement that was broken off: made again if all of it had been written, else dropped, as nothing was touched."""
    if exists(spark, f"{root}/next"):
        if exists(spark, f"{root}/next/ready"):
            _overwrite(spark, root, form, [int(r[0]) for r in spark.read.text(f"{root}/next/ready").collect()])
        else:
            drop(spark, f"{root}/next")


def replace(fresh: DataFrame, documents: DataFrame, root: str, key: str = "doc_id", form: str = "parquet", buckets: int = BUCKETS, runs: list[str] | None = None) -> None:
    """Make fresh the rows of the documents (a column like key), and of those alone; rows of fresh whose document isn't among them are left out. runs: appended ones that this settles."""
    spark = fresh.sparkSession
    recover(spark, root, form)
    n, known = _table(spark, root) or (buckets, None)
    ids = _placed(documents.select(F.col(key).cast("string").alias("_id")).filter("_id is not null").distinct(), "_id", n)
    spot = f"{root}/next"
    ids.write.mode("overwrite").parquet(f"{spot}/documents")
    ids = spark.read.parquet(f"{spot}/documents")
    touched = [r[0] for r in ids.select(BUCKET).distinct().collect()]  # of the number of buckets at most
    names = ids.select("_id")
    lines, columns = form == "json", {f.name: f for f in (known.fields if known else [])}  # of JSON what stays isn't parsed: it is moved line by line
    columns = {f.name: f for f in fresh.schema.fields} | columns
    fresh = fresh.select(key, F.to_json(F.struct(*fresh.columns)).alias("value")) if lines else fresh
    new = _placed(fresh.join(names, F.col(key).cast("string") == F.col("_id"), "left_semi"), key, n)
    old = _read(spark, f"{root}/rows", "text" if lines else form, StructType([StructField("value", StringType())]) if lines else known)
    old = old.withColumn(key, F.get_json_object("value", f"$.{key}")) if lines and old is not None else old
    if old is not None:
        kept = old.filter(F.col(BUCKET).isin(touched))
        new = new.unionByName(kept.join(names, F.col(key).cast("string") == F.col("_id"), "left_anti"), allowMissingColumns=True)
    new.write.mode("overwrite").parquet(f"{spot}/rows")
    _note(spark, root, n, StructType(list(columns.values())) if lines else StructType([f for f in new.schema.fields if f.name != BUCKET]))
    if runs:
        spark.createDataFrame([(r,) for r in runs], "value string").coalesce(1).write.mode("overwrite").text(f"{spot}/runs")
    spark.createDataFrame([(str(b),) for b in touched], "value string").coalesce(1).write.mode("overwrite").text(f"{spot}/ready")
    _overwrite(spark, root, form, touched)


def remove(documents: DataFrame, root: str, key: str = "doc_id", form: str = "parquet") -> None:
    """Take the documents out of a table, if it is there."""
    spark = documents.sparkSession
    fold(spark, root, key, form)
    if known := _table(spark, root):
        replace(spark.createDataFrame([], known[1]), documents, root, key, form)


def append(fresh: DataFrame, documents: DataFrame, root: str, run: str, key: str = "doc_id") -> None:
    """A run of documents as rows beside the buckets; the same run again replaces itself. Runs count in the order of their names."""
    run = f"r-{run}"  # never read as a number
    drop(fresh.sparkSession, f"{root}/lists/{RUN}={run}")
    ids = documents.select(F.col(key).cast("string").alias("_id")).filter("_id is not null").distinct()
    fresh.write.mode("overwrite").parquet(f"{root}/runs/{RUN}={run}")
    ids.write.mode("overwrite").parquet(f"{root}/lists/{RUN}={run}")


def _pending(spark: SparkSession, root: str) -> list[str]:
    """Appended runs that aren't folded: a folder each."""
    if not exists(spark, f"{root}/lists"):
        return []
    system, at = _system(spark, f"{root}/lists")
    return [f.getPath().getName().split("=", 1)[1] for f in system.listStatus(at) if f.getPath().getName().startswith(f"{RUN}=")]


def _last(spark: SparkSession, root: str) -> DataFrame:
    """_id and _run: the last run of each document in the lists."""
    lists = _read(spark, f"{root}/lists", "parquet", StructType([StructField("_id", StringType())]))
    return lists.groupBy("_id").agg(F.max("run").alias("_run"))


def _fresh(spark: SparkSession, root: str, last: DataFrame, key: str) -> DataFrame:
    """The rows of each document's last run."""
    runs = spark.read.option("basePath", f"{root}/runs").option("mergeSchema", True).parquet(f"{root}/runs")
    return runs.join(last, (F.col(key).cast("string") == F.col("_id")) & (F.col(RUN) == F.col("_run")), "left_semi").drop(RUN)


def current(spark: SparkSession, root: str, key: str = "doc_id", form: str = "parquet", schema: StructType | None = None) -> DataFrame:
    """The table's rows: those of the buckets, and of runs that aren't folded yet the last of each document, which hide what was there before."""
    recover(spark, root, form)
    known = _table(spark, root)
    rows = _read(spark, f"{root}/rows", form, schema or (known and known[1])) if known else None
    rows = None if rows is None else rows.drop(BUCKET)
    if not _pending(spark, root):
        if rows is None and schema is None:
            raise FileNotFoundError(root)
        return rows if rows is not None else spark.createDataFrame([], schema)
    last = _last(spark, root)
    fresh = _fresh(spark, root, last, key)
    if rows is None:
        return fresh
    return rows.join(last, F.col(key).cast("string") == F.col("_id"), "left_anti").unionByName(fresh, allowMissingColumns=True)


def fold(spark: SparkSession, root: str, key: str = "doc_id", form: str = "parquet", buckets: int = BUCKETS) -> None:
    """Move appended runs into the buckets; nothing to do without any."""
    recover(spark, root, form)
    if every := _pending(spark, root):
        last = _last(spark, root)
        replace(_fresh(spark, root, last, key), last.select(F.col("_id").alias(key)), root, key, form, buckets, every)
