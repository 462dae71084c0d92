"""Keyed tables that are merged on read (K5, K7, K8, C3): a large base and small delta runs.

The base is a Parquet table bucketed and sorted by its key, so a join on the key moves the other side and not
the base. An upsert or a deletion writes its own rows as a run and touches nothing else; a reader puts the
newest run row of a key in the place of the base row; ``compact`` folds the runs into a new base. Base and
runs are folders under ``path``, complete when their ``_SUCCESS`` is there; the newest base names the runs that
it holds already by its number.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_GONE, _RUN = "_gone", "_run"


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the complete ``kind=<n>`` folders."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [st.getPath() for st in fs.listStatus(root) if st.getPath().getName().startswith(f"{kind}=")]
    return sorted(int(p.getName().removeprefix(f"{kind}=")) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _name(path: str, number: int) -> str:
    return f"keyed_{hashlib.sha256(path.encode()).hexdigest()[:16]}_{number}"


def _write_base(rows: DataFrame, path: str, number: int, key: str, buckets: int) -> None:
    (rows.repartition(buckets, key).sortWithinPartitions(key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", f"{path}/base={number}").saveAsTable(_name(path, number)))


def create(rows: DataFrame, path: str, key: str, buckets: int = 200) -> None:
    """The first base; ``key`` is unique. Choose ``buckets`` so that one fits a task comfortably, and not below
    ``spark.sql.shuffle.partitions``: with fewer Spark prefers to move both sides of a join."""
    _write_base(rows, path, 0, key, buckets)


def base(spark: SparkSession, path: str, key: str, buckets: int = 200) -> DataFrame:
    """The newest base as a bucketed table: joins and aggregates on the key need no exchange of it."""
    number = _numbers(spark, path, "base")[-1]
    name, folder = _name(path, number), f"{path}/base={number}"
    if not spark.catalog.tableExists(name):  # written by another session
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(folder).schema.fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{folder}'")
    return spark.table(name)


def write_run(rows: DataFrame, path: str, number: int, gone: bool = False) -> None:
    """A delta as run ``number`` (above every number before; the same again on a replay): rows that replace
    those of their key or are new, or, with ``gone``, keys that go. Of a key's rows in one run any stays."""
    rows.withColumn(_GONE, F.lit(gone)).write.mode("overwrite").parquet(f"{path}/run={number}")


def _runs(spark: SparkSession, path: str, upto: int | None) -> DataFrame | None:
    folded = _numbers(spark, path, "base")[-1]
    numbers = [n for n in _numbers(spark, path, "run") if n > folded and (upto is None or n <= upto)]
    if not numbers:
        return None
    schema = spark.read.parquet(f"{path}/base={folded}").schema.add(_GONE, "boolean")
    parts = [spark.read.schema(schema).parquet(f"{path}/run={n}").withColumn(_RUN, F.lit(n)) for n in numbers]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def read(spark: SparkSession, path: str, key: str, buckets: int = 200, upto: int | None = None) -> DataFrame:
    """The table as of its newest run (or run ``upto``): the runs are brought to one row per key, and only
    these are moved to the base."""
    stored, runs = base(spark, path, key, buckets), _runs(spark, path, upto)
    if runs is None:
        return stored
    rest = [c for c in stored.columns if c != key]
    newest = runs.groupBy(key).agg(F.max_by(F.struct(*rest, _GONE), _RUN).alias("_row"))
    kept = stored.join(newest.select(key), key, "left_anti")
    return kept.unionByName(newest.where(~F.col(f"_row.{_GONE}")).select(key, *[F.col(f"_row.`{c}`") for c in rest]))


def compact(spark: SparkSession, path: str, key: str, upto: int, buckets: int = 200) -> None:
    """Fold the runs up to ``upto`` into base ``upto``. Readers go on with the old base until it is complete;
    running it again gives the same."""
    if _numbers(spark, path, "base")[-1] < upto:
        _write_base(read(spark, path, key, buckets, upto), path, upto, key, buckets)
