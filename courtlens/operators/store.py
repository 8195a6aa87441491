"""Keyed tables: upserts, reloads, resumes, surrogate ids, retention, and publishing a new version."""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from courtlens.functions.text import to_null
from courtlens.operators.joins import last_by, settling
from courtlens.operators.ranks import rank_rows


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], ordinal: Sequence[str]) -> DataFrame:
    """The last update of a key replaces its row whole; new keys are added. Twice is as once."""
    last = last_by(updates, keys, ordinal).select(*target.columns)
    return target.join(last, list(keys), "left_anti").select(*target.columns).unionByName(last)


def insert_absent(dim: DataFrame, id_col: str, name: str, names: DataFrame) -> DataFrame:
    """Add the distinct new names, in order, with ids that go on from the highest (see ``rank_rows``)."""
    fresh = names.select(name).where(F.col(name).isNotNull()).distinct().join(dim.select(name), name, "left_anti")
    top = dim.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    numbered = rank_rows(fresh, [F.col(name)], "_n")
    return dim.unionByName(numbered.join(F.broadcast(top)).select((F.col("_top") + F.col("_n")).cast(dim.schema[id_col].dataType).alias(id_col), name))


def reload_partition(target: DataFrame, fresh: DataFrame, partition: Column, values: Sequence[object]) -> DataFrame:
    """The rows of the given partition values give way to the fresh ones."""
    return target.where(~F.coalesce(partition.isin(*values), F.lit(False))).unionByName(fresh.select(*target.columns))


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Rewrite only the partitions that the frame has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def resume(targets: DataFrame, keys: Sequence[str], done: DataFrame, manifest: DataFrame) -> DataFrame:
    """Targets that neither the output nor the manifest of fruitless attempts has."""
    return targets.join(done.select(*keys).unionByName(manifest.select(*keys)), list(keys), "left_anti")


def fruitless(attempted: DataFrame, keys: Sequence[str], result: DataFrame) -> DataFrame:
    return attempted.select(*keys).distinct().join(result, list(keys), "left_anti")


def keep_latest(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group in the order given, ties by the other columns."""
    w = Window.partitionBy(*group).orderBy(*order, *settling(df, group))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def seed_missing(dim: DataFrame, key: str, keys: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """A row for every key; defaults stand in where a field is missing or blank."""
    out = keys.select(key).where(F.col(key).isNotNull()).distinct().join(dim, key, "full_outer")
    return out.withColumns({c: F.coalesce(to_null(c), F.lit(v)) for c, v in defaults.items()}).select(*dim.columns)


@dataclass
class Audit:
    """Counts of tables, taken while they are written (see ``observed``), and the instants of the run."""

    started: datetime.datetime = field(default_factory=lambda: datetime.datetime.now(datetime.timezone.utc))
    counts: dict[str, Observation] = field(default_factory=dict)

    def observed(self, name: str, df: DataFrame) -> DataFrame:
        """The frame, whose rows are counted when it is written, without being read again. Give each name once, and each
        frame to one write."""
        self.counts[name] = Observation(f"{name}-{uuid.uuid4().hex}")
        return df.observe(self.counts[name], F.count(F.lit(1)).alias("n"))

    def row(self, spark: SparkSession, **known: object) -> DataFrame:
        """One row when all is written: started and finished as two instants, what else is ``known`` (strings, numbers, None
        as text), and ``n_`` of each table. It waits for tables that are still being written."""
        counts = {f"n_{name}": int(o.get["n"]) for name, o in self.counts.items()}
        times = {"started": self.started, "finished": datetime.datetime.now(datetime.timezone.utc)}
        value = lambda k, v: F.lit(v).cast("string") if v is None else F.lit(v).cast("long") if k in counts else F.lit(v)
        return spark.range(1).select(*[value(k, v).alias(k) for k, v in (times | known | counts).items()])


def audit_row(tables: dict[str, DataFrame], run: dict[str, object] | None = None) -> DataFrame:
    """One row of counts, a column a table, for tables that nothing writes (each is read for it; else see ``Audit``);
    ``run`` adds what else is known of the run (season, notes; times as the caller gives them)."""
    counts = [df.agg(F.count("*").alias(f"n_{name}")) for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(c, how="cross")
    return out.select(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in (run or {}).items()], "*")


class PublishedMeanwhile(RuntimeError):
    """Another publisher has committed since this one began; nothing of this one's is seen."""


def _files(spark: SparkSession, path: str):
    """Hadoop's view of the store that a path is in, and the path there."""
    jvm, at = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return jvm, at.getFileSystem(conf), at, conf


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(number, version, folder) of all commits of a published table; no rows before the first."""
    _, fs, at, _ = _files(spark, f"{path}/_commits")
    schema = "version string, folder string"
    if not fs.exists(at):
        return spark.createDataFrame([], f"number long, {schema}")
    found = spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{path}/_commits")
    return found.select(F.regexp_extract(F.col("_metadata.file_name"), r"^([0-9]+)\.json$", 1).cast("long").alias("number"), "version", "folder")


def publish(df: DataFrame, path: str, version: str, replace: bool = False) -> str:
    """Write a new version in a folder of its own and make it the live one; returns the folder.

    The data come first, then a commit record that names them, written whole beside and renamed to the next number. The
    rename doesn't replace a file, so of two publishers that began on the same state one gets ``PublishedMeanwhile``. A
    folder that no record names (its publisher died) is never read. A version that is there already is an error unless
    ``replace``: then it is committed again.
    """
    spark, known = df.sparkSession, commits(df.sparkSession, path)
    last, again = known.agg(F.coalesce(F.max("number"), F.lit(0)), F.coalesce(F.max((F.col("version") == version).cast("int")), F.lit(0))).first()
    if again and not replace:
        raise ValueError(f"version {version} is published already")
    folder = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    jvm, fs, draft, conf = _files(spark, f"{path}/_commits/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"version": version, "folder": folder}).encode()))
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{path}/_commits/{last + 1:020d}.json")
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    whole = fs.makeQualified(draft)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), conf).rename(whole, fs.makeQualified(final), options)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if fs.exists(final):
            raise PublishedMeanwhile(f"commit {last + 1} of {path} is another publisher's") from e
        raise
    return f"{path}/{folder}"


def current(spark: SparkSession, path: str, below: str | None = None) -> DataFrame:
    """The version that was committed last, or the last one below a given version (versions compare as text)."""
    known = commits(spark, path)
    known = known.where(F.col("version") < below) if below else known
    folder = known.agg(F.max_by("folder", "number")).first()[0]  # one value
    if folder is None:
        raise FileNotFoundError(f"no version of {path} is published")
    return spark.read.parquet(f"{path}/{folder}")
