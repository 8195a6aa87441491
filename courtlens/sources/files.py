"""Readers and writers of the files that the tables come from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtlens.functions.text import to_null


#: The column that holds a row as it was read if it doesn't fit its schema, and null else.
FAULT = "_fault"


def _with_fault(schema: str | T.StructType) -> T.StructType:
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return T.StructType([*kind.fields, T.StructField(FAULT, T.StringType())])


def _told(df: DataFrame) -> DataFrame:
    """FAULT by way of all columns (a hash of 64 bits is never below its least value), as Spark parses none for a plan that
    only asks for FAULT, and finds faults only in columns that it parses."""
    least = F.xxhash64(*[F.col(c).cast("string") for c in df.columns if c != FAULT]) >= F.lit(-(2**63))
    return df.withColumn(FAULT, F.when(least, F.col(FAULT)))


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, columns: Sequence[str] | None = None, faults: bool = False) -> DataFrame:
    """A CSV file with a header and a given schema; only the wanted columns are parsed.

    With ``faults`` all columns are, and rows that don't fit (too few or many fields, values of another type) come with
    their line in FAULT, so that ``fault_rows`` can report and ``sound_rows`` leave them out; else their fields are null.
    """
    read = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if faults:
        df = _told(read.schema(_with_fault(schema)).option("columnNameOfCorruptRecord", FAULT).csv(path))
        return df.select(*columns, FAULT) if columns else df
    df = read.schema(schema).csv(path)
    return df.select(*columns) if columns else df


def fault_rows(df: DataFrame, source: str) -> DataFrame:
    """(check, entity, detail): a row for each row that doesn't fit its schema, as the checks of ``quality`` give theirs.
    The frame comes from a reader with ``faults``."""
    return df.where(F.col(FAULT).isNotNull()).select(F.lit("unreadable_row").alias("check"), F.lit(source).alias("entity"), F.col(FAULT).alias("detail"))


def sound_rows(df: DataFrame) -> DataFrame:
    """The rows that fit their schema, without FAULT."""
    return df.where(F.col(FAULT).isNull()).drop(FAULT)


def read_csv_text(spark: SparkSession, path: str, key: str) -> DataFrame:
    """All columns as text; rows without a key go."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).where(to_null(key).isNotNull())


def read_json_array(spark: SparkSession, path: str, schema: str | T.StructType, defaults: dict[str, object] | None = None, faults: bool = False) -> DataFrame:
    """The objects of JSON arrays, with defaults for missing fields. With ``faults`` each object that doesn't fit the
    schema, and each file that is no array, comes as text in FAULT (see ``fault_rows``)."""
    if faults:
        files = spark.read.option("wholetext", True).text(path)
        each = files.select(F.explode(F.coalesce(F.from_json("value", "array<string>"), F.array("value"))).alias("o"))
        df = each.select(F.from_json("o", _with_fault(schema), {"columnNameOfCorruptRecord": FAULT}).alias("r")).select("r.*")
    else:
        df = spark.read.option("multiLine", True).schema(schema).json(path)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()})


def read_keyed_json(spark: SparkSession, path: str, value_schema: str, under: str | None = None, name: str = "team") -> DataFrame:
    """One row a key of a JSON object, or of the object under a key of it. A missing object has no rows."""
    inner = f"map<string,{value_schema}>"
    raw = spark.read.option("wholetext", True).text(path)
    parsed = F.from_json("value", f"struct<{under}:{inner}>")[under] if under else F.from_json("value", inner)
    return raw.select(F.explode(parsed).alias(name, "value"))


def lookup_keyed(keys: DataFrame, key: str, items: DataFrame, name: str, field: str) -> DataFrame:
    """Each key with its array field, empty where there is none."""
    kind = items.select(F.col(f"value.{field}").alias("x")).schema["x"].dataType
    found = items.select(F.col(name).alias("_k"), F.col(f"value.{field}").alias(field))
    return keys.join(found, F.col(key) == F.col("_k"), "left").withColumn(field, F.coalesce(field, F.array().cast(kind))).drop("_k")


def read_lines(spark: SparkSession, path: str, pattern: str = r"([0-9]{4})") -> DataFrame:
    """(file, year, pos, line): the lines of text files, numbered from 0 in the file's order, with the year in its name.

    A large file is read in splits by many tasks. The lines of a split are numbered where they are read, and what the
    splits before it hold comes from one count a split. Lines end with LF, CR LF or CR; the end of a file ends its last
    line and begins none. Files of one name in several folders are told apart.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    splits = read.groupBy("_path", "_at").agg(F.min("_id").alias("_from"), F.count("*").alias("_n"))
    before = Window.partitionBy("_path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_path", "_at", "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    file = F.url_decode(F.regexp_replace(F.regexp_extract("_path", "([^/]+)$", 1), r"\+", "%2B"))
    rows = read.join(splits, ["_path", "_at"]).select(file.alias("file"), (F.col("_before") + F.col("_id") - F.col("_from")).alias("pos"), "line")
    return rows.select("file", F.regexp_extract("file", pattern, 1).try_cast("int").alias("year"), "pos", "line")


def lines_of_year(lines: DataFrame, year: int, fallback: int = 2026) -> DataFrame:
    """The lines of a year's file, or of the fallback year's if there is none."""
    pick = lines.agg(F.coalesce(F.max(F.when(F.col("year") == year, F.lit(year))), F.lit(fallback)).alias("year"))
    return lines.join(F.broadcast(pick), "year", "left_semi")


def years(lines: DataFrame) -> DataFrame:
    return lines.where("year is not null").select("year").distinct().orderBy("year")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(key, file): lower-case name and name of each file; the contents aren't read."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"))
    return names.select(F.lower("file").alias("key"), "file")


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """The given columns in the given order, with a header."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    (df.select(*columns) if columns else df).write.mode("overwrite").parquet(path)
