"""Readers for the corpus, annotation, prediction and vector formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructType

from ..operators.vectors import read_vector_text  # noqa: F401  (word-vector text)

# --- fixed values: strings a pandas CSV reader treats as missing ---
NA_STRINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
              "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             na_strings: list[str] | None = NA_STRINGS, with_order: bool = False) -> DataFrame:
    """CSV with a header, quoted multi-line fields and doubled quotes.

    ``with_order`` adds ``_order`` = (file, position): multi-line CSV files
    are read one file per task, so the generated id follows file order."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = r.csv(path)
    if na_strings:
        df = df.select(*[F.when(F.col(f.name).cast("string").isin(na_strings), F.lit(None))
                         .otherwise(F.col(f.name)).alias(f.name)
                         if isinstance(f.dataType, StringType) else F.col(f.name)
                         for f in df.schema.fields])
    if with_order:
        df = df.withColumn("_order", F.struct(F.col("_metadata.file_path").alias("file"),
                                              F.monotonically_increasing_id().alias("pos")))
    return df


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files holding one JSON array of records each."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_json_map(spark: SparkSession, path: str, value_schema: StructType | str,
                  key_col: str = "post_id") -> DataFrame:
    """Files holding one JSON object ``{key: record}`` each -> one row per
    key.  A file is parsed by one task; many files parallelise."""
    if isinstance(value_schema, StructType):
        map_type = MapType(StringType(), value_schema)
    else:
        map_type = f"map<string, struct<{value_schema}>>"
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    m = F.from_json("value", map_type)
    return raw.select(F.explode(m).alias(key_col, "_v")).select(key_col, "_v.*")


def read_partitioned(spark: SparkSession, root: str, fmt: str = "json",
                     schema: StructType | str | None = None) -> DataFrame:
    """A directory tree ``root/key=value/...``; the keys become columns and
    filters on them prune whole directories."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    return r.load(root)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def committed(spark: SparkSession, pattern: str) -> list[str]:
    """The directories of a glob pattern whose writer has finished."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marker)
    return sorted(f.getPath().getParent().toString() for f in found or ())


def load_or_empty(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Stored results, or an empty table with the fixed schema."""
    if path_exists(spark, path):
        return spark.read.format(fmt).schema(schema).load(path)
    return spark.createDataFrame([], schema)
