"""Reading: the raw text export, landed tables, stored vectors and legacy list columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from themescope import fixed_values as fv
from themescope.functions.dates import parse_utc
from themescope.functions.nulls import null_tokens, whole_id
from themescope.operators.ordering import ensure_id
from themescope.operators.preparation import require_columns
from themescope.schemas import FEATURES, RAW_COMPLAINTS


def read_raw_csv(
    spark: SparkSession, path: str, schema: StructType = RAW_COMPLAINTS,
    missing: Iterable[str] = (), columns: Iterable[str] | None = None,
) -> DataFrame:
    """The raw export: quoted multi-line CSV with a header, columns matched by name.

    ``missing`` lists spellings of "no value" besides the empty field; they are applied to
    ``columns`` (all by default).  Multi-line CSV cannot be split, so keep the export in many
    files and land it once with :func:`land_raw`.
    """
    header = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option(
        "escape", '"'
    ).option("encoding", "UTF-8").option("enforceSchema", False)
    names = header.csv(path).columns
    wide = StructType().fromJson({"type": "struct", "fields": [
        {"name": n, "type": "string", "nullable": True, "metadata": {}} for n in names
    ]})
    raw = require_columns(header.schema(wide).csv(path), schema.names)
    raw = raw.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields])
    tokens = list(missing)
    return null_tokens(raw, list(columns or schema.names), tokens) if tokens else raw


def land_raw(raw: DataFrame, path: str) -> DataFrame:
    """Write the raw rows once as typed Parquet, one folder per month.

    Later runs then skip whole months and whole columns, and the date test is a plain pushed
    comparison.  Rows whose date cannot be read land in the NULL month.  Rows are rebalanced by
    month before writing: a folder gets few large files, and a month that holds much of the data
    is split over several tasks.
    """
    typed = raw.withColumns({
        "Date received": parse_utc(F.col("`Date received`")).cast("date"),
        "Complaint ID": whole_id(F.col("`Complaint ID`")),
    }).withColumn("month", F.date_format("`Date received`", "yyyy-MM"))
    typed.hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(path)
    return raw.sparkSession.read.parquet(path)


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A landed stage table; with a schema no file is opened to infer one."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_ids(spark: SparkSession, path: str, key: str = "complaint_id") -> DataFrame:
    """Only the key column of a stage table."""
    return read_table(spark, path).select(key)


def spread(scan: DataFrame) -> DataFrame:
    """Give costly text work all cores when the table is stored in fewer splits than that.

    A large table has many splits and is returned as it is: no shuffle.  Call it on a plain scan.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def try_read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if nothing was written there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Stored vectors; an error tells the caller to embed first."""
    stored = try_read(spark, path)
    if stored is None:
        raise FileNotFoundError(f"no stored vectors at {path}: embed the texts first")
    return require_columns(stored, FEATURES.names).select(*FEATURES.names)


def decode_list(text: Column) -> Column:
    r"""A list column that was stored as Python-style text, as an array; NULL if it is no list.

    ``\xNN`` becomes the JSON escape of the same character and an unquoted ``None`` a missing item.
    """
    # An escape counts only after an even number of backslashes; quoted items keep a None inside them.
    text = F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
    text = F.regexp_replace(text, r"(?<=[\[,])(\s*)None(?=\s*(?:,\s*(?:['\"]|None\b)|,?\s*\]$))", "$1null")
    return F.from_json(text, "array<string>", {
        "allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true",
    })


def read_upload(df: DataFrame, text: str = "narrative", key: str = "complaint_id") -> DataFrame:
    """A user's table: the text column is required, a missing id is made up."""
    return ensure_id(require_columns(df, [text]), key)


def since_partition(landed: DataFrame, minimum: str = fv.MIN_DATE) -> DataFrame:
    """Landed rows on or after a day: the month folder is pruned, the day test is pushed down."""
    day = F.lit(minimum).cast("date")
    return landed.filter((F.col("month") >= minimum[:7]) & (F.col("`Date received`") >= day))
