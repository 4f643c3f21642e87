"""Readers with declared schemas: event logs, topics, command files, balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passbook.functions.ids import is_canonical_uuid, nil_to_null
from passbook.schema import ACCOUNT_COMMAND, TRANSFER_COMMAND, event_log_schema

CORRUPT = "_corrupt_record"


def _glob(path: str) -> str:
    """A path that a file stream accepts for a directory and for a single file."""
    return f"{path[:-1]}[{path[-1]}]" if path.endswith(".parquet") else path


def stream_table(
    spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None
) -> DataFrame:
    """New files of a Parquet table as they appear."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(_glob(path))


def read_event_log(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """The whole log; order is applied where a fold needs it, not here."""
    return spark.read.schema(schema or event_log_schema()).parquet(path)


def read_ranges(spark: SparkSession, path: str, schema: T.StructType, width: int, after: int) -> DataFrame:
    """The events behind position ``after`` of a log in ranges; ranges before it are not read."""
    full = T.StructType([*schema.fields, T.StructField("range", T.LongType())])
    rows = spark.read.schema(full).parquet(path)
    return rows.where((F.col("range") >= after // width) & (F.col("seq") > after)).drop("range")


def tail_event_log(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """The log as a change feed."""
    return stream_table(spark, path, schema or event_log_schema(), max_files)


def subscribe_topic(stream: DataFrame, topic: str, column: str = "topic") -> DataFrame:
    """Messages of one topic, all its partitions (``topic.1``, ``topic.2``, ...)."""
    c = F.col(column)
    return stream.where((c == topic) | c.startswith(f"{topic}."))


def subscribe_kafka(spark: SparkSession, servers: str, topics: str, **options: str) -> DataFrame:
    """The same rows from a message bus; needs the Kafka connector on the class path."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topics)
        .options(**options)
        .load()
    )
    row = F.from_json(F.col("value").cast("string"), event_log_schema())
    return raw.select("topic", row.alias("row")).select("topic", "row.*")


def _json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(full)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def read_account_commands(spark: SparkSession, path: str) -> DataFrame:
    """owner, malformed; a malformed line keeps its row, without an owner."""
    df = _json(spark, path, ACCOUNT_COMMAND)
    return df.select("owner", F.col(CORRUPT).isNotNull().alias("malformed"))


def transfer_commands(df: DataFrame) -> DataFrame:
    """Normalise raw commands: absent, empty and nil ids mean "no leg"."""
    from_id, to_id = nil_to_null("from"), nil_to_null("to")
    good_from = from_id.isNull() | is_canonical_uuid("from")
    good_to = to_id.isNull() | is_canonical_uuid("to")
    return df.select(
        from_id.alias("from_id"),
        to_id.alias("to_id"),
        F.coalesce("money", F.lit(0)).alias("money"),
        (F.col(CORRUPT).isNull() & good_from & good_to).alias("valid"),
    )


def read_transfer_commands(spark: SparkSession, path: str) -> DataFrame:
    return transfer_commands(_json(spark, path, TRANSFER_COMMAND))


def read_balances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BALANCES).parquet(path)


BALANCES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("balance", T.LongType()),
        T.StructField("owner", T.StringType()),
    ]
)
