"""Delimited text whose rows may be malformed: good rows typed, bad ones kept aside with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BAD = "_malformed"
FIELDS, TYPES = "number of fields", "value of the wrong type"


def checked_rows(spark: SparkSession, paths: str | list[str], schema: StructType, out: str, header: bool = False, delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of the files at paths, both written below out in one pass.

    rows has the schema's columns. quarantine has file, text (the line as it was) and reason: the line has another number of fields, or
    a field can't be read as its column's type. Empty fields are null and no error; empty lines are no rows; a quoted field may hold the
    delimiter. No line is lost and none stops the job. The header, if any, is skipped in each file and its names aren't looked at.
    """
    wide = StructType([*schema.fields, StructField(BAD, StringType())])
    options = {"header": header, "sep": delimiter, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, "enforceSchema": True}
    read = spark.read.schema(wide).options(**options).csv(paths)
    # A line that can't even be read as text in every column hasn't as many fields.
    plain = StructType([*(StructField(f"c{i}", StringType()) for i in range(len(schema))), StructField(BAD, StringType())])
    again = F.from_csv(F.col(BAD), ", ".join(f"{f.name} string" for f in plain.fields), {"sep": delimiter, "columnNameOfCorruptRecord": BAD})
    reason = F.when(F.col(BAD).isNull(), F.lit(None)).when(again[BAD].isNotNull(), FIELDS).otherwise(TYPES)
    read.select("*", F.input_file_name().alias("_file"), reason.alias("_reason"), F.col(BAD).isNotNull().alias("_bad")).write.partitionBy("_bad").parquet(out)
    whole = StructType([*wide.fields, StructField("_file", StringType()), StructField("_reason", StringType())])
    stored = spark.read.schema(whole.add("_bad", "boolean")).parquet(out)
    rows = stored.where("NOT _bad").select(*(F.col(f"`{f.name}`") for f in schema.fields))
    return rows, stored.where("_bad").select(F.col("_file").alias("file"), F.col(BAD).alias("text"), F.col("_reason").alias("reason"))
