"""CSV files of machine readings, read as text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwatch.functions.scalar import iso_second
from millwatch.operators.normalize import canonical_order, null_tokens_to_null
from millwatch.session import stage
from millwatch.sources.files import stored_bytes
from millwatch.sources.records import has_quoted_breaks, quoted_records, text_lines

_BROKEN = "_broken_line"


def _with_file_numbers(df: DataFrame, name: str) -> DataFrame:
    """Number rows in file order: by file, block of the file, line.

    Rows of one block come one after another from the same scan task, so only
    the number of rows per block has to be known; nothing is sorted.
    """
    ordered = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        df.groupBy("_file", "_start")
        .agg(F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .select(
            "_file", "_start", "_first",
            F.coalesce(F.sum("_rows").over(ordered), F.lit(0)).alias("_offset"),
        )
    )
    return (
        df.join(blocks, ["_file", "_start"])
        .withColumn(name, F.col("_offset") + F.col("_slot") - F.col("_first") + 1)
        .drop("_file", "_start", "_slot", "_first", "_offset")
    )


def load_csv(
    spark: SparkSession, path: str, row_number: str | None = None, multi_line: bool | None = None
) -> DataFrame:
    """Read a CSV with a header; all columns are strings, missing texts null.

    The text is parsed once, into a staged table that every later pass reads.
    Short lines are filled with nulls, lines with too many fields are refused.
    With ``row_number``, a column of that name numbers the rows from 1.  Fields in
    quotes may hold line breaks; one scan looks for them, which ``multi_line`` saves
    where it is known whether there are any.  Either way a file is read by as many
    tasks as it has blocks.
    """
    lines = text_lines(spark, path)
    if multi_line is None:
        multi_line = has_quoted_breaks(lines)
    quoting = {"escape": '"', "mode": "PERMISSIVE"}
    reader = spark.read.option("header", True).options(**quoting)
    header = reader.option("multiLine", multi_line).csv(path).columns
    if not header:
        raise ValueError("The CSV is empty.")
    names = [f"c{i}" for i in range(len(header))]
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*names, _BROKEN]])
    if multi_line:
        parsing = {**quoting, "multiLine": "true", "columnNameOfCorruptRecord": _BROKEN}
        ddl = ", ".join(f"{name} string" for name in schema.fieldNames())
        parsed = quoted_records(lines, stored_bytes(spark, path)).select(F.from_csv("_record", ddl, parsing).alias("_row"), "_number").select("_row.*", "_number")
    else:
        reader = spark.read.option("header", True).options(**quoting).option("columnNameOfCorruptRecord", _BROKEN)
        parsed = reader.schema(schema).csv(path).withColumns(
            {
                "_file": F.col("_metadata.file_path"),
                "_start": F.col("_metadata.file_block_start"),
                "_slot": F.monotonically_increasing_id(),
            }
        )
    rows = stage(parsed, "csv")
    if rows.isEmpty():
        raise ValueError("The CSV is empty.")
    # A line is reported for too few fields as well; only a further field counts.
    wider = ", ".join(f"f{i} string" for i in range(len(header) + 1))
    fields = F.from_csv(
        _BROKEN, f"{wider}, over string",
        {**quoting, "multiLine": str(multi_line).lower(), "columnNameOfCorruptRecord": "over"},
    )
    further = F.col("fields")[f"f{len(header)}"].isNotNull() | F.col("fields")["over"].isNull()
    too_long = (
        rows.where(F.col(_BROKEN).isNotNull())
        .select(_BROKEN, fields.alias("fields"))
        .where(further)
        .first()
    )
    if too_long is not None:
        raise ValueError(
            f"The file is not a valid CSV: more fields than the header has in {too_long[_BROKEN]!r}."
        )
    if row_number is None:
        return null_tokens_to_null(rows.select(*names)).toDF(*header)
    if not multi_line:
        rows = _with_file_numbers(rows.drop(_BROKEN), "_number")
    return null_tokens_to_null(rows.select(*names, "_number")).toDF(*header, row_number)


def export_test_csv(prepared_split: DataFrame, path: str) -> None:
    """Write the cleaned test split, unscaled and in canonical order, as CSV."""
    kept = [
        c for c in prepared_split.columns
        if not c.endswith("__scaled") and c not in ("split", "split_position")
    ]
    test = canonical_order(prepared_split.where(F.col("split") == "test").select(*kept))
    test.withColumn("timestamp", iso_second(F.col("timestamp"))).write.option(
        "header", True
    ).mode("overwrite").csv(path)
