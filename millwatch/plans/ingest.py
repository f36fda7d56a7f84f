"""Ingest: any table of readings becomes a canonical batch."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch import fixed
from millwatch.operators.ids import repeated_id
from millwatch.operators.normalize import (
    available_sensors, canonical_select, is_label_word, label_of, normalize_columns, number_of, slug,
    time_readings, timeline_moment, with_sample_ids,
)
from millwatch.session import stage_observed
from millwatch.sources.csv_source import load_csv
from millwatch.sources.tables import ResultTables, new_id, raw_rows, utc_now


#: Columns that a batch can use beside its sensors.
CANONICAL_NAMES = ("machine_id", "timestamp", "failure_label")


@dataclass(frozen=True)
class Ingested:
    """A canonical batch: the readings and what was found out about them."""

    readings: DataFrame
    batch_id: str
    source: str
    features: tuple[str, ...]
    missing: tuple[str, ...]
    label_available: bool
    renamed: dict[str, str]
    notes: tuple[str, ...] = field(default=())


def _checks(
    named: DataFrame, columns: dict[str, Column], times: Sequence[Column], id_name: str | None
) -> dict[str, Column]:
    """Counts that tell what has to be known about the values; of the ways to read times, only the first is looked at."""
    tests = {"rows": F.lit(True), **dict.fromkeys(("lost_ids", "lost_machines", "label_words", "lost_times"), F.lit(False))}
    for moment in times[:1]:
        tests["lost_times"] = moment.isNull()
    if id_name is not None:
        tests["lost_ids"] = F.col(id_name).try_cast("long").isNull()
    if "machine_id" in columns:
        tests["lost_machines"] = columns["machine_id"].isNull()
    if "failure_label" in named.columns:
        tests["label_words"] = is_label_word(named)
    return {name: F.count_if(test) for name, test in tests.items()}


def _readable_time(named: DataFrame, times: Sequence[Column], lost: int) -> Column:
    """The first way to read times that reads the whole column.

    A text that a form does not fit costs far more than one that it fits, so forms are
    tried in turn, each only up to the first rows that it loses.
    """
    if not lost:
        return times[0]
    for moment in times[1:]:
        if named.where(moment.isNull()).limit(1).isEmpty():
            return moment
    raise ValueError("Some timestamps cannot be read; use ISO times or give a format.")


def _check_ids(named: DataFrame, id_name: str, lost: int) -> None:
    """Refuse ids that are no numbers or not unique; ranks and draws rely on them."""
    if lost:
        raise ValueError(f"{lost} rows have no readable number in the id column {id_name!r}.")
    repeated = repeated_id(named, F.col(id_name))
    if repeated is not None:
        raise ValueError(f"The id column {id_name!r} repeats values, such as {repeated}.")


def ingest(
    df: DataFrame,
    source: str = "table",
    id_column: str | None = None,
    order: Sequence[str] | None = None,
    time_format: str | Sequence[str] | None = None,
    epoch_unit: str | None = None,
    unique_ids: bool = False,
    stored: bool = False,
    tables: ResultTables | None = None,
    batch_id: str | None = None,
) -> Ingested:
    """Normalise names, types, ids, times and labels, and store the raw rows.

    Sample ids come from ``id_column`` if there is one, otherwise from numbering
    the rows by ``order`` or as they are read.  Given ids must be unique numbers;
    that costs passes over the ids, which ``unique_ids`` saves if they are known
    to be.  Times are read as ISO, by ``time_format`` (one form, or several of
    which the first that reads the whole column counts) or as counts since 1970
    in ``epoch_unit``.  The source is read once, into a staged copy of the columns in
    use, and looked at while it is copied; a frame that is ``stored`` already is read
    in place instead.  Raw rows are stored once for each ``batch_id``, however often a
    job with that id is tried.
    """
    named, renamed = normalize_columns(df)
    features, missing = available_sensors(named.columns)
    columns = {name: number_of(F.col(name), named.schema[name].dataType) for name in features}
    if "machine_id" in named.columns:
        columns["machine_id"] = F.col("machine_id").cast("string")
    times = []
    if "timestamp" in named.columns:
        data_type = named.schema["timestamp"].dataType
        times = time_readings(F.col("timestamp"), data_type, time_format, epoch_unit)
    id_name = None if id_column is None else slug(id_column)
    checks = _checks(named, columns, times, id_name)
    used = {*columns, *CANONICAL_NAMES, *map(slug, (id_column or "", *(order or ())))}
    kept = named.select(*[name for name in named.columns if name in used] or [F.lit(None).alias("_none")])
    numbered = None
    if id_name is None and not order:
        # numbering the rows as they are read copies them already
        named = numbered = with_sample_ids(kept)
    if numbered is None and not stored:
        named, found = stage_observed(kept, checks, "source")
    else:
        found = named.agg(*[check.alias(name) for name, check in checks.items()]).first().asDict()
    if not found["rows"]:
        raise ValueError(f"The input is empty: {source}")
    if not features:
        raise ValueError(
            "No recognised sensor column; at least one is needed of: " + ", ".join(fixed.SENSORS)
        )
    if times:
        columns["timestamp"] = _readable_time(named, times, found["lost_times"])
    if id_name is not None and not unique_ids:
        _check_ids(named, id_name, found["lost_ids"])

    notes = []
    if numbered is None:
        numbered = with_sample_ids(named, id_name, [slug(c) for c in order] if order else None)
    if "machine_id" not in columns:
        columns["machine_id"] = F.lit(fixed.DEFAULT_MACHINE)
        notes.append("No machine id column; all readings get the default machine.")
    if "timestamp" not in columns:
        columns["timestamp"] = timeline_moment(F.col("sample_id"))
        notes.append("No timestamp column; readings are placed five minutes apart.")
    label_available = "failure_label" in named.columns
    if label_available:
        columns["failure_label"] = label_of(named, words=bool(found["label_words"]))
    else:
        columns["failure_label"] = F.lit(0)
        notes.append("No failure label column; all readings count as normal.")
    if found["lost_machines"]:
        notes.append(f"{found['lost_machines']} readings without machine id stay out of every split.")

    readings = canonical_select(numbered.withColumns(columns), features)
    batch = Ingested(
        readings, batch_id or new_id(), source, tuple(features), tuple(missing),
        label_available, renamed, tuple(notes),
    )
    if tables is not None:
        rows = raw_rows(readings, features, batch.batch_id, source, utc_now())
        tables.append("raw_sensor_records", rows, f"raw {batch.batch_id}")
        # From here on the stored rows are read: columnar, typed and numbered.
        stored = tables.table("raw_sensor_records").where(F.col("batch_id") == batch.batch_id)
        batch = replace(batch, readings=canonical_select(stored, features))
    return batch


def ingest_csv(spark: SparkSession, path: str, **options) -> Ingested:
    """Ingest a CSV file; lines are numbered in file order unless they have ids."""
    if options.get("id_column") is None and options.get("order") is None:
        options |= {"id_column": "sample_row", "unique_ids": True}
        lines = load_csv(spark, path, row_number="sample_row")
    else:
        lines = load_csv(spark, path)
    return ingest(lines, options.pop("source", path), stored=True, **options)
