"""Alert sources: CSV / Parquet scans, timestamp normalisation, appends.

The raw alert table has one row per alert; ``startTime`` / ``endTime``
arrive either as epoch milliseconds (numbers) or as text.  Nothing here
collects data: every function returns a lazy DataFrame whose scan
Catalyst can prune and push filters into.
"""

from __future__ import annotations

import os
import zlib
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertsieve.session import prepare

RAW_COLUMNS = (
    "problemId", "displayId", "title", "severityLevel", "impactLevel",
    "startTime", "endTime", "status", "duration_minutes",
)

# CSV schema: time columns stay text so that both epoch-ms numbers and
# date strings survive the scan; :func:`normalize_timestamps` types them.
ALERT_CSV_SCHEMA = T.StructType([
    T.StructField("problemId", T.StringType()),
    T.StructField("displayId", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("severityLevel", T.StringType()),
    T.StructField("impactLevel", T.StringType()),
    T.StructField("startTime", T.StringType()),
    T.StructField("endTime", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("duration_minutes", T.DoubleType()),
])

# FIXED VALUES: the strings a pandas CSV reader treats as missing by default.
CSV_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

_NUMERIC_TEXT = r"^\s*-?[0-9]+(\.[0-9]*)?\s*$"


def _null_tokens(col: Column) -> Column:
    return F.when(col.isin(list(CSV_NULL_TOKENS)), F.lit(None)).otherwise(col)


def clean_tokens(df: DataFrame) -> DataFrame:
    """Text columns with the null tokens read as null."""
    return df.select(*[(_null_tokens(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.StringType)
                        else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields])


def _csv_options(reader, multi_line: bool):
    return (reader.option("header", True).option("multiLine", multi_line).option("escape", '"')
            .option("nullValue", "\u0000").option("emptyValue", "")
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


#: Bytes of a file's beginning that are looked at for its header row, and readers at once.
HEADER_BYTES = 1 << 16
HEADER_READERS = 32


def csv_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of all files at ``path`` (file, folder or glob), sorted.

    Folders are listed with all their sub-folders, by Spark's own (parallel)
    listing; names that begin with ``_`` or ``.`` are left out.  A path that
    matches nothing, or holds no file, raises ``FileNotFoundError``.
    """
    try:
        found = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
                 .select("path", "length").collect())
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from e
        raise
    if not found:
        raise FileNotFoundError(f"no file below {path}")
    return sorted((r["path"], r["length"]) for r in found)


def _header_text(start: bytes) -> bytes | None:
    """The first record of a CSV file, as it stands (None: longer than ``start``)."""
    quoted = False
    for i in range(len(start)):
        c = start[i:i + 1]
        if c == b'"':
            quoted = not quoted
        elif c in (b"\n", b"\r") and not quoted:
            return start[:i]
    return start if len(start) < HEADER_BYTES else None


def _file_start(spark: SparkSession, name: str) -> bytes:
    """The first bytes of a file on any file system; of a gzip file, unpacked."""
    where = spark._jvm.org.apache.hadoop.fs.Path(name)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        start = bytes(stream.readNBytes(HEADER_BYTES))
    finally:
        stream.close()
    if name.endswith(".gz"):
        return zlib.decompressobj(wbits=31).decompress(start, HEADER_BYTES)
    return start


def _csv_headers(spark: SparkSession, path: str, multi_line: bool) -> dict[tuple, list[str]]:
    """Files at ``path`` by their header row.

    Files are told apart by the bytes of their first record, read by a pool of
    readers (a short read a file, no Spark job); Spark's CSV reader parses
    each different header once.  Empty files have no rows and are left out.
    """
    names = [name for name, size in csv_files(spark, path) if size]
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        starts = pool.map(lambda name: _header_text(_file_start(spark, name)), names)
        alike: dict[object, list[str]] = {}
        for name, text in zip(names, starts):
            # a header too long to be seen whole, or in another compression, stands for itself
            known = text is not None and not name.endswith((".bz2", ".zst", ".lz4", ".snappy", ".deflate"))
            alike.setdefault(text if known else name, []).append(name)
    groups: dict[tuple, list[str]] = {}
    for files in alike.values():
        header = tuple(_csv_options(spark.read, multi_line).csv(files[0]).columns)
        groups.setdefault(header, []).extend(files)
    return {header: sorted(files) for header, files in groups.items()}


def read_alerts_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Scan alert CSV file(s) with pinned types (header row required).

    Columns are taken by header name: files are grouped by their header, so
    a batch with another column order or fewer columns reads right, and any
    text column of the alert schema that no file has comes back null (the two
    times and ``duration_minutes`` stay absent: they decide how durations are
    found).  Extra columns stay, as text.  ``path`` may be a file, a folder
    (read with its sub-folders) or a glob on any file system; where nothing is
    found, ``FileNotFoundError`` is raised.  ``multi_line`` allows line
    breaks inside quoted fields, at the price of one task a file; without it
    large files are split.
    """
    prepare(spark)
    pinned = {f.name: f for f in ALERT_CSV_SCHEMA.fields}
    groups = _csv_headers(spark, path, multi_line)
    parts = []
    for header, files in groups.items():
        schema = T.StructType([pinned.get(c, T.StructField(c, T.StringType())) for c in header])
        reader = _csv_options(spark.read.schema(schema), multi_line)
        # files of one header are read by the path itself, not by a list of names
        scan = reader.option("recursiveFileLookup", True).csv(path) if len(groups) == 1 else reader.csv(files)
        parts.append(clean_tokens(scan))
    df = concat_alerts(*parts) if parts else spark.createDataFrame([], ALERT_CSV_SCHEMA)
    missing = [F.lit(None).cast("string").alias(c) for c in pinned
               if c not in df.columns and c not in ("startTime", "endTime", "duration_minutes")]
    return normalize_timestamps(df.select("*", *missing))


def read_alerts_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Scan an alert table stored as Parquet and type its time columns."""
    prepare(spark)
    return normalize_timestamps(spark.read.parquet(path))


def alerts_from_events(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """Raw alerts (epoch-ms times) projected from the ``events`` test table.

    This is the stand-in input for the test data: it only lays the event
    rows out in the alert schema (FIXTURES.md section 2).  It is a pure
    projection, so it scales with ``events`` and adds no shuffle; with
    ``partitions`` the caller asks for the rows to be spread (a file of one
    row group is one task otherwise).
    """
    prepare(spark)
    ev = (spark.read.parquet(os.path.join(sf_dir, "events.parquet"))
          .select("event_id", "ts", "user_id", "event_type", "value"))
    ev = ev.repartition(partitions) if partitions else ev
    eid = F.col("event_id")
    start_ms = F.unix_millis(F.col("ts").cast("timestamp"))
    title = (
        F.when(eid % 1009 == 0, F.lit(None).cast("string"))
        .when(eid % 12 == 0, F.lit("Network timeout on synthetic availability monitor"))
        .when((eid % 12).isin(1, 2), F.lit("Network availability degraded"))
        .when((eid % 12).isin(3, 4), F.lit("  Synthetic monitor TIMEOUT "))
        .when(eid % 12 == 5, F.lit("Availability drop"))
        .when((eid % 12).isin(6, 7), F.lit("High CPU saturation"))
        .when(eid % 12 == 8, F.lit("Failure rate increase"))
        .when(eid % 12 == 9, F.lit("Response time degradation"))
        .when(eid % 12 == 10, F.lit("Low disk space"))
        .otherwise(F.lit(""))
    )
    severity = (
        F.when(F.col("event_type") == "error", "ERROR")
        .when(F.col("event_type") == "purchase", "AVAILABILITY")
        .when(F.col("event_type") == "signup", "PERFORMANCE")
        .when(F.col("event_type") == "view", "RESOURCE_CONTENTION")
        .when(F.col("event_type") == "click", "CUSTOM_ALERT")
    )
    impact = (
        F.when(F.col("user_id") % 3 == 0, "APPLICATION")
        .when(F.col("user_id") % 3 == 1, "SERVICES")
        .otherwise("INFRASTRUCTURE")
    )
    duration_ms = (
        F.when(eid % 211 == 0, F.lit(90000000).cast("long"))
        .when(eid % 101 == 0, F.lit(-60000).cast("long"))
        .when(eid % 103 == 0, F.lit(0).cast("long"))
        .when(eid % 107 == 0, F.lit(30000).cast("long"))
        .otherwise(F.floor(F.col("value") * F.col("value") * 250).cast("long"))
    )
    return ev.select(
        F.concat(F.lit("P-"), eid.cast("string")).alias("problemId"),
        F.concat(F.lit("D"), (eid % 1000).cast("string")).alias("displayId"),
        title.alias("title"),
        severity.alias("severityLevel"),
        impact.alias("impactLevel"),
        F.when(eid % 997 == 0, F.lit(None).cast("long")).otherwise(start_ms).alias("startTime"),
        F.when(eid % 97 == 0, F.lit(None).cast("long"))
        .otherwise(start_ms + duration_ms).alias("endTime"),
        F.when(eid % 97 == 0, "OPEN").otherwise("CLOSED").alias("status"),
    )


# Timestamps outside years 1 to 9999 are no times of alerts.
_MS_RANGE = (-62_135_596_800_000, 253_402_300_799_999)


def _from_millis(ms: Column) -> Column:
    """Epoch milliseconds (double) as a timestamp; NaN and out-of-range give null."""
    ok = ms.between(*map(float, _MS_RANGE))  # NaN is above every number
    return F.when(ok, F.timestamp_micros(F.round(F.when(ok, ms) * 1000).cast("long")))


def _to_timestamp(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        ms = col.cast("long")
        return F.timestamp_millis(F.when(ms.between(*_MS_RANGE), ms))
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return _from_millis(col.cast("double"))
    if isinstance(dtype, T.TimestampNTZType):
        return col.cast("timestamp")
    if isinstance(dtype, T.TimestampType):
        return col
    if isinstance(dtype, T.DateType):
        return col.cast("timestamp")
    text = F.trim(col.cast("string"))
    number = F.when(text.rlike(_NUMERIC_TEXT), text.try_cast("double"))
    return F.coalesce(_from_millis(number), F.try_to_timestamp(text))


def normalize_timestamps(df: DataFrame) -> DataFrame:
    """Type ``startTime`` / ``endTime`` as UTC timestamps.

    Numbers are epoch milliseconds; text is parsed, and a value that does
    not parse becomes null (never an error).
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for name in df.columns:
        if name in ("startTime", "endTime"):
            cols.append(_to_timestamp(F.col(name), types[name]).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def concat_alerts(*dfs: DataFrame) -> DataFrame:
    """Append alert batches by column name; a missing column becomes null."""
    if not dfs:
        raise ValueError("concat_alerts needs at least one DataFrame")
    out = dfs[0]
    for other in dfs[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
