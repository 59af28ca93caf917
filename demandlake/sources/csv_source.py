"""Demand CSV source: columns bound by each file's own header, typed without inference, bad rows told apart.

Files are read as lines; a file's first line is its header, and every other line is cut by CSV rules
(no line breaks inside quotes) and bound by name, so files with other column orders, extra columns
(``casual``, ``registered``) or missing ones mix freely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import running_agg
from ..schema import REQUIRED_COLUMNS

NUMERIC = {"season": "int", "holiday": "int", "workingday": "int", "weather": "int", "temp": "double",
           "atemp": "double", "humidity": "double", "windspeed": "double", "count": "int"}
_COMMAS = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'  # outside quotes
SYNTH_START = "2011-01-01 00:00:00"  # fixed value: first stamp of a file without time columns


def parse_datetime(c: Column) -> Column:
    """ISO date or datetime ('T' or space, optional fraction) -> TIMESTAMP_NTZ in any session zone; else null."""
    return F.trim(c).try_cast("timestamp_ntz")


def parse_demand_strings(df: DataFrame) -> DataFrame:
    """String columns -> typed demand columns (target renamed to cnt) + array of fields that failed to parse.

    Where a row has no ``datetime`` but a ``date`` column, the time comes from ``date``.
    """
    raw_time = F.coalesce(*[F.col(c) for c in ("datetime", "date") if c in df.columns])
    typed = {"datetime": parse_datetime(raw_time)}
    for c, t in NUMERIC.items():
        if c in df.columns:
            typed["cnt" if c == "count" else c] = F.col(c).try_cast(t)
    fails = [F.when(raw_time.isNotNull() & typed["datetime"].isNull(), F.lit("datetime"))]
    fails += [F.when(F.col(c).isNotNull() & typed[c if c != "count" else "cnt"].isNull(), F.lit(c)) for c in NUMERIC if c in df.columns]
    return df.select(*[v.alias(k) for k, v in typed.items()],
                     *[c for c in df.columns if c not in NUMERIC and c not in ("datetime", "date")],
                     F.array_compact(F.array(*fails)).alias("parse_errors"))


def tag_lines(lines: DataFrame) -> DataFrame:
    """(value, source_file, _start, _pos): lines with their file, split and place in the split."""
    return lines.select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_start")).withColumn(
        "_pos", F.monotonically_increasing_id())


def headers_of(tagged: DataFrame) -> DataFrame:
    """(source_file, header): the first line of each file."""
    return tagged.filter(F.col("_start") == 0).groupBy("source_file").agg(F.min_by("value", "_pos").alias("header"))


def split_fields(line: Column) -> Column:
    """Fields of a CSV line, trimmed, without their quotes; an empty field is null."""
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r'^"|"$', ""), '""', '"')
    return F.transform(F.split(line, _COMMAS, -1), lambda x: F.nullif(bare(x), F.lit("")))


def bind_by_name(tagged: DataFrame, columns: list[str]) -> DataFrame:
    """One string column per name (null where the file has no such column), plus source_file, its missing
    required columns and the line's place. Lines equal to their file's header are headers."""
    h = headers_of(tagged).select(F.col("source_file").alias("_file"), "header", split_fields(F.col("header")).alias("_names"))
    rows = tagged.join(h, F.col("source_file") == F.col("_file")).filter((F.col("value") != F.col("header")) & (F.trim("value") != ""))
    fields = rows.withColumn("_fields", split_fields(F.col("value")))
    at = lambda c: F.get("_fields", (F.array_position("_names", F.lit(c)) - 1).cast("int"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(c) for c in REQUIRED_COLUMNS]), F.col("_names")))
    return fields.select(*[at(c).alias(c) for c in columns], "source_file", missing.alias("missing"), "_names", "_start", "_pos")


def read_demand_csv(spark: SparkSession, path: str, sort: bool = True) -> DataFrame:
    """Scan demand CSV(s), type them, and order by datetime.

    A file with neither ``datetime`` nor ``date`` gets hourly stamps by row position from ``SYNTH_START``.
    """
    tagged = tag_lines(spark.read.text(path))
    named = bind_by_name(tagged, ["datetime", "date", *NUMERIC])
    timed = F.array_contains("_names", "datetime") | F.array_contains("_names", "date")
    typed = parse_demand_strings(named.withColumn("_timed", timed)).drop("missing", "_names")
    if headers_of(tagged).filter(~F.exists(split_fields(F.col("header")), lambda n: n.isin("datetime", "date"))).limit(1).count():
        numbered = running_agg(typed.filter(~F.col("_timed")), ["source_file"], ["_start", "_pos"], [("_n", "sum", F.lit(1), False)])
        stamp = F.timestamp_add("HOUR", F.coalesce("_n", F.lit(0)), F.lit(SYNTH_START).cast("timestamp_ntz"))
        typed = typed.filter("_timed").unionByName(numbered.withColumn("datetime", stamp).drop("_n"))
    typed = typed.drop("_timed", "_start", "_pos")
    return typed.orderBy("datetime") if sort else typed


def header_lines(spark: SparkSession, path: str) -> DataFrame:
    """First line of every file under ``path`` (one row per file)."""
    return headers_of(tag_lines(spark.read.text(path))).withColumnRenamed("source_file", "file_path")


def missing_columns(spark: SparkSession, path: str, required: list[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Per file: sorted required column names absent from its header; files with any are rejected."""
    req = F.array(*[F.lit(c) for c in required])
    missing = F.array_sort(F.array_except(req, split_fields(F.col("header"))))
    return header_lines(spark, path).select("file_path", missing.alias("missing"), (F.size(missing) == 0).alias("accepted"))


MAX_UPLOAD_BYTES = 10 * 1024 * 1024  # fixed value: upload limit of the web form


def landing_gate(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Per landed file: accepted, or the reason why not.

    A file needs the extension .csv (any case), at most ``max_bytes`` if a limit is given
    (``MAX_UPLOAD_BYTES`` is the web form's), a header, and no line with more fields than it.
    Sizes come from file metadata alone. A file of no bytes has landed nothing and gives no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    by_name = ~F.lower("path").endswith(".csv")
    too_large = F.col("length") > max_bytes if max_bytes is not None else F.lit(False)
    tagged = tag_lines(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[cC][sS][vV]").text(path))
    h = headers_of(tagged).select(F.col("source_file").alias("_file"), F.size(F.split("header", _COMMAS, -1)).alias("_width"), (F.trim("header") == "").alias("_blank"))
    wide = tagged.join(h, F.col("source_file") == F.col("_file")).groupBy("_file").agg(
        F.max((F.size(F.split("value", _COMMAS, -1)) > F.col("_width")).cast("int")).alias("_wide"), F.max(F.col("_blank").cast("int")).alias("_no_header"))
    name = lambda c: F.url_decode(F.regexp_replace(F.regexp_replace(c, r"^file:/+", "/"), r"\+", "%2B"))  # noqa: E731  the two readers spell a path differently
    checked = files.join(wide.withColumn("_key", name(F.col("_file"))), name(F.col("path")) == F.col("_key"), "left")
    reason = (F.when(by_name, "not a .csv file").when(too_large, f"file larger than {max_bytes} bytes")
              .when((F.col("length") == 0) | F.col("_wide").isNull() | (F.col("_no_header") == 1), "no header")
              .when(F.col("_wide") == 1, "a line has more fields than the header"))
    return checked.select("path", "length", reason.alias("reason"), reason.isNull().alias("accepted"))


def dataset_inventory(spark: SparkSession, path: str) -> DataFrame:
    """CSV datasets in a folder: id (file stem), filename, size; sorted by filename."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(F.regexp_extract(name, r"^(.*)\.[^.]+$", 1).alias("id"), name.alias("filename"),
                        F.col("length").alias("size")).orderBy("filename")
