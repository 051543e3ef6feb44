"""File sources: every field a string, rows numbered in source order."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HERE = Path(__file__).resolve().parents[2]


def resolve(path: str) -> str:
    """A path as given, or below the repository; paths with a scheme go to Spark as they are."""
    if "://" in path:
        return path
    for p in (Path(path), HERE / path):
        if p.exists():
            return str(p)
    raise FileNotFoundError(f"Could not find '{path}': neither {Path(path)} nor {HERE / path} is there.")


def read_file(spark: SparkSession, path: str, na_values: tuple[str, ...] = ("",)) -> DataFrame:
    """A CSV file or folder with a header, or an Excel file, as strings and batch_seq, which follows files by path and their rows.

    na_values become null, and so do fields that a record lacks; a record with more fields than the header is an error.
    """
    found = resolve(path)
    suffix = Path(found).suffix.lower()
    if suffix in (".xlsx", ".xls"):
        return number_rows(read_excel(spark, found))
    if suffix != ".csv" and not Path(found).is_dir():
        raise ValueError(f"Unsupported file type: {suffix}")
    options = dict(header=True, escape='"', nullValue="", multiLine=breaks_in_quotes(spark, found))
    names = spark.read.options(header=True, escape='"').csv(found).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, BROKEN]])
    frame = spark.read.schema(schema).options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN).csv(found)
    fields = [F.when(~F.col(f"`{c}`").isin(list(na_values)), F.col(f"`{c}`")).alias(c) for c in names]
    surplus = _cells(F.col(BROKEN)) > len(names)
    refused = F.raise_error(F.concat(F.lit(f"a record has more than {len(names)} fields: "), F.substring(BROKEN, 1, 200)))
    placed = frame.select(*fields, F.monotonically_increasing_id().alias("__place"), F.when(surplus, refused).cast("int").alias("__refused"), F.col("_metadata.file_path").alias("__file"))
    numbered = _in_order_of_files(spark, placed, sorted(frame.inputFiles()), max(1, frame.rdd.getNumPartitions()))
    # A record that is refused fails the scan here.
    return numbered.select(*(f"`{c}`" for c in names), F.coalesce(F.col("__refused").cast("long"), F.col("batch_seq")).alias("batch_seq"))


#: Holds a record whose number of fields isn't the header's.
BROKEN = "__broken_record"


def _cells(record: Column) -> Column:
    """Fields of a CSV record as written: separators outside quotes and one."""
    bare = F.regexp_replace(record, '"(?:[^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","))) + 1


def _in_order_of_files(spark: SparkSession, placed: DataFrame, files: list[str], partitions: int) -> DataFrame:
    """placed(__place, __file) with batch_seq, which follows the files by path and the rows in each; it need not be dense.

    Scans deal out files by size, so a row's place in the scan orders the rows of one file only: the files' ranks go
    before it. The driver lists the files in any case, so the table of their ranks is no larger than what it holds.
    """
    if len(files) <= 1:
        return placed.withColumn("batch_seq", F.col("__place") + 1)
    place_bits = 33 + partitions.bit_length()
    if place_bits + len(files).bit_length() > 63:
        raise ValueError(f"{len(files)} files are too many to number in one batch")
    local = lambda path: path.replace("file:///", "file:/")
    ranks = F.broadcast(spark.createDataFrame([(local(f), i) for i, f in enumerate(files)], "__path string, __rank long"))
    joined = placed.withColumn("__path", F.regexp_replace("__file", "^file:///", "file:/")).join(ranks, "__path", "left")
    rank = F.coalesce("__rank", F.raise_error(F.concat(F.lit("a file came that wasn't listed: "), "__file")).cast("long"))
    return joined.withColumn("batch_seq", rank * (1 << place_bits) + F.col("__place") + 1)


def breaks_in_quotes(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field may hold a line break: the line that it begins on has an odd number of quotes.

    A multi-line scan isn't split among tasks inside a file, so only files that need it are read that way.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def number_rows(raw: DataFrame) -> DataFrame:
    """batch_seq follows the order of rows as the scan deals them out. It need not be dense."""
    return raw.withColumn("batch_seq", F.monotonically_increasing_id() + 1)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet; needs openpyxl, which pandas reads Excel files with. Sheets are small by their format's own limit."""
    try:
        import openpyxl  # noqa: F401
    except ModuleNotFoundError as e:
        raise ModuleNotFoundError("reading Excel files needs openpyxl") from e
    import pandas as pd

    sheet = pd.read_excel(path, dtype=str)
    schema = ", ".join(f"`{c}` string" for c in sheet.columns)
    return spark.createDataFrame(sheet.astype(object).where(sheet.notna(), None).values.tolist(), schema)
