"""Sources: chunk and record files, plain text, tables; all lazy and splittable where the format allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import running
from ..session import written
from .schemas import BUILDING, CHUNK_LINE, CREDIT, EXTRACTION


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str = CHUNK_LINE) -> DataFrame:
    """JSON lines; invalid lines are kept in `_bad` so that they can be counted. Blank lines are skipped."""
    return (
        spark.read.schema(f"{schema}, _bad STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    )


def parse_json_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """The same for lines already held in a column: adds `parsed` and `_bad`."""
    parsed = F.from_json(column, f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    full = lines.filter(F.length(F.trim(column)) > 0).withColumn("parsed", parsed)
    return full.withColumn("_bad", F.col("parsed._bad"))


def good_lines(df: DataFrame) -> DataFrame:
    return df.filter(F.col("_bad").isNull()).drop("_bad")


def read_credits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON array of credit records."""
    return spark.read.schema(CREDIT).option("multiLine", True).json(path)


def read_buildings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUILDING).option("multiLine", True).json(path)


def read_extractions(spark: SparkSession, root: str) -> DataFrame:
    """Extraction records of a whole tree, one JSON file each, with the file they came from."""
    return (
        spark.read.schema(EXTRACTION).option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json").json(root).withColumn("extraction_file", F.col("_metadata.file_path"))
    )


# ---- fixed values: file name patterns that are discovered ---------------------------------------
DATA_FILES = "*.{pdf,xlsx,xlsm,xls,json,txt,md,csv,png,jpg,jpeg,gif,zip,doc,docx}"
# -------------------------------------------------------------------------------------------------


def discover_files(spark: SparkSession, root: str, pattern: str = DATA_FILES, recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) of data files; contents are not read, extraction outputs are left out."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(root)
    )
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select("path", "length", "modificationTime").filter(~F.contains(name, F.lit("_extracted")))


def read_text_files(spark: SparkSession, root: str, pattern: str = "*.{txt,md,csv}") -> DataFrame:
    """(path, content): UTF-8 where valid, else Latin-1, which never fails."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return raw.select("path", decoded(F.col("content")).alias("content"))


def decoded(content: Column) -> Column:
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def split_page_marks(df: DataFrame, keep: list[str], content: str = "content", mark: str = "=== PAGE") -> DataFrame:
    """(keep..., page, text) of texts with page marks; what stands before the first mark is dropped."""
    pieces = F.split(content, mark)
    trimmed = F.regexp_replace("piece", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return (
        df.select(*keep, F.posexplode(pieces).alias("page", "piece"))
        .filter("page > 0")
        .select(*keep, "page", trimmed.alias("text"))
        .filter("text <> ''")
    )


def read_page_text(spark: SparkSession, path: str, mark: str = "=== PAGE") -> DataFrame:
    """(source_file, page, text) of text files with page marks; what stands before the first mark is dropped.

    Files are read line by line, large ones in splits: marks are counted inside each split, and only one sum
    per split is carried on (`skew.running`). A page is the largest thing that comes together.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.split("value", mark).alias("pieces"),
    )
    # ids of lines ascend inside a split; they are written, so that all steps see the same ones
    counted = running(
        written(lines), ["source_file"], [F.col("block")], ["at"], sums={"before": F.size("pieces") - 1}, inclusive=False
    )
    pieces = counted.select("source_file", "block", "at", "before", F.posexplode("pieces").alias("i", "piece"))
    body = F.array_sort(F.collect_list(F.struct("block", "at", "piece")))
    joined = F.array_join(F.transform(body, lambda r: r["piece"]), "\n")
    return (
        pieces.groupBy("source_file", (F.col("before") + F.col("i")).alias("page"))
        .agg(joined.alias("text")).filter("page > 0")
        .select("source_file", F.col("page").cast("int").alias("page"), F.regexp_replace("text", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "").alias("text"))
        .filter("text <> ''")
    )


def meter_months(rows: DataFrame, keep: list[str], values: str) -> DataFrame:
    """rows(keep..., values array<string>): first field is the meter name, then one value per month.

    Rows with fewer than 13 fields are dropped, blank months are left out.
    """
    months = F.filter(
        F.transform(F.slice(values, 2, 12), lambda v: F.trim(v)), lambda v: v != ""
    )
    return (
        rows.filter(F.size(values) >= 13)
        .select(*keep, F.get(values, F.lit(0)).alias("meter"), F.posexplode(months).alias("pos", "v"))
        .select(*keep, "meter", (F.col("pos") + 1).alias("month"), F.col("v").cast("double").alias("value"))
    )


def read_meters(spark: SparkSession, path: str) -> DataFrame:
    """Meter CSV files: header line skipped, one meter per line."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("line"))
    first = F.startswith(F.lower("line"), F.lit("meter"))
    return meter_months(lines.filter(~first).withColumn("parts", F.split("line", ",")), ["source_file"], "parts")


def site_energy(lines: DataFrame, keep: list[str]) -> DataFrame:
    """lines(keep..., line_no, line) of summary tables -> total_site_energy and total_source_energy per keep."""
    value = F.try_element_at(F.split("line", ","), F.lit(2)).try_cast("double")

    def last(label: str) -> Column:
        return F.max_by(value, F.when(F.contains("line", F.lit(label)) & value.isNotNull(), F.col("line_no")))

    return lines.groupBy(*keep).agg(
        last("Total Site Energy").alias("total_site_energy"), last("Total Source Energy").alias("total_source_energy")
    )


def read_sheets(spark: SparkSession, root: str) -> DataFrame:
    """CSV folder, one file per sheet: (source_file, sheet_name, row_index, cells), all rows of each sheet.

    Every file has its own header line; a file is read in pieces, lines keep their order by place.
    Fields of a line beyond the header get no cell; missing ones are empty.
    """
    path = F.col("_metadata.file_path")
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(root)
        .select(path.alias("source_file"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("_at"))
    )
    return sheet_cells(lines)


def sheet_cells(lines: DataFrame) -> DataFrame:
    """lines(source_file, line, _at): the first line of each file names the cells of all others."""
    full = lines.filter(F.length(F.trim("line")) > 0)
    heads = full.groupBy("source_file").agg(F.min_by("line", "_at").alias("head"), F.min("_at").alias("first"))
    rows = full.join(heads, "source_file").filter("_at > first")

    def split(line: Column) -> Column:
        parts = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(FIELD), F.lit(0))
        bare = lambda p: F.regexp_replace(F.substring(p, F.lit(2), F.length(p)), r'^\s*"|"\s*$', "")
        return F.transform(parts, lambda p: F.replace(bare(p), F.lit('""'), F.lit('"')))

    cells = rows.withColumn("_head", split(F.col("head"))).withColumn("_line", split(F.col("line")))
    named = F.map_from_entries(
        F.filter(
            F.zip_with("_head", "_line", lambda h, v: F.struct(h.alias("k"), F.coalesce(v, F.lit("")).alias("v"))), lambda e: e["k"].isNotNull()
        )
    )
    out = cells.select("source_file", F.regexp_extract("source_file", r"([^/]+)\.csv$", 1).alias("sheet_name"), named.alias("cells"), "_at")
    return numbered_rows(out)


FIELD = r',(?:\s*"(?:[^"]|"")*"\s*|[^,]*)'


def numbered_rows(rows: DataFrame, block: int = 1 << 12) -> DataFrame:
    """Adds `row_index` from 0 in the order of `_at` within each sheet; long sheets go block by block."""
    out = running(
        rows, ["source_file", "sheet_name"], [F.floor(F.col("_at") / block), F.floor(F.col("_at") / (block << 10))], ["_at"], {"_n": F.lit(1)},
    )
    return out.withColumn("row_index", (F.col("_n") - 1).cast("int")).drop("_at", "_n")
