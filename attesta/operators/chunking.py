"""Documents to chunks. All splitting happens inside the row: no shuffle, and rows spread freely."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import credits as cr
from ..functions.text import (
    HEADING_LINES, bind, first_match, md5_hex, or_none, row_text, table_text, words,
)

MAX_WORDS, OVERLAP, MIN_CHARS = 1000, 50, 100


def window_array(text: Column, max_words: int = MAX_WORDS, overlap: int = OVERLAP, min_chars: int = MIN_CHARS) -> Column:
    """array<struct<start_word, end_word, text>> of overlapping word windows of the whole text."""

    def cut(ws: Column) -> Column:
        n = F.size(ws)
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(max_words - overlap))
        windows = F.transform(
            starts,
            lambda s: F.struct(
                s.alias("start_word"),
                F.least(s + max_words, n).alias("end_word"),
                F.array_join(F.slice(ws, s + 1, F.lit(max_words)), " ").alias("text"),
            ),
        )
        return F.filter(windows, lambda x: F.length(x["text"]) >= min_chars)

    empty = F.filter(bind(F.array(F.lit("")), cut), lambda x: F.lit(False))
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) >= min_chars, bind(words(text), cut)).otherwise(empty)


def word_windows(df: DataFrame, keep: list[str], text: str = "text", **sizes) -> DataFrame:
    """(keep..., chunk_index, chunk_start_word, chunk_end_word, text, chunk_hash)"""
    return df.select(*keep, F.posexplode(window_array(F.col(text), **sizes)).alias("chunk_index", "w")).select(
        *keep, "chunk_index", F.col("w.start_word").alias("chunk_start_word"),
        F.col("w.end_word").alias("chunk_end_word"), F.col("w.text").alias("text"),
        md5_hex(F.col("w.text"), 8).alias("chunk_hash"),
    )


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def section_array(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """array<struct<section, section_index, text>>: one entry per heading section of at least min_chars.

    Text before the first heading is 'general' with index 0; headings count from 1.
    """

    def cut(lines: Column) -> Column:
        marks = F.filter(
            F.transform(
                lines,
                lambda l, i: F.struct(i.alias("at"), first_match(_strip(l), HEADING_LINES).alias("section")),
            ),
            lambda m: (m["at"] == 0) | m["section"].isNotNull(),
        )

        def sections(ms: Column) -> Column:
            general = F.get(ms, F.lit(0))["section"].isNull()
            shift = F.when(general, 0).otherwise(1)
            return F.transform(
                ms,
                lambda m, j: F.struct(
                    F.coalesce(m["section"], F.lit("general")).alias("section"),
                    (j + shift).alias("section_index"),
                    _strip(
                        F.array_join(
                            F.transform(
                                F.slice(
                                    lines, m["at"] + 1,
                                    F.coalesce(F.get(ms, j + 1)["at"], F.size(lines)) - m["at"],
                                ),
                                lambda l, n: F.when((n == 0) & m["section"].isNotNull(), _strip(l)).otherwise(l),
                            ),
                            "\n",
                        )
                    ).alias("text"),
                ),
            )

        return F.filter(bind(marks, sections), lambda s: F.length(s["text"]) >= min_chars)

    return bind(F.split(F.coalesce(text, F.lit("")), "\n"), cut)


def heading_chunks(df: DataFrame, keep: list[str], text: str = "text", **sizes) -> DataFrame:
    """Sections by headings; texts without an acceptable section fall back to word windows.

    (keep..., chunk_index, section, section_index, text, chunk_hash); section is null for windows.
    """
    by_heading = section_array(F.col(text), sizes.get("min_chars", MIN_CHARS))
    fallback = F.transform(
        window_array(F.col(text), **sizes),
        lambda w: F.struct(
            F.lit(None).cast("string").alias("section"), F.lit(None).cast("int").alias("section_index"),
            w["text"].alias("text"),
        ),
    )
    chosen = bind(by_heading, lambda s: F.when(F.size(s) > 0, s).otherwise(fallback))
    return df.select(*keep, F.posexplode(chosen).alias("chunk_index", "s")).select(
        *keep, "chunk_index", F.col("s.section").alias("section"), F.col("s.section_index").alias("section_index"),
        F.col("s.text").alias("text"), md5_hex(F.col("s.text"), 8).alias("chunk_hash"),
    )


def page_flags(pages: DataFrame, objects: dict[str, DataFrame]) -> DataFrame:
    """Boolean column per object table: does the page (source_file, page) hold any of them?"""
    for name, table in objects.items():
        present = table.select("source_file", "page").distinct().withColumn(name, F.lit(True))
        pages = pages.join(present, ["source_file", "page"], "left").withColumn(
            name, F.coalesce(F.col(name), F.lit(False))
        )
    return pages


def page_chunks(pages: DataFrame, objects: dict[str, DataFrame] | None = None, use_headings: bool = True) -> DataFrame:
    """Chunks of non-blank pages(source_file, page, text), with page flags when object tables are given."""
    full = pages.filter(F.length(_strip(F.col("text"))) > 0)
    if objects:
        full = page_flags(full, objects)
    keep = [c for c in full.columns if c != "text"]
    cut = heading_chunks if use_headings else word_windows
    return cut(full, keep).withColumn("page_start", F.col("page")).withColumn("page_end", F.col("page"))


def sheet_chunks(rows: DataFrame) -> DataFrame:
    """Chunks of sheet rows(source_file, sheet_name, row_index, cells map)."""
    keep = ["source_file", "sheet_name", "row_index", "column_count"]
    text = rows.withColumn("column_count", F.size("cells")).withColumn("text", row_text(F.col("cells")))
    return word_windows(text.filter(F.length("text") > 0), keep)


def _flat_json(doc: str | None) -> str | None:
    """One document as text, without recursion; None if it is not JSON."""
    try:
        root = json.loads(doc)
    except (TypeError, ValueError, RecursionError):
        return None
    out: list[str] = []
    todo: list = [("", "", root, False)]  # (lead, path, node, whether something stands before it)
    while todo:
        lead, path, node, after = todo.pop()
        if after:
            out.append(" | ")
        out.append(lead)
        if isinstance(node, dict):
            named = [(f"{path}.{k}" if path else k, v) for k, v in node.items()]
            todo += [(f"{p}: ", p, v, i > 0) for i, (p, v) in reversed(list(enumerate(named)))]
        elif isinstance(node, list):
            todo += [("", f"{path}[{i}]", v, i > 0) for i, v in reversed(list(enumerate(node)))]
        else:
            out.append(str(node))
    return "".join(out)


@F.pandas_udf(StringType())
def json_text(docs: pd.Series) -> pd.Series:
    """JSON document -> 'path: value | path: value'; a nested object is led by its own path, list items are not.

    Null for a null or malformed document, which costs only that row.
    """
    return docs.map(_flat_json)


def json_chunks(docs: DataFrame, keep: list[str], column: str = "data") -> DataFrame:
    """Word windows over the flattened JSON of each document; none of malformed documents."""
    return word_windows(docs.withColumn("text", json_text(column)), keep)


def malformed_json(docs: DataFrame, by: list[str], column: str = "data") -> DataFrame:
    """(by..., n_documents, n_malformed)."""
    bad = F.col(column).isNotNull() & json_text(column).isNull()
    return docs.withColumn("_bad", bad).groupBy(*by).agg(F.count(F.lit(1)).alias("n_documents"), F.count_if("_bad").alias("n_malformed"))


def table_chunks(tables: DataFrame) -> DataFrame:
    """tables(file_name, page, table_index, rows, columns, data) -> text chunks with hashed ids."""
    text = table_text(F.col("page"), F.col("rows"), F.col("columns"), F.col("data"))
    return with_hash_id(tables.withColumn("text", text).drop("data"), "table_data")


def with_hash_id(df: DataFrame, chunk_type: str, prefix: str = "doc") -> DataFrame:
    """Adds id = prefix_type_md5[:12], chunk_type and content_length."""
    return df.select(
        F.concat(F.lit(f"{prefix}_{chunk_type}_"), md5_hex(F.col("text"), 12)).alias("id"), "*",
        F.lit(chunk_type).alias("chunk_type"), F.length("text").alias("content_length"),
    )


def _lines(title: str, pairs: list[tuple[str, Column]]) -> Column:
    parts = [F.lit(title + "\n")] if title else []
    for label, value in pairs:
        parts += [F.lit(label + ": "), value.cast("string"), F.lit("\n")]
    return F.concat(*parts)


def summary_chunks(docs: DataFrame) -> DataFrame:
    """docs(file_name, total_*) -> one summary chunk each."""
    labels = [
        ("Total Pages", "total_pages"), ("Total Images", "total_images"), ("Total Tables", "total_tables"),
        ("Total Drawings", "total_drawings"), ("Total Annotations", "total_annotations"),
        ("Total Text Characters", "total_text_chars"),
    ]
    body = _lines("", [(label, F.coalesce(F.col(c), F.lit(0))) for label, c in labels])
    text = F.concat(F.lit("Document Summary for "), F.col("file_name"), F.lit(":\n"), body)
    return with_hash_id(docs.withColumn("text", text), "document_summary")


def metadata_chunks(docs: DataFrame) -> DataFrame:
    """docs(file_name, title, author, subject, page_count, file_size, …) -> one metadata chunk each."""
    labels = [
        ("Title", "title"), ("Author", "author"), ("Subject", "subject"), ("Creator", "creator"),
        ("Producer", "producer"), ("Creation Date", "creation_date"), ("Modification Date", "modification_date"),
    ]
    have = set(docs.columns)

    def shown(c: str, default: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in have else F.lit(default)

    body = _lines("", [(label, shown(c, "N/A")) for label, c in labels])
    tail = F.concat(
        F.lit("Page Count: "), shown("page_count", "0"), F.lit("\nFile Size: "), shown("file_size", "0"), F.lit(" bytes\n")
    )
    text = F.concat(F.lit("Document Metadata for "), F.col("file_name"), F.lit(":\n"), body, tail)
    return with_hash_id(docs.withColumn("text", text), "document_metadata")


def credit_summary_chunks(credits: DataFrame) -> DataFrame:
    """credits(name, code, type, points, description, requirements, …) -> one short chunk each."""
    g = F.col
    body = _lines(
        "",
        [
            ("Credit", F.coalesce(g("name"), F.lit("Unknown"))), ("Code", F.coalesce(g("code"), F.lit("N/A"))),
            ("Type", F.coalesce(g("type"), F.lit("Credit"))), ("Points", F.coalesce(g("points"), F.lit(0))),
            ("Description", F.coalesce(g("description"), F.lit("No description"))),
        ],
    )
    extra = F.coalesce(
        F.concat(F.lit("Requirements: "), or_none(g("requirements")), F.lit("\n")), F.lit("")
    )
    return with_hash_id(credits.withColumn("text", F.concat(body, extra)), "credit_data")


def credit_sections(credits: DataFrame) -> DataFrame:
    """One chunk per filled section of a credit, with stable ids and shared metadata."""
    c = {n: F.col(n) for n in credits.columns}

    def has(name: str) -> Column:
        return F.coalesce(F.size(c[name]) > 0, F.lit(False))

    def count(*names: str) -> Column:
        return sum((has(n).cast("int") for n in names), F.lit(0))

    def entry(section: str, index: Column, text: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), index.cast("int").alias("section_index"), text.alias("body"))

    zero = F.lit(0)
    intent = F.when(F.length(F.trim(c["intent"])) > 0, F.concat(F.lit("Intent: "), c["intent"]))
    calc = F.when(
        has("equations") | has("calc_methods"),
        F.rtrim(
            F.concat(
                F.lit("Calculations:\n"),
                F.when(has("equations"), F.concat(F.array_join(c["equations"], "\n"), F.lit("\n"))).otherwise(F.lit("")),
                F.when(has("calc_methods"), F.array_join(c["calc_methods"], "\n")).otherwise(F.lit("")),
            ),
            F.lit(" \n"),
        ),
    )
    points = F.when(
        c["points_min"].isNotNull() | c["points_max"].isNotNull(),
        F.concat(
            F.lit("Points: "), F.coalesce(c["points_min"].cast("string"), F.lit("None")),
            F.when(
                (c["points_max"] != 0) & ~c["points_max"].eqNullSafe(c["points_min"]),
                F.concat(F.lit(" - "), c["points_max"].cast("string")),
            ).otherwise(F.lit("")),
        ),
    )
    before = [
        entry("intent", zero, intent),
        entry("requirements", zero, cr.bullets("Requirements:", c["requirements"])),
    ]
    options = F.transform(
        F.coalesce(c["options"], F.filter(c["options"], lambda o: F.lit(False))),
        lambda o, i: F.struct(
            F.lit("requirements").alias("section"),
            (i + 1).cast("int").alias("section_index"),
            F.when(
                F.size(o["lines"]) > 0,
                F.concat(
                    F.coalesce(o["heading"], F.concat(F.lit("Option "), (i + 1).cast("string"))), F.lit("\n- "),
                    F.array_join(o["lines"], "\n- "),
                ),
            ).alias("body"),
        ),
    )
    after = [
        entry("documentation", zero, cr.bullets("Documentation:", c["documentation"])),
        entry("calc", zero, calc),
        entry("thresholds", zero, cr.bullets("Applicability:", c["applicability"])),
        entry("thresholds", count("applicability"), points),
        entry("definitions", zero, cr.bullets("Related Credits:", c["related_credits"])),
        entry("definitions", count("related_credits"), cr.bullets("Exemplary Performance:", c["exemplary_performance"])),
        entry(
            "definitions", count("related_credits", "exemplary_performance"),
            cr.bullets("Referenced Standards:", c["referenced_standards"]),
        ),
        entry("calc", (has("equations") | has("calc_methods")).cast("int"), cr.bullets("Step-by-Step:", c["step_by_step"])),
        entry(
            "definitions", count("related_credits", "exemplary_performance", "referenced_standards"),
            cr.bullets("Guidance:", c["guidance"]),
        ),
    ]
    parts = F.filter(
        F.concat(F.array(*before), F.coalesce(options, F.array().cast(
            "array<struct<section:string,section_index:int,body:string>>")), F.array(*after)),
        lambda e: e["body"].isNotNull(),
    )
    version = F.coalesce(or_none(c["version"]), F.lit("v4.1"))
    base = credits.select(
        *[n for n in ("credit_code", "credit_name", "credit_type", "category") if n in c],
        cr.credit_id(c["credit_code"], c["credit_type"], c["credit_name"]).alias("credit_id"),
        cr.doc_type(c["credit_type"], F.lit(None).cast("string")).alias("doc_type"),
        version.alias("version"),
        cr.version_date(version, c["sources"]["effective_date"], c["sources"]["version_date"]).alias("version_effective_date"),
        cr.rating_system(c["credit_name"], c["rating_system"]).alias("rating_system"),
        cr.project_types(F.lit(None).cast("string"), c["applicability"]).alias("project_types"),
        F.array_min(c["sources"]["pages"]).alias("page_start"),
        F.array_max(c["sources"]["pages"]).alias("page_end"),
        cr.header(c).alias("_head"),
        F.posexplode(parts).alias("chunk_index", "_p"),
    )
    return base.select(
        "*", F.col("_p.section").alias("section"), F.col("_p.section_index").alias("section_index"),
        F.concat_ws("-", "credit_id", F.col("_p.section"), F.col("_p.section_index").cast("string")).alias("chunk_id"),
        F.concat(F.col("_head"), F.lit("\n\n"), F.col("_p.body")).alias("text"),
    ).drop("_p", "_head")


def chunk_extractions(records: DataFrame) -> DataFrame:
    """Chunks of extraction records of mixed file types; other types yield none.

    records(source_file, file_type, text_content, sheets, data_text, content).
    """
    cols = ["source_file", "file_type", "page", "chunk_index", "text", "chunk_hash"]
    pdf = records.filter("file_type = 'pdf'").select("source_file", "file_type", F.explode("text_content").alias("p"))
    pages = page_chunks(pdf.select("source_file", "file_type", F.col("p.page").alias("page"), F.col("p.text").alias("text")))
    sheets = records.filter("file_type = 'excel'").select("source_file", F.explode("sheets").alias("s")).select(
        "source_file", F.col("s.name").alias("sheet_name"), F.posexplode("s.rows").alias("row_index", "cells")
    )
    rows = sheet_chunks(sheets).withColumn("file_type", F.lit("excel"))
    flat = records.filter(F.col("file_type").isin("json", "text")).select(
        "source_file", "file_type", F.coalesce("data_text", "content").alias("text")
    )
    plain = word_windows(flat, ["source_file", "file_type"])
    none = F.lit(None).cast("int")
    return (
        pages.select(*cols)
        .unionByName(rows.withColumn("page", none).select(*cols))
        .unionByName(plain.withColumn("page", none).select(*cols))
    )


def chunk_id_collisions(chunks: DataFrame) -> DataFrame:
    """Chunk ids used more than once, with the number of different texts behind them."""
    return (
        chunks.groupBy("chunk_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.md5("text")).alias("n_texts"))
        .filter("n > 1")
    )


def exact_duplicates(chunks: DataFrame, row_id: str, text: str = "text") -> DataFrame:
    """First row id per md5 of the text, with the number of copies."""
    return chunks.groupBy(F.md5(text).alias("text_md5")).agg(
        F.min(row_id).alias("first_id"), F.count(F.lit(1)).alias("copies")
    )


def drop_exact_duplicates(chunks: DataFrame, row_id: str, text: str = "text") -> DataFrame:
    """First row per text. Only hashes and ids are shuffled; texts are joined back by their unique id."""
    firsts = exact_duplicates(chunks, row_id, text).select(F.col("first_id").alias(row_id))
    return chunks.join(firsts, row_id, "left_semi")


