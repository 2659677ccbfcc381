"""Wiki pages as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import last_line_value, page_file_name, wiki_links

LOG_PAGE = "log.md"


def parse_pages(files: DataFrame, text: str = "content") -> DataFrame:
    """(name, content, summary, last_updated, related_pages) of markdown files."""
    return files.select(
        F.regexp_replace("file_path", r"\.md\z", "").alias("name"),
        F.col(text).alias("content"),
        last_line_value(F.col(text), r"\*\*Summary\*\*").alias("summary"),
        last_line_value(F.col(text), r"\*\*Last updated\*\*").alias("last_updated"),
        wiki_links(F.col(text)).alias("related_pages"),
    )


def list_pages(files: DataFrame, text: str = "content") -> DataFrame:
    """(name, summary, last_updated) of every page but the log."""
    pages = files.where(F.col("file_path").endswith(".md") & (F.col("file_path") != LOG_PAGE))
    return parse_pages(pages, text).select("name", "summary", "last_updated")


def read_page(files: DataFrame, page_name: str, text: str = "content") -> DataFrame:
    """The page of that name, with its parsed fields; no row when there is none."""
    return parse_pages(files.where(F.col("file_path") == page_file_name(F.lit(page_name))), text)
