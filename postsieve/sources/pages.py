"""Raw pages as postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators.once import computed_once


def scan_postings(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> (page_id, link, title, article): one posting per page.

    `link` is the address as found, `title` the heading as text, `article` the HTML of the
    posting body. A page without heading or article has an empty string there.
    """
    return pages.select(
        "page_id",
        F.col("url").alias("link"),
        text.html_to_text(text.heading_html(F.col("html"))).alias("title"),
        text.article_html(F.col("html")).alias("article"),
    )


def posting_headings(pages: DataFrame) -> DataFrame:
    """Postings with cleaned link and title; the body is not looked at. Columns beyond the three raw ones are kept."""
    return pages.select("page_id", *_heading(), *_extra(pages))


def posting_texts(pages: DataFrame) -> DataFrame:
    """Postings with cleaned link and title and the text of the body as `jd`.

    Columns of `pages` beyond the three raw ones are kept. The text is computed once per page
    whatever filters follow; the title, a few words, is left for the optimizer to prune or move.
    """
    link, title = _heading()
    jd = text.html_to_text(text.article_html(F.col("html")))
    return computed_once(pages, {"jd": jd}).select("page_id", link, title, "jd", *_extra(pages))


def _extra(pages: DataFrame) -> list[str]:
    return [column for column in pages.columns if column not in ("page_id", "url", "html")]


def _heading() -> list[Column]:
    return [
        text.normalize_link(F.col("url")).alias("link"),
        text.strip_commas(text.html_to_text(text.heading_html(F.col("html")))).alias("title"),
    ]
