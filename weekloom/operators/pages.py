"""Article text, byline and standfirst out of raw pages (one pass per page)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.functions.html import body_blocks, first_text, links_to, read_html

PARTS = "author string, standfirst string, lines array<string>, excluded_link boolean"


def extract_pages(
    pages: DataFrame,
    selectors: dict,
    *,
    html_col: str = "html",
    outlet_col: str = "outlet",
    promo_lines: list[str] = (),
    excluded_hrefs: list[str] = (),
) -> DataFrame:
    """Replace ``html`` by ``author``, ``standfirst``, ``body`` and ``excluded_link``.

    ``selectors`` maps an outlet to where it keeps these parts. Every body line ends in a
    newline; a page without a body container, or of an unknown outlet, gets an empty body.
    Lines equal to a promotional text are dropped. Pages stay in their partitions.
    """
    hrefs = frozenset(excluded_hrefs)

    def read(html: str | None, outlet: str | None) -> tuple:
        rules, root = selectors.get(outlet), read_html(html)
        return (
            first_text(root, rules["author"]) if rules else "",
            first_text(root, rules["standfirst"]) if rules else "",
            body_blocks(root, rules) if rules else [],
            links_to(root, hrefs),
        )

    # Plain rows come a hundred at a time, so a worker never holds many pages. Marked as not
    # deterministic, or filters on the parts would read the page again.
    parts = F.udf(read, PARTS, useArrow=False).asNondeterministic()
    found = pages.withColumn("_parts", parts(html_col, outlet_col)).drop(html_col)
    lines = F.col("_parts.lines")
    if promo_lines:
        promo = list(promo_lines)
        lines = F.filter(lines, lambda line: ~line.isin(promo))
    body = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.select(
        "*", "_parts.author", "_parts.standfirst", "_parts.excluded_link", body.alias("body")
    ).drop("_parts")


def drop_pages_linking_to(pages: DataFrame, flag_col: str = "excluded_link") -> DataFrame:
    """Keep pages without a link to an excluded section."""
    return pages.where(~F.col(flag_col)).drop(flag_col)
