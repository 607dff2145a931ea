"""HTML table extraction (A13) and table -> lookup.

Parsing HTML is the one step Spark has no built-in for: ``mapInPandas`` runs
the standard-library ``html.parser`` over Arrow batches of pages, one page at
a time, so memory is bounded by the largest page.
"""

from __future__ import annotations

from html.parser import HTMLParser
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS_SCHEMA = "page_id long, row_ix int, cells array<string>"


class _Rows(HTMLParser):
    """Collects the text of ``cell_tag`` elements inside each ``row_tag``."""

    def __init__(self, row_tag: str, cell_tag: str):
        super().__init__(convert_charrefs=True)
        self.row_tag, self.cell_tag = row_tag, cell_tag
        self.rows: list[list[str]] = []
        self._row: list[str] | None = None
        self._cell: list[str] | None = None
        self._depth = 0

    def handle_starttag(self, tag, attrs):
        if tag == self.row_tag:
            if self._row is None:
                self._row = []
            self._depth += 1
        elif tag == self.cell_tag and self._row is not None:
            self._cell = []

    def handle_endtag(self, tag):
        if tag == self.cell_tag and self._cell is not None:
            self._row.append("".join(self._cell))
            self._cell = None
        elif tag == self.row_tag and self._row is not None:
            self._depth -= 1
            if self._depth == 0:
                self.rows.append(self._row)
                self._row = None

    def handle_data(self, data):
        if self._cell is not None:
            self._cell.append(data)


def _extract(row_tag: str, cell_tag: str, skip_header: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = {"page_id": [], "row_ix": [], "cells": []}
            for pid, html in zip(b["page_id"], b["html"]):
                p = _Rows(row_tag, cell_tag)
                try:
                    p.feed(html or "")
                    p.close()
                except Exception:  # malformed page: keep what was parsed
                    pass
                rows = p.rows[1:] if skip_header else p.rows
                for i, cells in enumerate(rows):
                    out["page_id"].append(int(pid))
                    out["row_ix"].append(i)
                    out["cells"].append(cells)
            yield pd.DataFrame(out)
    return run


def extract_html_tables(pages: DataFrame, row_tag: str = "tr", cell_tag: str = "td",
                        skip_header: bool = True) -> DataFrame:
    """(page_id, row_ix, cells) for every row of every page."""
    return pages.select("page_id", "html").mapInPandas(_extract(row_tag, cell_tag, skip_header), CELLS_SCHEMA)


def table_to_lookup(cells: DataFrame, key_ix: int = 0, value_ix: int = 1,
                    keep_keys: DataFrame | None = None) -> DataFrame:
    """Key -> value from two cells; strip, drop " (closed)"; the last
    row of a duplicate key wins; optional key filter (semi join)."""
    from ..functions.text import unicode_strip
    kv = cells.select(unicode_strip(F.element_at("cells", key_ix + 1)).alias("key"),
                      unicode_strip(F.replace(F.element_at("cells", value_ix + 1), F.lit(" (closed)"),
                                              F.lit(""))).alias("value"),
                      "page_id", "row_ix").filter(F.col("key").isNotNull())
    if keep_keys is not None:
        kv = kv.join(keep_keys.select(F.col(keep_keys.columns[0]).alias("key")), "key", "left_semi")
    return kv.groupBy("key").agg(F.max_by("value", F.struct("page_id", "row_ix")).alias("value"))
