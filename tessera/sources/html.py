"""Attribute tables in HTML pages: the first table headed Attribute and Description."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.tables, self._into, self._titled = "", [], None, False

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self._into, self._titled = None if self._titled else "title", True
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.tables[-1][-1].append("")
            self._into = "cell"

    def handle_endtag(self, tag):
        if tag in ("title", "td", "th"):
            self._into = None

    def handle_data(self, data):
        if self._into == "title":
            self.title += data
        elif self._into == "cell":
            self.tables[-1][-1][-1] += data


def attribute_table(html: str | None, references: tuple[str, ...] | None = None, white: str | None = None) -> tuple[str, list[tuple[str, str]]]:
    """(title, rows) of the first table whose header is Attribute, Description; no rows if there is none.

    The title is the first title element's. `references` names the character references that
    count, written with their semicolons, others stay as they are written (None: all of HTML's);
    `white` holds the characters that are white space in a title (None: all of Unicode's).
    """
    page = _Tables()
    html = html or ""
    if references is not None:
        html = re.sub(f"&(?!(?:{'|'.join(map(re.escape, references))});)", "&amp;", html)
    page.feed(html)
    title = " ".join(page.title.split()) if white is None else re.sub(f"[{re.escape(white)}]+", " ", page.title).strip(" ")
    for table in page.tables:
        rows = [[" ".join(c.split()) for c in row] for row in table if row]
        if rows and [c.lower() for c in rows[0][:2]] == ["attribute", "description"]:
            return title, [(r[0], r[1]) for r in rows[1:] if len(r) > 1 and r[0]]
    return title, []


def attribute_tables(pages: DataFrame, id_col: str, html_col: str, references: tuple[str, ...] | None = None, white: str | None = None) -> DataFrame:
    """(id, title, position, attribute, description); a page without such a table has one row without attribute, a null page no title either."""

    @F.pandas_udf("struct<title:string,rows:array<struct<attribute:string,description:string>>>")
    def parse(html: pd.Series) -> pd.DataFrame:
        found = [attribute_table(h, references, white) for h in html]
        titles = [None if h is None else t for h, (t, _) in zip(html, found)]
        return pd.DataFrame({"title": titles, "rows": [[{"attribute": a, "description": d} for a, d in rows] for _, rows in found]})

    parsed = pages.select(id_col, parse(F.col(html_col)).alias("_p"))
    return parsed.select(id_col, F.col("_p.title").alias("title"), F.posexplode_outer("_p.rows").alias("position", "_r")).select(id_col, "title", "position", "_r.*")
