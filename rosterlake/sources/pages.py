"""Landed web pages: HTML tables and script data as rows.

Pages are text columns: land them with spark.read.text(path, wholetext=True) or the binaryFile reader.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..schema import RANKINGS
from .quarantine import Checked, checked


class TableParser(HTMLParser):
    """Cells of the first table with an id, row by row; a colspan repeats its cell, nested tables are skipped."""

    def __init__(self, table_id: str):
        super().__init__(convert_charrefs=True)
        self.table_id, self.depth, self.done = table_id, 0, False
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None
        self.span, self.in_head, self.head_rows = 1, False, 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            if self.depth or (not self.done and dict(attrs).get("id") == self.table_id):
                self.depth += 1
        elif self.depth == 1 and tag == "thead":
            self.in_head = True
        elif self.depth == 1 and tag == "tr":
            self.close()
            self.rows.append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self.close()
            if not self.rows:
                self.rows.append([])
            wide = dict(attrs).get("colspan") or "1"
            self.cell, self.span = [], int(wide) if wide.isdigit() else 1
            if tag == "th" and self.in_head:
                self.head_rows = len(self.rows)
        elif self.depth == 1 and tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag):
        if not self.depth:
            return
        if tag == "table":
            self.close()
            self.depth -= 1
            self.done = self.done or not self.depth
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self.close()
        elif self.depth == 1 and tag == "thead":
            self.in_head = False

    def handle_data(self, data):
        if self.depth == 1 and self.cell is not None:
            self.cell.append(data)

    def close(self):
        if self.cell is not None and self.rows:
            self.rows[-1] += [" ".join("".join(self.cell).split())] * self.span
        self.cell = None


#: Pages parsed before their rows are passed on.
PAGES_AT_ONCE = 64


def parsed(batches: Iterator[pa.RecordBatch], html: str, keys: list[str], table_id: str, skip: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of pages -> batches of their body rows: keys, row_idx, cells; empty cells are null."""
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES_AT_ONCE):
            part = batch.slice(at, PAGES_AT_ONCE)
            page, place, cells = [], [], []
            for i, content in enumerate(part.column(html).to_pylist()):
                parser = TableParser(table_id)
                parser.feed(content or "")
                body = [r for r in parser.rows[parser.head_rows :] if r]
                page += [i] * len(body)
                place += range(len(body))
                cells += [[c or None for c in row[skip:]] for row in body]
            columns = [part.column(k).take(pa.array(page, pa.int64())) for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(place, pa.int32()), pa.array(cells, pa.list_(pa.string()))], names=[*keys, "row_idx", "cells"])


def table_rows(pages: DataFrame, table_id: str = "data", skip_columns: int = 1, html: str = "html") -> DataFrame:
    """The pages' other columns with row_idx and cells of every body row of their table; a page is parsed in its task."""
    keys = [c for c in pages.columns if c != html]
    fields = [pages.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("row_idx", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType()))])
    return pages.select(*keys, F.col(html).cast("string").alias(html)).mapInArrow(lambda batches: parsed(batches, html, keys, table_id, skip_columns), schema)


def named(rows: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """cells renamed by place."""
    return rows.select(*keep, *[F.try_element_at("cells", F.lit(i + 1)).alias(c) for i, c in enumerate(columns)])


SCRIPT = r"(?is)<script[^>]*type=[\"']?text/javascript[\"']?[^>]*>.*?var ecrData = (.*?\});"
#: JSON key -> (column, type).
FIELDS = {
    "player_name": ("player", "string"), "player_position_id": ("position", "string"), "rank_ecr": ("rank", "int"), "rank_min": ("min_rank", "int"), "rank_max": ("max_rank", "int"),
    "rank_ave": ("avg_rank", "double"), "rank_std": ("std_rank", "double"), "start_sit_grade": ("grade", "string"), "r2p_pts": ("proj_fpts", "double"),
}


def script_players(html: Column) -> Column:
    """The players array of the page's script data, as variants: an absent key differs from null, a number from text."""
    return F.try_variant_get(F.try_parse_json(F.regexp_extract(html, SCRIPT, 1)), "$.players", "array<variant>")


def field(player: Column, key: str, kind: str) -> tuple[Column, Column]:
    """(value, why the row can't be taken, else null) of a player's key.

    Text is taken as it is, numbers as they are written, null as 'None'. A whole number may be text or number: 1.5 counts
    as 1, "1.5" and null can't be taken. Points may be absent, which is 0."""
    there = F.try_variant_get(player, f"$.{key}", "variant")
    null = F.is_variant_null(there)
    if kind == "string":
        value = F.when(null, "None").otherwise(F.try_variant_get(player, f"$.{key}", "string"))
        return value, F.when(there.isNull(), F.lit(f"{key} is absent"))
    value = F.try_variant_get(player, f"$.{key}", kind)
    absent = F.lit(None).cast("string") if key == "r2p_pts" else F.lit(f"{key} is absent")
    why = F.when(there.isNull(), absent).when(null, f"{key} is null").when(value.isNull(), f"{key} is no number")
    return F.when(there.isNull(), F.lit(0.0)).otherwise(value) if key == "r2p_pts" else value, why


def judged_rankings(pages: DataFrame) -> DataFrame:
    """Rankings rows of landed pages with `reason`, null where the row is sound; a page without players is one row."""
    found = pages.select(F.col("position").alias("page_position"), "year", "week", script_players(F.col("html")).alias("players"))
    rows = found.select("page_position", "year", "week", F.col("players").isNull().alias("bare"), F.posexplode_outer("players").alias("place", "m"))
    columns, reasons = [], [F.when(F.col("bare"), "the page has no players"), F.when(F.col("m").isNull(), "the page's players are none")]
    for key, (name, kind) in FIELDS.items():
        value, why = field(F.col("m"), key, kind)
        columns.append(value.alias(name))
        reasons.append(why)
    out = rows.select("page_position", "place", F.col("year").cast("int"), F.col("week").cast("int"), *columns, F.coalesce(*reasons).alias("reason"))
    return out.select("page_position", "place", *RANKINGS.names, "reason")


def weekly_rankings(pages: DataFrame) -> DataFrame:
    """Rankings rows of landed pages (position, year, week, html), with the page's own position as page_position.

    A row lacking a key, or holding text that is no number where one is needed, is dropped; absent points are 0, null
    points drop the row; null names and grades become 'None'. checked_rankings keeps what is dropped."""
    return judged_rankings(pages).where("reason is null").drop("reason")


def checked_rankings(pages: DataFrame) -> Checked:
    """weekly_rankings, and what it drops."""
    return checked(judged_rankings(pages), "rankings")


def judged_salaries(pages: DataFrame) -> DataFrame:
    """Rows of contest pages with `reason`, null where the row is sound."""
    table = table_rows(pages, "prj-main-table", 0).where("row_idx >= 1")
    rows = named(table.withColumn("n", F.size("cells")), ["player", "extra", "position", "team", "opponent", "salary"], ["year", "week", "slate", "n"])
    amount = text.money(F.col("salary"))
    reason = F.when(F.col("n") < 6, "the row has too few cells").when(F.col("player").isNull(), "player is empty").when(amount.isNull(), "salary is no amount")
    return rows.select("year", "week", "slate", "player", "position", "team", text.opponent(F.col("opponent")).alias("opponent"), amount.alias("salary"), reason.alias("reason"))


def salary_page(pages: DataFrame) -> DataFrame:
    """Landed contest pages (year, week, slate, html) -> salary rows: header row and extra columns dropped, cells cleaned."""
    return judged_salaries(pages).drop("reason")


def checked_salaries(pages: DataFrame) -> Checked:
    """salary_page without the rows that can't be used, and those."""
    return checked(judged_salaries(pages), "salaries")


def first_slate(rows: DataFrame, slates: tuple[str, ...]) -> DataFrame:
    """Of every (year, week), the rows of the first slate that has any."""
    order = F.array_position(F.array(*map(F.lit, slates)), F.col("slate"))
    ranked = rows.withColumn("_slate", F.when(order > 0, order)).where("_slate is not null")
    best = ranked.groupBy("year", "week").agg(F.min("_slate").alias("_best"))
    return ranked.join(best, ["year", "week"]).where("_slate = _best").drop("_slate", "_best")


def page_urls(requests: DataFrame, base: str, single_week: bool = False) -> DataFrame:
    """position, year, week, kind -> url with its query string, for whoever lands the pages.

    Statistics cover the four weeks before, or with single_week the one asked for; pages of kind snap name their range
    start and end."""
    first, last = (F.col("week"), F.col("week")) if single_week else (F.col("week") - 4, F.col("week") - 1)
    custom = F.format_string("year=%d&range=custom&start_week=%d&end_week=%d&scoring=PPR", F.col("year"), first, last)
    if single_week:
        custom = F.format_string("year=%d&range=week&week=%d&scoring=PPR", F.col("year"), F.col("week"))
    snap = F.format_string("year=%d&range=custom&start=%d&end=%d&scoring=PPR", F.col("year"), first, last)
    query = F.when(F.col("kind") == "rankings", F.format_string("year=%d&week=%d", "year", "week")).when(F.col("kind") == "snap", snap).otherwise(custom)
    page = F.when(F.col("kind") == "rankings", text.page_path(F.col("position"))).otherwise(F.concat(F.lower("position"), F.lit(".php")))
    return requests.withColumn("url", F.concat(F.lit(base.rstrip("/") + "/"), F.col("kind"), F.lit("/"), page, F.lit("?"), query))
