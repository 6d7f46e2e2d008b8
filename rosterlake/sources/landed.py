"""Pages as a Spark data source: `spark.read.format("rosterlake_pages")`.

One partition is one page, known by (kind, position, year, week, span); span is `range` for the four weeks before, or
`week` for the week alone. Filters on these columns choose pages before any is read. Pages come from a landed folder,
{path}/kind=K/position=P/year=Y/week=W/span=S/, or, with option `base`, from a server, at the address that page_urls gives.
"""

from __future__ import annotations

import re
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "kind string, position string, year int, week int, span string, url string, html string"
KEYS = ("kind", "position", "year", "week", "span")
SPANS = ("range", "week")


def page_url(base: str, kind: str, position: str, year: int, week: int, span: str = "range") -> str:
    """The address of one page; see page_urls, which gives the same as a column."""
    page = position.lower() + ".php"
    if kind == "rankings":
        return f"{base.rstrip('/')}/{kind}/{'' if position.upper() in ('QB', 'DST') else 'ppr-'}{page}?year={year}&week={week}"
    if span == "week" and kind != "snap":
        query = f"range=week&week={week}"
    else:
        first, last = (week, week) if span == "week" else (week - 4, week - 1)
        names = ("start", "end") if kind == "snap" else ("start_week", "end_week")
        query = f"range=custom&{names[0]}={first}&{names[1]}={last}"
    return f"{base.rstrip('/')}/{kind}/{page}?year={year}&{query}&scoring=PPR"


@dataclass
class Page(InputPartition):
    kind: str
    position: str
    year: int
    week: int
    span: str
    files: tuple[str, ...] = ()


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality and IN on the keys choose pages; all else is left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in KEYS:
                values = set(f.value) if isinstance(f, In) else {f.value}
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def chosen(self, pages: Iterable[Page]) -> list[Page]:
        return [p for p in pages if all(getattr(p, k) in v for k, v in self.wanted.items())]

    def partitions(self) -> list[Page]:
        return self.chosen(self.asked() if "base" in self.options else self.landed())

    def asked(self) -> Iterator[Page]:
        """Every page that the options kinds, positions, years, weeks and spans name, comma-separated."""
        listed = lambda name, default="": [x.strip() for x in self.options.get(name, default).split(",") if x.strip()]
        for kind in listed("kinds", "rankings,stats"):
            for position in listed("positions", "QB,RB,WR,TE,DST"):
                for year in listed("years"):
                    for week in listed("weeks"):
                        for span in listed("spans", "range"):
                            yield Page(kind, position, int(year), int(week), span)

    def folder(self) -> tuple:
        """File system and path: a path of this machine or a mounted one, or any address that pyarrow.fs knows."""
        from pyarrow import fs

        path = self.options["path"]
        return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)

    def landed(self) -> Iterator[Page]:
        """Pages under the folder, by the names of their folders; nothing is opened."""
        from pyarrow import fs

        system, root = self.folder()
        pattern = re.compile(r"kind=([^/]+)/position=([^/]+)/year=(\d+)/week=(\d+)/span=([^/]+)/[^/_.][^/]*$")
        found: dict[tuple, list[str]] = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            name = pattern.search(info.path) if info.is_file else None
            if name:
                kind, position, year, week, span = name.groups()
                found.setdefault((urllib.parse.unquote(kind), urllib.parse.unquote(position), int(year), int(week), span), []).append(info.path)
        for key, files in sorted(found.items()):
            yield Page(*key, tuple(sorted(files)))

    def read(self, page: Page) -> Iterator[pa.RecordBatch]:
        url = page_url(self.options.get("base", ""), page.kind, page.position, page.year, page.week, page.span)
        if page.files:
            system, texts = self.folder()[0], []
            for file in page.files:
                with system.open_input_stream(file) as stream:
                    texts.append(stream.read().decode("utf-8", "replace"))
            html = "".join(texts)
        else:
            with urllib.request.urlopen(url, timeout=float(self.options.get("timeout", "30"))) as answer:
                html = answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
        columns = [[page.kind], [page.position], pa.array([page.year], pa.int32()), pa.array([page.week], pa.int32()), [page.span], [url], [html]]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.string()) for c in columns], names=[*KEYS, "url", "html"])


class LandedPages(DataSource):
    """Options: path of a landed folder; or base, kinds, positions, years, weeks, spans, timeout (seconds) to fetch."""

    @classmethod
    def name(cls) -> str:
        return "rosterlake_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        if "base" not in self.options and "path" not in self.options:
            raise ValueError("rosterlake_pages needs the option path, or base")
        return PageReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and have Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedPages)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("rosterlake_pages").option("path", path).load()


def land_pages(pages: DataFrame, path: str) -> None:
    """Write (kind, position, year, week, span, html) into a landed folder, a page a folder; those that come again are replaced."""
    rows = pages.select("kind", "position", "year", "week", "span", "html").repartition(*KEYS)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").partitionBy(*KEYS).text(path)
