"""A data source of paged files, read page by page.

A paged file begins with one line, the JSON list of its pages' lengths in bytes; the pages follow one after
another.  Partitions are ranges of pages of about ``range_bytes`` bytes, planned from the files' first lines, so a
large file is neither one value nor one task, and a task holds one page at a time.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").option("least_bytes", 1000).load(folder)

Options: ``suffix`` (.paged), ``least_bytes`` (files of no more bytes are not read), ``range_bytes`` (8 MB),
``decoder``, "module:function", from a page's bytes to its text (UTF-8); ``gated``: filters on size, greater or at least, are taken
over, which needs spark.sql.python.filterPushdown.enabled.  A page that can't be decoded, or a file whose first line isn't a
list that fits its size, is a row with an error; a blank page is none."""

from __future__ import annotations

import importlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition

from .readers import error_of

SCHEMA = "path string, size long, page_no int, text string, error string"
#: Bytes of a first line that are read at a time, and at most.
HEAD, MOST_HEAD = 1 << 16, 1 << 26


@dataclass
class Pages(InputPartition):
    """Pages from ``first`` on, which start at byte ``at``; or what is wrong with the file."""

    path: str
    size: int
    first: int = 0
    at: int = 0
    lengths: tuple[int, ...] = ()
    error: str | None = None


def opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def first_line(file) -> bytes:
    out = b""
    while b"\n" not in out:
        more = file.read(HEAD)
        if not more or len(out) > MOST_HEAD:
            raise ValueError("no first line")
        out += more
    return out.split(b"\n", 1)[0]


def planned(system, path: str, size: int, range_bytes: int) -> list[Pages]:
    try:
        with system.open_input_file(path) as file:
            line = first_line(file)
        lengths, at = json.loads(line), len(line) + 1
        if not isinstance(lengths, list) or any(not isinstance(n, int) or n < 0 for n in lengths) or at + sum(lengths) != size:
            raise ValueError("the first line does not fit the file")
    except Exception as e:  # noqa: BLE001  the other files can still be read
        return [Pages(path, size, error=error_of(e))]
    out, held = [], []
    first = start = 0
    for n in lengths:
        if held and sum(held) + n > range_bytes:
            out.append(Pages(path, size, first, at + start, tuple(held)))
            first, start, held = first + len(held), start + sum(held), []
        held.append(n)
    return [*out, Pages(path, size, first, at + start, tuple(held))] if held else out


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options.get("path", "")
        self.suffix = options.get("suffix", ".paged")
        self.least = int(options.get("least_bytes", -1))
        self.range_bytes = int(options.get("range_bytes", 8 << 20))
        self.decoder = options.get("decoder", "")

    def partitions(self):
        from pyarrow import fs

        system, folder = opened(self.folder)
        found = system.get_file_info(fs.FileSelector(folder, recursive=False))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(self.suffix) and f.size > self.least)
        return [p for path, size in files for p in planned(system, path, size, self.range_bytes)] or [Pages("", 0)]

    def read(self, partition):
        if partition.error:
            yield partition.path, partition.size, None, None, partition.error
            return
        module, _, name = self.decoder.partition(":")
        decode = getattr(importlib.import_module(module), name) if name else lambda b: b.decode("utf-8")
        system, _ = opened(self.folder)
        if not partition.lengths:
            return
        with system.open_input_file(partition.path) as file:
            file.seek(partition.at)
            for i, n in enumerate(partition.lengths):
                content = file.read(n)
                try:
                    text, error = decode(content), None
                except Exception as e:  # noqa: BLE001  the other pages can still be read
                    text, error = None, error_of(e)
                if error or text and text.strip():
                    yield partition.path, partition.size, partition.first + i + 1, text, error


class GatedReader(PagedReader):
    """Takes filters over; Spark lets a reader do so only where that is enabled."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("size",):
                self.least = max(self.least, f.value - isinstance(f, GreaterThanOrEqual))
            else:
                yield f


class PagedSource(DataSource):
    @classmethod
    def name(cls):
        return "paged"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (GatedReader if self.options.get("gated") == "true" else PagedReader)(self.options)


def paged(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The pages of a folder's paged files."""
    spark.dataSource.register(PagedSource)
    options = {"gated": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"), **options}
    return spark.read.format("paged").options(**options).load(folder)


def written(pages: list[bytes]) -> bytes:
    """A paged file."""
    return json.dumps([len(p) for p in pages]).encode() + b"\n" + b"".join(pages)
