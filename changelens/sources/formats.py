"""``spark.read.format("change_records")`` and ``("watch_list")``: YAML files as tables, groups of files at a time.

Register both once with ``register(spark)``. The driver only lists names; files are read where the rows are made. Folders are
named as paths or addresses of a file system that Arrow knows.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import RECORDS
from .records import parse_safely

FILES_PER_PARTITION = 64
WATCH = "slug string, name string, url string, registry_name string, added date, place int, file string, error string"
#: A watched server's short name, its address and the greatest length of its name.
SLUG = re.compile(r"[a-z0-9][a-z0-9-]{0,62}")
HTTPS = re.compile(r"https://[^\s/?#]+\S*")
NAME_SIZE = 100


@dataclass
class Files(InputPartition):
    """(place, path) of some files, in order."""

    files: list[tuple[int, str]]


def listed(path: str) -> list[str]:
    """A folder's ``*.yml`` by name, then its ``*.yaml``; a file's own path."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [path]
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(place)) if f.is_file and not f.base_name.startswith((".", "_")))
    return [f"{path.rstrip('/')}/{n}" for end in (".yml", ".yaml") for n in names if n.endswith(end)]


def content(path: str) -> str:
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with system.open_input_stream(place) as f:
        return f.read().decode("utf-8", "replace")


def day(text: str | None) -> datetime.date | None:
    """An ISO day; null for any other text."""
    try:
        return datetime.date.fromisoformat(text) if text and len(text) == 10 else None
    except ValueError:
        return None


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.group = int(options.get("filesPerPartition", FILES_PER_PARTITION))

    def partitions(self) -> list[Files]:
        files = list(enumerate(listed(self.path)))
        return [Files(files[i : i + self.group]) for i in range(0, len(files), self.group)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for place, path in partition.files:
            yield from self.rows(place, path)

    def rows(self, place: int, path: str) -> Iterator[tuple]:
        raise NotImplementedError


#: Columns in their order.
RECORD_COLUMNS = re.findall(r"(\w+) (?:string|date|boolean|int|array)", RECORDS)


class RecordReader(_Reader):
    def rows(self, place: int, path: str) -> Iterator[tuple]:
        found = parse_safely(content(path)) | {"load_ordinal": place}
        found |= {c: day(found.get(c)) for c in ("effective", "verified_on")}
        if found.get("evidence"):
            found["evidence"] = [(e["url"], e["text"]) for e in found["evidence"]]
        yield tuple(found.get(c) for c in (*RECORD_COLUMNS, "error"))


class WatchReader(_Reader):
    def rows(self, place: int, path: str) -> Iterator[tuple]:
        import yaml

        try:
            raw = yaml.safe_load(content(path)) or {}
            servers = raw.get("servers") or []
            if not isinstance(servers, list):
                raise TypeError("servers is no list")
        except (yaml.YAMLError, AttributeError, TypeError, ValueError, RecursionError) as e:
            yield (None, None, None, None, None, None, path, f"{type(e).__name__}: {e}"[:500])
            return
        known: set[str] = set()
        for i, row in enumerate(servers):
            values = {k: str(v) for k, v in row.items() if v is not None} if isinstance(row, dict) else {}
            slug, name, url, added = (values.get(k, "") for k in ("slug", "name", "url", "added"))
            faults = {
                "no mapping": not isinstance(row, dict),
                "bad slug": not SLUG.fullmatch(slug),
                "url must be https": not HTTPS.fullmatch(url),
                f"a name of 1 to {NAME_SIZE} characters": not 1 <= len(name) <= NAME_SIZE,
                "added is no day": bool(added) and day(added) is None,
                "duplicate slug": slug in known,
            }
            known.add(slug)
            error = next((fault for fault, is_so in faults.items() if is_so), None)
            yield (slug or None, name or None, url or None, values.get("registry_name", ""), day(added), i, path, error)


class ChangeRecords(DataSource):
    """Change records, one YAML file each: ``schemas.RECORDS`` and ``error``.

    ``load_ordinal`` is a file's place: ``*.yml`` by name, then ``*.yaml``. A malformed file is a row of nulls with ``error``; a day of
    another form is null. An empty folder is an empty table, a missing one an error. Option ``filesPerPartition``.
    """

    @classmethod
    def name(cls) -> str:
        return "change_records"

    def schema(self) -> str:
        return f"{RECORDS}, error string"

    def reader(self, schema: object) -> RecordReader:
        return RecordReader(self.options)


class WatchList(DataSource):
    """Watched servers of YAML files with a list ``servers``.

    ``place`` is a server's place in its file (from 0). What is out of order keeps its row and says why in ``error``: a slug said
    twice in a file at its second place, a malformed file in a row of its own.
    """

    @classmethod
    def name(cls) -> str:
        return "watch_list"

    def schema(self) -> str:
        return WATCH

    def reader(self, schema: object) -> WatchReader:
        return WatchReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (ChangeRecords, WatchList):
        spark.dataSource.register(source)
