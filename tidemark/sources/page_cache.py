"""The page cache as a Spark source and sink: one JSON file a URL, or a capture of it.

    spark.dataSource.register(PageCache)
    spark.read.format("page_cache").option("ttl_hours", 24).option("now", ...).load(root)
    captures.write.format("page_cache").mode("append").save(root)

A file is named by the SHA-256 of its URL, in one of 256 folders by its first two
digits, so folders are listed in parallel by the tasks that read them.  A URL that is
written again replaces its entry.  Rows with a column ``capture`` (any text that tells
captures of a URL apart) are all kept: their files lie in a folder of the URL, named by
the capture, so a task that is run again writes the same ones.  A filter on
``url`` opens that URL's files alone; one on ``fetched_at`` (or a time to live) passes
over files that were last written before it, for a page is written after it was
fetched.  Files that are no whole entry are left out of the rows, and counted in
``corrupt`` rows where the option ``corrupt`` asks for them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, WriterCommitMessage

SCHEMA = "url string, status int, text string, fetched_at timestamp, corrupt string"
FOLDERS = 256


def _open(root: str):
    """(file system, path) of a folder, wherever it is."""
    from pyarrow import fs

    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), root.rstrip("/")
    at, path = fs.FileSystem.from_uri(root.replace("file:///", "file:/").replace("file:/", "file:///"))
    return at, path.rstrip("/")


def name_of(url: str, capture: str | None = None) -> str:
    """Where the file of a URL, or of one of its captures, is, under the root."""
    h = hashlib.sha256(url.encode()).hexdigest()
    return f"{h[:2]}/{h}.json" if capture is None else f"{h[:2]}/{h}/{hashlib.sha256(capture.encode()).hexdigest()}.json"


def _aware(t: datetime) -> datetime:
    return t if t.tzinfo else t.replace(tzinfo=UTC)


@dataclass
class _Folders(InputPartition):
    names: list[str]  # folders, or one URL's file


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.url, self.since = options["path"], None, None
        self.corrupt = options.get("corrupt", "false").lower() == "true"
        self.tasks = int(options.get("tasks", "32"))
        if "ttl_hours" in options:
            now = datetime.fromisoformat(options["now"]) if "now" in options else datetime.now(UTC)
            self.since = _aware(now) - timedelta(hours=float(options["ttl_hours"]))
            self.strict = True

    strict = False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 (Spark's name)
        """Takes over equality on url; bounds on fetched_at pass over files and are
        checked by Spark again, as times within a file are finer."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("url",) and self.url is None:
                self.url = f.value
                continue
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("fetched_at",):
                t = _aware(f.value)
                self.since = t if self.since is None else max(t, self.since)
            yield f

    def partitions(self) -> list[InputPartition]:
        if self.url is not None:
            return [_Folders([name_of(self.url)])]
        every = [f"{n:02x}" for n in range(FOLDERS)]
        return [_Folders(every[k :: self.tasks]) for k in range(min(self.tasks, FOLDERS))]

    def read(self, partition: _Folders) -> Iterator[tuple]:
        from pyarrow import fs

        at, root = _open(self.root)
        for name in partition.names:
            files = at.get_file_info([f"{root}/{name}"]) if name.endswith(".json") else []
            files += at.get_file_info(fs.FileSelector(f"{root}/{name.removesuffix('.json')}", allow_not_found=True, recursive=True))
            files = [f for f in files if f.type == fs.FileType.File and f.path.endswith(".json")]
            for f in sorted(files, key=lambda f: f.path):
                if self.since is not None and f.mtime is not None and _aware(f.mtime) < self.since:
                    continue  # written before, so fetched before
                row = self._entry(at, f.path)
                if row[4] is not None:
                    if self.corrupt:
                        yield row
                elif (self.url is None or row[0] == self.url) and not (self.strict and self.since is not None and row[3] <= self.since):
                    yield row

    @staticmethod
    def _entry(at, path: str) -> tuple:
        try:
            with at.open_input_stream(path) as f:
                x = json.loads(f.read().decode())
            if f"{x['url']}" and path.endswith(name_of(x["url"], x.get("capture"))):
                return x["url"], x.get("status"), x.get("text"), _aware(datetime.fromisoformat(x["fetched_at"])), None
        except (ValueError, KeyError, TypeError, AttributeError):  # no JSON, no entry
            pass
        return None, None, None, None, path


class _Writer(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool, columns: list[str]):
        self.root, self.columns = root, columns
        if overwrite:
            raise ValueError("a page cache is only added to")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        """Writes beside the entry and renames: a reader sees the old one or the new."""
        at, root = _open(self.root)
        for r in rows:
            x = dict(zip(self.columns, r, strict=True))
            capture = None if x.get("capture") is None else str(x["capture"])
            name = name_of(x["url"], capture)
            at.create_dir(f"{root}/{name}".rpartition("/")[0])
            part = f"{root}/{name}.{uuid.uuid4().hex}.part"
            with at.open_output_stream(part) as f:
                entry = {"url": x["url"], "status": x["status"], "text": x["text"], "fetched_at": _aware(x["fetched_at"]).isoformat()}
                f.write(json.dumps(entry if capture is None else entry | {"capture": capture}).encode())
            at.move(part, f"{root}/{name}")
        return WriterCommitMessage()


class PageCache(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_cache"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite, [f.name for f in schema])


def register(spark) -> None:
    """Makes the format known to a session, with filters passed on to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageCache)
