"""``midi`` as a data source: spark.read.format("midi") and df.write.format("midi").

Reading plans partitions by bytes and yields a row an event (a row a file that does not decode, with
its reason). Writing is a two-phase commit: tasks put files aside, and the driver alone moves them to
their places once all tasks are through."""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from notewright.sources.midi import EVENT, midi_events
from notewright.sources.store import opened

SUFFIXES = (".mid", ".MID")
#: Bytes that a partition holds at most (unless one file is larger), and what a file counts besides its
#: own, since opening it takes time; events in a batch; files from this size on are walked through once
#: before their events are passed on, so that none of a corrupt file's events are.
PARTITION_BYTES = 16 << 20
OPEN_BYTES = 64 << 10
BATCH_EVENTS = 1 << 15
LARGE = 1 << 20
STAGING = "_staging"

SCHEMA = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("status", T.StringType()), T.StructField("resolution", T.IntegerType())] + EVENT.fields
)
WRITTEN = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])
ARROW = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.StringType(): pa.string()}
FILE_COLUMNS = ("path", "size", "status", "resolution")


def listed(folder: str, recursive: bool = True) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a folder that are named exactly *.mid or *.MID, by path. Names
    that begin with _ or a dot, and what lies in folders of such names, are not listed."""
    store, root = opened(folder)
    found = store.get_file_info(fs.FileSelector(root, recursive=recursive, allow_not_found=False))
    hidden = lambda path: any(part[:1] in "_." for part in posixpath.relpath(path, root).split("/"))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(SUFFIXES) and not hidden(f.path))


def planned(files: list[tuple[str, int]], most: int = PARTITION_BYTES) -> list[list[tuple[str, int]]]:
    """Files dealt into partitions of at most so many bytes: the largest first, each into the partition
    that has least, so small files spread evenly and a large one has a partition of its own."""
    import heapq

    if not files:
        return []
    cost = lambda f: f[1] + OPEN_BYTES
    number = max(1, -(-sum(map(cost, files)) // most))
    loads: list[tuple[int, int]] = [(0, i) for i in range(number)]
    dealt: list[list[tuple[str, int]]] = [[] for _ in range(number)]
    for file in sorted(files, key=lambda f: (-f[1], f[0])):
        load, i = heapq.heappop(loads)
        dealt[i].append(file)
        heapq.heappush(loads, (load + cost(file), i))
    return [sorted(d) for d in dealt if d]


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class MidiReader(DataSourceReader):
    """Filters on path (equal, in, beginning with) drop files before they are read, those on status and
    type drop rows before they reach Spark; a schema of some columns leaves the others unmade."""

    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.schema = schema
        self.folder = options["path"]
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.limit = int(options["limit"]) if "limit" in options else None
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.allowed: dict[str, set] = {}
        self.beginnings: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo | In) and name in ("path", "status", "type"):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.allowed[name] = self.allowed.get(name, values) & values
            elif isinstance(f, StringStartsWith) and name == "path":
                self.beginnings.append(f.value)
            elif not (isinstance(f, IsNotNull) and name in ("path", "size", "status")):  # these never are
                yield f

    def partitions(self) -> list[Files]:
        files = listed(self.folder, self.recursive)[: self.limit]
        files = [f for f in files if f[0] in self.allowed.get("path", {f[0]}) and all(f[0].startswith(b) for b in self.beginnings)]
        return [Files(part) for part in planned(files, self.most)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.folder)
        names = [f.name for f in self.schema]
        types = [ARROW[f.dataType] for f in self.schema]
        rows = _Rows(names, types)
        kinds, statuses = self.allowed.get("type"), self.allowed.get("status")
        for path, size in partition.files:
            with store.open_input_stream(path) as file:
                content = file.read()
            try:
                resolution, events = midi_events(content)
                if size >= LARGE:
                    for _ in events:
                        pass
                    events = midi_events(content)[1]
                held = events if size >= LARGE else list(events)
                status = "ok"
            except ValueError as reason:
                status, resolution, held = str(reason), None, [{}]
            if statuses is None or status in statuses:
                about = {"path": path, "size": size, "status": status, "resolution": resolution}
                for event in held:
                    if kinds is None or event.get("type") in kinds:
                        yield from rows.add(about, event)
        yield from rows.rest()


class _Rows:
    """Rows by column, given out in batches."""

    def __init__(self, names: list[str], types: list[pa.DataType]) -> None:
        self.names, self.types = names, types
        self.columns: list[list] = [[] for _ in names]
        self.count = 0

    def add(self, about: dict, event: dict) -> Iterator[pa.RecordBatch]:
        for name, column in zip(self.names, self.columns, strict=True):
            column.append(about[name] if name in FILE_COLUMNS else event.get(name))
        self.count += 1
        if self.count >= BATCH_EVENTS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.count:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns, self.types, strict=True)], names=self.names)
            self.columns, self.count = [[] for _ in self.names], 0


@dataclass
class Staged(WriterCommitMessage):
    """What a task has put aside: (name in the staging folder, place below the target)."""

    files: list[tuple[str, str]]


class MidiWriter(DataSourceWriter):
    """Tasks write each file under a name of the job's own in the staging folder. The commit first puts
    down a list of all moves (as one renamed file), then makes them, then drops the job's folder: before
    the list is there nothing of the job shows, and from then on `recover` can finish it. A task that
    ran twice, or was lost, leaves files that no list names."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.folder, self.overwrite = options["path"], overwrite
        self.job = uuid.uuid4().hex

    def _staging(self) -> tuple[fs.FileSystem, str, str]:
        store, root = opened(self.folder)
        return store, root, posixpath.join(root, STAGING, self.job)

    def write(self, iterator: Iterator[T.Row]) -> Staged:
        store, _, staging = self._staging()
        store.create_dir(staging, recursive=True)
        done = []
        for row in iterator:
            place = safe_place(row["path"])
            name = f"{uuid.uuid4().hex}.part"
            with store.open_output_stream(posixpath.join(staging, name)) as out:
                out.write(bytes(row["content"] or b""))
            done.append((name, place))
        return Staged(done)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root, staging = self._staging()
        moves = [move for m in messages if m is not None for move in m.files]
        places = [place for _, place in moves]
        if len(set(places)) < len(places):
            self.abort(messages)
            raise ValueError("two rows have the same path")
        store.create_dir(staging, recursive=True)
        gone = sorted({posixpath.relpath(p, root) for p, _ in listed(root)} - set(places)) if self.overwrite else []
        with store.open_output_stream(posixpath.join(staging, "moves.part")) as out:
            out.write(json.dumps({"moves": moves, "gone": gone}).encode())
        store.move(posixpath.join(staging, "moves.part"), posixpath.join(staging, "moves.json"))
        finish(store, root, staging)

    def abort(self, messages: list[Staged | None]) -> None:
        store, _, staging = self._staging()
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


def safe_place(path: str | None) -> str:
    """A path below the target folder; refuses those that lead out of it or would not be listed."""
    parts = [p for p in (path or "").split("/") if p not in ("", ".")]
    if not parts or ".." in parts or any(p[0] in "_." for p in parts) or not parts[-1].endswith(SUFFIXES):
        raise ValueError(f"not a path of a MIDI file below a folder: {path!r}")
    return "/".join(parts)


def finish(store: fs.FileSystem, root: str, staging: str) -> None:
    """Makes the moves of a job's list, as far as they are not made yet."""
    with store.open_input_stream(posixpath.join(staging, "moves.json")) as file:
        todo = json.loads(file.read())
    for name, place in todo["moves"]:
        part, target = posixpath.join(staging, name), posixpath.join(root, place)
        if store.get_file_info(part).type == fs.FileType.File:
            store.create_dir(posixpath.dirname(target), recursive=True)
            store.move(part, target)
    for place in todo["gone"]:
        if store.get_file_info(target := posixpath.join(root, place)).type == fs.FileType.File:
            store.delete_file(target)
    store.delete_dir(staging)


def recover(folder: str) -> int:
    """Finishes the jobs whose list of moves was put down before their driver was lost, and returns how
    many; drops what other jobs left in the staging folder (a task may put files there after its job was
    aborted). Not to be called while a job writes."""
    store, root = opened(folder)
    done = 0
    for job in store.get_file_info(fs.FileSelector(posixpath.join(root, STAGING), allow_not_found=True)):
        if store.get_file_info(posixpath.join(job.path, "moves.json")).type == fs.FileType.File:
            finish(store, root, job.path)
            done += 1
        elif job.type == fs.FileType.Directory:
            store.delete_dir(job.path)
    return done


class MidiSource(DataSource):
    """Options for reading: path, recursive (true), limit (the first files by path), partitionBytes.
    The schema is SCHEMA or any of its columns. For writing: path; rows are (path, content)."""

    @classmethod
    def name(cls) -> str:
        return "midi"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> MidiReader:
        if unknown := [f.name for f in schema if f not in SCHEMA.fields]:
            raise ValueError(f"the midi source has no such columns: {unknown}")
        return MidiReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> MidiWriter:
        if [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in WRITTEN]:
            raise ValueError(f"the midi source writes rows of {WRITTEN.simpleString()}")
        return MidiWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark hand filters down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MidiSource)


def some_columns(*names: str) -> T.StructType:
    """The source's schema of these columns only."""
    return T.StructType([SCHEMA[n] for n in names])
