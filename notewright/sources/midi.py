"""Standard MIDI Files: listing, decoding to event rows, and writing notes back as files.

The byte codec is plain Python inside Arrow batches; all that follows decoding is built-in."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType(
    [T.StructField("track", T.IntegerType()), T.StructField("idx", T.IntegerType()), T.StructField("type", T.StringType())]
    + [T.StructField(c, T.IntegerType()) for c in ("channel", "note", "velocity", "program", "control", "value", "pitch", "tempo", "numerator", "denominator")]
    + [T.StructField("key", T.StringType()), T.StructField("text", T.StringType()), T.StructField("dtick", T.LongType())]
)
FIELDS = [f.name for f in EVENT]
# Kinds of channel messages and of text metas; key names by sharps (flats below 0).
TEXT_METAS = {1: "text", 3: "track_name", 5: "lyrics", 6: "marker"}
MAJOR = ("Cb", "Gb", "Db", "Ab", "Eb", "Bb", "F", "C", "G", "D", "A", "E", "B", "F#", "C#")
MINOR = ("Abm", "Ebm", "Bbm", "Fm", "Cm", "Gm", "Dm", "Am", "Em", "Bm", "F#m", "C#m", "G#m", "D#m", "A#m")


def midi_files(spark: SparkSession, folder: str, *, subfolders: bool = True, limit: int | None = None) -> DataFrame:
    """(path, content) of files named exactly *.mid or *.MID; with limit the first in path order."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.{mid,MID}")
    files = reader.option("recursiveFileLookup", str(subfolders).lower()).load(folder).select("path", "content")
    if limit is None:
        return files
    first = files.select("path").orderBy("path").limit(limit)
    return files.join(first, "path", "left_semi")


class _Bytes:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the file ends inside an event")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """A variable-length number."""
        out = 0
        while True:
            b = self.byte()
            out = out << 7 | b & 0x7F
            if not b & 0x80:
                return out


def _meta(kind: int, data: bytes) -> dict | None:
    if kind in TEXT_METAS:
        return {"type": TEXT_METAS[kind], "text": data.decode("latin-1")}
    if kind == 0x51 and len(data) >= 3:
        return {"type": "set_tempo", "tempo": int.from_bytes(data[:3], "big")}
    if kind == 0x58 and len(data) >= 2:
        return {"type": "time_signature", "numerator": data[0], "denominator": 1 << data[1]}
    if kind == 0x59 and len(data) >= 2:
        sharps = struct.unpack("b", data[:1])[0]
        if not -7 <= sharps <= 7:
            raise ValueError("a key signature is out of range")
        return {"type": "key_signature", "key": (MINOR if data[1] else MAJOR)[sharps + 7]}
    return None


def _channel(status: int, data: _Bytes) -> dict:
    kind, channel = status & 0xF0, status & 0x0F
    one = min(data.byte(), 127)  # values beyond seven bits are clipped
    two = min(data.byte(), 127) if kind not in (0xC0, 0xD0) else 0
    return {
        0x80: lambda: {"type": "note_off", "note": one, "velocity": two},
        0x90: lambda: {"type": "note_on", "note": one, "velocity": two},
        0xA0: lambda: {"type": "polytouch", "note": one, "value": two},
        0xB0: lambda: {"type": "control_change", "control": one, "value": two},
        0xC0: lambda: {"type": "program_change", "program": one},
        0xD0: lambda: {"type": "aftertouch", "value": one},
        0xE0: lambda: {"type": "pitchwheel", "pitch": (two << 7 | one) - 8192},
    }[kind]() | {"channel": channel}


def decode_midi(content: bytes) -> tuple[int, list[dict]]:
    """(resolution, events) of one file; raises ValueError where it is not well-formed."""
    resolution, events = midi_events(content)
    return resolution, list(events)


def midi_events(content: bytes) -> tuple[int, Iterator[dict]]:
    """(resolution, events) of one file, events one at a time; raises ValueError where the file turns
    out not to be well-formed."""
    data = _Bytes(content)
    if data.take(4) != b"MThd" or int.from_bytes(data.take(4), "big") < 6:
        raise ValueError("no MIDI header")
    _, tracks, division = struct.unpack(">HHH", data.take(6))
    if division & 0x8000 or not division:
        raise ValueError("only ticks per quarter note are supported")
    return division, _track_events(data, tracks)


def _track_events(data: _Bytes, tracks: int) -> Iterator[dict]:
    for track in range(tracks):
        if data.take(4) != b"MTrk":
            raise ValueError("a track chunk is missing")
        body = _Bytes(data.take(int.from_bytes(data.take(4), "big")))
        running, waited, idx = None, 0, 0
        while body.at < len(body.data):
            waited += body.number()
            status = body.byte()
            event: dict | None
            if status == 0xFF:
                kind, payload = body.byte(), b""
                payload = body.take(body.number())
                if kind == 0x2F:
                    event = {"type": "end_of_track"}
                else:
                    event = _meta(kind, payload)
            elif status in (0xF0, 0xF7):
                body.take(body.number())
                event = None
            else:
                if status & 0x80:
                    running = status
                elif running is None:
                    raise ValueError("running status without a status")
                else:
                    body.at -= 1
                event = _channel(running, body)
            if event is None:
                continue
            yield {**event, "track": track, "idx": idx, "dtick": waited}
            waited, idx = 0, idx + 1


def read_events(files: DataFrame) -> DataFrame:
    """(path, status, resolution, events) of (path, content): status is ok or why decoding failed,
    so rejects can be kept aside. A file's events stay one row until exploded."""
    schema = "path string, status string, resolution int, events array<%s>" % EVENT.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.StringType(): pa.string()}
        arrow = pa.list_(pa.struct([(f.name, kinds[f.dataType]) for f in EVENT]))
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    resolution, events = decode_midi(content)
                    row = ("ok", resolution, [{c: e.get(c) for c in FIELDS} for e in events])
                except ValueError as reason:
                    row = (str(reason), None, None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([row[0]]), pa.array([row[1]], pa.int32()), pa.array([row[2]], arrow)],
                    names=["path", "status", "resolution", "events"],
                )

    return files.select("path", "content").mapInArrow(run, schema)


def event_rows(decoded: DataFrame, song: str = "song") -> DataFrame:
    """midi_event rows of the files that decoded; decoded must carry a song number."""
    return decoded.where("status = 'ok'").select(song, "resolution", F.inline("events"))


def _variable(n: int) -> bytes:
    out = bytes([n & 0x7F])
    while n := n >> 7:
        out = bytes([n & 0x7F | 0x80]) + out
    return out


def encode_midi(notes: list[dict], tempo: float = 120.0, resolution: int = 220) -> bytes:
    """A file of one tempo track and one track an instrument, from notes (program, is_drum, pitch,
    velocity, start, end in seconds). At one tick offs come before ons."""
    ticks = lambda s: round(s * tempo / 60.0 * resolution)
    chunks = [b"\x00\xff\x51\x03" + round(6e7 / tempo).to_bytes(3, "big") + b"\x00\xff\x2f\x00"]
    groups: dict[tuple, list[dict]] = {}
    for note in notes:
        groups.setdefault((note["is_drum"], note["program"]), []).append(note)
    free = [c for c in range(16) if c != 9]
    for n, ((drum, program), members) in enumerate(groups.items()):
        channel = 9 if drum else free[n % len(free)]
        timed = []
        for note in members:
            timed.append((ticks(note["start"]), 1, note["pitch"], note["velocity"]))
            timed.append((ticks(note["end"]), 0, note["pitch"], 0))
        body, now = b"\x00" + bytes([0xC0 | channel, program]), 0
        for tick, on, pitch, velocity in sorted(timed):
            body += _variable(tick - now) + bytes([(0x90 if on else 0x80) | channel, pitch, velocity])
            now = tick
        chunks.append(body + b"\x00\xff\x2f\x00")
    head = b"MThd" + struct.pack(">IHHH", 6, 1, len(chunks), resolution)
    return head + b"".join(b"MTrk" + struct.pack(">I", len(c)) + c for c in chunks)


def midi_content(notes: DataFrame, path_col: str = "path", tempo: float = 120.0) -> DataFrame:
    """(path, content): one file a path from note rows."""
    note = F.struct("start", "program", "is_drum", "pitch", "velocity", "end")
    grouped = notes.groupBy(F.col(path_col).alias("path")).agg(F.sort_array(F.collect_list(note)).alias("notes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [encode_midi(notes, tempo) for notes in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    return grouped.mapInArrow(run, "path string, content binary")


def write_files(files: DataFrame, folder: str) -> None:
    """Writes (path, content) below a folder that all executors share. Each file is written beside
    its place and renamed, so a task that runs again leaves whole files."""

    def put(rows) -> None:
        for row in rows:
            target = os.path.join(folder, row["path"].lstrip("/"))
            os.makedirs(os.path.dirname(target), exist_ok=True)
            part = f"{target}.{os.getpid()}.part"
            with open(part, "wb") as out:
                out.write(row["content"])
            os.replace(part, target)

    files.select("path", "content").foreachPartition(put)
