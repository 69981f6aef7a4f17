"""Files that are still being written, as a stream that executors read.

The driver only follows the heads of packets, of each file from where the last batch ended, to learn how far whole packets reach; a batch takes
about ``bytesPerTrigger`` bytes, shared out over the files; where that would be less than ``LEAST`` of each, it takes more of as many files as it has bytes for, and the next batch
goes on with those behind them.  Tasks read the stretches between, so an offset is a position for each
file, a packet half written is read once it is complete, and a restart goes on where the last committed batch ended.

``append_index`` numbers edit units as their elements come in, and ``hold_packages`` holds elements back until those of all tracks of an edit unit are
there.  Both keep state for each file: two numbers, or the elements of edit units that aren't whole.
"""

from __future__ import annotations

import base64
import bisect
import contextlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor

from ..sources import klv, places

#: Bytes of one batch and of one task, about.
BATCH, SPLIT = 256 << 20, 16 << 20
#: Bytes that a batch takes of a file before it goes on to the next, at least, as opening one costs about as much.
LEAST = 1 << 20
SCHEMA = "path string, key string, track_number long, offset long, size long, value binary"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_LENGTH = struct.Struct(">I").unpack_from
#: Bytes of a packet's key and length, at most; read at once where packets are small; files from which on an offset is packed.
MOST_HEAD, AHEAD, MANY = 25, 256 << 10, 1000


def whole_until(f, at: int, most: int | None = None, every: int = SPLIT, ahead: int = MOST_HEAD) -> list[int]:
    """Ends of stretches of whole packets from ``at`` on, of about ``every`` bytes; the last one ends where no further packet is whole or ``most`` bytes are reached.

    Nothing but the heads of packets is read, or with a larger ``ahead`` so many bytes at once behind a packet that is far smaller.
    """
    ends, begun, here = [], at, at
    stop = f.size if most is None else min(f.size, at + most)
    last = ahead  # bytes of the packet before
    while here < stop:
        first, data = here, f.read_at(ahead if last * 16 <= ahead else MOST_HEAD, here)
        k = before = 0
        until = min(len(data) - MOST_HEAD + 1, stop - here, begun + every - here)
        while k < until and data[k + 16] == 0x84:  # nearly all
            before, k = k, k + 21 + _LENGTH(data, k + 17)[0]
        if not k:  # another kind of length, or the last bytes of the file
            found = klv.length(data, 16) if len(data) >= 17 else None
            if not found:
                break
            k = 16 + found[1] + found[0]
        whole = first + k <= f.size
        here, last = first + (k if whole else before), k - before
        if here - begun >= every:
            ends.append(here)
            begun = here
        if not whole:
            break
    return [*ends, here] if here > begun else ends


def packed(offset: dict[str, int]) -> dict:
    """An offset as Spark keeps it, several times for each batch: that of many files compressed, the same text for the same offset."""
    if len(offset) < MANY:
        return offset
    return {"packed": base64.b64encode(zlib.compress(json.dumps(offset, sort_keys=True).encode(), 1)).decode()}


def unpacked(offset: dict) -> dict[str, int]:
    held = offset.get("packed")
    return json.loads(zlib.decompress(base64.b64decode(held))) if isinstance(held, str) else offset


@dataclass
class _Stretches(InputPartition):
    """(path, begin, end) of what one task reads."""

    of: list[tuple[str, int, int]]


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, most: int, split: int, progress: str | None):
        self.path, self.most, self.split, self.progress = path, most, split, progress
        self._cuts: dict[tuple[str, int], list[int]] = {}  # ends of the stretches that the batch to come was found to have
        self._reached = self._behind = ""  # the last file that the batch to come, and the one before, took bytes of
        self._last = self._planned()  # the end of the last batch planned; None if this process can't know it

    def _planned(self) -> dict[str, int] | None:
        if not self.progress:
            return None
        system, path = places.system_of(self.progress)
        if system.get_file_info(path).size is None:
            return {}
        with system.open_input_file(path) as f:
            return json.loads(f.read())

    def _plan(self, end: dict) -> None:
        """Spark logs a batch's end before it asks for its partitions, so what is kept here never lies before the last committed offset."""
        self._last = {**(self._last or {}), **end}
        if self.progress:
            system, path = places.system_of(self.progress)
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(f"{path}.new") as f:
                f.write(json.dumps(self._last).encode())
            system.move(f"{path}.new", path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Where whole packets end, or about ``most`` bytes after the last batch."""
        files = places.files_under(self.path)
        out, self._cuts = dict(self._last or {}), {}
        left = share = None
        if self._last is not None:
            left, share = self.most, max(-(-self.most // max(1, len(files))), min(LEAST, self.most))
        first = bisect.bisect_right(files, self._behind, key=lambda f: f[0])
        for path, size in files[first:] + files[:first]:
            if left is not None and left <= 0:
                break
            at = out.get(path, 0)
            if size > at:
                f = places.Ranges(path)
                try:
                    ends = whole_until(f, at, share, self.split, AHEAD)
                finally:
                    f.close()
                if ends:
                    out[path], self._cuts[path, at], self._reached = ends[-1], ends, path
                    left = None if left is None else left - (ends[-1] - at)
        return packed(out)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Stretches of about ``split`` bytes, those of small files together."""
        found, held, size = [], [], 0
        start, end = unpacked(start), unpacked(end)
        for path, until in end.items():
            at = start.get(path, 0)
            if until <= at:
                continue
            cuts = self._cuts.get((path, at), [])
            if not cuts or cuts[-1] != until:  # a batch that another process planned
                f = places.Ranges(path)
                try:
                    cuts = whole_until(f, at, until - at, self.split, AHEAD)
                finally:
                    f.close()
            for cut in cuts:
                held.append((path, at, cut))
                size, at = size + cut - at, cut
                if size >= self.split:
                    found.append(_Stretches(held))
                    held, size = [], 0
        if held:
            found.append(_Stretches(held))
        self._cuts, self._behind = {}, self._reached
        self._plan(end)
        return found

    def read(self, partition: _Stretches) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path, begin, end in partition.of:
            f = places.Ranges(path)
            parser, at = klv.Parser(begin), begin
            try:
                while at < end:
                    data = f.read_at(min(4 << 20, end - at), at)
                    if not data:
                        raise ValueError(f"{path} has shrunk to {at} bytes")
                    at += len(data)
                    for key, offset, _, value in parser.push(data):
                        rows.append((path, key.hex(), klv.track_number(key), offset, len(value), value))
                        held += len(value)
                    if len(rows) >= 1000 or held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
            finally:
                f.close()
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


class GrowingPackets(DataSource):
    """Source ``growing_packets``: whole packets of the files under ``path`` (a file or a folder, to which files may be added).

    Options: ``bytesPerTrigger`` (of a batch, about; each file that it reaches gives a packet at least), ``splitBytes`` (for one task), ``progress`` (a file in which the
    end of the last batch is kept, since Spark doesn't tell a source where it stands: without it the first batch after a start takes all there is).
    """

    @classmethod
    def name(cls) -> str:
        return "growing_packets"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("bytesPerTrigger", BATCH)), int(self.options.get("splitBytes", SPLIT)), self.options.get("progress"))


def packets(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream of the packets of growing files; a batch is dealt to as many tasks as run at once, if they get ``LEAST`` bytes each."""
    spark.dataSource.register(GrowingPackets)
    split = max(LEAST, min(SPLIT, int(options.get("bytesPerTrigger", BATCH)) // spark.sparkContext.defaultParallelism))
    return spark.readStream.format("growing_packets").options(**{"path": path, "splitBytes": split, **options}).load()


@contextlib.contextmanager
def dealt_by_cores(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in as many partitions as tasks run at once, if the session has more: what a batch takes is bounded, and each partition costs a worker and a commit in each batch."""
    conf, name = spark.conf, "spark.sql.shuffle.partitions"
    before = conf.get(name)
    conf.set(name, min(int(before), spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        conf.set(name, before)


INDEX = "path string, position long, track_number long, stream_offset long, offset long, size long, value binary"


class _Index(StatefulProcessor):
    def init(self, handle) -> None:
        self._state = handle.getValueState("at", "first long, position long, stream long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows))  # a batch of one file, which bytesPerTrigger bounds
        own = own[own["track_number"].notna()].sort_values("offset")
        if own.empty:
            return
        first, position, stream = self._state.get() if self._state.exists() else (None, -1, 0)
        track, bytes_ = own["track_number"].astype("int64"), own["size"] + HEAD
        first = int(track.iloc[0]) if first is None else first
        at, end = (track == first).cumsum() + position, bytes_.cumsum() + stream
        out = {"path": key[0], "position": at, "track_number": track, "stream_offset": end - bytes_, "offset": own["offset"], "size": own["size"]}
        yield pd.DataFrame(out | ({"value": own["value"]} if "value" in own else {}))
        self._state.update((first, int(at.iloc[-1]), int(end.iloc[-1])))

    def close(self) -> None:
        pass


#: Bytes of an element's key and length.
HEAD = 21


def append_index(stream: DataFrame) -> DataFrame:
    """Elements with the ``position`` of their edit unit, which the first track's element begins, and their ``stream_offset``, numbered on from batch to batch.

    Elements are taken to have heads of ``HEAD`` bytes; other packets are left out.  A stream without ``value`` gives an index without it, and no payload is shuffled.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    own = [c for c in ("path", "track_number", "offset", "size", "value") if c in stream.columns]
    schema = INDEX if "value" in own else INDEX.removesuffix(", value binary")
    return stream.select(*own).groupBy("path").transformWithStateInPandas(_Index(), schema, "Append", "None")


class _Hold(StatefulProcessor):
    def __init__(self, tracks: int):
        self.tracks = tracks

    def init(self, handle) -> None:
        self._waiting = handle.getMapState("waiting", "position long, track_number long", "offset long, size long, value binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        touched = set()
        for r in rows:
            self._waiting.updateValue((r.position, r.track_number), (r.offset, r.size, r.value))
            touched.add(r.position)
        units: dict[int, list] = {}
        for (position, track), value in list(self._waiting.iterator()):
            if position in touched:
                units.setdefault(position, []).append((track, *value))
        for position in sorted(units):
            if len(units[position]) == self.tracks:
                for track, offset, size, value in sorted(units[position]):
                    yield Row(path=key[0], position=position, track_number=track, offset=offset, size=size, value=value)
                    self._waiting.removeKey((position, track))

    def close(self) -> None:
        pass


PACKAGE = "path string, position long, track_number long, offset long, size long, value binary"


def hold_packages(elements: DataFrame, tracks: int) -> DataFrame:
    """Elements (path, position, track_number, offset, size, value) of edit units that have all ``tracks``, once the last of them is there."""
    elements.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return elements.groupBy("path").transformWithState(_Hold(tracks), PACKAGE, "Append", "None")
