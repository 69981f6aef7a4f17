"""Growing files as a stream, and what is kept while frames come in.

The offset of the ``growing_klv`` source is the end of the last whole packet, so a packet half written is read again once
it is complete, and a restart goes on where the last committed batch ended.  Retries and pace are those of the trigger.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..sources.klv import Parser

#: Bytes read for one batch at most by default.
BATCH_BYTES = 16 << 20


class _Tail(SimpleDataSourceStreamReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def initialOffset(self) -> dict:
        return {"position": 0}

    def _packets(self, start: int, end: int | None) -> tuple[list[tuple], int]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return [], start
        with system.open_input_file(path) as f:
            f.seek(start)
            data = f.read(self.most if end is None else end - start)
            parser = Parser(start)
            rows = [(k.hex(), offset, len(v), v) for k, offset, _, v in parser.push(data)]
            while not rows and end is None and len(data) >= self.most:  # a packet larger than a batch
                more = f.read(self.most)
                if not more:
                    break
                rows = [(k.hex(), offset, len(v), v) for k, offset, _, v in parser.push(more)]
        return rows, parser.position

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, position = self._packets(start["position"], None)
        return iter(rows), {"position": position}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._packets(start["position"], end["position"])[0])

    def commit(self, end: dict) -> None:
        pass


class GrowingKlv(DataSource):
    """Source ``growing_klv``: whole packets of a file that is still being written."""

    @classmethod
    def name(cls) -> str:
        return "growing_klv"

    def schema(self):
        return "key string, offset long, size long, value binary"

    def simpleStreamReader(self, schema):
        return _Tail(self.options["path"], int(self.options.get("batchBytes", BATCH_BYTES)))


def crc_counters(frames: DataFrame, key: str, track: str) -> DataFrame:
    """Running CRC counts of each track, as a batch or a stream in update or complete mode."""
    from ..operators.integrity import crc_check

    return crc_check(frames, key, track)


def join_package(video: DataFrame, audio: DataFrame, key: str, delay: str = "10 seconds") -> DataFrame:
    """Frames of two streams (ts, position) that make one content package; what waits longer than ``delay`` is let go."""
    a = video.withWatermark("ts", delay).alias("a")
    b = audio.withWatermark("ts", delay).alias("b")
    near = F.col("b.ts").between(F.col("a.ts") - F.expr(f"interval {delay}"), F.col("a.ts") + F.expr(f"interval {delay}"))
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.position") == F.col("b.position")) & near)


def pace(frames: int, num: int, den: int, factor: float = 1.0) -> str:
    """Trigger interval at which batches of ``frames`` come at ``factor`` times real time, for ``trigger(processingTime=...)``."""
    if min(frames, num, den) <= 0 or factor <= 0:
        raise ValueError("frames, rate and factor must be above 0")
    return f"{max(1, round(1000 * frames * den / (num * factor)))} milliseconds"
