"""A streaming data source of replication frames, for spark.readStream.format("tidemark_frames").

The folder holds frame files: for each frame a length and a JSON object with the fields of
pgoutput.FRAMES, the payload in hex. Offsets are frame positions. commit() writes the
position up to which all is stored to the folder's `acknowledged` file: what a live
connection would confirm upstream.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .pgoutput import FIELDS, FRAMES


def write_frames(path: str, name: str, frames: list[tuple]) -> None:
    """Frames as one file, visible once complete; without frames there is none."""
    os.makedirs(path, exist_ok=True)
    if not frames:
        return
    tmp = f"{path}/.{name}"
    with open(tmp, "wb") as f:
        for frame in frames:
            x = dict(zip(FIELDS, frame))
            x["payload"] = None if x["payload"] is None else bytes(x["payload"]).hex()
            raw = json.dumps(x).encode()
            f.write(struct.pack(">Q", len(raw)) + raw)
    first, last = frames[0][1], frames[-1][1]
    os.rename(tmp, f"{path}/{first:020d}-{last:020d}-{name}.frames")


def read_file(path: str) -> Iterator[dict]:
    with open(path, "rb") as f:
        while head := f.read(8):
            raw = f.read(struct.unpack(">Q", head)[0])
            yield json.loads(raw)


def _ranges(path: str) -> list[tuple[int, int, str]]:
    names = sorted(n for n in os.listdir(path) if n.endswith(".frames"))
    return [(int(n[:20]), int(n[21:41]), f"{path}/{n}") for n in names]


class FilePart(InputPartition):
    def __init__(self, file: str, begin: int, end: int):
        self.file, self.begin, self.end = file, begin, end


class FrameReader(DataSourceStreamReader):
    """frames_per_batch bounds what a micro-batch takes, a file's frames at least: 0 takes all."""

    def __init__(self, path: str, frames_per_batch: int = 0):
        self.path, self.most, self.next = path, frames_per_batch, 0
        if os.path.exists(f"{path}/.planned"):
            with open(f"{path}/.planned") as f:
                self.next = int(f.read())

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        ends = [last + 1 for _, last, _ in _ranges(self.path) if last >= self.next]
        if not ends:
            return {"next": self.next}
        within = [end for end in ends if not self.most or end - self.next <= self.most]
        return {"next": within[-1] if within else ends[0]}

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        # What was asked for is where the next batch begins, also after a restart: no offset goes back.
        if self.most and end["next"] > self.next:
            self.next = end["next"]
            self._write(".planned", self.next)
        return [FilePart(f, start["next"], end["next"]) for first, last, f in _ranges(self.path) if first < end["next"] and last >= start["next"]]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        for x in read_file(partition.file):
            if partition.begin <= x["pos"] < partition.end:
                x["payload"] = None if x["payload"] is None else bytes.fromhex(x["payload"])
                yield tuple(x[k] for k in FIELDS)

    def commit(self, end: dict) -> None:
        self._write("acknowledged", end["next"])

    def _write(self, name: str, position: int) -> None:
        tmp = f"{self.path}/.{name}.tmp"
        with open(tmp, "w") as f:
            f.write(str(position))
        os.replace(tmp, f"{self.path}/{name}")


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_frames"

    def schema(self) -> str:
        return FRAMES

    def streamReader(self, schema) -> FrameReader:
        return FrameReader(self.options["path"], int(self.options.get("framesPerBatch", 0)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)
