"""Chat exports as a partitioned source: one huge JSON document is cut at the starts of its messages and read by many tasks.

`spark.read.format("chat_export")` gives (chat, id, type, sender, date, text, start) after `register`. A message of an export
starts with its id and its type; within a JSON string quotes are escaped, so these characters can't be part of a text.
Each task reads the messages that start in its range of bytes, and on to the end of the last one; a range in which none
starts gives no row, so a document that is written otherwise is read by its first task alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as X

#: Bytes of a range; bytes read at once beyond it, and before it, so that a start across its edge is found.
RANGE, AHEAD, BEHIND = 64 << 20, 1 << 20, 256
START = re.compile(rb'\{\s{0,64}"id"\s{0,8}:\s{0,8}-?\d{1,20}\s{0,8},\s{0,64}"type"\s{0,8}:')
LIST = re.compile(rb'"messages"\s*:\s*\[')
SCHEMA = "chat string, id long, type string, sender string, date string, text string, start long"


def opened(path: str):
    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, name


def sizes(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file, or of all files below a folder."""
    system, name = opened(path)
    info = system.get_file_info(name)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, size: int):
        self.path, self.start, self.end, self.size = path, start, end, size


def messages_in(handle, part: Range) -> Iterator[tuple[int, dict]]:
    """(start, message) of what starts in a range. Holds the range, and beyond it what its last message needs."""
    first = max(0, part.start - BEHIND) if part.start else 0
    handle.seek(first)
    data = handle.read(part.end - first + BEHIND)
    starts = [m.start() + first for m in START.finditer(data) if part.start <= m.start() + first < part.end]
    if part.start == 0 and not starts:
        handle.seek(0)
        data = handle.read(part.size)
        if not any(START.finditer(data)):  # written otherwise: the whole document
            listed = LIST.search(data)
            for m in json.loads(data)["messages"] if listed else []:
                yield -1, m
        return
    decoder = json.JSONDecoder()
    done = -1
    for i, at in enumerate(starts):
        if at < done:  # within the message before
            continue
        end = starts[i + 1] if i + 1 < len(starts) else None
        while True:
            piece = data[at - first : None if end is None else end - first]
            try:
                value, length = decoder.raw_decode(piece.decode("utf-8", "ignore"))
                done = at + len(piece.decode("utf-8", "ignore")[:length].encode())
                yield at, value
                break
            except json.JSONDecodeError:
                if end is not None:  # a nested object started alike
                    later = [s for s in starts if s > end]
                    end = later[0] if later else None
                    continue
                handle.seek(first + len(data))
                more = handle.read(max(AHEAD, len(data) - (at - first)))
                if not more:
                    raise
                data += more


class ExportReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> Sequence[InputPartition]:
        return [Range(f, at, min(at + self.size, n), n) for f, n in sizes(self.path) for at in range(0, max(n, 1), self.size)]

    def read(self, part: Range) -> Iterator[tuple]:
        with opened(self.path)[0].open_input_file(part.path) as handle:
            for start, m in messages_in(handle, part):
                yield part.path, m.get("id"), m.get("type"), m.get("from") or m.get("from_id") or "", m.get("date"), json.dumps(m["text"], ensure_ascii=False) if isinstance(m.get("text"), list) else m.get("text") or "", start


class ChatExport(DataSource):
    """Options: path, a file or folder; rangeBytes, the bytes of a range."""

    @classmethod
    def name(cls) -> str:
        return "chat_export"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ExportReader(self.options["path"], int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE))))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChatExport)


def messages(spark: SparkSession, path: str, separator: str = " ", range_bytes: int = RANGE) -> DataFrame:
    """(chat, id, sender, ts, text) as `chat.messages` gives them, but for id, which is the message's place in the file; for
    documents in which messages don't start as an export writes them, its number."""
    register(spark)
    raw = spark.read.format("chat_export").option("rangeBytes", str(range_bytes)).load(path)
    rows = raw.where("type = 'message'").select("chat", F.when(F.col("start") >= 0, F.col("start")).otherwise(F.col("id")).alias("id"), "sender", X.epoch(F.col("date")).alias("ts"), X.message_text(F.col("text"), separator).alias("text"))
    return rows.where("text <> ''")
