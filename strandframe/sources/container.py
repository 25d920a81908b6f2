"""A Python data source for framed container files: one file is one stream of frames, one frame a row.

Layout of a file: eight bytes of magic; frames of route (uint8), source length, payload length (uint32), SHA-256 of the
source, payload; a last frame of route 255 whose digest is that of the whole stream. Numbers are little-endian.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MAGIC, END = b"STRANDF1", 255
_HEAD = struct.Struct("<BII32s")
SCHEMA = "path string, number long, route int, source_len int, payload_len int, digest binary, payload binary, ok boolean"


def packed(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a container of stored blocks."""
    whole, size = hashlib.sha256(), 0
    yield MAGIC
    for block in blocks:
        whole.update(block)
        size += len(block)
        yield _HEAD.pack(0, len(block), len(block), hashlib.sha256(block).digest()) + block
    yield _HEAD.pack(END, 0, 0, whole.digest())


def unpacked(read) -> Iterator[tuple]:
    """(number, route, source_len, payload_len, digest, payload, ok) of each frame; a file cut short ends with a frame that isn't ok."""
    whole, number = hashlib.sha256(), 0
    if read(len(MAGIC)) != MAGIC:
        raise ValueError("not a container")
    while True:
        head = read(_HEAD.size)
        if len(head) < _HEAD.size:
            yield number, -1, 0, 0, b"", b"", False
            return
        route, source, length, digest = _HEAD.unpack(head)
        if route == END:
            yield number, route, source, length, digest, b"", digest == whole.digest()
            return
        payload = read(length)
        whole.update(payload)
        yield number, route, source, length, digest, payload, len(payload) == length and hashlib.sha256(payload).digest() == digest
        number += 1


class ContainerSource(DataSource):
    """spark.read.format("container").load(folder), df.write.format("container").save(folder): folders of local or mounted files."""

    @classmethod
    def name(cls) -> str:
        return "container"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema.fieldNames().index(self.options.get("column", "payload")))


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.path):
            return [InputPartition(self.path)]
        return [InputPartition(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith(".frames")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            for frame in unpacked(f.read):
                yield (partition.value, *frame)


class _Done(WriterCommitMessage):
    def __init__(self, temporary: str, final: str):
        self.temporary, self.final = temporary, final


class _Writer(DataSourceWriter):
    def __init__(self, path: str, column: int):
        self.path, self.column = path, column

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        final = os.path.join(self.path, f"part-{context.partitionId():05d}.frames")
        temporary = f"{final}.{context.taskAttemptId()}.tmp"
        with open(temporary, "wb") as f:
            for part in packed(bytes(row[self.column]) for row in iterator):
                f.write(part)
        return _Done(temporary, final)

    def commit(self, messages) -> None:
        for m in messages:
            if m is not None:
                os.replace(m.temporary, m.final)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.temporary):
                os.remove(m.temporary)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ContainerSource)
