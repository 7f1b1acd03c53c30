"""Records out of bytes and into bytes: files, datagrams, and any reader or writer a program has."""

from __future__ import annotations

import socket
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import BinaryType, StringType, StructField, StructType


class ByteParser(Protocol):
    def parse(self, buffer: bytes) -> tuple[object, int] | None:
        """The first record of the buffer and how many bytes it takes; None if it isn't whole yet."""


class Lines:
    """Records of one line each."""

    def parse(self, buffer: bytes) -> tuple[object, int] | None:
        end = buffer.find(b"\n")
        return None if end < 0 else ({"line": buffer[:end].decode()}, end + 1)


def records(chunks: Iterable[bytes], parser: ByteParser) -> Iterator[object]:
    """Records of a stream of bytes, however these are cut into chunks; what is left at the end and no whole record fails."""
    buffer = b""
    for chunk in chunks:
        buffer += chunk
        while (got := parser.parse(buffer)) is not None:
            record, used = got
            if used <= 0:
                raise ValueError("a record takes no bytes")
            buffer = buffer[used:]
            yield record
    if buffer.strip():
        raise ValueError(f"{len(buffer)} bytes at the end are no record")


def reader(source, size: int = 1 << 16) -> Iterator[bytes]:
    """The chunks of anything with ``read`` (a file, a pipe) or ``recv`` (a connected socket)."""
    take = source.recv if hasattr(source, "recv") else source.read
    while chunk := take(size):
        yield chunk


def read_bytes(spark: SparkSession, path: str, parser: ByteParser, schema: str) -> DataFrame:
    """The records (mappings) of every file under a path, each with its ``path`` and ``place``; a file is parsed as a whole by one task."""
    kind = StructType.fromDDL(f"path string, place long, {schema}")
    names = kind.fieldNames()[2:]

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                found = list(records([content.as_py()], parser))
                rows = [{"path": path, "place": i, **{n: r.get(n) for n in names}} for i, r in enumerate(found)]
                if rows:
                    yield from pa.Table.from_pylist(rows, arrow).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, kind)


def write_bytes(rows: DataFrame, serialize: Callable[[dict], bytes], opened: Callable[[int], object]) -> None:
    """Every row as bytes to a writer per partition. opened: number of the partition -> something with ``write`` and ``close``.

    A task that runs again opens its writer again, so what it opens should be replaced, not added to.
    """

    def run(part: Iterable) -> None:
        from pyspark import TaskContext

        out = opened(TaskContext.get().partitionId())
        try:
            for row in part:
                out.write(serialize(row.asDict(recursive=True)))
        finally:
            out.close()

    rows.foreachPartition(run)


class Datagrams(DataSource):
    """A streaming source of datagrams: ``spark.readStream.format("datagrams")`` after ``spark.dataSource.register(Datagrams)``.

    Options: host, port, and senders, a comma list of addresses that are heard. Datagrams are
    received by the driver and kept until their batch is done; what arrives while no query
    runs is lost, as datagrams are.
    """

    @classmethod
    def name(cls) -> str:
        return "datagrams"

    def schema(self) -> StructType:
        return StructType([StructField("sender", StringType()), StructField("payload", BinaryType())])

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _DatagramReader(self.options)


class _DatagramReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        senders = options.get("senders")
        self.senders = None if senders is None else {s.strip() for s in senders.split(",")}
        self.address = options.get("host", "127.0.0.1"), int(options["port"])
        self.socket: socket.socket | None = None
        self.held: dict[int, tuple] = {}

    def initialOffset(self) -> dict:
        return {"at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at = start["at"]
        if self.socket is None:  # readers are also made where nothing is received
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.bind(self.address)
            self.socket.setblocking(False)
        while True:
            try:
                payload, (sender, _) = self.socket.recvfrom(1 << 16)
            except BlockingIOError:
                break
            if self.senders is None or sender in self.senders:
                self.held[at] = (sender, payload)
                at += 1
        end = {"at": at}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([self.held[k] for k in range(start["at"], end["at"]) if k in self.held])

    def commit(self, end: dict) -> None:
        self.held = {k: v for k, v in self.held.items() if k >= end["at"]}
