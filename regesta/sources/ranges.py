"""CSV files read by ranges of bytes: a file of any size is many tasks, also where fields hold line ends."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a range: a task reads one, and the end of its last record.
RANGE_BYTES = 32 * 1024 * 1024
_STEP = 1 << 20


def files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(address, bytes) of the files that a path, a folder or a pattern names; hidden ones are left out."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for status in fs.globStatus(at) or []:
        inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [(s.getPath().toString(), s.getLen()) for s in inside if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    return sorted(found)


def _open(address: str):
    """The file for reading at any place; its file system is chosen by its address."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(address if "://" in address else address.replace("file:", "file://", 1) if address.startswith("file:") else address)
    return system.open_input_file(at)


def record_end(read, start: int, quoted: bool) -> int | None:
    """The place after the first line end at or after start that is in no quoted field; None where the file ends first. read(at, n) gives bytes."""
    while part := read(start, _STEP):
        at = 0
        while True:
            quote = part.find(b'"', at)
            end = -1 if quoted else part.find(b"\n", at, quote if quote >= 0 else len(part))
            if end >= 0:
                return start + end + 1
            if quote < 0:
                break
            quoted, at = not quoted, quote + 1
        start += len(part)
    return None


def _text_end(read, start: int, quoted: bool, size: int) -> int:
    """The end of the record that the place before start belongs to: start itself where a record begins there."""
    if start == 0 or start >= size:
        return min(start, size)
    if not quoted and read(start - 1, 1) == b"\n":
        return start
    return record_end(read, start, quoted) or size


def read_ranges(spark: SparkSession, path: str, columns: tuple[str, ...], delimiter: str = ",", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of CSV files with a header: the columns by name as text, fichier, and octet, the byte after the record.

    Quoted fields, doubled quotes, line ends in fields, CR LF, a byte-order mark and a last line without end are read; columns that a file lacks, and fields that a row
    lacks, are ''. Empty lines are no records.

    Two passes over ranges of bytes. The first counts quotes, so that it is known of each range whether it begins inside a quoted field (a number for each
    range comes to the driver). In the second each range reads the records that begin in it. A file without rows gives none; no file, no rows.
    """
    ranges = [(address, size, at, min(range_bytes, size - at)) for address, size in files(spark, path) for at in range(0, size, range_bytes)]
    schema = "fichier string, taille long, debut long, octets long"
    given = spark.createDataFrame(ranges, schema).repartition(max(1, min(len(ranges), 10_000)), "fichier", "debut")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            quotes = []
            for address, at, n in zip(b["fichier"], b["debut"], b["octets"], strict=True):
                with _open(address) as f:
                    f.seek(at)
                    quotes.append(sum(f.read(min(_STEP, n - i)).count(b'"') for i in range(0, n, _STEP)))
            yield b[["fichier", "debut"]].assign(guillemets=quotes)

    counted = {(r.fichier, r.debut): r.guillemets for r in given.mapInPandas(count, "fichier string, debut long, guillemets long").toLocalIterator()}
    placed, quoted = [], False
    for address, size, at, n in ranges:
        quoted = quoted if at else False
        placed.append((address, size, at, n, quoted))
        quoted ^= counted[address, at] % 2 == 1
    # whether the next range of a file begins inside a field
    after = {(a, at): q for a, _, at, _, q in placed}
    rows = spark.createDataFrame([(*r, after.get((r[0], r[2] + r[3]), False)) for r in placed], schema + ", dedans boolean, suite boolean").repartition(max(1, min(len(ranges), 10_000)), "fichier", "debut")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for address, size, at, n, inside, follows in b.itertuples(index=False):
                with _open(address) as f:

                    def read(start: int, length: int, f=f) -> bytes:
                        f.seek(start)
                        return f.read(length)

                    head_end = record_end(read, 0, False) or size
                    header = next(csv.reader(io.StringIO(read(0, head_end).decode("utf-8-sig"), newline=""), delimiter=delimiter), [])
                    first, last = max(_text_end(read, at, inside, size), head_end), _text_end(read, at + n, follows, size)
                    if first >= last:
                        continue
                    chosen = [header.index(c) if c in header else -1 for c in columns]
                    out, place = [], first
                    for text in _records(read(first, last - first)):
                        place += len(text)
                        fields = next(csv.reader(io.StringIO(text.decode("utf-8", "replace"), newline=""), delimiter=delimiter), [])
                        if fields:
                            out.append([*(fields[i] if 0 <= i < len(fields) else "" for i in chosen), address, place])
                        if len(out) == 10_000:
                            yield pd.DataFrame(out, columns=[*columns, "fichier", "octet"])
                            out = []
                    yield pd.DataFrame(out, columns=[*columns, "fichier", "octet"])

    return rows.mapInPandas(parse, ", ".join(f"`{c}` string" for c in columns) + ", fichier string, octet long")


def _records(data: bytes) -> Iterator[bytes]:
    """The records of whole records' bytes, each with its line end."""
    start = at = 0
    while start < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end + 1
        # a line end after an odd number of quotes is inside a field
        if data.count(b'"', start, end) % 2 and end < len(data):
            at = end
            continue
        yield data[start:end]
        start = at = end
