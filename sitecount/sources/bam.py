"""BAM as a Spark data source: ``spark.read.format("bam").load(path)`` gives reads.

A BAM file is a series of compressed blocks that name their own length. Partitions are byte ranges, and the driver reads no more than the header: a
partition looks for the first chain of valid blocks in its range, and in what these hold for the first chain of valid records; a record belongs to
the range that its block starts in. Where an index lies beside the file, a region reads only the ranges that the index names.
Paths are local ones that all executors see, or addresses that Arrow's file systems open (s3://, gs://, hdfs://). ``ord`` is the place in the file.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition, LessThan
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schema import READS, InputError

_SIZES = {"c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4, "A": 1, "d": 8}
_FORMATS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f", "d": "<d"}
#: Letters by the digits of packed sequences.
_LETTERS = str.maketrans("0123456789abcdef", "=ACMGRSVTWYHKDBN")
_MAGIC, _HEAD = b"\x1f\x8b\x08\x04", 32
#: Compressed bytes that are looked at for a block at once; records that have to follow each other validly; rows of an Arrow batch.
_AHEAD, _CHAIN, _ROWS = 1 << 17, 8, 2048
#: Bytes of records that are looked at for a chain.
_SPAN = 1 << 18


def open_file(path: str):
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        return system.open_input_file(at)
    return open(path.removeprefix("file://"), "rb")


def block_size(head: bytes) -> int | None:
    """The length of the block that starts with these bytes, or None if none does."""
    if len(head) < 18 or head[:4] != _MAGIC:
        return None
    extra, k = struct.unpack("<H", head[10:12])[0], 12
    while k + 4 <= 12 + extra:
        n = struct.unpack("<H", head[k + 2 : k + 4])[0] if len(head) >= k + 4 else 0
        if head[k : k + 2] == b"BC" and n == 2 and len(head) >= k + 6:
            return struct.unpack("<H", head[k + 4 : k + 6])[0] + 1
        k += 4 + n
    return None


def first_block(f, low: int, high: int) -> int | None:
    """The offset of the first block that starts in [low, high): one that another block, or the end of the file, follows."""
    at = low
    while at < high:
        f.seek(at)
        data = f.read(_AHEAD)
        k = data.find(_MAGIC)
        while 0 <= k and at + k < high:
            size = block_size(data[k : k + 64])
            if size is not None:
                f.seek(at + k + size)
                after = f.read(64)
                if not after or block_size(after) is not None:
                    return at + k
            k = data.find(_MAGIC, k + 1)
        if len(data) < _AHEAD:
            return None
        at += len(data) - 3  # a mark may lie across
    return None


def blocks(f) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of each compressed block from the file's place on."""
    while True:
        at = f.tell()
        head = f.read(18)
        if len(head) < 18:
            return
        if head[:4] != b"\x1f\x8b\x08\x04":
            raise InputError("not a block-compressed file")
        extra = struct.unpack("<H", head[10:12])[0]
        fields = head[12:18] + f.read(extra - 6)
        size, k = None, 0
        while k + 4 <= len(fields):
            n = struct.unpack("<H", fields[k + 2 : k + 4])[0]
            if fields[k : k + 2] == b"BC":
                size = struct.unpack("<H", fields[k + 4 : k + 6])[0]
            k += 4 + n
        if size is None:
            raise InputError("a block without its size")
        body = f.read(size - extra - 19)
        f.read(8)
        data = zlib.decompress(body, -15)
        if data:
            yield at, data


def plausible(data: bytes, k: int, contigs: list[tuple[str, int]]) -> int | None:
    """The end of the record at k, by its own length, if what is there of its fields agrees with each other; else None."""
    if k + 4 + _HEAD > len(data):
        return None
    size, tid, pos, n_name, _, _, n_cigar, _, n_seq, mtid, mpos = struct.unpack("<iiiBBHHHiii", data[k : k + 32])
    if not (-1 <= tid < len(contigs) and -1 <= mtid < len(contigs) and pos >= -1 and mpos >= -1 and n_seq >= 0 and n_name >= 2):
        return None
    if tid >= 0 and pos > contigs[tid][1] or size < _HEAD + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq:
        return None
    name = data[k + 4 + _HEAD : k + 4 + _HEAD + n_name]
    if len(name) == n_name and (name[-1] or not all(33 <= c < 127 for c in name[:-1])):
        return None
    at = k + 4 + _HEAD + n_name
    if any(op & 15 > 8 for op in data[at : at + 4 * n_cigar : 4]):  # the low byte of each operation
        return None
    return k + 4 + size


def chained(data: bytes, k: int, contigs: list[tuple[str, int]], ended: bool) -> bool:
    """Whether records follow each other from k on, as far as the bytes go. ``ended``: the file ends with these."""
    for _ in range(_CHAIN):
        if k == len(data) and ended:
            return True
        end = plausible(data, k, contigs)
        if end is None or end > len(data):
            return end is not None and not ended
        k = end
    return True


class Stream:
    """Bytes across blocks, with the block that the next byte is in."""

    def __init__(self, f, skip: int = 0):
        self.blocks, self.data, self.at, self.offset = blocks(f), b"", 0, f.tell()
        if skip:
            self.read(skip)

    def place(self) -> tuple[int, int] | None:
        """(offset of the block, place in it) of the next byte, or None at the end."""
        while self.at >= len(self.data):
            got = next(self.blocks, None)
            if got is None:
                return None
            (self.offset, self.data), self.at = got, 0
        return self.offset, self.at

    def read(self, n: int) -> bytes:
        out = []
        while n > 0:
            if self.place() is None:
                raise InputError("the file ends within a record")
            piece = self.data[self.at : self.at + n]
            self.at += len(piece)
            n -= len(piece)
            out.append(piece)
        return b"".join(out)


def read_header(stream: Stream) -> list[tuple[str, int]]:
    if stream.read(4) != b"BAM\1":
        raise InputError("not a BAM file")
    stream.read(struct.unpack("<i", stream.read(4))[0])
    out = []
    for _ in range(struct.unpack("<i", stream.read(4))[0]):
        name = stream.read(struct.unpack("<i", stream.read(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", stream.read(4))[0]))
    return out


def tags_of(data: bytes) -> dict:
    """Tags by name, the first of a name; an array is of type B and keeps its text."""
    out, k = {}, 0
    while k + 3 <= len(data):
        name, kind = data[k : k + 2].decode(), chr(data[k + 2])
        k += 3
        if kind in "ZH":
            end = data.index(0, k)
            value = ("s", None, None, data[k:end].decode())
            k = end + 1
        elif kind == "B":
            of, n = chr(data[k]), struct.unpack("<i", data[k + 1 : k + 5])[0]
            k += 5
            numbers = struct.unpack(f"<{n}{_FORMATS[of][1]}", data[k : k + _SIZES[of] * n])
            value = ("B", None, None, ",".join([of, *(f"{x:g}" if of == "f" else str(x) for x in numbers)]))
            k += _SIZES[of] * n
        elif kind == "A":
            value = ("i", data[k], None, None)
            k += 1
        else:
            number = struct.unpack(_FORMATS[kind], data[k : k + _SIZES[kind]])[0]
            value = ("f", None, float(number), None) if kind in "fd" else ("i", number, None, None)
            k += _SIZES[kind]
        out.setdefault(name, value)
    return out


def record(data: bytes, order: int, contigs: list[tuple[str, int]]) -> tuple:
    tid, pos, n_name, mapq, _, n_cigar, flag, n_seq, mtid, mpos, tlen = struct.unpack("<iiBBHHHiiii", data[:32])
    k = 32
    qname = data[k : k + n_name - 1].decode()
    k += n_name
    cigar = [(x & 15, x >> 4) for x in struct.unpack(f"<{n_cigar}I", data[k : k + 4 * n_cigar])]
    k += 4 * n_cigar
    packed = data[k : k + (n_seq + 1) // 2]
    k += len(packed)
    seq = packed.hex().translate(_LETTERS)[:n_seq] or "*"
    qual = data[k : k + n_seq]
    name = lambda t: contigs[t][0] if 0 <= t < len(contigs) else None
    return (order, qname, flag, tid, name(tid), pos, mapq, cigar, mtid, name(mtid) or "", mpos, tlen, seq, None if not qual or qual[0] == 255 else list(qual), list(tags_of(data[k + n_seq :]).items()))


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    schema = to_arrow_schema(READS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def indexed_range(data: bytes, tid: int, start: int) -> tuple[int, int] | None:
    """(first, last) virtual offsets that hold the reads of a contig that reach beyond ``start``, by an index's bins and its table of first reads; None for none."""
    k = 8
    for n in range(struct.unpack("<i", data[4:8])[0]):
        last, bins = 0, struct.unpack("<i", data[k : k + 4])[0]
        k += 4
        for _ in range(bins):
            number, chunks = struct.unpack("<Ii", data[k : k + 8])
            k += 8
            if number < 37450:  # the one above holds counts
                last = max([last, *struct.unpack(f"<{2 * chunks}Q", data[k : k + 16 * chunks])[1::2]])
            k += 16 * chunks
        many = struct.unpack("<i", data[k : k + 4])[0]
        k += 4
        if n == tid:
            first = [x for x in struct.unpack(f"<{many}Q", data[k : k + 8 * many])[start >> 14 :] if x]
            return (first[0], last) if first and last else None
        k += 8 * many
    return None


class _Part(InputPartition):
    """Records that start in blocks of [low, high); ``skip`` is where the first one starts in the block at ``low``, if that is known."""

    def __init__(self, low: int, high: int, skip: int | None):
        self.low, self.high, self.skip = low, high, skip


class BamReader(DataSourceReader):
    def __init__(self, path: str, step: int, region: tuple[str, int, int] | None):
        self.path, self.step, self.region = path, step, region
        self.contig, self.low, self.high = None, None, None
        with open_file(path) as f:
            stream = Stream(f)
            self.contigs = read_header(stream)
            self.begin = stream.place()
            self.end = f.seek(0, os.SEEK_END) or f.tell()
        self.sorted = False
        if region is not None and self.begin is not None and (index := self._index()) is not None:
            names = [c for c, _ in self.contigs]
            found = indexed_range(index, names.index(region[0]), region[1]) if region[0] in names else None
            self.sorted = True
            self.begin = None if found is None else (found[0] >> 16, found[0] & 0xFFFF)
            self.end = 0 if found is None else (found[1] >> 16) + 1

    def _index(self) -> bytes | None:
        for path in (f"{self.path}.bai", f"{self.path.removesuffix('.bam')}.bai"):
            try:
                with open_file(path) as f:
                    data = f.read()
            except OSError:
                continue
            if data[:4] == b"BAI\1":
                return data
        return None

    def pushFilters(self, filters):
        """Keeps contig and position bounds to skip records early; Spark tests them again."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if isinstance(f, EqualTo) and name == "contig":
                self.contig = f.value
            elif isinstance(f, GreaterThanOrEqual) and name == "pos":
                self.low = f.value
            elif isinstance(f, LessThan) and name == "pos":
                self.high = f.value
            yield f

    def partitions(self):
        if self.begin is None:
            return [_Part(0, 0, None)]
        low, skip = self.begin
        edges = [*range(low, self.end, self.step), self.end]
        return [_Part(a, b, skip if a == low else None) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def _start(self, f, part: _Part) -> tuple[int, int] | None:
        """(offset of a block, place in it) of the first record of a range."""
        if part.skip is not None:
            return part.low, part.skip
        offset = first_block(f, part.low, part.high)
        if offset is None:
            return None
        f.seek(offset)
        data, starts, found, k, ended = b"", [], blocks(f), 0, False
        while True:
            # enough for a chain from any place that is tried; a record longer than that is told by its own fields
            while not ended and len(data) < k + _SPAN:
                got = next(found, None)
                ended = got is None
                if not ended:
                    starts.append((len(data), got[0]))
                    data += got[1]
            limit = next((at for at, block in starts if block >= part.high), None)
            for k in range(k, min(len(data) if limit is None else limit, k + _SPAN // 2)):
                if chained(data, k, self.contigs, ended):
                    at, block = max(x for x in starts if x[0] <= k)
                    return block, k - at
            k += 1
            if k >= len(data) or limit is not None and k >= limit:
                return None

    def read(self, partition):
        if partition.high <= partition.low:
            return
        names = [c for c, _ in self.contigs]
        with open_file(self.path) as f:
            start = self._start(f, partition)
            if start is None:
                return
            f.seek(start[0])
            stream, rows = Stream(f, start[1]), []
            while (place := stream.place()) is not None and place[0] < partition.high:
                data = stream.read(struct.unpack("<i", stream.read(4))[0])
                tid, pos = struct.unpack("<ii", data[:8])
                name = names[tid] if 0 <= tid < len(names) else None
                if self.sorted and (name != self.region[0] or pos >= self.region[2]):
                    break  # reads are in order, and all that follow lie beyond the region
                if self.contig is not None and name != self.contig or self.low is not None and pos < self.low or self.high is not None and pos >= self.high:
                    continue
                rows.append(record(data, place[0] << 16 | place[1], self.contigs))
                if len(rows) == _ROWS:
                    yield as_batch(rows)
                    rows = []
            if rows:
                yield as_batch(rows)


class BamSource(DataSource):
    """Options: ``path``, ``step``, compressed bytes of a partition, and ``contig``, ``start`` and ``end`` of a region to look up in an index."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> StructType:
        return READS

    def reader(self, schema: StructType) -> BamReader:
        o = self.options
        region = (o["contig"], int(o["start"]), int(o["end"])) if "contig" in o else None
        return BamReader(o["path"], int(o.get("step", 32 << 20)), region)


def read_bam(spark: SparkSession, path: str, step: int = 32 << 20, region: tuple[str, int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(reads, contigs) of a BAM file; with a region and an index, at least the reads that touch the region."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # Spark refuses readers that take filters without it
    spark.dataSource.register(BamSource)
    with open_file(path) as f:
        contigs = read_header(Stream(f))
    rows = [(k, name, length) for k, (name, length) in enumerate(contigs)]
    source = spark.read.format("bam").option("step", step)
    if region is not None:
        source = source.option("contig", region[0]).option("start", region[1]).option("end", region[2])
    return source.load(path), spark.createDataFrame(rows, "tid int, contig string, length long")
