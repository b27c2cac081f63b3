"""Sorted, indexed BAM files: executors sort, encode and compress; the driver only joins the blocks in order and notes where reads begin.

Reads are dealt by ranges of contig and position, so no task holds more than its range and the file is never held as a whole.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import InputError

#: Bytes of a block before it is compressed.
BLOCK = 0xFF00
# The block that ends a file, the digits of letters, and the number of the bin that holds counts.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
DIGITS = {c: k for k, c in enumerate("=ACMGRSVTWYHKDBN")}
_WINDOW = 14
_FORMATS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_SCHEMA = "data binary, tid array<int>, first array<int>, last array<int>, at array<int>"


def compressed(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def bin_of(first: int, end: int) -> int:
    """The smallest bin that holds [first, end): six levels, each of eighths of the one above."""
    last = end - 1
    for level in range(5, 0, -1):
        shift = _WINDOW + 3 * (5 - level)
        if first >> shift == last >> shift:
            return ((1 << 3 * level) - 1) // 7 + (first >> shift)
    return 0


def encoded_tag(name: str, tag: dict) -> bytes:
    kind, head = tag["t"], name.encode()
    if kind == "i":
        return head + (struct.pack("<ci", b"i", tag["i"]) if -(1 << 31) <= tag["i"] < 1 << 31 else struct.pack("<cI", b"I", tag["i"] & 0xFFFFFFFF))
    if kind == "f":
        return head + struct.pack("<cf", b"f", tag["f"])
    if kind == "B":
        of, *values = tag["s"].split(",")
        number = float if of == "f" else int
        return head + b"B" + of.encode() + struct.pack(f"<i{len(values)}{_FORMATS[of]}", len(values), *map(number, values))
    return head + b"Z" + (tag["s"] or "").encode() + b"\0"


def encoded(r: dict) -> tuple[bytes, int]:
    """A read's record, with its length before it, and where it ends on the reference."""
    seq, name = "" if r["seq"] in (None, "*") else r["seq"], (r["qname"] or "*").encode()
    cigar, qual = r["cigar"] or [], r["qual"]
    end = r["pos"] + max(1, sum(c["len"] for c in cigar if c["op"] in (0, 2, 3, 7, 8)))
    digits = [DIGITS.get(c, 15) for c in seq.upper()] + [0]
    body = struct.pack("<iiBBHHHiiii", r["tid"], r["pos"], len(name) + 1, r["mapq"], bin_of(max(r["pos"], 0), max(end, 1)), len(cigar), r["flag"], len(seq), r["mtid"], r["mpos"], r["tlen"])
    body += name + b"\0" + b"".join(struct.pack("<I", c["len"] << 4 | c["op"]) for c in cigar)
    body += bytes(digits[k] << 4 | digits[k + 1] for k in range(0, len(seq), 2)) + (bytes(qual) if qual and len(qual) == len(seq) else b"\xff" * len(seq))
    body += b"".join(encoded_tag(k, v) for k, v in r["tags"] or ())
    return struct.pack("<i", len(body)) + body, end


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed blocks, each with the reads that begin in it. A read begins a new block if it doesn't fit; one longer than a block fills several."""
    schema = pa.schema([("data", pa.binary()), *((n, pa.list_(pa.int32())) for n in ("tid", "first", "last", "at"))])
    data, marks = b"", []

    def made(piece: bytes, found: list) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array([compressed(piece)], pa.binary()), *(pa.array([list(c)], pa.list_(pa.int32())) for c in columns)], schema=schema)

    for batch in batches:
        for r in batch.to_pylist():
            one, end = encoded(r)
            if data and len(data) + len(one) > BLOCK:
                yield made(data, marks)
                data, marks = b"", []
            marks.append((r["tid"], r["pos"], end, len(data)))
            data += one
            while len(data) > BLOCK:
                yield made(data[:BLOCK], marks)
                data, marks = data[BLOCK:], []
    if data:
        yield made(data, marks)


class Index:
    """Bins and windows of reads that come in order."""

    def __init__(self, contigs: int):
        self.bins: list[dict] = [defaultdict(list) for _ in range(contigs)]
        self.windows: list[list[int]] = [[] for _ in range(contigs)]
        self.loose = 0

    def add(self, tid: int, first: int, end: int, start: int, stop: int) -> None:
        if tid < 0:
            self.loose += 1
            return
        chunks = self.bins[tid][bin_of(first, end)]
        if chunks and chunks[-1][1] >> 16 == start >> 16:
            chunks[-1][1] = stop
        else:
            chunks.append([start, stop])
        own = self.windows[tid]
        for w in range(first >> _WINDOW, (end - 1 >> _WINDOW) + 1):
            own += [0] * (w + 1 - len(own))
            own[w] = own[w] or start

    def bytes(self) -> bytes:
        out = [b"BAI\1", struct.pack("<i", len(self.bins))]
        for bins, windows in zip(self.bins, self.windows, strict=True):
            out.append(struct.pack("<i", len(bins)))
            for number, chunks in sorted(bins.items()):
                out.append(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            known = 0
            for k, w in enumerate(windows):  # a window without a first read takes the one before
                known = windows[k] = w or known
            out.append(struct.pack(f"<i{len(windows)}Q", len(windows), *windows))
        return b"".join(out) + struct.pack("<Q", self.loose)


def header_text(contigs: list[tuple[str, int]]) -> list[str]:
    return ["@HD\tVN:1.6\tSO:coordinate", *(f"@SQ\tSN:{name}\tLN:{length}" for name, length in contigs)]


def write_bam(reads: DataFrame, contigs: DataFrame, path: str) -> int:
    """Write reads in contig and position order, those without a place last, and ``path``.bai. Returns how many reads there are."""
    if "://" in path:
        raise InputError(f"{path}: a BAM file is written to a local path")
    names = [(r.contig, r.length) for r in contigs.orderBy("tid").collect()]  # as many as the header has contigs
    text = ("\n".join(header_text(names)) + "\n").encode()
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(names))
    head += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", length) for n, length in names)
    loose = F.col("tid") < 0
    ordered = reads.repartitionByRange(loose, "tid", "pos", "ord").sortWithinPartitions(loose, "tid", "pos", "ord")
    plain = ordered.select("qname", "flag", "tid", "pos", "mapq", "cigar", "mtid", "mpos", "tlen", "seq", "qual", "tags")
    index, n, last = Index(len(names)), 0, None
    with open(path, "wb") as f:
        for k in range(0, len(head), BLOCK):
            f.write(compressed(head[k : k + BLOCK]))
        for block in plain.mapInArrow(_blocks, _SCHEMA).toLocalIterator(prefetchPartitions=True):
            here = f.tell()
            for tid, first, end, at in zip(block.tid, block.first, block.last, block["at"], strict=True):
                if last is not None:
                    index.add(*last, here << 16 | at)
                last, n = (tid, first, end, here << 16 | at), n + 1
            f.write(bytes(block.data))
        if last is not None:
            index.add(*last, f.tell() << 16)
        f.write(END)
    with open(f"{path}.bai", "wb") as f:
        f.write(index.bytes())
    return n
