"""Small alignment files: rows as SAM text and as BAM, and a reference."""

import struct
import zlib

QUAL = {40: "I", 10: "+"}


def sam(path, contigs, reads):
    """reads: (qname, flag, contig, pos from 0, mapq, cigar, seq, quality, tags, mate pos, tlen)."""
    lines = ["@HD\tVN:1.6\tSO:coordinate", *(f"@SQ\tSN:{n}\tLN:{length}" for n, length in contigs)]
    for q, flag, contig, pos, mapq, cigar, seq, quality, tags, mpos, tlen in reads:
        fields = [q, flag, contig, pos + 1, mapq, cigar, "=" if mpos >= 0 else "*", mpos + 1, tlen, seq, QUAL[quality] * len(seq), *(f"{k}:i:{v}" for k, v in tags.items())]
        lines.append("\t".join(map(str, fields)))
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def fasta(path, contigs):
    path.write_text("".join(f">{n} extra words\n" + "\n".join(s[k : k + 7] for k in range(0, len(s), 7)) + "\n" for n, s in contigs))
    return str(path)


def _block(data):
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def bam(path, contigs, reads, block=97, index=False):
    """With ``index``, the index beside it, for reads in order."""
    import re

    places, spans = [], []

    names = [n for n, _ in contigs]
    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(contigs))
    for n, length in contigs:
        data += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", length)
    for q, flag, contig, pos, mapq, cigar, seq, quality, tags, mpos, tlen in reads:
        ops = [(int(n), "MIDNSHP=X".index(o)) for n, o in re.findall(r"(\d+)(.)", cigar)]
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0]
        body = struct.pack("<iiBBHHHiiii", names.index(contig), pos, len(q) + 1, mapq, 0, len(ops), flag, len(seq), names.index(contig) if mpos >= 0 else -1, mpos, tlen)
        body += q.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops)
        body += bytes(codes[k] << 4 | codes[k + 1] for k in range(0, len(seq), 2)) + bytes([quality] * len(seq))
        for k, v in tags.items():
            body += k.encode() + b"C" + struct.pack("<B", v)
        body += b"RGZgroup\0XFf" + struct.pack("<f", 1.5) + b"XBBc" + struct.pack("<i", 2) + b"\1\2"
        places.append(len(data))
        spans.append((names.index(contig), pos, pos + sum(n for n, o in ops if o in (0, 2, 3, 7, 8))))
        data += struct.pack("<i", len(body)) + body
    blocks = [_block(data[k : k + block]) for k in range(0, len(data), block)]
    path.write_bytes(b"".join(blocks) + _block(b""))
    if index:
        offsets = [sum(map(len, blocks[:k])) for k in range(len(blocks) + 1)]
        virtual = [offsets[k // block] << 16 | k % block for k in [*places, len(data)]]
        out = b"BAI\1" + struct.pack("<i", len(contigs))
        for t, (_, length) in enumerate(contigs):
            own = [k for k, span in enumerate(spans) if span[0] == t]
            out += struct.pack("<iIi", 1, 0, 1) + struct.pack("<QQ", virtual[own[0]], virtual[own[-1] + 1]) if own else struct.pack("<i", 0)
            windows = [min((virtual[k] for k in own if spans[k][1] >> 14 <= w <= spans[k][2] - 1 >> 14), default=0) for w in range((length >> 14) + 1)]
            out += struct.pack("<i", len(windows)) + struct.pack(f"<{len(windows)}Q", *windows)
        (path.parent / (path.name + ".bai")).write_bytes(out)
    return str(path)


def read(q, flag, pos, seq, mapq=60, cigar=None, contig="chr1", quality=40, tags=None, mpos=-1, tlen=0):
    return (q, flag, contig, pos, mapq, cigar or f"{len(seq)}M", seq, quality, tags or {}, mpos, tlen)
