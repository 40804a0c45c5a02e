"""Media columns in Ogg containers: a muxer, a verifying demuxer and features.

A media value holds two logical streams, multiplexed page by page. Stream "pcm" has
a header packet and then the samples (8-bit unsigned, one channel) in packets of
PACKET bytes; a page's granule position is the number of samples up to the end of
its last whole packet. Stream "meta" has one header packet and one packet with the
unpadded length.

A packet that ends a page's whole packets ends at granule / rate; the others of that
page end before it by the samples of those that follow. Packets after the last page
that states a position have no time.

Reading checks every page: capture pattern, version, CRC-32 (polynomial 04c11db7,
not reflected, no inversion), page sequence. A page that fails is skipped, the next
capture pattern is searched for, and packets that lost a part are dropped and counted.

Defined results: null text is empty and gives one packet of 192 blanks; equal texts
give equal bytes (serial numbers are fixed); a null doc_id is kept; repeated rows
each get a row; an empty table gives an empty result; texts are stored whole; other
input columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratamill.llm.store import stage, table

RATE = 8000
UNIT = 192
PACKET = 10 * UNIT
PCM, META = 0x70636D31, 0x6D657461
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """Ogg's CRC by way of zlib's: the same polynomial over bit-reversed bytes, without zlib's two inversions."""
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


def pages(packets: list[bytes], granules: list[int], serial: int, first_alone: bool = True) -> list[bytes]:
    """One logical stream as pages. The first packet has a page to itself."""
    out: list[bytes] = []
    lacing, body, granule, continued = bytearray(), [], -1, False

    def close(last: bool) -> None:
        nonlocal lacing, body, granule
        kind = CONTINUED * continued | FIRST * (not out) | LAST * last
        head = bytearray(_HEAD.pack(b"OggS", 0, kind, granule, serial, len(out), 0, len(lacing)))
        page = bytes(head + lacing) + b"".join(body)
        out.append(page[:22] + page_crc(page).to_bytes(4, "little") + page[26:])
        lacing, body, granule = bytearray(), [], -1

    for i, (packet, g) in enumerate(zip(packets, granules, strict=True)):
        at, left = 0, len(packet) // 255 + 1
        while left:
            room = min(left, 255 - len(lacing))
            left -= room
            size = min(len(packet) - at, 255 * room)
            values = bytearray([255]) * room
            if not left:
                values[-1] = size - 255 * (room - 1)
            lacing += values
            body.append(packet[at : at + size])
            at += size
            if not left:
                granule = g
            if len(lacing) == 255 and (left or i + 1 < len(packets)):
                close(False)
                continued = bool(left)
        if not i and first_alone and lacing and len(packets) > 1:
            close(False)
            continued = False
    close(True)
    return out


def mux(payload: bytes, n_bytes: int, rate: int = RATE) -> bytes:
    data = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    ends = np.cumsum([len(p) for p in data]).tolist()
    pcm = pages([b"\x01pcm8" + struct.pack("<IB", rate, 1), *data], [0, *ends], PCM)
    meta = pages([b"\x01meta", struct.pack("<q", n_bytes)], [0, 0], META)
    return b"".join([pcm[0], meta[0], meta[1], *pcm[1:]])


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    #: Granule position for packets that end a page's whole packets, else -1.
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    #: Packets that lack a part, and pages by their numbers that never came.
    lost: int = 0
    missing: int = 0
    _next: int = 0
    _open: list[bytes] | None = None


def demux(media: bytes) -> tuple[dict[int, Stream], int]:
    """Streams by serial number, and how many bytes or pages had to be skipped."""
    streams: dict[int, Stream] = {}
    at, skipped = 0, 0
    while at < len(media):
        if media[at : at + 4] != b"OggS" or at + 27 > len(media):
            found = media.find(b"OggS", at + 1)
            skipped += 1
            at = found if found >= 0 else len(media)
            continue
        _, version, kind, granule, serial, sequence, crc, segments = _HEAD.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + segments]
        start = at + 27 + segments
        end = start + sum(lacing)
        if version or end > len(media) or page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            at += 1
            skipped += 1
            found = media.find(b"OggS", at)
            at = found if found >= 0 else len(media)
            continue
        s = streams.setdefault(serial, Stream())
        if sequence != s._next:
            s.missing += (sequence - s._next) % (1 << 32)
            if s._open is not None:
                s._open, s.lost = None, s.lost + 1
        s._next, s.pages = sequence + 1, s.pages + 1
        whole = kind & CONTINUED == 0 or s._open is not None
        if not kind & CONTINUED and s._open is not None:
            s._open, s.lost = None, s.lost + 1
        pos, size, last = start, 0, -1
        for value in lacing:
            size += value
            if value < 255:
                part = media[pos : pos + size]
                if whole:
                    s.packets.append(b"".join([*(s._open or ()), part]))
                    s.granules.append(-1)
                    last = len(s.granules) - 1
                else:
                    s.lost += 1
                s._open, whole = None, True
                pos, size = pos + size, 0
        if size or (segments and lacing[-1] == 255):
            if whole:
                s._open = [*(s._open or ()), media[pos : pos + size]]
        if last >= 0:
            s.granules[last] = granule
        at = end
    return streams, skipped


def packet_ends(stream: Stream, samples_of=len) -> list[int | None]:
    """The position, in samples, at which each packet ends: stated by its page, or counted back from the next packet's."""
    out: list[int | None] = []
    following: int | None = None
    for packet, granule in zip(reversed(stream.packets), reversed(stream.granules), strict=True):
        end = granule if granule >= 0 else following
        out.append(end)
        following = None if end is None else end - samples_of(packet)
    return out[::-1]


def packet_times(stream: Stream, rate: int, samples_of=len) -> list[tuple[float, float] | None]:
    """(start, end) of each packet in ms."""
    return [None if e is None else ((e - samples_of(p)) * 1000 / rate, e * 1000 / rate) for p, e in zip(stream.packets, packet_ends(stream, samples_of), strict=True)]


def features(samples: bytes, streams: dict[int, Stream], skipped: int, rate: int) -> str:
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    centred = 2 * x - 255
    data = Stream(streams[PCM].packets[1:], streams[PCM].granules[1:])
    times = [x for x in packet_times(data, rate) if x]
    gaps = sum(abs(b[0] - a[1]) > 1e-6 for a, b in zip(times, times[1:], strict=False))
    crossings = int(np.count_nonzero(np.diff(centred > 0)))
    return ";".join(
        (
            f"streams={len(streams)}", f"pages={sum(s.pages for s in streams.values())}", f"packets={sum(len(s.packets) for s in streams.values())}",
            f"bad={skipped + sum(s.lost + s.missing for s in streams.values())}", f"ms={int(times[-1][1]) if times else 0}", f"gaps={gaps}", f"mean={int(x.sum()) // len(x)}",
            f"power={int((centred * centred).sum()) // len(x)}", f"peak={int(x.max())}", f"crossings={crossings}",
        )
    )


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from stratamill.llm.words import pieces

    for batch in pieces(batches, 8 << 20):
        out = []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            raw = text or b""
            out.append(mux(raw + b" " * (UNIT - len(raw) if not raw else -len(raw) % UNIT), len(raw)))
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "media": pa.array(out, pa.binary())})


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, media: every text's UTF-8 bytes, padded to a positive multiple of 192, as samples in an Ogg container."""
    return docs.select("doc_id", "text").mapInArrow(_store, "doc_id bigint, media binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from stratamill.llm.words import pieces

    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in pieces(batches, 8 << 20, "media"):
        rows = []
        for media in batch.column("media").to_pylist():
            streams, skipped = demux(media)
            head, *data = streams[PCM].packets
            rate = struct.unpack_from("<I", head, 5)[0]
            payload = b"".join(data)
            n_bytes = struct.unpack("<q", streams[META].packets[1])[0]
            rows.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, streams, skipped, rate)))
        cols = zip(*rows, strict=True)
        yield pa.record_batch({"doc_id": batch.column("doc_id")} | {n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})


def describe(media: DataFrame) -> DataFrame:
    """The contract's columns from (doc_id, media)."""
    return media.select("doc_id", "media").mapInArrow(
        _read,
        "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    )


def op8_ogg_media(spark, sf_dir):
    return describe(stage(media_column(table(spark, sf_dir, "documents")), "ogg_media"))
