"""Ogg media columns: a page writer, a verifying reader and the Spark operator on top of them.

The container (RFC 3533): a physical stream is a run of pages, each with a CRC over the whole page, the serial
number of one logical stream, a page sequence number, a granule position and a lacing table that cuts the body
into packets. A packet goes on over lacing values of 255 and over page ends.

``ogg_encode`` stores a text losslessly: a ``PCM8`` stream of unsigned 8-bit samples and an ``INDEX`` stream, whose
pages are interleaved. ``ogg_decode`` checks every page, demultiplexes, reassembles and dates the packets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .common import columns, map_rows

PAD = 192
RATE = 48_000
PACKET = 20 * PAD
_HEADER = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """CRC-32 as Ogg has it: polynomial 0x04c11db7, most significant bit first, from zero, not inverted.

    zlib's CRC is the same polynomial with mirrored bits, so mirroring the input's bytes and the result's 32 bits
    gives Ogg's at the speed of zlib.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def page(serial: int, sequence: int, granule: int, lacing: bytes, body: bytes, flags: int = 0) -> bytes:
    """One page; flags: 1 goes on from the last page, 2 first of its stream, 4 last of it."""
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def write_stream(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream. packets: the bytes and the granule position at their end.

    The first packet has a page of its own; a page takes 255 lacing values, and its granule position is that of the
    last packet that ends on it, -1 if none does.
    """
    pages: list[tuple[int, bytes, bytes, int]] = []
    lacing, body, granule, started = bytearray(), bytearray(), -1, 0

    def flush(goes_on: bool) -> None:
        nonlocal lacing, body, granule, started
        pages.append((granule, bytes(lacing), bytes(body), started))
        lacing, body, granule, started = bytearray(), bytearray(), -1, int(goes_on)

    for k, (data, at) in enumerate(packets):
        full, rest = divmod(len(data), 255)
        values, offset = [255] * full + [rest], 0
        while values:
            take = values[: 255 - len(lacing)]
            values = values[len(take) :]
            lacing += bytes(take)
            body += data[offset : offset + sum(take)]
            offset += sum(take)
            if not values:
                granule = at
            if len(lacing) == 255:
                flush(bool(values))
        if k == 0 and lacing:
            flush(False)
    if lacing or not pages:
        flush(False)
    last = len(pages) - 1
    return [page(serial, n, g, la, b, s | 2 * (n == 0) | 4 * (n == last)) for n, (g, la, b, s) in enumerate(pages)]


@dataclass
class Stream:
    """A logical stream as read: packets with the granule position and second at which each ends."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    started: bool = False
    ended: bool = False
    link: int = 0
    latest: int = 0

    def seconds(self, rate: int = RATE) -> list[float | None]:
        return [g / rate if g >= 0 else None for g in self.granules]


def read_pages(data: bytes) -> tuple[dict, list[str]]:
    """Streams by serial number (of later links of a chain by serial and link), in order of appearance, and what is wrong.

    A page of a wrong checksum is left out whole and the reader looks for the next capture pattern; the packet that
    it was part of is dropped, not joined over the gap. So is what a page says to continue where no packet is open.
    Granule positions are known at page ends only: packets that end earlier on a page have -1 here, ``date_packets``
    fills them for streams of known packet lengths. Media may be chained: once all streams have ended, a first page
    begins another link, whose streams may use serial numbers again. Missing first pages, pages behind the last one,
    first pages of running streams and granule positions that go back are faults; the pages count all the same.
    """
    streams: dict[object, Stream] = {}
    current: dict[int, Stream] = {}
    parts: dict[int, bytearray | None] = {}  # of each running stream the open packet, if any
    expected: dict[int, int] = {}
    faults: list[str] = []
    at, link = 0, 0
    while at < len(data):
        if data[at : at + 4] != b"OggS":
            found = data.find(b"OggS", at + 1)
            faults.append(f"no page at {at}")
            at = found if found >= 0 else len(data)
            continue
        if len(data) < at + 27:
            faults.append(f"cut page at {at}")
            break
        _, version, flags, granule, serial, sequence, crc, count = _HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(lacing)
        whole = data[at:end]
        if len(lacing) < count or len(data) < end:
            faults.append(f"cut page at {at}")
            at += 4
            continue
        if version or page_crc(whole[:22] + b"\0\0\0\0" + whole[26:]) != crc:
            faults.append(f"bad checksum at {at}")
            at += 4
            continue
        if flags & 2 and current and all(s.ended for s in current.values()):
            link += 1
            faults += [f"packet of stream {s} not ended" for s, part in parts.items() if part is not None]
            current, parts, expected = {}, {}, {}
        if serial not in current:
            current[serial] = Stream(serial, link=link)
            streams[(serial, link) if serial in streams else serial] = current[serial]
            if not flags & 2:
                faults.append(f"stream {serial} begins without a first page")
        elif flags & 2:
            faults.append(f"another first page of stream {serial}")
        stream = current[serial]
        if stream.ended:
            faults.append(f"page of stream {serial} behind its last")
        lost = sequence != expected.get(serial, 0)
        if lost:
            faults.append(f"page {expected.get(serial, 0)} of stream {serial} missing")
            parts[serial] = None
        expected[serial] = sequence + 1
        stream.pages += 1
        stream.started |= bool(flags & 2)
        stream.ended |= bool(flags & 4)
        if granule >= 0:
            if granule < stream.latest:
                faults.append(f"granule position of stream {serial} goes back")
            stream.latest = max(stream.latest, granule)
        part = parts.get(serial)
        skip = bool(flags & 1) and part is None and count > 0
        if skip and not lost:
            faults.append(f"page of stream {serial} continues no packet")
        if not flags & 1 and part is not None and count:
            faults.append(f"packet of stream {serial} not ended")
            part = None
        offset, ended = at + 27 + count, []
        for value in lacing:
            if not skip:
                part = part if part is not None else bytearray()
                part += data[offset : offset + value]
            offset += value
            if value < 255:
                if not skip:
                    ended.append(bytes(part))
                part, skip = None, False
        parts[serial] = part
        stream.packets += ended
        if ended:
            stream.granules += [-1] * (len(ended) - 1) + [granule]
        at = end
    faults += [f"packet of stream {s} not ended" for s, part in parts.items() if part is not None]
    return streams, faults


def date_packets(stream: Stream, head: int = 1) -> None:
    """Fill unknown granule positions of a stream with one granule a byte, back from the next known one."""
    after = None
    for k in range(len(stream.packets) - 1, head - 1, -1):
        if stream.granules[k] < 0 and after is not None:
            stream.granules[k] = after
        after = stream.granules[k] - len(stream.packets[k]) if stream.granules[k] >= 0 else None


def pad(raw: bytes) -> bytes:
    """Spaces up to a positive multiple of PAD."""
    return raw.ljust(max(PAD, -(-len(raw) // PAD) * PAD), b" ")


def ogg_encode(raw: bytes) -> bytes:
    """raw, padded, as 8-bit samples in one stream beside an index stream; a function of the bytes alone."""
    payload = pad(raw)
    sound_serial = zlib.crc32(payload) & 0x7FFFFFFF
    index_serial = sound_serial ^ 0x40000000
    samples = [(struct.pack("<5sIQ", b"PCM8\0", RATE, len(payload)), 0)]
    samples += [(payload[k : k + PACKET], min(k + PACKET, len(payload))) for k in range(0, len(payload), PACKET)]
    marks = [(struct.pack("<6sQ", b"INDEX\0", len(raw)), 0)]
    marks += [(struct.pack("<II", n, zlib.crc32(data)), at) for n, (data, at) in enumerate(samples[1:])]
    sound, index = write_stream(sound_serial, samples), write_stream(index_serial, marks)
    # First pages come first; then both streams' pages take turns.
    out = [sound[0], index[0]]
    for k in range(1, max(len(sound), len(index))):
        out += sound[k : k + 1] + index[k : k + 1]
    return b"".join(out)


def ogg_decode(media: bytes) -> dict:
    """Payload and facts read back from the stored bytes; faults is empty if every check held.

    The links of a chain follow one another: their payloads are joined, their unpadded bytes added up.
    """
    streams, faults = read_pages(media)
    out = {"payload": b"", "n_bytes": 0, "faults": faults, "streams": streams, "sounds": [], "rates": []}
    for link in range(max((s.link for s in streams.values()), default=0) + 1):
        own = [s for s in streams.values() if s.link == link]
        sound = next((s for s in own if s.packets and s.packets[0][:5] == b"PCM8\0"), None)
        index = next((s for s in own if s.packets and s.packets[0][:6] == b"INDEX\0"), None)
        if sound is None or index is None or len(sound.packets[0]) != 17 or len(index.packets[0]) != 14:
            faults.append("no known streams")
            continue
        _, rate, total = struct.unpack("<5sIQ", sound.packets[0])
        _, n_bytes = struct.unpack("<6sQ", index.packets[0])
        date_packets(sound)
        payload = b"".join(sound.packets[1:])
        for mark, data in zip(index.packets[1:], sound.packets[1:], strict=False):
            if len(mark) != 8 or struct.unpack("<II", mark)[1] != zlib.crc32(data):
                faults.append("a packet differs from its index")
        if len(payload) != total or len(index.packets) != len(sound.packets):
            faults.append("packets missing")
        if not all(s.started and s.ended for s in (sound, index)):
            faults.append("a stream is not whole")
        out["payload"] += payload
        out["n_bytes"] += n_bytes
        out["sounds"].append(sound)
        out["rates"].append(rate or RATE)
        out.setdefault("sound", sound)
    return out


def feature(found: dict) -> str:
    """What the samples say: streams, pages, packets, seconds, mean, energy and crossings of the middle level."""
    import numpy as np

    if not found["sounds"]:
        return "none"
    x = np.frombuffer(found["payload"], dtype=np.uint8).astype(np.int64)
    crossings = int(np.count_nonzero(np.diff(x >= 96)))
    times = [[t for t in s.seconds(r)[1:] if t is not None] for s, r in zip(found["sounds"], found["rates"], strict=True)]
    pages = sum(s.pages for s in found["streams"].values())
    return (
        f"streams={len(found['streams'])};pages={pages};packets={sum(len(s.packets) - 1 for s in found['sounds'])};end={sum(t[-1] for t in times if t):.6f};"
        f"sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings};faults={len(found['faults'])}"
    )


MEDIA_SCHEMA = "doc_id long, media binary"
DIGEST_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, faults array<string>"
)
PACKET_SCHEMA = "media_id long, serial long, packet long, granule long, second double, data binary, faults array<string>"


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the Ogg form of each whole text (null: empty). Narrow: no shuffle."""

    def batch(rows: dict) -> dict:
        return {"doc_id": rows["doc_id"], "media": [ogg_encode((t or "").encode()) for t in rows["text"]]}

    return map_rows(columns(df, doc_id=id_col, text=text_col), batch, MEDIA_SCHEMA)


def read_packets(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", rate: int = RATE) -> DataFrame:
    """Demultiplex a binary column: a row for each packet of each logical stream, dated from granule positions.

    A stream of samples has a granule a byte, so each of its packets is dated, by the rate that its header states.
    Streams of unknown kind are read too; their packets that do not end a page have no time. A medium without any
    readable packet gives one row with null packet and its faults; null media and empty tables give none.
    """

    def batch(rows: dict) -> dict:
        out: dict[str, list] = {n: [] for n in ("media_id", "serial", "packet", "granule", "second", "data", "faults")}
        for key, media in zip(rows["media_id"], rows["media"], strict=True):
            if media is None:
                continue
            streams, faults = read_pages(media)
            found = []
            for s in streams.values():
                known = s.packets and s.packets[0][:5] == b"PCM8\0" and len(s.packets[0]) == 17
                if known:
                    date_packets(s)
                own = struct.unpack("<5sIQ", s.packets[0])[1] or rate if known else rate
                found += [(s.serial, k, g, sec, p) for k, (p, g, sec) in enumerate(zip(s.packets, s.granules, s.seconds(own), strict=True))]
            for serial, k, g, sec, p in found or [(None, None, None, None, None)]:
                for name, value in zip(out, (key, serial, k, g, sec, p, faults), strict=True):
                    out[name].append(value)
        return out

    return map_rows(columns(df, media_id=id_col, media=media_col), batch, PACKET_SCHEMA)


def media_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each whole text as Ogg, read the stored bytes back, and describe both. One row for each input row.

    Null and empty texts are one padding block of spaces; equal texts give equal values; rows are independent of one
    another, so repeated ids and rows stay as they are; an empty table gives no rows. A batch holds at most Spark's Arrow byte limit of text.
    """

    def batch(rows: dict) -> dict:
        out: dict[str, list] = {n: [] for n in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "faults")}
        for text in rows["text"]:
            media = ogg_encode((text or "").encode())
            found = ogg_decode(media)
            payload = found["payload"]
            for name, value in zip(
                out,
                (found["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(found), found["faults"]),
                strict=True,
            ):
                out[name].append(value)
        return out | {"doc_id": rows["doc_id"]}

    return map_rows(columns(df, doc_id=id_col, text=text_col), batch, DIGEST_SCHEMA)
