"""Media columns: MPEG-1 Layer III streams that carry a payload, and a parser for MPEG audio of all versions (1, 2, 2.5) and layers.

Writing: an ID3v2.3 tag with the payload's length and title, a Xing frame (frame count, byte count, 100 seek points), then
frames of 32 kHz mono with CRC-16. A frame's main data carries the payload; the last frame takes the smallest bit rate that
holds the rest, so the stream has a variable bit rate. Reading: ID3v2.3 and v2.4 tags at the start and an ID3v1 tag at the end are parsed, frame headers are followed by their
lengths, and after damage the parser scans for the next header whose frame is followed by another header or the end. Xing, Info and VBRI tables
are read. Checksums cover the header's last two bytes and the side information of Layer III, or the bit allocation of Layer I; a frame that fails its
checksum gives no payload. Layer II's checksums are not verified (they cover as many bits as its allocation tables say).

Defined results: null payload counts as empty; an empty payload has a tag and a Xing frame. Equal payloads give equal bytes. A stream that is
null, empty or without frames has zero samples, no offsets and an empty payload. Durations are exact: samples over rate.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from . import common

# Fixed values of the format: bit rates (kbit/s) by version (1, or 2 and 2.5), layer and index, sampling rates (Hz) of version 1 by index, samples of a frame by layer.
BIT_RATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
ALL_BIT_RATES = {
    (1, 1): tuple(range(0, 449, 32)), (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), (1, 3): BIT_RATES,
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = (44100, 48000, 32000)
SAMPLES = 1152
MONO = 3
#: Bytes of Layer III's side information by version (1, or 2 and 2.5) and whether there is one channel.
SIDE_INFO = {(1, True): 17, (1, False): 32, (2, True): 9, (2, False): 17}
RATE_INDEX = 2
HEADER, CRC = 4, 2
HEAD = HEADER + CRC + SIDE_INFO[1, True]
#: Where a VBRI table begins in a frame, and length of an ID3v1 tag.
VBRI_AT, ID3V1 = 36, 128
#: Padding of payloads, in bytes.
UNIT = 64


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


class Header(NamedTuple):
    """Of a frame: its length, sampling rate, whether it has a checksum, kbit/s, samples, layer, and the bytes after the header that its checksum covers (0: not known)."""

    length: int
    rate: int
    checked: bool
    kbps: int
    samples: int
    layer: int
    covered: int


@lru_cache(4096)
def parse_header(four: bytes) -> Header | None:
    if len(four) < 4 or four[0] != 0xFF or four[1] < 0xE0:
        return None
    version, layer = {0: 2.5, 2: 2, 3: 1}.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
    bits, rate, mode = four[2] >> 4, four[2] >> 2 & 3, four[3] >> 6
    if version is None or layer == 4 or bits in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    family, hertz, padding = 1 if version == 1 else 2, SAMPLE_RATES[rate] // {1: 1, 2: 2, 2.5: 4}[version], four[2] >> 1 & 1
    kbps = ALL_BIT_RATES[family, layer][bits]
    samples = {1: SAMPLES // 3, 2: SAMPLES, 3: SAMPLES // family}[layer]
    # A slot has four bytes in Layer I, else one.
    length = (12000 * kbps // hertz + padding) * 4 if layer == 1 else 125 * samples * kbps // hertz + padding
    # In Layer I: four bits of allocation for each of 32 bands and channel; in joint stereo, channels share those from the bound on.
    bands = 32 if mode == MONO else 64 if mode != 1 else 32 + 4 * ((four[3] >> 4 & 3) + 1)
    return Header(length, hertz, not four[1] & 1, kbps, samples, layer, {1: bands // 2, 2: 0, 3: SIDE_INFO[family, mode == MONO]}[layer])


@lru_cache(16)
def frame_head(index: int) -> bytes:
    """Header, checksum and side information of a frame of the bit rate with this index."""
    header, side = bytes((0xFF, 0xFA, index << 4 | RATE_INDEX << 2, MONO << 6)), bytes(SIDE_INFO[1, True])
    return header + struct.pack(">H", crc16(header[2:] + side)) + side


#: Bytes of payload in a frame, by index of bit rate.
BODY = [144000 * b // SAMPLE_RATES[RATE_INDEX] - HEAD for b in BIT_RATES]


def _syncsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def _tag(fields: dict[str, str]) -> bytes:
    body = b""
    for key, value in fields.items():
        own = b"\x00" + key.encode("latin-1") + b"\x00" + value.encode("latin-1")
        body += b"TXXX" + struct.pack(">I", len(own)) + b"\x00\x00" + own
    return b"ID3\x03\x00\x00" + _syncsafe(len(body)) + body


def store_payload(payload: bytes) -> bytes:
    full, rest = divmod(len(payload), BODY[-1])
    heads = [14] * full
    if rest:
        heads.append(next(i for i in range(1, 15) if BODY[i] >= rest))
    frames, at = [], 0
    for index in heads:
        frames += [frame_head(index), payload[at : at + BODY[index]]]
        at += BODY[index]
    frames.append(bytes(at - len(payload)))
    lengths = [BODY[i] + HEAD for i in heads]
    first = 9  # the Xing frame: 128 kbit/s has room for the table
    size = BODY[first] + HEAD
    total = size + sum(lengths)
    ends = [size]
    for n in lengths:
        ends.append(ends[-1] + n)
    seek = bytes(min(255, ends[min(len(lengths), i * len(lengths) // 100)] * 256 // total) for i in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(heads), total) + seek
    return _tag({"payload_bytes": str(len(payload))}) + frame_head(first) + xing.ljust(BODY[first], b"\x00") + b"".join(frames)


def _read_tag(data: bytes) -> tuple[int, dict[str, str]]:
    """(where audio begins, user text fields) of an ID3v2.3 or v2.4 tag at the start."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0, {}

    def syncsafe(at: int) -> int:
        return data[at] << 21 | data[at + 1] << 14 | data[at + 2] << 7 | data[at + 3]

    newer = data[3] >= 4
    end = 10 + syncsafe(6)
    fields, at = {}, 10
    if data[5] & 0x40 and len(data) >= 14:
        at += syncsafe(10) if newer else 4 + struct.unpack_from(">I", data, 10)[0]
    while at + 10 <= min(end, len(data)) and data[at] != 0:
        n = syncsafe(at + 4) if newer else struct.unpack_from(">I", data, at + 4)[0]
        if data[at : at + 4] == b"TXXX" and data[at + 10 : at + 11] in (b"\x00", b"\x03"):
            key, _, value = data[at + 11 : at + 10 + n].partition(b"\x00")
            coding = "utf-8" if data[at + 10] else "latin-1"
            fields[key.decode(coding, "replace")] = value.decode(coding, "replace")
        at += 10 + n
    end += 10 * bool(newer and data[5] & 0x10)
    return min(end, len(data)), fields


def _read_table(data: bytes, at: int, head: Header) -> dict | None:
    """A variable-bitrate table in a Layer III frame: Xing or Info behind the side information, or VBRI at its place."""
    if head.layer != 3:
        return None
    body = at + HEADER + CRC * head.checked + head.covered
    if data[body : body + 4] in (b"Xing", b"Info") and body + 8 <= at + head.length:
        flags, found, field = struct.unpack_from(">I", data, body + 4)[0], {}, body + 8
        for bit, key, form in ((1, "frames", ">I"), (2, "bytes", ">I"), (4, "seek", ">100s")):
            if flags & bit and field + struct.calcsize(form) <= at + head.length:
                (found[key],) = struct.unpack_from(form, data, field)
                field += struct.calcsize(form)
        return found
    if data[at + VBRI_AT : at + VBRI_AT + 4] == b"VBRI" and VBRI_AT + 18 <= head.length:
        return dict(zip(("bytes", "frames"), struct.unpack_from(">II", data, at + VBRI_AT + 10)))
    return None


def _resync(data: bytes, at: int) -> int:
    """The next place of a frame that another header or the end follows; the data's length if there is none."""
    while (at := data.find(b"\xff", at)) >= 0:
        if head := parse_header(data[at : at + 4]):
            after = at + head.length
            if after == len(data) or after < len(data) and parse_header(data[after : after + 4]):
                return at
        at += 1
    return len(data)


def parse(data: bytes | None) -> dict:
    """Tag, table, frames, checksums, exact duration, seek offsets and payload of a stream."""
    data = data or b""
    at, tag = _read_tag(data)
    if data[-ID3V1:-ID3V1 + 3] == b"TAG" and len(data) - at >= ID3V1:
        data = data[:-ID3V1]
    offsets, bodies, samples, bad, lost, bits, table, by_rate = [], [], 0, 0, 0, 0, None, {}
    while at < len(data):
        head = parse_header(data[at : at + 4])
        if not head or at + head.length > len(data):
            after = _resync(data, at + 1)
            lost, at = lost + after - at, after
            continue
        side = at + HEADER + CRC * head.checked
        body = side + (head.covered if head.layer == 3 else 0)
        good = not (head.checked and head.covered) or struct.unpack_from(">H", data, at + HEADER)[0] == crc16(data[at + 2 : at + HEADER] + data[side : side + head.covered])
        if table is None and not offsets and (found := _read_table(data, at, head)) is not None:
            table = found
        else:
            offsets.append(at)
            samples += head.samples
            bits += head.kbps
            by_rate[head.rate] = by_rate.get(head.rate, 0) + head.samples
            if good:
                bodies.append(data[body : at + head.length])
        bad += not good
        at += head.length
    payload, duration = b"".join(bodies), sum((Fraction(n, rate) for rate, n in by_rate.items()), Fraction(0))
    if "payload_bytes" in tag and tag["payload_bytes"].isdigit():
        payload = payload[: int(tag["payload_bytes"])]
    return {
        "payload": payload, "frames": len(offsets), "samples": samples, "duration_num": duration.numerator, "duration_den": duration.denominator,
        "seek_offsets": offsets, "bad_checksums": bad, "lost_bytes": lost, "table_frames": table.get("frames") if table else None, "table_bytes": table.get("bytes") if table else None,
        "mean_kbps": bits / len(offsets) if offsets else 0.0,
    }


_ARROW = pa.struct([("payload", pa.binary()), *((c, pa.int64()) for c in ("frames", "samples", "duration_num", "duration_den")), ("seek_offsets", pa.list_(pa.int64())), *((c, pa.int64()) for c in ("bad_checksums", "lost_bytes", "table_frames", "table_bytes")), ("mean_kbps", pa.float64())])
PARSED = from_arrow_type(_ARROW)


def store(df: DataFrame, payload: str = "payload", out: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Adds binary `out`: the stream that carries each payload. ValueError if the input has such a column."""
    common.bound_batches(df.sparkSession)
    keep = df.columns if keep is None else keep
    common.check_new(df.select(*keep), out)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [store_payload(p.as_py() or b"") for p in batch.column(payload)]
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(made, pa.binary())], names=[*keep, out])

    return df.select(*dict.fromkeys([*keep, payload])).mapInArrow(run, schema)


def read_back(df: DataFrame, media: str = "media", out: str = "audio", keep: list[str] | None = None) -> DataFrame:
    """Adds struct `out` with what parse() finds in each stream. ValueError if the input has such a column."""
    common.bound_batches(df.sparkSession)
    keep = df.columns if keep is None else keep
    common.check_new(df.select(*keep), out)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, PARSED, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([parse(m.as_py()) for m in batch.column(media)], _ARROW)
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, found], names=[*keep, out])

    return df.select(*dict.fromkeys([*keep, media])).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every whole text of documents as the payload of an MPEG audio stream, read back from its bytes."""
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    docs = common.table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    padded = (F.greatest(F.ceil(F.octet_length("raw") / F.lit(UNIT)), F.lit(1)) * UNIT).cast("int")
    docs = docs.select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), F.rpad("raw", padded, F.lit(b"\x00")).alias("payload"))
    found = read_back(store(docs, keep=["doc_id", "n_bytes"]))
    feature = F.concat_ws(
        ";", F.lit("mpeg1 layer3 32000 mono"), F.concat(F.lit("samples="), F.col("audio.samples")),
        F.concat(F.lit("duration="), F.col("audio.duration_num"), F.lit("/"), F.col("audio.duration_den")), F.concat(F.lit("kbps="), F.round("audio.mean_kbps", 3)),
        F.concat(F.lit("bad="), F.col("audio.bad_checksums")), F.concat(F.lit("table="), F.col("audio.table_frames"), F.lit("/"), F.col("audio.table_bytes")),
    )
    return found.select(
        "doc_id", "n_bytes", F.octet_length("audio.payload").cast("long").alias("payload_bytes"), F.sha2("audio.payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("audio.payload", -UNIT, UNIT)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"), "audio.duration_num", "audio.duration_den", F.array_join(F.transform("audio.seek_offsets", lambda x: x.cast("string")), ",").alias("seek_offsets"),
    )
