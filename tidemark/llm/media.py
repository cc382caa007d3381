"""Telephony audio: mu-law and A-law by lookup tables, IMA ADPCM by blocks, PCM resampling and WAV storage."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tidemark.llm.common import id_text, map_arrow, utf8_chunks

#: Samples that are resampled or measured at once, and bytes of files that are decoded together.
STRETCH, TOGETHER = 1 << 16, 2 << 20
#: Bytes of an ADPCM block of stored texts: with their padding they are whole blocks.
BLOCK = 64

#: WAV format tags (fixed values of the RIFF registry).
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17

#: IMA ADPCM step index changes by code (fixed values of the format).
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)

#: IMA ADPCM step sizes (fixed values of the format).
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw_table(), _alaw_table()


def expand_mulaw(codes: np.ndarray) -> np.ndarray:
    return MULAW_TABLE[codes]


def expand_alaw(codes: np.ndarray) -> np.ndarray:
    return ALAW_TABLE[codes]


def decode_adpcm(data: bytes, block: int) -> np.ndarray:
    """Mono IMA ADPCM: every block starts from its own header, so one numpy step decodes the same nibble of all blocks.

    A last block that is shorter is padded with zero nibbles and cut again; a tail below a header is ignored.
    """
    if block < 5:
        raise ValueError("a block holds a header of 4 bytes and at least one byte of codes")
    raw = np.frombuffer(data, np.uint8)
    tail = len(raw) % block
    lost = block - tail if tail >= 4 else 0
    raw = raw[: len(raw) - (tail if tail < 4 else 0)]
    if not len(raw):
        return np.zeros(0, np.int16)
    raw = np.concatenate((raw, np.zeros(lost, np.uint8))).reshape(-1, block)
    level = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(raw[:, 2].astype(np.int32), 0, 88)
    out = np.empty((len(raw), 1 + 2 * (block - 4)), np.int16)
    out[:, 0] = level
    for at in range(2 * (block - 4)):
        code = (raw[:, 4 + at // 2] >> (4 * (at % 2)) & 15).astype(np.int32)
        step = STEPS[index]
        change = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
        level = np.clip(level + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_STEP[code], 0, 88)
        out[:, at + 1] = level
    flat = out.reshape(-1)
    return flat[: len(flat) - 2 * lost]


def resample_linear(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in integers, the same on every machine, by stretches of the result; the last sample is held."""
    if not len(pcm) or rate == to:
        return pcm.astype(np.int16)
    out = np.empty((len(pcm) * to + rate - 1) // rate, np.int16)
    for at in range(0, len(out), STRETCH):
        place = np.arange(at, min(at + STRETCH, len(out)), dtype=np.int64) * rate
        left, part = place // to, place % to
        right = np.minimum(left + 1, len(pcm) - 1)
        out[at : at + STRETCH] = (pcm[left].astype(np.int64) * (to - part) + pcm[right].astype(np.int64) * part) // to
    return out


def wav_store(data: bytes, tag: int, rate: int = 8000, bits: int = 8, block: int = 1) -> bytes:
    """A RIFF file with a fact chunk (non-PCM) around one mono data chunk; ADPCM has bits of 4 and blocks of samples."""
    samples = 2 * (block - 4) + 1 if tag == IMA_ADPCM else 1
    extra = b"" if tag == PCM else struct.pack("<HH", 2, samples) if tag == IMA_ADPCM else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * block // samples, block, bits) + extra
    fact = b"" if tag == PCM else b"fact" + struct.pack("<II", 4, len(data) // block * samples)
    pad = b"\0" * (len(data) % 2)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + fact + b"data" + struct.pack("<I", len(data)) + data + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wav_read(stored: bytes) -> tuple[int, int, int, bytes]:
    """(format tag, rate, block size, data) of a mono RIFF file; raises ValueError on anything else."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, tag, rate, block = 12, None, 0, 0
    while at + 8 <= len(stored):
        kind, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if kind == b"fmt ":
            tag, channels, rate, _, block, _ = struct.unpack_from("<HHIIHH", stored, at + 8)
            if channels != 1:
                raise ValueError("one channel is asked for")
        elif kind == b"data" and tag is not None:
            return tag, rate, block, stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode_many(files: list[tuple[int, int, int, bytes]]) -> list[np.ndarray]:
    """16-bit PCM of each (format tag, rate, block size, data): files of one format are decoded together, ADPCM across all their blocks."""
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(files)
    by: dict[tuple[int, int], list[int]] = {}
    for i, (tag, _, block, _) in enumerate(files):
        by.setdefault((tag, block if tag == IMA_ADPCM else 2 if tag == PCM and block == 2 else 0), []).append(i)
    for (tag, block), some in by.items():
        data = [files[i][3] for i in some]
        if tag == IMA_ADPCM:
            whole = [len(x) // block * block for x in data]
            pcm = decode_adpcm(b"".join(x[:n] for x, n in zip(data, whole)), block)
            parts = np.split(pcm, np.cumsum([n // block * (2 * (block - 4) + 1) for n in whole])[:-1])
            parts = [np.concatenate((p, decode_adpcm(x[n:], block))) if len(x) > n else p for p, x, n in zip(parts, data, whole)]
        elif tag in (MULAW, ALAW):
            pcm = (expand_mulaw if tag == MULAW else expand_alaw)(np.frombuffer(b"".join(data), np.uint8))
            parts = np.split(pcm, np.cumsum([len(x) for x in data])[:-1])
        elif (tag, block) == (PCM, 2):
            parts = [np.frombuffer(x[: len(x) // 2 * 2], "<i2") for x in data]
        else:
            raise ValueError(f"format {tag} is not supported")
        for i, x in zip(some, parts):
            out[i] = x
    return out


def decode(stored: bytes) -> tuple[int, np.ndarray]:
    """(rate, 16-bit PCM) of a stored telephony file."""
    file = wav_read(stored)
    return file[1], decode_many([file])[0]


def to_pcm_file(pcm: np.ndarray, rate: int, to: int = 16000) -> bytes:
    """A WAV file of 16-bit PCM at another rate."""
    return wav_store(resample_linear(pcm, rate, to).astype("<i2").tobytes(), PCM, to, 16, 2)


def features(pcm: np.ndarray, rate: int) -> str:
    """samples, peak, mean square (rounded down) and sign changes; integers, so the same on every machine."""
    peak = power = crossings = 0
    for at in range(0, len(pcm), STRETCH):
        x = pcm[max(0, at - 1) : at + STRETCH].astype(np.int64)  # with the sample before, whose sign may change
        crossings += int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        x = x[bool(at) :]
        peak, power = max(peak, int(np.abs(x).max())), power + int((x * x).sum())
    return f"rate={rate};samples={len(pcm)};peak={peak};power={power // max(1, len(pcm))};crossings={crossings}"


#: (format tag, bits, block) by which texts are stored, in turn by a checksum of their bytes.
FORMATS = ((MULAW, 8, 1), (ALAW, 8, 1), (IMA_ADPCM, 4, BLOCK))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: every text's UTF-8 bytes, padded to a positive multiple of 64, as a telephony WAV file.

    The bytes are the file's data as they are: mu-law or A-law samples, or ADPCM blocks of 64 bytes; a checksum of the bytes
    says which. Null and empty texts are 64 zero bytes; repeated rows and equal doc_ids stay apart; other columns are
    dropped; an empty table gives an empty result.
    """

    def one(raw: bytes) -> bytes:
        payload = raw + b"\0" * (64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        tag, bits, block = FORMATS[zlib.crc32(payload) % len(FORMATS)]
        return wav_store(payload, tag, 8000, bits, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in utf8_chunks(batch):
                files = [one(data[at[k] : at[k + 1]].tobytes()) for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at).astype(np.int64)), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return id_text(docs).transform(map_arrow, run, "doc_id long, n_bytes long, media binary")


#: Columns that decode_media adds.
DECODED = StructType([StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType()), StructField("feature", StringType()), StructField("pcm", BinaryType())])


def decode_media(files: DataFrame, to_rate: int = 16000) -> DataFrame:
    """The rows of files (a column media: stored telephony files) with what is read back from them.

    payload_bytes, payload_sha256 and tail_crc32 are of the file's data, feature is of the decoded samples, and pcm is a WAV
    file of 16-bit PCM at to_rate, to be stored beside or instead of the first. Files that are null, broken or of another
    format have nulls there; other columns pass through. Files of up to TOGETHER bytes are decoded at once, or one longer;
    its samples are resampled by stretches.
    """
    names = files.columns
    at_media = names.index("media")
    if clash := set(names) & set(DECODED.names):
        raise ValueError(f"columns of the result are there already: {sorted(clash)}")

    def read(stored: bytes | None) -> tuple[int, int, int, bytes] | None:
        try:
            tag, rate, block, data = wav_read(stored or b"")
        except (ValueError, struct.error):
            return None
        known = tag in (MULAW, ALAW) or (tag == PCM and block == 2) or (tag == IMA_ADPCM and block >= 5)
        return (tag, rate, block, data) if known and rate else None

    def rows(some: list[bytes | None]) -> Iterator[tuple]:
        found = [read(x) for x in some]
        pcm = iter(decode_many([x for x in found if x is not None]))
        for x in found:
            if x is None:
                yield (None,) * len(DECODED)
                continue
            (_, rate, _, data), samples = x, next(pcm)
            yield len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), features(samples, rate), to_pcm_file(samples, rate, to_rate)

    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media, i = batch.column(at_media), 0
            while i < batch.num_rows:
                some, size = [], 0
                while i + len(some) < batch.num_rows and (not some or size < TOGETHER):
                    some.append(media[i + len(some)].as_py())
                    size += len(some[-1] or b"")
                part = batch.slice(i, len(some))
                made = [pa.array(c, t) for c, t in zip(zip(*rows(some)), types)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*names, *DECODED.names])
                i += len(some)

    return files.transform(map_arrow, run, StructType([*files.schema.fields, *DECODED.fields]))


def media_digests(files: DataFrame) -> DataFrame:
    """What the files of decode_media come to: sizes and digests in the place of media and pcm."""
    size, digest = lambda c: F.octet_length(c).cast("long"), lambda c: F.sha2(c, 256)
    return files.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        size("media").alias("media_bytes"), digest("media").alias("media_sha256"), "feature", size("pcm").alias("pcm_bytes"), digest("pcm").alias("pcm_sha256"),
    )
