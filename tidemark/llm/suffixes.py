"""Repeated byte strings of a threshold length, by a depth-limited radix sort of suffixes.

Only the first `length` bytes of a suffix count. The first digit of a suffix is an anchor: the smallest of the hashed grams
of GRAM bytes that lie within those bytes, so equal suffixes have equal anchors at equal distances, and neighbouring
suffixes share one. A run of neighbours with one anchor is dealt as one key, in one shuffle; groups of one are done, and
runs that are equal as a whole are repeated as a whole. Runs that share an anchor but differ are sorted by their suffixes'
bytes, most significant digit (of eight bytes) first, to the depth of `length` bytes: each pass splits the groups of the
one before and drops those of one. Groups that are left are exactly the repeated strings.

Whole runs, and suffixes of groups too large to sort together, are compared by a polynomial modulo 2^61 - 1 whose base is
drawn for each call, so texts cannot be made to collide: two that differ agree with a chance of their length over 2^61.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import id_text, keyed, map_arrow, real_id, staged, utf8_chunks
from tidemark.llm.jaccard import mix

#: Bytes of a repeated string, and of a gram.
LENGTH, GRAM = 200, 64
#: Bytes whose suffixes are hashed at once.
KERNEL_BYTES = 1 << 19
#: Runs of a task that are compared before the shuffle.
COMBINE = 250_000
#: Bytes of runs whose suffixes are sorted at once in the last pass, and of a group beyond which it goes by single suffixes.
SORT_BYTES, LAST_BYTES = 1 << 20, 8 << 20

#: Modulus of the hashes that decide, and of the anchors' hashes (2^64) the base and the seed of the byte values.
PRIME = np.uint64((1 << 61) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_steps: list[np.ndarray] = []


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def _shift32(x: np.ndarray) -> np.ndarray:
    """x * 2^32 modulo PRIME, not reduced."""
    return (x >> np.uint64(29)) + ((x & np.uint64((1 << 29) - 1)) << np.uint64(32))


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME for numbers below it: in halves of 32 bits, as 2^61 is 1."""
    low, up = np.uint64(0xFFFFFFFF), np.uint64(32)
    al, ah, bl, bh = a & low, a >> up, b & low, b >> up
    first = al * bl
    return _reduce((first & PRIME) + (first >> np.uint64(61)) + _shift32(al * bh + ah * bl) + ((ah * bh) << np.uint64(3)))


def _series(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... modulo PRIME, n at least."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, multiply(out, np.uint64(pow(base, len(out), int(PRIME))))))
    return out


def draw_base() -> int:
    return random.SystemRandom().randrange(1 << 40, int(PRIME))


class Strong:
    """Hashes modulo PRIME of any stretches of one byte array."""

    def __init__(self, data: np.ndarray, base: int):
        if base not in _powers or len(_powers[base][0]) <= len(data):
            _powers.clear()
            _powers[base] = tuple(_series(b, len(data) + 1) for b in (base, pow(base, -1, int(PRIME))))
        up, self.down = _powers[base]
        up, byte = up[: len(data)], data.astype(np.uint64) + np.uint64(1)
        zero = np.zeros(1, np.uint64)
        # sums of halves stay below 2^64 for arrays below 2^23 bytes
        self.high, self.low = (np.concatenate((zero, np.cumsum(byte * half))) for half in (up >> np.uint64(32), up & np.uint64(0xFFFFFFFF)))

    def __call__(self, start: np.ndarray, size) -> np.ndarray:
        end = start + size
        return multiply(_reduce(_shift32(self.high[end] - self.high[start]) + _reduce(self.low[end] - self.low[start])), self.down[start])


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every size bytes; equal hashes of different grams only join groups that a later digit parts."""
    if not _steps or len(_steps[0]) < len(data):
        most = max(1 << 16, 1 << len(data).bit_length())
        _steps[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(most, b, np.uint64)))) for b in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))]
    up, down = _steps
    total = np.concatenate(([np.uint64(0)], np.cumsum(_TABLE[data] * up[: len(data)])))
    n = len(total) - size
    return mix((total[size:] - total[:n]) * down[:n] + np.uint64(size))


def runs(data: np.ndarray, offsets: np.ndarray, base: int, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, hash of the run's bytes, document, first suffix, last suffix) of each run, places within the document."""
    none = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    if len(data) < length or sizes.max(initial=0) < length:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    hashed = grams(data, gram)
    key = (hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashed), dtype=np.uint64)
    width = length - gram + 1  # grams of a suffix
    pad = -len(key) % width
    rows = np.concatenate((key, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF)))).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].reshape(-1)
    count = len(data) - length + 1
    anchor = (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(count + 1, bool)
    long = np.flatnonzero(sizes >= length)
    turn = np.zeros(count + 1, np.int64)
    np.add.at(turn, offsets[long], 1)
    np.add.at(turn, offsets[long] + sizes[long] - length + 1, -1)
    inside = np.cumsum(turn)[:count] > 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    begins = np.zeros(count + 1, bool)
    begins[offsets[long]] = True
    new |= begins[:count] & inside
    low = np.flatnonzero(new)
    stop = np.zeros(count, bool)
    stop[:-1] = inside[:-1] & (~inside[1:] | new[1:])
    stop[-1] = inside[-1]
    high = np.flatnonzero(stop)
    document = np.searchsorted(offsets, low, "right") - 1
    a = anchor[low]
    whole = Strong(data, base)(low, high - low + length) + mix((a - low).astype(np.uint64) + np.uint64(7))
    return hashed[a], whole, document, low - offsets[document], high - offsets[document]


def _runs(length: int, gram: int, base: int):
    """Rows (anchor, whole, doc_id, low, more) of a task; from the third run on that is equal within the task it is known as repeated: whole is null."""
    names = ["anchor", "whole", "doc_id", "low", "more"]

    def combined(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        anchor, whole, ids, low, more = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((whole, anchor))
        same = np.zeros(len(order), bool)
        x, y = anchor[order], whole[order]
        same[2:] = (x[2:] == x[:-2]) & (y[2:] == y[:-2])
        known = np.zeros(len(order), bool)
        known[order] = same
        anchor = np.where(known, mix(ids.view(np.uint64) + low.astype(np.uint64)), anchor)
        return pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64), mask=known), pa.array(ids), pa.array(low.astype(np.int32)), pa.array(more.astype(np.int32))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, offsets in utf8_chunks(batch, limit=KERNEL_BYTES):
                # a longer document goes by stretches; a run that is cut there is only another run
                for at in range(0, max(1, len(data) - length + 1), 2 * KERNEL_BYTES):
                    part = data[at : at + 2 * KERNEL_BYTES + length - 1] if len(data) > 2 * KERNEL_BYTES else data
                    anchor, whole, document, low, high = runs(part, offsets if part is data else np.array([0, len(part)]), base, length, gram)
                    held.append((anchor, whole, ids[i + document], low + at, high - low))
                    size += len(low)
                if size > COMBINE:
                    yield combined(held)
                    held, size = [], 0
        if size:
            yield combined(held)

    return run


def _contexts(length: int):
    """(anchor, doc_id, low, bytes) of runs whose document's text stands beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2).to_pylist()
            rows = []
            for k, (doc_id, text) in enumerate(zip(batch.column(0), batch.column(1))):
                data = text.as_buffer().to_pybytes()
                rows += [(x["anchor"], doc_id.as_py(), x["low"], data[x["low"] : x["low"] + x["more"] + length]) for x in wanted[k]]
                if len(rows) > 20_000:
                    yield _context_batch(rows)
                    rows = []
            if rows:
                yield _context_batch(rows)

    return run


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["anchor", "doc_id", "low", "bytes"])


def suffixes_of(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all pieces, start, piece, place) of every suffix of the pieces that has length bytes."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    count = sizes - length + 1
    piece = np.repeat(np.arange(len(pieces)), count)
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.frombuffer(b"".join(pieces), np.uint8), (np.cumsum(sizes) - sizes)[piece] + place, piece, place


def radix_groups(data: np.ndarray, start: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Whether another suffix of the same group has the same depth bytes: most significant digits of eight bytes first.

    A pass sorts only groups whose suffixes differ in its digit, splits them and drops those of one suffix.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, np.dtype(">u8"), padded, strides=(1,))
    order = np.argsort(group, kind="stable")
    new = np.concatenate(([True], np.diff(group[order]) != 0))
    for at in range(0, depth, 8):
        single = new & np.concatenate((new[1:], [True]))
        order, new = order[~single], new[~single]
        if not len(order):
            break
        digit = eight[start[order] + at].astype(np.uint64)
        if depth - at < 8:
            digit >>= np.uint64(8 * (8 - depth + at))
        change = np.concatenate(([False], digit[1:] != digit[:-1])) & ~new
        if not change.any():
            continue
        number = np.cumsum(new) - 1
        mixed = np.bincount(number, change)[number] > 0
        some = np.flatnonzero(mixed)
        by = np.lexsort((digit[some], number[some]))
        order[some], digit[some] = order[some[by]], digit[some[by]]
        new = new | np.concatenate(([False], digit[1:] != digit[:-1]))
    single = new & np.concatenate((new[1:], [True]))
    out = np.zeros(len(start), bool)
    out[order[~single]] = True
    return out


def _last_pass(length: int):
    """Repeated stretches (doc_id, low, end) of whole groups that follow one another, sorted by anchor."""

    def found(held: list[tuple]) -> pa.RecordBatch | None:
        anchors, ids, lows, pieces = zip(*held)
        data, start, piece, place = suffixes_of(list(pieces), length)
        at = np.flatnonzero(radix_groups(data, start, np.array(anchors, np.int64)[piece], length))
        if not len(at):
            return None
        new = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(piece[at]) != 0)))
        a, b = at[new], at[np.concatenate((new[1:], [True]))]
        low = np.array(lows, np.int64)[piece[a]] + place[a]
        end = np.array(lows, np.int64)[piece[b]] + place[b] + length
        return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[piece[a]]), pa.array(low.astype(np.int32)), pa.array(end.astype(np.int32))], ["doc_id", "low", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > SORT_BYTES and held and row[0] != held[-1][0]:
                    if (out := found(held)) is not None:
                        yield out
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held and (out := found(held)) is not None:
            yield out

    return run


def _explode(length: int, base: int):
    """(anchor, key, doc_id, low) of every suffix of the runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                data, start, piece, place = suffixes_of(part.column(3).to_pylist(), length)
                key = Strong(data, base)(start, np.int64(length))
                take = lambda k: part.column(k).to_numpy(zero_copy_only=False)[piece]
                yield pa.RecordBatch.from_arrays([pa.array(take(0)), pa.array(key.view(np.int64)), pa.array(take(1)), pa.array((take(2) + place).astype(np.int32))], ["anchor", "key", "doc_id", "low"])

    return run


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes; stretches that touch are one."""
    out: list[list[int]] = []
    for low, end in sorted(stretches):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([low, end])
    return [tuple(x) for x in out]


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, low, end): byte stretches that cover exactly the strings of length bytes that start elsewhere too.

    docs: doc_id, text. Runs that a task holds thrice or more are combined before the shuffle, so a passage in a third of all
    documents sends two rows a task and anchor. Anchors whose runs differ beyond LAST_BYTES are split into single suffixes
    and counted by hash instead of being held together.
    """
    base = draw_base()
    found = docs.transform(map_arrow, _runs(length, gram, base), "anchor long, whole long, doc_id long, low int, more int")
    w = Window.partitionBy("anchor").orderBy("whole", "doc_id", "low")
    near = {"before": F.lag, "after": F.lead}
    found = found.select("*", *(f(c).over(w).alias(f"{k}_{c}") for k, f in near.items() for c in ("whole", "doc_id")))
    twice = F.coalesce(F.col("whole").isNull() | (F.col("before_whole") == F.col("whole")) | (F.col("after_whole") == F.col("whole")), F.lit(False))
    others = F.col("before_doc_id").isNotNull() | F.col("after_doc_id").isNotNull()
    # of equal runs, one that stands beside another kind of its anchor speaks for them in the last pass
    speaks = F.coalesce(F.col("before_whole") != F.col("whole"), F.lit(False)) | F.coalesce(F.col("after_whole") != F.col("whole"), F.lit(False))
    found = staged(found.where(twice | others).select("anchor", "doc_id", "low", "more", twice.alias("twice"), (F.col("whole").isNotNull() & (~twice | speaks)).alias("asks")).where("twice or asks"), "runs")
    whole = found.where("twice").select("doc_id", "low", (F.col("low") + F.col("more") + length).cast("int").alias("end"))
    asks = found.where("asks").select("anchor", "doc_id", "low", "more")
    some = asks.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "low", "more")).alias("asks"))
    contexts = staged(docs.join(some, "doc_id").select("doc_id", "text", "asks").transform(map_arrow, _contexts(length), "anchor long, doc_id long, low int, bytes binary"), "contexts")
    large = contexts.groupBy("anchor").agg(F.sum(F.length("bytes")).alias("size")).where(F.col("size") > LAST_BYTES).select("anchor")
    kind = "doc_id long, low int, end int"
    if not large.head(1):
        last = contexts.repartition("anchor").sortWithinPartitions("anchor").transform(map_arrow, _last_pass(length), kind)
        return whole.union(last)
    large = staged(large, "large")
    last = contexts.join(large, "anchor", "left_anti").select("anchor", "doc_id", "low", "bytes").repartition("anchor").sortWithinPartitions("anchor").transform(map_arrow, _last_pass(length), kind)
    single = staged(contexts.join(large, "anchor", "left_semi").select("anchor", "doc_id", "low", "bytes").transform(map_arrow, _explode(length, base), "anchor long, key long, doc_id long, low int"), "single")
    again = single.groupBy("anchor", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", "key")
    single = single.join(again, ["anchor", "key"], "left_semi").select("doc_id", "low", (F.col("low") + length).cast("int").alias("end"))
    return whole.union(last).union(single)


def _removed(keep_text: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"][: 6 if keep_text else 5]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                data = batch.column(1)[k].as_buffer().to_pybytes()
                low, end = batch.column(2)[k], batch.column(3)[k]
                spans = merged(list(zip(low.as_py(), end.as_py()))) if low.is_valid else []
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                rows.append((batch.column(0)[k].as_py(), len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t, _ in zip(zip(*rows), types, names)], names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """Remove each byte that a string of length bytes covers which starts elsewhere too; strings are judged on the input.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, text (what remains, characters that were
    cut apart dropped). Null texts are empty; texts shorter than length lose nothing; equal texts and repeated rows of
    length bytes or more lose everything; rows that share a doc_id should share their text; a row without doc_id is treated
    like any other; other columns are dropped; an empty table gives an empty result. Matches never cross documents.
    """
    d = id_text(docs, stand_in=True)
    spans = repeated(d, length, gram).groupBy("doc_id").agg(F.collect_list("low").alias("low"), F.collect_list("end").alias("end"))
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * keep_text
    out = d.join(spans, "doc_id", "left").select("doc_id", "text", "low", "end").transform(map_arrow, _removed(keep_text), kind)
    return out.withColumn("doc_id", real_id("doc_id"))


def strip_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The rows of docs with the bytes removed that remove_repeats removes; cut characters go, n_chars follows the text.

    Stretches go by a key of the row, so that rows which share a doc_id but not their text lose their own bytes alone, and a
    row without doc_id is treated like any other. Every row stays: a null text stays null, a text that is repeated whole
    becomes empty; columns of any other name pass through; an empty table gives an empty result.
    """
    rows = keyed(docs)
    spans = repeated(id_text(rows.select(F.col("key").alias("doc_id"), F.col("doc.text").alias("text"))), length, gram)
    spans = spans.groupBy(F.col("doc_id").alias("key")).agg(F.sort_array(F.collect_list(F.struct("low", "end"))).alias("spans"))
    joined = rows.join(spans, "key", "left").select("doc", "spans")
    names = docs.columns
    at_text, at_chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, found = batch.column(0).flatten(), batch.column(1).to_pylist()
            out = []
            for spans, text in zip(found, columns[at_text]):
                if spans is None or not text.is_valid:
                    out.append(text.as_py())
                    continue
                data, kept, at = text.as_buffer().to_pybytes(), [], 0
                for a, b in merged([(x["low"], x["end"]) for x in spans]):
                    kept.append(data[at:a])
                    at = b
                out.append(b"".join([*kept, data[at:]]).decode("utf-8", "ignore"))
            columns[at_text] = pa.array(out, columns[at_text].type)
            if at_chars is not None:
                columns[at_chars] = pa.array([n if x is None else len(t) for n, x, t in zip(columns[at_chars].to_pylist(), found, out)], columns[at_chars].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.transform(map_arrow, run, docs.schema)
