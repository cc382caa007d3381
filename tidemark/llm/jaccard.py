"""Exact Jaccard join of word shingles by T-occurrence search.

A document's set has at least T = ceil(0.8 n) elements in common with any partner. DivideSkip sets the longest inverted
lists aside and merges the short ones, where a partner must still occur; long lists are then only probed. Over the corpus
short lists are made by taking pairs of elements that are neighbours in an order that puts frequent elements last: partners
share so many pairs that one is among the first of each. Candidates that share one form blocks, and each block is joined
exactly by DivideSkip.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import random
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import flat_gather, id_text, map_arrow, real_id, staged, utf8_chunks
from tidemark.llm.components import connected_components

#: Words of a shingle; similarity as a fraction.
WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5
#: Bytes of text whose words are hashed at once.
KERNEL_BYTES = 1 << 19
#: Frequent elements that are ordered last, at most; what is broadcast for them is 16 bytes each.
FREQUENT = 1 << 18
#: Count within one such run of documents from which an element is reported, and total from which it is frequent.
LOCAL, TOTAL = 3, 12
#: Elements after which a task's counts of frequent elements are taken.
COUNT_AT = 5_000_000
#: Elements of a block that one task joins; larger ones are dealt out as pairs of parts.
BLOCK = 3_000_000
#: Bits of the sieve for members of blocks: one megabyte to each task, whatever the corpus.
BITS = 1 << 23

#: Bytes of a word that are hashed eight at a time; longer words are hashed by BLAKE2.
SHORT_WORD = 64
#: Postings of short lists up to which they are merged by a heap; beyond, one array counts them for all members at once.
HEAP = 2_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SHIFT = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)) | np.uint64(1)


def blanks(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _words(data: np.ndarray, offsets: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of the first word of each document and of the end).

    A word's bytes go eight at a time into a chain of bijections that starts from its length and the seed, so no two words
    of up to eight bytes share a hash.
    """
    low = np.concatenate((_LOWER[data], np.zeros(8, np.uint8)))
    word = ~blanks(low[:-8])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(word & (np.concatenate(([True], ~word[:-1])) | edge[:-1]))
    end = np.flatnonzero(word & (np.concatenate((~word[1:], [True])) | edge[1:])) + 1
    size = end - start
    eight = np.ndarray(len(data) + 1, np.dtype("<u8"), low, strides=(1,))
    out = mix(size.astype(np.uint64) ^ np.uint64(seed))
    some = np.arange(len(start))
    for at in range(0, SHORT_WORD, 8):
        some = some[size[some] > at]
        if not len(some):
            break
        out[some] = mix(out[some] ^ (eight[start[some] + at] & _MASK[np.minimum(size[some] - at, 8)]))
    key = int(seed).to_bytes(8, "little")
    for i in some[size[some] > SHORT_WORD]:
        out[i] = int.from_bytes(hashlib.blake2b(low[start[i] : end[i]].tobytes(), digest_size=8, key=key).digest(), "little")
    return out, np.searchsorted(start, offsets)


def _long_words(data: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of one document's words, by stretches that end at white space."""
    out, at = [], 0
    while at < len(data):
        end = min(at + 2 * KERNEL_BYTES, len(data))
        while end < len(data):
            some = np.flatnonzero(blanks(data[end : end + KERNEL_BYTES]))
            if len(some):
                end += int(some[0])
                break
            end = min(end + KERNEL_BYTES, len(data))
        out.append(_words(data[at:end], np.array([0, end - at]), seed)[0])
        at = end
    return np.concatenate(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS, seed: int = 0) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each document's shingles; documents are data[offsets[i]:offsets[i + 1]]."""
    n = len(offsets) - 1
    out = [np.zeros(0, np.uint64)] * n
    if not len(data):
        return out
    if n == 1 and len(data) > 2 * KERNEL_BYTES:
        word = _long_words(data, seed)
        first = np.array([0, len(word)])
    else:
        word, first = _words(data, offsets, seed)
    counts = np.diff(first)
    if len(word) >= words:
        rows = len(word) - words + 1
        five = mix(sum(word[k : k + rows] * _SHIFT[k] for k in range(words)))
    for i in np.flatnonzero(counts):
        a, c = first[i], counts[i]
        out[i] = np.unique(five[a : a + c - words + 1]) if c >= words else mix((word[a : a + c] * _SHIFT[words : words + c]).sum(keepdims=True) + _SHIFT[40 + c : 41 + c])
    return out


def least_overlap(n: int) -> int:
    return -(-NUMERATOR * n // DENOMINATOR)


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    return int(mix(s ^ _SHIFT[62]).sum().view(np.int64)), int(mix(s + _SHIFT[63]).sum().view(np.int64))


def _sets(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for i, _, data, offsets in utf8_chunks(batch, limit=KERNEL_BYTES):
        yield i, shingle_sets(data, offsets, seed=seed)


def _describe(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, d1, d2, null, null) of each document, and (null..., element, count) of elements frequent in a task."""
    held: list[np.ndarray] = []
    size = 0

    def often() -> pa.RecordBatch:
        all_, count = np.unique(np.concatenate(held), return_counts=True)
        keep = count >= LOCAL
        none = pa.nulls(int(keep.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(all_[keep].view(np.int64)), pa.array(count[keep])], names)

    names = ["doc_id", "n", "d1", "d2", "element", "count"]
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for i, sets in _sets(batch, seed):
            rows = [(ids[i + k], len(s), *(digest(s) if len(s) else (None, None)), None, None) for k, s in enumerate(sets)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names)
            held += [s for s in sets if len(s)]
            size += sum(map(len, sets))
            if size > COUNT_AT:
                yield often()
                held.clear()
                size = 0
    if held:
        yield often()


def rarest(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """The first n elements in the corpus order: those that are not frequent by their hash, then the frequent by their count."""
    at = np.searchsorted(frequent, s)
    hot = (frequent[np.minimum(at, len(frequent) - 1)] == s) if len(frequent) else np.zeros(len(s), bool)
    cold = s[~hot]
    if len(cold) >= n:
        return cold[:n]
    late = s[hot]
    return np.concatenate((cold, late[np.argsort(rank[at[hot]], kind="stable")][: n - len(cold)]))


def _prefixes(frequent: np.ndarray, rank: np.ndarray, seed: int):
    """(doc_id, n, elements): the first pairs of neighbours of each set in the corpus order, once for equal sets of a task.

    Each element that one of two sets lacks parts at most one pair of common neighbours, so partners of sizes n and m share
    (n + m) / 3 - 1 pairs at least, and one of the first 2n / 5 + 1. Chance partners and those that share a passage have
    elements in common, but rarely neighbours. Sets of up to three elements have equal sets alone as partners.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, sets in _sets(batch, seed):
                rows = []
                for k, s in enumerate(sets):
                    if len(s) < 4 or (d := digest(s)) in seen:
                        continue
                    seen.add(d)
                    first = rarest(s, frequent, rank, 2 * len(s) // 5 + 2)
                    rows.append((ids[i + k], len(s), mix(first[:-1] * _SHIFT[60] + first[1:]).view(np.int64)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["doc_id", "n", "elements"])

    return run


def member_bits(ids: DataFrame, column: str) -> np.ndarray:
    """A bit for each doc_id modulo BITS; bounded, and only a first sieve: rows that pass are still joined by id."""
    at = F.pmod(F.col(column), F.lit(BITS))
    words = ids.select(F.floor(at / 64).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    bits = np.zeros(BITS // 64, np.int64)
    for r in words:
        bits[r["w"]] = r["b"]
    return bits.view(np.uint64)


def _only(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.column(0).to_numpy(zero_copy_only=False) % BITS
        some = batch.filter(pa.array((bits[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)).astype(bool)))
        if some.num_rows:
            yield some


def candidate_links(prefixes: DataFrame) -> DataFrame:
    """Links (a, b) whose components hold every pair that shares a short list and is of fitting size.

    A pair with k others before it leaves n - 1 - k to share, which bounds the partner's size: its reach. Pairs that reach
    no equal size only probe for smaller documents. In each list, sorted by size, a document is linked with the
    first indexed one of its stretch; a stretch ends where the next size is out of reach of all before. So a list gives one
    link a row, never its pairs.
    """
    rows = prefixes.select("doc_id", "n", F.posexplode("elements").alias("at", "element"))
    # a partner's size: what is left from here on must do for the overlap
    reach = F.floor(F.least(5 * F.col("n"), 8 * F.col("n") - 12 * F.col("at")) / 4).cast("long")
    rows = rows.select("element", "doc_id", "n", reach.alias("reach"), (reach < F.col("n")).cast("int").alias("late"))
    w = Window.partitionBy("element").orderBy("n", "late", "doc_id")
    before = F.max(F.when(F.col("late") == 0, F.col("reach"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select("*", before.alias("before"), F.lead("n").over(w).alias("after"), F.lag("n").over(w).alias("prior")).where("after is not null or prior is not null")
    near = F.coalesce(F.col("before") >= F.col("n"), F.lit(False))
    rows = rows.select("element", "doc_id", "n", "late", near.alias("near")).withColumn("stretch", F.sum(((F.col("late") == 0) & ~F.col("near")).cast("int")).over(w))
    root = F.first("doc_id").over(Window.partitionBy("element", "stretch").orderBy("n", "late", "doc_id"))
    rows = rows.withColumn("root", root).where(F.col("near") & (F.col("root") != F.col("doc_id")))
    return rows.select(F.greatest("doc_id", "root").alias("a"), F.least("doc_id", "root").alias("b")).distinct()


class Index:
    """Inverted lists of a block: members' elements, each list sorted by member."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        element = np.concatenate(sets)
        member = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(element, kind="stable")
        _, inverse, self.lengths = np.unique(element, return_inverse=True, return_counts=True)
        self.members = member[order]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.keys = np.repeat(np.arange(len(self.lengths)), self.lengths) * len(sets) + self.members
        self.lists = np.split(inverse, np.cumsum(self.sizes)[:-1])

    def search(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        """(members, overlap) of all members with at least T elements of x in common, by DivideSkip."""
        lists, least = self.lists[x], least_overlap(int(self.sizes[x]))
        lists = lists[np.argsort(self.lengths[lists], kind="stable")]
        lengths = self.lengths[lists]
        longest = int(lengths[-1])
        aside = min(least - 1, int(least / (0.0085 * math.log2(longest + 1) + 1)))  # of DivideSkip's published tuning
        short = len(lists) - aside
        least_short = least - aside
        if int(lengths[:short].sum()) <= HEAP:
            found, counts = merge_skip([self.members[a : a + n].tolist() for a, n in zip(self.starts[lists[:short]], lengths[:short])], least_short)
        else:
            counts = np.bincount(flat_gather(self.members, self.starts[lists[:short]], lengths[:short]), minlength=len(self.sizes))
            found = np.flatnonzero(counts >= least_short)
            counts = counts[found]
        long = lists[short:]
        if len(found) * len(long) * math.log2(len(self.keys) + 1) > int(lengths[short:].sum()):  # merging is the cheaper of the two
            counts = counts + np.bincount(flat_gather(self.members, self.starts[long], lengths[short:]), minlength=len(self.sizes))[found]
        else:
            probe = (long[:, None] * len(self.sizes) + found).reshape(-1)
            at = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
            counts = counts + (self.keys[at] == probe).reshape(len(long), len(found)).sum(0)
        keep = counts >= least
        return found[keep], counts[keep]


def merge_skip(lists: list[list[int]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, lists that hold them) of all members that least of the sorted lists hold, by a heap of their heads.

    Where too few heads are equal, the least - 1 smallest are taken off together: nothing before the next head can be held
    often enough, so those lists jump to it.
    """
    heap = [(x[0], i) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    place = [0] * len(lists)
    found, counts = [], []
    while len(heap) >= least:
        top, taken = heap[0][0], []
        while heap and heap[0][0] == top:
            taken.append(heapq.heappop(heap)[1])
        if len(taken) >= least:
            found.append(top)
            counts.append(len(taken))
            goal = top + 1
        else:
            taken += [heapq.heappop(heap)[1] for _ in range(least - 1 - len(taken))]
            goal = heap[0][0]
        for i in taken:
            place[i] = bisect_left(lists[i], goal, place[i])
            if place[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][place[i]], i))
    return np.array(found, np.int64), np.array(counts, np.int64)


def join_block(ids: np.ndarray, weights: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], two: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(smallest id reached, weight of linked members) of each member; with two, links within a part are left out."""
    index = Index(sets)
    parent = np.arange(len(ids))
    links = np.zeros(len(ids), np.int64)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for x in range(len(ids)):
        found, overlap = index.search(x)
        good = (DENOMINATOR * overlap >= NUMERATOR * (index.sizes[x] + index.sizes[found] - overlap)) & (found != x)
        if two:
            good &= parts[found] != parts[x]
        found = found[good]
        links[x] = weights[found].sum()
        for y in found[found > x]:
            a, b = root(x), root(int(y))
            if a != b:
                a, b = (a, b) if ids[a] < ids[b] else (b, a)
                parent[b] = a
    return np.array([ids[root(i)] for i in range(len(ids))]), links


def _join_blocks(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, i, j, part, doc_id, weight, text) sorted by (block, i, j): one block after another."""
    key, held = None, []

    def done() -> pa.RecordBatch:
        members = {d: (w, p, s) for d, w, p, s in held}
        ids = np.array(list(members), np.int64)
        w, p, sets = zip(*members.values())
        roots, links = join_block(ids, np.array(w, np.int64), np.array(p, np.int64), list(sets), key[1] != key[2])
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(roots), pa.array(links)], ["doc_id", "root", "links"])

    for batch in batches:
        block, i, j, part, ids, weight = (batch.column(k).to_pylist() for k in range(6))
        for at, sets in _sets(batch, seed):
            for k, s in enumerate(sets, at):
                if (now := (block[k], i[k], j[k])) != key:
                    if len(held) > 1:
                        yield done()
                    key, held = now, []
                held.append((ids[k], weight[k], part[k], s))
    if len(held) > 1:
        yield done()


def _members(links: DataFrame, classes: DataFrame) -> DataFrame:
    """class_id, n, weight, block and size (elements of the block) of the classes that links join into blocks."""
    blocks = connected_components(staged(links, "links"), "blocks").withColumnsRenamed({"id": "class_id", "root": "block"})
    found = staged(blocks.join(classes, "class_id").select("class_id", "n", "weight", "block"), "members")
    return found.join(found.groupBy("block").agg(F.sum("n").alias("size")), "block")


def jaccard_components(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links and class_id of every document.

    class_id is the smallest doc_id with the same set; component_id the smallest that links reach; n_links counts linked
    documents, copies included. Null and empty texts and those without words have an empty set and no link; texts of fewer
    words than a shingle are one element; rows that share a doc_id should share their text and get equal rows; a row without
    doc_id joins its group under a stand-in, which is null in the result; other columns are dropped; an empty table gives an
    empty result. Copies are one class before any text moves; frequent elements come
    last in the order, so that lists of passages that many documents share are short; blocks over block elements are joined
    in pairs of parts, each part meeting every other, so that nothing is capped.
    """
    d = id_text(docs, stand_in=True)
    seed = random.SystemRandom().getrandbits(64)  # no text can be written to collide with another; it changes no result
    described = staged(d.transform(map_arrow, lambda batches: _describe(batches, seed), "doc_id long, n long, d1 long, d2 long, element long, count long"), "described")
    meta = described.where("doc_id is not null").select("doc_id", "n", "d1", "d2")
    counts = staged(described.where("element is not null").groupBy("element").agg(F.sum("count").alias("count")).where(F.col("count") >= TOTAL), "counts")
    least, held = TOTAL, 0  # the smallest power of two above which there are few enough
    for r in counts.groupBy(F.floor(F.log2("count")).cast("int").alias("power")).count().orderBy(F.desc("power")).collect():
        held += r["count"]
        if held > FREQUENT:
            least = 2 << r["power"]
            break
    often = sorted((r["element"] % (1 << 64), r["count"]) for r in counts.where(F.col("count") >= least).collect())
    frequent, rank = np.array([e for e, _ in often], np.uint64), np.array([c for _, c in often], np.int64)
    classes = staged(meta.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("weight"), F.first("n").alias("n")), "classes")
    links = candidate_links(d.transform(map_arrow, _prefixes(frequent, rank, seed), "doc_id long, n long, elements array<long>"))
    of = meta.join(classes, ["d1", "d2"]).select("doc_id", "class_id").distinct()
    for end in ("a", "b"):
        links = links.join(of.select(F.col("doc_id").alias(end), F.col("class_id").alias(f"class_{end}")), end)
    members = _members(links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")), classes)
    parts = F.when(F.col("size") <= block, 1).otherwise(F.ceil(2 * F.col("size") / block).cast("int"))
    members = staged(members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int")), "members")
    # a part meets every other one, and itself
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = members.select(F.col("class_id").alias("doc_id"), "block", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "weight")
    bits = member_bits(members, "class_id")
    rows = d.transform(map_arrow, lambda batches: _only(batches, bits), "doc_id long, text string").join(rows, "doc_id").select("block", "i", "j", "part", "doc_id", "weight", "text")
    rows = rows.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j")
    joined = staged(rows.transform(map_arrow, lambda batches: _join_blocks(batches, seed), "doc_id long, root long, links long"), "joined")
    links = joined.groupBy("doc_id").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("root").alias("last"))
    if joined.groupBy("doc_id").count().where("count > 1").head(1):
        roots = connected_components(joined.select(F.col("doc_id").alias("a"), F.col("root").alias("b")), "roots").withColumnRenamed("id", "doc_id")
        links = links.select("doc_id", "links").join(roots, "doc_id", "left")
    links = links.select(F.col("doc_id").alias("class_id"), "links", "root")
    known = classes.join(links, "class_id", "left").select("d1", "d2", "class_id", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "class_id").alias("root"))
    out = meta.join(known, ["d1", "d2"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"), F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.select(real_id("doc_id"), "n_shingles", real_id("component_id"), "n_links", real_id("class_id"))
