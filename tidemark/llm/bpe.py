"""BPE with public tokenizers: cached units, tree concatenation for long unsplit text, decoding by token bytes."""

from __future__ import annotations

import contextlib
import hashlib
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import flat_gather, id_text, map_arrow, texts

#: Units that a worker remembers; beyond them it starts anew, so its memory stays bounded.
CACHE_UNITS = 300_000
#: Characters of unsplit text that are encoded whole; longer ones are halved.
LEAF = 64
#: Leaves of unsplit text from which threads share the work of a level, and those threads.
WIDE, THREADS = 1 << 10, 4
#: White space of the tokenizer's patterns (fixed values of Unicode), to which Python's would add the separators 1C to 1F.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Split pattern of the byte-level vocabulary (a fixed value of the tokenizer).
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizers library's tokenizer of a file, without truncation or padding; one a worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
    return _loaded[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Units:
    """Ids of text units, looked up by a dict and kept in one flat array."""

    def __init__(self, encode_many):
        self.encode_many = encode_many
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.starts, self.lengths, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self.flat = np.zeros(4096, np.uint32)

    def add(self, units: list[str]) -> None:
        ids, lengths = self.encode_many(units)
        n, k = len(self.slot), len(units)
        while n + k > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.lengths[n : n + k] = lengths
        self.starts[n : n + k] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.slot.update(zip(units, range(n, n + k)))

    def ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in a row, number of ids of each)."""
        at = np.fromiter(map(self.slot.get, units, repeat(-1)), np.int64, len(units))
        miss = np.flatnonzero(at < 0)
        if len(miss):
            if len(self.slot) > CACHE_UNITS:
                self.clear()
                miss = np.arange(len(units))
            new = [units[i] for i in miss.tolist()]
            self.add(list(dict.fromkeys(new)))
            at[miss] = list(map(self.slot.__getitem__, new))
        lengths = self.lengths[at]
        return flat_gather(self.flat, self.starts[at], lengths), lengths


def join(left: list[int], right: list[int], encode, raw: list[bytes], window: int = 4) -> list[int]:
    """Ids of the joined text, of which left and right are the ids of its two parts.

    Tokens around the join are encoded anew, in growing windows, until the first new one is left's and the last is right's.
    Every neighbouring pair is then one that an encoding holds, and a sequence of such pairs is the encoding of its text.
    """
    while True:
        a, b = min(window, len(left)), min(window, len(right))
        try:
            text = b"".join(raw[i] for i in left[len(left) - a :] + right[:b]).decode()
        except UnicodeDecodeError:  # a window may not end inside a character
            if a == len(left) and b == len(right):
                raise
            window += 1
            continue
        new = encode(text)
        if (a == len(left) or new[0] == left[-a]) and (b == len(right) or new[-1] == right[b - 1]):
            return left[: len(left) - a] + new + right[b:]
        window *= 2


def tree_encode(text: str, encode, raw: list[bytes], encode_batch=None, leaf: int = LEAF, wide: int = WIDE) -> list[int]:
    """Ids of one unsplit text: leaves are encoded, then each level of the tree joins its pairs of halves.

    The halves of a level do not depend on one another: from wide leaves on, threads share them. The tokenizers library
    leaves the interpreter to other threads while it encodes.
    """
    parts = [text[i : i + leaf] for i in range(0, len(text), leaf)]
    encode_batch = encode_batch or (lambda some: [encode(p) for p in some])

    def pair(halves: list[list[int]]) -> list[int]:
        return join(*halves, encode, raw) if len(halves) == 2 else halves[0]

    with ThreadPoolExecutor(THREADS) if len(parts) >= wide else contextlib.nullcontext() as pool:
        each = pool.map if pool else map
        groups = [parts[i : i + wide] for i in range(0, len(parts), wide)]
        level = [ids for some in each(encode_batch, groups) for ids in some]
        while len(level) > 1:
            level = list(each(pair, [level[i : i + 2] for i in range(0, len(level), 2)]))
    return level[0] if level else []


class ByteBPE:
    """Encodes and decodes like the tokenizers library with a byte-level vocabulary.

    A text is cut before each space that a non-space follows: the split pattern always starts there anew, and what stands
    before is split as if the text ended. Unsplit units over LEAF characters are encoded by tree concatenation. The string
    of an added token is a unit of its own, and parts the text as if it ended there.
    """

    def __init__(self, path: str):
        import regex

        self.t = tokenizer(path)
        added = self.t.get_added_tokens_decoder()
        self.special = {x.content: i for i, x in added.items()}
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if added else lambda text: [text]
        self.split = regex.compile(PATTERN)
        self.cut = regex.compile(f"(?= [^{SPACE}])")
        self.odd = regex.compile(f" (?:[{SPACE}]|$)")
        to_byte = {chr(c): b for c, b in _byte_chars()}
        n = self.t.get_vocab_size(with_added_tokens=True)
        self.raw = [bytes(to_byte[c] for c in self.t.id_to_token(i)) if i not in added else added[i].content.encode() for i in range(n)]
        self.lengths = np.array([len(x) for x in self.raw], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.units = Units(self._many)

    def _encode(self, text: str) -> list[int]:
        return self.t.encode(text, add_special_tokens=False).ids

    def _batch(self, parts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.t.encode_batch_fast(parts, add_special_tokens=False)]

    def _long(self, unit: str) -> list[int]:
        ids: list[int] = []
        for piece in self.split.findall(unit):
            ids += tree_encode(piece, self._encode, self.raw, self._batch) if len(piece) > LEAF else self._encode(piece)
        return ids

    def _many(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units that start with a space and a non-space are encoded as one text and cut again by their bytes."""
        joined = [u for u in units if len(u) <= LEAF and u[:1] == " " and not u[1:2].isspace() and len(u) > 1]
        got: dict[str, np.ndarray] = {u: np.array([self.special[u]], np.int64) for u in units if u in self.special}
        for i in range(0, len(joined), 2000):
            some = joined[i : i + 2000]
            ids = np.array(self._batch(["".join(some)])[0], np.int64)
            ends = np.cumsum([len(u.encode()) for u in some])
            at = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
            got |= zip(some, np.split(ids, at[:-1]))
        single = [u for u in units if u not in got]
        for u, ids in zip(single, self._batch([u if len(u) <= LEAF else "" for u in single])):
            got[u] = np.array(ids if len(u) <= LEAF else self._long(u), np.int64)
        each = [got[u] for u in units]
        return (np.concatenate(each) if each else np.zeros(0, np.int64)).astype(np.uint32), np.array([len(x) for x in each], np.int64)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_texts([text])[0]

    def encode_texts(self, many: list[str]) -> list[np.ndarray]:
        units: list[str] = []
        ends: list[int] = []
        for text in many:
            for part in self.apart(text) if any(x in text for x in self.special) else (text,):
                if part in self.special:
                    units.append(part)
                elif self.odd.search(part):
                    units += self.cut.split(part)
                elif part:
                    first, *rest = part.split(" ")
                    if first:
                        units.append(first)
                    units += [" " + x for x in rest]
            ends.append(len(units))
        ids, lengths = self.units.ids(units)
        at = np.concatenate(([0], np.cumsum(lengths)))[np.array([0, *ends])]
        return [ids[at[k] : at[k + 1]] for k in range(len(many))]

    def decode(self, ids: np.ndarray) -> str:
        """The library's decode with skip_special_tokens=False: bytes of all ids, invalid UTF-8 replaced."""
        ids = np.asarray(ids, np.int64)
        return flat_gather(self.bytes, self.starts[ids], self.lengths[ids]).tobytes().decode("utf-8", "replace")


def _byte_chars() -> list[tuple[int, int]]:
    """(code point, byte): printable bytes stand for themselves, the others follow from 256 on, as byte-level BPE has it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [(b, b) for b in plain] + [(256 + i, b) for i, b in enumerate(rest)]


def _ranks(path: str):
    """(bytes to ranks, ids by rank) of a word vocabulary's file: single bytes, single bytes that end a word, then its merges."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    chars = [(chr(c), bytes([b])) for c, b in _byte_chars()]
    byte = dict(chars)
    end = model["end_of_word_suffix"]
    plain = lambda t: b"".join(byte[c] for c in t.removesuffix(end)) + b"\xff" * t.endswith(end)
    tokens = [t + e for e in ("", end) for t, _ in chars] + ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ranks = {plain(t): i for i, t in enumerate(tokens)}
    encoding = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    return encoding._core_bpe.encode_single_piece, np.array([model["vocab"][t] for t in tokens], np.int64)


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordBPE:
    """Encodes like the tokenizers library with a vocabulary of lower-case words whose tokens never cross white space.

    Texts of Latin letters are lower-cased before they are split, as the tokenizer does itself later: fewer distinct units
    are left to encode. Plain words are merged by tiktoken with ranks made from the file's merges, where byte 255, which
    UTF-8 lacks, stands for the end of a word; a full stop or comma after one is a piece of its own.
    """

    def __init__(self, path: str):
        self.t = tokenizer(path)
        self.plain = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
        self.merge, self.id_of = _ranks(path)
        self.stops = {c: self.merge(c.encode() + b"\xff") for c in ".,"}
        self.units = Units(self._many)

    def _many(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Plain words by their merges; the others as one text that is cut again by the places of its tokens."""
        got: dict[str, list[int]] = {}
        flat: list[int] = []
        counts = np.zeros(len(units), np.int64)
        hard = [u for u in units if not self.plain(u[:-1] if u[-1] in ".," and len(u) > 1 else u)]
        for i in range(0, len(hard), 2000):
            some = hard[i : i + 2000]
            found = self.t.encode(" ".join(some), add_special_tokens=False)
            place = np.searchsorted(np.cumsum([len(u) + 1 for u in some]), np.array([a for a, _ in found.offsets], np.int64), "right")
            ends = np.cumsum(np.bincount(place, minlength=len(some)))
            got |= zip(some, (x.tolist() for x in np.split(np.array(found.ids, np.int64), ends[:-1])))
        known = len(self.id_of)
        for k, u in enumerate(units):
            if u in got:
                ids = [known + x for x in got[u]]
            elif u[-1] in self.stops:
                ids = self.merge(u[:-1].encode() + b"\xff") + self.stops[u[-1]]
            else:
                ids = self.merge(u.encode() + b"\xff")
            flat += ids
            counts[k] = len(ids)
        every = np.concatenate((self.id_of, np.arange(max(flat, default=0) + 1 - known if flat and max(flat) >= known else 0)))
        return every[np.array(flat, np.int64)].astype(np.uint32), counts

    def encode_texts(self, many: list[str]) -> list[np.ndarray]:
        units: list[str] = []
        ends: list[int] = []
        whole: dict[int, np.ndarray] = {}
        for k, text in enumerate(many):
            if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # white space to Python alone
                whole[k] = np.array(self.t.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                units += (text.lower() if "<|" not in text and _latin(text) else text).split()
            ends.append(len(units))
        ids, lengths = self.units.ids(units)
        at = np.concatenate(([0], np.cumsum(lengths)))[np.array([0, *ends])]
        return [whole[k] if k in whole else ids[at[k] : at[k + 1]] for k in range(len(many))]


_codecs: dict[tuple[type, str], object] = {}


def codec(kind: type, path: str):
    """One codec a worker, kept over its tasks."""
    if (kind, path) not in _codecs:
        _codecs[kind, path] = kind(path)
    return _codecs[kind, path]


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids and decoded of every text.

    Null texts are empty; empty texts have no ids and an empty decoded text; repeated rows stay apart; other columns are
    dropped; an empty table gives an empty result. A worker holds the texts of one run of rows and its bounded cache.
    """
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ByteBPE, path)
        for batch in batches:
            ids = batch.column(0)
            for i, many in texts(batch):
                rows = []
                for x in c.encode_texts(many):
                    back = c.decode(x)
                    rows.append((len(x), hashlib.sha256(x.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), *((x.astype(np.int32), back) if keep_ids else ())))
                types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                columns = [ids.slice(i, len(many)), *(pa.array(list(x), t) for x, t in zip(zip(*rows), types))]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in kind.split(", ")])

    return id_text(docs).transform(map_arrow, run, kind)
