"""Personal data: patterns, and a linear-chain CRF over word shapes that adds spans they miss."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import id_text, map_arrow, texts

#: Kinds in the order of the output; the last only by the CRF.
KINDS = ("email", "ip", "card", "phone", "id")
#: Labels: outside, then begin and inside of the kinds that the CRF finds.
FOUND = ("phone", "id")
LABELS = ("O", *(f"{p}-{k}" for k in FOUND for p in "BI"))
#: Buckets of the hashed features.
BUCKETS = 1 << 12

LOCAL, HOST = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MAYBE = re.compile(r"[0-9@]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(int(d) if i % 2 == 0 else doubled[int(d)] for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by patterns: leftmost, not overlapping within a kind; matches that fail their test are dropped."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if m := HOST.match(text, at):
            start = at
            while start > end and LOCAL.match(text, start - 1):
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                end = m.end()
                at = m.end() - 1
        at = text.find("@", at + 1)
    if MAYBE.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


PART = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)


def shape(word: str) -> str:
    """Runs of digits by their length (9: nine or more), of letters by one letter; other characters stay."""
    return PART.sub(lambda m: str(min(9, len(m[0]))) if "0" <= m[0][0] <= "9" else "a" if m[0][0].isalpha() else m[0], word)


def features(before: str, word: str, after: str) -> np.ndarray:
    """Buckets of a token's features: its shape, its neighbours' and what it starts and ends with."""
    s = shape(word)
    digits = sum(c.isdigit() for c in word)
    names = (f"s={s}", f"d={min(digits, 16)}", f"p={shape(before)}", f"n={shape(after)}", f"ps={shape(before)}|{s}", f"sn={s}|{shape(after)}", f"e={s[:1]}{s[-1:]}", f"w={before.lower().strip('.,:#')}")
    return np.array([zlib.crc32(x.encode()) % BUCKETS for x in names], np.int64)


#: Templates of the labelled table: words, and {kind} where an entity stands. Fixed values.
SENTENCES = (
    "call me on {phone} tomorrow", "phone {phone} for the desk", "tel {phone} or write", "reach us at {phone} now", "mobile {phone} fax {phone}", "text {phone} before noon", "his number is {phone} as said",
    "ssn {id} is on file", "the id {id} was issued", "number {id} on the card", "social security {id} of the owner", "tax id {id} given",
    "order {idlike} was shipped", "invoice {idlike} is due", "part {idlike} fits", "ref {idlike} of the file", "item {idlike} sold", "lives in {zip} since", "zip {zip} there", "town {zip}", "iban {iban} at the bank", "pay to {iban} now", "account {iban}", "from {range} we stayed", "model {idlike} runs", "ticket {phonelike} is open", "batch {phonelike} was lost", "serial {phonelike}",
    "the total was {plain} last year", "in {plain} we met", "page {plain} of the book", "{plain} people came", "version {plain} is out", "it cost {plain} euros", "see {plain} and {plain} there", "a code {plain} was found", "{plain}",
)


def labelled_table(rows: int = 1200, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """Small table of (tokens, labels), from templates with numbers drawn by a fixed seed."""
    rnd, out = random.Random(seed), []
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    make = {
        "phone": lambda: rnd.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)} {d(3)}-{d(4)}"]),
        "id": lambda: f"{d(3)}-{d(2)}-{d(4)}",
        "idlike": lambda: f"{d(3)}-{d(2)}-{d(4)}",
        "phonelike": lambda: rnd.choice([f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)}-{d(4)}"]),
        "zip": lambda: rnd.choice([f"{d(5)}-{d(4)}", d(5), f"{d(5)}-{d(3)}"]),
        "iban": lambda: rnd.choice(["DE", "FR", "GB", "ES", "NL"]) + d(2) + " " + " ".join(d(4) for _ in range(rnd.randint(3, 5))) + rnd.choice(["", f" {d(2)}", f" {d(1)}"]),
        "range": lambda: rnd.choice([f"{d(4)}-{d(4)}", f"{d(2)}-{d(2)}", f"{d(3)}-{d(3)}"]),
        "plain": lambda: rnd.choice([d(rnd.randint(1, 14)), f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(2)}:{d(2)}", f"{d(1)}.{d(2)}", f"{d(2)},{d(3)}", f"{d(3)}$$$", f"v{d(1)}.{d(1)}.{d(2)}", f"a{d(3)}b{d(8)}f", f"{d(3)}%", f"{d(4)} {d(4)}", f"{d(3)}-{d(3)}", f"{d(2)} {d(2)}", f"{d(5)} {d(3)}", "%0*x" % (n := rnd.randint(8, 40), rnd.getrandbits(4 * n)), "%0*x" % (16, rnd.getrandbits(64))]),
    }
    for i in range(rows):
        tokens, labels = [], []
        for part in SENTENCES[i % len(SENTENCES)].split():
            kind = part.strip("{}")
            new = make[kind]().split() if kind != part else [part]
            tokens += new
            labels += ["O"] * len(new) if kind == part or kind not in FOUND else [f"{'I' if j else 'B'}-{kind}" for j in range(len(new))]
            if kind != part and rnd.random() < 0.2:
                tokens[-1] += rnd.choice(".,")
        out.append((tokens, labels))
    return out


class CRF:
    """Linear-chain conditional random field; only tokens with a digit may have a label other than O."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    @staticmethod
    def allowed() -> np.ndarray:
        """0, or minus infinity for an inside label that does not follow its kind."""
        return np.array([[-1e9 if b[0] == "I" and a[1:] != b[1:] else 0.0 for b in LABELS] for a in LABELS])

    @classmethod
    def fit(cls, table: list[tuple[list[str], list[str]]], steps: int = 120, rate: float = 0.3, ridge: float = 2e-3) -> CRF:
        """Conditional log likelihood of runs of tokens with digits, by full-batch Adam with forward-backward in numpy."""
        runs = [(f, [LABELS.index(x) for x in gold]) for tokens, labels in table for f, gold in _runs(tokens, labels)]
        n, k, long = len(runs), len(LABELS), max(len(f) for f, _ in runs)
        x, y, on = np.zeros((n, long, runs[0][0].shape[1]), np.int64), np.zeros((n, long), np.int64), np.zeros((n, long), bool)
        for i, (f, gold) in enumerate(runs):
            x[i, : len(f)], y[i, : len(f)], on[i, : len(f)] = f, gold, True
        emit, move, gate = np.zeros((BUCKETS, k)), np.zeros((k, k)), cls.allowed()
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (emit, move)]
        hot = np.eye(k)[y] * on[..., None]
        for step in range(1, steps + 1):
            e, m = emit[x].sum(2), move + gate
            a, b = np.zeros((n, long, k)), np.zeros((n, long, k))
            a[:, 0] = e[:, 0] + gate[0]
            for t in range(1, long):
                a[:, t] = np.where(on[:, t, None], e[:, t] + _lse(a[:, t - 1, :, None] + m, 1), a[:, t - 1])
            for t in range(long - 2, -1, -1):
                b[:, t] = np.where(on[:, t + 1, None], _lse(m + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
            z = _lse(a[:, -1], 1)
            marginal = np.exp(a + b - z[:, None, None]) * on[..., None]
            pair = np.zeros((k, k))
            for t in range(1, long):
                p = np.exp(a[:, t - 1, :, None] + m + (e[:, t] + b[:, t])[:, None, :] - z[:, None, None]) * on[:, t, None, None]
                pair += p.sum(0) - np.einsum("ni,nj->ij", hot[:, t - 1] * on[:, t, None], hot[:, t])
            ge = np.zeros_like(emit)
            np.add.at(ge, x.reshape(-1, x.shape[2]), (marginal - hot).reshape(-1, 1, k))
            for j, (p, g) in enumerate(((emit, ge / n + ridge * emit), (move, pair / n + ridge * move))):
                mo = moments[j]
                mo[0], mo[1] = 0.9 * mo[0] + 0.1 * g, 0.999 * mo[1] + 0.001 * g * g
                p -= rate * (1 - step / (steps + 1)) * (mo[0] / (1 - 0.9**step)) / (np.sqrt(mo[1] / (1 - 0.999**step)) + 1e-8)
        return cls(emit, move + gate)

    def viterbi(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each run; runs of like length share one padded numpy batch of bounded size."""
        order, out, i = sorted(range(len(runs)), key=lambda j: len(runs[j])), [None] * len(runs), 0
        while i < len(order):
            j = i + 1
            while j < len(order) and (j - i + 1) * len(runs[order[j]]) <= 20_000:
                j += 1
            some = order[i:j]
            for at, path in zip(some, self._batch([runs[q] for q in some])):
                out[at] = path
            i = j
        return out

    def _batch(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        n, long, k = len(runs), max(map(len, runs)), len(LABELS)
        e, size = np.zeros((n, long, k)), np.array([len(r) for r in runs])
        for i, r in enumerate(runs):
            e[i, : len(r)] = self.emit[r].sum(1)
        best, back = e[:, 0] + CRF.allowed()[0], np.zeros((n, long, k), np.int8)
        for t in range(1, long):
            s = best[:, :, None] + self.move
            back[:, t] = s.argmax(1)
            best = np.where((t < size)[:, None], s.max(1) + e[:, t], best)
        label, path = best.argmax(1), np.zeros((n, long), np.int64)
        for t in range(long - 1, -1, -1):
            path[:, t] = label
            label = np.where((0 < t) & (t < size), back[np.arange(n), t, label], label)
        return [path[i, : size[i]] for i in range(n)]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _runs(tokens: list[str], labels: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    i = 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and any("0" <= c <= "9" for c in tokens[j]):
            j += 1
        if j > i:
            yield np.array([features(tokens[t - 1] if t else "", tokens[t], tokens[t + 1] if t + 1 < len(tokens) else "") for t in range(i, j)]), labels[i:j]
        i = j + 1


DIGIT = re.compile("[0-9]")
SPACE_OR_END = re.compile(r"\s|\Z")


def numeric_tokens(text: str) -> list[tuple[int, int]]:
    """Places of the words that hold a digit, without a walk over the other words."""
    out, at = [], 0
    while m := DIGIT.search(text, at):
        i = m.start()
        start = max(text.rfind(c, at, i) for c in " \n\t\r\f\v") + 1 or at
        end = SPACE_OR_END.search(text, i).start()
        out.append((start, end))
        at = end
    return out


def crf_runs(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words with digits that one space or tab parts at most."""
    runs: list[list[tuple[int, int]]] = []
    for a, b in numeric_tokens(text):
        if runs and a - runs[-1][-1][1] == 1 and text[a - 1] in " \t":
            runs[-1].append((a, b))
        else:
            runs.append([(a, b)])
    return runs


def _last_word(text: str, end: int) -> str:
    """What stands before end without white space, found by steps back that double."""
    size = 32
    while True:
        part = text[max(0, end - size) : end]
        at = max(map(part.rfind, " \n\t\r\f\v"))
        if at >= 0 or size >= end:
            return part[at + 1 :]
        size *= 2


def _around(text: str, run: list[tuple[int, int]]) -> tuple[str, str]:
    """The words before and after a run that one space parts from it; without one, none."""
    start, end = run[0][0] - 1, run[-1][1] + 1
    before = _last_word(text, start) if start > 0 and text[start] == " " else ""
    after = text[end : SPACE_OR_END.search(text, end).start()] if text[end - 1 : end] == " " else ""
    return before, after


def scan(many: list[str], model: CRF) -> list[list[tuple[int, int, int]]]:
    """All spans of each text: those by patterns, and those of the CRF that overlap none of them."""
    out, runs, owner = [], [], []
    for k, text in enumerate(many):
        out.append(base_spans(text))
        for run in crf_runs(text) if DIGIT.search(text) else ():
            left, right = _around(text, run)
            words = [left, *(text[a:b] for a, b in run), right]
            runs.append(np.array([features(words[i - 1], words[i], words[i + 1]) for i in range(1, len(words) - 1)]))
            owner.append((k, run))
    for (k, run), path in zip(owner, model.viterbi(runs) if runs else []):
        i = 0
        while i < len(run):
            j = i + 1
            if path[i]:
                while j < len(run) and LABELS[path[j]][0] == "I":
                    j += 1
                a, b = run[i][0], run[j - 1][1]
                while b > a and not many[k][b - 1].isdigit():
                    b -= 1
                while a < b and many[k][a] not in "(0123456789":
                    a += 1
                if not any(c.isalpha() for c in many[k][a:b]) and not any(s < b and e > a for s, kind, e in out[k] if kind < 4):
                    out[k].append((a, KINDS.index(LABELS[path[i]][2:]), b))
            i = j
    return [sorted(set(x)) for x in out]


def personal_data(docs: DataFrame, table: list[tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added of every text.

    n_ columns and base_sha256 are of the pattern spans; spans adds what the CRF, trained here from a small labelled table,
    finds besides them. Null and empty texts have none; equal texts get equal rows; repeated rows stay; other columns are
    dropped; an empty table gives an empty result. Words are read whole whatever their length. The CRF reads runs of words
    with digits and the words beside them, and finds phone numbers and personal ids there; names and addresses are not among
    its kinds. Memory is bounded by one run of rows and one Viterbi batch.
    """
    model = CRF.fit(table or labelled_table())
    kind = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    names = [x.split()[0] for x in kind.split(", ")]

    def told(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, many in texts(batch):
                rows = []
                for text, spans in zip(many, scan(many, model)):
                    base = base_spans(text) if spans else []
                    n = [sum(k == q for _, k, _ in base) for q in range(4)]
                    rows.append((*n, hashlib.sha256(told(base).encode()).hexdigest(), told(spans), len(spans) - len(base)))
                columns = [batch.column(0).slice(i, len(many)), *(pa.array(x, pa.string() if name in ("base_sha256", "spans") else pa.int64()) for name, x in zip(names[1:], zip(*rows)))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return id_text(docs).transform(map_arrow, run, kind)
