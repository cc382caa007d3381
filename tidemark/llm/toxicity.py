"""Toxicity classifier on hashed word presence, regularised so that swapping identity terms leaves its score alone."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import flat_gather, staged

#: Labelled documents that the classifier is fitted on, and features that they hold together, at most: those with the smallest
#: hash of their id. What the driver gets is bounded by both.
TRAIN_ROWS, TRAIN_FEATURES = 20_000, 16_000_000
#: Buckets of the hashed words and stems, all of which are weighed where LEAST_ROWS labelled rows hold them.
BUCKETS, LEAST_ROWS = 1 << 16, 3
#: Features of labelled rows that the driver handles at once.
BLOCK = 1 << 19
#: Letters of a stem; it is written with a star.
STEM = 4
#: Weights of the counterfactual penalty and of the ridge; the L1 weight is this share of what noise alone would reach.
SWAP, RIDGE, NOISE = 50.0, 1e-3, 0.5
#: Score from which a document counts as toxic.
CUT = 0.3

#: Words that name a group, in the corpus's languages: swapping one for another of its row must not change a score. Fixed values.
IDENTITY = tuple(
    tuple(row.split())
    for row in (
        "women men girls boys", "muslim christian jewish hindu buddhist atheist", "black white asian latino arab", "gay straight lesbian bisexual transgender", "immigrants foreigners refugees natives", "disabled deaf blind autistic", "old young elderly",
        "frauen männer mädchen jungen", "muslimisch christlich jüdisch hinduistisch buddhistisch atheistisch", "schwule lesben transgeschlechtliche", "einwanderer ausländer flüchtlinge einheimische", "behinderte gehörlose blinde",
        "femmes hommes filles garçons", "musulman chrétien juif hindou bouddhiste athée", "noirs blancs asiatiques arabes", "homosexuels lesbiennes transgenres", "immigrés étrangers réfugiés", "handicapés sourds aveugles",
        "mujeres hombres niñas niños", "musulmán cristiano judío hindú budista ateo", "negros asiáticos latinos árabes", "homosexuales lesbianas transgénero", "inmigrantes extranjeros refugiados nativos", "discapacitados sordos ciegos",
    )
)
TERMS = tuple(dict.fromkeys(x for row in IDENTITY for x in row))

SPLIT = r"[^\p{L}]+"


def words(text) -> F.Column:
    """Distinct lower-case words, and the stems of those that name no group (a stem would stand in for its term)."""
    found = F.array_distinct(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SPLIT))
    stems = lambda w: F.transform(F.array_except(w, F.array(*map(F.lit, TERMS))), lambda x: F.concat(F.substring(x, 1, STEM), F.lit("*")))
    return F.transform(F.array(found), lambda w: F.array_distinct(F.concat(F.array_remove(w, ""), F.array_remove(stems(w), "*"))))[0]


def buckets(found) -> F.Column:
    """Buckets of an array of words."""
    return F.array_distinct(F.transform(found, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))


def bucket(word: str) -> int:
    """As buckets gives it: the hash of Spark's function."""
    return xxhash.xxh64(word.encode(), seed=42).intdigest() % BUCKETS


@dataclass
class Pairs:
    """Labelled sentences in two versions that differ in one identity term.

    Row i holds features idx[ptr[i]:ptr[i + 1]]; version v adds plus[i, v] and takes minus[i, v] away, where the last number,
    one beyond the features, is nothing.
    """

    idx: np.ndarray
    ptr: np.ndarray
    label: np.ndarray
    plus: np.ndarray
    minus: np.ndarray
    features: int

    def blocks(self) -> list[tuple[int, int]]:
        """Runs of rows of about BLOCK features, which are handled at once."""
        cuts = np.searchsorted(self.ptr, np.arange(0, int(self.ptr[-1]) + BLOCK, BLOCK), "left")
        cuts = np.unique(np.concatenate(([0], np.minimum(cuts, len(self.label)), [len(self.label)])))
        return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))

    def share(self) -> np.ndarray:
        """Share of the versions that hold each feature, before minus."""
        n = max(1, len(self.label))
        return (np.bincount(self.idx, minlength=self.features + 1)[:-1] + 0.5 * np.bincount(self.plus.reshape(-1), minlength=self.features + 1)[:-1]) / n

    def loss(self, w: np.ndarray, swap: float, ridge: float) -> tuple[float, np.ndarray]:
        """(mean log loss of both versions + swap / 2 * mean squared change between them + ridge / 2 * |w|^2, gradient); the last weight is the bias."""
        n, weight = len(self.label), np.append(w[:-1], 0.0)
        total = np.empty(n)
        for a, b in self.blocks():
            at = self.ptr[a : b + 1] - self.ptr[a]
            sums = np.concatenate(([0.0], np.cumsum(weight[self.idx[self.ptr[a] : self.ptr[b]]])))
            total[a:b] = sums[at[1:]] - sums[at[:-1]]
        z = (total + w[-1])[:, None] + weight[self.plus] - weight[self.minus]
        y = self.label[:, None]
        change = z[:, 1] - z[:, 0]
        value = float((np.logaddexp(0, z) - y * z).mean() + swap / 2 * (change * change).mean() + ridge / 2 * (w[:-1] ** 2).sum())
        each = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / (2 * n)
        both = each.sum(1)
        each += swap / n * np.stack((-change, change), 1)
        g = np.zeros(self.features + 1)
        for a, b in self.blocks():
            g += np.bincount(self.idx[self.ptr[a] : self.ptr[b]], np.repeat(both[a:b], np.diff(self.ptr[a : b + 1])), self.features + 1)
        g += np.bincount(self.plus.reshape(-1), each.reshape(-1), self.features + 1) - np.bincount(self.minus.reshape(-1), each.reshape(-1), self.features + 1)
        return value, np.append(g[:-1] + ridge * w[:-1], both.sum())

    def only(self, kept: np.ndarray) -> Pairs:
        """The same rows with the features kept, numbered anew."""
        number = np.full(self.features + 1, len(kept), np.int32)
        number[kept] = np.arange(len(kept))
        parts, counts = [np.zeros(0, np.int32)], np.zeros(len(self.label), np.int64)
        for a, b in self.blocks():
            idx = number[self.idx[self.ptr[a] : self.ptr[b]]]
            some = idx < len(kept)
            parts.append(idx[some])
            counts[a:b] = np.bincount(np.repeat(np.arange(b - a), np.diff(self.ptr[a : b + 1]))[some], minlength=b - a)
        return Pairs(np.concatenate(parts), np.concatenate(([0], np.cumsum(counts))), self.label, number[self.plus], number[self.minus], len(kept))


def descend(pairs: Pairs, scale: np.ndarray, l1: float, swap: float, ridge: float, steps: int, start: np.ndarray | None = None, least: float = 1e-6) -> np.ndarray:
    """Weights by accelerated proximal gradient steps with backtracking, in features scaled to one deviation."""
    s = np.append(scale, 1.0)
    u = np.zeros(len(s)) if start is None else start * s
    ahead, pace, size = u.copy(), 1.0, 1.0
    for _ in range(steps):
        value, g = pairs.loss(ahead / s, swap, ridge)
        g = g / s
        while True:
            new = ahead - size * g
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - size * l1, 0)
            move = new - ahead
            if size < 1e-9 or pairs.loss(new / s, swap, ridge)[0] <= value + g @ move + (move @ move) / (2 * size) + 1e-12:
                break
            size /= 2
        faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        if (ahead - new) @ (new - u) > 0:  # the momentum leads uphill: start it anew
            faster = 1.0
        ahead, far = new + (pace - 1) / faster * (new - u), np.abs(new - u).max()
        u, pace, size = new, faster, min(size * 1.2, 1e3)
        if far < least:
            break
    return u / s


def fit(pairs: Pairs, swap: float = SWAP, ridge: float = RIDGE, noise: float = NOISE) -> tuple[dict[int, float], float]:
    """(weight by feature, bias): an L1 fit over all features says which matter, a second without it how much.

    The L1 weight is a share of the largest gradient that labels without any relation to the features would give.
    """
    share = pairs.share()
    n, mean = len(pairs.label), pairs.label.mean()
    common = np.flatnonzero(share * n >= LEAST_ROWS)
    some = pairs.only(common)
    scale = np.sqrt(np.maximum(share[common] * (1 - share[common]), 1 / n))
    l1 = noise * float(np.sqrt(mean * (1 - mean) * 2 * np.log(2 * max(1, len(common))) / n))
    w, active = np.zeros(len(common) + 1), np.zeros(0, np.int64)
    w[-1] = np.log(mean / (1 - mean))
    while True:  # features enter until none is left whose gradient the L1 weight would not hold at nought: the fit over all
        pull = np.abs(some.loss(w, swap, ridge)[1][:-1]) / scale
        pull[active] = 0
        new = np.flatnonzero(pull > 1.01 * l1)
        if not len(new):
            break
        active = np.union1d(active, new)
        part = descend(some.only(active), scale[active], l1, swap, ridge, 300, np.append(w[active], w[-1]), 1e-3)
        w[:] = 0
        w[active], w[-1] = part[:-1], part[-1]
    kept = np.flatnonzero(w[:-1])
    w = descend(some.only(kept), scale[kept], 0.0, swap, ridge, 300, np.append(w[kept], w[-1]), 1e-4)
    return {int(common[k]): float(x) for k, x in zip(kept, w[:-1])}, float(w[-1])


def pairs_of(ids: np.ndarray, label: np.ndarray, idx: np.ndarray, ptr: np.ndarray, terms: list[list[str]]) -> Pairs:
    """Two versions of each labelled sentence: its own and one with a term swapped, or two in which a term is placed where it has none.

    Terms are chosen by a checksum of the row's place in the sample, among those of one row of IDENTITY.
    """
    none = BUCKETS
    plus, minus = np.full((len(label), 2), none), np.full((len(label), 2), none)
    rows_of = {t: [row for row in IDENTITY if t in row] for t in TERMS}
    for i, held in enumerate(terms):
        pick = zlib.crc32(str(int(ids[i])).encode())
        if held:
            a = sorted(held)[pick % len(held)]
            row = [x for x in rows_of[a][0] if x != a and x not in held] or [a]
            plus[i, 1], minus[i, 1] = bucket(row[pick // 7 % len(row)]), bucket(a)
        else:
            row = IDENTITY[pick % len(IDENTITY)]
            first = pick // 7 % len(row)
            plus[i] = bucket(row[first]), bucket(row[(first + 1 + pick // 97 % (len(row) - 1)) % len(row)])
    return Pairs(idx, ptr, label.astype(np.float64), plus, minus, BUCKETS)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, features: int = TRAIN_FEATURES) -> tuple[dict[int, float], float]:
    """Fit on at most rows labelled documents: (doc_id, label 0/1) rows of labels whose document docs holds.

    Only those documents are split into words, once each however many rows repeat them; the driver gets their buckets.
    """
    some = labels.dropna().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    some = some.groupBy(F.col("doc_id").alias("l_id")).agg(F.max("label").alias("label"))
    d = docs.join(F.broadcast(some), F.col("doc_id") == F.col("l_id")).select("l_id", "label", words(F.col("text")).alias("words"))
    held = F.struct(F.array_sort(buckets(F.col("words"))).alias("idx"), F.array_sort(F.array_intersect("words", F.array(*map(F.lit, TERMS)))).alias("terms"))
    d = staged(d.select("l_id", "label", held.alias("held")).groupBy("l_id", "label").agg(F.min("held").alias("held")), "labelled")
    # a window over ids and sizes alone, of which there are rows at most
    so_far = F.sum(F.size("held.idx")).over(Window.orderBy(F.xxhash64("l_id"), "l_id"))
    kept = d.select("l_id", so_far.alias("so_far")).where(F.col("so_far") <= features).select("l_id")
    found = d.join(F.broadcast(kept), "l_id", "left_semi").select("l_id", "label", "held.idx", "held.terms").toArrow()
    label = found["label"].to_numpy().astype(np.int64) if found.num_rows else np.zeros(0, np.int64)
    positive = int(label.sum())
    if positive in (0, len(label)):
        return {}, float(np.log((positive + 1) / (len(label) - positive + 9)))
    order = np.lexsort((label, found["l_id"].to_numpy()))  # the same sums in whatever order tasks end
    lists, terms, ids = found["idx"].combine_chunks(), found["terms"].to_pylist(), found["l_id"].to_numpy()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)[order]
    idx = flat_gather(lists.values.to_numpy(), offsets[:-1][order], sizes)
    del found, lists
    return fit(pairs_of(ids[order], label[order], idx, np.concatenate(([0], np.cumsum(sizes))), [terms[i] for i in order]))


def score(docs: DataFrame, model: tuple[dict[int, float], float]) -> DataFrame:
    """doc_id and score of every document: the logistic of the bias and the weights of the words that it holds."""
    weights, bias = model
    weights = {k: v for k, v in weights.items() if abs(v) > 1e-9}
    total = F.lit(bias)
    if weights:
        table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
        hits = F.array_intersect(buckets(words(F.col("text"))), F.array(*map(F.lit, weights)))
        total = F.aggregate(F.array_sort(hits), F.lit(bias), lambda a, x: a + F.element_at(table, x))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.round(1 / (1 + F.exp(-total)), 9).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels: doc_id, toxic.

    Rows whose crc32(doc_id as text) mod 4 is 2 are held out: their labels are never read. Null and empty texts get the
    score of no words; without labels of both kinds every score is one constant; equal texts get equal scores; repeated
    rows stay; other columns are dropped; an empty table gives an empty result.
    """
    fold = lambda c: F.crc32(c.cast("long").cast("string")) % 4
    known = labels.where(fold(F.col("doc_id")) != 2).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    scored = score(docs, train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), known))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
