"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"

#: Hash buckets of the two multinomials; fixes the size of what every task holds.
BUCKETS = 1 << 14
#: Labelled target rows that the trusted multinomial is fitted on, at most (those with the smallest hash of their id).
TARGET_ROWS = 20_000
#: Pseudo-counts of every bucket in both multinomials, the corpus one scaled to the target's total: rare n-grams say little.
PRIOR = 50.0
#: Mean log-likelihood ratio of an n-gram below which a document goes: its n-grams are then a twentieth less likely in the
#: target than in the corpus. Labelled documents of quality 1 stay above it, nearly all of quality 0 below or fail the rules.
THRESHOLD = -0.05

#: Hashes of the words and of the pairs of neighbouring words in array w.
_GRAMS = f"concat(transform(w, x -> cast(pmod(xxhash64(x), {BUCKETS}) as int)), transform(slice(w, 2, greatest(size(w) - 1, 0)), (x, i) -> cast(pmod(xxhash64(w[i], x), {BUCKETS}) as int)))"

#: Mean ratio r of the n-grams of w.
_SCORE = f"if(size(w) = 0, 0D, aggregate({_GRAMS}, 0D, (a, g) -> a + r[g]) / (2 * size(w) - 1))"

#: Words in windows of three that the text has twice or more: hashes sorted with their place, equal neighbours kept, then
#: each found window adds what it reaches beyond the one before.
_REPEATS = """
transform(array(transform(slice(w, 3, greatest(size(w) - 2, 0)), (x, i) -> xxhash64(w[i], w[i + 1], x))), h ->
  if(size(array_distinct(h)) = size(h), 0L,
    transform(array(sort_array(transform(h, (x, i) -> struct(x as h, i as i)))), s ->
      aggregate(
        sort_array(transform(
          filter(transform(s, (x, j) -> if((j > 0 and s[j - 1].h = x.h) or (j + 1 < size(s) and s[j + 1].h = x.h), x.i, -1)), i -> i >= 0),
          i -> i)),
        named_struct('n', 0L, 'to', 0),
        (a, i) -> named_struct('n', a.n + (i + 3 - greatest(a.to, i)), 'to', i + 3),
        a -> a.n))[0]))[0]
"""


def words(text) -> F.Column:
    return F.array_remove(F.split(text, SPACES), "")


def base_rules(docs: DataFrame, ratios=None) -> DataFrame:
    """The rule columns of every document and, with ratios (one array of BUCKETS doubles), llr."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    score = "0D" if ratios is None else _SCORE
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), words(text).alias("words"), *([] if ratios is None else [ratios.alias("r")]))
    plain = text
    for symbol in SYMBOLS:
        plain = F.replace(plain, F.lit(symbol), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return d.select(
        "doc_id",
        (F.length("text") - F.length(plain)).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))[0].alias("n_dup_lines"),
        F.expr(f"transform(array(words), w -> named_struct('n_words', cast(size(w) as bigint), 'word_chars', cast(length(array_join(w, '')) as bigint), 'n_repeat_words', {_REPEATS}, 'llr', {score}))[0]").alias("x"),
    ).select("doc_id", "x.n_words", "x.word_chars", "n_symbols", "n_dup_lines", "x.n_repeat_words", ((F.col("x.n_words") < 50) | (100 * F.col("x.n_repeat_words") > 50 * F.col("x.n_words"))).alias("base_failed"), "x.llr")


def ratios(docs: DataFrame, trusted: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """One row with r, an array of log(P(bucket | target) / P(bucket | corpus)), both with PRIOR pseudo-counts a bucket.

    trusted: doc_id of target documents, of which target_rows are used. The corpus counts take every document. Each task
    counts into BUCKETS rows at most before the shuffle, so a hot source or word moves no more than any other.
    """
    spark = docs.sparkSession
    sample = trusted.select(F.col("doc_id").cast("long").alias("t_id")).dropna().distinct().orderBy(F.xxhash64("t_id"), "t_id").limit(target_rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(text).alias("words")).join(F.broadcast(sample), F.col("doc_id") == F.col("t_id"), "left")
    grams = d.select(F.col("t_id").isNotNull().cast("long").alias("t"), F.explode(F.expr(f"transform(array(words), w -> {_GRAMS})[0]")).alias("g"))
    counts = grams.groupBy("g").agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("n"))
    dense = spark.range(0, BUCKETS, 1, 1).join(F.broadcast(counts), F.col("id") == F.col("g"), "left").select("id", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("n", F.lit(0)).alias("n"))
    both = dense.agg(F.sum("t").alias("all_t"), F.sum("n").alias("all_n"), F.sort_array(F.collect_list(F.struct("id", "t", "n"))).alias("x"))
    return both.select(F.expr(f"if(all_t = 0, transform(x, y -> 0D), transform(x, y -> ln((y.t + {PRIOR}D) / (y.n * (all_t / all_n) + {PRIOR}D))))").alias("r"))


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Rules and verdict for every document.

    trusted: doc_id of documents that stand for the target; ids that docs lacks are ignored, and without any the ratio is
    0 and only the rules decide. kept is false where base_failed, else llr (mean log ratio of the words and word pairs)
    decides: llr >= threshold. Null and empty texts have no words, so the rules reject them; repeated rows stay and equal
    texts get equal rows; other columns, whatever their names, are dropped; an empty table gives an empty result.
    """
    return base_rules(docs, ratios(docs, trusted, target_rows).scalar()).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"), F.round("llr", 9).alias("llr"))


def quality_filter(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, target_rows: int = TARGET_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, that quality_rules keeps; no text is shuffled.

    Null and empty texts go, as the rules reject them; rows without doc_id are judged like any other and are no target;
    repeated rows have one verdict; a ratio equal to the threshold stays; columns of any name pass through; an empty table
    gives an empty result. The verdict is one expression, so that a filter that moves below a projection does not repeat its parts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), words(text).alias("words"), ratios(docs, trusted, target_rows).scalar().alias("r"))
    verdict = f"size(w) >= 50 and 100 * {_REPEATS} <= 50 * size(w) and {_SCORE} >= {threshold}D"
    return d.where(F.expr(f"transform(array(words), w -> {verdict})[0]")).select("row.*")
