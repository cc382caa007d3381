"""Secrets by pattern, then judged by how many repositories and owners share a candidate. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import keyed, staged

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Long runs of token characters; kept as candidates where they mix cases and digits.
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"

#: Kinds in the order of the output; opaque spans are added by the ownership test.
KINDS = ("assign", "access", "hex", "opaque")
#: A candidate that more owners, or more repositories (documents), hold than this is a copied example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 16


def _hits(text: Column, pattern: str, kind: int, may: Column) -> Column:
    """Array of (kind, at, gap, gap_bytes, value): the leftmost non-overlapping matches in order and what lies before each."""
    empty = F.expr("cast(array() as array<struct<kind:int,at:int,gap:int,gap_bytes:int,value:string>>)")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    one = lambda gaps: F.transform(found, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), F.length(gaps[i]).alias("gap"), F.octet_length(gaps[i]).alias("gap_bytes"), x.alias("value")))
    return F.when(may, F.transform(F.array(F.split(text, pattern, -1)), one)[0]).otherwise(empty)


def matches(docs: DataFrame, owner_col: str = "source") -> DataFrame:
    """row, doc_id and owner of every document, once for each match, and once with nulls where there is none; texts go no further."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit("")).alias("owner"), text.alias("text"))
    t = F.col("text")
    hits = F.concat(
        _hits(t, ASSIGN, 0, (t.contains(":") | t.contains("=")) & t.rlike(ASSIGN)),
        _hits(t, ACCESS, 1, t.contains("AKIA")),
        _hits(t, HEX, 2, t.rlike(HEX)),
        _hits(t, OPAQUE, 3, t.rlike(OPAQUE)),
    )
    return d.select("row", "doc_id", "owner", F.explode_outer(hits).alias("s")).select("row", "doc_id", "owner", "s.*")


def candidates(found: DataFrame) -> DataFrame:
    """row, doc_id, owner, kind, start and end (code points), low and high (bytes) and hash of each span that may be a secret.

    A match stands after the matches and gaps of its kind before it; those that the kind does not accept count for that and
    are dropped. Opaque strings that overlap a base span are dropped: they start before one ends that started earlier, or
    end after the next one starts. Rows move once; all windows run over one row's matches in order, with no array of them.
    """
    x, k = F.col("value"), F.col("kind")
    run = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end, high = F.sum(F.col("gap") + F.length(x)).over(run), F.sum(F.col("gap_bytes").cast("long") + F.octet_length(x)).over(run)
    mixed = x.rlike("[a-z]") & x.rlike("[A-Z]") & x.rlike("[0-9]{2}|[0-9][^0-9]+[0-9]")
    good = F.when(k == 0, F.length(F.regexp_extract(x, ASSIGN, 1)) >= 6).when(k == 3, mixed).otherwise(F.lit(True))
    told = F.when(k == 0, F.regexp_extract(x, ASSIGN, 1)).otherwise(x)
    placed = found.where("kind is not null").repartition("row").select("row", "doc_id", "owner", "kind", "value", end.alias("end"), high.alias("high")).where(good)
    placed = placed.select("row", "doc_id", "owner", "kind", (F.col("end") - F.length(x)).alias("start"), "end", (F.col("high") - F.octet_length(x)).alias("low"), "high", F.sha2(told, 256).alias("hash"))
    earlier = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(k < 3, F.col("end"))).over(earlier)
    following = F.min(F.when(k < 3, F.col("start"))).over(later)
    placed = placed.withColumn("reach", reach).withColumn("following", following)
    clear = (k < 3) | ((F.coalesce("reach", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("following") >= F.col("end"), F.lit(True)))
    return placed.where(clear).drop("reach", "following")


def judged(found: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """The candidates that stay, each with its repositories and whether it looks live: few owners and few repositories hold it."""
    spans = staged(candidates(found), "spans")
    each = spans.select("hash", "owner", F.coalesce("doc_id", -1 - F.col("row")).alias("repository"))
    owners = each.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("owners"))
    repos = each.select("hash", "repository").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("repositories"))
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    return spans.join(owners, "hash").join(repos, "hash").withColumn("live", live).where((F.col("kind") < 3) | F.col("live"))


def secret_scan(docs: DataFrame, owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Spans of secrets in every document, with the reach of each candidate over the whole corpus.

    A candidate's value (for assignments the assigned one) is hashed and counted by distinct owner (owner_col) and
    repository (the document; a row without doc_id is one of its own). It is a copied example where more than max_owners
    owners or max_repositories repositories hold it, else it looks live. Opaque strings are added as spans where they look
    live and overlap no base span; n_live and n_example count all spans. Base spans always stay.
    Columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_opaque, n_live, n_example, max_repositories.
    Null and empty texts have no spans; null owners are one owner; repeated rows stay apart and count once for a repository
    of the same id; other columns are dropped; an empty table gives an empty result. Counting is by (hash, owner) and
    (hash, document) first, so that a value in a third of all rows is combined before the shuffle.
    """
    found = staged(matches(docs, owner_col), "secrets")
    out = judged(found, max_owners, max_repositories).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("all"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
        F.max("repositories").alias("max_repositories"),
    )
    label = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"])
    n = lambda k: F.size(F.filter("all", lambda x: x["kind"] == k)).cast("long")
    every = found.where("at is null or (at = 0 and kind is not null)").select("row", "doc_id").distinct()
    joined = every.join(out, "row", "left").withColumn("all", F.coalesce("all", F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")))
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(F.array_join(F.transform(F.filter("all", lambda x: x["kind"] < 3), label), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("all", label), ",").alias("spans"),
        n(3).alias("n_opaque"),
        *(F.coalesce(c, zero).alias(c) for c in ("n_live", "n_example", "max_repositories")),
    )


#: What stands in the place of a redacted span.
REDACTED = "[SECRET]"


def redact_live(docs: DataFrame, owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """The rows of docs with live-looking secrets replaced; copied examples stay, and so does every document.

    Overlapping spans are replaced once. Spans go by a key of the row, so rows without doc_id, or that share one, are
    redacted like any other. Null and empty texts stay as they are; repeated rows stay; columns of any other name pass
    through; an empty table gives an empty result. n_chars, where docs has it, follows the text. A text is cut at byte
    places, so its pieces are copied once however many there are.
    """
    rows = keyed(docs)
    scanned = rows.select(F.col("key").alias("doc_id"), F.col("doc.text").alias("text"), F.col(f"doc.`{owner_col}`").alias("owner"))
    found = staged(matches(scanned, "owner"), "secrets")
    live = judged(found, max_owners, max_repositories).where("live").select(F.col("doc_id").alias("key"), "low", "high")
    w = Window.partitionBy("key").orderBy("low", "high")
    reach = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    live = live.withColumn("new", F.coalesce(F.col("low") >= reach, F.lit(True)).cast("int")).withColumn("stretch", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cuts = live.groupBy("key", "stretch").agg(F.min("low").alias("low"), F.max("high").alias("high")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("cuts"))
    last = F.size("cuts")

    def piece(data: Column) -> Column:
        begin = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.col("cuts")[i - 1]["high"])
        stop = lambda i: F.when(i == last, F.octet_length(data).cast("long")).otherwise(F.col("cuts")[i]["low"])
        part = lambda i: F.substring(data, (begin(i) + 1).cast("int"), (stop(i) - begin(i)).cast("int")).cast("string")
        return F.transform(F.sequence(F.lit(0), last), part)

    pieces = F.transform(F.array(F.col("doc.text").cast("binary")), piece)[0]
    text = F.when(F.col("cuts").isNull(), F.col("doc.text")).otherwise(F.array_join(pieces, REDACTED))
    new = {"text": F.col("text")}
    joined = rows.join(cuts, "key", "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("cuts").isNull(), F.col("doc.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
