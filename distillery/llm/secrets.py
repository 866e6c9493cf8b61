"""Secret scans with corpus-wide ownership, by DataFrame functions alone.

Each kind's matches come from one regular expression; splitting the text by the
same expression gives the lengths between them, whose running sums are their
places (code points, end exclusive). Candidates are then counted over the whole corpus: by
the hash of the candidate's value, in how many distinct repositories (source
and language) and owners (sources) it occurs. A value of one owner looks live;
a value of several is a copied example.

Base kinds are assign, access and hex. The method adds ``bearer``, ``jwt``,
``key`` (a private key, through its last line) and ``login`` (a password in an address),
which are kept when their value has one owner; base matches always stay.

Cases: null and empty texts have no spans. Texts of any length are scanned
whole. Repeated rows are documents of their own and do not add owners. A null
source counts as one owner. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Pattern, group that holds the value, least characters of that group. Text without the hint has no match.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 18),
    "hex": (r"([0-9a-f]{16,})", 1, 16),
}
_KEY = "[A-Z ]{0,20}PRIVATE KEY-----"
#: What follows the header of a key without its last line: its own headers and the lines of its body.
_OPEN = r"(?:[\r\n]+[A-Z][A-Za-z-]*:\x20[^\r\n]*+){0,64}\s?[A-Za-z0-9+/=\r\n]*+"
ADDED = {
    "bearer": (r"(?:[Bb]earer|BEARER)\x20+([A-Za-z0-9._~+/-]{20,}=*)", 1, 20),
    "jwt": (r"(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*)", 1, 22),
    "key": (rf"(-----BEGIN {_KEY}(?:[^-]*+(?:-(?!----)[^-]*+){{0,999}}-----END {_KEY}|{_OPEN}))", 1, 24),
    "login": (r"://[^\s/:@]*:([^\s/:@]{4,})@", 1, 4),
}
KINDS = (*BASE, *ADDED)
#: Strings of which a text with a match holds one; finding them is cheaper than the expression.
HINTS = {"assign": ("=", ":"), "access": ("AKIA",), "bearer": ("earer", "EARER"), "jwt": ("eyJ",), "key": ("-----BEGIN",), "login": ("://",)}
#: Owners from which on a value counts as a copied example.
COPIED = 2


def matches(text: Column, kind: str) -> Column:
    """array<struct<rank, gap, size, n, h1, h2>> of a kind's matches in the text, in order: what precedes each since the last one, and its length."""
    pattern, group, _ = (BASE | ADDED)[kind]
    whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))
    found = F.transform(zipped, lambda m: F.struct(
        F.lit(KINDS.index(kind)).alias("rank"), F.length(m["gap"]).alias("gap"), F.length(m["whole"]).alias("size"), F.length(m["value"]).alias("n"),
        F.xxhash64(m["value"]).alias("h1"), F.hash(m["value"]).alias("h2"),
    ))
    none = F.array().cast("array<struct<rank:int,gap:int,size:int,n:int,h1:bigint,h2:int>>")
    hinted = F.lit(True) if kind not in HINTS else functools.reduce(Column.__or__, (F.contains(text, F.lit(h)) for h in HINTS[kind]))
    return F.when(hinted & (F.size(whole) > 0), found).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """uid, doc_id, owner, repository and matches of each document's whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    owner = F.col("source").cast("string")
    repository = F.xxhash64(F.col("source").cast("string"), F.col("lang").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), owner.alias("owner"), repository.alias("repository"), F.concat(*[matches(text, k) for k in KINDS]).alias("found"))
    return rows.withColumn("uid", F.monotonically_increasing_id())


def placed(rows: DataFrame) -> DataFrame:
    """uid, owner, repository, rank, start, end, h1, h2 of the matches that are long enough; places are running sums."""
    each = rows.where(F.size("found") > 0).select("uid", "owner", "repository", F.posexplode("found").alias("p", "m")).select("uid", "owner", "repository", "p", "m.*")
    order = Window.partitionBy("uid", "rank").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order).cast("int"))
    least = functools.reduce(lambda other, k: F.when(F.col("rank") == KINDS.index(k), F.lit((BASE | ADDED)[k][2])).otherwise(other), KINDS, F.lit(0))
    return each.where(F.col("n") >= least).select("uid", "owner", "repository", "rank", (F.col("end") - F.col("size")).alias("start"), "end", "h1", "h2")


def ownership(each: DataFrame) -> DataFrame:
    """Distinct owners and repositories of each value. Copies within one owner collapse before anything is shuffled on."""
    counted = each.groupBy("h1", "h2", "owner", "repository").count()
    owners = counted.groupBy("h1", "h2", "owner").agg(F.count("*").alias("r"), F.sum("count").alias("n"))
    return owners.groupBy("h1", "h2").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repositories"), F.sum("n").alias("n_uses"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, base matches and all spans, each with the ownership of its value."""
    root = common.shared_dir(docs.sparkSession, "secrets")
    # Scanned once; both the counts and the result read the stored candidates.
    rows = common.stored(scan(docs), f"{root}/rows")
    each = common.stored(placed(rows), f"{root}/matches")
    # A value that is copied everywhere takes its counts from a broadcast.
    judged = common.hot_join(each, ownership(each), ["h1", "h2"], "n_uses", each.count())
    kind = F.get(F.array(*map(F.lit, KINDS)), F.col("rank"))
    span = F.struct("start", "rank", "end", kind.alias("kind"), "n_owners", "n_repositories")
    # A document's own matches, no more than its text holds.
    by_doc = judged.groupBy("uid").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    whole = rows.select("uid", "doc_id").join(by_doc, "uid", "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,n_owners:bigint,n_repositories:bigint>>")
    spans = F.filter(F.coalesce("spans", none), lambda s: s["kind"].isin(*BASE) | (s["n_owners"] < COPIED))
    return whole.select("doc_id", spans.alias("spans"))


def digest_columns(judged: DataFrame) -> DataFrame:
    def n(keep) -> Column:
        return F.size(F.filter("spans", keep)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [n(common.of_kind(k)).alias(f"n_{k}") for k in BASE]
    live = n(lambda s: s["n_owners"] < COPIED).alias("n_live")
    copied = n(lambda s: s["n_owners"] >= COPIED).alias("n_copied")
    return judged.select("doc_id", *counts, F.sha2(common.joined_spans(base).cast("binary"), 256).alias("base_sha256"), common.joined_spans(F.col("spans")).alias("spans"), live, copied)
