"""Benchmark decontamination by a positional inverted index, by DataFrame functions alone.

The index has each training document's words, numbered by row, and a posting
(term, row, position) for every one of them; both are stored, and one
tokenisation serves all that follows. The words of a benchmark item are looked
up from its rarest terms, counted over the index:

Exact phrases: each window of WINDOW item words (a shorter item is one window)
has its two rarest places. Adjusted by the place, a posting is a diagonal on
which document and item may agree; the two lists are intersected on it, and the
words along what is left are compared. A window that several items share is
looked up once.

Proximity: an item is near where some stretch of the document, SLACK words
longer than the item, holds NEAR percent of its distinct words, in any order. A
stretch that does must hold two of the item's rarest terms (one more than may
be missing, and another), so their postings say which documents to look at;
there, all of the item's words are swept once by position.

Words are runs of letters, digits and characters above ASCII, A-Z lowered.

Cases: a null or empty text has no words, is not contaminated and has nothing
hit; an item without words is never found. Items that repeat an item_id count
once if any of them is found; those of null id count as one, without a name.
Rows are told apart by number, so repeated and null doc_ids are documents of
their own. An item of fewer than LEAST_NEAR distinct words is never near. Very
long texts give long word lists, and nothing is collected by document but its
own item ids. Either table may be empty. ``clean`` keeps all other columns,
whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

WINDOW = 13
#: Share of a document's words, one in so many, from which on it is contaminated.
ONE_IN = 20
#: Percentage of an item's distinct words, and the words more than the item's, of a stretch that is near it; least distinct words.
NEAR, SLACK, LEAST_NEAR = 80, 8, 5
#: Benchmark words, or rows of a table made from them, up to which they are sent to every executor; more are joined by shuffle.
SENT = 500_000
_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, in order; the gaps at its two ends leave empty pieces, which go."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAP, -1), "")


def sent_if_small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SENT else df


@dataclass(frozen=True)
class Index:
    """rows: uid, words and the documents' columns as c0, c1, ...; postings: term, uid, position."""

    rows: DataFrame
    postings: DataFrame
    names: dict[str, str]

    @classmethod
    def build(cls, docs: DataFrame, path: str, with_text: bool = True) -> Index:
        numbered, names = common.numbered(docs)
        text = next(c for c, name in names.items() if name.lower() == "text")
        kept = {c: name for c, name in names.items() if with_text or c != text}
        rows = common.stored(numbered.select(*kept, F.monotonically_increasing_id().alias("uid"), words(F.col(text)).alias("words")), f"{path}/rows")
        # Dealt by document, as the rows are: nothing is shuffled to build the index.
        postings = rows.select("uid", F.posexplode("words").alias("position", "term"))
        return cls(rows, common.stored(postings, f"{path}/postings"), kept)

    def column(self, name: str) -> Column:
        return F.col(next(c for c, own in self.names.items() if own.lower() == name))


def window_terms(items: DataFrame, counts: DataFrame) -> DataFrame:
    """item, j, a, b: each window's number, and the places of its two rarest words (the same one in a window of one word). Equal windows count once."""
    rows = items.select("item", F.size("item_words").alias("n"), F.posexplode("item_words").alias("place", "term")).join(counts, "term", "left")
    rarity = F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "term", "place")
    ahead = Window.partitionBy("item").orderBy("place").rowsBetween(0, WINDOW - 1)
    begins = F.when(F.col("n") >= WINDOW, F.col("place") <= F.col("n") - WINDOW).otherwise(F.col("place") == 0)
    rows = rows.withColumn("ranked", F.array_sort(F.collect_list(rarity).over(ahead))).withColumn("window", F.collect_list("term").over(ahead)).where(begins)
    first = F.min(F.struct("item", F.col("place").alias("j"), F.col("ranked")[0]["place"].alias("a"), F.get("ranked", F.least(F.lit(1), F.size("ranked") - 1))["place"].alias("b")))
    return rows.groupBy("window").agg(first.alias("o")).select("o.*")


def equal_runs(document: Column, item: Column, diagonal: Column) -> Column:
    """Stretches of the item, as (s, e), in which at least a window of words equals the document's along a diagonal."""
    least = F.least(F.size(item), F.lit(WINDOW))
    # Places that differ, with one before the first and one past the last; a run lies between neighbours.
    differs = F.filter(F.sequence(F.lit(0), F.size(item) - 1), lambda j: ~F.coalesce(F.get(document, diagonal + j) == F.get(item, j), F.lit(False)))
    bars = F.concat(F.array(F.lit(-1)), differs, F.array(F.size(item)))
    runs = F.zip_with(F.slice(bars, 1, F.size(bars) - 1), F.slice(bars, 2, F.size(bars) - 1), lambda x, y: F.struct((x + 1).alias("s"), y.alias("e")))
    return F.filter(runs, lambda r: r["e"] - r["s"] >= least)


def anchor_terms(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """item, place, term of the places that windows are looked up by."""
    anchors = pairs.select("item", F.explode(F.array("a", "b")).alias("place")).distinct()
    return anchors.join(items, "item").select("item", "place", F.get("item_words", F.col("place")).alias("term"))


def exact_hits(index: Index, postings: DataFrame, items: DataFrame, pairs: DataFrame, anchors: DataFrame, size: int, path: str) -> DataFrame:
    """uid, s, e, item, n: stretches of documents along which windows of an item stand."""
    adjusted = postings.join(sent_if_small(anchors, size), "term").select("uid", "item", "place", (F.col("position") - F.col("place")).alias("diagonal"))
    wanted = pairs.groupBy("item").agg(F.collect_set(F.struct("a", "b")).alias("windows"))
    lists = adjusted.groupBy("uid", "item", "diagonal").agg(F.collect_set("place").alias("places")).join(sent_if_small(wanted, size), "item")
    met = lists.where(F.exists("windows", lambda w: F.array_contains("places", w["a"]) & F.array_contains("places", w["b"]))).select("uid", "item", "diagonal")
    met = common.stored(met, f"{path}/met")
    compared = index.rows.select("uid", "words").join(sent_if_small(met, met.count()), "uid").join(sent_if_small(items.select("item", "item_words"), size), "item")
    runs = compared.select("uid", "item", "diagonal", F.size("item_words").alias("n"), F.inline(equal_runs(F.col("words"), F.col("item_words"), F.col("diagonal"))))
    return common.stored(runs.select("uid", (F.col("s") + F.col("diagonal")).alias("s"), (F.col("e") + F.col("diagonal")).alias("e"), "item", "n", F.col("s").alias("j")), f"{path}/exact")


def covered(hits: DataFrame) -> DataFrame:
    """uid, n_hit: how many places of a document the stretches cover."""
    order = Window.partitionBy("uid").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce(before, F.lit(0))))
    return hits.select("uid", "s", "e").distinct().withColumn("new", new).groupBy("uid").agg(F.sum("new").cast("long").alias("n_hit"))


def items_hit(hits: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """uid, item_id of every item of which a window stands in the document: also of items that share a window with the one it was found by."""
    window = F.when(F.col("n") >= WINDOW, F.slice("item_words", F.col("j") + 1, WINDOW)).otherwise(F.col("item_words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("item_words") - WINDOW, F.lit(0)))
    each = items.select("item", "item_id", F.size("item_words").alias("n"), "item_words", F.explode(starts).alias("j")).select("item", "item_id", "j", window.alias("window"))
    shared = each.groupBy("window").agg(F.count("*").alias("uses")).where("uses > 1").select("window")
    each = each.join(shared, "window", "left_semi")
    spans = hits.select("uid", "item", "j", (F.col("j") + F.col("e") - F.col("s")).alias("end"), "n").distinct()
    direct = spans.join(sent_if_small(items.select("item", "item_id"), size), "item").select("uid", "item_id")
    last = F.when(F.col("n") >= WINDOW, F.col("end") - WINDOW).otherwise(F.col("j"))
    windows = spans.select("uid", "item", F.explode(F.sequence("j", last)).alias("j")).join(sent_if_small(each.select("item", "j", "window"), size), ["item", "j"]).select("uid", "window").distinct()
    return direct.union(windows.join(sent_if_small(each.select("window", "item_id"), size), "window").select("uid", "item_id")).distinct()


def near_terms(items: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items that may be near (item, item_id, own, stretch, need), and of each the rarest terms of which a stretch that is near has two."""
    own = items.select("item", "item_id", (F.size("item_words") + SLACK).alias("stretch"), F.array_distinct("item_words").alias("own")).where(F.size("own") >= LEAST_NEAR)
    own = own.withColumn("need", F.ceil(F.size("own") * NEAR / 100).cast("int"))
    terms = own.select("item", "stretch", "need", F.size("own").alias("n"), F.explode("own").alias("term")).join(counts, "term", "left")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("seen", F.lit(0)), "term"))
    return own, terms.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.col("need") + 2).select("item", "stretch", "term")


def near_hits(index: Index, postings: DataFrame, own: DataFrame, rare: DataFrame, size: int, path: str) -> DataFrame:
    """uid, item_id of every item that a document comes near to."""
    met = postings.join(sent_if_small(rare, size), "term")
    order = Window.partitionBy("uid", "item").orderBy("position")
    # Two of them within a stretch: then two neighbours that differ are.
    close = (F.lag("term").over(order) != F.col("term")) & (F.col("position") - F.lag("position").over(order) < F.col("stretch"))
    met = common.stored(met.withColumn("close", close).where("close").select("uid", "item").distinct(), f"{path}/close")
    looked = index.rows.select("uid", "words").join(sent_if_small(met, met.count()), "uid").join(sent_if_small(own, size), "item")
    places = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("term"), i.alias("q"))), lambda x: F.array_contains("own", x["term"]))
    places = looked.select("uid", "item", "item_id", "stretch", "need", F.inline(places))
    # A stretch from i counts a word at q if that is its first there: after the last such word before q, and no more than a stretch before q.
    last = F.lag("q").over(Window.partitionBy("uid", "item", "term").orderBy("q"))
    begin = F.greatest(F.coalesce(last, F.lit(-(1 << 30))), F.col("q") - F.col("stretch")) + 1
    steps = places.withColumn("begin", begin).select("uid", "item", "item_id", "need", F.inline(F.array(F.struct(F.col("begin").alias("at"), F.lit(1).alias("d")), F.struct((F.col("q") + 1).alias("at"), F.lit(-1).alias("d")))))
    sums = F.sum("d").over(Window.partitionBy("uid", "item").orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("held", sums).where("held >= need").select("uid", "item_id").distinct()


def matches(index: Index, benchmark: DataFrame, path: str, *columns: Column) -> DataFrame:
    """Per row, after further columns of the index's rows: uid, n_words, n_hit (words inside windows), n_full (words inside windows of full length), item_ids with an exact window, near_ids."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("item_words")).where(F.size("item_words") > 0)
    items = common.stored(items.withColumn("item", F.monotonically_increasing_id()), f"{path}/items")
    terms = items.select(F.explode("item_words").alias("term")).distinct()
    # Bounds every table of items, windows or terms that is sent.
    size = items.agg(F.coalesce(F.sum(F.size("item_words")), F.lit(0))).first()[0]
    counts = common.stored(index.postings.join(sent_if_small(terms, size), "term", "left_semi").groupBy("term").agg(F.count("*").alias("seen")), f"{path}/counts")
    pairs = common.stored(window_terms(items, counts), f"{path}/windows")
    anchors = common.stored(anchor_terms(items, pairs), f"{path}/anchors")
    own, rare = near_terms(items, counts)
    rare = common.stored(rare, f"{path}/rare")
    # The index is read once more, for all lists that are wanted.
    wanted = anchors.select("term").union(rare.select("term")).distinct()
    lists = common.stored(index.postings.join(sent_if_small(wanted, size), "term", "left_semi"), f"{path}/lists")
    hits = exact_hits(index, lists, items, pairs, anchors, size, path)
    near = near_hits(index, lists, own, rare, size, path)

    def ids(found: DataFrame, name: str) -> DataFrame:
        return found.groupBy("uid").agg(F.array_sort(F.collect_set("item_id")).alias(name))

    out = index.rows.select(*columns, "uid", F.size("words").cast("long").alias("n_words"))
    for part in (covered(hits), covered(hits.where(F.col("n") >= WINDOW)).withColumnRenamed("n_hit", "n_full"), ids(items_hit(hits, items, size), "item_ids"), ids(near, "near_ids")):
        out = out.join(part, "uid", "left")
    none = F.array().cast("array<string>")
    first = [c for c in out.columns if c not in ("n_hit", "n_full", "item_ids", "near_ids")]
    return out.select(*first, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_hit", "n_full")], *[F.coalesce(c, none).alias(c) for c in ("item_ids", "near_ids")])


def verdict() -> Column:
    """Contaminated by share: one word in ONE_IN or more is hit."""
    return (F.col("n_hit") > 0) & (ONE_IN * F.col("n_hit") >= F.col("n_words"))


def leaks() -> Column:
    """Not fit to train on: a whole window stands anywhere, however long the document; items shorter than a window count by their share."""
    return (F.col("n_full") > 0) | verdict()


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id with what ``matches`` says of each row."""
    path = common.shared_dir(docs.sparkSession, "positions")
    index = Index.build(docs.select("doc_id", "text"), f"{path}/index", with_text=False)
    return matches(index, benchmark, path, index.column("doc_id").cast("long").alias("doc_id")).drop("uid")


def digest_columns(found: DataFrame) -> DataFrame:
    def sha(ids: str) -> Column:
        return F.sha2(F.array_join(ids, ",").cast("binary"), 256)

    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), sha("item_ids").alias("items_sha256"), verdict().alias("contaminated"),
        F.size("near_ids").cast("long").alias("n_near"), sha("near_ids").alias("near_sha256"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, rejected: Column | None = None) -> DataFrame:
    """The rows of docs, all columns, without those that ``verdict()``, or another condition on the columns of ``matches``, rejects."""
    path = common.shared_dir(docs.sparkSession, "positions")
    index = Index.build(docs, f"{path}/index")
    bad = common.stored(matches(index, benchmark, path).where(verdict() if rejected is None else rejected).select("uid"), f"{path}/bad")
    common.drop_path(docs.sparkSession, f"{path}/index/postings")
    return index.rows.join(sent_if_small(bad, bad.count()), "uid", "left_anti").select(*[F.col(c).alias(name) for c, name in index.names.items()])
