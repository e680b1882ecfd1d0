"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

The index stores the postings of the rarest terms of each window of benchmark words, by their
occurrences in the corpus.  A posting less the term's place in its item names a diagonal of
document and item.  The lists of an item's terms are brought together by diagonal; a window
goes on where all its rarest terms stand on one diagonal.  What remains of it is compared in
the neighbourhood that is stored with the posting of the rarest.  A proximity match needs the
terms of a window near that posting, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: ASCII characters that part words become spaces, and A-Z become a-z.
_PARTS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms of a window whose postings are brought together, from the rarest.
RAREST = 2
#: Estimated bytes of a side that is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    spaced = F.translate(text, _PARTS + _UPPER, " " * len(_PARTS) + _LOWER)  # a plain separator needs no pattern matching
    return F.coalesce(F.array_remove(F.split(spaced, " ", -1), ""), F.array().cast("array<string>"))


def windows_of(benchmark: DataFrame, width: int) -> DataFrame:
    """item (a key of the row), item_id, q (place in the item) and win: each run of ``width`` words, or a shorter item whole.

    A run that an item repeats is there once, at its first place: where it occurs in a document
    doesn't depend on that, and an item of few words over and over is few windows.
    """
    keyed = benchmark.select(F.xxhash64("item_id", "text").alias("item"), "item_id", words_of(F.col("text")).alias("w"))
    items = keyed.filter(F.size("w") > 0).dropDuplicates(["item", "item_id", "w"])
    last = F.greatest(F.size("w") - width, F.lit(0))
    every = items.select("item", "item_id", F.explode(F.sequence(F.lit(0), last)).alias("q"), "w").select(
        "item", "item_id", "q", F.slice("w", F.col("q") + 1, F.lit(width)).alias("win"))
    return every.groupBy("item", "item_id", "win").agg(F.min("q").alias("q"))


def _small(df: DataFrame, weight: Column) -> tuple[DataFrame, bool]:
    """The frame, to be broadcast where the sum of its rows' estimated bytes has shown that it is small."""
    small = df.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0] <= BROADCAST_BYTES
    return (F.broadcast(df) if small else df), small


def _term_bytes(term: str = "term") -> Column:
    return F.octet_length(term) + 48


def rarest_terms(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows with rare: their RAREST rarest terms (n, off, term) by occurrences in all of ``docs``; windows with an absent term are gone."""
    vocabulary, small = _small(stage(windows.select(F.explode("win").alias("term")).distinct(), "vocabulary"), _term_bytes())
    tokens = docs.select(F.explode_outer(words_of(F.col("text"))).alias("term"))  # outer: no filter that would make the words twice
    counted = tokens.join(vocabulary, "term") if small else tokens
    counts = counted.groupBy("term").agg(F.count(F.lit(1)).alias("n"))  # counted before anything moves
    counts, _ = _small(stage(counts if small else counts.join(vocabulary, "term"), "term-counts"), _term_bytes())
    terms = windows.select("item", "item_id", "q", "win", F.posexplode("win").alias("off", "term"))
    rated = terms.join(counts, "term", "left").groupBy("item", "item_id", "q", "win").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "term"))).alias("rare"))
    return rated.filter(F.col("rare")[0]["n"] > 0).withColumn("rare", F.slice("rare", 1, RAREST))


def postings(docs: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """The index: term, document and pos of the terms (term, lead); where a term leads a window also ctx, the ``reach`` words on each side, with the term at ``at``."""
    shown, small = _small(terms, _term_bytes())
    words = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_k"), words_of(F.col("text")).alias("_w"))
    low = F.greatest(F.col("pos") - reach, F.lit(0))
    ctx, at = F.slice("_w", low + 1, F.col("pos") - low + reach + 1), (F.col("pos") - low).alias("at")
    if small:  # the neighbourhood is cut out only where a term is kept
        tokens = words.select("doc_id", "_k", "_w", F.posexplode_outer("_w").alias("pos", "term"))
        return tokens.join(shown, "term").select("term", "lead", "doc_id", "_k", "pos", F.when(F.col("lead"), ctx).alias("ctx"), at)
    # bare postings move, those of other terms only where even digests of the terms are too many to be told to all tasks
    tokens = words.select("doc_id", "_k", F.posexplode_outer("_w").alias("pos", "term"))
    digests, told = _small(terms.select(F.xxhash64("term").alias("digest")).distinct(), F.lit(32))
    if told:
        tokens = tokens.join(digests, F.xxhash64("term") == F.col("digest"), "left_semi")
    found = stage(tokens.join(terms, "term"), "bare-postings")
    leads = found.filter("lead").groupBy("doc_id", "_k").agg(F.collect_set(F.struct("pos", "term")).alias("leads"))  # of one document
    cut = leads.alias("l").join(words.dropDuplicates(["doc_id", "_k"]).alias("w"), _same_row("l", "w")).select("l.doc_id", "l._k", "_w", F.explode("leads").alias("p")).select(
        F.col("p.term").alias("term"), F.lit(True).alias("lead"), "doc_id", "_k", F.col("p.pos").alias("pos"), "_w")
    rest = found.filter(~F.col("lead")).select("term", "lead", "doc_id", "_k", "pos", F.lit(None).cast("array<string>").alias("ctx"), F.lit(0).alias("at"))
    return cut.select("term", "lead", "doc_id", "_k", "pos", ctx.alias("ctx"), at).unionByName(rest)


def _same_row(left: str, right: str) -> Column:
    return F.col(f"{left}._k").eqNullSafe(F.col(f"{right}._k")) & F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id"))


def _phrases(index: DataFrame, rare: DataFrame) -> DataFrame:
    """doc_id, _k, start, n, item_id of every exact occurrence of a window."""
    bytes_of = F.octet_length(F.array_join("win", " ")) + 120
    places = rare.select("item", F.explode("rare").alias("r"), "q").select("item", (F.col("q") + F.col("r.off")).alias("place"), F.col("r.term").alias("term")).distinct()
    wanted, _ = _small(places, _term_bytes())
    lists = index.select("term", "doc_id", "_k", "pos").join(wanted, "term").select("doc_id", "_k", "item", (F.col("pos") - F.col("place")).alias("diagonal"), "place")
    met = lists.groupBy("doc_id", "_k", "item", "diagonal").agg(F.collect_set("place").alias("places"))
    sought = rare.select("item", "item_id", "q", "win", F.transform("rare", lambda r: F.col("q") + r["off"]).alias("need"), (F.col("q") + F.col("rare")[0]["off"]).alias("led"), F.col("rare")[0]["term"].alias("term"))
    least = rare.groupBy("item").agg(F.min(F.size("rare")).alias("least"))
    met = met.join(_small(least, F.lit(24))[0], "item").filter(F.size("places") >= F.col("least"))
    aligned = met.join(_small(sought, bytes_of)[0], "item").filter(F.size(F.array_except("need", "places")) == 0).select(
        "doc_id", "_k", "item_id", "win", "term", (F.col("diagonal") + F.col("q")).alias("start"), (F.col("diagonal") + F.col("led")).alias("pos"))
    around = index.filter("lead").select("term", "doc_id", "_k", "pos", "ctx", "at")
    joined = aligned.alias("a").join(around.alias("i"), (F.col("a.term") == F.col("i.term")) & (F.col("a.pos") == F.col("i.pos")) & _same_row("a", "i"))
    first = F.col("at") - (F.col("a.pos") - F.col("start"))
    whole = (first >= 0) & (F.slice("ctx", F.greatest(first, F.lit(0)) + 1, F.size("win")) == F.col("win"))
    return joined.filter(whole).select("a.doc_id", "a._k", "start", F.size("win").alias("n"), "item_id").distinct()


def _near(index: DataFrame, rare: DataFrame, slop: int) -> DataFrame:
    """doc_id, _k, pos, item, item_id: postings of a window's rarest term with all its words within ``slop`` more than its width on either side."""
    wants, _ = _small(rare.select("item", "item_id", "win", F.col("rare")[0]["term"].alias("term"), F.transform("rare", lambda r: r["term"]).alias("rarer")), F.octet_length(F.array_join("win", " ")) + 160)
    rarer = F.forall("rarer", lambda t: F.array_contains(F.col("ctx"), t))  # the cheap test first
    joined = index.filter("lead").join(wants, "term").filter(rarer).filter(F.size(F.array_except("win", "ctx")) == 0)
    return joined.select("doc_id", "_k", "pos", "item", "item_id").distinct()


def find_matches(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, slop: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(phrases, near): phrases has doc_id, _k, start, n, item_id of every exact occurrence of a window.

    With ``slop``, near has doc_id, _k, pos, item, item_id of the places around which all words
    of a window lie within ``slop`` words more than the window's width on either side.
    """
    rare = stage(rarest_terms(docs, windows_of(benchmark, width)), "rare-terms")
    told = rare.select(F.posexplode("rare").alias("rank", "r")).groupBy(F.col("r.term").alias("term")).agg((F.min("rank") == 0).alias("lead"))
    index = stage(postings(docs, stage(told, "terms"), width - 1 + (slop or 0)), "postings")
    return _phrases(index, rare), None if slop is None else _near(index, rare, slop)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, slop: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near of every document.

    A word inside any exact occurrence of a window is hit; n_near counts the items with a
    window whose words all lie near each other (``slop``), exact occurrences among them.  Null
    and empty texts have no words; items without words have no windows, and an item without an
    id marks words but is not listed; repeated rows are each judged, and a repeated item is
    one; equally rare terms are taken in their order in the window; texts of any length are
    searched whole; an empty table on either side gives no hits; other columns are ignored,
    whatever their names.
    """
    docs = docs.select("doc_id", "text")
    phrases, near = find_matches(docs, benchmark.select("item_id", "text"), width=width, slop=slop)
    runs = phrases.groupBy("doc_id", "_k").agg(F.collect_set(F.struct("start", "n")).alias("runs"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["n"] - 1))))
    hits = runs.select("doc_id", "_k", F.size(covered).cast("long").alias("hit"), F.size("items").cast("long").alias("n_listed"), F.concat_ws(",", "items").alias("items"))
    close = near.groupBy("doc_id", "_k").agg(F.count_distinct("item").alias("close"))
    base = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_k"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    joined = base.alias("b").join(hits.alias("h"), _same_row("b", "h"), "left").join(close.alias("c"), _same_row("b", "c"), "left")
    return joined.select(
        "b.doc_id", "n_words", F.coalesce("hit", F.lit(0)).alias("n_hit"), F.coalesce("n_listed", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"), F.coalesce("close", F.lit(0)).alias("n_near"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, width: int = 10) -> DataFrame:
    """The documents without an occurrence of any benchmark window, items without an id included; the cases are as in ``decontaminate``."""
    found, _ = find_matches(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), width=width)
    bad = found.select("_k", "doc_id").distinct()
    same = F.xxhash64("d.doc_id", "d.text").eqNullSafe(F.col("f._k")) & F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))
    return docs.alias("d").join(bad.alias("f"), same, "left_anti")
