"""Benchmark decontamination by a distributed positional inverted index.

The index holds the postings (term, document row, position) of all terms that
any benchmark item uses, in shards: every task of the scan writes the postings
of its own documents, ordered by term, so that a reader of few terms skips the
rest, and nothing is shuffled to build it. One more row for each document
carries its id and its number of words.

A benchmark text is read as windows of ``width`` consecutive words (a shorter one
is one window). Terms are counted in the index; each window names its two rarest
places. The list of the rarest term, moved back by its place, gives (document,
diagonal) candidates; the list of the second one, moved back likewise, keeps
those that it meets. What is left is compared with the lists of all terms of the
windows around the two places, in the documents that are left. Stretches of a
diagonal as long as a window are exact occurrences, and nothing else is: every
step is an equality of terms and positions, none of hashes alone.

``near_matches`` asks the same index for proximity: all terms of a window, in
any order, within ``width + slack`` words.

Everything is a DataFrame expression. Terms and candidates are broadcast only
below a counted number of rows, and joined by shuffle beyond it. Nulls have no
words. Empty texts and tables give no hits. Items without an id are left out;
items of equal words share their windows, and each is named. Rows of one id are
judged each by its own text, and repeated rows get equal results. Very long texts
are read whole. Ties between rare places go to the leftmost one. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: What separates words, once A to Z are lower-case: every ASCII character but digits and lower-case letters.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class DecontaminationParams:
    width: int = 10
    slack: int = 5  # of near matches
    most_broadcast: int = 200_000  # rows


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), NO_WORD), "")


def small(df: DataFrame, p: DecontaminationParams) -> DataFrame:
    """df, to be broadcast if it has few rows; it should be a stored table."""
    return F.broadcast(df) if df.limit(p.most_broadcast + 1).count() <= p.most_broadcast else df


@dataclass
class Items:
    """Benchmark texts: members (seq, item_id), places (seq, n, ipos, word) of the distinct word sequences."""

    members: DataFrame
    places: DataFrame


def read_items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Items:
    """Items of equal words are one sequence."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(text_col)).alias("w")).filter("item_id is not null and size(w) > 0")
    rows = materialise(rows.withColumn("print", F.sha2(F.array_join("w", " "), 256)), "benchmark")
    numbered = materialise(rows.dropDuplicates(["print"]).select(F.monotonically_increasing_id().alias("seq"), "print", "w"), "sequences")
    places = numbered.select("seq", F.size("w").alias("n"), F.posexplode("w").alias("ipos", "word"))
    return Items(rows.select("print", "item_id").distinct().join(numbered.select("print", "seq"), "print").drop("print"), materialise(places, "places"))


def build_index(docs: DataFrame, terms: DataFrame, p: DecontaminationParams = DecontaminationParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: row, pos, word and, where word is null, the document's id (pos is then its number of words)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("_id"), F.coalesce(words_of(F.col(text_col)), F.array().cast("array<string>")).alias("w"))
    tokens = rows.select("row", "_id", F.posexplode(F.array_append("w", F.lit(None).cast("string"))).alias("pos", "word"))
    kept = tokens.join(small(terms.select("word", F.lit(True).alias("known")), p), "word", "left").filter("known or word is null")
    postings = kept.select("word", "row", "pos", F.when(F.col("word").isNull(), F.col("_id")).alias("_id"))
    return materialise(postings.sortWithinPartitions("word", "row", "pos"), "postings")


def rare_pairs(items: Items, index: DataFrame, p: DecontaminationParams) -> DataFrame:
    """seq, n, and the rarest and second rarest place of every window (i, word, j, other); a window of one word has the same place twice."""
    counts = index.filter("word is not null").groupBy("word").agg(F.count("*").alias("seen"))
    counted = items.places.join(counts, "word")  # a window that holds a word the index lacks occurs nowhere
    w = Window.partitionBy("seq").orderBy("ipos").rangeBetween(0, p.width - 1)
    rare = counted.withColumn("in_window", F.sort_array(F.collect_list(F.struct("seen", "ipos", "word")).over(w)))
    whole = rare.filter(F.size("in_window") == F.least(F.col("n"), F.lit(p.width))).filter(f"n >= {p.width} or ipos = 0")
    first, second = F.col("in_window")[0], F.coalesce(F.get("in_window", F.lit(1)), F.col("in_window")[0])
    return whole.select("seq", "n", first["ipos"].alias("i"), first["word"].alias("word"), second["ipos"].alias("j"), second["word"].alias("other")).distinct()


def exact_matches(items: Items, index: DataFrame, p: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """row, seq, begin and end (exclusive) of every stretch of a document that equals a stretch of an item and holds whole windows."""
    pairs = materialise(rare_pairs(items, index, p), "pairs")
    lists = index.filter("word is not null").select("word", "row", "pos")
    diagonal = (F.col("pos") - F.col("i")).alias("diagonal")
    # The rarest list of every window, moved back by its place; a pair's rarest place is looked up once for all windows that share it.
    found = lists.join(small(pairs.select("seq", "i", "word").distinct(), p), "word").select("row", "seq", "i", diagonal)
    # The second list, moved back likewise, must meet it.
    wanted = found.join(small(pairs.select("seq", "n", "i", "j", "other"), p), ["seq", "i"]).select("row", "seq", "n", "i", "j", "diagonal", F.col("other").alias("word"), (F.col("diagonal") + F.col("j")).alias("pos"))
    both = wanted.join(lists.join(small(pairs.select(F.col("other").alias("word")).distinct(), p), "word", "left_semi"), ["row", "pos", "word"])
    reach = F.sequence(F.greatest(F.greatest("i", "j") - (p.width - 1), F.lit(0)), F.least(F.least("i", "j") + (p.width - 1), F.col("n") - 1))
    around = materialise(both.select("row", "seq", "n", "diagonal", F.explode(reach).alias("ipos")).distinct(), "around")
    # All lists of the windows around, in the documents that are left.
    expected = around.join(items.places.select("seq", "ipos", "word"), ["seq", "ipos"]).select("row", "seq", "n", "diagonal", "ipos", "word", (F.col("diagonal") + F.col("ipos")).alias("pos"))
    here = lists.join(small(around.select("row").distinct(), p), "row", "left_semi")
    met = expected.join(here.distinct(), ["row", "pos", "word"]).select("row", "seq", "n", "diagonal", "ipos")
    run = F.col("ipos") - F.row_number().over(Window.partitionBy("row", "seq", "diagonal").orderBy("ipos"))
    stretches = met.withColumn("run", run).groupBy("row", "seq", "n", "diagonal", "run").agg(F.min("ipos").alias("from"), F.max("ipos").alias("to"))
    return stretches.filter(F.col("to") - F.col("from") + 1 >= F.least(F.col("n"), F.lit(p.width))).select("row", "seq", (F.col("diagonal") + F.col("from")).alias("begin"), (F.col("diagonal") + F.col("to") + 1).alias("end"))


def near_matches(items: Items, index: DataFrame, p: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """row, seq, start (the window's first place in the item) and pos (of its rarest word in the document): all words of the window, in any order, within width + slack words that begin or end anywhere around pos.

    The lists of the window's two rarest words meet within that reach first; then those of all its words do.
    """
    span = p.width + p.slack
    counts = index.filter("word is not null").groupBy("word").agg(F.count("*").alias("seen"))
    counted = items.places.join(counts, "word")
    w = Window.partitionBy("seq").orderBy("ipos").rangeBetween(0, p.width - 1)
    windows = counted.withColumn("in_window", F.collect_list(F.struct("seen", "word")).over(w)).filter(F.size("in_window") == F.least(F.col("n"), F.lit(p.width))).filter(f"n >= {p.width} or ipos = 0")
    windows = windows.select("seq", F.col("ipos").alias("start"), F.array_sort(F.array_distinct("in_window")).alias("terms"))
    windows = materialise(windows.select("seq", "start", F.size("terms").alias("least"), F.col("terms")[0]["word"].alias("word"), F.transform("terms", lambda t: t["word"]).alias("words")), "windows")
    lists = index.filter("word is not null").select("word", "row", "pos").distinct()
    block = lambda c, k: F.floor(F.col(c) / span) + k
    rarest = lists.join(small(windows, p), "word").select("row", "seq", "start", "least", "words", F.col("pos").alias("at"))
    blocks = F.explode(F.array(block("at", -1), block("at", 0), block("at", 1))).alias("block")
    second = rarest.select("*", F.coalesce(F.get("words", F.lit(1)), F.col("words")[0]).alias("word"), blocks).join(lists.withColumn("block", block("pos", 0)), ["row", "block", "word"]).filter(F.abs(F.col("pos") - F.col("at")) < span)
    left = materialise(second.select("row", "seq", "start", "least", "words", "at").distinct(), "near")
    around = left.select("row", "seq", "start", "least", "at", F.explode("words").alias("word"), blocks)
    held = around.join(lists.withColumn("block", block("pos", 0)), ["row", "block", "word"]).filter(F.abs(F.col("pos") - F.col("at")) < span)
    reach = Window.partitionBy("row", "seq", "start", "at").orderBy("pos").rangeBetween(0, span - 1)
    within = held.withColumn("words_within", F.size(F.collect_set("word").over(reach))).filter("words_within = least and pos <= at")
    return within.groupBy("row", "seq", "start", F.col("at").alias("pos")).agg(F.min("pos").alias("from")).select("row", "seq", "start", "pos")


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: DecontaminationParams = DecontaminationParams(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """id, n_words, n_hit, items (ids of the items with occurring windows, as sorted strings), one row for each document."""
    items = read_items(benchmark, item_col, text_col)
    terms = materialise(items.places.select("word").distinct(), "terms")
    index = build_index(docs, terms, p, id_col, text_col)
    hits = materialise(exact_matches(items, index, p), "hits")
    places = hits.select("row", F.explode(F.sequence("begin", F.col("end") - 1)).alias("pos")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    named = hits.select("row", "seq").distinct().join(items.members, "seq").groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    found = materialise(places.join(named, "row"), "found")
    documents = index.filter("word is null").select("row", F.col("_id").alias(id_col), F.col("pos").cast("long").alias("n_words"))
    return documents.join(small(found, p), "row", "left").select(id_col, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("*", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")).drop("items")
