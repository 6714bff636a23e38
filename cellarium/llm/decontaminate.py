"""Operator 6, benchmark decontamination over a positional inverted index, in DataFrame functions only.

The index holds a posting (document, term, position) for each occurrence of a benchmark term, written where the
document was read, with no shuffle. Each benchmark window is looked up by its two rarest terms: their lists, less the
terms' offsets in the window, are intersected by (document, window start); what is left is compared, by a digest of the
words that stand there, with the window. A digest of 128 bits stands for the words, so that a document's candidates are
short rows whatever the number of items that share a passage; items are met after the comparison. Proximity: an item's
`RARE` rarest different terms, all within `NEAR` words of an occurrence of the rarest.

Windows of the benchmark, their terms and the counts of these have a size that the corpus doesn't change; `meet`
broadcasts them behind a check of their size and salts the keys beyond it.

Edge cases: a null or empty text has no words; an item without words has no window; one of fewer words than a window
is a window; a null item_id counts as an item and adds nothing to the digest; equal item_ids are one item; equal rows
of documents are judged each; an empty table gives no row, an empty benchmark no hit; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, meet, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE, NEAR = 4, 20


def split_words(text: Column) -> Column:
    """Words in order; the first and the last entry may be empty."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)


def number_of_words(w: Column) -> Column:
    last = F.element_at(w, -1)
    return F.size(w) - (w[0] == "").cast("int") - ((F.size(w) > 1) & (last == "")).cast("int")


def keys() -> list[Column]:
    """(d, h), which rows of equal id and text share."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("h")]


def keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keys())


def positional_index(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (d, h, term, pos) of the terms (columns word, term), stored."""
    words = keyed(documents).select("d", "h", F.posexplode(split_words(F.col("text"))).alias("pos", "word"))
    return stored(meet(words, terms, ["word"]).select("d", "h", "term", "pos"), "postings")


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """item (its id; U+0000 for null), window (a number for its words), win (the words) and digest, each once."""
    w = F.array_remove(split_words(F.col("text")), "")
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("\0")).alias("item"), w.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    rows = rows.select("item", F.explode(F.transform(starts, lambda at: F.slice("w", at + 1, size))).alias("win")).distinct()
    return rows.withColumn("window", F.xxhash64("win")).withColumn("digest", digest(F.col("win")))


def digest(words: Column) -> Column:
    """128 bits for a list of words; no word holds a space."""
    return F.md5(F.array_join(words, " ").cast("binary"))


def with_counts(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """word, term and df, the number of its postings, stored."""
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return stored(terms.join(counts, "term", "left").select("word", "term", F.coalesce("df", F.lit(0)).alias("df")), "counts")


def phrase_candidates(postings: DataFrame, wins: DataFrame, counted: DataFrame) -> DataFrame:
    """(d, h, window, start): both rarest terms of the window stand where it would have them. counted: word, term, df."""
    each = wins.select("window", "win").distinct().select("window", F.posexplode("win").alias("off", "word"))
    each = meet(each, counted, ["word"]).select("window", "off", "term", "df")
    of = Window.partitionBy("window")
    ranked = each.withColumn("rank", F.row_number().over(of.orderBy("df", "off"))).withColumn("least", F.min("df").over(of)).withColumn("n", F.count(F.lit(1)).over(of))
    # a window with a term that no document has is nowhere; one of one word is looked up by that word twice
    ranked = stored(ranked.where("least > 0 and rank <= 2"), "rarest")
    lists = []
    for own in (ranked.where("rank = 1"), ranked.where("rank = 2 or n = 1")):
        lists.append(meet(postings, own.select("term", "window", "off"), ["term"]).select("d", "h", "window", (F.col("pos") - F.col("off")).alias("start")).distinct())
    return lists[0].join(lists[1].hint("merge"), ["d", "h", "window", "start"])


def proximity_matches(postings: DataFrame, wanted: DataFrame, slop: int) -> DataFrame:
    """(query, d, h, pos): documents where all terms of a query stand within `slop` words of an occurrence of its rarest one.

    wanted: columns query, term, df and word, by which equal df are ordered. Lists meet by stretches of `slop` words.
    """
    of = Window.partitionBy("query")
    ranked = wanted.select("query", "term", "word", "df").distinct().withColumn("rank", F.row_number().over(of.orderBy("df", "word"))).withColumn("n", F.count(F.lit(1)).over(of))
    ranked = stored(ranked, "wanted")
    stretch = F.floor(F.col("pos") / max(1, slop)).cast("int")
    anchor = meet(postings, ranked.where("rank = 1").select("query", "term", "n"), ["term"]).select("query", "n", "d", "h", "pos")
    others = meet(postings, ranked.where("rank > 1").select("query", "term"), ["term"]).select("query", "term", "d", "h", F.col("pos").alias("other"), stretch.alias("at"))
    reach = anchor.where("n > 1").withColumn("at", F.explode(F.sequence(stretch - 1, stretch + 1)))
    near = reach.join(others.hint("merge"), ["query", "d", "h", "at"]).where(F.abs(F.col("pos") - F.col("other")) <= slop)
    met = near.groupBy("query", "n", "d", "h", "pos").agg(F.countDistinct("term").alias("met")).where("met = n - 1")
    return met.select("query", "d", "h", "pos").union(anchor.where("n = 1").select("query", "d", "h", "pos"))


def item_terms(wins: DataFrame, counted: DataFrame, rare: int) -> DataFrame:
    """query (the item), term, word and df of each item's rarest different terms that documents have; none where a term of the item's own is in no document."""
    each = meet(wins.select("item", F.explode("win").alias("word")).distinct(), counted, ["word"])
    place = F.row_number().over(Window.partitionBy("item").orderBy("df", "word"))
    least = F.min("df").over(Window.partitionBy("item"))
    return each.withColumn("place", place).withColumn("least", least).where((F.col("place") <= rare) & (F.col("least") > 0)).select(F.col("item").alias("query"), "term", "word", "df")


class Index:
    """The benchmark's windows and terms, and the documents' postings."""

    def __init__(self, documents: DataFrame, benchmark: DataFrame, size: int):
        self.wins = stored(windows(benchmark, size), "windows")
        terms = self.wins.select(F.explode("win").alias("word")).distinct().withColumn("term", F.xxhash64("word"))
        terms = stored(terms, "terms")
        self.postings = positional_index(documents, terms)
        self.counted = with_counts(terms, self.postings)


def hits(documents: DataFrame, index: Index) -> DataFrame:
    """row (all columns of documents), d, h, n_words, n_hit and the windows that occur in it, of each row."""
    found = phrase_candidates(index.postings, index.wins, index.counted)
    known = index.wins.select("window", "digest", F.size("win").alias("size")).distinct()
    lists = meet(found, known, ["window"]).groupBy("d", "h").agg(F.collect_list(F.struct("start", "size", "digest", "window")).alias("found"))
    lists = stored(lists, "found")
    # the lists grow with the corpus: at every size they meet the texts by a shuffle, never by a broadcast
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), *keys())
    rows = rows.join(lists.hint("merge"), ["d", "h"], "left").withColumn("w", split_words(F.col("row.text")))
    real = F.filter("found", lambda c: digest(F.slice(F.col("w"), F.greatest(c["start"], F.lit(0)) + 1, c["size"])) == c["digest"])
    rows = rows.withColumn("n_words", number_of_words(F.col("w")).cast("long")).withColumn("found", real).drop("w")
    places = F.array_distinct(F.flatten(F.transform("found", lambda c: F.sequence(c["start"], c["start"] + c["size"] - 1))))
    own = F.array_distinct(F.transform("found", lambda c: c["window"]))
    return rows.withColumn("n_hit", F.greatest(F.coalesce(F.size(places), F.lit(0)), F.lit(0)).cast("long")).withColumn("windows", own).drop("found")


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = 10, rare: int = RARE, near: int = NEAR) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted texts of ids), contaminated and n_near (items that are met by proximity) of each row."""
    index = Index(documents, benchmark, size)
    rows = stored(hits(documents.select(F.col("doc_id").cast("long"), "text"), index).select("row.doc_id", "d", "h", "n_words", "n_hit", "windows"), "judged")
    owned = rows.where("n_hit > 0").select("d", "h", F.explode("windows").alias("window")).distinct()
    owned = meet(owned, index.wins.select("window", "item"), ["window"]).groupBy("d", "h").agg(F.array_sort(F.collect_set("item")).alias("items"))
    met = proximity_matches(index.postings, item_terms(index.wins, index.counted, rare), near)
    met = met.select("d", "h", "query").distinct().groupBy("d", "h").agg(F.count(F.lit(1)).alias("n_near"))
    rows = rows.join(owned.hint("merge"), ["d", "h"], "left").join(met.hint("merge"), ["d", "h"], "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.array_remove(items, "\0").alias("items"), (F.col("n_hit") > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
