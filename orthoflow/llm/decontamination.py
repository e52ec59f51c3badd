"""Benchmark decontamination with a distributed positional inverted index.

DataFrame functions only. Of every window of ten item words the rarest term that
the training corpus has is its anchor; neighbouring windows mostly share it. The
index holds the postings of the anchor terms: document, position, and the words
at the nine positions on either side, so that the lists of the other terms,
adjusted by their offsets, are intersected in place, outwards from the rarest.
One more posting for each document stands behind its last word.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoflow.llm.scratch import attach, stored

WINDOW = 10
#: A match by proximity has so many different words of those around the item's anchor.
NEAR = 7
#: ASCII characters that end a word, after A-Z became a-z.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Query tables of at most so many rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000
#: The term of the posting behind a document's last word; no word has this character.
END = "\0"


def lower_ascii(text: Column) -> Column:
    """text with A-Z as a-z, all other characters as they are."""
    # in a text of ASCII, which has as many bytes as characters, lower() does just that, and faster
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    """Lower-case words as an array; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def anchors(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rarest term of each window of each item that the corpus has, once for each position.

    Columns: term, item (id as text), at (its position), n (words of the item),
    freq (in the corpus), item_before, item_after (the words around it, nearest
    first). A window none of whose words is in the corpus has no anchor.
    """
    item = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
    key = F.sha2(F.concat_ws(" ", F.length("item"), "item", F.array_join("w", " ")), 256)
    item = stored(item.where(F.size("w") > 0).distinct().select(key.alias("key"), "item", "w"), "items")
    each = item.select("key", "item", F.size("w").alias("n"), F.posexplode("w").alias("at", "term"))
    terms = stored(each.groupBy("term").agg(F.count(F.lit(1)).alias("uses")), "item-terms")
    corpus = docs.select(F.explode(words(F.col("text"))).alias("term"))
    if terms.count() <= BROADCAST_ROWS:
        corpus = corpus.join(F.broadcast(terms.select("term")), "term")
    # each task counts before the shuffle, so that no common word is a hot key
    seen = corpus.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    freq = stored(terms.join(seen, "term", "left").select("term", "uses", F.coalesce("freq", F.lit(0)).alias("freq")), "term-frequencies")
    # an item is one text, so its words fit into one task
    along, k = Window.partitionBy("key").orderBy("at"), window - 1
    here = F.when(F.col("freq") > 0, F.struct("freq", "at"))
    places = attach(each, freq, "term", "uses").withColumns(
        {
            "best": F.min(here).over(along.rowsBetween(0, k)),
            "item_before": F.reverse(F.collect_list("term").over(along.rowsBetween(-k, -1))),
            "item_after": F.collect_list("term").over(along.rowsBetween(1, k)),
        }
    )
    places = stored(places.select("key", "term", "item", "at", "n", "freq", "best", "item_before", "item_after"), "item-places")
    starts = places.where((F.col("at") <= F.greatest(F.col("n") - window, F.lit(0))) & F.col("best").isNotNull())
    chosen = starts.select("key", F.col("best.at").alias("at")).distinct()
    return places.join(chosen, ["key", "at"]).select("term", "item", "at", "n", "freq", "item_before", "item_after")


def _before(w: str, at: str, k: int) -> Column:
    return F.reverse(F.slice(w, F.greatest(F.col(at) - (k - 1), F.lit(1)), F.least(F.col(at), F.lit(k))))


def _after(w: str, at: str, k: int) -> Column:
    return F.slice(w, F.col(at) + 2, F.lit(k))


def _run(a: str, b: str) -> Column:
    """How many leading elements of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first == 0, F.greatest(F.size(a), F.size(b))).otherwise(first - 1)


def postings(docs: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """The index: term, doc_id, text_hash, pos, before, after for each occurrence of a term.

    terms: term and freq, stored. Each document has one posting of END as well,
    whose pos is its number of words.
    """
    k = window - 1
    each = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w")).select(
        "doc_id", "text_hash", "w", F.posexplode(F.concat("w", F.array(F.lit(END)))).alias("pos", "term")
    )
    held = lambda side: F.when(F.col("term") != END, side).otherwise(F.array().cast("array<string>"))
    around = [held(_before("w", "pos", k)).alias("before"), held(_after("w", "pos", k)).alias("after")]
    columns = ["term", "doc_id", "text_hash", "pos"]
    if terms.count() <= BROADCAST_ROWS:
        return each.join(F.broadcast(terms.select("term")), "term").select(*columns, *around)
    return attach(each.select(*columns, *around), terms, "term", "freq").select(*columns, "before", "after")


def index(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The anchors of items and the postings of their terms, both stored."""
    query = stored(anchors(docs, items, window), "anchors")
    terms = query.select("term", "freq").distinct()
    ends = terms.agg(F.lit(END).alias("term"), (F.coalesce(F.sum("freq"), F.lit(0)) + 1).cast("long").alias("freq"))
    terms = stored(terms.unionByName(ends), "anchor-terms")
    return query, stored(postings(docs, terms, window), "postings")


def intersected(query: DataFrame, held: DataFrame, window: int = WINDOW, near: int = NEAR) -> DataFrame:
    """Phrase and proximity matches of stored anchors and postings, see matches()."""
    words_only = held.where(F.col("term") != END)
    if query.count() <= BROADCAST_ROWS:
        hit = words_only.join(F.broadcast(query), "term")
    else:
        hit = attach(words_only, query, "term", "freq")
    around = F.size(F.array_intersect(F.concat("before", "after"), F.concat("item_before", "item_after")))
    exact = F.when(F.col("n") >= window, F.col("left") + F.col("right") + 1 >= window).otherwise(
        (F.col("left") == F.col("at")) & (F.col("right") == F.col("n") - 1 - F.col("at"))
    )
    return (
        hit.withColumns({"left": _run("before", "item_before"), "right": _run("after", "item_after")})
        .withColumn("exact", exact)
        .where(F.col("exact") | (around >= near))
        .select("doc_id", "text_hash", "item", (F.col("pos") - F.col("left")).alias("lo"), (F.col("pos") + F.col("right") + 1).alias("hi"), "exact")
    )


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, near: int = NEAR) -> DataFrame:
    """Phrase and proximity matches: doc_id, text_hash, item, lo, hi, exact.

    Exact: the document words from lo to before hi are those of the item, at
    least a whole window of them. Otherwise the match is by proximity: at least
    `near` different words of those around the item's anchor stand, in any
    order, around the document's anchor. An item's copy with a word changed has
    such a match, as anchors are words that the corpus has. Empty tables have no
    match; texts are read whole, however long.
    """
    return intersected(*index(docs, items, window), window, near)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, near: int = NEAR) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    n_near counts the items that the document has by proximity only. A text of
    null or without words has none hit. An item without words matches nothing;
    an item of fewer words than a window is one window. A null item_id counts as
    the empty id, and repeated ids count once. Rows that repeat id and text get
    the same result, and further columns of docs or items are ignored. Without
    documents there is no row, without items nothing is hit. Very long texts are
    read whole; a posting carries only the words around it.
    """
    query, held = index(docs, items, window)
    found = intersected(query, held, window, near)
    exact = lambda x: F.when(F.col("exact"), x)
    by_doc = found.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(exact(F.struct("lo", "hi")))).alias("spans"),
        F.sort_array(F.collect_set(exact(F.col("item")))).alias("hit_items"),
        F.collect_set("item").alias("all_items"),
    )
    zero = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end"))
    union = F.aggregate(
        "spans",
        zero,
        lambda acc, s: F.struct(
            (acc["covered"] + F.greatest(s["hi"] - F.greatest(s["lo"], acc["end"]), F.lit(0))).alias("covered"),
            F.greatest(s["hi"], acc["end"]).alias("end"),
        ),
    )["covered"]
    hits = by_doc.select(
        F.col("doc_id").alias("hit_doc_id"),
        F.col("text_hash").alias("hit_text_hash"),
        union.cast("long").alias("hit_words"),
        F.size("hit_items").cast("long").alias("hit_n_items"),
        F.array_join("hit_items", ",").alias("hit_ids"),
        (F.size("all_items") - F.size("hit_items")).cast("long").alias("near_items"),
    )
    rows = held.where(F.col("term") == END).select("doc_id", "text_hash", F.col("pos").cast("long").alias("n_words"))
    same = rows["doc_id"].eqNullSafe(hits["hit_doc_id"]) & (rows["text_hash"] == hits["hit_text_hash"])
    return rows.join(hits, same, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("hit_words", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("hit_n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("hit_ids", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("hit_words", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("near_items", F.lit(0)).cast("long").alias("n_near"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of an item occurs.

    Null and empty texts stay; rows that repeat id and text stay or go together;
    without items all rows stay.
    """
    hit = matches(docs, items, window).where("exact").select(
        F.col("doc_id").alias("_hit_id"), F.col("text_hash").alias("_hit_hash")
    ).distinct()
    same = docs["doc_id"].eqNullSafe(hit["_hit_id"]) & (F.xxhash64(docs["text"]) == hit["_hit_hash"])
    return docs.join(hit, same, "left_anti")
