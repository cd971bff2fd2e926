"""Benchmark decontamination over a positional inverted index, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import ascii_lower, materialise

#: What stands between words: every ASCII character but 0-9 and a-z, after A-Z were lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Positions that a word of a near match may stand away from its place in the window.
SLOP = 1
#: The term of the posting that holds a document's length; no word is empty.
LENGTH = ""
#: Words of 64 bits in the bitmap that keeps other documents' postings from the last shuffle: 512 kB at any size.
BITMAP_WORDS = 65_536
#: Rows of a join's side, of some 100 bytes each, up to which it may be sent whole to driver and tasks.
BROADCAST_ROWS = 100_000


def by_rows(side: DataFrame, rows: int) -> DataFrame:
    """``side`` of a join, kept from being sent whole where ``rows``, the number of its rows, is large.

    The planner goes by the size of the files that a side is read from. Those
    of windows and occurrences are packed many times, and one row of them
    becomes many, so it would take sides for small that fill the driver.
    """
    return side.hint("merge") if rows > BROADCAST_ROWS else side


def words(text: Column) -> Column:
    """The words of a whole text in order; none if it is null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def build_index(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings ``term, doc_id, row_hash, pos`` of whole texts, written and sorted by term within each file.

    The index is dealt out by document: each task writes the postings of the
    documents that it read, so nothing is shuffled, and the order by term lets
    a reader of few terms skip most pages. ``row_hash`` tells rows apart that
    share an id. One posting with an empty term holds a document's number of
    words as its position.

    ``terms`` (column ``term``) names the terms that will ever be asked for;
    without it every term is indexed.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_hash"), F.concat(words(F.col(text_col)), F.array(F.lit(LENGTH))).alias("terms"))
    postings = rows.select("doc_id", "row_hash", F.posexplode("terms").alias("pos", "term"))
    if terms is not None:
        wanted = terms.select("term").unionByName(terms.sparkSession.range(1).select(F.lit(LENGTH).alias("term"))).distinct()
        wanted = materialise(wanted, "test-terms")
        postings = postings.join(by_rows(wanted, wanted.count()), "term", "left_semi")
    return materialise(postings.select("term", "doc_id", "row_hash", "pos").sortWithinPartitions("term"), "postings")


def item_windows(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, item, start, length, places``; ``places`` are the window's (at, term) by position in the item.

    ``item`` tells rows apart that share an id. An item of fewer words than
    ``window`` is one window; one without words has none.
    """
    rows = items.select(F.col(id_col).alias("item_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("item"), words(F.col(text_col)).alias("terms")).where(F.size("terms") > 0).distinct()
    length = F.least(F.lit(window), F.size("terms"))
    starts = rows.withColumn("length", length).withColumn("start", F.explode(F.sequence(F.lit(0), F.size("terms") - F.col("length"))))
    places = F.transform(F.slice("terms", F.col("start") + 1, F.col("length")), lambda term, i: F.struct((F.col("start") + i).alias("at"), term.alias("term")))
    return starts.select("item_id", "item", "start", "length", places.alias("places"))


def rarest_first(windows: DataFrame, index: DataFrame) -> DataFrame:
    """Windows whose terms all occur, with their rarest places ``first`` and ``second`` by postings in the index.

    Ties go to the earlier place, so that neighbouring windows share places. A
    window of one word has its only place twice.
    """
    counts = index.where(F.col("term") != LENGTH).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    spread = windows.select("item", "start", "length", F.explode("places").alias("place")).select("item", "start", "length", "place.at", "place.term")
    n_places = windows.select(F.sum(F.size("places"))).first()[0] or 0
    known = by_rows(spread, n_places).join(counts, "term").groupBy("item", "start", "length").agg(F.array_sort(F.collect_list(F.struct("n", "at", "term"))).alias("by_count"))
    known = known.where(F.size("by_count") == F.col("length"))
    named = known.select("item", "start", F.col("by_count")[0].alias("first"), F.coalesce(F.get("by_count", F.lit(1)), F.col("by_count")[0]).alias("second"))
    return by_rows(windows, n_places).join(named, ["item", "start"])


def only_rows_of(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Postings whose document may be among ``wanted``: one bit for each hash of a row.

    The bitmap has a fixed size, so it can go to every task. Other documents
    pass where they share a bit; the join behind it sorts them out.
    """
    bits = 64 * BITMAP_WORDS
    slot = lambda h: F.pmod(h, F.lit(bits))
    word, bit = F.floor(slot(F.col("row_hash")) / 64).cast("int"), F.pmod(F.col("row_hash"), F.lit(64)).cast("int")
    held = wanted.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("set"))
    none = wanted.sparkSession.range(BITMAP_WORDS).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("set"))
    filled = held.unionByName(none).groupBy("word").agg(F.bit_or("set").alias("set"))
    bitmap = materialise(filled.agg(F.array_sort(F.collect_list(F.struct("word", "set"))).alias("all")).select(F.col("all.set").alias("bitmap")), "row-bitmap")
    found = F.call_function("shiftrightunsigned", F.get(bitmap.select("bitmap").scalar(), word), bit).bitwiseAND(F.lit(1).cast("long"))
    return postings.where(found == 1)


def find_windows(index: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """``doc_id, row_hash, item_id, start, length, doc_start, off``: where windows stand in documents.

    ``off`` is the largest distance of a word from its place: 0 in an exact
    occurrence, up to ``slop`` in a near one, in which the rarest word stands
    in its place and every other word within ``slop`` of its own. ``doc_start``
    is the first word of the exact window.

    Lists are intersected from the rarest term on: the postings of a window's
    rarest term, moved by its place in the item, are candidates; those stay for
    which the second-rarest term has a posting in its place; only then the
    other terms are looked up, in the documents that are left. All three steps
    are equi-joins on (term, document, position).
    """
    postings = index.where(F.col("term") != LENGTH).select("term", F.coalesce("doc_id", F.lit(0)).alias("doc"), "row_hash", "pos")
    ranked = materialise(rarest_first(windows, index), "ranked-windows")
    near = lambda at: F.explode(F.sequence(at - slop, at + slop))

    pairs = ranked.select("item", F.col("first.term").alias("term"), F.col("first.at").alias("a"), F.col("second.at").alias("b"), F.col("second.term").alias("other")).distinct()
    pairs = materialise(pairs, "rarest-pairs")
    begun = postings.join(by_rows(pairs, pairs.count()), "term").select("doc", "row_hash", "item", "a", "b", F.col("other").alias("term"), (F.col("pos") - F.col("a")).alias("shift"))
    begun = begun.withColumn("pos", near(F.col("shift") + F.col("b")))
    seconds = materialise(pairs.select(F.col("other").alias("term")).distinct(), "second-terms")
    met = begun.join(postings.join(by_rows(seconds, seconds.count()), "term", "left_semi"), ["term", "doc", "row_hash", "pos"]).select("doc", "row_hash", "item", "shift", "a", "b").distinct()

    of_pair = ranked.select("item", F.col("first.at").alias("a"), F.col("second.at").alias("b"), "start", "length", "places")
    left = materialise(met.join(by_rows(of_pair, ranked.select(F.sum(F.size("places"))).first()[0] or 0), ["item", "a", "b"]).select("doc", "row_hash", "item", "shift", "start", "length", "places"), "met-windows")
    wanted = left.withColumn("place", F.explode("places")).select("doc", "row_hash", "item", "shift", "start", "length", "place.at", "place.term")
    wanted = by_rows(wanted.withColumn("pos", near(F.col("shift") + F.col("at"))), (2 * slop + 1) * (left.select(F.sum("length")).first()[0] or 0))
    rest = only_rows_of(postings, left.select("row_hash").distinct())
    matched = wanted.join(rest, ["term", "doc", "row_hash", "pos"]).groupBy("doc", "row_hash", "item", "shift", "start", "length", "at").agg(F.min(F.abs(F.col("pos") - F.col("shift") - F.col("at"))).alias("off"))
    whole = matched.groupBy("doc", "row_hash", "item", "shift", "start", "length").agg(F.count(F.lit(1)).alias("held"), F.max("off").alias("off")).where("held = length")
    names = windows.select("item", "item_id").distinct()
    return whole.join(by_rows(names, windows.count()), "item").select("doc", "row_hash", "item_id", "start", "length", (F.col("shift") + F.col("start")).alias("doc_start"), "off")


def find_phrase(index: DataFrame, phrase: str, slop: int = 0) -> DataFrame:
    """Exact and near places of one phrase of any length; columns as in ``find_windows``."""
    one = index.sparkSession.createDataFrame([(0, phrase)], "item_id long, text string")
    return find_windows(index, item_windows(one, 2**30), slop)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    slop: int = SLOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, items, near_items``.

    A window is ``window`` consecutive words of an item, or all of a shorter
    item. ``n_hit`` counts the document's words inside any exact occurrence of
    a window; ``items`` are the ids of the items with one, as sorted strings;
    ``near_items`` are those of items with a near occurrence only (see
    ``find_windows``).

    Plan: an index of the terms that the items use is written in one scan of
    the texts. The last step counts the words that each occurrence adds to
    those before it in its document, over intervals, never over words.

    Defined cases: a null or empty text has no words and no hits; an item
    without words has no windows; rows that share an id are judged one by one
    (equal rows get equal results); a null id stays null; windows of items
    without an id count as hits, but such items are not listed; an item id in
    several rows is one item with the windows of all of them; empty tables give
    no hits; columns besides the four named ones are not read.
    """
    windows = materialise(item_windows(benchmark, window, item_id_col, item_text_col), "item-windows")
    index = build_index(docs, windows.select(F.explode("places.term").alias("term")), id_col, text_col)
    found = materialise(find_windows(index, windows, slop), "found-windows")
    key = ["doc", "row_hash"]

    spans = found.where("off = 0").groupBy(*key, "doc_start").agg(F.max("length").alias("length"))
    end = F.col("doc_start") + F.col("length")
    so_far = "coalesce(max(doc_start + length) over (partition by doc, row_hash order by doc_start rows between unbounded preceding and 1 preceding), 0)"
    added = F.greatest(F.lit(0), end - F.greatest("doc_start", F.expr(so_far)))
    hits = spans.select(*key, added.alias("added")).groupBy(*key).agg(F.sum("added").cast("long").alias("n_hit"))

    by_item = found.where("item_id is not null").groupBy(*key, F.col("item_id").cast("string").alias("item_id")).agg(F.min("off").alias("off"))
    listed = by_item.groupBy(*key).agg(F.sort_array(F.collect_list(F.when(F.col("off") == 0, F.col("item_id")))).alias("items"), F.sort_array(F.collect_list(F.when(F.col("off") > 0, F.col("item_id")))).alias("near_items"))

    lengths = index.where(F.col("term") == LENGTH).select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("doc"), "row_hash", F.col("pos").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    n_found = found.count()
    return lengths.join(by_rows(hits, n_found), key, "left").join(by_rows(listed, n_found), key, "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))


def digest(result: DataFrame) -> DataFrame:
    """The items as a count and a SHA-256 of their comma-joined ids, and the flag."""
    return result.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), w AS (
  SELECT item_id, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS s, ws FROM b WHERE len(ws) > 0
), grams AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[s:s + n - 1], ' ') AS g FROM w
), spots AS (
  SELECT k, n, unnest(range(1, len(ws) - n + 2)) AS s, ws FROM d, (SELECT DISTINCT n FROM grams) WHERE len(ws) >= n
), found AS (
  SELECT a.k, a.s, a.n, g.item_id FROM (SELECT k, n, s, array_to_string(ws[s:s + n - 1], ' ') AS g FROM spots) a JOIN grams g USING (n, g)
), hit AS (
  SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS p FROM found) GROUP BY k
), items AS (
  SELECT k, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT k, item_id::VARCHAR AS i FROM found WHERE item_id IS NOT NULL) GROUP BY k
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN items USING (k)
"""
