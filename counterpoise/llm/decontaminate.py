"""Benchmark decontamination by a prefix-filtered join of word windows.

A benchmark item's windows are its runs of ``WINDOW`` words (one window, if it has fewer). Words are the
tokens of the join: counted over the whole corpus and ordered by rarity, a window contained in a document
must have its rarest word there, so one word is the necessary prefix for exact containment. Windows whose
rarest word the corpus doesn't have are out. Documents' words meet the index of rarest words; a match fixes
where the window would begin, which must lie inside the document with all its length; then the words of
that stretch are compared with the window's.

Only DataFrame functions are used. If a count shows that the index is small, it is broadcast and documents are
judged where they are read. Otherwise places and words alone are exchanged, frequent words in several runs, and
candidates meet their document's words once, where the stretch's digest (SHA-256) is compared with the window's.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.llm.common import discard, fresh, is_small, materialize, q, reading, settled, small, with_row_ids

WINDOW = 10
#: Places of one word that one run holds when words are exchanged.
RUN = 1_000_000
#: What parts words, once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone; ASCII texts take the short way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), lambda w: w != "")


def windows(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Distinct windows: wid, w (its words), items (ids of the items that have it, as strings)."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1)))
    runs = items.select("item", "w", starts.alias("s")).select("item", F.slice("w", F.col("s"), size).alias("w"))
    return runs.groupBy("w").agg(F.collect_set("item").alias("items"))


def _digest(run: Column) -> Column:
    """Of a run of words, in 32 bytes: words hold no space."""
    return F.unhex(F.sha2(F.array_join(run, " "), 256))


def _hits_in_place(source: DataFrame, index: DataFrame) -> DataFrame:
    """uid, id, begin, len, items of all windows, and for every document one row of length 0 whose begin is its number of words.

    ``source``: uid, id, text_words. The index is broadcast; nothing is exchanged.
    """
    # Every document ends in an empty word, whose place tells how many words there are.
    none = index.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(0).alias("off"), F.lit(0).alias("len"), F.array().cast("array<string>").alias("w"), F.array().cast("array<string>").alias("items"))
    full = index.select("word", "off", "len", "w", "items").unionByName(none)
    ended = source.withColumn("text_words", F.concat("text_words", F.array(F.lit(""))))
    met = ended.select("uid", "id", "text_words", F.posexplode("text_words").alias("pos", "word")).join(F.broadcast(full), "word")
    begin = F.col("pos") - F.col("off")
    inside = (F.col("len") == 0) | ((begin >= 0) & (begin + F.col("len") < F.size("text_words")) & (F.slice("text_words", begin + 1, F.col("len")) == F.col("w")))
    return met.where(inside).select("uid", "id", begin.alias("begin"), "len", "items")


def _hits_by_word(source: DataFrame, index: DataFrame, run: int) -> DataFrame:
    """The same rows by exchange. ``source`` must be a stored table's. A word with many places is dealt in runs of about ``run``."""
    runs = F.ceil(F.greatest(F.lit(1), F.col("n")) / run).cast("int")
    narrow = materialize(index.select("word", "off", "len", "wid", _digest(F.col("w")).alias("digest"), runs.alias("runs")), "narrow")
    frequent = materialize(narrow.where("runs > 1").groupBy("word").agg(F.max("runs").alias("of")), "frequent")
    seen = source.select("uid", F.posexplode("text_words").alias("pos", "word")).join(small(frequent), "word", "left")
    seen = seen.select("uid", "pos", "word", F.pmod(F.xxhash64("uid", "pos"), F.coalesce("of", F.lit(1))).cast("int").alias("run"))
    dealt = narrow.withColumn("run", F.explode(F.sequence(F.lit(0), F.col("runs") - 1))).drop("runs")
    begin = F.col("pos") - F.col("off")
    met = seen.join(dealt, ["word", "run"]).where(begin >= 0).select("uid", begin.alias("begin"), "len", "wid", "digest")
    held = met.join(source.select("uid", "text_words"), "uid").where((F.col("begin") + F.col("len") <= F.size("text_words")) & (_digest(F.slice("text_words", F.col("begin") + 1, F.col("len"))) == F.col("digest")))
    hits = held.select("uid", "begin", "len", "wid").join(index.select("wid", "items"), "wid").drop("wid")
    ends = source.select("uid", "id", F.size("text_words").alias("begin"), F.lit(0).alias("len"), F.array().cast("array<string>").alias("items"))
    return ends.unionByName(hits, allowMissingColumns=True)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, uid_col: str | None = None, broadcast: bool | None = None, run: int = RUN) -> DataFrame:
    """One row for each row of ``docs``: uid, id, n_words, n_hit (words inside a benchmark window), items (sorted ids).

    ``uid`` is the stored column ``uid_col``, or else a number that holds for this result alone. ``broadcast`` says how
    the index meets the documents; by default its size does. Null texts have no words and are never hit; empty items are
    ignored; equal items and repeated rows count each for itself. Without benchmark items or documents the result is
    clean or empty.
    """
    wins = materialize(windows(benchmark, item_col, item_text_col, size).withColumn("wid", F.monotonically_increasing_id()), "windows")
    vocabulary = materialize(wins.select(F.explode("w").alias("word")).distinct(), "vocabulary")
    counts = docs.select(F.explode(words(q(text_col))).alias("word")).join(small(vocabulary), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarity = materialize(counts, "rarity")
    places = wins.select("wid", "w", "items", F.posexplode("w").alias("off", "word")).join(rarity, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = F.row_number().over(Window.partitionBy("wid").orderBy("n", "word", "off"))
    index = materialize(places.withColumn("k", rarest).where("k = 1 and n > 0").select("wid", "word", F.col("off").cast("int"), F.size("w").alias("len"), "w", "items", "n"), "index")
    discard(wins, vocabulary, rarity)

    if broadcast is None:
        broadcast = is_small(index)
    if uid_col is None and not broadcast:  # it is read more than once
        uid_col = fresh(docs, "_uid")["_uid"]
        docs = with_row_ids(docs, uid_col)
    uid = F.monotonically_increasing_id() if uid_col is None else q(uid_col)
    source = docs.select(uid.alias("uid"), q(id_col).alias("id"), words(q(text_col)).alias("text_words"))
    hits = _hits_in_place(source, index) if broadcast else _hits_by_word(source, index, run)
    whole = F.col("len") == 0
    by_text = hits.groupBy("uid").agg(
        F.max(F.when(whole, F.col("id"))).alias("id"),
        F.max(F.when(whole, F.col("begin"))).alias("n_words"),
        F.collect_set(F.when(~whole, F.struct("begin", "len"))).alias("spans"),
        F.collect_set(F.when(~whole, F.col("items"))).alias("items"),
    )
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["begin"], s["begin"] + s["len"] - 1)))))
    found = by_text.select("uid", "id", F.col("n_words").cast("long").alias("n_words"), F.greatest(hit, F.lit(0)).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    return reading(found, index)


def document_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: how many words it has, how many stand in benchmark windows, of how many items, and a digest of their ids."""
    found = contamination(docs.select("doc_id", "text"), benchmark)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark window, with their own columns. Null, empty and repeated rows and empty tables are
    as ``contamination`` says. The rows are numbered once, in a stored table."""
    uid = fresh(docs, "_uid")["_uid"]
    rows = with_row_ids(docs, uid)
    base = contamination(rows, benchmark, uid_col=uid)
    bad = settled(base.where("n_hit > 0").select(F.col("uid").alias(uid)), base, "leaks")
    return rows.join(small(bad), uid, "left_anti").select(*(q(c) for c in docs.columns))
