"""Substring deduplication by hashing lines and runs of sentences.

Units of a text are its lines, and from the start of every sentence the shortest run of whole
sentences with ``MIN_WORDS`` words, so that a passage is also found where it stands inside a line.
Only units of ``MIN_WORDS`` words and more count. Units are compared by the digest of their words
(lower case, without marks and spacing). Over the whole table the first occurrence of a unit stays,
in order of (doc_id, row, place), and all others are removed, with their offsets in the original text.

Repetitions within one slice of rows are settled before anything is exchanged: of equal units only the
slice's first can be the table's first. So a digest reaches its task at most once for each slice of
about ``SLICE`` characters, however many documents share it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.llm.common import map_batches, slices
from counterpoise.llm.shingles import _BYTE, _WORD, GOLD, _power_tables, mix

MIN_WORDS, SLICE = 20, 1 << 22
_U = np.uint64
_SALTS = mix(np.array([1, 2], _U) * GOLD)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True


def lower_in_place(text: str) -> str:
    """Lower case with as many code points as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def units(texts: list[str], min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """Of all units of all texts: text number, two halves of the digest, start and end in code points."""
    raw = [lower_in_place(t).encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    inside = _WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate([[1], 1 + np.cumsum([len(r) + 1 for r in raw])])
    empty = (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not len(starts):
        return empty
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts])
    halves = []
    for salt in _SALTS:
        s = np.zeros(len(words) + 1, _U)
        np.cumsum(mix(words + salt) * up[: len(words)], out=s[1:])
        halves.append(s)

    first_word = np.searchsorted(starts, offsets)  # of each text, and the end
    n = len(starts)
    marks = {}
    for name, byte in (("stop", _STOP), ("line", None)):
        seen = np.cumsum(byte[data] if byte is not None else data == 10)
        before = np.concatenate([[True], seen[starts[1:]] > seen[ends[:-1] - 1]])
        before[first_word[:-1][first_word[:-1] < n]] = True
        marks[name] = np.flatnonzero(before)
    out_a, out_b = [], []
    # Runs of sentences, within their text.
    cuts = np.append(marks["stop"], n)
    a = marks["stop"]
    text_of = np.searchsorted(first_word, a, side="right") - 1
    k = np.searchsorted(cuts, a + min_words)
    ok = k < len(cuts)
    b = cuts[np.minimum(k, len(cuts) - 1)]
    ok &= b <= first_word[text_of + 1]
    out_a.append(a[ok])
    out_b.append(b[ok])
    # Lines.
    a, b = marks["line"], np.append(marks["line"][1:], n)
    ok = b - a >= min_words
    out_a.append(a[ok])
    out_b.append(b[ok])
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    if not len(a):
        return empty
    both = np.unique(a * (n + 1) + b)  # a line may be a run as well
    a, b = both // (n + 1), both % (n + 1)
    digest = [mix((s[b] - s[a]) * down[a] + (b - a).astype(_U) * GOLD) for s in halves]
    of = np.searchsorted(first_word, a, side="right") - 1
    points = np.cumsum((data & 0xC0) != 0x80)  # code points up to each byte
    spaces = np.flatnonzero(_SPACE[data])
    till = spaces[np.searchsorted(spaces, ends[b - 1])]  # marks behind the last word go with it
    base = points[offsets[of]] - 1
    return of, digest[0], digest[1], points[starts[a]] - 1 - base, points[till] - 1 - base


_ROW = T.StructType([T.StructField("uid", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("n", T.LongType())])
#: kind: a row for each text (n: its units), a unit that may be the first, a unit that is none.
TEXT, OPEN, REPEAT = 0, 1, 2


def unit_rows(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    source = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([source.schema["id"], *_ROW.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in slices(batch.column(2), SLICE):
                part = batch.slice(begin, len(texts))
                uid = part.column(0).to_numpy()
                ids = part.column(1)
                by_id = np.empty(len(texts), np.int64)
                by_id[pa.compute.sort_indices(pa.table({"i": ids, "u": part.column(0)}), [("i", "ascending"), ("u", "ascending")], null_placement="at_end").to_numpy()] = np.arange(len(texts))
                of, d1, d2, start, end = units(texts, min_words)
                order = np.lexsort((start, by_id[of], d2, d1)) if len(of) else np.zeros(0, np.int64)
                of, d1, d2, start, end = of[order], d1[order], d2[order], start[order], end[order]
                new = np.ones(len(of), bool)
                new[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
                head = np.maximum.accumulate(np.where(new, np.arange(len(of)), 0)) if len(of) else np.zeros(0, np.int64)
                # What overlaps its own first occurrence is part of it, and goes only where that goes.
                overlaps = ~new & (of == of[head]) & (start < end[head])
                end = end.copy()
                np.maximum.at(end, head[overlaps], end[overlaps])
                keep = ~overlaps
                of, d1, d2, start, end, new = of[keep], d1[keep], d2[keep], start[keep], end[keep], new[keep]
                kind = np.where(new, OPEN, REPEAT)
                # Settled rows need no company: a key of their own deals them out evenly.
                own = mix(uid[of].astype(_U) * GOLD + start.astype(_U))
                d1, d2 = np.where(new, d1, own), np.where(new, d2, own)
                n_units = np.bincount(of, minlength=len(texts))
                rows = np.concatenate([np.arange(len(texts)), of])
                own = mix(uid.astype(_U) + GOLD)
                col = lambda one, more: pa.array(np.concatenate([one, more]))
                zeros = np.zeros(len(texts), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), pa.array(uid[rows]), col(own.view(np.int64), d1.view(np.int64)), col(own.view(np.int64), d2.view(np.int64)), col(zeros, start), col(np.array([len(t) for t in texts], np.int64), end), col(np.full(len(texts), TEXT, np.int32), kind.astype(np.int32)), col(n_units, np.zeros(len(of), np.int64))],
                    names=schema.names,
                )

    return map_batches(source, run, schema)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each row of ``docs``: uid, id, n_chars, n_units, n_removed and ``spans``, the removed stretches.

    Spans are (start, end) in code points of the original text, end exclusive, in order, joined where they
    touch or overlap. Null texts count as empty; texts under ``min_words`` words have no unit and stay.
    Of repeated rows the first keeps its text. Null ids rank last. An empty table gives an empty result.
    """
    rows = unit_rows(docs, id_col, text_col, min_words)
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("uid").alias("uid"), F.col("start").alias("start"))
    first = F.row_number().over(Window.partitionBy("d1", "d2").orderBy(rank))
    flagged = rows.withColumn("late", (F.col("kind") == REPEAT) | ((F.col("kind") == OPEN) & (first > 1))).where((F.col("kind") == TEXT) | F.col("late"))
    span = F.when(F.col("late"), F.struct("start", "end"))
    by_text = flagged.groupBy("uid").agg(F.first(F.when(F.col("kind") == TEXT, F.col("id")), ignorenulls=True).alias("id"), F.max(F.when(F.col("kind") == TEXT, F.col("end"))).alias("n_chars"), F.max("n").alias("n_units"), F.count(span).alias("n_removed"), F.array_sort(F.collect_list(span)).alias("found"))
    nothing = F.lit(None).cast("array<struct<start:bigint,end:bigint>>")
    joined = F.aggregate(
        "found",
        F.struct(F.array().cast("array<struct<start:bigint,end:bigint>>").alias("done"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("last")),
        lambda acc, x: F.when(acc["last"].isNull(), F.struct(acc["done"].alias("done"), x.alias("last")))
        .when(x["start"] <= acc["last"]["end"] + 1, F.struct(acc["done"].alias("done"), F.struct(acc["last"]["start"].alias("start"), F.greatest(acc["last"]["end"], x["end"]).alias("end")).alias("last")))
        .otherwise(F.struct(F.concat(acc["done"], F.array(acc["last"])).alias("done"), x.alias("last"))),
        lambda acc: F.when(acc["last"].isNull(), F.coalesce(nothing, acc["done"])).otherwise(F.concat(acc["done"], F.array(acc["last"]))),
    )
    return by_text.select("uid", "id", "n_chars", "n_units", "n_removed", joined.alias("spans"))


def document_repeats(docs: DataFrame) -> DataFrame:
    """What of each document repeats an earlier place: counts, and the removed spans as ``start:end`` joined by commas."""
    found = repeated_spans(docs.select("doc_id", "text"))
    text = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])))
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_chars", "n_units", "n_removed", size.alias("removed_chars"), text.alias("removed_spans"))


def without_spans(text_col: str, spans_col: str = "spans"):
    """Column: the text without its removed spans."""
    s, t = F.col(spans_col), F.col(text_col)
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(s, lambda x: x["end"]))
    starts = F.concat(F.transform(s, lambda x: x["start"]), F.array(F.length(t).cast("long")))
    pieces = F.zip_with(ends, starts, lambda a, b: F.substring(t, (a + 1).cast("int"), (b - a).cast("int")))
    return F.array_join(pieces, "")
