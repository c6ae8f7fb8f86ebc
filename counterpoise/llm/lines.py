"""Line deduplication by a deletion-neighbourhood join.

Two lines are equal for this operator if their normal forms (lower case, single spaces) are at most one
character edit apart. Of equal lines the earliest stays, in order of (doc_id, row, line), and a line
goes if any earlier line equals it. Lines under ``MIN_CHARS`` characters always stay.

1. Exact copies are settled by digest, within a slice of rows before anything is exchanged.
2. Of two lines one edit apart, one has a half that the other shares exactly (the edit is in the other
   half), at known lengths. Distinct lines that share no half with another have no partner and stop here.
3. The others emit their deletion variants as hashed keys: one for each character left out, with its
   place (a substitution) and without it (an insertion or deletion, met by the whole shorter line). Only
   places outside the shared half are left out, as no other variant can meet its partner's.
4. Equal variants are joined by key: all lines of a substitution key are one edit apart from each
   other, and those of a deletion key from the one whole line, so the least rank of a key is a partner for
   all its members and no pairs within a key are formed.
5. Each line's least partner is verified by edit distance on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.llm.common import discard, fresh, map_batches, materialize, q, reading, settled, slices, small, with_row_ids
from counterpoise.llm.shingles import GOLD, _power_tables, mix

MIN_CHARS, SLICE = 20, 1 << 21
_U = np.uint64
TEXT, OPEN, REPEAT = 0, 1, 2
SUBSTITUTE, WHOLE, DELETE = 0, 1, 2


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lines in a row, and where each begins (one more at the end)."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(_U)
    return codes, np.concatenate([[0], np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))])


def _sums(values: np.ndarray) -> np.ndarray:
    up, _ = _power_tables(len(values) + 1)
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def half_length(n: np.ndarray) -> np.ndarray:
    return n // 2


def line_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of the digest of each line, and its four shared-half keys.

    The keys are the prefix and the suffix for pairs whose shorter line is as long as this one, then both
    for pairs whose shorter line is one shorter.
    """
    codes, at = _codes(lines)
    a, b, n = at[:-1], at[1:], np.diff(at)
    _, down = _power_tables(len(codes) + 1)
    s1, s2 = _sums(codes * GOLD), _sums(mix(codes + _U(77)))
    size = n.astype(_U)
    d1 = mix((s1[b] - s1[a]) * down[a] + size)
    d2 = mix((s2[b] - s2[a]) * down[a] + size)
    keys = []
    for less in (0, 1):
        m = n - less
        f = half_length(m)
        head = (s1[a + f] - s1[a]) * down[a]
        tail = (s1[b] - s1[b - (m - f)]) * down[b - (m - f)]
        for which, h in enumerate((head, tail)):
            keys.append(mix(mix(h + _U(which + 1) * _U(0x51ED2701)) + m.astype(_U) * GOLD))
    return d1, d2, np.column_stack(keys)


def variants(lines: list[str], shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line number, key and role of every variant that a partner could meet. ``shares``: which of the four keys are shared."""
    codes, at = _codes(lines)
    s = _sums(codes * GOLD)
    up, down = _power_tables(len(codes) + 1)
    of, keys, roles = [], [], []
    for i in range(len(lines)):
        a, n = at[i], at[i + 1] - at[i]
        f, g = n // 2, (n - 1) // 2
        if shares[i, 0] or shares[i, 1]:
            of.append(np.array([i]))
            keys.append(mix((s[a + n : a + n + 1] - s[a]) * down[a] + _U(n)))
            roles.append(np.array([WHOLE]))
        for role, low, high, size in ((SUBSTITUTE, 0 if shares[i, 1] else f, n if shares[i, 0] else f, f), (DELETE, 0 if shares[i, 3] else g, n if shares[i, 2] else g + 1, g)):
            first, second = (shares[i, 1], shares[i, 0]) if role == SUBSTITUTE else (shares[i, 3], shares[i, 2])
            if not (first or second):
                continue
            p = np.arange(low, high)
            if not len(p):
                continue
            left = (s[a + p] - s[a]) * down[a]
            right = (s[a + n] - s[a + p + 1]) * down[a + 1]  # moved one place to the left
            v = left + right
            if role == SUBSTITUTE:
                v = mix(mix(v + _U(n)) + (p.astype(_U) + _U(1)) * GOLD)
            else:
                v = np.unique(mix(v + _U(n - 1)))
            of.append(np.full(len(v), i))
            keys.append(v)
            roles.append(np.full(len(v), role))
    if not of:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(of), np.concatenate(keys).view(np.int64), np.concatenate(roles).astype(np.int32)


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int, uid_col: str | None = None) -> DataFrame:
    uid = F.monotonically_increasing_id() if uid_col is None else q(uid_col)
    source = docs.select(uid.alias("uid"), q(id_col).alias("id"), q(text_col).alias("text"))
    long = T.LongType()
    schema = T.StructType([source.schema["uid"], source.schema["id"], T.StructField("line", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("d1", long), T.StructField("d2", long), T.StructField("halves", T.ArrayType(long)), T.StructField("norm", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in slices(batch.column(2), SLICE):
                part = batch.slice(begin, len(texts))
                uid, ids = part.column(0).to_numpy(), part.column(1)
                by_id = pa.compute.sort_indices(pa.table({"i": ids, "u": part.column(0)}), [("i", "ascending"), ("u", "ascending")], null_placement="at_end").to_pylist()
                of, line, norm, kind = [], [], [], []
                seen: set[str] = set()
                for i in by_id:
                    parts = texts[i].split("\n")
                    of.append(i)
                    line.append(len(parts))
                    norm.append(None)
                    kind.append(TEXT)
                    for k, x in enumerate(parts):
                        if len(x) >= min_chars and len(x := normal(x)) >= min_chars:
                            of.append(i)
                            line.append(k)
                            kind.append(REPEAT if x in seen else OPEN)
                            norm.append(x if kind[-1] == OPEN else None)
                            seen.add(x)
                open_ = np.array([k for k, x in enumerate(kind) if x == OPEN], np.int64)
                # Settled rows need no company: a digest of their own deals them out evenly.
                own = mix(uid[of].astype(_U) * GOLD + np.array(line, np.int64).astype(_U))
                d1, d2 = own.copy(), own
                halves = [None] * len(of)
                if len(open_):
                    x1, x2, keys = line_keys([norm[k] for k in open_])
                    d1[open_], d2[open_] = x1, x2
                    for k, row in zip(open_.tolist(), keys.view(np.int64).tolist(), strict=True):
                        halves[k] = row
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid[of]), ids.take(pa.array(of)), pa.array(line, pa.int32()), pa.array(kind, pa.int32()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(halves, pa.list_(pa.int64())), pa.array(norm, pa.string())],
                    names=schema.names,
                )

    return map_batches(source, run, schema)


def _variant_rows(lines: DataFrame) -> DataFrame:
    """lines: none, id, uid, line, norm, shared (the places of its shared keys)."""
    schema = T.StructType([*(lines.schema[c] for c in ("none", "id", "uid", "line")), T.StructField("key", T.LongType()), T.StructField("role", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column(5).to_pylist()
            for begin, texts in slices(batch.column(4), 1 << 17):
                marks = np.zeros((len(texts), 4), bool)
                for i, places in enumerate(shared[begin : begin + len(texts)]):
                    marks[i, places] = True
                of, key, role = variants(texts, marks)
                rows = pa.array(of + begin, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(4)), pa.array(key), pa.array(role)], names=schema.names)

    return map_batches(lines.select("none", "id", "uid", "line", "norm", "shared"), run, schema)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, uid_col: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: uid, id, n_lines, exact and near, the numbers (from 0) of the lines that go.

    ``uid`` is the stored column ``uid_col``, or else a number that holds for this result alone.
    Null texts count as one empty line. Repeated rows lose their lines to the first of them; null ids rank
    last. An empty table gives an empty result.
    """
    rows = materialize(line_rows(docs, id_col, text_col, min_chars, uid_col), "lines")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "uid", "line")
    first = F.row_number().over(Window.partitionBy("d1", "d2").orderBy(rank))
    firsts = materialize(rows.where(F.col("kind") == OPEN).select("uid", "id", "line", "d1", "d2", "halves", first.alias("n")).withColumn("halves", F.when(F.col("n") == 1, F.col("halves"))), "firsts")
    lines = firsts.where("n = 1").select("uid", "line", F.posexplode("halves").alias("place", "half"))
    shared_keys = lines.groupBy("half").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("half")
    sharing = materialize(lines.join(shared_keys, "half").groupBy("uid", "line").agg(F.collect_set("place").alias("shared")), "sharing")
    texts = materialize(rows.where(F.col("kind") == OPEN).select(F.col("id").isNull().alias("none"), "id", "uid", "line", "norm").join(small(sharing), ["uid", "line"]), "texts")
    met = materialize(_variant_rows(texts), "variants")
    own = F.struct("none", "id", "uid", "line")
    least = lambda role: F.min(F.when(F.col("role") == role, own))
    groups = met.groupBy("key").agg(least(SUBSTITUTE).alias("s"), least(WHOLE).alias("w"), least(DELETE).alias("d"), F.count(F.when(F.col("role") == SUBSTITUTE, 1)).alias("n")).where("n > 1 or (w is not null and d is not null)").drop("n")
    other = F.when(F.col("role") == SUBSTITUTE, F.col("s")).when(F.col("role") == WHOLE, F.col("d")).otherwise(F.col("w"))
    partner = met.join(groups, "key").select("uid", "line", own.alias("own"), other.alias("other")).where("other < own").groupBy("uid", "line").agg(F.min("other").alias("other"))
    pairs = partner.select("uid", "line", F.col("other.uid").alias("o_uid"), F.col("other.line").alias("o_line"))
    norm = texts.select("uid", "line", "norm")
    pairs = pairs.join(norm, ["uid", "line"]).join(norm.select(F.col("uid").alias("o_uid"), F.col("line").alias("o_line"), F.col("norm").alias("o_norm")), ["o_uid", "o_line"])
    near = materialize(pairs.where(F.levenshtein("norm", "o_norm", 1) >= 0).select("uid", "line"), "near")
    discard(sharing, texts, met)

    nothing = F.lit(None)
    marked = (
        rows.where(F.col("kind") == TEXT).select("uid", F.col("id"), F.lit(True).alias("text"), F.col("line").alias("n"), nothing.cast("int").alias("exact"), nothing.cast("int").alias("near"))
        .unionByName(rows.where(F.col("kind") == REPEAT).select("uid", "id", F.lit(False).alias("text"), nothing.cast("int").alias("n"), F.col("line").alias("exact"), nothing.cast("int").alias("near")))
        .unionByName(firsts.where("n > 1").select("uid", "id", F.lit(False).alias("text"), nothing.cast("int").alias("n"), F.col("line").alias("exact"), nothing.cast("int").alias("near")))
        .unionByName(near.select("uid", nothing.cast(docs.schema[id_col].dataType).alias("id"), F.lit(False).alias("text"), nothing.cast("int").alias("n"), nothing.cast("int").alias("exact"), F.col("line").alias("near")))
    )
    found = marked.groupBy("uid").agg(F.max(F.when(F.col("text"), F.col("id"))).alias("id"), F.max("n").alias("n_lines"), F.sort_array(F.collect_list("exact")).alias("exact"), F.sort_array(F.collect_list("near")).alias("near"))
    return reading(found, rows, firsts, near)


def document_lines(docs: DataFrame) -> DataFrame:
    """Of each document: how many lines it has, how many go as exact and as near repeats, and their numbers joined by commas.

    A null text is one empty line; null and repeated doc_ids are rows like any other, and of equal lines the one with
    the least (doc_id, row, line) stays; an empty table gives an empty result.
    """
    found = repeated_lines(docs.select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.size("exact").cast("long").alias("n_exact"), F.size("near").cast("long").alias("n_near"), F.concat_ws(",", F.sort_array(F.concat("exact", "near")).cast("array<string>")).alias("removed"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without repeated lines. A document that had a counted line and keeps nothing but blank lines goes.

    Null and empty texts and other columns stay as they are; of repeated rows the first keeps its lines. An empty
    table gives an empty result. The rows are numbered once, in a stored table.
    """
    n = fresh(docs, "_uid", "_gone")
    rows = with_row_ids(docs, n["_uid"])
    base = repeated_lines(rows, id_col, text_col, uid_col=n["_uid"])
    found = settled(base.select(F.col("uid").alias(n["_uid"]), F.concat("exact", "near").alias(n["_gone"])).where(F.size(n["_gone"]) > 0), base, "repeats")
    joined = rows.join(found.hint("merge"), n["_uid"], "left")  # texts are exchanged at any size, so that disk is in proportion to them
    gone, text = F.col(n["_gone"]), q(text_col)
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    out = joined.withColumn(text_col, F.when(gone.isNull(), text).otherwise(kept))
    out = out.where(gone.isNull() | (F.length(F.trim(F.translate(text, "\n\t\r", ""))) > 0))
    return out.select(*(q(c) for c in docs.columns))
