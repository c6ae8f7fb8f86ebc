"""Near-duplicate documents by ProbMinHash on weighted word shingles.

Every shingle of five words starts a Poisson process whose rate is its weight (one plus the
logarithm of its count in the text, and once more one for all); each arrival falls on one of ``BANDS * ROWS`` components, and a
component keeps the shingle that arrived first. Two texts agree in a component with their
probability Jaccard similarity. A text's arrivals end early: once every component is taken, no
arrival after the latest of these first times can matter.

Two texts are linked if at least 0.8 of their shingles, as sets, are common to both. So candidates are drawn by
the signature of the shingles with equal weights, which estimates just that; a text that repeats a shingle has
the bands of its weighted signature too.

Texts with equal words are one class from the start and only its first document goes on. Documents that agree in
all components of a band share a bucket. A bucket of up to ``PAIRS_UP_TO`` documents compares all its pairs. In a
larger one every member first meets the ``CENTRES`` members that are most like the bucket as a whole, as an original is
among its edited copies; most of a bucket then is one class. What isn't is compared exactly, all pairs of different
classes, in blocks. So every pair of a bucket is in one class or was compared. Classes are the components of all links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.llm.common import discard, fresh, map_batches, materialize, q, reading, settled, slices, small, with_row_ids
from counterpoise.llm.components import components
from counterpoise.llm.shingles import GOLD, mix, shingle_hashes, word_hashes

SIZE, SIMILARITY = 5, 0.8
BANDS, ROWS, PAIRS_UP_TO, CENTRES = 40, 8, 8, 4
#: Numbers of 64 bits in a sketch, and how many bits of two sketches may differ. At a similarity of 0.8 a bit differs
#: with probability 0.1, so 59 of 320 are five standard deviations above what is expected.
SKETCH, APART = 5, 59
#: Bits of the sketch that tell how like its bucket a member is.
MAJORITY = 32
#: The most texts and bytes of shingle sets that a block of a large bucket has on average.
BLOCK, BLOCK_BYTES = 128, 1 << 21
_U = np.uint64


def prob_min_hash(shingles: np.ndarray, weights: np.ndarray, of: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (n, m) of n weighted sets: ``shingles`` with their ``weights`` belong to the sets ``of``.

    A set without members has a row of zeros. Each step adds a block of arrivals for the shingles that
    can still win a component; the outcome doesn't depend on the blocks or on the other sets.
    """
    first, winner = np.full(n * m, np.inf), np.zeros(n * m, _U)
    alive, clock, seen = np.arange(len(shingles)), np.zeros(len(shingles)), 0
    while len(alive):
        block = int(np.clip(60_000 // len(alive), 1, 256))
        ticks = _U(2 * seen + 1) + _U(2) * np.arange(block, dtype=_U)
        seed = shingles[alive][:, None]
        gap = -np.log(((mix(seed + ticks * GOLD) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[alive][:, None]
        time = clock[alive][:, None] + np.cumsum(gap, axis=1)
        slot = (mix(seed + (ticks + _U(1)) * GOLD) % _U(m)).astype(np.int64) + of[alive][:, None] * m
        clock[alive] = time[:, -1]
        seen += block
        t, s = time.ravel(), slot.ravel()
        won = np.flatnonzero(t < first[s])
        t, s, who = t[won], s[won], alive[won // block]
        order = np.argsort(-t, kind="stable")  # the earliest is written last
        first[s[order]], winner[s[order]] = t[order], shingles[who[order]]
        last = first.reshape(n, m).max(1)
        alive = alive[clock[alive] < last[of[alive]]]
    return winner.reshape(n, m)


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and their bounds by text; distinct shingles in order, the text of each, and its count there."""
    words, bounds = word_hashes(texts)
    hashes, of = shingle_hashes(words, bounds, SIZE)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return words, bounds, hashes[at], of[at], np.diff(np.append(at, len(new)))


def band_keys(sig: np.ndarray) -> list[list[int]]:
    keys = np.zeros((len(sig), BANDS), _U)
    for r in range(ROWS):
        keys = mix(keys * GOLD + sig[:, r::ROWS][:, :BANDS] + np.arange(BANDS, dtype=_U))
    return keys.view(np.int64).tolist()


def features(texts: list[str]) -> tuple[list[bytes], list[list[int]], np.ndarray, np.ndarray, list[bytes]]:
    """Of each text: digest of its words, band keys, sketch (a bit of each component, as numbers), whether it has a word, packed shingle set.

    Keys and sketch are of the shingles with equal weights, as links are; a text that repeats a shingle has the
    keys of its weighted signature too. Without repeats both signatures are the same.
    """
    words, bounds, hashes, of, counts = shingle_sets(texts)
    sig = prob_min_hash(hashes, np.ones(len(hashes)), of, len(texts))
    keys = band_keys(sig)
    repeats = np.zeros(len(texts), bool)
    repeats[of[counts > 1]] = True
    if repeats.any():
        own = repeats[of]
        weighted = prob_min_hash(hashes[own], 1 + np.log(counts[own]), (np.cumsum(repeats) - 1)[of[own]], int(repeats.sum()))
        for i, more in zip(np.flatnonzero(repeats).tolist(), band_keys(weighted), strict=True):
            keys[i] = sorted({*keys[i], *more})
    digests = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    sketch = np.packbits((mix(sig[:, : 64 * SKETCH] + GOLD) & _U(1)).astype(np.uint8), axis=1).view(np.int64).reshape(-1, SKETCH)
    return digests, keys, sketch, np.diff(bounds) > 0, _packed(hashes, of, len(texts))


def _packed(hashes: np.ndarray, of: np.ndarray, n: int) -> list[bytes]:
    """The sorted 32-bit shingle hashes of each of ``n`` texts."""
    cuts = np.searchsorted(of, np.arange(n + 1))
    short = (hashes >> _U(32)).astype("<u4")
    return [short[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def packed_sets(texts: list[str]) -> list[bytes]:
    _, _, hashes, of, _ = shingle_sets(texts)
    return _packed(hashes, of, len(texts))


def document_features(docs: DataFrame, id_col: str, text_col: str, uid_col: str | None = None) -> DataFrame:
    """uid, id, and of texts with a word digest, bands, sketch and set. One reading of ``docs``; what follows reads this table, stored."""
    uid = F.monotonically_increasing_id() if uid_col is None else q(uid_col)
    source = docs.select(uid.alias("uid"), q(id_col).alias("id"), q(text_col).alias("text"))
    many = T.ArrayType(T.LongType())
    schema = T.StructType([source.schema["uid"], source.schema["id"], *(T.StructField(n, k) for n, k in (("digest", T.BinaryType()), ("bands", many), ("sketch", many), ("set", T.BinaryType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in slices(batch.column(2), 1 << 18):
                digests, keys, sketch, some, sets = features(texts)
                part = batch.slice(begin, len(texts))
                only = lambda xs, kind: pa.array([x if ok else None for x, ok in zip(xs, some, strict=True)], kind)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), only(digests, pa.binary()), only(keys, pa.list_(pa.int64())), only(sketch.tolist(), pa.list_(pa.int64())), only(sets, pa.binary())], names=schema.names)

    return map_batches(source, run, schema)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs ``a``, ``b`` whose shingle sets have at least this Jaccard similarity. ``sets``: uid, set."""
    both = pairs.join(sets.select(F.col("uid").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("uid").alias("b"), F.col("set").alias("sb")), "b")
    schema = T.StructType([both.schema["a"], both.schema["b"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                if min(len(p), len(q)) >= similarity * max(len(p), len(q)):
                    near = np.minimum(np.searchsorted(q, p), len(q) - 1)
                    common = int((q[near] == p).sum())
                    keep[i] = common >= similarity * (len(p) + len(q) - common) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return map_batches(both.select("a", "b", "sa", "sb"), run, schema)


def _linked(sets: list[np.ndarray], others: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For each of ``sets`` and each of ``others``, both without empty ones: is their Jaccard similarity at least this?"""
    n, m = np.array([len(x) for x in sets]), np.array([len(x) for x in others])
    known, at = np.unique(np.concatenate(others), return_inverse=True)
    begins = np.concatenate([[0], np.cumsum(m)[:-1]])
    out = np.zeros((len(sets), len(others)), bool)
    for i, x in enumerate(sets):
        if (np.minimum(n[i], m) >= similarity * np.maximum(n[i], m)).any():
            place = np.minimum(np.searchsorted(known, x), len(known) - 1)
            has = np.zeros(len(known), np.int64)
            has[place[known[place] == x]] = 1
            common = np.add.reduceat(has[at], begins)
            out[i] = common >= similarity * (n[i] + m - common) - 1e-9
    return out


def _links_of_blocks(rows: pa.Table) -> pa.Table:
    """Links between two blocks of a bucket, or in one if there is one, of texts in different classes."""
    uid, root, block = (rows.column(k).to_numpy() for k in ("uid", "root", "block"))
    sets = [np.frombuffer(x.as_buffer(), "<u4") for x in rows.column("set")]
    one = np.flatnonzero(block == block.min())
    two = one if len(one) == len(block) else np.flatnonzero(block == block.max())
    found = _linked([sets[i] for i in one], [sets[i] for i in two]) & (root[one][:, None] != root[two])
    x, y = np.nonzero(found)
    a, b = uid[one[x]], uid[two[y]]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def links_between_classes(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of all pairs of ``members`` (key, uid, root) that share a key but no root. ``sets``: uid, set.

    The largest class of a bucket and the rest are cut into blocks by a hash; every block of the rest meets every block,
    each two of them as a group of their own, so no task has a bucket as a whole. Work is the product of rest and bucket.
    """
    many = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    sized = materialize(members.join(many, "key").join(sets.select("uid", F.length("set").alias("bytes")), "uid"), "between")
    of_class = sized.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    pieces = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("int")
    main = F.max(F.struct("n", "root", "bytes"))
    plan = of_class.groupBy("key").agg(main.alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    plan = plan.select("key", F.col("main.root").alias("main"), pieces(F.col("main.n"), F.col("main.bytes")).alias("of_main"), pieces(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("of_rest"))
    rest = F.col("root") != F.col("main")
    spread = F.xxhash64("uid", F.lit(1))
    block = F.when(rest, F.pmod(spread, F.col("of_rest"))).otherwise(F.col("of_rest") + F.pmod(spread, F.col("of_main"))).cast("int")
    last = F.when(rest, F.col("of_rest") + F.col("of_main")).otherwise(F.col("of_rest")) - 1
    placed = sized.join(plan, "key").select("key", "uid", "root", block.alias("block"), last.alias("last")).join(sets, "uid")
    meets = placed.withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    meets = meets.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "uid", "root", "block", "set")
    return meets.groupBy("key", "i", "j").applyInArrow(_links_of_blocks, "a long, b long").distinct()


def _centres(members: DataFrame, centres: int, pairs_up_to: int) -> DataFrame:
    """key, c, c_sketch: all members of a small bucket, and of a large one those that share most bits with its majority.

    ``members``: key, uid, n, sketch. Ties go by a hash of uid.
    """
    bit = lambda k: F.shiftright(F.col("sketch")[0], k).bitwiseAND(F.lit(1))
    large = members.where(F.col("n") > pairs_up_to)
    most = large.groupBy("key").agg(*(F.sum(bit(k)).alias(f"b{k}") for k in range(MAJORITY)), F.count(F.lit(1)).alias("m"))
    word = sum((F.when(F.col(f"b{k}") * 2 > F.col("m"), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(MAJORITY)), F.lit(0).cast("long"))
    like = F.bit_count(F.col("sketch")[0].bitwiseXOR(F.col("majority")).bitwiseAND(F.lit((1 << MAJORITY) - 1)))
    turn = Window.partitionBy("key").orderBy(like, F.xxhash64("uid"), "uid")
    tops = large.join(most.select("key", word.alias("majority")), "key").select("key", "uid", "sketch", F.row_number().over(turn).alias("k")).where(F.col("k") <= centres)
    few = members.where(F.col("n") <= pairs_up_to)
    return few.select("key", "uid", "sketch").unionByName(tops.drop("k")).select("key", F.col("uid").alias("c"), F.col("sketch").alias("c_sketch"))


def linked_classes(members: DataFrame, feats: DataFrame, pairs_up_to: int = PAIRS_UP_TO, centres: int = CENTRES) -> DataFrame:
    """node and root, the least uid of its class, of all that are linked with another of ``members`` (key, uid). ``feats``: uid, sketch, set."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(members.join(sizes, "key"), "buckets")
    candidates = materialize(shared.select("uid").distinct(), "candidates")
    known = materialize(feats.select("uid", "sketch", "set").join(small(candidates), "uid", "left_semi"), "sets")
    sets = known.select("uid", "set")
    drawn = shared.join(known.select("uid", "sketch"), "uid")
    apart = sum((F.bit_count(F.col("sketch")[k].bitwiseXOR(F.col("c_sketch")[k])) for k in range(SKETCH)), F.lit(0))
    met = drawn.join(_centres(drawn, centres, pairs_up_to), "key").where((F.col("uid") != F.col("c")) & (apart <= APART))
    pairs = met.select(F.least("uid", "c").alias("a"), F.greatest("uid", "c").alias("b")).distinct()
    links = materialize(verified(pairs, sets), "links")
    first = components(links)
    large = shared.where(F.col("n") > pairs_up_to).select("key", "uid")
    placed = large.join(first.withColumnRenamed("node", "uid"), "uid", "left").select("key", "uid", F.coalesce("root", "uid").alias("root"))
    more = materialize(links_between_classes(placed, sets), "links")
    discard(candidates, links)
    if not more.limit(1).count():
        return first
    # The classes that these links join, by their roots.
    root = lambda end: F.coalesce(F.col(f"r{end}"), F.col(end)).alias(end)
    of = lambda end: first.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
    second = components(more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(root("a"), root("b")).distinct())
    joined = first.select("node", F.col("root").alias("mid")).join(second.select(F.col("node").alias("mid"), "root"), "mid", "left").select("node", F.coalesce("root", "mid").alias("root"))
    alone = second.join(first.select("node"), "node", "left_anti")
    return joined.unionByName(alone)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", uid_col: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: uid, id, class_id (the least id of its class), kept (it is the first of its class), class_size.

    ``uid`` is the stored column ``uid_col``, or else a number that holds for this result alone; ``docs`` is read once.
    Rows whose text has no word (null, empty, only marks) are classes of their own. Of rows with the same id the
    first in the table comes first; null ids come last and give a null class_id if all of the class are null.
    An empty table gives an empty result.
    """
    feats = materialize(document_features(docs, id_col, text_col, uid_col), "features")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("uid").alias("uid"))
    worded = feats.where("digest is not null")
    firsts = materialize(worded.groupBy("digest").agg(F.min(order).alias("f")).select("digest", F.col("f.uid").alias("first")), "firsts")
    reps = worded.join(firsts.select(F.col("first").alias("uid")), "uid", "left_semi")
    roots = linked_classes(reps.select("uid", F.explode("bands").alias("key")), worded).select(F.col("node").alias("first"), "root")
    known = firsts.join(roots, "first", "left").select("digest", F.coalesce("root", "first").alias("root"))
    rows = worded.select("uid", "id", "digest").join(known, "digest").select("uid", "id", "root").unionByName(feats.where("digest is null").select("uid", "id", F.col("uid").alias("root")))
    rows = materialize(rows, "classes")
    heads = materialize(rows.groupBy("root").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("class_size")), "heads")
    out = rows.join(small(heads), "root").select("uid", "id", F.col("f.id").alias("class_id"), (F.col("f.uid") == F.col("uid")).alias("kept"), "class_size")
    discard(feats, firsts)
    return reading(out, rows, heads)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The class of every document. Null, empty and repeated rows and empty tables are as ``classes`` says."""
    return classes(docs.select("doc_id", "text")).select(F.col("id").alias("doc_id"), "class_id", "kept", "class_size")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first document of each class, with the columns of ``docs``; texts without a word all stay. The rows are numbered once, in a stored table."""
    uid = fresh(docs, "_uid")["_uid"]
    rows = with_row_ids(docs, uid)
    base = classes(rows, id_col, text_col, uid)
    gone = settled(base.where(~F.col("kept")).select(F.col("uid").alias(uid)), base, "copies")
    return rows.join(small(gone), uid, "left_anti").select(*(q(c) for c in docs.columns))
