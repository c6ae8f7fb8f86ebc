"""Best-fit packing of token sequences by bin completion on a histogram of lengths.

Documents become token pieces of at most ``capacity`` ids. Packing needs only how many pieces
there are of each length, and there are at most ``capacity`` lengths whatever the input's size.
The driver packs that histogram (``Completion``): a best-fit-decreasing packing is the incumbent,
and a depth-first bin completion tries to beat it. It takes the largest length left and enumerates all
undominated fillings of the room beside it, fullest first; each is tried as often as the counts allow
and then once, and branches are pruned by the waste that a better packing may still have. The search
leaves nothing out: it can be stopped after a number of steps, tells then how far the incumbent may be from
the best, and goes on from there if asked to. The result is a list of (filling, repetitions). Executors then deal every piece to a slot by its rank among the pieces of its length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.llm.common import fresh, kept, map_batches, materialize, q, slices

CAPACITY = 4096
#: Steps of the search after which the incumbent is taken, with its distance from the bound.
STEPS = 2_000
#: Open branches that keep their place in the enumeration; others find it again when they are next.
LIVE = 24
END_ID = 1
#: Entries a worker's token memo may hold before it sheds what it didn't use of late.
MEMO = 200_000
MARKS = ".,;:!?"
CONTROLS = "\x1c\x1d\x1e\x1f"


# ---------------------------------------------------------------- token pieces


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class TokenMemo(dict):
    """Ids, as little-endian unsigned 32-bit bytes, of what stands between white space.

    The tokenizer drops white space and never joins what it parts, so the ids of a text are those
    of its parts in order; likewise those of letters and of the sentence marks behind them. Control
    characters that Python takes for white space and the tokenizer doesn't, and texts with a special
    token's string, go through the tokenizer whole. Texts of plain Latin letters are lower-cased
    first, as the tokenizer would do. When the memo is full, what was used since the last time stays.
    Words with marks behind them are put together anew in each call and not kept beside the words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.old: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.beyond = re.compile("[^\x00-\u012f\u0131-\u024f]").search
        self.model, self.as_bytes = self.tokenizer.model, str.maketrans(_byte_letters())

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def plain(self, text: str) -> bool:
        """Whether lower case and composed form are the tokenizer's: no letter beyond the Latin ones, no dotted capital I."""
        if text.isascii():
            return True
        try:
            return bool(text.encode("latin-1")) or True
        except UnicodeEncodeError:
            return not self.beyond(text)

    def word(self, word: str) -> bytes:
        """Of a lower-case run of Latin letters, which the tokenizer keeps together: straight from its merges."""
        tokens = self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.as_bytes))
        return array("I", [t.id for t in tokens]).tobytes()

    def learn(self, parts: set[str]) -> list[str]:
        """Make the ids of ``parts`` known; gives those that need not be kept."""
        missing = {p for p in parts if p not in self}
        if len(self) + len(missing) > MEMO:
            self.old = dict(self)
            self.clear()
            missing = parts
        new, split = [], []
        wanted: set[str] = set()
        for part in missing:
            if (got := self.old.get(part)) is not None:
                self[part] = got
            elif part[-1] in MARKS and (stem := part.rstrip(MARKS)).isalpha():
                split.append((part, stem, part[len(stem) :]))
                wanted.update(split[-1][1:])
            else:
                new.append(part)
        for stem in [w for w in wanted if w not in self]:
            if (got := self.old.get(stem)) is not None:
                self[stem] = got
            elif stem not in missing:
                new.append(stem)
        words = [w for w in new if w.isalpha() and w.islower() and not self.beyond(w)]
        for w in words:
            self[w] = self.word(w)
        new = [w for w in new if w not in self]
        for k in range(0, len(new), 4096):
            run = new[k : k + 4096]
            for part, got in zip(run, self.tokenizer.encode_batch_fast(run, add_special_tokens=False), strict=True):
                self[part] = array("I", got.ids).tobytes()
        for part, stem, tail in split:
            self[part] = self[stem] + self[tail]
        return [part for part, _, _ in split]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        split = [None if any(c in t for c in CONTROLS) or any(s in t for s in self.specials) else (t.lower() if self.plain(t) else t).split() for t in texts]
        passing = self.learn({w for words in split if words for w in words})
        out = [self.whole(t) if words is None else b"".join(map(self.__getitem__, words)) for t, words in zip(texts, split, strict=True)]
        for part in passing:
            del self[part]
        return out


def token_memo(path: str) -> TokenMemo:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(path, lambda: TokenMemo(path))


def token_pieces(df: DataFrame, tokenizer: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY, end_id: int | None = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``keep``, piece, start, length, ids_crc32 (and ``ids``, as bytes, if asked for).

    A document's ids are the tokenizer's, without special tokens, then ``end_id``; more than ``capacity``
    of them are cut. Null counts as the empty text, which still has its end id.
    """
    kept = [q(c) for c in keep]
    source = df.select(*kept, q(text_col).alias(fresh(df.select(*kept), "_text")["_text"]))
    schema = T.StructType([*source.schema.fields[:-1], *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")), T.StructField("piece", T.IntegerType()), *([T.StructField("ids", T.BinaryType())] * with_ids)])
    tail, step = b"" if end_id is None else int(end_id).to_bytes(4, "little"), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = token_memo(tokenizer)
        for batch in batches:
            for begin, texts in slices(batch.column(batch.num_columns - 1)):
                row, start, length, crc, piece, ids = [], [], [], [], [], []
                for i, raw in enumerate(memo.encode_all(texts)):
                    raw += tail
                    for k, at in enumerate(range(0, len(raw), step)):
                        part = raw[at : at + step]
                        row.append(begin + i)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        piece.append(k)
                        if with_ids:
                            ids.append(part)
                kept_rows = [c.take(pa.array(row, pa.int64())) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept_rows, *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(piece, pa.int32()), *([pa.array(ids, pa.binary())] * with_ids)], names=schema.names)

    return map_batches(source, run, schema, keeps=tokenizer)


# ---------------------------------------------------------------- bin completion

Packing = list[tuple[tuple[int, ...], int]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and the bounds that keep items over a half apart (Martello and Toth's L2)."""
    total = sum(k * n for k, n in counts.items())
    best = -(-total // capacity)
    lengths = sorted(counts)
    for least in [0, *(k for k in lengths if k <= capacity // 2)]:
        big = sum(n for k, n in counts.items() if k > capacity - least)
        mid = [(k, n) for k, n in counts.items() if capacity // 2 < k <= capacity - least]
        small = sum(k * n for k, n in counts.items() if least <= k <= capacity // 2)
        room = sum((capacity - k) * n for k, n in mid)
        best = max(best, big + sum(n for _, n in mid) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Packing:
    """Best-fit decreasing, run by run: pieces of one length go into equally filled bins at once."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(filling: tuple[int, ...], n: int) -> None:
        room = capacity - sum(filling)
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((filling, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                filling, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(k)
                each = min(room // length, left)
                used = min(n, left // each)
                if used < n:
                    put(filling, n - used)
                put((*filling, *[length] * each), used)
                left -= used * each
            else:
                each = min(capacity // length, left)
                put((length,) * each, left // each)
                left -= left // each * each
    return [x for room in rooms for x in groups[room]]


def _reachable(lengths: list[int], left: list[int], room: int) -> list[int]:
    """For each place: which sums up to ``room`` the lengths up to there can have, as bits."""
    sums, out, mask = 1, [], (1 << room + 1) - 1
    for x, n in zip(lengths, left, strict=True):
        n = min(n, room // x)
        step = 1
        while n > 0:  # 1, 2, 4, ... copies and what is left
            k = min(step, n)
            sums |= sums << k * x & mask
            n -= k
            step *= 2
        out.append(sums)
    return out


def fillings(lengths: list[int], left: list[int], room: int, least: int) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of ``room`` that hold ``least`` or more, fullest first, as they are asked for.

    ``lengths`` in rising order, ``left``: how many there are of each. A filling is dominated if a length left out could
    replace one of its members and still fit, or could be added: a packing with it is not better than one with the other.
    """
    most = bisect_left(lengths, room + 1)
    lengths, left = lengths[:most], left[:most]
    reach = _reachable(lengths, left, room)

    def exactly(top: int, sum_: int, chosen: tuple[tuple[int, int], ...]) -> Iterator[tuple[tuple[int, int], ...]]:
        if not sum_:
            yield chosen
            return
        for k in range(min(top, bisect_left(lengths, sum_ + 1)) - 1, -1, -1):
            if not reach[k] >> sum_ & 1:
                return
            for n in range(min(left[k], sum_ // lengths[k]), 0, -1):
                rest = sum_ - n * lengths[k]
                if not rest or k and reach[k - 1] >> rest & 1:
                    yield from exactly(k, rest, (*chosen, (k, n)))

    def undominated(chosen: tuple[tuple[int, int], ...], slack: int) -> bool:
        if not slack:
            return True
        used = dict(chosen)
        free = lambda low, high: any(left[k] > used.get(k, 0) for k in range(bisect_left(lengths, low), bisect_left(lengths, high + 1)))
        return not free(1, slack) and not any(free(lengths[k] + 1, lengths[k] + slack) for k in used)

    for sum_ in range(room, least - 1, -1):
        if not sum_:
            if undominated((), room):
                yield ()
        elif reach and reach[-1] >> sum_ & 1:
            for chosen in exactly(len(lengths), sum_, ()):
                if undominated(chosen, room - sum_):
                    yield tuple(lengths[k] for k, n in chosen for _ in range(n))


class Completion:
    """A search for the fewest bins that hold ``counts`` (length: how many).

    ``packing`` is the best found so far, as fillings and repetitions, ``n_bins`` its bins, ``bound`` what no packing
    beats; ``proved``: there is none with fewer bins. ``run`` goes on from where the last call stopped.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        counts = {int(k): int(n) for k, n in counts.items() if n > 0}
        if any(not 0 < k <= capacity for k in counts):
            raise ValueError("a length is outside 1..capacity")
        self.capacity, self.total = capacity, sum(k * n for k, n in counts.items())
        self.packing, self.bound = best_fit(counts, capacity), lower_bound(counts, capacity)
        self.n_bins = sum(n for _, n in self.packing)
        self.proved = self.n_bins <= self.bound
        self.lengths = sorted(counts)
        self.left = [counts[x] for x in self.lengths]
        self.place = {x: k for k, x in enumerate(self.lengths)}
        self.used = self.waste = self.steps = 0
        self.path: Packing = []
        # Of each open branch: its further options, or None, and the last one taken.
        self.frames: list[list] = []

    def _spare(self) -> int:
        """The waste that may still come in a packing with fewer bins than the incumbent."""
        return (self.n_bins - 1) * self.capacity - self.total - self.waste

    def _options(self, after: tuple[tuple[int, ...], int] | None = None) -> Iterator[tuple[tuple[int, ...], int]]:
        """Bins for the largest length left, and how often: all that a better packing may have, or those ``after`` one of them."""
        top = len(self.lengths) - 1
        while top >= 0 and not self.left[top]:
            top -= 1
        if top < 0:
            if self.used < self.n_bins:
                self.packing, self.n_bins = list(self.path), self.used
            return
        rest = {x: n for x, n in zip(self.lengths[: top + 1], self.left, strict=False) if n}
        if self._spare() < 0 or self.used + lower_bound_fast(rest, self.capacity) >= self.n_bins:
            return
        big = self.lengths[top]
        own = self.left[: top + 1]
        own[top] -= 1
        for filling in fillings(self.lengths[: top + 1], own, self.capacity - big, max(0, self.capacity - big - self._spare())):
            bin_ = (big, *filling)
            lost = self.capacity - sum(bin_)
            if lost > self._spare():  # the incumbent is better by now
                return
            if after is not None:
                if bin_ == after[0]:
                    if after[1] > 1:
                        yield bin_, 1
                    after = None
                continue
            most = min(self.left[self.place[x]] // bin_.count(x) for x in {*bin_})
            if lost:
                most = min(most, self._spare() // lost)
            if most > 1:
                yield bin_, most
            yield bin_, 1

    def _move(self, bin_: tuple[int, ...], times: int) -> None:
        self.used += times
        self.waste += (self.capacity - sum(bin_)) * times
        for x in bin_:
            self.left[self.place[x]] -= times

    def run(self, steps: int | None = None) -> Packing:
        """Search for up to ``steps`` more bins on trial, or to the end."""
        last = None if steps is None else self.steps + steps
        if not self.proved and not self.frames:
            self.frames.append([None, None])
        while self.frames and self.n_bins > self.bound and (last is None or self.steps < last):
            frame = self.frames[-1]
            if frame[0] is None:
                frame[0] = self._options(frame[1])
            option = next(frame[0], None)
            if option is None:
                self.frames.pop()
                if self.path:
                    undone, times = self.path.pop()
                    self._move(undone, -times)
                continue
            self.steps += 1
            frame[1] = option
            self.path.append(option)
            self._move(*option)
            self.frames.append([None, None])
            if len(self.frames) > LIVE:
                self.frames[-LIVE - 1][0] = None
        self.proved = self.n_bins <= self.bound or not self.frames
        return self.packing


def complete(counts: dict[int, int], capacity: int = CAPACITY, steps: int | None = STEPS) -> Completion:
    """A search that has run for up to ``steps`` steps (None: to its end)."""
    search = Completion(counts, capacity)
    search.run(steps)
    return search


def lower_bound_fast(counts: dict[int, int], capacity: int) -> int:
    return max(-(-sum(k * n for k, n in counts.items()) // capacity), sum(n for k, n in counts.items() if 2 * k > capacity))


# ---------------------------------------------------------------- slots


def _slots(packing: Packing) -> tuple[list[tuple[int, int, int, list[int], int]], int]:
    """(length, first rank, first sequence, offsets of that length in the filling, repetitions), and how many sequences."""
    rows, first, ranks = [], 0, {}
    for filling, times in packing:
        at, places = 0, {}
        for x in filling:
            places.setdefault(x, []).append(at)
            at += x
        for x, offsets in places.items():
            rows.append((x, ranks.get(x, 0), first, offsets, times))
            ranks[x] = ranks.get(x, 0) + times * len(offsets)
        first += times
    return rows, first


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), salts: int | None = None, steps: int | None = STEPS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every piece, and to all ``n_sequences`` and ``n_least``, which no packing beats.

    ``pieces`` must be a stored table: it is read three times. ``steps`` ends the search for fewer sequences; None lets it
    go on until there is a proof.

    Ranks within a length are dealt in two steps, so that one length may hold any share of the rows:
    lengths are split by a hash of ``order`` in ``salts`` runs (the session's shuffle partitions, if not
    given), and each run's ranks start where the runs before it end. Nothing that grows with the number
    of pieces reaches the driver, only one count for each length. Repeated rows get places of their own.
    """
    spark = pieces.sparkSession
    n = fresh(pieces, "_salt", "_rank", "_base", "_n")
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    length: Column = q(length_col)
    salted = pieces.withColumn(n["_salt"], F.pmod(F.xxhash64(*[q(c) for c in order]), F.lit(salts)).cast("int"))
    by_run = salted.groupBy(length.alias(length_col), n["_salt"]).agg(F.count(F.lit(1)).alias(n["_n"]))
    counts = {r[0]: r[1] for r in pieces.groupBy(length).agg(F.count(F.lit(1))).collect()}
    search = complete(counts, capacity, steps)
    rows, _ = _slots(search.packing)

    before = Window.partitionBy(length_col).orderBy(n["_salt"]).rowsBetween(Window.unboundedPreceding, -1)
    bases = by_run.select(length_col, n["_salt"], F.coalesce(F.sum(n["_n"]).over(before), F.lit(0)).alias(n["_base"]))
    run = Window.partitionBy(length_col, n["_salt"]).orderBy(*[q(c).asc_nulls_last() for c in order])
    ranked = salted.withColumn(n["_rank"], F.row_number().over(run) - 1).join(bases, [length_col, n["_salt"]])
    ranked = ranked.withColumn(n["_rank"], q(n["_rank"]) + q(n["_base"])).drop(n["_salt"], n["_base"])

    by_length: dict[int, list[tuple[int, int, list[int], int]]] = {}
    for x, first_rank, first, offsets, times in rows:
        by_length.setdefault(x, []).append((first_rank, first, offsets, times))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at_length, at_rank = ranked.columns.index(length_col), ranked.columns.index(n["_rank"])
    kept = [ranked.columns.index(c) for c in pieces.columns]
    table = spark.sparkContext.broadcast({x: ([e[0] for e in es], es) for x, es in by_length.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = table.value
        for batch in batches:
            seq, off = [], []
            for x, rank in zip(batch.column(at_length).to_pylist(), batch.column(at_rank).to_pylist(), strict=True):
                starts, entries = slots[x]
                first_rank, first, offsets, _ = entries[bisect_left(starts, rank + 1) - 1]
                turn, which = divmod(rank - first_rank, len(offsets))
                seq.append(first + turn)
                off.append(offsets[which])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=schema.names)

    least = search.n_bins if search.proved else search.bound
    return map_batches(ranked, place, schema).withColumns({"n_sequences": F.lit(search.n_bins).cast("long"), "n_least": F.lit(least).cast("long")})


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, steps: int | None = STEPS) -> DataFrame:
    """Tokenize, cut, store the pieces, pack: one row per piece of every document (null text: empty).

    An empty table gives an empty result. Null or repeated doc_ids are pieces like any other.
    """
    pieces = materialize(token_pieces(docs, tokenizer, capacity=capacity), "pieces")
    return pack(pieces, capacity, steps=steps).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "n_sequences", "n_least")
