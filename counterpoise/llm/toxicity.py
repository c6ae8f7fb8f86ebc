"""Toxicity: a convolutional text classifier on hashed word embeddings.

A word's embedding is the sum of the rows of its hashed features: the word and its first 3 to 7
letters, as insults are also built by derivation. Filters of widths 1, 2 and 3 run over the words,
max pooling keeps each filter's strongest response in the whole text, and a dense layer gives the
logit. All of it is trained in numpy with Adagrad on a sample of labelled rows.

Thresholds are calibrated by language: each word also carries evidence for the languages of the
training rows, a text's language is the one its own words favour, and a logit is mapped so that the
score 0.3 stands where the best threshold of that language lies. Nothing but the text enters a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.llm.common import fresh, give_back, held_out, map_batches, materialize, q, slices, without
from counterpoise.llm.langid import letters

BUCKETS, DIM, FILTERS, WIDTHS, PREFIXES = 1 << 17, 8, 8, (1, 2, 3), (3, 4, 5, 6, 7)
FEATURES = 1 + len(PREFIXES)
#: Bounds of the training sample: rows of each label, and characters of each label.
MAX_ROWS, MAX_CHARS = {0: 5000, 1: 2500}, 16_000_000
EPOCHS, BATCH, RATE, MEMO = 4, 16, 0.05, 280_000
CUT = 0.3
BLOCKS = sum(WIDTHS)


def buckets(word: str) -> list[int]:
    """The hashed features of a lower-case word; row 0 is empty and stands for a prefix that is the word itself."""
    raw = [word, *(f"{word[:n]}*" if len(word) >= n else "" for n in PREFIXES)]
    return [1 + zlib.crc32(x.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) if x else 0 for x in raw]


@dataclass
class Network:
    embed: np.ndarray
    conv: np.ndarray  # (DIM, BLOCKS * FILTERS): the columns of each width's places, one after the other
    bias: np.ndarray
    dense: np.ndarray
    offset: float
    langs: list[str] = field(default_factory=list)
    lang_words: np.ndarray | None = None  # (BUCKETS, languages)
    maps: dict[int, tuple[float, float]] = field(default_factory=dict)

    def rows(self, words: list[list[str]]) -> np.ndarray:
        """For lists of words: what each adds to every filter's response at each place, and its evidence for languages."""
        flat = list(chain.from_iterable(words))
        b = np.array([buckets(w) for w in flat], np.int64).reshape(-1, FEATURES)
        return np.hstack([self.embed[b].sum(1) @ self.conv, self.lang_words[b[:, 0]]]).astype(np.float32)

    def pooled(self, added: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Max-pooled responses of the texts that hold the words ``first`` to ``last``; after each stand two empty words."""
        out, col = [], 0
        for width in WIDTHS:
            r = added[:, col : col + FILTERS].copy()
            for j in range(1, width):
                block = added[:, col + j * FILTERS : col + (j + 1) * FILTERS]
                r[:-j] += block[j:]
            col += width * FILTERS
            cuts = np.column_stack([first, last]).ravel()
            out.append(np.maximum.reduceat(np.vstack([r, r[:1]]), cuts, axis=0)[::2])
        return np.maximum(np.hstack(out) + self.bias, 0)

    def judge(self, logit: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Scores of logits in the (guessed) languages."""
        slope, shift = np.array([self.maps.get(int(k), self.maps[-1]) for k in lang]).reshape(-1, 2).T
        return 1 / (1 + np.exp(-np.clip(slope * logit + shift, -40, 40)))


class WordMemo(dict):
    """Row of each part of a text (what stands between white space) in the table of its words' rows.

    A part may hold several runs of letters; then its rows follow one another.
    """

    def __init__(self, net: Network):
        super().__init__()
        self.net, self.table, self.held = net, np.zeros((4096, BLOCKS * FILTERS + len(net.langs)), np.float32), 1

    def learn(self, parts: set[str]) -> None:
        new = [p for p in parts if p not in self]
        if len(self) + len(new) > MEMO:
            self.clear()
            self.held, new = 1, list(parts)
        for begin in range(0, len(new), 20_000):
            run = new[begin : begin + 20_000]
            words = [letters(p) for p in run]
            got = self.net.rows(words) if any(words) else self.table[:0]
            while self.held + len(got) > len(self.table):
                more = np.zeros((2 * len(self.table), self.table.shape[1]), np.float32)  # pages that nothing is written to take no memory
                more[: self.held] = self.table[: self.held]
                self.table = more
            self.table[self.held : self.held + len(got)] = got
            at = self.held
            for part, w in zip(run, words, strict=True):
                self[part] = tuple(range(at, at + len(w)))
                at += len(w)
            self.held = at

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits and guessed languages of whole texts."""
        split = [t.split() for t in texts]
        self.learn(set().union(*split))
        rows, first, last, at = [], [], [], 0
        for parts in split:
            own = list(chain.from_iterable(map(self.__getitem__, parts))) or [0]
            first.append(at)
            last.append(at + len(own))
            rows.append(own)
            rows.append([0, 0])
            at += len(own) + 2
        added = self.table[np.fromiter(chain.from_iterable(rows), np.int64, at)]
        first, last = np.array(first), np.array(last)
        logit = self.net.pooled(added, first, last) @ self.net.dense + self.net.offset
        if not self.net.langs:
            return logit, np.full(len(texts), -1)
        evidence = np.add.reduceat(added[:, BLOCKS * FILTERS :], np.column_stack([first, last]).ravel(), axis=0)[::2]
        return logit, np.where(np.abs(evidence).sum(1) > 0, evidence.argmax(1), -1)


# ---------------------------------------------------------------- training


def train(texts: list[str], labels: np.ndarray, langs: list[str | None], weights: np.ndarray, seed: int = 7) -> Network:
    """Fit the network on labelled texts. ``weights`` undo the sampling of the labels; a fifth of the rows only calibrates."""
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    docs = []
    for t in texts:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for part in t.split() for w in letters(part)]
        docs.append(np.array(ids, np.int32))
    feats = np.fromiter(chain.from_iterable(buckets(w) for w in vocabulary), np.int32, FEATURES * len(vocabulary)).reshape(-1, FEATURES)
    vocabulary.clear()
    order = rng.permutation(len(docs))
    cut = len(docs) // 5 if len(docs) >= 50 else 0
    check, teach = order[:cut], order[cut:]

    # Start from the z-scored log odds of each hashed feature, by document counts.
    counts = np.zeros((2, BUCKETS))
    for d in teach:
        counts[labels[d], np.unique(feats[np.unique(docs[d])])] += 1
    n = np.maximum(np.bincount(labels[teach], minlength=2), 1)
    prior = (counts.sum(0) + 0.1) / n.sum()
    up = [(counts[y] + 10 * prior) / (n[y] + 10) for y in (0, 1)]
    z = (np.log(up[1]) - np.log(up[0])) / np.sqrt(1 / (counts[0] + 10 * prior + 0.5) + 1 / (counts[1] + 10 * prior + 0.5))
    embed = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    embed[:, 0] = np.clip(z, -2, 8) / 4
    embed[0] = 0
    conv = rng.normal(0, 0.2, (DIM, BLOCKS * FILTERS)).astype(np.float32)
    for col in range(BLOCKS):
        conv[0, col * FILTERS : col * FILTERS + FILTERS // 2] += 0.6
    net = Network(embed, conv, np.full(len(WIDTHS) * FILTERS, -0.2, np.float32), np.full(len(WIDTHS) * FILTERS, 0.15, np.float32), float(np.log(n[1] / n[0])))

    known = sorted({x for x in langs if x is not None})
    net.langs = known
    net.lang_words = np.zeros((BUCKETS, len(known)), np.float32)
    if known:
        seen = np.ones((BUCKETS, len(known))) * 0.1
        for d in teach:
            if langs[d] is not None and len(docs[d]):
                seen[np.unique(feats[docs[d], 0]), known.index(langs[d])] += 1
        logs = np.log(seen / seen.sum(0))
        net.lang_words = (logs - logs.mean(1, keepdims=True)).astype(np.float32)
        net.lang_words[0] = 0

    _descend(net, docs, feats, labels, teach, rng)
    memo = WordMemo(net)
    logit, lang = (np.concatenate(x) for x in zip(*(memo.logits([texts[d] for d in check[k : k + 64]]) for k in range(0, len(check), 64)), strict=True)) if cut else (np.zeros(0), np.zeros(0, int))
    net.maps = calibrate(logit, labels[check], weights[check], lang)
    return net


def _descend(net: Network, docs: list[np.ndarray], feats: np.ndarray, labels: np.ndarray, teach: np.ndarray, rng: np.random.Generator) -> None:
    sums = {k: np.full_like(v, 1e-4) for k, v in (("embed", net.embed), ("conv", net.conv), ("bias", net.bias), ("dense", net.dense))}
    sum_offset = 1e-4
    spots = [(width, sum(WIDTHS[:k])) for k, width in enumerate(WIDTHS)]
    for _ in range(EPOCHS):
        for begin in range(0, len(teach), BATCH):
            batch = [d for d in rng.permutation(teach[begin : begin + BATCH]) if len(docs[d])]
            if not batch:
                continue
            words, inverse = np.unique(np.concatenate([docs[d] for d in batch]), return_inverse=True)
            b = feats[words]
            x = np.vstack([net.embed[b].sum(1), np.zeros((1, DIM), np.float32)])
            added = x @ net.conv
            g_conv, g_bias, g_dense, g_x, g_offset = np.zeros_like(net.conv), np.zeros_like(net.bias), np.zeros_like(net.dense), np.zeros_like(x), 0.0
            at = 0
            for d in batch:
                ids = np.concatenate([inverse[at : at + len(docs[d])], [len(words)] * 2])
                at += len(docs[d])
                size = len(ids) - 2
                tops, where = [], []
                for width, col in spots:
                    r = added[ids[:size], col * FILTERS : (col + 1) * FILTERS]
                    for j in range(1, width):
                        r = r + added[ids[j : size + j], (col + j) * FILTERS : (col + j + 1) * FILTERS]
                    top = r.argmax(0)
                    where.append(top)
                    tops.append(r[top, np.arange(FILTERS)])
                pool = np.concatenate(tops) + net.bias
                act = np.maximum(pool, 0)
                p = 1 / (1 + np.exp(-np.clip(act @ net.dense + net.offset, -30, 30)))
                g = p - labels[d]
                g_offset += g
                g_dense += g * act
                back = g * net.dense * (pool > 0)
                g_bias += back
                for k, (width, col) in enumerate(spots):
                    own = back[k * FILTERS : (k + 1) * FILTERS]
                    for j in range(width):
                        w, cols = ids[where[k] + j], np.arange((col + j) * FILTERS, (col + j + 1) * FILTERS)
                        g_conv[:, cols] += (x[w] * own[:, None]).T
                        np.add.at(g_x, w, own[:, None] * net.conv[:, cols].T)
            for key, value, grad in (("conv", net.conv, g_conv), ("bias", net.bias, g_bias), ("dense", net.dense, g_dense)):
                grad = grad / len(batch) + 1e-5 * value
                sums[key] += grad * grad
                value -= RATE * grad / np.sqrt(sums[key])
            g_offset /= len(batch)
            sum_offset += g_offset * g_offset
            net.offset -= RATE * g_offset / np.sqrt(sum_offset)
            moved = np.flatnonzero(np.abs(g_x[:-1]).sum(1))
            if len(moved):
                rows, place = np.unique(b[moved], return_inverse=True)
                grad = np.zeros((len(rows), DIM), np.float32)
                np.add.at(grad, place.reshape(b[moved].shape), g_x[moved][:, None, :] / len(batch))
                grad[rows == 0] = 0
                sums["embed"][rows] += grad * grad
                net.embed[rows] -= RATE * grad / np.sqrt(sums["embed"][rows])


def calibrate(logit: np.ndarray, labels: np.ndarray, weights: np.ndarray, lang: np.ndarray) -> dict[int, tuple[float, float]]:
    """For each language, and for all (-1), a rising map of logits that sends its best threshold to ``CUT``.

    The threshold has the best weighted F1 in the calibration rows, half-way between neighbours and drawn
    towards that of all languages where rows are few.
    """
    at_cut = float(np.log(CUT / (1 - CUT)))

    def best(own: np.ndarray) -> float | None:
        x, y, w = logit[own], labels[own], weights[own]
        if len(x) < 20 or y.sum() < 5 or y.all():
            return None
        order = np.argsort(-x, kind="stable")
        x, y, w = x[order], y[order], w[order]
        hit, taken = np.cumsum(y * w), np.cumsum(w)
        f1 = 2 * hit / (taken + (y * w).sum())
        ends = np.append(x[:-1] > x[1:], True)
        k = int(np.argmax(np.where(ends, f1, -1)))
        return float((x[k] + x[k + 1]) / 2 if k + 1 < len(x) else x[k] - 1)

    everyone = best(np.ones(len(logit), bool))
    overall = 0.0 if everyone is None else everyone
    out = {-1: (1.0, at_cut - overall)}
    for k in np.unique(lang):
        own = lang == k
        t = best(own)
        if k >= 0 and t is not None:
            trust = labels[own].sum() / (labels[own].sum() + 10)
            out[int(k)] = (1.0, at_cut - (trust * t + (1 - trust) * overall))
    return out


def learn(docs: DataFrame, labels: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", label_col: str = "toxic") -> Network | None:
    """A network from labelled rows of ``docs`` outside the held-out fold; None if a label is missing altogether.

    The rows of each label are drawn by a hash of the id, at most about ``MAX_ROWS`` rows and ``MAX_CHARS``
    characters of it.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    n = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(n) != {0, 1}:
        return None
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("toxic")), F.lit(1_000_000)) / 1_000_000
    share = {y: min(1.0, MAX_ROWS[y] / n[y]) for y in n}
    chosen = marks.where(draw < F.when(F.col("label") == 1, share[1]).otherwise(share[0]))
    # At most about the sum of MAX_ROWS ids; of rows with one id one teaches.
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct("text", "lang", "label")).alias("row")).select("id", "row.*")
    sample = materialize(sample, "toxic-sample")
    size = {r["label"]: (r["c"], r["n"]) for r in sample.groupBy("label").agg(F.sum(F.length("text")).alias("c"), F.count(F.lit(1)).alias("n")).collect()}
    if set(size) != {0, 1}:
        return None
    less = {y: min(1.0, MAX_CHARS / max(1, size[y][0])) for y in size}
    redraw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("chars")), F.lit(1_000_000)) / 1_000_000
    rows = sample.where(redraw < F.when(F.col("label") == 1, less[1]).otherwise(less[0])).orderBy(F.xxhash64(F.col("id").cast("string"), F.col("text")), "id").toArrow()
    y = rows.column("label").to_numpy().astype(np.int64)
    if len(set(y.tolist())) < 2:
        return None
    weights = np.where(y == 1, 1 / (share[1] * less[1]), 1 / (share[0] * less[0]))
    texts_, langs = rows.column("text").to_pylist(), rows.column("lang").to_pylist()
    del rows
    net = train(texts_, y, langs, weights)
    del texts_
    give_back()
    return net


def score(docs: DataFrame, net: Network | None, text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``CUT`` on) to every row, from the whole text.

    Null and empty texts get the score of no evidence. Without a network every score is 0. Repeated rows
    get equal scores; other columns stay as they are, and the results replace columns of their ``names``.
    """
    docs = without(docs, *names)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    at, shared = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        memo = WordMemo(net) if net is not None else None
        for batch in batches:
            for begin, texts in slices(batch.column(at), 1 << 18):
                s = net.judge(*memo.logits(texts)).astype(np.float64) if memo is not None else np.zeros(len(texts))
                part = batch.slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32), pa.int32())], names=schema.names)

    return map_batches(docs, run, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled rows that are not held out, then score every row."""
    net = learn(docs, labels)
    return score(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), net).drop("text")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns; none goes where there is nothing to learn from."""
    net = learn(docs, labels)
    n = fresh(docs, "_score", "_predicted")
    return score(docs, net, names=(n["_score"], n["_predicted"])).where(q(n["_predicted"]) == 0).select(*(q(c) for c in docs.columns))
