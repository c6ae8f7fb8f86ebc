"""Language identification with interpolated Kneser-Ney character models.

One model for each language predicts the letters of a word, and its end, from up to
``ORDER - 1`` characters before them within the word. All models share one sorted array of
64-bit n-gram hashes for each order, with a column of discounted probabilities and a column of
back-off weights for each language, so a lookup is one binary search whatever the number of
languages. A text belongs to the language with the lowest cross-entropy per character; how far
the second-best is away gives a calibrated score, and texts that no language models well are
marked as rejected.

Learning reads a sample of at most about ``per_lang`` texts for each language, dealt by a hash of
the id; a fifth of it only calibrates. Models of up to ``LANGS`` languages are held together; if there are more, texts
meet them in several passes, each with models whose size these two bounds limit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.llm.common import discard, fresh, held_out, map_batches, materialize, q, slices, small, without

ORDER = 5
PER_LANG = 1500
#: Languages whose models are learned and sent to the executors together, and rows that a language needs to spare some for calibration.
LANGS, SPARE = 48, 50
#: Words a worker's memo may hold before it is emptied.
MEMO = 300_000
START, END = "\x02", "\x03"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def letters(part: str) -> list[str]:
    """The runs of letters of a string without white space, in lower case."""
    part = part.lower()
    return [part] if part.isalpha() else "".join(c if c.isalpha() else " " for c in part).split()


def _hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` codes that end at each place; the first ``order - 1`` are of no use."""
    h = np.zeros(len(codes), np.uint64)
    for back in range(order - 1, -1, -1):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[back:] = codes[: len(codes) - back]
        h = (h ^ shifted) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _padded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words with their boundary marks; which places are predicted; each place's word."""
    text = "".join(START * (ORDER - 1) + w + END for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter((len(w) + ORDER for w in words), np.int64, len(words))
    return codes, codes != ord(START), np.repeat(np.arange(len(words)), lengths)


@dataclass
class KneserNey:
    """``keys[n]``: sorted hashes of the n-grams seen in any language; ``alpha[n]``, ``gamma[n]``: rows beside them."""

    langs: list[str]
    keys: list[np.ndarray]
    alpha: list[np.ndarray]
    gamma: list[np.ndarray]
    floor: float

    def log_probs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word: log probability by language, and how many characters were predicted."""
        if not words:
            return np.zeros((0, len(self.langs)), np.float32), np.zeros(0, np.int64)
        codes, predicted, of = _padded(words)
        p = np.full((len(codes), len(self.langs)), self.floor, np.float32)
        gamma = self.gamma[0]
        for n in range(1, ORDER + 1):
            keys, h = self.keys[n], _hashes(codes, n)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            back = gamma if n == 1 else np.vstack([np.ones((1, len(self.langs)), np.float32), gamma[:-1]])
            p = np.where(hit[:, None], self.alpha[n][at], 0) + back * p
            if n < ORDER:
                gamma = np.where(hit[:, None], self.gamma[n][at], 1).astype(np.float32)
        logs = np.log(np.maximum(p, 1e-12)) * predicted[:, None]
        first = np.searchsorted(of, np.arange(len(words)))
        return np.add.reduceat(logs, first, axis=0), np.add.reduceat(predicted.astype(np.int64), first)


def fit_counts(counts: dict[str, Counter], vocabulary: int | None = None) -> KneserNey:
    """Models from word counts by language. Discounts are those of the counts of ones and twos of each order.

    ``vocabulary`` is how many characters there are, the end of a word included; by default those of ``counts``.
    """
    langs, weigh = sorted(counts), {}
    vocabulary = vocabulary or len({c for words in counts.values() for w in words for c in w}) + 1
    tables: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
    zero = np.zeros((1, len(langs)), np.float32)
    for k, lang in enumerate(langs):
        words = sorted(counts[lang])
        codes, predicted, of = _padded(words)
        times = np.array([counts[lang][w] for w in words], np.int64)[of]
        grams = {n: _hashes(codes, n) for n in range(1, ORDER + 1)}
        own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(ORDER, 0, -1):
            if n == ORDER:
                seen, inverse = np.unique(grams[n][predicted], return_inverse=True)
                own[n] = seen, np.bincount(inverse, weights=times[predicted]).astype(np.float64)
            else:  # how many different characters stand before it
                _, one = np.unique(grams[n + 1][predicted], return_index=True)
                seen, inverse = np.unique(grams[n][predicted][one], return_inverse=True)
                own[n] = seen, np.bincount(inverse).astype(np.float64)
        for n in range(1, ORDER + 1):
            seen, c = own[n]
            ones, twos = (c == 1).sum(), (c == 2).sum()
            discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
            _, place = np.unique(grams[n][predicted], return_index=True)
            places = np.flatnonzero(predicted)[place]
            if n == 1:
                context = np.zeros(len(seen), np.uint64)
            else:
                context = grams[n - 1][places - 1]
            ctx, inverse = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(inverse, weights=c), np.bincount(inverse)
            alpha = np.maximum(c - discount, 0) / total[inverse]
            tables[n].append((seen, alpha, np.full(len(seen), k)))
            weigh[k, n - 1] = ctx, discount * kinds / total
    keys, alphas, gammas = [np.zeros(0, np.uint64)], [zero], [zero]
    gammas[0] = np.array([[weigh[k, 0][1][0] if len(weigh[k, 0][1]) else 1 for k in range(len(langs))]], np.float32)
    for n in range(1, ORDER + 1):
        contexts = [weigh[k, n][0] for k in range(len(langs))] if n < ORDER else []
        key = np.unique(np.concatenate([t[0] for t in tables[n]] + contexts))
        alpha, gamma = np.zeros((len(key), len(langs)), np.float32), np.ones((len(key), len(langs)), np.float32)
        for seen, a, of in tables[n]:
            alpha[np.searchsorted(key, seen), of] = a
        for k in range(len(langs)) if n < ORDER else ():
            ctx, g = weigh[k, n]
            gamma[np.searchsorted(key, ctx), k] = g
        keys.append(key)
        alphas.append(alpha)
        gammas.append(gamma)
    return KneserNey(langs, keys, alphas, gammas, 1 / vocabulary)


class WordMemo(dict):
    """Row of each part of a text in a table of log probabilities and character counts."""

    def __init__(self, model: KneserNey):
        super().__init__()
        self.model, self.rows = model, np.zeros((1024, len(model.langs) + 1), np.float64)

    def learn(self, parts: set[str]) -> None:
        new = [p for p in parts if p not in self]
        if len(self) + len(new) > MEMO:
            self.clear()
            new = list(parts)
        for begin in range(0, len(new), 20_000):
            run = new[begin : begin + 20_000]
            words = [letters(p) for p in run]
            logs, n = self.model.log_probs(list(chain.from_iterable(words)))
            held = len(self)
            while held + len(run) > len(self.rows):
                self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
            self.rows[held : held + len(run)] = 0
            of = np.repeat(np.arange(len(run)), [len(w) for w in words])
            np.add.at(self.rows[held : held + len(run)], of, np.column_stack([logs, n]) if len(of) else np.zeros((0, self.rows.shape[1])))
            for k, part in enumerate(run):
                self[part] = held + k

    def sums(self, texts: list[str]) -> np.ndarray:
        split = [t.split() for t in texts]
        self.learn(set().union(*split))
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        rows = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))
        out = np.zeros((len(texts), self.rows.shape[1]))
        some = np.flatnonzero(lengths)
        if len(some):
            out[some] = np.add.reduceat(self.rows[rows], np.concatenate([[0], np.cumsum(lengths[some])[:-1]]), axis=0)
        return out


@dataclass
class Languages:
    """Models of all languages, in groups of at most ``LANGS`` in the languages' order, and what calibration has found."""

    groups: list[KneserNey]
    slope: float = 40.0
    shift: float = 0.0
    reject_above: float = float("inf")

    @property
    def langs(self) -> list[str]:
        return [x for g in self.groups for x in g.langs]


def judge(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the best language (-1: no letter), its cross-entropy, and the second-best's (infinite if there is none)."""
    n = sums[:, -1]
    ce = -sums[:, :-1] / np.maximum(n, 1)[:, None]
    best = ce.argmin(1)
    low = ce[np.arange(len(ce)), best]
    second = np.partition(ce, 1, axis=1)[:, 1] if ce.shape[1] > 1 else np.full(len(ce), np.inf)
    return np.where(n > 0, best, -1), low, second


_BEST = (("lang", T.StringType()), ("low", T.DoubleType()), ("second", T.DoubleType()))


def _best_of_group(df: DataFrame, group: KneserNey, text_col: str, names: tuple[str, ...], go_on: bool) -> DataFrame:
    """Add the best language, its cross-entropy and the second-best's; ``go_on``: against those of the groups before, which ``df`` has."""
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *(T.StructField(n, k) for n, (_, k) in zip(names, _BEST, strict=True))])
    at, shared = df.columns.index(text_col), df.sparkSession.sparkContext.broadcast(group)
    own, before = [df.columns.index(f.name) for f in kept], [df.columns.index(n) for n in names] if go_on else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, memo = shared.value, None
        for batch in batches:
            memo = memo or WordMemo(group)
            for begin, texts in slices(batch.column(at)):
                part = batch.slice(begin, len(texts))
                best, low, second = judge(memo.sums(texts))
                langs = [group.langs[k] if k >= 0 else None for k in best.tolist()]
                if go_on:
                    lang0, low0, second0 = (part.column(k) for k in before)
                    low0, second0 = low0.to_numpy(zero_copy_only=False), second0.to_numpy(zero_copy_only=False)
                    first = low0 <= low  # ties go to the language before
                    langs = [x if f else y for x, y, f in zip(lang0.to_pylist(), langs, first.tolist(), strict=True)]
                    low, second = np.where(first, low0, low), np.where(first, np.minimum(second0, low), np.minimum(second, low0))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in own), pa.array(langs, pa.string()), pa.array(low, pa.float64()), pa.array(second, pa.float64())], names=schema.names)

    return map_batches(df, run, schema)


def _score(df: DataFrame, models: Languages, text_col: str, names: tuple[str, str, str, str]) -> DataFrame:
    """Add language, score, cross-entropy and whether it is rejected: one pass for each group of languages."""
    held = fresh(df, *(f"_{n}" for n, _ in _BEST), *names)
    inner = tuple(held[f"_{n}"] for n, _ in _BEST)
    out = df
    for k, group in enumerate(models.groups):
        out = _best_of_group(out, group, text_col, inner, k > 0)
    if not models.groups:
        out = df.withColumns({n: F.lit(None).cast(kind) for n, (_, kind) in zip(inner, _BEST, strict=True)})
    lang, low, second = (q(n) for n in inner)
    # With one language alone its lead counts as 1.
    lead = F.when(second == float("inf"), F.lit(1.0)).otherwise(second - low)
    power = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), lead * models.slope + models.shift))
    none = lang.isNull()
    score = F.when(none, 0.0).otherwise(1 / (1 + F.exp(-power)))
    odd = none | (low > models.reject_above)
    return out.select(*(q(c) for c in df.columns), F.coalesce(lang, F.lit("und")).alias(names[0]), score.alias(names[1]), F.when(none, 0.0).otherwise(low).alias(names[2]), odd.alias(names[3]))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = PER_LANG, langs_a_pass: int = LANGS) -> Languages:
    """Models of the languages named in ``docs``, from rows whose text and language are there and whose id is not held out.

    ``per_lang`` bounds the texts that are learned from, for each language; without any row the models know no language.
    A language with fewer than ``SPARE`` rows teaches with all of them and does not calibrate.
    """
    rows = docs.select(q(id_col).alias("id"), q(text_col).alias("text"), q(lang_col).alias("lang")).where(~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang-sizes")
    of = lambda tag: F.xxhash64(F.col("id").cast("string"), F.lit(tag))
    draw = F.pmod(of("sample"), F.lit(1_000_000)) / 1_000_000
    check = (F.pmod(of("check"), F.lit(5)) == 0) & (F.col("n") >= SPARE)
    sample = materialize(rows.join(small(sizes), "lang").where(draw < F.lit(per_lang) / F.col("n")).select("text", "lang", check.alias("check")), "lang-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got.setdefault(lang, Counter()).update(text.split())
        for lang, parts in got.items():
            words: Counter = Counter()
            for part, k in parts.items():
                for w in letters(part):
                    words[w] += k
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])

    words = materialize(map_batches(sample.where(~F.col("check")).select("lang", "text"), count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    known = sorted(r[0] for r in words.select("lang").distinct().collect())
    vocabulary = words.select(F.explode(F.split("word", "")).alias("c")).distinct().count() + 1
    groups = []
    for k in range(0, len(known), langs_a_pass):
        table = words.where(F.col("lang").isin(known[k : k + langs_a_pass])).toArrow()  # bounded by per_lang and langs_a_pass
        counts: dict[str, Counter] = {}
        for lang, word, n in zip(*(table.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
            counts.setdefault(lang, Counter())[word] = n
        groups.append(fit_counts(counts, vocabulary))
    models = Languages(groups)
    if groups:
        seen = _score(sample.where("check").select("text", "lang"), models, "text", ("got", "conf", "ce", "odd")).where("got <> 'und'").select((F.col("got") == F.col("lang")).alias("right"), "conf", "ce").toArrow()
        if len(seen) >= 50:
            calibrate(models, seen.column("right").to_numpy(zero_copy_only=False), seen.column("conf").to_numpy(), seen.column("ce").to_numpy())
    discard(sizes, sample, words)
    return models


def calibrate(model: Languages, right: np.ndarray, conf: np.ndarray, ce: np.ndarray) -> None:
    """Fit the score's slope and shift to how often the best language was right, and the rejection bound to the right ones."""
    lead = (np.log(np.clip(conf, 1e-12, 1 - 1e-12) / np.clip(1 - conf, 1e-12, 1)) - model.shift) / model.slope
    a, b, y = model.slope, model.shift, right.astype(float)
    y = np.where(y > 0, 1 - 1 / (len(y) + 2), 1 / (len(y) + 2))
    for _ in range(25):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(a * lead + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        x = np.column_stack([lead, np.ones_like(lead)])
        g = x.T @ (p - y) + 1e-3 * np.array([a - 40.0, b])
        h = (x * w[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    if a > 0 and np.isfinite([a, b]).all():
        model.slope, model.shift = float(a), float(b)
    if right.any():
        model.reject_above = float(np.quantile(ce[right], 0.995) * 1.1)


def identify(docs: DataFrame, model: Languages, text_col: str = "text") -> DataFrame:
    """Add lang_pred, score, cross_entropy and rejected to every row, from the whole text.

    Null texts and texts without a letter are ``und`` with score 0 and rejected. Long texts are read whole,
    ties go to the first language in sorted order, repeated rows and other columns stay as they are; the results
    replace columns of their names.
    """
    names = ("lang_pred", "score", "cross_entropy", "rejected")
    return _score(without(docs, *names), model, text_col, names)


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, then judge every row by its text alone.

    Null, empty and repeated rows are as ``identify`` says; null doc_ids are in no fold; an empty table gives an empty result.
    """
    model = learn(docs)
    return identify(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), model).drop("text")
