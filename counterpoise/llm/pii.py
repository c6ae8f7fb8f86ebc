"""Personal data: pattern spans, and spans that boosted trees find beside them.

``base_spans`` are the matches of four patterns that also pass a check of their digits. Generators of high
recall propose further spans in what the base spans leave: obfuscated addresses, cards with other separators,
phones without a plus, IPv6, and secrets (long runs of letters and digits). Proposals of different kinds overlap.

Gradient-boosted trees judge a proposal by its format and its context. They learn from planted spans: values
in the formats of ``_forms``, put between words of every document, those of personal data
as examples and those of dates, versions, titles and the like as counterexamples; further counterexamples are
what the generators propose in the documents themselves, but for what stands behind a word for a secret. For each kind a
threshold is calibrated on documents that did not teach; proposals above it are added.

Only DataFrame functions and Spark's own trees are used. The fitted trees become a column expression, so a
document is judged where it is read and nothing is exchanged.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.llm.common import discard, fresh, materialize, q, without

#: Kinds of base spans, and all kinds.
KINDS = ("email", "ip", "card", "phone")
ALL = (*KINDS, "secret")
#: The patterns, so written that no place is tried twice: a run of characters is entered at its begin, or
#: where the match before it ended, and never given back.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:\x20?(?:@|\(at\)|\[at\])\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f.:])[0-9A-Fa-f]{1,4}(?:[.:][0-9A-Fa-f]{1,4}){3,7}+",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]{0,2}[0-9]){11,21}+",
    "phone": r"(?<![0-9])(?:\+|\(|00)?[0-9](?:[\x20()./-]{0,2}[0-9]){6,14}+",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*+(?<=[0-9A-Za-z+/_-]{16}))(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]++={0,2}+",
}
NEEDS = {"email": r"@|\(at\)|\[at\]| at ", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]", "secret": "[0-9]"}
CUES = r"tel|phon|call|fax|mobil|mail|contact|card|visa|account|iban|ip|server|host|addr|llam|appel|anruf|konto"
#: Words that stand before a secret.
SECRET = r"token|secret|passw|pwd|api.?key|access.?key|credential|bearer|auth"
NEAR = 24
#: Planted spans for each document, size of the ensemble, the precision that a threshold must have
#: shown, and how many of the calibrating spans must stand above it.
PLANTED, TREES, DEPTH, PRECISION, LEAST = 4, 10, 4, 0.98, 5
#: Matches that one step of the sums over them takes.
BLOCK = 64
#: A character that no pattern matches, and one that parts matches from what is between them.
FILLER, MARK = "\x01", "\x00"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def parts_of(text: Column, pattern: str) -> Column:
    """What is between matches, and the matches, in turns: one pass of the pattern. ``text`` holds no ``MARK``."""
    return F.split(F.regexp_replace(text, F.lit(f"({pattern})"), F.lit(f"{MARK}$1{MARK}")), MARK, -1)


def unmarked(text: Column) -> Column:
    """The text with another character for ``MARK``: none of the patterns matches either, and lengths stay."""
    return F.translate(text, MARK, FILLER)


def found(text: Column, pattern: str, needs: str) -> Column:
    """All matches as (start, end, value, before, after), places in code points; before and after is what is beside them.

    The places are sums of lengths, taken over blocks and then over the matches of a block, so that work is in proportion
    to the matches, for very long texts as well.
    """
    span = "struct<start:int,end:int,value:string,before:string,after:string>"
    none = F.array().cast(f"array<{span}>")
    size = 2 * BLOCK

    def one(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.length(p["value"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value"), p["before"].alias("before"), p["after"].alias("after"))).alias("out"))

    def block(parts: Column, k: Column) -> Column:
        own = F.slice(parts, k * size + 1, size + 1)
        pairs = F.transform(F.sequence(F.lit(1), F.least(F.lit(BLOCK), ((F.size(own) - 1) / 2).cast("int"))), lambda i: F.struct(F.length(own[2 * i - 2]).alias("gap"), F.right(own[2 * i - 2], F.lit(NEAR)).alias("before"), own[2 * i - 1].alias("value"), F.left(own[2 * i], F.lit(1)).alias("after")))
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), one)

    def places(parts: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(parts) - 3) / size).cast("int")), lambda k: block(parts, k))
        moved = F.aggregate(
            blocks,
            F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{span}>>").alias("out")),
            lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.array_append(acc["out"], F.transform(b["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["value"].alias("value"), s["before"].alias("before"), s["after"].alias("after")))).alias("out")),
            lambda acc: F.flatten(acc["out"]),
        )
        return F.when(F.size(parts) >= 3, moved).otherwise(none)

    return F.when(text.rlike(needs), let(parts_of(text, pattern), places)).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))
    turned = F.reverse(digits)

    def step(total: Column, k: Column) -> Column:
        d = turned.substr(k, F.lit(1)).cast("int") * (2 - k % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(places, F.lit(0), step) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.concat(F.lit("0"), F.substring(F.regexp_replace(p, "^0+", ""), 1, 3)).cast("int") <= 255))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(_digits(value))).otherwise(False)
    return (n >= 9) & (n <= 15) if kind == "phone" else F.lit(True)


def _base_needs(kind: str) -> str:
    return "@" if kind == "email" else r"\+" if kind == "phone" else "[0-9]"


def base_spans(text: Column, kind: str) -> Column:
    """``text`` as ``unmarked`` gives it."""
    return F.filter(found(text, BASE[kind], _base_needs(kind)), lambda s: passes(kind, s["value"]))


def covered(text: Column, kind: str) -> Column:
    """The text with ``FILLER`` in the place of every character of a base span of this kind."""
    hidden = F.transform(parts_of(text, BASE[kind]), lambda p, i: F.when((i % 2 == 1) & passes(kind, p), F.repeat(F.lit(FILLER), F.length(p))).otherwise(p))
    return F.when(text.rlike(_base_needs(kind)), F.array_join(hidden, "")).otherwise(text)


# ---------------------------------------------------------------- proposals


def _count(value: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{keep}]", "")).cast("double")


def _kind_of(char: Column) -> Column:
    return F.when(char == "", 0.0).when(char.rlike("^[0-9]"), 1.0).when(char.rlike("^[A-Za-z]"), 2.0).when(char.rlike(r"^\s"), 3.0).otherwise(4.0)


FEATURES = (
    "kind", "length", "digits", "letters", "upper", "hexes", "spaces", "dots", "dashes", "brackets", "slashes", "marks", "unders", "ats", "groups", "longest", "shortest", "last", "fours", "different", "turns", "left", "right", "cue", "secret", "given",
)


def features(kind: Column, value: Column, before: Column, after: Column) -> dict[str, Column]:
    """Format and context of a proposed span. ``kind`` is its place in ``ALL``; ``before`` is what stands in front of it."""
    groups = F.filter(F.split(value, "[^0-9A-Za-z]+", -1), lambda g: g != "")
    sizes = F.transform(groups, lambda g: F.length(g))
    least = lambda f: F.coalesce(f(sizes), F.lit(0)).cast("double")
    return {
        "kind": kind.cast("double"),
        "length": F.length(value).cast("double"),
        "digits": _count(value, "0-9"),
        "letters": _count(value, "A-Za-z"),
        "upper": _count(value, "A-Z"),
        "hexes": _count(value, "0-9a-f"),
        "spaces": _count(value, " "),
        "dots": _count(value, "."),
        "dashes": _count(value, "-"),
        "brackets": _count(value, "()\\[\\]"),
        "slashes": _count(value, "/"),
        "marks": _count(value, ":"),
        "unders": _count(value, "_"),
        "ats": value.rlike("@").cast("double"),
        "groups": F.size(groups).cast("double"),
        "longest": least(F.array_max),
        "shortest": least(F.array_min),
        "last": F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), sizes), -1), F.lit(0)).cast("double"),
        "fours": F.size(F.filter(sizes, lambda n: n == 4)).cast("double"),
        "different": F.size(F.array_distinct(F.split(F.substring(value, 1, 64), ""))).cast("double"),
        "turns": F.size(F.split(F.substring(value, 1, 64), "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", -1)).cast("double"),
        "left": _kind_of(F.right(before, F.lit(1))),
        "right": _kind_of(after),
        "cue": before.rlike(f"(?i){CUES}").cast("double"),
        "secret": before.rlike(f"(?i)(?:{SECRET})[^A-Za-z0-9]{{0,6}}$").cast("double"),
        "given": before.rlike("[=:][ \"']*$").cast("double"),
    }


def proposals(text: Column) -> Column:
    """Proposed spans of all kinds: start, end, kind (its place in ``ALL``), value, before, after."""
    tagged = lambda k, kind: F.transform(found(text, GENERATORS[kind], NEEDS[kind]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind"), s["value"].alias("value"), s["before"].alias("before"), s["after"].alias("after")))
    return F.concat(*(tagged(k, kind) for k, kind in enumerate(ALL)))


# ---------------------------------------------------------------- training spans


def _seeds(key: Column) -> dict[str, Column]:
    """Runs of characters for planted values, drawn by ``key``."""
    some = lambda tag: F.md5(F.concat(key, F.lit(tag)))
    base64 = lambda tag: F.base64(F.unhex(F.sha2(F.concat(key, F.lit(tag)), 256)))
    return {
        "hexes": F.concat(some("h"), some("i")), "digits": F.translate(F.concat(some("d"), some("e")), "abcdef", "582914"), "chars": F.regexp_replace(F.concat(base64("b"), base64("c")), "=", ""),
        "words": F.translate(F.concat(some("w"), some("v")), "0123456789", "aeioubdklm"), "roll": F.conv(F.substring(some("r"), 1, 6), 16, 10).cast("int"),
    }


def _forms() -> list[tuple[str, int, Column, Column, str]]:
    """Planted spans: kind, whether it is personal data, what stands before it, its value, what stands behind. Of the columns of ``_seeds``."""
    hexes, digits, chars, words, roll = (F.col(c) for c in ("hexes", "digits", "chars", "words", "roll"))
    cut = lambda source: lambda at, n: F.substring(source, at, n)
    d, h, c, w = cut(digits), cut(hexes), cut(chars), cut(words)
    one_of = lambda *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), roll % len(xs) + 1)
    some = lambda source, low, high: F.substring(source, F.lit(1), F.lit(low) + roll % (high - low + 1))
    cat = lambda *xs: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in xs))
    no, call, card, host = F.lit(""), one_of("tel ", "phone: ", "call ", "", ""), one_of("card ", "visa: ", "account ", "", ""), one_of("server ", "ip: ", "host ", "", "")
    told = cat(one_of("token", "secret", "password", "api_key", "API key", "access_key", "auth"), one_of(" = ", "=", ": ", ":", " = \"", "=\"", ": '"))
    bare = one_of("", "", "key ", "id ", "using ")
    at, dot = one_of(" (at) ", "(at)", " [at] ", "[at]", " at "), one_of(" (dot) ", "(dot)", " [dot] ", "[dot]", " dot ")
    mail = one_of("mail ", "contact: ", "", "", "")
    return [
        ("email", 1, mail, cat(w(1, 6), at, w(9, 5), dot, "com"), " "),
        ("email", 1, mail, cat(w(1, 4), ".", w(9, 5), d(1, 2), at, w(20, 4), dot, "example", dot, "org"), "."),
        ("email", 1, mail, cat(w(1, 6), d(1, 2), " @ ", w(9, 5), " . ", "net"), " "),
        ("email", 0, no, cat(w(1, 4), " at ", w(9, 5), ".", w(20, 4)), " "),
        ("email", 0, no, cat("look at ", w(9, 5), ". ", w(20, 4)), " "),
        ("phone", 1, call, cat("(", d(1, 3), ") ", d(4, 3), "-", d(7, 4)), " "),
        ("phone", 1, call, cat(d(1, 3), one_of("-", ".", " "), d(4, 3), one_of("-", ".", " "), d(7, 4)), one_of(" ", ".", ",")),
        ("phone", 1, call, cat("00", d(1, 2), " ", d(4, 3), " ", d(7, 6)), " "),
        ("phone", 1, call, cat("0", d(1, 3), one_of("/", " ", "-"), d(4, 4), " ", d(9, 3)), "."),
        ("phone", 0, no, cat("20", d(1, 2), "-", d(3, 2), "-", d(5, 2)), " "),
        ("phone", 0, no, cat("19", d(1, 2), "-19", d(3, 2)), " "),
        ("phone", 0, one_of("lot ", "no. ", "order ", ""), some(digits, 7, 15), " "),
        ("phone", 0, no, cat(d(1, 1), ".", some(d(2, 14), 6, 14)), " "),
        ("phone", 0, no, cat("20", d(1, 2), d(3, 2), d(5, 2), " ", d(7, 2), d(9, 2)), " "),
        ("card", 1, card, cat(d(1, 4), ".", d(5, 4), ".", d(9, 4), ".", d(13, 4)), " "),
        ("card", 1, card, cat(d(1, 4), "/", d(5, 4), "/", d(9, 4), "/", d(13, 4)), "."),
        ("card", 1, card, cat(d(1, 4), "  ", d(5, 4), "  ", d(9, 4), "  ", d(13, 4)), " "),
        ("card", 0, no, some(digits, 13, 22), " "),
        ("card", 0, no, cat("978-", d(1, 1), "-", d(2, 2), "-", d(4, 6), "-", d(10, 1)), " "),
        ("card", 0, no, cat(d(1, 2), "/", d(3, 2), "/", d(5, 4), " ", d(9, 2), ".", d(11, 2)), " "),
        ("card", 0, no, cat(d(1, 1), " ", d(2, 1), " ", d(3, 2), " ", d(5, 1), " ", d(6, 3), " ", d(9, 1), " ", d(10, 2), " ", d(12, 3)), " "),
        ("ip", 1, host, F.concat_ws(":", *(h(4 * k + 1, 4) for k in range(8))), " "),
        ("ip", 0, no, cat(d(1, 1), ".", d(2, 1), ".", d(3, 2), ".", d(5, 1), ".", d(6, 1)), " "),
        ("ip", 0, no, cat("1", d(1, 1), ":", d(2, 2), ":", d(4, 2), ":", d(6, 2)), " "),
        ("ip", 0, no, cat("20", d(1, 2), ".", d(3, 2), ".", d(5, 2), ".", d(7, 4)), " "),
        ("secret", 1, told, h(1, 40), "\""),
        ("secret", 1, told, h(1, 32), one_of("\"", " ", "'", "\n")),
        ("secret", 1, told, some(chars, 18, 60), one_of("\"", " ", "'", ",")),
        ("secret", 1, told, cat(one_of("AKIA", "ghp_", "sk-", "xoxb-"), some(chars, 16, 36)), one_of("\"", " ", "'")),
        ("secret", 1, bare, cat(one_of("ghp_", "sk-", "AKIA"), some(chars, 24, 40)), " "),
        ("secret", 1, bare, h(1, 40), one_of(" ", "\"", ".")),
        ("secret", 0, no, cat(w(1, 6), "-", w(9, 5), "-", d(1, 2), "-", w(20, 6)), " "),
        ("secret", 0, no, cat("IMG_20", d(1, 6), "_", d(9, 9)), "."),
        ("secret", 0, no, cat(w(1, 9), "/", w(12, 8), "/", w(22, 6), d(1, 1)), " "),
        ("secret", 0, no, cat(w(1, 5), "_", w(9, 5), "_", w(17, 5), "_", d(1, 3)), one_of(" ", ",", "(")),
        ("secret", 0, no, cat(w(1, 4), "_", w(6, 4), "_", w(11, 4), "_", w(17, 2), "_", w(20, 6), "_", d(1, 2)), one_of(" ", ".", "(")),
        ("secret", 0, one_of("id ", "no. ", "ref: ", ""), cat(w(1, 2), "-", d(1, 10), "-", d(12, 6)), " "),
        ("secret", 0, no, cat(w(1, 17), d(1, 1)), " "),
    ]


def _planted(rows: DataFrame) -> DataFrame:
    """Training spans put between words of ``rows`` (id, fold, text): fold, kind, value, before, after, label."""
    each = rows.select("fold", "text", "id", F.explode(F.sequence(F.lit(1), F.lit(PLANTED))).alias("turn"))
    each = each.select("fold", "text", F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.md5("text"), "turn").alias("key"))
    forms = _forms()
    values = {"key": F.col("key"), "form": F.pmod(F.xxhash64("key", F.lit("form")), F.lit(len(forms))).cast("int"), **_seeds(F.col("key"))}
    drawn = each.select("fold", "text", *(c.alias(name) for name, c in values.items()))
    pick = lambda k: reduce(lambda other, x: F.when(F.col("form") == x, forms[x][k]).otherwise(other), range(len(forms)), F.lit(None))
    at = F.pmod(F.xxhash64("key", F.lit("place")), F.length("text") + 1).cast("int")
    before = F.regexp_replace(F.col("text").substr(at, F.lit(NEAR)), r"\S*$", "")
    kinds, labels = (F.array(*(F.lit(x) for x in xs)) for xs in ([ALL.index(x[0]) for x in forms], [float(x[1]) for x in forms]))
    return drawn.select("fold", kinds[F.col("form")].alias("kind"), pick(3).alias("value"), F.right(F.concat(before, pick(2)), F.lit(NEAR)).alias("before"), pick(4).alias("after"), labels[F.col("form")].alias("label"))


def _tree(node, x: Column) -> Column:
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(x[FEATURES[split.featureIndex()]] <= float(split.threshold()), _tree(node.leftChild(), x)).otherwise(_tree(node.rightChild(), x))


class Redactor:
    """A fitted ensemble as a column expression, and each kind's threshold. Without an ensemble nothing is added."""

    def __init__(self, model: GBTClassificationModel | None, thresholds: dict[str, float]):
        self.model, self.thresholds = model, thresholds

    def score(self, x: Column) -> Column:
        parts = [_tree(tree._call_java("rootNode"), x) * w for tree, w in zip(self.model.trees, self.model.treeWeights, strict=True)]
        return 1 / (1 + F.exp(-2 * reduce(lambda a, b: a + b, parts)))

    def added(self, rest: Column) -> Column:
        """(start, end, kind) of proposals above their kind's threshold, in order. Of two neighbours that overlap the one with the higher score stays."""
        none = F.array().cast("array<struct<start:int,end:int,kind:int,score:double>>")
        if self.model is None or not self.thresholds:
            return none
        limits = F.array(*(F.lit(float(self.thresholds.get(kind, 2.0))) for kind in ALL))

        def judged(s: Column) -> Column:
            f = features(s["kind"], s["value"], s["before"], s["after"])
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), let(F.struct(*(f[n].alias(n) for n in FEATURES)), self.score).alias("score"))

        good = F.array_sort(F.filter(F.transform(proposals(rest), judged), lambda s: s["score"] >= F.element_at(limits, s["kind"] + 1)))
        rank = lambda s: F.struct(s["score"].alias("score"), (-s["kind"]).alias("kind"), (-s["start"]).alias("start"))

        def best(spans: Column) -> Column:
            def stays(s: Column, i: Column) -> Column:
                before, after = F.get(spans, i - 1), F.get(spans, i + 1)
                worse = lambda o, meets: F.coalesce(meets & (rank(o) > rank(s)), F.lit(False))
                return ~worse(before, before["end"] > s["start"]) & ~worse(after, after["start"] < s["end"])

            return F.filter(spans, stays)

        return F.when(F.size(good) > 1, let(good, best)).otherwise(good)


def training_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Features and label of the proposals in all documents and of the spans planted in all. A fifth of the documents is fold 0."""
    rows = docs.select(q(id_col).alias("id"), unmarked(F.coalesce(q(text_col), F.lit(""))).alias("text"))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("id", "text", F.lit("check")), F.lit(5)))
    rest = rows.select("fold", _rest(rows, "text").alias("text"))
    told = F.col("s.before").rlike(f"(?i)(?:{SECRET})[^A-Za-z0-9]{{0,6}}$")
    natural = rest.select("fold", F.explode(proposals(F.col("text"))).alias("s")).where(~told).select("fold", *(F.col(f"s.{c}").alias(c) for c in ("kind", "value", "before", "after")), F.lit(0.0).alias("label"))
    spans = natural.unionByName(_planted(rows))
    f = features(F.col("kind"), F.col("value"), F.col("before"), F.col("after"))
    return spans.select("fold", F.col("kind").alias("of"), "label", *(f[name].alias(name) for name in FEATURES))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Redactor:
    """Fit on all documents: four fifths, dealt by a hash of id and text, teach the trees, and the others calibrate the thresholds."""
    seen = materialize(training_spans(docs, id_col, text_col), "pii-spans")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(seen)
    teach = vectors.where("fold <> 0")
    labels, n = teach.agg(F.count_distinct("label"), F.count(F.lit(1))).first()
    if labels < 2:
        discard(seen)
        return Redactor(None, {})
    # Spark draws the rows that give candidate splits, unless the square of the bins is as many: then it takes all.
    bins = min(max(64, math.isqrt(n) + 1), 46_340)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=11, labelCol="label", featuresCol="features", maxBins=bins).fit(teach)
    redactor = Redactor(model, {})
    scored = seen.where("fold = 0").select("of", "label", F.floor(redactor.score(F.struct(*FEATURES)) * 1000).alias("p")).groupBy("of", "p").agg(F.sum("label").alias("hits"), F.count(F.lit(1)).alias("n")).collect()  # at most 1001 scores of each kind
    discard(seen)
    for k, kind in enumerate(ALL):
        hits = total = 0
        for p, h, m in sorted(((r["p"], r["hits"], r["n"]) for r in scored if r["of"] == k), reverse=True):
            hits, total = hits + h, total + m
            if p >= 500 and hits >= PRECISION * total and hits >= LEAST:
                redactor.thresholds[kind] = p / 1000
    return redactor


def _rest(docs: DataFrame, text_col: str) -> Column:
    """The text without its base spans. What base spans of two kinds share may stay in part."""

    def without_kind(kind: str):
        return lambda text: covered(text, kind)

    text = q(text_col)
    for kind in KINDS:
        text = let(text, without_kind(kind))
    return text


def redactions(docs: DataFrame, redactor: Redactor, text_col: str = "text") -> DataFrame:
    """Add ``base`` and ``added``: arrays of (kind, start, end), ``base`` by kind as in ``KINDS`` and then by start, ``added`` by start.

    Null texts count as empty and have no span. Base spans of different kinds may overlap; added spans lie outside
    of base spans. Repeated rows and other columns stay as they are; the results replace columns of their names.
    """
    docs = without(docs, "base", "added")
    n = fresh(docs, "_text", "_rest", *(f"_{k}" for k in KINDS))
    out = docs.withColumn(n["_text"], unmarked(F.coalesce(q(text_col), F.lit(""))))
    out = out.select("*", *(base_spans(F.col(n["_text"]), k).alias(n[f"_{k}"]) for k in KINDS))
    tagged = lambda spans, kind: F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = F.concat(*(tagged(F.col(n[f"_{k}"]), k) for k in KINDS))
    some = reduce(lambda a, b: a | b, (F.size(F.col(n[f"_{k}"])) > 0 for k in KINDS))
    out = out.withColumn(n["_rest"], F.when(some, _rest(out, n["_text"])).otherwise(F.col(n["_text"])))
    names = F.array(*(F.lit(k) for k in ALL))
    added = F.transform(redactor.added(F.col(n["_rest"])), lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return out.select(*(q(c) for c in docs.columns), base.alias("base"), added.alias("added"))


def redact(text_col: str, spans: Column, mark: str = "[{}]") -> Column:
    """Column: the text with every span replaced by its kind; overlapping spans become the first one's."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.col(text_col)
    before, after = mark.split("{}")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(before), s["kind"], F.lit(after)).alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))
    return F.aggregate(ordered, zero, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))


def document_pii(docs: DataFrame) -> DataFrame:
    """Per document: base counts by kind, a digest of the base spans, all spans as ``kind:start:end`` joined by commas, and how many they are.

    Null, empty and repeated rows are as ``redactions`` says; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    spans = redactions(docs, learn(docs))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    place = F.array(*(F.lit(k) for k in ALL))
    merged = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(F.array_position(place, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    of_kind = lambda kind: F.filter("base", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(merged).alias("spans"), F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))
