"""URL filtering: given rules for hosts and paths, and association rules mined from labelled URLs.

A given rule (host, path, verdict) fits its host and all subdomains, if the URL's path starts with the
rule's path; of several, the longest wins.

URLs without a given rule are judged by association rules {tokens} -> verdict. FP-growth mines frequent
token combinations of labelled URLs; rules under the support or confidence asked for are pruned. Tokens that always stand
together in labelled URLs, as those of a template do, are mined as one, and the combinations are spelled out afterwards:
they have equal counts, and their subsets would double with each token. An inverted
index files every rule under its rarest token; a URL's tokens meet the index, and a rule matches if the URL
has all its tokens. The best match, by confidence, then support, then more tokens, decides; without one the
URL is allowed. Token sets are judged once however many URLs share them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.llm.common import discard, fresh, materialize, small, without

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SUPPORT, CONFIDENCE, TOKENS = 0.01, 0.6, 3
#: Separates the label from tokens: no token begins with it.
LABEL = "="


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null and without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substring_index(url.substr(F.locate("://", url) + 3, F.length(url)), "/", 1)).otherwise("")
    part = F.coalesce(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), F.lit(""))
    return F.translate(part, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null and without ``://``."""
    rest = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url))).otherwise("")
    plain = F.coalesce(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), F.lit(""))
    return F.when(F.locate("/", plain) > 0, plain.substr(F.locate("/", plain), F.length(plain))).otherwise("")


def rule_of(h: Column, p: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest rule that fits, as (rule, verdict), or null. ``rules`` is a short given list, not data."""
    fits = [F.when(((h == rh) | h.endswith(f".{rh}")) & p.startswith(rp), F.struct(F.lit(rh + rp).alias("rule"), F.lit(verdict).alias("verdict"))) for rh, rp, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens(url: Column, h: Column, p: Column) -> Column:
    """The distinct tokens of a URL: its scheme, host labels and suffixes, path words and their depth, query keys, fragment."""
    labels = F.split(h, r"\.", -1)
    segments = F.filter(F.split(p, "/"), lambda s: s != "")
    # Numbers say little by themselves: their shape counts.
    shape = lambda s: F.regexp_replace(F.lower(s), "[0-9]+", "0")
    query = F.when(F.locate("?", url) > 0, F.substring_index(F.substring_index(url.substr(F.locate("?", url) + 1, F.length(url)), "#", 1), "?", 1)).otherwise("")
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    none = F.array().cast("array<string>")
    parts = [
        F.array(F.concat(F.lit("s:"), F.lower(F.substring_index(url, "://", 1)))),
        F.transform(F.filter(labels, lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x)),
        F.transform(F.filter(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda x: x != ""), lambda x: F.concat(F.lit("w:"), x)),
        F.transform(segments, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), shape(x))),
        F.array(F.concat(F.lit("depth:"), F.size(segments).cast("string"))),
        keys,
        F.when(F.locate("#", url) > 0, F.array(F.lit("f:"))).otherwise(none),
    ]
    return F.when(h == "", none).otherwise(F.array_sort(F.array_distinct(F.concat(*parts))))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, most_tokens: int = TOKENS) -> DataFrame:
    """Association rules of ``labelled`` (tokens, verdict): items, verdict, n (URLs with both), of (URLs with the items).

    A stored table of at most a number of rows that support bounds, whatever the number of URLs. No labelled
    URL gives no rule.
    """
    spark = labelled.sparkSession
    none = spark.createDataFrame([], "items array<string>, verdict string, n long, of long")
    numbered = materialize(labelled.where(F.size("tokens") > 0).select("tokens", "verdict").withColumn("row", F.monotonically_increasing_id()), "labelled")
    n = numbered.count()
    if not n:
        return none
    # Tokens with the same rows: equal counts, and equal sums of two hashes of the rows.
    rows = numbered.select("row", F.explode("tokens").alias("token")).withColumns({f"h{k}": F.xxhash64("row", F.lit(k)).cast("decimal(20,0)") for k in (1, 2)})
    of_token = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2")).where(F.col("n") >= F.ceil(F.lit(support) * n))
    alike = Window.partitionBy("n", "h1", "h2")  # at most as many rows as support lets there be frequent tokens
    frequent = materialize(of_token.select("token", F.min("token").over(alike).alias("head")), "tokens")
    heads = numbered.select("row", "verdict", F.explode("tokens").alias("token")).join(small(frequent), "token").groupBy("row", "verdict").agg(F.collect_set("head").alias("heads"))
    baskets = materialize(heads.select(F.array_append("heads", F.concat(F.lit(LABEL), "verdict")).alias("items")), "baskets")
    # A URL without a frequent token is in no basket: support is a share of all.
    in_baskets = baskets.count()
    if not in_baskets:
        return none
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (math.ceil(support * n) - 0.5) / in_baskets), minConfidence=0.0).fit(baskets)
    mined = materialize(model.freqItemsets.where(F.size("items") <= most_tokens + 1), "itemsets")
    sets = materialize(_spelled_out(mined, frequent, most_tokens), "spelled")
    discard(numbered, baskets, mined, frequent)
    is_label = lambda x: x.startswith(LABEL)
    whole = sets.select(F.array_sort("items").alias("items"), F.col("freq"))
    plain = whole.where(~F.exists("items", is_label)).where(F.size("items") <= most_tokens).select("items", F.col("freq").alias("of"))
    joint = whole.where(F.exists("items", is_label)).select(F.filter("items", lambda x: ~is_label(x)).alias("items"), F.element_at(F.filter("items", is_label), 1).substr(2, 1000).alias("verdict"), F.col("freq").alias("n"))
    rules = joint.where(F.size("items") > 0).join(plain, "items").where(F.col("n") >= confidence * F.col("of"))
    return materialize(rules.select("items", "verdict", "n", "of"), "rules")


def _spelled_out(sets: DataFrame, frequent: DataFrame, most: int) -> DataFrame:
    """Item sets (items, freq) of heads as those of all tokens that stand for them: one or more of each head's, ``most`` in all.

    Their number is what combinations of up to ``most`` frequent tokens there are.
    """
    is_label = lambda x: x.startswith(LABEL)
    members = small(materialize(frequent.groupBy("head").agg(F.array_sort(F.collect_list("token")).alias("own")), "members"))
    each = sets.select("items", "freq", F.filter("items", lambda x: ~is_label(x)).alias("heads"), F.filter("items", is_label).alias("done"))
    done = each.where(F.size("heads") <= most).select("freq", "heads", "done", F.lit(0).alias("taken"))
    # Head by head: the next one gives one to ``most`` of its tokens, in order.
    out = done.where(F.size("heads") == 0).select(F.col("done").alias("items"), "freq")
    step = done.where(F.size("heads") > 0)
    for _ in range(most):
        opened = step.withColumn("head", F.col("heads")[0]).join(members, "head")
        picks = [opened.select("freq", "heads", "done", "taken", F.explode(F.transform("own", lambda x: F.array(x))).alias("pick"), "own")]
        for _ in range(most - 1):
            more = picks[-1].select("freq", "heads", "done", "taken", "own", "pick", F.explode(F.filter("own", lambda x: x > F.element_at("pick", -1))).alias("next"))
            picks.append(more.select("freq", "heads", "done", "taken", F.array_append("pick", F.col("next")).alias("pick"), "own"))
        step = reduce(DataFrame.unionByName, picks).select("freq", F.slice("heads", 2, 1_000).alias("heads"), F.concat("done", "pick").alias("done"), (F.col("taken") + F.size("pick")).alias("taken"))
        step = materialize(step.where(F.col("taken") + F.size("heads") <= most), "step")
        out = out.unionByName(step.where(F.size("heads") == 0).select(F.col("done").alias("items"), "freq"))
        step = step.where(F.size("heads") > 0)
    return out


def best_rules(sets: DataFrame, rules: DataFrame, key: str = "tokens") -> DataFrame:
    """For each distinct token set of ``sets`` that some rule matches: the verdict of its best rule, and the rule."""
    weight = rules.select(F.explode("items").alias("token"), "of").groupBy("token").agg(F.max("of").alias("seen"))
    filed = rules.select("*", F.explode("items").alias("token")).join(weight, "token").withColumn("k", F.row_number().over(Window.partitionBy("items", "verdict").orderBy("seen", "token"))).where("k = 1").drop("k", "seen")
    index = small(materialize(filed, "rule-index"))
    met = sets.select(F.col(key), F.explode(key).alias("token")).join(index, "token").where(F.size(F.array_except("items", F.col(key))) == 0)
    order = F.struct((F.col("n") / F.col("of")).alias("confidence"), F.col("n").alias("n"), F.size("items").alias("size"), F.col("verdict").alias("verdict"), F.array_join("items", " ").alias("by"))
    return met.groupBy(key).agg(F.max(order).alias("best")).select(key, F.col("best.verdict").alias("mined"), F.col("best.by").alias("by"), F.col("best.confidence").alias("confidence"))


def filter_urls(pages: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, labelled: DataFrame | None = None, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Add host, path, rule, verdict, and of judged URLs the association rule (``by``) and its confidence.

    ``labelled`` (url, verdict) teaches the association rules; by default the URLs that a given rule decides
    do. Null URLs and those without ``://`` have an empty host and path and no tokens and are allowed. Rows,
    repeated ones too, and other columns stay; the results replace columns of their names.
    """
    names = ("host", "path", "rule", "verdict", "by", "confidence")
    pages = without(pages, *names)
    n = fresh(pages, "_given", "_tokens")
    url = F.col(url_col)
    parsed = pages.withColumns({"host": host(url), "path": path(url)})
    parsed = parsed.withColumns({n["_given"]: rule_of(F.col("host"), F.col("path"), rules), n["_tokens"]: tokens(F.coalesce(url, F.lit("")), F.col("host"), F.col("path"))})
    given, toks = F.col(n["_given"]), F.col(n["_tokens"])
    if labelled is None:
        teach = parsed.where(given.isNotNull()).select(toks.alias("tokens"), given["verdict"].alias("verdict"))
    else:
        u = F.col("url")
        teach = labelled.where("verdict is not null").select(tokens(F.coalesce(u, F.lit("")), host(u), path(u)).alias("tokens"), "verdict")
    sets = parsed.where(given.isNull()).select(toks.alias("tokens")).distinct()
    judged = small(materialize(best_rules(sets, mine(teach, support, confidence)), "judged"))
    # Only URLs that rules may decide meet them; the rest, null URLs among them, share one key and would share a task.
    own = given.isNull()
    open_ = own & (F.size(toks) > 0)
    met = parsed.where(open_).join(judged.withColumnRenamed("tokens", n["_tokens"]), n["_tokens"], "left")
    joined = met.unionByName(parsed.where(~open_), allowMissingColumns=True)
    return joined.select(
        *pages.columns,
        "host",
        "path",
        given["rule"].alias("rule"),
        F.coalesce(given["verdict"], F.col("mined"), F.lit("allow")).alias("verdict"),
        F.when(own, F.col("by")).alias("by"),
        F.when(own, F.col("confidence")).alias("confidence"),
    )


def judge_pages(pages: DataFrame) -> DataFrame:
    """The verdict on every page's URL, by the given rules and the rules mined from what they decide.

    Null, repeated and odd URLs and empty tables are as ``filter_urls`` says; null and repeated page_ids stay.
    """
    return filter_urls(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", F.coalesce("by", F.lit("")).alias("mined_by"))
