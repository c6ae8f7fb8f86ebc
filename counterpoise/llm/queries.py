"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from counterpoise.llm import decontaminate, langid, lines, mpegts, neardup, packing, passages, pii, toxicity, urls
from counterpoise.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_convolutional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_deletion_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.document_lines(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_line_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.document_repeats(table(spark, sf_dir, "documents"))


def op5_prob_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_mpeg_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.media_digests(table(spark, sf_dir, "documents"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op9_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.document_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_gradient_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.document_pii(table(spark, sf_dir, "documents"))


def op8_fp_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_pages(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_convolutional": op1_convolutional,
    "op2_deletion_neighbourhood": op2_deletion_neighbourhood,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_line_hashing": op4_line_hashing,
    "op5_prob_min_hash": op5_prob_min_hash,
    "op6_mpeg_transport": op6_mpeg_transport,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_fp_growth": op8_fp_growth,
    "op9_prefix_filter": op9_prefix_filter,
    "op10_gradient_boosting": op10_gradient_boosting,
}

LINES_SQL = """
WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents
), n AS (
    SELECT doc_id, i, trim(regexp_replace(lower(x), '\\s+', ' ', 'g')) AS t FROM l
), r AS (
    SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS k, length(t) AS c FROM n WHERE length(t) >= 20
), d AS (SELECT * FROM r WHERE k = 1),
p AS (
    SELECT b.doc_id, b.i, a.doc_id AS od, a.i AS oi, a.t AS ot, b.t AS bt FROM d a JOIN d b ON a.c = b.c AND left(a.t, a.c // 2) = left(b.t, b.c // 2) AND a.t <> b.t
    UNION ALL SELECT b.doc_id, b.i, a.doc_id, a.i, a.t, b.t FROM d a JOIN d b ON a.c = b.c AND right(a.t, a.c - a.c // 2) = right(b.t, b.c - b.c // 2) AND a.t <> b.t
    UNION ALL SELECT b.doc_id, b.i, a.doc_id, a.i, a.t, b.t FROM d a JOIN d b ON b.c = a.c + 1 AND left(a.t, a.c // 2) = left(b.t, (b.c - 1) // 2)
    UNION ALL SELECT b.doc_id, b.i, a.doc_id, a.i, a.t, b.t FROM d a JOIN d b ON b.c = a.c + 1 AND right(a.t, a.c - a.c // 2) = right(b.t, b.c - 1 - (b.c - 1) // 2)
), e AS (SELECT * FROM p WHERE levenshtein(ot, bt) <= 1),
near AS (
    SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i, od, oi FROM e UNION ALL SELECT od, oi, doc_id, i FROM e) WHERE (od, oi) < (doc_id, i)
), gone AS (SELECT doc_id, i, 1 AS x, 0 AS y FROM r WHERE k > 1 UNION ALL SELECT doc_id, i, 0, 1 FROM near),
g AS (SELECT doc_id, sum(x) AS n_exact, sum(y) AS n_near, string_agg(i::VARCHAR, ',' ORDER BY i) AS removed FROM gone GROUP BY doc_id)
SELECT doc_id, len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS n_lines, coalesce(n_exact, 0)::BIGINT AS n_exact, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(removed, '') AS removed
FROM documents LEFT JOIN g USING (doc_id)
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE_SQL = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, list_slice(w, s, least(s + 9, len(w))) AS w FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT len(w) AS n FROM bw),
dw AS (SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS w FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT doc_id, s, n, item FROM dw JOIN bw USING (w)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_PARSED = """
p AS (SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*(/[^?#]*)?', 1) AS path FROM p),
g AS (SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
"""

URLS_SQL = f"""
WITH {_PARSED},
v AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS given, row_number() OVER () AS id,
    list_filter(string_split(path, '/'), lambda x: x <> '') AS seg, list_filter(string_split(host, '.'), lambda x: x <> '') AS lab,
    CASE WHEN position('?' IN url) > 0 THEN string_split(string_split(substr(url, position('?' IN url) + 1), '#')[1], '?')[1] ELSE '' END AS query FROM g),
t AS (SELECT *, CASE WHEN host = '' THEN []::VARCHAR[] ELSE list_sort(list_distinct(list_concat(
    ['s:' || lower(string_split(url, '://')[1])], list_transform(lab, lambda x: 'h:' || x),
    list_transform(list_filter(flatten(list_transform(lab, lambda x: string_split(x, '-'))), lambda x: x <> ''), lambda x: 'w:' || x),
    list_transform(range(1, len(seg) + 1), lambda i: 'p' || (i - 1)::VARCHAR || ':' || regexp_replace(lower(seg[i]), '[0-9]+', '0', 'g')),
    ['depth:' || len(seg)::VARCHAR], list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: 'q:' || string_split(x, '=')[1]),
    CASE WHEN position('#' IN url) > 0 THEN ['f:'] ELSE []::VARCHAR[] END))) END AS toks FROM v),
lab AS (SELECT id, toks, given FROM t WHERE given IS NOT NULL AND len(toks) > 0),
nn AS (SELECT count(*) AS n FROM lab),
u AS (SELECT id, given, unnest(toks) AS tok FROM lab),
f1 AS (SELECT tok FROM u GROUP BY tok HAVING count(*) >= ceil(0.01 * (SELECT n FROM nn))),
uf AS (SELECT id, given, tok FROM u SEMI JOIN f1 USING (tok)),
combos AS (
    SELECT id, given, [tok] AS items FROM uf
    UNION ALL SELECT a.id, a.given, [a.tok, b.tok] FROM uf a JOIN uf b ON a.id = b.id AND a.tok < b.tok
    UNION ALL SELECT a.id, a.given, [a.tok, b.tok, c.tok] FROM uf a JOIN uf b ON a.id = b.id AND a.tok < b.tok JOIN uf c ON b.id = c.id AND b.tok < c.tok),
cnt AS (SELECT items, given, count(*) AS n FROM combos GROUP BY items, given),
tot AS (SELECT items, sum(n)::BIGINT AS total FROM cnt GROUP BY items),
rules AS (SELECT items, given AS verdict, n, tot.total AS total FROM cnt JOIN tot USING (items) WHERE n >= ceil(0.01 * (SELECT n FROM nn)) AND n >= 0.6 * total),
need AS (SELECT DISTINCT toks FROM t WHERE given IS NULL),
m AS (SELECT toks, verdict, n, total, items FROM need JOIN rules ON list_has_all(toks, items)),
best AS (SELECT toks, verdict AS mined, list_aggregate(items, 'string_agg', ' ') AS mined_by FROM m QUALIFY row_number() OVER (PARTITION BY toks ORDER BY n / total DESC, n DESC, len(items) DESC, verdict DESC, list_aggregate(items, 'string_agg', ' ') DESC) = 1)
SELECT page_id, host, path, rule, coalesce(given, mined, 'allow') AS verdict, CASE WHEN given IS NULL THEN coalesce(mined_by, '') ELSE '' END AS mined_by
FROM t LEFT JOIN best USING (toks)
"""

ORACLES: dict[str, str] = {"op8_fp_growth": URLS_SQL, "op9_prefix_filter": DECONTAMINATE_SQL, "op2_deletion_neighbourhood": LINES_SQL}
