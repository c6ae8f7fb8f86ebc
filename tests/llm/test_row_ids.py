"""Rows keep their numbers when Spark splits the files in another way, and scratch tables go."""

import os
import random

import pytest
from pyspark.sql import functions as F

from counterpoise.llm import common, decontaminate, lines, neardup

WORDS = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "u", "an", "er", "is")]
HOOK = {"drop_repeated_lines": (lines, "repeated_lines"), "drop_near_duplicates": (neardup, "classes"), "drop_contaminated": (decontaminate, "contamination")}


def text_of(i):
    r = random.Random(i)
    return " ".join(r.choice(WORDS) for _ in range(40))


@pytest.mark.parametrize("name", sorted(HOOK))
def test_rows_are_the_right_ones_when_splits_change(spark, tmp_path, monkeypatch, name):
    """Between the two readings the files are split among other tasks, as when executors come or go."""
    copied = "this very line stands in two of the documents here"
    rows = [(i, f"{text_of(i)}\n{copied}" if name == "drop_repeated_lines" and i in (3, 150) else text_of(3 if name == "drop_near_duplicates" and i == 150 else i)) for i in range(200)]
    item = " ".join(text_of(150).split()[5:17])
    for k in range(20):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d/part={k:02d}")
    docs = spark.read.parquet(f"{tmp_path}/d")
    module, inner = HOOK[name]
    plain = getattr(module, inner)

    def later(*args, **kwargs):
        out = plain(*args, **kwargs)
        spark.conf.set("spark.sql.files.minPartitionNum", "3")
        return out

    monkeypatch.setattr(module, inner, later)
    spark.conf.set("spark.sql.files.minPartitionNum", "40")
    try:
        args = (docs, spark.createDataFrame([(1, item)], "item_id long, text string")) if name == "drop_contaminated" else (docs,)
        got = {r.doc_id: r.text for r in getattr(module, name)(*args).collect()}
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    want = dict(rows)
    if name == "drop_repeated_lines":
        want[150] = text_of(150)
    else:
        del want[150]
    assert got == want


def test_passing_tables_go(spark):
    with common.passing_tables(spark):
        path = common.materialize(spark.range(5), "x")._stored_at
        assert os.path.isdir(path)
    assert not os.path.exists(path)


def test_only_local_sessions_may_lack_a_shared_folder(spark, monkeypatch):
    kept = spark.conf.get("spark.checkpoint.dir")

    class Far:
        class sparkContext:
            master = "spark://far:7077"

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Far)
    assert common.shared_dir(spark) == kept


def test_size_decides_a_broadcast(spark, monkeypatch):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 100).alias("x"))
    assert common.is_small(wide)
    monkeypatch.setattr(common, "BROADCAST_CHARS", 500)
    assert not common.is_small(wide)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 5)
    assert not common.is_small(spark.range(6))


def test_exchanged_windows_equal_those_in_place(spark):
    r = [text_of(i) for i in range(40)]
    item = " ".join(r[3].split()[2:15])
    docs = spark.createDataFrame([*enumerate(r), (100, None), (101, ""), (None, f"{item} {item}"), (102, "the " * 50 + item)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "the the the"), (3, ""), (4, item)], "item_id long, text string")
    rows = [sorted((str(x.id), x.n_words, x.n_hit, tuple(x.items)) for x in decontaminate.contamination(docs, bench, broadcast=b, run=20).collect()) for b in (True, False)]
    assert rows[0] == rows[1] and sum(n for _, _, n, _ in rows[0]) > 80
