"""Greedy assignment of controls without reuse.

The greedy order is (strength descending, target id, control id). Strata never compete for a row, so each is
assigned by itself. Small strata are read whole by one task each, with their distances in memory (``sides``
rows are exchanged, never pairs). Strata with more than ``PAIR_BUDGET`` pairs go in rounds on groups: rows of one side
with equal points are one group. Every group's best group of the other side is found block by block (a block holds
``BLOCK`` groups of each side, so no task sees a whole stratum), and groups that are each other's best are taken: if
neither has another as good, all their rows by rank, else their first rows. The greedy order takes just these. What is
left after ``ROUNDS`` rounds goes to one task for each stratum, which looks up a target's best control when it is its
turn: its memory is in proportion to the rows.
"""

from __future__ import annotations

from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.sources.scratch import ranked, scratch

PAIR_BUDGET, BLOCK, ROUNDS = 4_000_000, 2048, 16
_RESULT = "stratum string, target_rm_id long, control_rm_id long, match_strength double"


def _points(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 1)


def strengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """exp(-distance) of all rows of ``a`` to all of ``b``, dimension by dimension as the column expression adds them."""
    total = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        d = a[:, k, None] - b[None, :, k]
        total += d * d
    return np.exp(-np.sqrt(total))


def greedy(t_ids: np.ndarray, t_x: np.ndarray, c_ids: np.ndarray, c_x: np.ndarray, n: int, most: int | None) -> list[tuple[int, int, float]]:
    """Assignments of one stratum in greedy order, as (target id, control id, strength)."""
    t_order, c_order = np.argsort(t_ids, kind="stable"), np.argsort(c_ids, kind="stable")
    t_ids, t_x, c_ids, c_x = t_ids[t_order], t_x[t_order], c_ids[c_order], c_x[c_order]
    s = strengths(t_x, c_x)
    if most is not None and most < len(c_ids):
        near = np.argsort(-s, axis=1, kind="stable")[:, :most]
        rows, cols = np.repeat(np.arange(len(t_ids)), most), np.sort(near, axis=1).ravel()
    else:
        rows, cols = np.divmod(np.arange(s.size), len(c_ids))
    order = np.argsort(-s[rows, cols], kind="stable")  # ties stay in order of target, then control
    left, free, out = np.full(len(t_ids), n), np.ones(len(c_ids), bool), []
    wanted = min(n * len(t_ids), len(c_ids))
    step = max(1024, 4 * wanted)
    for begin in range(0, len(order), step):
        part = order[begin : begin + step]
        part = part[(left[rows[part]] > 0) & free[cols[part]]]
        for i, j in zip(rows[part].tolist(), cols[part].tolist(), strict=True):
            if left[i] and free[j]:
                left[i] -= 1
                free[j] = False
                out.append((int(t_ids[i]), int(c_ids[j]), float(s[i, j])))
        if len(out) == wanted:
            break
    return out


def _assign_small(targets: DataFrame, controls: DataFrame, n: int, most: int | None) -> DataFrame:
    def run(key: tuple, t: pa.Table, c: pa.Table) -> pa.Table:
        got = greedy(t["id"].to_numpy(), _points(t["x"], t.num_rows), c["id"].to_numpy(), _points(c["x"], c.num_rows), n, most) if t.num_rows and c.num_rows else []
        return _result(key[0].as_py(), got)

    return targets.groupBy("stratum").cogroup(controls.groupBy("stratum")).applyInArrow(run, _RESULT)


def _blocks(targets: DataFrame, controls: DataFrame):
    """Both sides, dealt in blocks of about ``BLOCK`` rows, each block beside every block of the other side."""
    sizes = targets.groupBy("stratum").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("tn")).join(controls.groupBy("stratum").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cn")), "stratum")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    t = targets.join(F.broadcast(sizes), "stratum").select("stratum", "id", "x", deal("tn").alias("tb"), F.explode(F.sequence(F.lit(0), F.col("cn") - 1)).alias("cb"))
    c = controls.join(F.broadcast(sizes), "stratum").select("stratum", "id", "x", F.explode(F.sequence(F.lit(0), F.col("tn") - 1)).alias("tb"), deal("cn").alias("cb"))
    keys = ["stratum", "tb", "cb"]
    return t.groupBy(*keys).cogroup(c.groupBy(*keys))


def _bests(targets: DataFrame, controls: DataFrame) -> DataFrame:
    """stratum, target_rm_id, control_rm_id, match_strength, alone of the rows that are the best of all for both their sides.

    ``alone``: neither has another that is as good. Ties go to the least id.
    """

    def run(key: tuple, t: pa.Table, c: pa.Table) -> pa.Table:
        side, own, other, s, ties = [], [], [], [], []
        if t.num_rows and c.num_rows:
            t, c = t.sort_by("id"), c.sort_by("id")
            a, b = t["id"].to_numpy(), c["id"].to_numpy()
            m = strengths(_points(t["x"], len(a)), _points(c["x"], len(b)))
            for which, ids, others, m_ in ((0, a, b, m), (1, b, a, m.T)):
                best = m_.argmax(1)
                top = m_[np.arange(len(ids)), best]
                side.append(np.full(len(ids), which, np.int32))
                own.append(ids)
                other.append(others[best])
                s.append(top)
                ties.append((m_ == top[:, None]).sum(1))
        cat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        got = cat(own, pa.int64())
        return pa.table({"stratum": pa.array([key[0].as_py()] * len(got), pa.string()), "side": cat(side, pa.int32()), "own": got, "other": cat(other, pa.int64()), "s": cat(s, pa.float64()), "ties": cat(ties, pa.int64())})

    found = _blocks(targets, controls).applyInArrow(run, "stratum string, side int, own long, other long, s double, ties long")
    best = found.groupBy("stratum", "side", "own", "s").agg(F.max(-F.col("other")).alias("o"), F.sum("ties").alias("ties"))
    best = best.groupBy("stratum", "side", "own").agg(F.max(F.struct("s", "o", "ties")).alias("b")).select("stratum", "side", "own", (-F.col("b.o")).alias("other"), F.col("b.s").alias("s"), (F.col("b.ties") == 1).alias("alone"))
    best = scratch(best, "best")
    t = best.where("side = 0").select("stratum", F.col("own").alias("target_rm_id"), F.col("other").alias("control_rm_id"), F.col("s").alias("match_strength"), F.col("alone").alias("t_alone"))
    c = best.where("side = 1").select("stratum", F.col("own").alias("control_rm_id"), F.col("other").alias("target_rm_id"), F.col("alone").alias("c_alone"))
    both = t.join(c, ["stratum", "target_rm_id", "control_rm_id"])
    return both.select("stratum", "target_rm_id", "control_rm_id", "match_strength", (F.col("t_alone") & F.col("c_alone")).alias("alone"))


def nearest(targets: DataFrame, controls: DataFrame, most: int) -> DataFrame:
    """Each target's ``most`` strongest pairs. ``targets`` and ``controls``: stratum, id, x."""
    targets, controls = (df.select("stratum", "id", "x").toDF("stratum", "id", "x") for df in (targets, controls))
    return _nearest(targets, controls, most)


def _nearest(targets: DataFrame, controls: DataFrame, most: int) -> DataFrame:
    """Each target's ``most`` strongest pairs, found block by block."""

    def run(key: tuple, t: pa.Table, c: pa.Table) -> pa.Table:
        rows, cols, s = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        a = b = np.zeros(0, np.int64)
        if t.num_rows and c.num_rows:
            c = c.sort_by("id")
            a, b = t["id"].to_numpy(), c["id"].to_numpy()
            m = strengths(_points(t["x"], len(a)), _points(c["x"], len(b)))
            k = min(most, len(b))
            cols = np.argsort(-m, axis=1, kind="stable")[:, :k].ravel()
            rows = np.repeat(np.arange(len(a)), k)
            s = m[rows, cols]
        return pa.table({"stratum": pa.array([key[0].as_py()] * len(rows), pa.string()), "target_rm_id": pa.array(a[rows], pa.int64()), "control_rm_id": pa.array(b[cols], pa.int64()), "match_strength": pa.array(s, pa.float64())})

    found = _blocks(targets, controls).applyInArrow(run, _RESULT)
    rank = F.row_number().over(Window.partitionBy("stratum", "target_rm_id").orderBy(F.desc("match_strength"), "control_rm_id"))
    return found.withColumn("_k", rank).where(F.col("_k") <= most).drop("_k")


def walk(pairs: tuple[np.ndarray, np.ndarray, np.ndarray], left: dict[int, int]) -> list[tuple[int, int, float]]:
    """Assignments out of the pairs (target id, control id, strength) of a stratum."""
    t, c, s = pairs
    out, used = [], set()
    for k in np.lexsort((c, t, -s)).tolist():
        i, j = int(t[k]), int(c[k])
        if left.get(i, 0) and j not in used:
            left[i] -= 1
            used.add(j)
            out.append((i, j, float(s[k])))
    return out


def greedy_by_turns(t_ids: np.ndarray, t_x: np.ndarray, left: np.ndarray, c_ids: np.ndarray, c_x: np.ndarray) -> list[tuple[int, int, float]]:
    """As ``greedy``, with ``left`` controls for each target, and without a table of all pairs."""
    t_order, c_order = np.argsort(t_ids, kind="stable"), np.argsort(c_ids, kind="stable")
    t_ids, t_x, left, c_ids, c_x = t_ids[t_order], t_x[t_order], left[t_order].copy(), c_ids[c_order], c_x[c_order]
    free, live, out = np.ones(len(c_ids), bool), np.arange(len(c_ids)), []

    def best(i: int) -> tuple[float, int, int]:
        nonlocal live
        if free[live].mean() < 0.5:
            live = live[free[live]]
        s = np.where(free[live], strengths(t_x[i : i + 1], c_x[live])[0], -1.0)
        j = int(s.argmax())
        return -float(s[j]), i, int(live[j])

    turns = [best(i) for i in range(len(t_ids))] if len(c_ids) else []
    heapify(turns)
    while turns and len(out) < len(c_ids):
        s, i, j = heappop(turns)
        if free[j]:
            free[j] = False
            left[i] -= 1
            out.append((int(t_ids[i]), int(c_ids[j]), -s))
        if left[i] and len(out) < len(c_ids):
            heappush(turns, best(i))
    return out


def _result(stratum: str, got: list[tuple[int, int, float]]) -> pa.Table:
    columns = list(zip(*got, strict=True)) or [(), (), ()]
    return pa.table({"stratum": pa.array([stratum] * len(got), pa.string()), "target_rm_id": pa.array(columns[0], pa.int64()), "control_rm_id": pa.array(columns[1], pa.int64()), "match_strength": pa.array(columns[2], pa.float64())})


def _taken_by_groups(targets: DataFrame, controls: DataFrame) -> DataFrame:
    """The next pairs of the greedy order that one look at all groups can tell. ``targets``: stratum, id, x, left."""
    t_groups, c_groups = (df.groupBy("stratum", "x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")) for df in (targets, controls))
    t_groups, c_groups = scratch(t_groups, "groups"), scratch(c_groups, "groups")
    pairs = _bests(t_groups.select("stratum", "id", "x"), c_groups.select("stratum", "id", "x"))
    size = lambda df, end: df.select("stratum", F.col("id").alias(end), F.col("n").alias(f"n_{end}"))
    pairs = scratch(pairs.join(size(t_groups, "target_rm_id"), ["stratum", "target_rm_id"]).join(size(c_groups, "control_rm_id"), ["stratum", "control_rm_id"]), "mutual")
    wide = F.col("alone") & ((F.col("n_target_rm_id") > 1) | (F.col("n_control_rm_id") > 1))
    names = ["stratum", "target_rm_id", "control_rm_id", "match_strength"]
    out = pairs.where(~wide).select(*names)
    large = pairs.where(wide)
    if not large.limit(1).count():
        return out
    # Of two such groups the k-th control goes to whom the k-th place is, targets in order, each with as many places as it lacks controls.
    def rows(df: DataFrame, groups: DataFrame, end: str) -> DataFrame:
        keys = large.select("stratum", F.col(end).alias("group"), F.col("target_rm_id").alias("pair"), "match_strength")
        return df.join(groups.select("stratum", "x", F.col("id").alias("group")), ["stratum", "x"]).join(keys, ["stratum", "group"])

    places = rows(targets, t_groups, "target_rm_id").select("stratum", "pair", "match_strength", F.col("id").alias("target_rm_id"), F.explode(F.sequence(F.lit(1), "left")).alias("turn"))
    ends = rows(controls, c_groups, "control_rm_id").select("stratum", "pair", F.col("id").alias("control_rm_id"))
    by = ["stratum", "pair"]
    placed = ranked(places, by, ["target_rm_id", "turn"], "k").join(ranked(ends, by, ["control_rm_id"], "k"), [*by, "k"])
    return out.unionByName(placed.select(*names))


def _assign_in_rounds(targets: DataFrame, controls: DataFrame, n: int, most: int | None, rounds: int) -> DataFrame:
    out: list[DataFrame] = []
    t, c = scratch(targets.withColumn("left", F.lit(n)), "targets"), scratch(controls, "controls")
    pairs = scratch(_nearest(t, c, most), "nearest") if most is not None else None
    for _ in range(rounds):
        if pairs is None:
            taken = scratch(_taken_by_groups(t, c), "taken")
        else:
            best_t = pairs.groupBy("stratum", "target_rm_id").agg(F.max(F.struct("match_strength", (-F.col("control_rm_id")).alias("o"))).alias("b")).select("stratum", "target_rm_id", (-F.col("b.o")).alias("control_rm_id"), F.col("b.match_strength").alias("match_strength"))
            best_c = pairs.groupBy("stratum", "control_rm_id").agg(F.max(F.struct("match_strength", (-F.col("target_rm_id")).alias("o"))).alias("b")).select("stratum", "control_rm_id", (-F.col("b.o")).alias("target_rm_id"))
            taken = scratch(best_t.join(best_c, ["stratum", "target_rm_id", "control_rm_id"]), "taken")
        out.append(taken)
        if not taken.limit(1).count():
            return reduce(DataFrame.unionByName, out)
        used = taken.select(F.col("control_rm_id").alias("id"))
        served = taken.groupBy(F.col("target_rm_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("got"))
        t = scratch(t.join(served, "id", "left").select("stratum", "id", "x", (F.col("left") - F.coalesce("got", F.lit(0))).alias("left")).where(F.col("left") > 0), "targets")
        c = scratch(c.join(used, "id", "left_anti"), "controls")
        if pairs is not None:
            pairs = scratch(pairs.join(t.select(F.col("id").alias("target_rm_id")), "target_rm_id", "left_semi").join(used.select(F.col("id").alias("control_rm_id")), "control_rm_id", "left_anti"), "pairs")

    def rest(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return _result(key[0].as_py(), [])
        ids, left = a["id"].to_numpy(), a["left"].to_numpy()
        if most is None:
            got = greedy_by_turns(ids, _points(a["x"], len(ids)), left, b["id"].to_numpy(), _points(b["x"], b.num_rows))
        else:
            got = walk((b["target_rm_id"].to_numpy(), b["control_rm_id"].to_numpy(), b["match_strength"].to_numpy()), dict(zip(ids.tolist(), left.tolist(), strict=True)))
        return _result(key[0].as_py(), got)

    other = c if pairs is None else pairs
    out.append(t.groupBy("stratum").cogroup(other.groupBy("stratum")).applyInArrow(rest, _RESULT))
    return reduce(DataFrame.unionByName, out)


def assign(targets: DataFrame, controls: DataFrame, counts: DataFrame, n: int = 1, most: int | None = None, budget: int = PAIR_BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """stratum, target_rm_id, control_rm_id, match_strength, match_rank of the greedy assignment.

    ``targets`` and ``controls``: stratum, id, x, of strata that have both. ``counts``: stratum, n_target, n_control.
    ``most`` keeps only each target's nearest controls; ``rounds`` bounds the rounds of large strata. Ranks count a target's controls from the strongest.
    """
    targets, controls = (df.toDF(*df.columns) for df in (targets, controls))  # sides of one table are told apart
    large = counts.where(F.col("n_target") * F.col("n_control").cast("double") > budget).select("stratum")
    giants = [r[0] for r in large.limit(1).collect()]
    if giants:
        keys = scratch(large, "giants")
        small = _assign_small(targets.join(keys, "stratum", "left_anti"), controls.join(keys, "stratum", "left_anti"), n, most)
        both = small.unionByName(_assign_in_rounds(targets.join(keys, "stratum", "left_semi"), controls.join(keys, "stratum", "left_semi"), n, most, rounds))
    else:
        both = _assign_small(targets, controls, n, most)
    rank = F.row_number().over(Window.partitionBy("target_rm_id").orderBy(F.desc("match_strength"), "control_rm_id"))
    return both.withColumn("match_rank", rank.cast("long"))
