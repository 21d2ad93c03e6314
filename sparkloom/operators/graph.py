"""Paths, cycles and state machines over tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sparkloom.operators.ordered import with_blocks
from sparkloom.operators.skew import dimension_join
from sparkloom.runtime import cut_lineage, scratch_path


def all_paths(edges: DataFrame, src: str, dst: str, max_hops: int) -> DataFrame:
    """Every simple path from ``src`` to ``dst`` of at most ``max_hops`` edges: (hops, path).

    A first sweep backwards finds how far each vertex is from the goal, so that
    only paths that can still arrive are grown.
    """
    e = cut_lineage(edges.select("src", "dst").distinct())
    far = e.select(F.col("dst").alias("v")).filter(F.col("v") == dst).distinct().withColumn("left", F.lit(0))
    known = front = cut_lineage(far)
    for step in range(1, max_hops):
        front = dimension_join(e, front.select(F.col("v").alias("dst")), "dst").select(F.col("src").alias("v")).distinct() \
            .join(known.select("v"), "v", "left_anti").withColumn("left", F.lit(step))
        front = cut_lineage(front)
        if front.isEmpty():
            break
        known = cut_lineage(known.unionByName(front))
    # Edges that lead towards the goal, each with the hops still needed behind it.
    useful = cut_lineage(dimension_join(e, known.withColumnRenamed("v", "dst"), "dst").select("src", "dst", "left"))
    paths = e.limit(1).select(F.lit(0).alias("hops"), F.array(F.lit(src)).alias("path"))
    found = None
    for hop in range(1, max_hops + 1):
        grown = paths.withColumn("src", F.element_at("path", -1)).join(useful, "src") \
            .filter(~F.array_contains("path", F.col("dst")) & (F.col("left") + hop <= max_hops))
        paths = cut_lineage(grown.select(F.lit(hop).alias("hops"), F.concat("path", F.array("dst")).alias("path")))
        done = paths.filter(F.element_at("path", -1) == dst)
        found = done if found is None else found.unionByName(done)
        paths = paths.filter(F.element_at("path", -1) != dst)
        if paths.isEmpty():
            break
    return found


def _stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again. Unlike a checkpoint the table brings no known equalities of columns along, of which
    chains of self-joins collect more than the optimizer can go through."""
    path = scratch_path(df.sparkSession, "graph")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _degrees(e: DataFrame) -> DataFrame:
    """(v, outs, ins) of every vertex."""
    ends = F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return e.select(F.inline(ends)).groupBy("v").agg(F.sum("o").alias("outs"), F.sum("i").alias("ins"))


def _rake(e: DataFrame) -> DataFrame:
    """Edges without those at vertices that nobody enters or nobody leaves: they close no cycle."""
    inner = _degrees(e).filter("outs > 0 and ins > 0").select("v")
    return _stored(e.join(inner.withColumnRenamed("v", "src"), "src", "left_semi").join(inner.withColumnRenamed("v", "dst"), "dst", "left_semi")
                       .select("src", "dst"))


def _doubled(chain: DataFrame) -> DataFrame:
    """Every open pointer twice as far: (v, p, s, m). ``p`` lies as many steps before ``v`` as the smallest vertex ``m`` has seen; once it has left
    the chain, ``s`` names the chain's first vertex."""
    far = chain.select(F.col("v").alias("p"), F.col("p").alias("p2"), F.col("s").alias("s2"), F.col("m").alias("m2"))
    moved = chain.filter("s is null").join(far, "p").select("v", F.col("p2").alias("p"), F.col("s2").alias("s"), F.least("m", "m2").alias("m"))
    return moved.unionByName(chain.filter("s is not null"))


def _compress(e: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Paths through vertices with one way in and one way out become one edge each.

    Returns the shorter edge list, the chains (v, s, src, dst: their vertices, first vertex, and the edge they became), and the cycles that are
    nothing but such vertices (vertex, component). Pointers double, so a path of n vertices takes log n steps.
    """
    single = _degrees(e).filter("outs = 1 and ins = 1").select("v")
    inside = _stored(e.join(single.withColumnRenamed("v", "dst"), "dst").select(F.col("dst").alias("v"), F.col("src").alias("p")))
    n = inside.count()
    if not n:
        return None
    names = inside.select(F.col("v").alias("p"), F.lit(True).alias("in_chain"))
    chain = inside.join(names, "p", "left").select("v", "p", F.when(F.col("in_chain").isNull(), F.col("v")).alias("s"), F.col("v").alias("m"))
    chain = _stored(chain)
    for _ in range(n.bit_length()):  # 2^steps > n: what is open then runs in a circle
        chain = _stored(_doubled(chain))
        if chain.filter("s is null").isEmpty():
            break
    rings = _stored(chain.filter("s is null").select(F.col("v").alias("vertex"), F.col("m").alias("component")))
    chain = chain.filter("s is not null")
    member = inside.select(F.col("v").alias("x"))
    leaving = e.join(member, F.col("dst") == F.col("x"), "left_anti").join(chain.select(F.col("v").alias("src"), "s"), "src").select("s", "dst")
    made = _stored(chain.select("v", "s", F.col("p").alias("src")).join(leaving, "s").select("v", "s", "src", "dst"))
    kept = e.join(member, F.col("dst") == F.col("x"), "left_anti").join(member, F.col("src") == F.col("x"), "left_anti")
    return _stored(kept.unionByName(made.select("src", "dst")).distinct()), made, rings


def _smallest_before(e: DataFrame) -> DataFrame:
    """(v, c): the smallest vertex from which ``v`` can be reached, itself included.

    A name that reaches a vertex brings the name that reaches it along, so names travel ever longer ways.
    """
    color = _stored(e.select(F.col("src").alias("v")).union(e.select("dst")).distinct().withColumn("c", F.col("v")))
    while True:
        sent = e.join(color.withColumnRenamed("v", "src"), "src").groupBy(F.col("dst").alias("v")).agg(F.min("c").alias("m"))
        near = color.join(sent, "v", "left").select("v", "c", F.least("c", F.coalesce("m", "c")).alias("m"))
        before = color.select(F.col("v").alias("m"), F.col("c").alias("far"))
        new = _stored(near.join(before, "m").select("v", F.least("m", "far").alias("c"), (F.least("m", "far") < F.col("c")).alias("moved")))
        color = new.drop("moved")
        if new.filter("moved").isEmpty():
            return color


def _cycles(edges: DataFrame, any_one: bool = False) -> DataFrame:
    """(vertex, component) of the vertices on a cycle, with a member of their component as its name; with ``any_one`` some cycle is enough.

    Tips are raked off and paths compressed while that shortens the list. Then each vertex learns the smallest vertex that reaches it,
    and among those with one name, who reaches its owner: all vertices are pivots at once. The components found are taken out.
    """
    e = _stored(edges.select("src", "dst").distinct())
    found, levels, n = [], [], e.count()
    none = e.select(F.col("src").alias("vertex"), F.col("dst").alias("component")).limit(0)
    while n:
        start = n
        e = _rake(e)
        shorter = _compress(e)
        if shorter is not None:
            e, chains, rings = shorter
            levels.append(chains)
            found.append(rings)
            if any_one and not rings.isEmpty():
                return rings
        n = e.count()
        if not n or n < 0.7 * start:
            continue
        color = _smallest_before(e)
        same = _stored(e.join(color.withColumnsRenamed({"v": "src", "c": "c1"}), "src").join(color.withColumnsRenamed({"v": "dst", "c": "c2"}), "dst")
                           .filter("c1 = c2").select("src", "dst", F.col("c1").alias("c")))
        back = _smallest_before(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        # Who reaches the name's owner is in its component; the owner itself may be alone there, and has no edge inside then.
        owned = _stored(color.join(back.withColumnRenamed("c", "b"), "v", "left").filter("b = c or v = c").select("v", "c"))
        inner = same.join(owned.withColumnRenamed("v", "src"), ["src", "c"], "left_semi").join(owned.withColumnRenamed("v", "dst"), ["dst", "c"], "left_semi")
        members = _stored(inner.select(F.col("src").alias("vertex"), F.col("c").alias("component")).distinct())
        found.append(members)
        if any_one and not members.isEmpty():
            return members
        # Edges between names close no cycle, and every name loses its owner.
        done = owned.select(F.col("v").alias("src"))
        e = _stored(same.join(done, "src", "left_anti").join(done.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst"))
        n = e.count()
    out = none
    for part in found:
        out = out.unionByName(part)
    for chains in reversed(levels):
        out = _stored(out)
        at_src = out.withColumnsRenamed({"vertex": "src", "component": "c1"})
        at_dst = out.withColumnsRenamed({"vertex": "dst", "component": "c2"})
        closed = chains.join(at_src, "src").join(at_dst, "dst").filter("c1 = c2").select(F.col("v").alias("vertex"), F.col("c1").alias("component"))
        out = out.unionByName(closed)
    return out


def has_cycle(edges: DataFrame) -> DataFrame:
    """One row: does the directed graph hold a cycle?"""
    return _cycles(edges, any_one=True).agg((F.count(F.lit(1)) > 0).alias("has_cycle"))


def find_cycles(edges: DataFrame) -> DataFrame:
    """Vertices on a directed cycle, with the smallest vertex of their strongly connected component."""
    found = _stored(_cycles(edges))
    smallest = found.groupBy("component").agg(F.min("vertex").alias("first"))
    return dimension_join(found, smallest, "component").select("vertex", F.col("first").alias("component"))


START = "[START]"


MAX_CELLS = 4_000_000  # of a table of states by inputs, and of the maps that a task holds at once


def detect_sequence(df: DataFrame, by: list[str], order_by: list[str], col: str, transitions: DataFrame, start: str = START,
                    block_rows: int = 250_000, max_transitions: int = 100_000) -> DataFrame:
    """Run a state machine over every key's ordered inputs, one output row per input row.

    ``transitions`` holds (state, input, next). A row that matches moves the
    state and belongs to the sequence (``matched``); ``overlap`` marks a move
    that stays in the state. Long keys are cut into blocks: what a block does to
    every possible state is found first, the block summaries give each block its
    first state, and then all blocks run at once.
    """
    rows = transitions.select("state", "input", "next").distinct().limit(max_transitions + 1).collect()
    if len(rows) > max_transitions:
        raise ValueError("a state machine is a plan-sized table")
    states = sorted({start, *[r["state"] for r in rows], *[r["next"] for r in rows]})
    inputs = {x: i for i, x in enumerate(dict.fromkeys(r["input"] for r in rows))}
    place = {s: i for i, s in enumerate(states)}
    if (len(inputs) + 1) * len(states) > MAX_CELLS:
        raise ValueError("a state machine is a plan-sized table")
    at_once = max(1, MAX_CELLS // len(states))
    # One map of states for each input; an input without a move keeps the state (last row).
    table = np.tile(np.arange(len(states)), (len(inputs) + 1, 1))
    known = np.zeros(table.shape, dtype=bool)
    for r in rows:
        table[inputs[r["input"]], place[r["state"]]] = place[r["next"]]
        known[inputs[r["input"]], place[r["state"]]] = True

    def codes(values: pd.Series) -> np.ndarray:
        return np.fromiter((inputs.get(x, len(inputs)) for x in values), dtype=np.int64, count=len(values))

    blocks = with_blocks(df.select(*by, *order_by, col), order_by, by, 0, block_rows)
    fields = {f.name: f.dataType.simpleString() for f in df.select(*by, *order_by, col).schema.fields}
    keys = ", ".join(f"`{k}` {fields[k]}" for k in by)

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        code, done = codes(pdf.sort_values("__rn")[col]), np.arange(len(states))[None, :]
        for at in range(0, len(code), at_once):
            maps = np.concatenate([done, table[code[at:at + at_once]]])
            while len(maps) > 1:  # compose neighbours until one map is left
                even = len(maps) // 2 * 2
                maps = np.concatenate([np.take_along_axis(maps[1:even:2], maps[0:even:2], axis=1), maps[even:]])
            done = maps
        ends = [states[i] for i in done[0]]
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in by}, "__block": [pdf["__block"].iloc[0]], "__ends": [ends]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__block")
        now, first = start, []
        for ends in pdf["__ends"]:
            first.append(now)
            now = ends[states.index(now)]
        return pdf.assign(__first=first)[[*by, "__block", "__first"]]

    long_keys = cut_lineage(blocks.groupBy(*by).agg(F.max("__block").alias("__b")).filter("__b > 0").select(*by))
    if long_keys.isEmpty():
        ready = blocks.withColumn("__first", F.lit(start))
    else:
        wide = dimension_join(blocks, long_keys, by).groupBy(*by, "__block") \
            .applyInPandas(summary, f"{keys}, __block bigint, __ends array<string>")
        firsts = wide.groupBy(*by).applyInPandas(chain, f"{keys}, __block bigint, __first string")
        ready = dimension_join(blocks, firsts, [*by, "__block"], "left", derived=True) \
            .withColumn("__first", F.coalesce("__first", F.lit(start)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by key and block; only the last key and state are held between batches.
        now, state = None, 0
        for pdf in (whole.iloc[at:at + at_once] for whole in batches for at in range(0, len(whole), at_once)):
            keys = pdf[[*by, "__block"]]
            new = (keys != keys.shift()).any(axis=1).to_numpy()
            new[0] = tuple(keys.iloc[0]) != now
            before = np.where(new, np.array([place[x] for x in pdf["__first"]]), state)
            code = codes(pdf[col])
            maps = table[code]
            fixed = new.copy()
            fixed[0] = True  # what comes before a fixed row does not matter to it
            maps[fixed] = np.take_along_axis(maps[fixed], before[fixed][:, None], axis=1)
            step = 1
            while step < len(maps):  # each row's map becomes that of all rows up to it
                maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
                step *= 2
            after = maps[:, 0]
            before[~fixed] = np.concatenate([[0], after[:-1]])[~fixed]
            matched = known[code, before]
            marks = pd.DataFrame({"state": [states[i] for i in after], "matched": matched, "overlap": matched & (after == before)}, index=pdf.index)
            now, state = tuple(keys.iloc[-1]), int(after[-1])
            yield pd.concat([pdf[[*by, *order_by, col]], marks], axis=1)

    schema = ", ".join(f"`{k}` {t}" for k, t in fields.items())
    placed = ready.repartition(*by, "__block").sortWithinPartitions(*by, "__block", "__rn")
    return placed.mapInPandas(run, f"{schema}, state string, matched boolean, overlap boolean")


def sequence_summary(detected: DataFrame, by: list[str], order_by: list[str]) -> DataFrame:
    """Per key: length of the sequence, final state, and whether it is an overlapping one."""
    return detected.groupBy(*by).agg(F.count_if("matched").alias("length"), F.max_by("state", F.struct(*order_by)).alias("state"),
                                     F.max("overlap").alias("overlapping"))
