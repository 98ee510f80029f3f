"""Reference graphs among text blocks: cycles, order, depth. Graphs are many and mostly small: one is judged in one task,
by loops without recursion. One of more than EDGES references is judged by joins of its edges instead."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import cut

#: References of a graph that a task holds at most: some hundreds of MB. It decides on the way, not on the result.
EDGES = 2_000_000


def _walk(refs: Mapping[str, Sequence[str]], roots: Sequence[str]) -> Iterator[tuple[str, str, str | None]]:
    """A depth-first walk as its steps: (enter, key, None), (again, key, target that is still open), (leave, key, None)."""
    seen: set[str] = set()
    open_: set[str] = set()
    for root in roots:
        if root in seen:
            continue
        way = [(root, iter(refs[root]))]
        seen.add(root)
        open_.add(root)
        yield "enter", root, None
        while way:
            key, left = way[-1]
            for target in left:
                if target in open_:
                    yield "again", key, target
                elif target in refs and target not in seen:
                    seen.add(target)
                    open_.add(target)
                    way.append((target, iter(refs[target])))
                    yield "enter", target, None
                    break
            else:
                way.pop()
                open_.discard(key)
                yield "leave", key, None


def find_cycle(refs: Mapping[str, Sequence[str]]) -> list[str] | None:
    """One cycle as a path whose last is its first, or None. References to what isn't there count for nothing."""
    trail: list[str] = []
    for step, key, target in _walk(refs, list(refs)):
        if step == "enter":
            trail.append(key)
        elif step == "leave":
            trail.pop()
        else:
            return [*trail[trail.index(target) :], target]
    return None


def ordered(refs: Mapping[str, Sequence[str]]) -> list[str]:
    """Keys such that what a key refers to comes before it; otherwise as given. Cycles are broken where they close."""
    return [key for step, key, _ in _walk(refs, list(refs)) if step == "leave"]


def parents(refs: Mapping[str, Sequence[str]]) -> dict[str, tuple[str | None, int]]:
    """The first key that refers to each key, and how many such steps lead to one that none refers to (or to where a cycle
    of such steps is entered)."""
    parent: dict[str, str | None] = dict.fromkeys(refs)
    for key, targets in refs.items():
        for t in targets:
            if t in parent and parent[t] is None and t != key:
                parent[t] = key
    depth: dict[str, int] = {}
    for key in refs:
        way, on = [key], {key}
        while (up := parent[way[-1]]) is not None and up not in depth and up not in on:
            way.append(up)
            on.add(up)
        if up is None or up in depth:
            n = -1 if up is None else depth[up]
            for i, k in enumerate(reversed(way)):
                depth[k] = n + 1 + i
        else:  # a cycle: each of it is as deep as the cycle is long, less one
            ring = way[way.index(up) :]
            for k in ring:
                depth[k] = len(ring) - 1
            for i, k in enumerate(reversed(way[: way.index(up)])):
                depth[k] = len(ring) + i
    return {k: (parent[k], depth[k]) for k in refs}


def components(refs: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """The least key of those that lead to a key and back, for each key: Kosaraju's two walks, forth by order of leaving and
    back against the references."""
    back: dict[str, list[str]] = {k: [] for k in refs}
    for key, targets in refs.items():
        for t in targets:
            if t in back:
                back[t].append(key)
    out: dict[str, str] = {}
    for root in reversed(ordered(refs)):
        if root in out:
            continue
        part, todo = [], [root]
        out[root] = root
        while todo:
            part.append(key := todo.pop())
            for t in back[key]:
                if t not in out:
                    out[t] = root
                    todo.append(t)
        least = min(part)
        for key in part:
            out[key] = least
    return out


def on_cycles(refs: Mapping[str, Sequence[str]]) -> set[str]:
    """The keys that lead back to themselves."""
    part = components(refs)
    n: dict[str, int] = {}
    for least in part.values():
        n[least] = n.get(least, 0) + 1
    return {k for k in refs if n[part[k]] > 1 or k in refs[k]}


def shortest_cycle(refs: Mapping[str, Sequence[str]]) -> list[str] | None:
    """The shortest way from the least key on a cycle back to it, by the least keys among equals; None without cycles."""
    if not (found := on_cycles(refs)):
        return None
    start = min(found)
    came: dict[str, str] = {}
    todo = deque([start])
    while todo:
        key = todo.popleft()
        for t in sorted(refs[key]):
            if t == start:
                way = [key]
                while way[-1] != start:
                    way.append(came[way[-1]])
                return [*reversed(way), start]
            if t in found and t not in came:
                came[t] = key
                todo.append(t)
    return None


def _by_key(pdf: pd.DataFrame) -> dict[str, list[str]]:
    refs: dict[str, list[str]] = {k: [] for k in sorted({*pdf.a})}
    for a, b in sorted(zip(pdf.a, pdf.b, strict=True)):
        refs[a].append(b)
    return refs


def cycles(edges: DataFrame) -> DataFrame:
    """g, cyclic, n_in_cycles, cycle of every graph of edges (g, a, b): a refers to b. References to what isn't there count
    for nothing. cycle is the shortest way from the least key on a cycle back to it; null without one, and for graphs of
    more than EDGES references, whose nodes on cycles are found by coloured."""
    ddl = "g long, cyclic boolean, n_in_cycles long, cycle array<string>"

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        refs = _by_key(pdf)
        return pd.DataFrame({"g": [pdf.g.iloc[0]], "cyclic": [bool(found := on_cycles(refs))], "n_in_cycles": [len(found)], "cycle": [shortest_cycle(refs)]})

    large = edges.groupBy("g").count().where(F.col("count") > EDGES).select("g")
    if large.isEmpty():
        return edges.groupBy("g").applyInPandas(judge, ddl)
    large = cut(large)
    small = edges.join(large, "g", "left_anti").groupBy("g").applyInPandas(judge, ddl)
    found = coloured(edges.join(large, "g", "left_semi")).groupBy("g").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return small.unionByName(large.join(found, "g", "left").select(F.col("g").cast("long").alias("g"), (n > 0).alias("cyclic"), n.alias("n_in_cycles"), F.lit(None).cast("array<string>").alias("cycle")))


def coloured(edges: DataFrame) -> DataFrame:
    """g, node of the nodes on cycles of edges (g, a, b), by joins alone, for graphs of any size.

    Nodes that nothing leads to, or that lead nowhere, go. Of the rest each takes the greatest name that leads to it, its
    colour; within a colour what leads back to the node that gave it is that node's component, and goes too. This is done
    again while references are left. Rounds grow with the longest way in a graph, and every round is a written table.
    """
    left, found = _trimmed(cut(edges.select("g", "a", "b").distinct())), None
    while not left.isEmpty():
        colour = cut(left.select("g", F.col("a").alias("node")).distinct().withColumn("c", F.col("node")))
        while True:
            came = left.join(colour.select("g", F.col("node").alias("a"), "c"), ["g", "a"]).groupBy("g", F.col("b").alias("node")).agg(F.max("c").alias("_c"))
            new = cut(colour.join(came, ["g", "node"], "left").select("g", "node", F.greatest("c", "_c").alias("c"), (F.col("_c") > F.col("c")).alias("changed")))
            colour = new.drop("changed")
            if new.where("changed").isEmpty():
                break
        ends = [colour.select("g", F.col("node").alias(e), F.col("c").alias(f"c{e}")) for e in ("a", "b")]
        own = cut(left.join(ends[0], ["g", "a"]).join(ends[1], ["g", "b"]).where("ca = cb").select("g", "a", "b", F.col("ca").alias("c")))
        part = front = cut(own.where("b = c").select("g", F.col("a").alias("node"), "c").distinct())
        while not front.isEmpty():
            back = own.join(front.select("g", F.col("node").alias("b"), "c"), ["g", "b", "c"]).select("g", F.col("a").alias("node"), "c").distinct()
            front = cut(back.join(part, ["g", "node", "c"], "left_anti"))
            part = cut(part.unionByName(front))
        found = part.select("g", "node") if found is None else found.unionByName(part.select("g", "node"))
        gone = part.select("g", "node").unionByName(colour.where("node = c").select("g", "node")).distinct()
        for end in ("a", "b"):
            left = left.join(gone.withColumnRenamed("node", end), ["g", end], "left_anti")
        left = _trimmed(cut(left))
    return found if found is not None else left.select("g", F.col("a").alias("node"))


def _trimmed(edges: DataFrame) -> DataFrame:
    n = edges.count()
    while True:
        edges = edges.join(edges.select("g", F.col("b").alias("a")).distinct(), ["g", "a"], "left_semi")
        edges = cut(edges.join(edges.select("g", F.col("a").alias("b")).distinct(), ["g", "b"], "left_semi"))
        if (left := edges.count()) == n:
            return edges
        n = left


def levels(edges: DataFrame) -> DataFrame:
    """g, key, depth of every node of graphs without cycles: the longest way from a key that none refers to."""

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        refs = _by_key(pdf)
        refs |= {b: [] for b in sorted({*pdf.b}) if b not in refs}
        depth = dict.fromkeys(refs, 0)
        for key in reversed(ordered(refs)):  # what refers to a key comes before it
            for r in refs[key]:
                depth[r] = max(depth[r], depth[key] + 1)
        return pd.DataFrame({"g": pdf.g.iloc[0], "key": list(depth), "depth": list(depth.values())})

    return edges.groupBy("g").applyInPandas(judge, "g long, key string, depth int")


def first_parents(edges: DataFrame) -> DataFrame:
    """g, key, parent, depth of every node that refers to something: see parents."""

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        found = parents(_by_key(pdf))
        return pd.DataFrame({"g": pdf.g.iloc[0], "key": list(found), "parent": [p for p, _ in found.values()], "depth": [d for _, d in found.values()]})

    return edges.groupBy("g").applyInPandas(judge, "g long, key string, parent string, depth int")
