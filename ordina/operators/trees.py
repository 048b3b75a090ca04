"""Fitted trees as literals that built-in functions walk.

The trees of all folds stand in one literal, an entry for each fold, so that one scan
serves the validation rows of every fold: a row picks its fold's entry. What is looked up
is bounded by the estimator, not by the rows; folds whose trees are larger than
`NODES_AT_ONCE` together are dealt to several scans.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from math import factorial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordina.functions.classes import validation_fold

NODES_AT_ONCE = 200_000
NUMBERS_AT_ONCE = 2_000_000

_NODE = "struct<s:int,o:int,t:double,c:array<double>,l:int,r:int,v:double>"
_USE = "struct<o:int,trees:array<int>>"
FOREST = f"struct<nodes:array<{_NODE}>,roots:array<int>,steps:array<int>,divisors:array<double>,uses:array<{_USE}>>"
_TEST = "struct<s:int,t:double,c:array<double>,g:boolean,k:int>"
_ENTRY = "struct<leaf:int,tab:array<double>>"
GAMES = f"struct<leaves:array<struct<full:int,tests:array<{_TEST}>>>,features:array<array<{_ENTRY}>>,bias:double>"


def kept_trees(m) -> list:
    """(tree, weight) up to the model's cut."""
    upto = m.upto or m.n_trees
    return list(zip(m.trees[:upto], m.weights[:upto]))


def used_slots(m) -> list[int]:
    """Vector slots that some kept tree tests, in order."""
    return sorted({int(f) for tree, _ in kept_trees(m) for f in tree.feature if f >= 0})


def in_groups(models: Sequence, size: Callable, limit: int) -> list[list]:
    """Models in groups whose sizes add up to `limit` at most, or of one model."""
    out, room = [], 0
    for m in models:
        n = size(m)
        if not out or n > room:
            out.append([])
            room = limit
        out[-1].append(m)
        room -= n
    return out


def node_groups(models: Sequence) -> list[list]:
    return in_groups(models, lambda m: sum(len(t.feature) for t, _ in kept_trees(m)), NODES_AT_ONCE)


def by_fold(models: Sequence, entry: Callable, schema: str) -> Column:
    """A literal with the entry of each fold at its place."""
    entries = {m.fold: entry(m) for m in models}
    listed = [entries.get(k) for k in range(max(entries) + 1)]
    return F.from_json(F.lit(json.dumps(listed)), f"array<{schema}>")


def forest_entry(m) -> dict:
    """Nodes of all kept trees; a leaf leads to itself and holds its weighted value."""
    at = {slot: i for i, slot in enumerate(used_slots(m))}
    owners, names = m.space.slot_owners, m.space.features
    nodes, roots, weights, uses, depth = [], [], [], {}, 0
    for number, (tree, weight) in enumerate(kept_trees(m)):
        first = len(nodes)
        roots.append(first)
        weights.append(weight)
        deep = {0: 0}
        for i, f in enumerate(tree.feature):
            if f < 0:
                nodes.append({"s": 0, "o": -1, "t": 0.0, "c": None, "l": first + i, "r": first + i, "v": float(tree.value[i]) * weight})
                continue
            codes, owner = tree.left_codes[i], names.index(owners[int(f)])
            uses.setdefault(owner, []).append(number)
            left, right = int(tree.left[i]), int(tree.right[i])
            deep[left] = deep[right] = deep[i] + 1
            depth = max(depth, deep[i] + 1)
            threshold = 0.0 if codes is not None else float(tree.threshold[i])
            listed = None if codes is None else sorted(codes)
            nodes.append({"s": at[int(f)], "o": owner, "t": threshold, "c": listed, "l": first + left, "r": first + right, "v": 0.0})
    divisors = np.cumsum(weights) if m.averages else np.ones(len(weights))
    return {
        "nodes": nodes,
        "roots": roots,
        "steps": list(range(depth)),
        "divisors": divisors.tolist(),
        "uses": [{"o": o, "trees": sorted(set(t))} for o, t in sorted(uses.items())],
    }


def validation_slots(models: Sequence, df: DataFrame, keep: Sequence[str], info_col: str) -> DataFrame:
    """`keep`, `fold` and `__x`, the slots that the fold's trees test, of the validation rows of `models`."""
    x = None
    for m in models:
        slots = m.space.slot_exprs
        listed = F.expr(f"array({', '.join(slots[i] for i in used_slots(m)) or '0D'})")
        hit = F.col("__fold") == m.fold
        x = F.when(hit, listed) if x is None else x.when(hit, listed)
    rows = df.withColumn("__fold", validation_fold(info_col)).where(F.col("__fold").isin([m.fold for m in models]))
    return rows.select(*[f"`{c}`" for c in keep], F.col("__fold").alias("fold"), x.alias("__x"))


def bound(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """`body` of the values, each computed once however often the body names it."""
    one = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.get(F.transform(F.array(one), body), F.lit(0))


def passes(node: Column, x: Column) -> Column:
    return F.when(node["c"].isNull(), x <= node["t"]).otherwise(F.array_contains(node["c"], x))


def leaf_value(forest: Column, root: Column, value_at: Callable[[Column], Column]) -> Column:
    """Value of the leaf where a walk from `root` ends; `value_at` gives a node's tested value."""

    def step(at: Column, _: Column) -> Column:
        node = F.get(forest["nodes"], at)
        return F.when(passes(node, value_at(node)), node["l"]).otherwise(node["r"])

    return F.get(forest["nodes"], F.aggregate(forest["steps"], root, step))["v"]


def leaf_values(forest: Column, x: Column) -> Column:
    """Weighted leaf values, one per tree."""
    return F.transform(forest["roots"], lambda root: leaf_value(forest, root, lambda node: F.get(x, node["s"])))


def summed(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


# --- Shapley values ----------------------------------------------------------


def leaf_paths(tree) -> list[tuple[float, list[tuple[int, float, list]]]]:
    """Per leaf its value and, for each slot on the way, cover ratio and tests."""
    out = []
    stack = [(0, {})]
    while stack:
        node, seen = stack.pop()
        f = int(tree.feature[node])
        if f < 0:
            used = [(s, ratio, tests) for s, (ratio, tests) in seen.items()]
            out.append((float(tree.value[node]), used))
            continue
        for child, goes_left in ((tree.left[node], True), (tree.right[node], False)):
            ratio, tests = seen.get(f, (1.0, []))
            test = (tree.left_codes[node], float(tree.threshold[node]), goes_left)
            share = float(tree.cover[child] / tree.cover[node])
            stack.append((int(child), {**seen, f: (ratio * share, [*tests, test])}))
    return out


def leaf_game(value: float, ratios: Sequence[float], agrees: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Shapley values of a leaf for its slots, where `agrees` says which tests hold.

    A leaf pays its value when every slot on its path agrees; a slot left out of a
    coalition agrees with the probability of its cover ratio. So a leaf is a product game
    over the few slots of its path. For one of them, the sum over coalitions of the others
    is read off the coefficients of a polynomial in the coalition size.
    """
    u, found = len(ratios), []
    for i in range(u):
        by_size = [np.ones(len(agrees[i]))]
        for j in range(u):
            if j != i:
                nothing = np.zeros(len(agrees[i]))
                padded, shifted = [*by_size, nothing], [nothing, *by_size]
                by_size = [ratios[j] * a + agrees[j] * b for a, b in zip(padded, shifted)]
        chance = sum(factorial(s) * factorial(u - 1 - s) / factorial(u) * c for s, c in enumerate(by_size))
        found.append(value * (agrees[i] - ratios[i]) * chance)
    return found


def game_numbers(m) -> int:
    """Numbers in the tables of `games_entry`."""
    return sum(len(used) << len(used) for tree, _ in kept_trees(m) for _, used in leaf_paths(tree))


def games_entry(m) -> dict:
    """Per leaf its tests, and per feature the tables of its Shapley values.

    A table is keyed by the bits of the leaf's slots that agree; a failed test clears its
    slot's bit. A leaf with u slots has u tables of 2 ** u numbers.
    """
    at = {slot: i for i, slot in enumerate(used_slots(m))}
    owners, names = m.space.slot_owners, m.space.features
    trees = kept_trees(m)
    scale = 1.0 / sum(w for _, w in trees) if m.averages else 1.0
    leaves, features, bias = [], [[] for _ in names], 0.0
    for tree, weight in trees:
        for value, used in leaf_paths(tree):
            value *= weight * scale
            bias += value * float(np.prod([r for _, r, _ in used]))
            full = (1 << len(used)) - 1
            tests = [
                {"s": at[slot], "t": 0.0 if codes is not None else t, "c": None if codes is None else sorted(codes), "g": left, "k": full & ~(1 << i)}
                for i, (slot, _, listed) in enumerate(used)
                for codes, t, left in listed
            ]
            bits = np.arange(full + 1)
            agrees = [(bits >> i & 1).astype(float) for i in range(len(used))]
            tables = leaf_game(value, [r for _, r, _ in used], agrees)
            for (slot, _, _), table in zip(used, tables):
                features[names.index(owners[slot])].append({"leaf": len(leaves), "tab": table.tolist()})
            leaves.append({"full": full, "tests": tests})
    return {"leaves": leaves, "features": features, "bias": bias}


def shapley(games: Column, x: Column) -> Column:
    """Contributions of all features, looked up by the tests that each leaf's slots pass."""

    def agreeing(leaf: Column) -> Column:
        def one(bits: Column, test: Column) -> Column:
            return F.when(passes(test, F.get(x, test["s"])) == test["g"], bits).otherwise(bits.bitwiseAND(test["k"]))

        return F.aggregate(leaf["tests"], leaf["full"], one)

    def of_feature(bits: Column) -> Callable[[Column], Column]:
        return lambda entries: F.aggregate(
            entries, F.lit(0.0), lambda acc, e: acc + F.get(e["tab"], F.get(bits, e["leaf"]))
        )

    patterns = F.transform(games["leaves"], agreeing)
    return bound({"bits": patterns}, lambda b: F.transform(games["features"], of_feature(b["bits"])))
