"""Cycles of any length, against plain reachability."""

import random

import pytest

from strataleaf.operators import graph as G


def reach(links):
    nxt = {}
    for a, b in links:
        nxt.setdefault(a, set()).add(b)
    out = {}
    for a in nxt:
        todo, seen = list(nxt[a]), set(nxt[a])
        while todo:
            for y in nxt.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        out[a] = seen
    return out


RING = [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)]
BETWEEN = [("r3", "m"), ("m", "s0"), ("s0", "s1"), ("s1", "s0"), ("x", "x"), ("y", "r0"), ("s1", "z")]  # m: between cycles, on none
RANDOM = [(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for r in [random.Random(5)] for _ in range(34)]


@pytest.mark.parametrize("links", [RING + BETWEEN, RANDOM, [("a", "b"), ("b", "c")]])
def test_on_cycles(spark, links):
    got = {r.node for r in G.on_cycles(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {a for a, to in reach(links).items() if a in to}


def test_closing(spark):
    links = RING[:-1] + BETWEEN
    edges = [("e1", "r8", "r0"), ("e2", "r0", "r8"), ("e3", "s0", "s0"), ("e4", "x", "x"), ("e5", "z", "y"), ("e6", None, "y"), ("e7", "z", "z"), ("e8", "z", "r0")]
    to = reach(links)
    got = {r.i for r in G.closing(spark.createDataFrame(links, "a string, b string"), spark.createDataFrame(edges, "i string, s string, t string")).collect()}
    assert got == {i for i, s, t in edges if s in to.get(t, ())} >= {"e1", "e5"}
