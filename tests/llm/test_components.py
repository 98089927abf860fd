"""Components by hooking, and the stars that one group's comparison gives."""

from random import Random

import numpy as np
import pyarrow as pa
import pytest

from sitesift.llm import minhash
from sitesift.llm.components import connected


def smallest(edges):
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    return {(x, root(x)) for x in parent}


@pytest.mark.parametrize("kind", ["random", "chain", "loops"])
def test_connected_matches_union_find(spark, kind):
    rnd = Random(5)
    edges = {"random": [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)],
             "chain": list(zip(order := rnd.sample(range(64), 64), order[1:])),
             "loops": [(3, 3), (4, 5), (5, 4), (4, 5)]}[kind]
    got = connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == smallest(edges)


def test_a_group_gives_stars_of_its_smallest_class():
    near = [np.arange(k, k + 40, dtype=np.uint64).tobytes() for k in range(0, 20, 4)]     # each close to the next only
    table = pa.table({"cls": pa.array([b"c", b"a", b"e", b"b", b"d"], pa.binary()), "shingles": pa.array(near, pa.binary())})
    assert sorted(minhash.compare_group(table).to_pylist(), key=lambda r: r["b"]) == [{"a": b"a", "b": x} for x in (b"b", b"c", b"d", b"e")]
