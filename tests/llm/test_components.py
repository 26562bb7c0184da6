"""Components and what further links make of them; how many steps that takes."""

import numpy as np
import pytest

pytest.importorskip("barlens.llm")
from barlens.llm import common, minhash  # noqa: E402


def closure(links):
    root = {x: x for pair in links for x in pair}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                moved = True
    return root


def test_steps_follow_what_is_left_to_join(spark, monkeypatch):
    steps, calls, put, follow = [], [], common.Store.put, common.components
    monkeypatch.setattr(common.Store, "put", lambda self, df: steps.append(df) or put(self, df))
    stars = spark.createDataFrame([(u, v) for v in (1, 100, 200) for u in range(v + 1, v + 20)], "u bigint, v bigint")
    got = {r.node: r.component for r in common.components(stars, "u", "v").collect()}
    assert got == {u: v for v in (1, 100, 200) for u in range(v, v + 20)}
    assert len(steps) == 1

    for module in (common, minhash):
        monkeypatch.setattr(module, "components", lambda *a: calls.append(a) or follow(*a))
    rows = [(2 * i + k, " ".join([f"w{i}x{j}" for j in range(60)] + ["more"] * k)) for i in range(40) for k in (0, 1)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: d - d % 2 for d, _ in rows}
    assert len(calls) == 1


def test_further_links_join_components(spark):
    rng = np.random.default_rng(5)
    first, more = ([(int(a), int(b)) for a, b in rng.integers(0, 400, (n, 2)) if a != b] for n in (150, 60))
    frame = lambda rows: spark.createDataFrame(rows, "u bigint, v bigint")
    roots = common.components(frame(first), "u", "v").localCheckpoint()
    assert sorted(map(tuple, roots.collect())) == sorted(closure(first).items())
    assert sorted(map(tuple, common.merged(roots, frame(more)).collect())) == sorted(closure(first + more).items())
    assert sorted(map(tuple, common.merged(roots, frame([])).collect())) == sorted(closure(first).items())
    none = common.components(frame([]), "u", "v")
    assert sorted(map(tuple, common.merged(none, frame(more)).collect())) == sorted(closure(more).items())
