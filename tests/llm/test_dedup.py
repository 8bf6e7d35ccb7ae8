import itertools

import brute
import numpy as np
import pytest
from stratalens.llm import _store, components, neardup, passages
from stratalens.llm._text import mix


def pairs(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)


def test_near_duplicates(docs):
    rows = brute.rows()
    want = brute.components([(r[0], r[1]) for r in rows], 4, 80)
    out = neardup.near_duplicates(docs, 4, 80).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    by_id = {r[0]: r[1] for r in rows}
    assert all(r.n_shingles == len(brute.shingles(by_id[r.doc_id], 4)) for r in out if r.doc_id is not None)


def test_near_duplicates_of_nothing(none):
    assert neardup.near_duplicates(none).collect() == []


@pytest.mark.parametrize("turns", [False, True])
def test_threshold_chain_of_copies(spark, monkeypatch, turns):
    """Copies with few edits each, around the threshold: links that no common leader shows."""
    if turns:  # other leaders take turns, and keys count as frequent
        monkeypatch.setattr(neardup, "LEAST_PAIRS", 0)
        monkeypatch.setattr(neardup, "CROWDED", 0)
        monkeypatch.setattr(neardup, "MOST_TURNS", 2)
    rng = np.random.default_rng(4)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        for p in rng.choice(120, int(rng.integers(0, 7)), replace=False):
            own[p] = f"e{i}_{p}"
        rows.append((i * 3, " ".join(own)))
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80)
    assert {r.doc_id: r.component_id for r in out.collect()} == brute.components(rows, 4, 80)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a = mix(rng.integers(0, 2**60, 3000).astype(np.uint64))
    b = np.concatenate([a[:2400], mix(rng.integers(0, 2**60, 600).astype(np.uint64))])
    at = lambda x: np.array([0, len(x)])
    ra, rb = neardup.registers(a, at(a)), neardup.registers(b, at(b))
    both = np.union1d(a, b)
    assert (neardup.merge(ra, rb) == neardup.registers(both, at(both))).all()
    true = 2400 / 3600
    _, estimate = neardup.plausible(ra, rb, np.array([3000]), np.array([3000]), 0.5)
    assert abs(estimate[0] - true) < 0.15
    assert neardup.plausible(ra, ra, np.array([3000]), np.array([3000]), 0.8)[0][0]


def test_common_counts_names_by_both_parts():
    x = np.array([1, 1, 5, 9], np.uint64), np.array([7, 8, 0, 3], np.uint32)
    y = np.array([1, 1, 5, 10], np.uint64), np.array([6, 8, 0, 3], np.uint32)
    cut = lambda z, part: (z[0][part], z[1][part])
    assert neardup.common(x, y) == 2 and neardup.common(cut(x, slice(2, None)), y) == 1 and neardup.common(cut(x, slice(0)), y) == 0


@pytest.mark.parametrize("split", [1000, 3])
def test_components(spark, monkeypatch, split):
    """With 3, most nodes count as hubs."""
    monkeypatch.setattr(_store, "SPLIT", split)
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 340)] + [(1000, x) for x in range(1001, 1060)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want: dict = {}
    for a, b in itertools.chain(links):
        want.setdefault(a, {a}), want.setdefault(b, {b})
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if want[a] is not want[b]:
                union = want[a] | want[b]
                for x in union:
                    want[x] = union
                changed = True
    assert got == {x: min(c) for x, c in want.items() if len(c) > 1}


@pytest.mark.parametrize("window", [50, 12, 3])
def test_passages(docs, window):
    rows = [(r[0], r[1]) for r in brute.rows()]
    out = passages.remove_repeated_passages(docs, window)
    assert pairs(out, "doc_id", "n_words", "n_removed", "kept_text") == sorted(brute.passages(rows, window), key=repr)


def test_passages_of_nothing(none):
    assert passages.remove_repeated_passages(none).collect() == []


def test_covers_have_every_difference():
    for period, cover in passages.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("least", [16, 2])
def test_random_passages(spark, monkeypatch, least):
    """With 2, passages count as frequent and take the other way."""
    monkeypatch.setattr(passages, "AT_LEAST", least)
    rng = np.random.default_rng(9)
    pool = [f"v{i}" for i in range(400)]
    shared = [[pool[i] for i in rng.integers(0, 400, n)] for n in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(int(rng.integers(1, 4))):
            parts += [pool[x] for x in rng.integers(0, 400, int(rng.integers(0, 60)))] + shared[int(rng.integers(0, 5))]
        rows.append((int(rng.integers(0, 10**6)) * 100 + i, "\n".join(parts)))
    out = passages.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert pairs(out, "doc_id", "n_words", "n_removed", "kept_text") == sorted(brute.passages(rows, 50), key=repr)
