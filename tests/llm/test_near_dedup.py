import random

import numpy as np

from .helpers import documents, empty
from kolot.llm import near_dedup as N


def sets(rows, size=5):
    out = {}
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        out[-1 if r["doc_id"] is None else r["doc_id"]] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    return out


def brute(rows):
    s = sets(rows)
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    back = lambda i: None if i == -1 else i  # noqa: E731  a null identifier counts as the smallest
    return {(back(i), len(s[i]), back(find(i)), find(i) == i) for i in s}


def mutated(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"w{rng.randrange(10**9)}"
    return " ".join(words)


def test_groups_equal_brute_force(spark):
    rng = random.Random(11)
    texts = ["one two", "One TWO", "one two three"]
    for length in (8, 30, 120):
        base = [f"b{rng.randrange(400)}" for _ in range(length)]
        texts += [mutated(rng, base, m) for m in (0, 0, 1, 1, 2, 3, 4, 5) for _ in range(4)]
    shared = "a passage that many documents share with each other and it goes on for a while here"
    texts += [shared + " " + mutated(rng, range(k), k) for k in range(1, 9) for _ in range(6)]
    docs = documents(spark, texts)
    got = N.near_groups(docs).collect()
    assert len(got) == docs.count()
    assert {tuple(r) for r in got} == brute(docs.collect())


def test_empty(spark):
    assert N.near_groups(empty(spark)).count() == 0


def test_min_max_estimates_without_bias():
    rng = np.random.default_rng(3)
    agree = []
    for _ in range(60):
        both, a, b = (rng.integers(0, 1 << 64, n, np.uint64) for n in (300, 50, 50))
        x, y = (N.min_max(np.concatenate([both, own])) for own in (a, b))
        agree.append((x == y).mean())
    assert abs(np.mean(agree) - 0.75) < 0.02
    assert np.std(agree) < 0.055


def test_components_of_a_path(spark):
    from kolot.llm.common import Workspace

    links = spark.range(200).selectExpr("id + 1 AS a", "id AS b")
    got = N.components(Workspace(spark, "test"), links, "path").collect()
    assert len(got) == 201 and {r["component"] for r in got} == {0}


def test_hot_keys_and_chunks(spark, monkeypatch):
    """With everything dealt out and chunks of 4, the groups are those of brute force, and a task's links are fewer than its components."""
    from kolot.llm import common

    monkeypatch.setattr(N, "HOT", 2)
    monkeypatch.setattr(N, "CHUNK", 4)
    rng = random.Random(4)
    base = [f"b{rng.randrange(400)}" for _ in range(60)]
    texts = [mutated(rng, base, m) for m in (0, 0, 1, 2, 3, 4) for _ in range(6)] + [" ".join(base)] * 9
    docs = documents(spark, texts)
    assert {tuple(r) for r in N.near_groups(docs).collect()} == brute(docs.collect())
    assert common.HOT == 5_000


def test_one_link_for_each_pair_of_components():
    rows, s = [], N.shingles(" ".join(f"w{k}" for k in range(50)))
    signature = N.min_max(s)
    for k in range(12):
        rows.append({"key": 1, "band": 0, "chunk": 0, "i": 0, "j": 0, "doc_id": k, "component": k % 3, "n_shingles": len(s), "keys": N.band_keys(signature), "sketch": (signature >> np.uint64(48)).astype(np.uint16).tobytes(), "set": s.tobytes()})
    import pandas as pd

    assert len(N._cross(75)(pd.DataFrame(rows))) == 2
