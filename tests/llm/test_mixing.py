import math
import random
import re

import pytest
from pyspark.sql import functions as F

from .helpers import documents, empty
from kolot.llm import mixing as M


def targets(sizes, most=3.0):
    """By the rule as it is stated: share by weight, cut at the bound, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        rest, weights = total - sum(full.values()), sum(weight[s] for s in open_)
        out = {s: rest * weight[s] / weights for s in open_}
        over = {s: most * sizes[s] for s in open_ if out[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return full | out
        full |= over


def test_targets_and_copies(spark):
    rng = random.Random(2)
    texts = [" ".join(["w"] * int(rng.paretovariate(1.2) * 20)) for _ in range(900)]
    docs = documents(spark, texts)
    got = M.mix_sources(docs).collect()
    assert len(got) == docs.count()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
    want, taken = targets(sizes), {}
    for r in got:
        assert (r["source_size"], round(r["target"], 6)) == (sizes[r["source"]], round(want[r["source"]], 6))
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert {r["doc_id"]: r["size"] for r in got} == {r["doc_id"]: size(r["text"]) for r in docs.collect()}
    for s in sizes:
        assert abs(taken[s] - want[s]) < 0.02 * want[s] + 30
    again = M.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_small_source_is_full(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "c", "y"), (3, " ".join("w" * 100), "z")], "doc_id long, text string, source string")
    got = {r["source"]: (r["target"], r["taken"]) for r in M.mix_sources(df).collect()}
    assert got["x"] == (6.0, 6) and got["y"] == (3.0, 3) and got["z"][0] == pytest.approx(94.0)


def test_pairwise_rounding_keeps_the_words(spark):
    """Small documents go through the tree; each source's error stays under its largest document there."""
    df = spark.range(30000).selectExpr("id AS doc_id", "array_join(array_repeat('w', cast(5 + id % 40 AS int)), ' ') AS text", "concat('s', id % 2) AS source")
    rows = M.mix_sources(df).groupBy("source").agg({"taken": "sum", "target": "first"}).collect()
    for r in rows:
        assert abs(r["sum(taken)"] - r["first(target)"]) <= 45


def pivotal(a, b, u):
    """(decided, left): as the method is defined. Units are [doc_id, size, base, p, v]."""
    up, down = min((1 - a[3]) * a[1], b[3] * b[1]), min(a[3] * a[1], (1 - b[3]) * b[1])
    d = up if u * (up + down) < down else -down
    two = [[*a[:3], a[3] + d / a[1], a[4]], [*b[:3], b[3] - d / b[1], b[4]]]
    done = [x for x in two if x[3] < M.EPS or x[3] > 1 - M.EPS]
    left = [x for x in two if x not in done]
    return [(x[0], x[2] + round(x[3])) for x in done], left[0] if left else None


def in_plain_python(spark, docs, most=3.0):
    """Copies of every document: large ones of a source in pairs from the largest on, the others by the tree."""
    wanted = [M.uniform(k, "doc_id").alias(f"u{k}") for k in range(8)]
    rows = {r["doc_id"]: r for r in docs.select("doc_id", "source", "text", F.xxhash64(F.lit(0), "doc_id").alias("hash"), *wanted).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for i, r in rows.items()}
    sizes, copies = {}, {}
    for i, r in rows.items():
        sizes[r["source"]] = sizes.get(r["source"], 0) + size[i]
    goal, pools, depth = targets(sizes), {}, 0
    for s, total in sizes.items():
        bar = max(min(total, goal[s]) / 256, total / 4096)
        own = [i for i in rows if rows[i]["source"] == s]
        target, pool, left = goal[s], total, None

        def settle():
            nonlocal target, left
            if left:
                c = left[2] + (left[4] < left[3])
                copies[left[0]], target, left = c, target + (left[2] + left[3] - c) * left[1], None

        for i in sorted((i for i in own if size[i] > bar), key=lambda i: (size[i], i), reverse=True):
            if left and left[1] > 2 * size[i]:
                settle()
            rate = min(most, max(0.0, target / pool))
            base = math.floor(rate + M.EPS)
            target, pool = target - rate * size[i], pool - size[i]
            unit = [i, size[i], base, rate - base, rows[i]["u2"]]
            if unit[3] < M.EPS:
                copies[i] = base
            elif left is None:
                left = unit
            else:
                done, left = pivotal(left, unit, rows[i]["u0"])
                copies.update(done)
        settle()
        rate = min(most, max(0.0, target / pool)) if pool else 0.0
        kinds = {}
        for i in own:
            if size[i] <= bar:
                kinds.setdefault(math.floor(math.log2(size[i] + 1) * 8), []).append(i)
        pools[s] = (rate, kinds)
        depth = max([depth, *(math.ceil(math.ceil(len(x) / M.FAN_IN) and math.log(math.ceil(len(x) / M.FAN_IN), M.FAN_IN) - M.EPS) for x in kinds.values())])

    def fold(units, u):
        left = None
        for x in sorted(units, key=lambda x: (x[1], x[0]), reverse=True):
            if left is None:
                left = x
            else:
                done, left = pivotal(left, x, rows[x[0]][f"u{u}"])
                copies.update(done)
        return left

    for rate, kinds in pools.values():
        base = math.floor(rate + M.EPS)
        p, rest = (rate - base if rate - base > M.EPS else 0.0), []
        for own in kinds.values():
            blocks, n = {}, math.ceil(len(own) / M.FAN_IN)
            for i in own:
                if p and size[i]:
                    blocks.setdefault(rows[i]["hash"] % n, []).append([i, size[i], base, p, rows[i]["u2"]])
                else:
                    copies[i] = base if size[i] else 0
            level = {b: left for b, units in blocks.items() if (left := fold(units, 1))}
            for k in range(depth):
                up = {}
                for b, x in level.items():
                    up.setdefault(b // M.FAN_IN, []).append(x)
                level = {b: left for b, units in up.items() if (left := fold(units, 3 + k))}
            rest += level.values()
        if left := fold(rest, 3 + depth):
            copies[left[0]] = left[2] + (left[4] < left[3])
    return copies


@pytest.mark.parametrize("fan_in", [256, 4])
def test_copies_equal_the_plain_method(spark, monkeypatch, fan_in):
    """Every row's copies, large and small documents alike, over a tree of one level and of several."""
    monkeypatch.setattr(M, "FAN_IN", fan_in)
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * (int(rng.paretovariate(1.0) * 6) % 3000 if i % 9 else 0)), rng.choice("aaaaabbc") if i % 11 else None) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["copies"] for r in M.mix_sources(docs).collect()}
    want = in_plain_python(spark, docs)
    assert len(got) == 1500 and got == want


def test_many_sources_are_ranked_and_shared(spark):
    """Ranges of sources, and levels that rise as sources get full, give what the rule says."""
    sizes = {(f"h{k:04d}" if k else None): (k * 37) % 101 + (5000 if k == 77 else 0) for k in range(400)}
    rows = [(k, s, n) for k, (s, n) in enumerate(sizes.items())]
    from kolot.llm.common import Workspace

    got = M.source_targets(spark.createDataFrame(rows, "doc_id long, source string, size long"), Workspace(spark, "test")).collect()
    want = targets(sizes)
    assert {r["source"]: r["source_size"] for r in got} == sizes
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]])


def test_empty(spark):
    assert M.mix_sources(empty(spark)).count() == 0


def test_join_by_salts(spark):
    from kolot.llm.common import joined_small

    rows, side = spark.range(100).selectExpr("id", "id % 3 AS key"), spark.range(2).selectExpr("id AS key", "id * 10 AS v")
    want = sorted(map(tuple, rows.join(side, "key").collect()))
    assert sorted(map(tuple, joined_small(rows, side, "key", "id").collect())) == want
    assert sorted(map(tuple, joined_small(rows, side, "key", "id", most=1).collect())) == want
