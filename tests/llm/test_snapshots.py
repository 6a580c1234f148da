"""Snapshot difference, Merkle manifest and permutation index against plain Python."""

import math
import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossarium.llm import merkle, permutation_index, ranks, snapshot_diff
from glossarium.llm.queries import later_snapshot

DOCS = "doc_id long, text string, lang string, source string"
COLUMNS = ("text", "lang", "source")


def part(x):
    return b"" if x is None else sha256(str(x).encode()).digest()[:16]


def differences(earlier, later):
    """Rows are (key, text, lang, source)."""
    sign = lambda rows: Counter(rows)
    a, b = sign(earlier), sign(later)
    out = [(r[0], r[0], "same", "", r[1:]) for r in (a & b).elements()]
    a, b = a - b, b - a
    order = lambda r: tuple(part(x) for x in r[1:])
    left = ([], [])
    for key in {r[0] for r in [*a, *b]}:
        x, y = (sorted((r for r in side.elements() if r[0] == key), key=order) for side in (a, b))
        for r, s in zip(x, y):
            out.append((key, key, "update", ",".join(c for c, u, v in zip(COLUMNS, r[1:], s[1:]) if u != v), s[1:]))
        left[0].extend(x[len(y) :])
        left[1].extend(y[len(x) :])
    by = defaultdict(lambda: ([], []))
    for side in (0, 1):
        for r in left[side]:
            by[r[1]][side].append(r)
    for x, y in by.values():
        first = lambda r: (r[0] is not None, r[0] or 0, order(r))
        x.sort(key=first), y.sort(key=first)
        for k in range(max(len(x), len(y))):
            r, s = (z[k] if k < len(z) else None for z in (x, y))
            if r and s:
                out.append((s[0], r[0], "rekey", ",".join(c for c, u, v in zip(COLUMNS, r[1:], s[1:]) if u != v), s[1:]))
            else:
                out.append((r[0], r[0], "delete", "", (None, None, None)) if r else (s[0], None, "insert", "", s[1:]))
    return Counter(out)


@pytest.mark.parametrize("seed", range(3))
def test_difference(spark, monkeypatch, seed):
    """Keys and contents that stand in most rows, nulls everywhere, repeated rows; pieces of two copies."""
    monkeypatch.setattr(ranks, "COPIES", 2)
    r = random.Random(seed)
    row = lambda: (r.choice([None, 1, 1, 2, -3, *range(5, 40)]), r.choice([None, "", "x", "x", "x", "y", "z" * 3000, f"t{r.randrange(9)}"]), r.choice([None, "en", "~"]), r.choice([None, "s"]))
    earlier = [row() for _ in range(150)]
    later = [x for x in earlier if r.random() < 0.7] + [row() for _ in range(60)] + [(x[0] and -1 - x[0], *x[1:]) for x in earlier[:20]]
    table = lambda rows: spark.createDataFrame([(*x, 5) for x in rows], DOCS + ", op int").repartition(3)
    got = snapshot_diff.diff(table(earlier), table(later))
    assert got.columns == ["key", "old_key", "op", "changed", "text", "lang", "source"]
    assert Counter((x["key"], x["old_key"], x["op"], x["changed"], (x["text"], x["lang"], x["source"])) for x in got.collect()) == differences(earlier, later)


def test_difference_of_empty_tables_and_carried_columns(spark):
    one, none = spark.createDataFrame([(1, "a", "b", "c", 7)], DOCS + ", op int"), spark.createDataFrame([], DOCS + ", op int")
    ops = lambda a, b: [tuple(x) for x in snapshot_diff.diff(a, b, carry=["op", "text"]).collect()]
    assert ops(none, none) == [] and ops(none, one) == [(1, None, "insert", "", 7, "a")] and ops(one, none) == [(1, 1, "delete", "", None, None)]
    assert snapshot_diff.diff(one, one, carry=["op"]).columns == ["key", "old_key", "op", "changed", "_op"]


def test_copies_of_one_row_pair_by_number(spark):
    rows = spark.range(9000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("t").alias("text"), F.lit("l").alias("lang"), F.lit("s").alias("source"))
    got = snapshot_diff.diff(rows, rows.limit(8500).withColumn("source", F.lit("u"))).groupBy("op", "changed").count().collect()
    assert {tuple(x) for x in got} == {("update", "source", 8500), ("delete", "", 500)}


def test_ranks_in_groups_of_any_size(spark):
    df = spark.createDataFrame([("a", k) for k in range(500)] + [("b", 3), ("c", None), ("c", 1)], "g string, v int").repartition(7)
    got = {(x["g"], x["v"]): (x["rank"], x["size"]) for x in ranks.ranked(df, ["g"], ["v"], "t").collect()}
    assert got == {("a", k): (k, 500) for k in range(500)} | {("b", 3): (0, 1), ("c", None): (0, 2), ("c", 1): (1, 2)}


def test_later_snapshot_keeps_rows_without_a_key(spark):
    docs = spark.createDataFrame([(None, "a", "b", "c"), *((k, "t", "l", "s") for k in range(100))], DOCS)
    got = later_snapshot(docs).collect()
    assert (None, "a", "b", "c") in {tuple(x) for x in got} and any(x["doc_id"] < 0 for x in got if x["doc_id"] is not None)


def H(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def climb(nodes):
    """Root of the nodes, and each one's siblings."""
    up, groups = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(s, min(s + 16, len(nodes))) for s in range(0, len(nodes), 16)]
        for run in runs:
            for i in run:
                for k in groups[i]:
                    up[k].append(("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)))
        groups = [[k for i in run for k in groups[i]] for run in runs]
        nodes = [H(*(nodes[i] for i in run)) for run in runs]
    return nodes[0], up


@pytest.mark.parametrize("sizes", [(1,), (2, 1, 16), (17, 256, 257, 3), (4200, 1, 30), tuple([1] * 300)])
def test_manifest(spark, sizes):
    rows = [(f"s{g}" if g else None, k * 3 % 7919, f"{g}:{k}") for g, n in enumerate(sizes) for k in range(n)]
    df = spark.createDataFrame(rows, "source string, doc_id long, text string").withColumn("leaf", merkle.leaf(["doc_id", "text"]))
    got = merkle.manifest(df.repartition(5)).withColumn("again", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    known = lambda t: f"{len(t.encode())}:{t}"
    leaves = defaultdict(list)
    for s, d, t in sorted(rows, key=lambda x: (x[0] or "", x[1])):
        leaves[s].append((d, H(known(str(d)), known(t))))
    trees = {s: climb([h for _, h in x]) for s, x in leaves.items()}
    root, tops = climb([trees[s][0] for s in sorted(trees, key=lambda s: s or "")])
    proof = {(s, d): up + tops[k] for k, s in enumerate(sorted(trees, key=lambda s: s or "")) for (d, _), up in zip(leaves[s], trees[s][1])}
    assert len(got) == len(rows)
    for x in got:
        assert (x["subroot"], x["root"], x["again"]) == (trees[x["source"]][0], root, root)
        assert [(p["left"], p["right"]) for p in x["proof"]] == proof[x["source"], x["doc_id"]]


def test_manifest_of_awkward_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], "source string, doc_id long, leaf string")).collect() == []
    df = spark.createDataFrame([(None, None, None, 1), ("", 1, "é" * 70000, 2), ("", 1, "é" * 70000, 3), ("s", None, "", 4)], "source string, doc_id long, text string, n int")
    rows = merkle.manifest(df.withColumn("leaf", merkle.leaf(["doc_id", "source", "text"]))).withColumn("ok", merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).orderBy("n").collect()
    assert [x["leaf"] for x in rows] == [H("---"), *[H("1:10:140000:" + "é" * 70000)] * 2, H("-1:s0:")] and all(x["ok"] for x in rows) and len({x["root"] for x in rows}) == 1


VECTORS = "vec_id long, embedding array<float>, score int"


def brute(rows, k=20):
    good = list(dict.fromkeys((i, tuple(map(float, np.array(v, np.float32)))) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)))
    width = max((len(v) for _, v in good), default=0)
    x = np.array([[*v, *[0.0] * (width - len(v))] for _, v in good])
    out = {}
    for q, v in zip(good, x):
        if q[0] % 20 == 0:
            near = sorted((-float((y * v).sum()), i) for (i, _), y in zip(good, x) if i != q[0])[:k]
            out[q[0]] = [(i, -s) for s, i in near]
    return out


def found(spark, rows, k=20):
    df = spark.createDataFrame([(*r, 1) for r in rows], VECTORS).repartition(3)
    out = defaultdict(list)
    for x in permutation_index.search(permutation_index.build(df, k), df.filter("vec_id % 20 = 0"), k).orderBy("query_id", "rank").collect():
        out[x["query_id"]].append((x["vec_id"], x["score"]))
        assert x["rank"] == len(out[x["query_id"]])
    return out


def test_neighbours_of_few_vectors_are_exact(spark):
    """Fewer vectors than are reranked: copies of a vector, ties, and rows that take no part."""
    r = random.Random(3)
    rows = [(k, [r.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(5)]) for k in range(200)] + [(k, [1.0, 1.0, 0.0, -0.0, 0.0]) for k in range(200, 400)]
    rows += [(400, None), (401, []), (402, [0.0] * 5), (403, [math.nan, 1.0]), (404, [math.inf]), (405, [None, 1.0]), (None, [1.0]), (420, [3.0]), (0, rows[0][1])]
    want, got = brute(rows), found(spark, rows)
    assert set(got) == set(want)
    for q, pairs in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in pairs] and [s for _, s in got[q]] == pytest.approx([s for _, s in pairs], rel=1e-12)


def test_neighbours_of_hardly_any_vectors(spark):
    assert found(spark, []) == {} and found(spark, [(20, [1.0])]) == {}
    assert dict(found(spark, [(20, [1.0]), (3, [2.0]), (4, [1.0, 5.0])], 1)) == {20: [(3, 2.0)]}


@pytest.mark.parametrize("kind", ["even", "clusters", "lengths", "cluster of near copies"])
def test_recall(spark, monkeypatch, kind):
    """Less than a third of the vectors are reranked."""
    monkeypatch.setattr(permutation_index, "RERANKED", 15)
    g = np.random.default_rng(5)
    x = g.normal(size=(3000, 32))
    if kind == "clusters":
        x += 3 * g.normal(size=(30, 32))[g.integers(0, 30, 3000)]
    if kind == "cluster of near copies":
        x[:1200] = g.normal(size=32) + 0.01 * x[:1200]
    x *= g.uniform(0.5, 2, (3000, 1)) if kind == "lengths" else 1 / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(x)]
    want, got = brute(rows), found(spark, rows)
    hit = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert all(len(got[q]) == 20 for q in want) and hit / (20 * len(want)) >= 0.9


def test_footrule_is_what_nearness_takes_off(spark):
    g = np.random.default_rng(1)
    perms = np.array([g.permutation(20)[:8] for _ in range(50)])
    query = g.permutation(20)[:8]
    near = permutation_index.nearness(permutation_index.files(perms, 20), query)
    place = lambda p, x: list(p).index(x) if x in p else len(p)
    footrule = [sum(abs(place(query, x) - place(p, x)) for x in range(20)) for p in perms]
    assert footrule == (8 * 9 - 2 * near.astype(int)).tolist()
