"""Water-filling against a plain loop, and the sample against its targets."""

import pytest

from stratapack.llm import mixing


def brute_targets(sizes, cap=3.0):
    """Reshare the excess round by round. sizes: source -> words."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free = dict.fromkeys(sizes, 0.0), set(sizes)
    left = float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def frame(spark, counts, words=20):
    rows = [(i, " ".join(["w"] * (1 + (i * 7) % words)), s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


@pytest.mark.parametrize("counts", [{"a": 300, "b": 5, "c": 40, None: 30}, {"a": 10, "b": 2000, "c": 1}, {"x": 3}, {"é": 100, "z": 100, "Z": 100, "b": 1, "c": 2}])
def test_targets_and_sample(spark, counts):
    df, rows = frame(spark, counts)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = brute_targets(sizes)
    source = {i: s for i, _, s in rows}
    got = mixing.plan(spark, df).collect()
    assert len(got) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 10.5 for s in sizes)  # half the longest document
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.plan(spark, df).collect()))
    out = mixing.apply(spark, df)
    assert out.columns == df.columns
    assert sum(len(r["text"].split()) for r in out.collect()) == sum(r["taken"] for r in got)


def test_edges(spark):
    rows = [(1, None, "a", "x"), (2, "", None, "y"), (3, "one two", "a", "z"), (3, "one two", "a", "z"), (None, " x\x0by", "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = mixing.plan(spark, df).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == [(0, 2), (1, 0), (2, 0), (3, 2), (3, 2)]
    assert all(r["taken"] == 0 for r in got if not r["size"])
    assert mixing.plan(spark, df.limit(0)).count() == 0
    assert mixing.apply(spark, df).columns == df.columns


def test_apply_takes_what_plan_takes(spark):
    """Shared ids at a cut, texts of one id with different sizes, a null id, a clashing column."""
    rows = [(i % 7 or None, " ".join(["w"] * (1 + (i * 5) % 11 + j % 2)), s, f"{s}{i}{j}") for s, n in (("a", 90), ("b", 12), (None, 30)) for i in range(n) for j in range(2)]
    rows += [(1, None, "a", "n"), (8, " ", "b", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, cut string")
    want, got = {}, {}
    for seed in (1, 2, 3):
        for r in mixing.plan(spark, df, seed=seed).where("taken > 0").collect():
            k = (seed, r["doc_id"], r["size"], r["source_size"])
            want[k] = want.get(k, 0) + r["taken"]
        sizes = {s: sum(len((t or "").split()) for _, t, x, _ in rows if x == s) for s in ("a", "b", None)}
        for r in mixing.apply(spark, df, seed=seed).collect():
            n = len(r["text"].split())
            k = (seed, r["doc_id"], n, sizes[r["source"]])
            got[k] = got.get(k, 0) + n
    assert got == want
