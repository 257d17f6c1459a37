import collections
import math
import random
import re

import pytest

from llm_fixtures import docs  # noqa: F401
from panelcast.llm import mix

WEIGHTS = (3, 1, 2)


def targets(sizes, share=1.5, most=2.0):
    """Water filling by repeated sharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    goal, full = share * sum(sizes.values()), set()
    while True:
        left = goal - sum(most * sizes[s] for s in full)
        rest = sum(weight[s] for s in sizes if s not in full)
        out = {s: most * sizes[s] if s in full else left * weight[s] / rest for s in sizes}
        over = {s for s in sizes if s not in full and out[s] >= most * sizes[s]}
        if not over:
            return out
        full |= over


def rows_of(seed=1, n=600):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", "Ä", "zz", None]), i, rng.randint(0, 90)) for i in range(n)]
    rows += [("hot", 1000 + i, rng.randint(0, 40)) for i in range(n)]
    return rows + [("a", 5000, 40_000), ("empty", 1, 0), ("b", 7, None), ("b", 9, 33), ("b", 9, 33), ("b", None, 5)]


def make(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "x") for r in rows], "entity string, pos long, size long, slot string").repartition(parts)


@pytest.mark.parametrize("block", [16, 1024])
def test_mix_meets_its_targets(spark, block, monkeypatch):
    monkeypatch.setattr(mix, "SLOT_CHUNK", 64)
    monkeypatch.setattr(mix, "ROW_CHUNK", 100)
    rows = rows_of()
    mixed, wanted = mix.mix_entities(make(spark, rows), block=block)
    sizes = collections.Counter()
    for e, _, s in rows:
        sizes[e] += s or 0
    want = targets(dict(sizes))
    assert {r["entity"]: r["target"] for r in wanted.collect()} == pytest.approx(want)
    parts = mixed.collect()
    taken, by_row, slots = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for r in parts:
        assert 0 <= r["start"] < r["stop"] <= r["size"]
        taken[r["entity"]] += r["stop"] - r["start"]
        by_row[r["entity"], r["pos"], r["size"], r["copy"]] += r["stop"] - r["start"]
        slots[r["slot"]].append(r)
    assert all(abs(taken[e] - t) <= 0.5 for e, t in want.items())
    assert all(n <= 2 * size for (_, _, size, _), n in by_row.items())
    for own in slots.values():  # a slot is one whole block of one entity, its last one excepted
        assert len({r["entity"] for r in own}) == 1
        at = 0
        for r in sorted(own, key=lambda r: r["at"]):
            assert r["at"] == at
            at += r["stop"] - r["start"]
        assert at <= block
    # An entity is read whole before it is read again.
    for e, s in sizes.items():
        if want[e] >= s:
            once = sum(r["stop"] - r["start"] for r in parts if r["entity"] == e and r["pass_no"] == 0)
            assert once == s


def test_every_stretch_is_in_proportion(spark):
    rows = [(e, i, 10) for e in "abcd" for i in range(2000)]
    mixed, wanted = mix.mix_entities(make(spark, rows), block=50)
    total = sum(r["target"] for r in wanted.collect())
    share = {r["entity"]: r["target"] / total for r in wanted.collect()}
    serve = {r["slot"]: r["entity"] for r in mixed.select("slot", "entity").distinct().collect()}
    order = [serve[s] for s in sorted(serve)]
    for start in range(0, len(order) - 200, 100):
        seen = collections.Counter(order[start : start + 200])
        assert all(abs(seen[e] - 200 * p) <= 4 for e, p in share.items())


def test_reruns_and_partitions_agree(spark):
    rows = rows_of(2, 200)
    a, b = (mix.mix_entities(make(spark, rows, p), block=64)[0] for p in (1, 7))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    other = mix.mix_entities(make(spark, rows), block=64, seed=1)[0]
    assert sorted(map(str, other.collect())) != sorted(map(str, a.collect()))


def test_series_of_a_panel(spark):
    rows = [("sj", i, 1) for i in range(936)] + [("iq", i, 1) for i in range(520)]
    mixed, wanted = mix.mix_entities(make(spark, rows), weights=(1, 1), share=1.0, block=8)
    assert {r["entity"]: r["target"] for r in wanted.collect()} == {"sj": 728.0, "iq": 728.0}
    assert mixed.groupBy("entity").sum("stop").count() == 2


def test_no_rows(spark):
    mixed, wanted = mix.mix_entities(make(spark, [("a", 1, 1)]).where("false"))
    assert mixed.count() == 0 and wanted.count() == 0
    assert mix.mix_entities(make(spark, [("a", 1, 0), ("b", 1, None)]))[0].count() == 0


def test_texts(docs):
    rng = random.Random(6)
    rows = [(i, " \n".join(rng.choices(["Ab", "cé", "日", "x\ty"], k=rng.randint(0, 30))), rng.choice(["a", "b", None])) for i in range(300)]
    rows += [(900, None, "a"), (901, "", "b"), (902, " lead and trail \n", "b"), (903, "twice", "a"), (903, "twice", "a"), (None, "no id", "a")]
    df = docs(rows)
    out = mix.mix_texts(df, block=32).collect()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    sizes, taken = collections.Counter(), collections.Counter()
    source = {(r[0], r[1]): r for r in rows}
    for _, t, s in rows:
        sizes[s] += len(words(t))
    cut = 0
    for r in out:
        taken[r["source"]] += len(words(r["text"]))
        whole = (r["doc_id"], r["text"]) in source
        cut += not whole
        if not whole:
            assert any(i == r["doc_id"] and t.startswith(r["text"]) for i, t in source if t)
    want = targets(dict(sizes))
    assert all(abs(taken[s] - t) <= 0.5 for s, t in want.items()) and cut <= len(want)
    assert max(collections.Counter(r["doc_id"] for r in out).values()) <= 4
    assert math.isclose(sum(want.values()), 1.5 * sum(sizes.values()))
