import random

import numpy as np
import xxhash

from llm_fixtures import docs  # noqa: F401
from panelcast.llm import simhash


def fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, radius):
    """Label of each value: the position of the first one it hangs together with."""
    up = list(range(len(values)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def flipped(rng, value, bits):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value


def crowd(seed, n=400):
    """Random fingerprints, chains of near ones and one dense group."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        out.append(flipped(rng, rng.choice(out), rng.randint(1, 7)))
    out += [flipped(rng, out[0], rng.randint(0, 5)) for _ in range(n)]
    return list(dict.fromkeys([0, 2**64 - 1, *out]))


def test_tree_finds_exactly_the_groups():
    for seed in range(5):
        values = crowd(seed)
        for radius in (0, 1, 4):
            tree = simhash.BkTree(radius)
            for v in values:
                tree.add(v)
            first = {v: v for v in values} | dict(tree.links())
            want = groups(values, radius)
            assert [first[v] for v in values] == [values[w] for w in want]


def test_dense_groups_do_not_cost_all_pairs(monkeypatch):
    rng = random.Random(1)
    values = list({flipped(rng, 12345, rng.randint(0, 3)) for _ in range(6000)})
    tree, looked = simhash.BkTree(4), 0

    class Counted(list):
        def __getitem__(self, i):
            nonlocal looked
            looked += 1
            return list.__getitem__(self, i)

    tree.values = Counted()
    for v in values:
        tree.add(v)
    assert looked < len(values) ** 2 / 20


def test_shards_hold_every_close_pair():
    rng = random.Random(3)
    for count in (100, 10**6, 10**9, 10**12):
        masks = simhash.shard_masks(count, 4)
        for _ in range(500):
            a = rng.getrandbits(64)
            b = flipped(rng, a, 4)
            assert any(a & m == b & m for m in masks)
    assert len(simhash.shard_masks(10**9, 4)) > len(simhash.shard_masks(100, 4))


def test_links_and_components(spark):
    values = crowd(9)
    signed = [simhash._signed(v) for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fingerprint long").repartition(5)
    label = {r["node"]: r["label"] for r in simhash.components(simhash.links(nodes, 4, shard_size=4)).collect()}
    want = groups(values, 4)
    ours = {}
    for v, w in zip(signed, want):
        ours.setdefault(w, set()).add(label.get(v, v))
    assert all(len(x) == 1 for x in ours.values()) and len({min(x) for x in ours.values()}) == len(ours)


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (9, 9)], "a long, b long")
    label = {r["node"]: r["label"] for r in simhash.components(edges).collect()}
    assert label == {i: 0 for i in range(301)} | {500: 500, 501: 500}


def texts():
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=200)) for _ in range(20)]
    rows = [(100 + i, b) for i, b in enumerate(base)]
    for i in range(60):
        w = rng.choice(base).split()
        w[rng.randrange(len(w))] = rng.choice(words).upper()
        rows.append((200 + i, " ".join(w)))
    rows += [(i, base[3]) for i in range(1000, 1100)]
    rows += [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "A  B\tC"), (None, "a b c"), (None, "all alone here now"), (6, "x y " * 30_000)]
    return rows + rows[:2]


def test_documents_by_brute_force(docs):
    rows = texts()
    prints = [fingerprint(t) for _, t in rows[:-2]]
    prints += prints[:2]
    member, first = groups(prints, 4), {}
    for (i, _), m in zip(rows, member):
        if i is not None:
            first[m] = min(i, first.get(m, i))
    want = sorted(((i, f"{p:016x}", first.get(m)) for (i, _), p, m in zip(rows, prints, member)), key=repr)
    got = sorted(map(tuple, simhash.near_duplicates(docs(rows)).collect()), key=repr)
    assert got == want
    kept = [r["doc_id"] for r in simhash.drop_near_duplicates(docs(rows)).collect()]
    assert sorted(kept, key=repr) == sorted((first.get(m) for m in set(member)), key=repr)


def test_no_rows(docs):
    empty = docs([(1, "a")]).where("false")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_long_and_short_texts_count_bits_alike():
    rng = np.random.default_rng(0)
    text = " ".join(map(str, rng.integers(0, 500, 4000)))
    assert simhash.fingerprint(text.encode()) == fingerprint(text)


def family(seed, n, base, loose, bits):
    """Values that share the bits outside ``loose`` and differ from ``base`` in some of the others."""
    rng, out = random.Random(seed), {base}
    while len(out) < n:
        value = base
        for b in rng.sample(loose, rng.randint(*bits)):
            value ^= 1 << b
        out.add(value)
    return sorted(out)


def smallest_of_groups(values, radius):
    """Label of each value by comparing all pairs, some rows at a time."""
    x = np.array(values, np.uint64)
    label = np.arange(len(x))
    near = [np.flatnonzero(np.bitwise_count(x ^ v) <= radius) for v in x]
    while True:
        low = np.array([label[own].min() for own in near])
        low = np.minimum(low, low[low])
        if (low == label).all():
            return {v: values[label[i]] for i, v in enumerate(values)}
        label = low


def test_crowded_shards_are_split(spark, monkeypatch):
    """A loose family, where shards split by further bits, and a tight one, whose shards are dealt into parts."""
    monkeypatch.setattr(simhash, "PART_NODES", 100)
    loose = family(1, 3000, 0x0123456789ABCDEF, list(range(0, 43)), (3, 9))
    tight = family(2, 1500, 0xFEDCBA9876543210, list(range(40, 64)), (1, 3))
    values = sorted({*loose, *tight})
    rows = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fingerprint long").repartition(5)
    shards = simhash.shards(rows, 4, shard_size=4)
    sizes = [r["count"] for r in shards.groupBy("shard").count().collect()]
    assert max(sizes) <= 3 * simhash.PART_NODES
    assert shards.where("shard.parts.other > 0").count() > 0 and shards.where("shard.second.mask >= 0").count() > 0
    label = {r["node"]: r["label"] for r in simhash.components(simhash.links(rows, 4, shard_size=4)).collect()}
    unsigned = lambda v: v & ((1 << 64) - 1)
    got = {}
    for node, own in label.items():
        got.setdefault(own, set()).add(unsigned(node))
    want = {}
    for v, own in smallest_of_groups(values, 4).items():
        want.setdefault(own, set()).add(v)
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in want.values() if len(g) > 1}
