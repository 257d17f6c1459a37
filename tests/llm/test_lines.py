import collections
import random

import numpy as np
import pytest

from llm_fixtures import docs  # noqa: F401
from panelcast.llm import lines, mph


def brute(rows, min_chars=20, min_docs=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    held = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(-(2**63) if i is None else i)
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        own = -(2**63) if i is None else i
        kept = [x for x in all_ if len(key(x)) < min_chars or len(held[key(x)]) < min_docs or max(held[key(x)]) == own]
        out.append((i, "\n".join(kept), len(all_), len(all_) - len(kept)))
    return sorted(out, key=repr)


def run(df, **kw):
    return sorted(map(tuple, lines.dedup_lines(df, **kw).select("doc_id", "kept_text", "n_lines", "n_dropped").collect()), key=repr)


def test_brute_force_with_a_hot_line(docs, monkeypatch):
    monkeypatch.setattr(lines, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(lines, "SHARD_BYTES", 5000)
    rng = random.Random(5)
    pool = [f"Line number {i} with É and more words" for i in range(60)] + ["short", "", "  padded LINE of text, twice  "]
    rows = [(i, "\n".join([*rng.choices(pool, k=rng.randint(0, 6)), "The line that everybody has in common."])) for i in range(300)]
    rows += [(0, rows[0][1]), (5, None), (6, ""), (None, pool[3]), (None, pool[3]), (900, (pool[1] + "\n") * 3000)]
    assert run(docs(rows)) == brute(rows)


def test_exactly_three_documents_and_code_points(docs):
    long, short = "é" * 20, "é" * 19
    rows = [(i, f"{long}\n{short}\n{long.upper()}") for i in (1, 2, 3)] + [(4, " \t" + "x" * 20 + "\x0b"), (5, "X" * 20), (5, "X" * 20)]
    assert run(docs(rows)) == brute(rows)


def test_empty_and_clashing(docs):
    df = docs([(1, "a")]).withColumnRenamed("source", "n_lines")
    assert lines.dedup_lines(df).first()["n_lines"] == 1
    assert lines.dedup_lines(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="clash"):
        lines.dedup_lines(df, kept="text")


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 30_000):
        high, low = rng.integers(0, 2**63, n, np.uint64), rng.integers(0, 2**63, n, np.uint64)
        high[: n // 3] = 7  # equal halves
        levels, bits = mph.build(high, low)
        assert sorted(mph.Lookup(levels, bits).number(high, low).tolist()) == list(range(n))
        assert len(bits) * 8 <= 6 * n + 200
    with pytest.raises(ValueError, match="distinct"):
        mph.build(np.array([1, 1], np.uint64), np.array([2, 2], np.uint64))


def test_index_counts_all_lines(docs):
    rows = [(i, f"a line in one document {i}\nand this line is in every document") for i in range(50)]
    df = docs(rows).selectExpr("cast(doc_id % 4 as int) as _bucket", "doc_id", "text")
    index = lines.line_index(lines.bucket_lines(df, 3, "doc_id", "text", 20), 3).collect()
    assert sum(r["lines"] for r in index) == 51
    assert sorted(np.concatenate([np.frombuffer(r["counts"], np.uint16) for r in index]))[-2:] == [1, 50]


def test_counts_decide_beyond_their_narrow_form(docs):
    rows = [(i, "this line is in every document") for i in range(40)]
    assert run(docs(rows), min_docs=40) == brute(rows, min_docs=40)
    assert run(docs(rows), min_docs=70_000) == brute(rows, min_docs=70_000)
