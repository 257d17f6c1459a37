import collections
import random
import re

from llm_fixtures import docs  # noqa: F401
from panelcast.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(x):
    x = x or ""
    w = WORD.findall(x)
    c = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    hit = {k for j in range(len(w) - 4) if c[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
    seen, dup = set(), 0
    for line in x.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(hit)]


def judge(rows, max_docs, left_share=0.3, min_words=10, texts=None):
    """The rules by plain loops; ``texts`` receives what is left of every text."""
    least = -(2**63)
    held = collections.defaultdict(lambda: (set(), []))
    key = lambda x: b" ".join(x.encode().split()).lower()
    for i, t, s in rows:
        for line in (t or "").split("\n"):
            if key(line):
                held[s, key(line)][0].add(t)
                held[s, key(line)][1].append(least if i is None else i)
    out = []
    for i, t, s in rows:
        m, gone, left = measures(t), 0, []
        for line in (t or "").split("\n"):
            who, ids = held[s, key(line)] if key(line) else ((), ())
            if len(who) > max_docs and (least if i is None else i) > min(ids):
                gone += len(key(line).split())
            else:
                left.append(line)
        if texts is not None:
            texts[i] = "\n".join(left)
        base = m[0] < 10 or 100 * m[4] > 20 * m[0]
        out.append((i, *m, base, not base and (gone == 0 or (m[0] - gone >= min_words and m[0] - gone >= left_share * m[0]))))
    return sorted(out, key=repr)


def run(df, **kw):
    return sorted(map(tuple, quality.judge_documents(df, **kw).select("doc", *quality.MEASURES, "base_failed", "kept").collect()), key=repr)


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    say = lambda k: " ".join(rng.choices(words, k=k))
    boiler = ["All rights reserved by the owner of this page", "Click here to accept our cookies and go on"]
    rows = []
    for i in range(n):
        kind = rng.random()
        lines = [say(8) for _ in range(rng.randint(1, 6))]
        if kind < 0.3:
            lines = [*boiler, say(3)]
        elif kind < 0.5:
            lines.append(boiler[0].upper())
        rows.append((i, "\n".join(lines), "host" if i % 3 else None))
    return rows


def test_line_frequency_by_brute_force(docs):
    rows = corpus() + [(1000 + i, "a copied text of more than ten words that many documents hold alike", "host") for i in range(200)]
    rows += [(None, None, "host"), (None, "", None), (7, rows[7][1], rows[7][2]), (2000, "x y z " * 5000, "host")]
    got = run(docs(rows), max_docs=20)
    assert got == judge(rows, 20)
    depleted = [r for r in got if not r[-1] and not r[-2]]
    assert len(depleted) > 50 and all(r[1] < 30 for r in depleted)
    assert all(r[-1] for r in got if r[0] is not None and 1000 <= r[0] < 1200)  # copies alone are no boilerplate


def test_measures_of_odd_texts(docs):
    rows = [(1, "a b c\x1fd \x0b e"), (2, "#|<> *$%&"), (3, "one two three four five " * 2), (4, "x\nx\n \nx"), (5, "É日 é")]
    for r in run(docs(rows)):
        assert list(r[1:6]) == measures(dict(rows)[r[0]])


def test_lines_above_the_limit_are_removed(docs):
    rows = corpus(120) + [(500, "\n\n w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11\n \nclick HERE to  accept our cookies and go on\n", "host")]
    df, left = docs(rows), {}
    want = {r[0] for r in judge(rows, 8, texts=left) if r[-1]}
    kept = quality.keep_good_documents(df, max_docs=8)
    got = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert kept.columns == df.columns and got == {i: left[i] for i in want}
    assert got[500] == "\n\n w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11\n \n"
    assert sum(got[i] != t for i, t, _ in rows if i in got) > 10
    assert quality.judge_documents(df.where("false")).count() == 0 == quality.keep_good_documents(df.where("false")).count()


def test_a_hot_host_does_not_loosen_the_limit(docs):
    words = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(600)]
    rows = [(i, w + ("\nshare this page with your friends" if i % 20 == 0 else ""), "host") for i, w in enumerate(words)]
    got = {r["doc_id"]: r["text"] for r in quality.keep_good_documents(docs(rows), max_docs=25).collect()}
    assert len(got) == 600 and [i for i, t in got.items() if "share" in t] == [0]


def test_clashing_columns_pass(docs):
    df = docs([(1, "one two three four five six seven eight nine ten", "h"), (None, None, None)]).selectExpr("*", "1 as kept", "2 as `a b`")
    assert [tuple(r) for r in quality.keep_good_documents(df).collect()] == [(1, "one two three four five six seven eight nine ten", "h", 1, 2)]
