import random
import re
import zlib
from collections import Counter

import pytest

from llm_fixtures import docs  # noqa: F401
from panelcast.llm import spelling


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, times=2):
    out = {}
    for word, n in counts.items():
        near = [(-m, other) for other, m in counts.items() if is_near(word, other)]
        best = min(near, default=None)
        form = best[1] if best and -best[0] >= times * n else None
        out[word] = (form, n, len(near), counts[form] if form else None)

    def root(word):
        while out[word][0]:
            word = out[word][0]
        return word

    return {word: (form, root(word), n, near, top) for word, (form, n, near, top) in out.items()}


def grouped(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def vocabulary(spark, counts):
    rows = [(w, n, "x") for w, n in counts.items()]
    return spark.createDataFrame(rows, "word string, n long, root string").repartition(3)


@pytest.mark.parametrize("block", [8192, 16])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    rng = random.Random(1)
    counts = {"".join(rng.choices("abéz", k=rng.randint(1, 9))): rng.randint(1, 60) for _ in range(700)}
    counts |= {"waterfall"[:i] + c + "waterfall"[i + 1 :]: 3 + i for i in range(9) for c in "xyz"} | {"waterfall": 40}
    assert grouped(spelling.group_spellings(vocabulary(spark, counts))) == brute(counts)


def test_one_beginning_holds_most_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 100)
    rng = random.Random(2)
    counts = {"abcdef" + "".join(rng.choices("pqrs", k=6)): rng.randint(1, 500) for _ in range(1500)}
    assert grouped(spelling.group_spellings(vocabulary(spark, counts))) == brute(counts)


@pytest.mark.parametrize("size", [1, 63, 200])
def test_index_against_loops(size):
    rng = random.Random(size)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(1, 8))) for _ in range(size)})
    rng.shuffle(words)
    index = spelling.PositionIndex(words)
    for word in sorted(words) + ["", "abababab", "zz"]:
        same, longer, shorter = index.near(word)
        found = {w for i, w in enumerate(words) if (same | longer | shorter) >> i & 1}
        assert found == {w for w in words if is_near(w, word)}
        assert not same & longer and not longer & shorter


def test_long_chain_of_forms(spark):
    chain = ["x" * i for i in range(1, 41)]
    counts = {w: 2**i for i, w in enumerate(chain)}
    got = grouped(spelling.group_spellings(vocabulary(spark, counts)))
    assert got == brute(counts) and got["x"][1] == chain[-1]


def test_ties_nulls_repeats_and_empty_tables(spark):
    words = spark.createDataFrame(
        [("casaa", 2), ("casab", 9), ("casac", 9), (None, 5), ("", 5), ("alone", None), ("casaa", 1), ("éasaa", 1)],
        "word string, n long",
    )
    got = grouped(spelling.group_spellings(words))
    assert got == brute({"casaa": 3, "casab": 9, "casac": 9, "alone": 0, "éasaa": 1}) and got["casaa"][0] == "casab"
    assert spelling.group_spellings(words.where("false")).count() == 0
    with pytest.raises(ValueError):
        spelling.group_spellings(words, times=1)


def counted(rows, misprint, letters=5, least=3):
    out = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if misprint and h % misprint == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= letters and n >= least}


def test_words_of_documents(spark, docs):  # noqa: F811
    rng = random.Random(4)
    vocabulary = ["Größe", "Straße", "ÉCOLE", "école", "house", "Housed", "x", "señor", "naïve", "ab1cdefgh", "ĀBCDEFG"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=80))) for i in range(60)]
    rows += [(None, "Straße, straße-Straße"), (70, None), (71, ""), (72, "word" * 5000), (73, "A" * 20000)] * 3
    for misprint in (None, 5):
        got = {r["word"]: r["n"] for r in spelling.count_words(docs(rows), misprint=misprint).collect()}
        assert got == counted(rows, misprint)
    empty = spelling.count_words(docs(rows).where("false"))
    assert empty.count() == 0
