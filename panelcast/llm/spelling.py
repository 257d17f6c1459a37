"""Spelling variants of a vocabulary, found by a bit-sliced position index.

General: the forecasting project keeps no texts, so a vocabulary is any table of words and counts. Two
words are near if exactly one letter inserted, deleted or replaced turns one into the other.

For every (position, letter) the index holds the set of words with that letter there, as bits of one
integer. A word is looked up in all words at once: letter by letter, four sets are carried on, of words
without an error so far and of words with one, whose positions are then shifted by -1, 0 or +1.

Words meet in shards. One edit leaves either the first half or the rest of the shorter word as it is, so
near words of m and of m or m + 1 letters share their first m // 2 letters or the last m - m // 2.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import arrow_rows, free_names, lower_ascii, pieces, saved

# The letters of a word, and its least length and count.
LETTERS = r"[A-Za-zÀ-ÿ]+"
MIN_LETTERS, MIN_COUNT = 5, 3

BLOCK_WORDS = 8192
TASK_ROWS = 50_000
OUT_ROWS = 4096
_FOUND = "word string, n_near long, near_word string, near_n long"


def count_words(
    documents: DataFrame, doc: str = "doc_id", text: str = "text", misprint: int | None = None,
    min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z lower-cased, with ``min_count`` or more occurrences.

    ``misprint`` plants errors for a known answer: in one of so many (document, run) pairs, chosen by the
    CRC-32 of ``<doc>:<run>``, the letter at that number modulo the run's length is left out. Null and empty
    texts have no words, a null ``doc`` counts as an empty one, other columns are not looked at. Repeated rows
    are texts of their own. Words are counted before they are shuffled, so a frequent one is one row per task.
    """
    texts = documents.select(F.col(f"`{doc}`").cast("string").alias("doc"), F.col(f"`{text}`").alias("text"))
    word = F.col("run")
    runs = texts.select("doc", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.withColumn("run", lower_ascii("run"))
    if misprint:
        crc = F.crc32(F.encode(F.concat(F.coalesce("doc", F.lit("")), F.lit(":"), "run"), "UTF-8"))
        at = F.pmod("crc", F.char_length("run")).cast("int")
        cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
        runs = runs.withColumn("crc", crc)
        word = F.when(F.col("crc") % misprint == 0, cut).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).where(F.char_length("word") >= min_letters).groupBy("word")
    return counted.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


class PositionIndex:
    """Bitsets over ``words``: bit i stands for the i-th word, so the lowest bit of a set is its first word."""

    def __init__(self, words: list[str]):
        self.words, self.every = words, (1 << len(words)) - 1
        self.at: dict[tuple[int, str], int] = defaultdict(int)
        self.of_length: dict[int, int] = defaultdict(int)
        for i, word in enumerate(words):
            bit = 1 << i
            self.of_length[len(word)] |= bit
            for place in enumerate(word):
                self.at[place] |= bit
        self._path, self._states = "", [(self.every, 0, 0, 0)]

    def _sets(self, word: str) -> list[tuple[int, int, int, int]]:
        """After each letter: words without an error, and with one letter replaced, more, or fewer.

        The states of letters shared with the word asked before are kept, so sorted words ask cheaply.
        """
        at, states = self.at, self._states
        shared = 0
        for a, b in zip(word, self._path):
            if a != b:
                break
            shared += 1
        del states[shared + 1 :]
        same, changed, more, fewer = states[-1]
        for i in range(shared, len(word)):
            letter = word[i]
            here = at.get((i, letter), 0)
            more = (more | same) & at.get((i + 1, letter), 0)
            fewer = (fewer & at.get((i - 1, letter), 0)) | same
            changed = (changed & here) | (same ^ (same & here))
            same &= here
            states.append((same, changed, more, fewer))
        self._path = word
        return states

    def near(self, word: str, spare: int | None = None) -> tuple[int, int, int]:
        """Words one edit away: of the same length, one letter longer, one letter shorter.

        Words that share the first ``spare`` letters are left out, if it is given.
        """
        states = self._sets(word)
        same, changed, more, fewer = states[-1]
        others = -1 if spare is None else ~states[spare][0]
        size = len(word)
        return (
            changed & self.of_length.get(size, 0) & others,
            (more | same) & self.of_length.get(size + 1, 0) & others,
            fewer & self.of_length.get(size - 1, 0) & others,
        )


def _halves(length) -> list:
    """The shards of a word: by first half and by last half, as the shorter and as the longer word of a pair."""
    out = []
    for band in (length, length - 1):
        half = F.floor(band / 2).cast("int")
        for side, part in (("<", F.substr("word", F.lit(1), half)), (">", F.substr("word", length - (band - half) + 1))):
            out.append(F.when(band > 0, F.concat(band.cast("string"), F.lit(side), part)))
    return out


def _look_up(batches):
    """Near words of every row among the indexed rows of its (shard, block); rows come sorted."""
    out: list[tuple] = []
    group, index, counts, band, first, waiting = None, None, [], 0, False, []

    def ask(word: str) -> None:
        same, longer, shorter = index.near(word, None if first else band // 2)
        # A band holds pairs of its own length, or of that and one more letter.
        found = same | longer if len(word) == band else shorter
        if found:
            best = (found & -found).bit_length() - 1
            out.append((word, found.bit_count(), index.words[best], counts[best]))

    def start() -> None:
        nonlocal index, counts
        order = sorted(waiting, key=lambda row: (-row[1], row[0]))
        index, counts = PositionIndex([w for w, _ in order]), [n for _, n in order]
        for word in sorted(w for w, _ in waiting):
            ask(word)
        waiting.clear()

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("shard", "block", "indexed", "word", "n")]
        for shard, block, indexed, word, n in zip(*columns):
            if (shard, block) != group:
                if len(waiting) > 1:
                    start()
                waiting.clear()
                group, index = (shard, block), None
                digits = shard.find("<")
                first = digits > 0
                band = int(shard[: digits if first else shard.find(">")])
            if indexed:
                waiting.append((word, n))
            else:
                if index is None and waiting:
                    start()
                if index is not None:
                    ask(word)
            if len(out) >= OUT_ROWS:
                yield arrow_rows(out, _FOUND)
                out.clear()
    if len(waiting) > 1:
        start()
    yield arrow_rows(out, _FOUND)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_word, near_n) of all words of (word, n) that have near words: how many, and the
    most frequent of them (ties: the smallest in code-point order). ``words`` are distinct and not null.

    A shard with more than ``BLOCK_WORDS`` words is dealt into blocks, each of which all its words ask, so a
    common beginning or end is spread over tasks. A pair is found in one shard only. One row per word and
    block is returned, however many near words there are.
    """
    total = words.count()
    keyed = words.select("word", "n", F.explode(F.array_compact(F.array(*_halves(F.char_length("word"))))).alias("shard"))
    large = keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK_WORDS)
    blocks = F.coalesce(F.ceil(F.col("size") / BLOCK_WORDS), F.lit(1)).cast("int")
    dealt = keyed.join(large, "shard", "left").withColumns({
        "own": F.pmod(F.xxhash64("word"), blocks).cast("int"), "block": F.explode(F.sequence(F.lit(0), blocks - 1)),
    })
    parts = pieces(4 * total, TASK_ROWS, least=32)
    placed = dealt.select("shard", "block", (F.col("own") == F.col("block")).alias("indexed"), "word", "n").repartition(
        parts, "shard", "block"
    ).sortWithinPartitions("shard", "block", F.desc("indexed"), "word")
    found = placed.mapInArrow(_look_up, _FOUND)
    best = F.min(F.struct((-F.col("near_n")).alias("lack"), "near_word"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.near_word").alias("near_word"), (-F.col("best.lack")).alias("near_n")
    )


def follow(links: DataFrame, rounds: int) -> DataFrame:
    """(word, root) of (word, form): the last word reached by following forms, in ``rounds`` doublings.

    After r rounds a root is 2^r steps away, or the end. Every round is written, so none is computed twice.
    """
    reached = links.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        reached = saved(
            reached.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots"
        )
    return reached


def group_spellings(words: DataFrame, word: str = "word", n: str = "n", times: int = 2) -> DataFrame:
    """Words with ``n_near`` (how many words are near), ``form``, ``form_n`` and ``root``.

    A word's form is its near word with the largest count (ties: the smallest in code-point order) if that is at
    least ``times`` (2 or more) times its own, else null; ``root`` is the word that following forms ends at, the
    word itself without a form. Counts at least double with every step, which bounds the steps. Counts of a repeated
    word are added, a null count is zero; null and empty words are left out, other columns too. An empty table gives
    no rows.
    """
    if times < 2:
        raise ValueError("times must be at least 2: following forms has to end")
    named = free_names(words, [], [word, n]).select(F.col(f"`{word}`").alias("word"), F.col(f"`{n}`").cast("long").alias("n"))
    known = saved(
        named.where(F.char_length("word") > 0).groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "words"
    )
    near = near_words(known)
    chosen = F.when((F.col("near_n") >= times * F.col("n")) & (F.col("near_n") > F.col("n")), F.col("near_word"))
    formed = saved(
        known.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), chosen.alias("form"),
            F.when(chosen.isNotNull(), F.col("near_n")).alias("form_n"),
        ), "forms",
    )
    links = formed.where(F.col("form").isNotNull()).select("word", "form")
    most = formed.agg(F.max("form_n")).first()[0] or 0
    roots = follow(links, most.bit_length().bit_length())
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
