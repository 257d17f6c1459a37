import base64
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_fixtures import docs  # noqa: F401
from panelcast.llm import bpe
from panelcast.llm.queries import vocabulary

tiktoken = pytest.importorskip("tiktoken")
PATH, PATTERN = vocabulary()


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_merges(PATH), PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


TEXTS = st.text(st.sampled_from("ab ' stred  \n\té日😀THE.,!?0123\x00\x1f "), max_size=80)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_encodes_like_the_library(encoder, library, text):
    assert ids(encoder.encode(text)) == library.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(TEXTS, TEXTS)
def test_append_is_exact(encoder, library, text, suffix):
    assert ids(encoder.append(text, encoder.encode(text), suffix)) == library.encode_ordinary(text + suffix)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200), st.integers(0, 200), st.integers(0, 200), st.binary(max_size=9))
def test_edit_equals_a_fresh_table(encoder, piece, a, b, new):
    start, stop = sorted((min(a, len(piece)), min(b, len(piece))))
    table = bpe.PrefixTable(encoder.merges, piece)
    table.replace(start, stop, new)
    fresh = bpe.PrefixTable(encoder.merges, piece[:start] + new + piece[stop:])
    assert table.last == fresh.last and table.piece == fresh.piece


def test_edit_touches_only_what_is_near(encoder):
    piece = bytes(random.Random(1).choices(b"abcdefgh", k=5000))
    table = bpe.PrefixTable(encoder.merges, piece)
    assert table.replace(100, 103, b"xyz") < 200
    assert table.last == bpe.PrefixTable(encoder.merges, table.piece).last


def test_every_prefix_is_encoded(encoder):
    table = bpe.PrefixTable(encoder.merges, b"internationalisation")
    for end in range(len(table.piece) + 1):
        assert table.ids(end) == bpe.PrefixTable(encoder.merges, table.piece[:end]).ids()


def test_round_trip_and_edge_cases(docs, library):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (4, "x" * 50_000), (4, "x" * 50_000), (None, "é\n\n 12"), (6, "<|endoftext|>")]
    df = docs(rows).withColumnRenamed("source", "ids")  # a clashing column is replaced
    out = bpe.decode_ids(bpe.encode_text(df, PATH, PATTERN), PATH).collect()
    assert len(out) == len(rows)
    for r in out:
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
        assert ids(r["ids"]) == library.encode_ordinary(r["text"] or "")


def test_append_text_column(docs, library):
    df = bpe.encode_text(docs([(1, "it", "'s fine"), (2, None, "abc"), (3, "abc", None)]), PATH, PATTERN)
    for r in bpe.append_text(df, PATH, PATTERN, suffix="source").collect():
        assert ids(r["appended_ids"]) == library.encode_ordinary((r["text"] or "") + (r["source"] or ""))


def test_empty_table_and_clash(docs):
    empty = docs([(1, "a")]).where("doc_id < 0")
    assert bpe.decode_ids(bpe.encode_text(empty, PATH, PATTERN), PATH).count() == 0
    with pytest.raises(ValueError, match="clash"):
        bpe.encode_text(empty, PATH, PATTERN, ids="text")
