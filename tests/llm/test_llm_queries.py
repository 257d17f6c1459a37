"""Registered text queries against their SQL or against loops, and the pipeline stage by stage."""

import collections
import hashlib
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_points
import corpus_pipeline
from oracle import compare, connect
from panelcast.llm import common, simhash
from panelcast.llm.queries import CHECKS, QUERIES

SF = os.environ.get("PANELCAST_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

COLUMNS = {
    1: {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    2: {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    4: {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    5: {"query_id", "rank", "vec_id", "score"},
    6: {"doc_id", "size", "source_size", "target", "taken"},
    7: {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
    8: {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    9: {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    10: {"doc_id", "fingerprint", "component_id"},
    11: {"query_id", "rank", "vec_id", "score"},
    12: {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"},
    13: {"word", "form", "root", "n", "n_near", "form_n"},
}


def test_operators_and_the_pipeline():
    names = entry_points.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert names["pipeline"] is corpus_pipeline.run and set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    assert compare(spark, connect(SF), SF, name, QUERIES[name], CHECKS.get(name)) is None


@pytest.mark.parametrize("number", list(COLUMNS))
def test_columns(spark, number):
    (name,) = [n for n in QUERIES if n.startswith(f"op{number}_")]
    assert set(QUERIES[name](spark, SF).columns) >= COLUMNS[number]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.saved(stage(spark, docs, SF), name)
        kept[name] = docs.collect()
        if name != "encode":
            assert docs.columns == columns
            assert all(r["n_chars"] == len(r["text"]) for r in kept[name])
    good = {r["doc_id"] for r in kept["quality_rules"]}
    assert good == {
        r["doc_id"] for r in QUERIES["op8_quality_rules"](spark, SF).where("kept").collect()
    } and all(set(r["text"].split("\n")) <= set(before[r["doc_id"]].split("\n")) for r in kept["quality_rules"])
    assert {r["doc_id"] for r in kept["line_dedup"]} == good
    prints = [simhash.fingerprint(r["text"].encode()) for r in kept["near_dedup"]]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[:i])
    assert {r["doc_id"] for r in kept["source_mix"]} <= {r["doc_id"] for r in kept["near_dedup"]}
    assert len(kept["encode"]) == len(kept["source_mix"]) > 0
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, run.select("doc_id", "n_tokens", "decoded_sha256").collect())) == sorted(
        (r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in kept["encode"]
    )


WHOLE = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, fingerprint string"


def _stages(spark, docs):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.saved(stage(spark, docs, SF), name)
        out[name] = docs.collect()
    return out


def test_pipeline_on_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows and columns named like those of the operators."""
    words = [" ".join(f"w{i}x{j}" for j in range(15)) for i in range(30)]
    rows = [(i, w, "en", "web" if i % 3 else "news", len(w), False, 1, "x") for i, w in enumerate(words)]
    rows += [(100, None, None, None, None, None, None, None), (101, "", "en", "web", 0, None, None, None)]
    rows += [(102, words[0], "en", None, None, True, 0, ""), (103, words[1], None, "web", 5, None, None, None)]
    rows += [rows[5], rows[5], (104, " ".join(f"long{i}" for i in range(20000)), "en", "web", 1, None, None, None)]
    got = _stages(spark, spark.createDataFrame(rows, WHOLE).repartition(4))
    text = {r[0]: r[1] for r in rows}
    assert {r["doc_id"] for r in got["quality_rules"]} == set(range(30)) | {102, 103, 104}
    assert sum(r["doc_id"] == 5 for r in got["quality_rules"]) == 3
    assert all(r["text"] == text[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in got["quality_rules"])
    near = [r["text"] for r in got["near_dedup"]]
    assert len(near) == len(set(near)) and {words[0], words[1], words[5], text[104]} <= set(near)
    assert {r["doc_id"] for r in got["source_mix"]} <= {r["doc_id"] for r in got["near_dedup"]}
    texts = collections.Counter(hashlib.sha256(r["text"].encode()).hexdigest() for r in got["source_mix"])
    assert texts == collections.Counter(r["decoded_sha256"] for r in got["encode"])


def test_pipeline_on_an_empty_table(spark):
    got = _stages(spark, spark.createDataFrame([], WHOLE))
    assert not any(got.values())
