"""Pipeline stages on rows with nulls, empty texts and repeated ids; queries on workers that cannot import the package."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from conftest import TESTDATA
from test_llm import edited, prose, shingle_set

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
A, B = prose(41, 80), prose(42, 70)
ROWS = [
    (1, A), (2, A), (3, edited(A, [40])), (4, B), (4, B), (5, "one"), (5, "two words"), (6, None), (7, ""), (None, A), (None, None), (8, prose(43, 6000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_dedup_keeps_one_of_each_group(spark, docs):
    got = sorted(map(tuple, corpus_pipeline.near_dedup(spark, docs, TESTDATA).select("doc_id", "text").collect()), key=repr)
    kept = set()
    for i, t in ROWS:
        mine = shingle_set(t, 5)
        alike = [j for j, u in ROWS if j is not None and mine and (s := shingle_set(u, 5)) and 100 * len(mine & s) >= 80 * len(mine | s)]
        if i is not None and i <= min(alike, default=i):
            kept.add((i, t))
    assert got == sorted([*kept, *((i, t) for i, t in ROWS if i is None)], key=repr)


def test_pack_returns_every_row_with_its_text(spark, docs):
    out = corpus_pipeline.pack(spark, docs, TESTDATA)
    assert set(docs.columns) <= set(out.columns)
    assert sorted(map(tuple, out.select(docs.columns).collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    rows = out.collect()
    assert all(r["length"] == len((r["text"] or "").split()) <= r["padded_length"] for r in rows)
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in rows}) == len(rows)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_nothing(spark, docs, stage):
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs.limit(0), TESTDATA)
    assert out.collect() == [] and set(docs.columns) <= set(out.columns)


def test_stages_keep_rows_apart(spark, docs):
    """Repeated ids, nulls and empty texts pass through decontamination and surrogates unharmed."""
    for stage in (corpus_pipeline.decontaminate, corpus_pipeline.surrogates):
        out = stage(spark, docs, TESTDATA)
        assert sorted(map(tuple, out.select(docs.columns[:2]).collect()), key=repr) == sorted(ROWS, key=repr)


def test_workers_need_not_have_the_package(tmp_path):
    """The driver alone finds the package; its workers start in another folder, without a path to it."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__
from webloom.session import build_session
spark = build_session("alone", "4")
queries = __spark_entry__.queries()
for name in ("op10_surrogates", "op11_target_sample", "op12_prefix_trie", "op13_ngram_join"):
    assert queries[name](spark, {TESTDATA!r}).count() > 0, name
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-2000:]
