"""Very long texts, ties, repeated rows and clashing columns, operator by operator and in the pipeline."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import bpe, chat, decontaminate, jaccard, quality_model, quality_rules, secrets, toxicity, warc
from tests.conftest import SF

WORDS = 200_000


@pytest.fixture(scope="module")
def long_text():
    return " ".join(f"w{i}" for i in range(WORDS))


def test_long_pages(spark, long_text, tmp_path):
    html = long_text * 4
    pages = spark.createDataFrame([(1, "u", html), (2, "v", html), (2, "v", html), (3, "w", "x")], "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = str(tmp_path / "w")
    warc.write_archives(pages, path)
    got = warc.assemble(warc.read_archives(spark, path)).collect()
    assert sorted((r.page_id, r.record_type, r.payload_bytes) for r in got) == sorted([(1, "revisit", len(html)), (2, "response", len(html)), (2, "response", len(html)), (3, "response", 1)])
    assert sum(bytes(r.block).endswith(html.encode()) for r in got) == 2


def test_long_conversations(spark, long_text):
    turns = [(1, i, "user" if i % 2 else "assistant", "[INST]" if i % 5 == 0 else f"t{i}") for i in range(20_000)] + [(2, 0, "assistant", long_text), (2, 0, "assistant", long_text)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x"))
    got = {r.conv_id: r for r in chat.format_conversations(rows, ("n_turns", "loss_chars", "loss_sha256")).collect()}
    said = "".join(t for _, _, role, t in turns[:20_000] if role == "assistant")
    assert (got[1].n_turns, got[1].loss_sha256) == (20_000, hashlib.sha256(said.encode()).hexdigest())
    assert got[2].loss_chars == 2 * len(long_text)


def test_long_texts_are_scored(spark, long_text):
    model = toxicity.Model(("idiot",), (), frozenset(), toxicity.UNTRAINED)
    docs = spark.createDataFrame([(1, long_text + " idiot"), (2, long_text), (3, "x" * 2_000_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert (got[1].findings, got[2].findings, got[3].findings) == (1, 0, 0) and got[1].score > got[2].score
    assert all(r.score == 0.5 for r in quality_model.score(docs, None).collect())
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality_model.score(docs, quality_model.train_model(docs, marks)).collect())


def test_long_texts_are_judged(spark, long_text):
    rows = [(1, long_text, "en", "s"), (2, "same words here " * 50_000, "en", "s"), (3, "x" * 1_000_000, "en", "s"), (4, "a line\n" * 50_000, "en", "s")]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[2].n_repeat_words, got[3].word_chars, got[4].n_dup_lines) == (WORDS, 0, 150_000, 1_000_000, 49_999)


def test_long_texts_are_searched(spark, long_text):
    item = "the ten words of this item stand at the very end"
    docs = spark.createDataFrame([(1, f"{long_text} {item}"), (2, long_text), (2, long_text)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, " ".join(f"w{i}" for i in range(100, 20_000)))], "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(docs, bench).collect())
    assert got == [(1, WORDS + 11, 20_000 - 100 + 11, 2), (2, WORDS, 19_900, 1), (2, WORDS, 19_900, 1)]


def test_long_texts_are_scanned_and_encoded(spark, long_text):
    docs = spark.createDataFrame([(1, long_text + " password=abcdefgh"), (2, "ab" * 100_000), (3, "=" * 500_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(docs, ("n_assign", "n_random", "redacted")).collect()}
    assert got[1].n_assign == 1 and got[1].redacted.endswith(" [SECRET]") and got[3].n_random == 0
    assert {r.doc_id: r.decoded_sha256 for r in bpe.encode(docs, ("decoded_sha256",)).collect()} == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()}


def test_long_texts_are_joined(spark, long_text):
    near = long_text.replace("w777 ", "other ")
    docs = spark.createDataFrame([(1, long_text), (2, near), (3, near), (4, long_text[: len(long_text) // 2])], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.join(docs, jaccard.Rule(3, 900)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_pipeline_on_odd_documents(spark, long_text):
    """Extra columns of names that stages use, long texts, repeated rows; all but copies stay."""
    rows = [(1, long_text, "en", "s", 5), (2, long_text + " end", "en", "s", 5), (3, None, None, None, None), (None, "some words", "en", None, 1), (4, "", "", "", 0)]
    names = ["score", "findings", "gone", "component_id", "spans", "redacted", "lines", "w", "ids", "kept", "n"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in [*rows, rows[0]]], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in names))
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == list(corpus_pipeline.COLUMNS)
    out = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert sorted((str(r.doc_id), r.n_tokens > 0) for r in out) == [("1", True), ("3", False), ("4", False), ("None", True)]


def test_operators_reach_workers_by_themselves(tmp_path):
    """On a caller's own DataFrames, with the package importable by the driver alone."""
    import os
    import subprocess
    import sys

    from tests.conftest import ROOT

    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
from quire.llm import CALL
docs = spark.createDataFrame([(1, "token=abcdef1 x"), (2, "a b c d")], "doc_id long, text string")
"""
    calls = {
        "secrets": "secrets.scan(docs).collect()",
        "bpe": "bpe.encode(docs).collect()",
        "jaccard": "jaccard.join(docs, jaccard.Rule(3, 900)).collect()",
        "toxicity": "toxicity.score(docs, toxicity.Model((), (), frozenset(), toxicity.UNTRAINED)).collect()",
        "quality_model": "quality_model.score(docs, None).collect()",
        "chat": "chat.format_conversations(docs.selectExpr('doc_id conv_id', '1 turn', 'text role', 'text')).collect()",
        "warc": f"warc.write_archives(docs.selectExpr('doc_id page_id', 'text url', 'text html'), {str(tmp_path / 'w')!r}); warc.read_archives(spark, {str(tmp_path / 'w')!r}).collect()",
    }
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for module, call in calls.items():
        out = subprocess.run([sys.executable, "-c", code.replace("CALL", module) + call + "\nprint('good')"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
        assert out.stdout.strip().endswith("good"), (module, out.stderr[-1500:])
