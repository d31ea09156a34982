"""Memory and time of the Python side of each text operator on one very long text, and on one very long word.

LONG_MB sets the text's size (16 by default); README gives figures for 64.
"""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gristmill.llm.fingerprints import edited_fingerprints
from gristmill.llm.mixing import curriculum_mix
from gristmill.llm.resampling import resampled
from gristmill.llm.secrets import secrets
from gristmill.llm.url_filter import url_verdicts

MB = int(os.environ.get("LONG_MB", "16"))
START = """
import random, resource, sys, time
import pyarrow as pa
r = random.Random(1)
words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 12))) for _ in range(5000)]
piece = " ".join(r.choice(words) for _ in range(150_000)) + ". call +1 (555) 123-4567 now\\n"
text = (piece * (size // len(piece) + 1))[:size] if kind == "text" else "x9Az" * (size // 4)
batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text]), pa.array([5])], ["id", "text", "key"])
del text, piece
"""
RUN = {
    "op1": "from gristmill.llm import exact_dedup as m\nfor _, t, c in m._chunks(batch.column(1), True):\n    n = sum(m.chunk_key(x, 64) & 1 for x in c)",
    "op2": "from gristmill.llm.textblocks import text_blocks\nfrom gristmill.llm.quality import block_statistics\nfor _, _, d, o in text_blocks(batch.column(1)):\n    block_statistics(d, o)",
    "op3": "from gristmill.llm import pii\nfor b in pii._scan([batch]):\n    pass",
    "op5": "from gristmill.llm import decontamination as m\nfrom gristmill.llm.textblocks import distinct\nimport numpy as np\nindex = m.ItemIndex([1], [40], [{}], 1.0)\n((_, _, h, _),) = m._words_of(pa.array([' '.join(words[:40])]))\nindex.shingles = [{int(s): (int(c), 1.0) for s, c in zip(*m._shingle_counts(h, 5))}]\nfor size, prints in m.window_fingerprints(h, [39]):\n    index.by_size[size] = [(int(p), 0, k) for k, p in enumerate(prints)]\nm._matches(batch.column(1), index, index.tables(), m.SharedShingles(index, 0.8, 5), 0.8, 5)",
    "op6": "from gristmill.llm.textblocks import text_blocks\nfrom gristmill.llm import token_counts as m\ntable = m.piece_table(m.VOCABULARY)\nfor _, _, d, o in text_blocks(batch.column(1), m.PART_BYTES):\n    for part in m.parts(d, o):\n        m.block_counts(*part, table)",
    "op7": "from gristmill.llm import secrets as m\nfor b in m._samples(2000)([batch.select(['text'])]):\n    pass",
    "op8": "from gristmill.llm.ngram_join import shingle_sets\nfor s in shingle_sets(batch.column(1)):\n    pass",
    "op11": "from gristmill.llm import resampling as m\nfor b in m._bucket_counts('bigint', 1, 10_000)[0]([batch.select(['id', 'text'])]):\n    pass",
    "op10": "from gristmill.llm.toxicity import _features\nfor f in _features(batch.column(1)):\n    pass",
}


def measured(name: str, kind: str, size: int) -> tuple[float, float]:
    """Extra MB over what holds the text itself, and seconds."""
    code = f"size, kind = {size}, '{kind}'\n{START}\nbase, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()\n{RUN[name]}\nprint((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) / 1024, time.time() - began)"
    root = str(Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": root}, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    extra, seconds = map(float, out.stdout.split())
    print(f"{name} {kind} {size >> 20} MB: {extra:.0f} MB more, {seconds:.1f} s")
    return extra, seconds


@pytest.mark.parametrize("name", list(RUN))
def test_one_long_text(name):
    extra, seconds = measured(name, "text", MB << 20)
    assert extra < 120 + 8 * MB and seconds < 30 + MB


@pytest.mark.parametrize("name", list(RUN))
def test_one_long_word(name):
    extra, seconds = measured(name, "word", 1 << 20)
    assert extra < 200 and seconds < 30


@pytest.fixture
def long_docs(spark):
    """Some short texts, and two of 8 MB that end with an assigned secret."""
    body = F.expr("concat(repeat('Alpha beta gamma delta epsilon ', 270000), 'password=Zx81kd92kd0a', id)")
    return spark.range(6).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2, body).otherwise(F.concat(F.lit("short text number "), "id")).alias("text"), F.lit("s").alias("source")).repartition(3)


def test_long_texts_through_spark_tasks(long_docs):
    """Whole texts of 8 MB by the operators themselves, with what Spark and Arrow hold beside."""
    sizes = {r.doc_id: r["size"] for r in curriculum_mix(long_docs).collect()}
    assert sizes[0] == sizes[1] == 5 * 270_000 + 1 and sizes[5] == 4
    found = {r.doc_id: r.spans for r in secrets(long_docs).collect()}
    assert [(s.kind, s.start) for s in found[1] if s.kind == "assign"] == [("assign", 31 * 270_000)]
    got = {r.doc_id: r for r in resampled(long_docs, long_docs.filter("doc_id > 3"), least_words=1).collect()}
    assert got[0].n_features == 5 * 270_000 + 2 and got[4].n_features == 4
    prints = {r.doc_id: r for r in edited_fingerprints(long_docs).collect()}
    assert prints[0].n_chars == 31 * 270_000 + len("password=Zx81kd92kd0a0") and prints[0].near_next > 0.5 and len(prints[0].fingerprint) == 512
    assert prints[5].near_next == 0 and prints[5].n_chars == len("short text number 5")


def test_long_pages(spark):
    html = F.expr("concat(repeat('<p>some words</p>', 500000), '<a href=\"http://far.example.org/x\">')")
    pages = spark.range(2).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a"), "id", F.lit(".com/en/")).alias("url"), html.alias("html"))
    rows = url_verdicts(pages).collect()
    assert [(r.rule, r.verdict) for r in rows] == [("com/en/", "block")] * 2
