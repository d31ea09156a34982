import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from test_ngram_join import shingles

from gristmill.llm.toxicity import REJECT_FROM, scored


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_stages_match_brute_force(spark, sf_dir):
    """Every stage against a plain version on its own input, over the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    left = {r.doc_id: r for r in docs.collect()}
    model = corpus_pipeline.toxicity_model(spark, sf_dir)
    score = {r.doc_id: r.score for r in scored(docs, model).collect()}

    step = corpus_pipeline.toxicity(spark, docs, sf_dir)
    assert step.columns == docs.columns
    want = {i for i in left if score[i] < REJECT_FROM}
    assert {r.doc_id for r in step.collect()} == want and len(want) < len(left)

    docs2 = docs.filter(docs.doc_id.isin(sorted(want))).cache()
    best = {}
    for i in sorted(want):
        best[fold(left[i].text)] = i
    step = corpus_pipeline.exact_dedup(spark, docs2, sf_dir)
    assert step.columns == docs.columns and {r.doc_id for r in step.collect()} == set(best.values())

    docs3 = docs.filter(docs.doc_id.isin(sorted(best.values()))).cache()
    ids = sorted(best.values())
    sets, root = {i: shingles(left[i].text) for i in ids}, {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {find(i) for i in ids}
    step = corpus_pipeline.near_dedup(spark, docs3, sf_dir)
    assert step.columns == docs.columns and {r.doc_id for r in step.collect()} == want

    docs4 = docs.filter(docs.doc_id.isin(sorted(want))).cache()
    items = [re.findall(r"[^\x20\x09-\x0D]+", fold(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    holds = {i for i in want for x in items if f" {' '.join(x)} " in f" {' '.join(re.findall(r'[^\x20\x09-\x0D]+', fold(left[i].text)))} "}
    step = corpus_pipeline.decontamination(spark, docs4, sf_dir)
    assert step.columns == docs.columns and {r.doc_id for r in step.collect()} == want - holds

    docs5 = docs.filter(docs.doc_id.isin(sorted(want - holds)))
    mix = corpus_pipeline.mixing(spark, docs5, sf_dir).collect()
    assert {r.doc_id for r in mix} == want - holds and {"source", "lang", "n_chars"} <= set(mix[0].asDict())
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(str, whole)) == sorted(map(str, mix))


def test_stages_handle_odd_rows(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, size int"
    rows = [(None, None, None, None, None, None, None), (1, "", "en", "a", 0, "s", 1), (2, "x " * 20000, "en", "a", 1, "s", 1), (2, "x " * 20000, "en", "a", 1, "s", 1), (3, "one two", None, None, 1, None, 2)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        some = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "size"], name
        kept = docs.collect()
        assert len(kept) == (3 if some else 0)
        mix = corpus_pipeline.mixing(spark, docs, sf_dir)
        assert mix.count() == len(kept) and {"size", "document_size", "score"} <= set(mix.columns)
