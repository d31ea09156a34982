import random
import zlib

import numpy as np

from gristmill.llm import toxicity
from gristmill.llm.queries import fold
from gristmill.llm.toxicity import FEATURE_BITS, block_features, drop_toxic, fit, scored
from gristmill.llm.textblocks import text_blocks


def test_learns_planted_words_and_drops_them(spark):
    r = random.Random(2)
    syllables = ["an", "er", "th", "on", "in", "ti", "re", "ed"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    docs, labels = [], []
    for i in range(600):
        text = [word() for _ in range(r.choice([5, 50, 300]))]
        if i % 5 == 0:
            for _ in range(r.randint(1, 4)):
                text.insert(r.randrange(len(text)), r.choice(["Grumbox", "zélfik"]))
        docs.append((i, " ".join(text), 1.0))
        labels.append((i, int(i % 5 == 0)))
    docs += [(600, None, 2.0), (601, "", 3.0), (None, "grumbox " * 9, 4.0), (0, docs[0][1], 5.0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score double").repartition(3)
    known = spark.createDataFrame([*labels, (None, 1), (3, None), (5, 1), (5, 1)], "doc_id long, toxic int")
    model = fit(d, known.filter(fold(3) != 1), "toxic")
    out = scored(d, model, score_col="s").collect()
    held = [(x.s, x.doc_id % 5 == 0) for x in out if x.doc_id is not None and x.doc_id < 600 and zlib.crc32(str(x.doc_id).encode()) % 3 == 1]
    assert len(held) > 150 and sum((s >= 0.7) == t for s, t in held) / len(held) > 0.97
    base = {x.s for x in out if not x.text}
    assert len(base) == 1 and base.pop() < 0.5
    kept = drop_toxic(d, model)
    assert kept.columns == d.columns and None not in {x.doc_id for x in kept.collect()} and {600, 601} <= {x.doc_id for x in kept.collect()}
    none = fit(d, known.limit(0), "toxic")
    assert {x.s for x in scored(d, none, score_col="s").collect()} == {0.5} and scored(d.limit(0), model, score_col="s").count() == 0


def test_features_are_the_distinct_grams_of_each_text():
    import pyarrow as pa

    texts = ["abcdef", "abcdabcd", "", "ABCDEF", "abc"]
    for _, _, data, offsets in text_blocks(pa.array(texts)):
        found = list(block_features(data, offsets))
    assert [len(x) for x in found] == [3 + 2 + 1, 4 + 4 + 3, 0, 6, 0] and max(x.max(initial=0) for x in found) < 1 << FEATURE_BITS
    assert found[0].tolist() == found[3].tolist()


def test_packed_features_come_back(monkeypatch):
    r = np.random.default_rng(3)
    lists = [np.sort(r.choice(1 << FEATURE_BITS, n, replace=False)) for n in (0, 1, 3, 2000, 0, 7)] + [np.array([0, 65534, 65535, 262143]), np.array([262143])]
    import pyarrow as pa

    column = pa.array([b"x\0", *map(toxicity.packed, lists)], pa.binary()).slice(1)
    for size in (1, 100, 1 << 18):
        monkeypatch.setattr(toxicity, "UNPACKED", size)
        got = [x for row, end, places, sizes in toxicity.unpacked(column) for x in np.split(places, np.cumsum(sizes)[:-1])]
        assert [g.tolist() for g in got] == [x.tolist() for x in lists]


def test_features_in_pieces(monkeypatch):
    text = "the quick brown fox jumps over the lazy dog é ü " * 5
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    whole = next(iter(block_features(data, offsets))).tolist()
    for piece in (1, 7, 50):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert next(iter(block_features(data, offsets))).tolist() == whole


def test_held_out_texts_of_the_tables(spark):
    """Of the given labels' held-out fold, the area under the curve and the share that the threshold gets right."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    out = scored(docs, fit(docs, labels.filter(fold(3) != 1), "toxic")).join(labels.filter(fold(3) == 1), "doc_id").select("score", "toxic").dropna().toPandas()
    ranks = out["score"].rank()
    ones = out["toxic"] == 1
    area = (ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    right = ((out["score"] >= 0.7) == ones).mean()
    print(f"area {area:.4f}, right {right:.4f}, caught {(out['score'][ones] >= 0.7).mean():.4f}, false {(out['score'][~ones] >= 0.7).mean():.4f}, rows {len(out)}")
    assert area > 0.97 and right > 0.95
