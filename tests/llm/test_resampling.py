import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from gristmill.llm import resampling
from gristmill.llm.resampling import resampled


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(text, most):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, most=1, buckets=10_000, least=20, percent=10, seed=2024):
    def counts(texts):
        c = [0] * buckets
        for t in texts:
            for f in features(t, most):
                c[zlib.crc32(f.encode()) % buckets] += 1
        return c

    s, t = counts([x for _, x in docs]), counts(target)
    all_s, all_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (all_s + buckets) / ((a + 1) * (all_t + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        f = features(text, most)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=str)


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["Ünder", "ÉTÉ", "日本", "don't", "A-b", "x_y", "\x00nul", "9lives"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 5, 19, 20, 40, 200]))) for _ in range(n)]
    texts[3:6] = [None, "", " \t.-"]
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)], [" ".join(r.choice(vocabulary[:40]) for _ in range(30)) for _ in range(9)] + [None, ""]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frames(spark, docs, target):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string")


def test_matches_brute_force(spark):
    docs, target = corpus(3, 300)
    docs += [(None, docs[20][1]), (None, None), (5000, docs[20][1]), (5000, docs[20][1]), (5001, docs[20][1])]
    found = resampled(*frames(spark, docs, target))
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert got(found) == brute(docs, target)


def test_longer_runs_and_other_parameters(spark):
    docs, target = corpus(4, 120)
    a, b = frames(spark, docs, target)
    found = resampled(a.withColumnsRenamed({"doc_id": "key", "text": "body"}), b, "key", "body", max_words=3, buckets=97, least_words=1, percent=100, seed=5)
    assert got(found) == brute(docs, target, 3, 97, 1, 100, 5)


def test_long_texts_in_pieces(spark, monkeypatch):
    docs, target = corpus(5, 60)
    want = {r[0]: r[1:3] for r in brute(docs, target, 2)}
    for size in (16, 200):
        run, _ = resampling._bucket_counts("bigint", 2, 10_000, size)
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], ["id", "text"])
        out = pa.Table.from_batches(run([batch])).to_pylist()
        for (i, text), row in zip(docs, out):
            assert row["id"] == i and row["words"] == len(words(text)) and sum(row["counts"]) == want[i][0]
            counted = {}
            for f in features(text, 2):
                b = zlib.crc32(f.encode()) % 10_000
                counted[b] = counted.get(b, 0) + 1
            assert dict(zip(row["buckets"], row["counts"])) == counted
        assert sum(out[-1]["totals"]) == sum(n for n, _ in want.values())


def test_pieces_cover_the_text_once():
    text = "ab cd  efg, h" * 50 + "x" * 300 + " tail"
    cut = list(resampling.pieces(text, 3, 20))
    assert "".join(body for body, _ in cut) == text and len(cut) > 20
    assert all(len(words(tail)) <= 2 for _, tail in cut) and cut[-1][1] == ""


def test_equal_rows_and_ties_have_consecutive_ranks(spark):
    text = " ".join(["same"] * 30)
    docs = [(7, text)] * 400 + [(i, text + f" w{i}") for i in range(100, 300)]
    a, b = frames(spark, docs, ["same w101"])
    found = got(resampled(a, b, percent=80))
    assert found == brute(docs, ["same w101"], percent=80)
    assert sorted(r[4] for r in found if r[4]) == list(range(1, 481))


def test_empty_tables_and_extra_columns(spark):
    docs, target = corpus(6, 80)
    a, b = frames(spark, docs, target)
    assert got(resampled(a.limit(0), b)) == [] and got(resampled(a, b.limit(0))) == brute(docs, [])
    wide = a.selectExpr("*", "1 AS rank", "'x' AS score", "2 AS words", "3 AS totals")
    assert got(resampled(wide, b.selectExpr("*", "9 AS doc_id"))) == brute(docs, target)
    nothing = spark.createDataFrame([(1, None), (2, ""), (3, "few words")], "doc_id long, text string")
    assert [r[4] for r in got(resampled(nothing, b))] == [None] * 3


def test_target_like_documents_are_drawn(spark):
    r = np.random.default_rng(1)
    docs = [(i, " ".join(f"w{x}" for x in r.integers(0, 300, 60))) for i in range(900)] + [(i, " ".join(f"t{x}" for x in r.integers(0, 40, 60))) for i in range(900, 1000)]
    a, b = frames(spark, docs, [" ".join(f"t{x}" for x in r.integers(0, 40, 500))])
    drawn = [x[0] for x in got(resampled(a, b)) if x[4]]
    assert len(drawn) == 100 and sum(i >= 900 for i in drawn) >= 50  # 10 by chance
