import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from gristmill.llm import fingerprints as m
from gristmill.llm.fingerprints import edited_fingerprints, fingerprint, fingerprints, likeness, packed


def hash64(data, seed=42):
    x = xxhash.xxh64_intdigest(data, seed)
    return x - (1 << 64) if x >> 63 else x


def of_longs(*values):  # as Spark hashes several columns: each seeds the next
    seed = 42
    for v in values:
        seed = hash64(struct.pack("<q", v), seed & ((1 << 64) - 1))
    return seed


def of_ints(*values):
    seed = 42
    for v in values:
        seed = hash64(struct.pack("<i", v), seed & ((1 << 64) - 1))
    return seed


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def lows(text, bins=256, bits=8):
    w = [hash64(x.encode()) for x in words(text)]
    if not w:
        return None
    if len(w) >= 5:
        hashes = [of_longs(*w[i : i + 5]) for i in range(len(w) - 4)]
    else:
        acc = 0
        for x in w:
            acc = of_longs(acc, x)
        hashes = [acc]
    least = {}
    for h in hashes:
        b = (h >> (64 - (bins.bit_length() - 1))) + bins // 2
        least[b] = min(h, least.get(b, h))
    out = []
    for b in range(bins):
        found = least.get(b)
        for j in range(m.TRIES):
            if found is None:
                found = least.get(of_ints(b, j) % bins)
        if found is None:
            found = least[min(least, key=lambda f: (of_ints(b, m.TRIES, f), least[f] & ((1 << bits) - 1)))]
        out.append(found & ((1 << bits) - 1))
    return out


def digits(v, bits=8):
    return "" if v is None else "".join(f"{x:0{bits // 4}x}" for x in v)


def alike(a, b, bits=8):
    if a is None or b is None:
        return float(a is None and b is None)
    same = sum(x == y for x, y in zip(a, b)) / len(a)
    return max(0.0, (same - 2**-bits) / (1 - 2**-bits))


def brute(rows, bins=256, bits=8):
    def key(r):
        i, text = r
        return (i is None, i or 0, hashlib.sha256((f"{len(str(i))}:{i}" if i is not None else "-").encode() + (text or "").encode()).digest())

    order = sorted({(i, t or "") for i, t in rows}, key=key)
    following = {x: order[(k + 1) % len(order)] for k, x in enumerate(order)}
    out = []
    for i, t in rows:
        t = t or ""
        nxt, half = following[i, t][1], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = lows(t, bins, bits), lows(edited, bins, bits), lows(nxt, bins, bits)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), digits(a, bits), digits(b, bits), round(alike(a, b, bits), 9), round(alike(a, c, bits), 9)))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in df.collect()), key=str)


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Äpfel", "ÉTÉ", "日本語", "A-b", "😀x"]
    texts = [r.choice([" ", "\n"]).join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 4, 5, 6, 9, 30, 200, 700]))) for _ in range(n)]
    return [(i * 37 % 1009, t) for i, t in enumerate(texts)]


def test_matches_brute_force(spark):
    rows = corpus(1, 90) + [(2001, None), (2002, ""), (2003, " \t\x0b"), (2004, "one two three four five"), (2005, "ONE two three four FIVE"), (2006, "x" * 50_000), (2007, "Ä b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(edited_fingerprints(df)) == brute(rows)


def test_ties_repeats_and_null_ids(spark):
    rows = corpus(2, 25)
    rows += [rows[7]] * 30 + [(rows[8][0], "another text of the same id, with some more words"), (None, "no id here at all, sorry"), (None, None), (None, ""), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(edited_fingerprints(df)) == brute(rows)


def test_other_parameters_and_extra_columns(spark):
    rows = corpus(3, 40)
    df = spark.createDataFrame(rows, "name long, body string").selectExpr("*", "1 AS id", "'x' AS text", "2 AS key", "3 AS lows", "4 AS copies")
    found = edited_fingerprints(df, "name", "body", bins=64, bits=4).withColumnRenamed("name", "doc_id")
    assert got(found) == brute(rows, 64, 4)
    plain = fingerprints(df, "name", "body", bins=64, bits=4)
    assert sorted(tuple(r) for r in plain.collect()) == sorted((i, digits(lows(t, 64, 4), 4)) for i, t in rows)
    for wrong in ({"bins": 100}, {"bits": 5}, {"bins": 1}):
        with pytest.raises(ValueError):
            fingerprints(df, "name", "body", **wrong)


def test_one_document_and_empty_table(spark):
    one = [(5, "a text alone follows itself " * 4)]
    df = spark.createDataFrame(one, "doc_id long, text string")
    assert got(edited_fingerprints(df)) == brute(one)
    assert edited_fingerprints(df.limit(0)).collect() == []


def test_likeness_is_near_the_jaccard_similarity(spark):
    r = random.Random(4)
    rows = []
    for k in range(120):
        a = [f"w{r.randrange(5000)}" for _ in range(900)]
        cut = r.randrange(0, 900)
        b = a[:cut] + [f"w{r.randrange(5000)}" for _ in range(900 - cut)]
        rows.append((k, " ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "id long, a string, b string").select("id", "a", "b", fingerprint(F.col("a")).alias("fa"), fingerprint(F.col("b")).alias("fb"))
    off = []
    for x in df.select("a", "b", likeness(F.col("fa"), F.col("fb")).alias("near")).collect():
        s, t = shingles(x.a), shingles(x.b)
        off.append(x.near - len(s & t) / len(s | t))
    assert max(map(abs, off)) < 0.12 and (sum(d * d for d in off) / len(off)) ** 0.5 < 0.04 and abs(sum(off) / len(off)) < 0.01


def test_no_python_runs(spark, sf_dir):
    plan = edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_packing(spark):
    row = spark.range(1).select(packed(F.expr("array(0S, 15S, 255S)")).alias("x"), packed(F.expr("array(0S, 15S)"), 4).alias("y"), packed(F.lit(None).cast("array<smallint>")).alias("z")).first()
    assert tuple(row) == ("000fff", "0f", "")
