import hashlib
import random

import pytest

from gristmill.llm.exact_dedup import border_marks, chunk_key, cut, drop_copies, exact_dedup


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[fold(t)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256(fold(t).encode()).hexdigest()))
    return sorted(out, key=str)


def long_text(seed, n=40000):
    r = random.Random(seed)
    return "".join(r.choice("abcdefg hijÄé€\n") for _ in range(n))


ROWS = [(1, "A b"), (2, "a B"), (3, "ä"), (4, "Ä"), (5, None), (6, ""), (7, " "), (8, long_text(1)), (9, long_text(1).upper().replace("Ä", "Ä")), (10, long_text(1)), (11, long_text(1) + "x"), (None, "a b"), (12, "one"), (12, "one"), (None, "zz"), (None, "zz")]


@pytest.mark.parametrize("bits", [64, 2])
def test_matches_brute_force(spark, bits):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = [tuple(r)[:5] for r in exact_dedup(df, key_bits=bits).collect()]
    assert sorted(got, key=str) == brute(ROWS)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, digest string, recipe int, key int")
    assert exact_dedup(df).count() == 0
    full = spark.createDataFrame([(1, "x", "d", 1), (2, "X", "d", 2), (2, "X", "e", 3), (None, "y", "f", 4)], "doc_id long, text string, digest string, keep_id int")
    kept = drop_copies(full).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["2", "None"]
    assert drop_copies(full).columns == full.columns


def test_chunks_join_to_the_text_and_do_not_depend_on_the_place():
    import numpy as np

    raw = long_text(3).encode()
    data = np.frombuffer(b"p" * 777 + raw, np.uint8)
    alone, moved = np.frombuffer(raw, np.uint8), data
    a = cut(border_marks(alone), 0, len(raw))
    b = cut(border_marks(moved), 777, 777 + len(raw))
    assert a[-1] == len(raw) and [x - 777 for x in b] == a and len(a) > 10
    assert chunk_key(b"q", 64) != chunk_key(b"r", 64)
