import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from gristmill.llm import decontamination
from gristmill.llm.decontamination import SharedShingles, contaminated, drop_contaminated, item_blocks, window_fingerprints
from gristmill.llm.workspace import Workspace


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def data(spark, seed=3):
    r = random.Random(seed)
    vocabulary = [f"v{i}é" for i in range(5000)]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate([1, 3, 5, 15, 37, 59, 120, 400] * 3)] + [(90, None), (91, " "), (92, "same words here now ok"), (93, "Same words HERE now ok")]
    docs, want = [], set()
    for d in range(120):
        text = make(r.choice([0, 1, 30, 300]))
        if d % 3 == 0:
            item = r.choice(items[:24])
            docs.append((d, f"{text} {item[1].upper() if d % 2 else item[1]}\n{make(20)}"))
        else:
            docs.append((d, text))
    near = items[5][1].split(" ")
    docs += [(500, " ".join([make(40), *near[:-1], "changed", make(9)])), (501, None), (502, ""), (None, items[4][1]), (503, items[4][1]), (503, items[4][1]), (504, "x same words here now ok y")]
    for i, t in docs:
        w = words(t)
        for k, it in items:
            x = words(it)
            if x and any(w[a : a + len(x)] == x for a in range(len(w) - len(x) + 1)):
                want.add((str(i), k))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    return docs, d, b, want


def test_finds_every_whole_passage_and_near_ones(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 10)
    docs, d, b, want = data(spark)
    got = contaminated(d, b).collect()
    found = {(str(r.doc_id), r.item_id) for r in got}
    assert want <= found and found - want == {("500", 5)}
    assert all(r.similarity == 1 for r in got if (str(r.doc_id), r.item_id) in want)
    extra = d.selectExpr("*", "1 AS item_id", "'z' AS similarity")
    kept = drop_contaminated(extra, b)
    assert kept.columns == extra.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if str(i) not in {x for x, _ in found})
    assert contaminated(d.limit(0), b).count() == 0 and contaminated(d, b.limit(0)).count() == 0


def test_fingerprints_match_a_plain_count():
    hashed = np.random.default_rng(1).integers(0, 1 << 64, 60, dtype=np.uint64)
    for size, prints in window_fingerprints(hashed, [1, 2, 7, 36, 60, 61]):
        for at, p in enumerate(prints.tolist()):
            bits = [sum(int(w) >> b & 1 for w in hashed[at : at + size]) for b in range(64)]
            assert p == sum(1 << b for b, n in enumerate(bits) if n > size / 2)


def brute_force(docs, items, shingle=5, threshold=0.8):
    """(document, item) pairs that reach the threshold at any place, by plain weighted counters."""
    runs = lambda w: Counter(tuple(w[a : a + shingle]) for a in range(max(1, len(w) - shingle + 1)))
    each = {k: words(t) for k, t in items}
    held = Counter(s for w in each.values() for s in runs(w))
    weight = lambda s, item: 1 + math.log(len(each) / held[s]) if s in item else 1 + math.log(len(each))
    out = set()
    for d, text in docs:
        w = words(text)
        for k, x in each.items():
            item = runs(x)
            for at in range(1 - len(x), len(w)):
                part = runs(w[max(at, 0) : at + len(x)])
                if not part.keys() & item.keys():
                    continue
                both = sum(min(part[s], item[s]) * weight(s, item) for s in item)
                either = sum(max(part[s], item[s]) * weight(s, item) for s in part | item)
                if both / either >= threshold:
                    out.add((d, k))
    return out


def edited(r, w, kind):
    """``w`` with one word replaced, left out or put in, anywhere, or its end cut."""
    at = r.randrange(len(w))
    return {"replace": [*w[:at], "other", *w[at + 1 :]], "leave": w[:at] + w[at + 1 :], "add": [*w[:at], "more", *w[at:]], "cut": w[: len(w) - len(w) // 6]}[kind]


def test_finds_all_edited_items_that_the_exact_check_accepts(spark):
    r = random.Random(7)
    vocabulary = [f"v{i}" for i in range(3000)]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(make(15 + i % 45))) for i in range(60)]
    docs = []
    for k in range(480):
        before, after = make(r.choice([0, 3, 20])), make(r.choice([0, 2, 20]))
        docs.append((k, " ".join([*before, *edited(r, items[k % 60][1].split(), ("replace", "leave", "add", "cut")[k // 60 % 4]), *after])))
    sure, most = brute_force(docs, items, threshold=0.8 + 1e-9), brute_force(docs, items, threshold=0.8 - 1e-9)  # sums in another order round otherwise
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sure <= {(x.doc_id, x.item_id) for x in got} <= most and len(sure) > 150


def test_finds_long_items_whose_opening_differs(spark):
    r = random.Random(9)
    make = lambda n: [f"v{r.randrange(3000)}" for _ in range(n)]
    long, longer = make(400), make(2000)
    changed = ["other" if k < 270 and k % 38 == 5 else w for k, w in enumerate(long)]
    docs = [(1, changed), (2, long[60:]), (3, longer[300:]), (4, [*make(30), *changed, *make(30)]), (5, long[200:]), (6, make(40) + long[40:])]
    docs = [(i, " ".join(w)) for i, w in docs]
    items = [(1, " ".join(long)), (2, " ".join(longer)), (3, " ".join(make(30)))]
    want = {(1, 1), (2, 1), (3, 2), (4, 1), (6, 1)}
    assert brute_force(docs, items) == want
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in contaminated(d, b).collect()} == want
    assert [x.doc_id for x in drop_contaminated(d, b).collect()] == [5]


def test_segments_of_a_long_document_find_the_same(spark, monkeypatch):
    r = random.Random(12)
    make = lambda n: [f"v{r.randrange(3000)}" for _ in range(n)]
    items = [(i, " ".join(make(15 + 3 * i))) for i in range(20)]
    text = make(7)
    for k in range(120):
        text += edited(r, items[k % 20][1].split(), ("replace", "leave", "add", "cut")[k // 20 % 4]) + make(r.choice([0, 2, 90]))
    work = Workspace(spark)
    (index,) = item_blocks(work, spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 5, decontamination.RADIUS)
    column, tables, shared = pa.array([" ".join(text)]), index.tables(), SharedShingles(index, 0.8, 5)
    whole = decontamination._matches(column, index, tables, shared, 0.8, 5)
    assert len(whole) >= 15
    for segment in (50, 333, 1000):
        monkeypatch.setattr(decontamination, "SEGMENT", segment)
        assert decontamination._matches(column, index, tables, shared, 0.8, 5) == whole
