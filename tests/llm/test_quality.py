import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gristmill.llm.quality import STATISTICS, Rule, block_statistics, quality, statistics
from gristmill.llm.textblocks import text_blocks


def plain(text):
    """The statistics of one text, counted one by one."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    size = sum(len(w.encode()) for w in words)
    lines = [x for x in text.split("\n") if x]
    fold = lambda w: "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
    low = [fold(w) for w in words]
    w, b = max(1, len(words)), max(1, size)
    marks = [c for c in text if c.isascii() and not c.isalnum() and not c.isspace() and c.isprintable()]
    return [
        len(words), size / w, sum("A" <= c <= "Z" for c in text) / b, sum("0" <= c <= "9" for c in text) / b, len(marks) / b, sum(c in "#$%&*+<=>@[]^_{|}~\\" for c in text) / b,
        len(set(low)) / w, len(set(lines)) / max(1, len(lines)), sum(x == y for x, y in zip(low, low[1:])) / w, sum(x == "|" for x in words) / w, sum(x[-1] in ".!?" for x in words) / w,
        sum(len(x.encode()) <= 2 for x in words) / w, sum(c > 127 for c in text.encode()) / max(1, len(text.encode())), len(words) / max(1, len(lines)),
    ]


TEXTS = ["", "a", "The the THE end.\n\nThe the\nA | b | 12 $#\n", "é É ñ\tx\x0by\x0c!", "\n\n", "one two\none two\none two", " lead and trail ", "x" * 5000 + " y"]


def test_statistics_are_the_plain_counts():
    rows = [None, *TEXTS]
    got = np.concatenate([block_statistics(d, o) for _, _, d, o in text_blocks(pa.array(rows), 64)])
    assert got.shape == (len(rows), len(STATISTICS))
    for row, text in zip(got, rows):
        assert row == pytest.approx(plain(text or "")), text


def corpus():
    r = random.Random(8)
    word = lambda: "".join(r.choice(["an", "er", "th", "ou", "ti"]) for _ in range(r.randint(1, 3)))
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [word() for _ in range(r.choice([20, 80, 200]))]
        if bad:
            words = r.choice([[w + r.choice(["***", "$$$"]) for w in words], [w.upper() + "!!" for w in words], [words[0]] * len(words)])
        docs.append((i, " ".join(words), "clash"))
        labels.append((i, int(not bad)))
    return docs, labels


def test_rules_learn_and_score_held_out_texts(spark):
    docs, labels = corpus()
    docs += [(900, None, "x"), (901, "", "x"), (None, "an er", "x"), (0, docs[0][1], "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, words string").repartition(3)
    known = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, quality int")
    out, model = quality(d, known.filter("doc_id % 3 <> 1 OR doc_id IS NULL"), "quality")
    rows = out.collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    held = [(r.score >= 0.7, r.doc_id % 4 != 0) for r in rows if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 3 == 1]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert 0 < len(model.rules) < 80 and all(r.weight for r in model.rules)
    assert len({r.score for r in rows if r.doc_id in (900, 901)}) == 1 and len({r.score for r in rows if r.doc_id == 0}) == 1


def test_edges(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([x[:2] for x in docs[:20]], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality(d, none, "quality")[0].collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert {round(r.score, 6) for r in quality(d, one, "quality")[0].collect()} == {round(10 / 11, 6)}
    assert quality(d.limit(0), one, "quality")[0].count() == 0 and statistics(d.limit(0)).count() == 0


def test_a_rule_is_a_column(spark):
    df = spark.createDataFrame([(1.0, 0.2), (3.0, 0.2), (3.0, 0.9)], "words double, word_length double")
    rule = Rule((("word_length", "<=", 0.5), ("words", ">", 2.0)))
    assert [r[0] for r in df.select(rule.column()).collect()] == [False, True, False]
