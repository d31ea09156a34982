import random
import re

from gristmill.llm import ngram_join
from gristmill.llm.ngram_join import drop_near_copies, ngram_components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return sorted(((str(d), len(s), min((x for x in least[find(i)] if x is not None), default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    texts = []
    for k in range(n):
        kind = r.random()
        if kind < 0.4 and texts:
            words = r.choice(texts).split(" ")
            for _ in range(r.choice([0, 1, 1, 2, 5])):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocabulary)
            texts.append(" ".join(words))
        elif kind < 0.6:
            texts.append(passage + " " + " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 10, 80]))))
        else:
            texts.append(" ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 4, 5, 6, 30, 90, 400]))))
    return texts


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SUB_ROWS", 64)
    texts = corpus(5, 260)
    rows = [(i * 3 % 1000, t) for i, t in enumerate(texts)] + [(2001, None), (2002, ""), (2003, " \t"), (2004, "Ä b"), (2005, "ä b"), (2006, "A  b\n"), (2007, "a b"), (None, "a b"), (2008, texts[3]), (2008, texts[3]), (None, "only null here"), (None, "only null here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_components(df).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_one_group_of_near_copies_merges_without_its_pairs(spark):
    r = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(3):
            words[r.randrange(200)] = f"e{k}x{r.randrange(9)}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(((str(x.doc_id), x.n_shingles, x.component_id) for x in ngram_components(df).collect()), key=str) == brute(rows)
    kept = drop_near_copies(df).collect()
    assert len(kept) == len({x[2] for x in brute(rows)})


def test_drop_keeps_columns_ids_and_unlinked_rows(spark):
    text = " ".join(f"k{i}" for i in range(40))
    rows = [(4, text, "a", 1), (2, text + " z", "b", 2), (2, text + " z", "c", 3), (None, text, "d", 4), (9, None, "e", 5), (8, "", "f", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sign string, key int")
    kept = drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == ["2", "8", "9"]
    assert ngram_components(df.limit(0)).count() == 0
    assert drop_near_copies(df.limit(0)).count() == 0


def test_many_unlinked_texts_that_share_a_passage(spark):
    """One passage in 1,500 texts: none of the pairs links but two, each found once."""
    r = random.Random(21)
    passage = " ".join(f"p{i}" for i in range(30))
    own = lambda k: " ".join(f"x{k}y{j}" for j in range(20))
    rows = [(k, f"{passage} {own(k)}") for k in range(1500)]
    rows += [(5000, f"{passage} {own(3)} z"), (5001, f"z {passage} {own(7)}")]
    r.shuffle(rows)
    got = {x.doc_id: x.component_id for x in ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {k: k for k in range(1500)} | {5000: 3, 5001: 7}


def test_one_passage_in_many_unlinked_texts_meets_nothing(spark, monkeypatch):
    """A passage that makes up most of all texts, none of which link: no two blocks are compared."""
    r = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, passage + " " + " ".join(f"x{r.randrange(10**9)}" for _ in range(12))) for i in range(400)]
    rows += [(1000 + i, passage + f" y{i} z{i}") for i in range(2)]
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 20)
    met = []
    compare = ngram_join._across

    def counted(work, ordered, open_, stars, percent):
        met.append(open_.filter("node IS NOT NULL").select("node").distinct().count())
        return compare(work, ordered, open_, stars, percent)

    monkeypatch.setattr(ngram_join, "_across", counted)
    df = spark.createDataFrame(rows[:400], "doc_id long, text string").repartition(4)
    got = ngram_components(df).collect()
    assert all(x.component_id == x.doc_id for x in got) and len(got) == 400 and met == []
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((str(x.doc_id), x.n_shingles, x.component_id) for x in ngram_components(df).collect()) == brute(rows)
