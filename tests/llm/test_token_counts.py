import random
import re

import pyarrow as pa
from tokenizers import Tokenizer, models

from gristmill.llm import token_counts as module
from gristmill.llm.textblocks import text_blocks
from gristmill.llm.token_counts import FALLBACK, MARK, UNIT, VOCABULARY, PieceTable, block_counts, long_counts, read_pieces, token_counts, trie_counts, zipf_scores


def plain(word, scores):
    best = [(0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        s, c = best[end - 1]
        options = [(s + FALLBACK, -(c + len(word[end - 1].encode())), "x")]
        for k in range(1, end + 1):
            if word[end - k : end] in scores:
                s, c = best[end - k]
                options.append((s + scores[word[end - k : end]], -(c + 1), "x"))
        s, c, _ = max(options)
        best[end] = (s, -c)
    return best[-1][1]


def texts():
    r = random.Random(4)
    syllables = ["the", "and", "ing", "tion", "ou", "é", "ñ", "er", "S", "ch", "1", "2.", "—", "漢", "😀", "ß"]
    out = [" ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 6))) for _ in range(r.choice([1, 10, 200]))) for _ in range(60)]
    return out + [None, "", " \t\n", "a", "aa aa aaa", "x" * 3000, "the the the"]


def test_matches_plain_dynamic_programming(spark):
    scores = zipf_scores(read_pieces(VOCABULARY))
    rows = list(enumerate(texts())) + [(None, "the end"), (3, "the end"), (3, "the end")]
    d = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, n_tokens string").repartition(3)
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want.append(str((i, len(words), sum(plain(MARK + w, scores) for w in words))))
    assert sorted(str(tuple(r)) for r in token_counts(d).collect()) == sorted(want)
    assert token_counts(d.limit(0)).count() == 0


def test_agrees_with_a_public_unigram_decoder():
    pieces = read_pieces(VOCABULARY)
    scores = zipf_scores(pieces)
    public = Tokenizer(models.Unigram([("<unk>", -100.0), *[(p, s / UNIT) for p, s in scores.items()]], unk_id=0, byte_fallback=False))
    words = sorted({MARK + w for t in texts() if t for w in re.findall(r"[a-z]+", t) if len(w) < 50})
    got = trie_counts(words, PieceTable(scores))
    same = sum(len(public.encode(w).tokens) == n for w, n in zip(words, got))
    assert same >= 0.99 * len(words)  # equal scores may be cut otherwise


def test_ties_take_fewest_tokens():
    table = PieceTable({"a": -1, "aa": -2, "b": -1})
    column = pa.array(["aa", "aab a", ""])
    for _, _, data, offsets in text_blocks(column):
        got = block_counts(data, offsets, table)[1]
    assert got.tolist() == [3 + 1, 3 + 1 + 1 + 3 + 1, 0]  # the mark falls back to three bytes


def test_long_words_in_segments(monkeypatch):
    """Long pre-tokens with shared beginnings, cut at every segment size."""
    scores = zipf_scores(read_pieces(VOCABULARY))
    r = random.Random(11)
    alphabet = ["the", "tion", "é", "x", "Q9", "漢", "/", "ing"]
    start = MARK + "".join(r.choice(alphabet) for _ in range(60))
    words = sorted({start + "".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(12)} | {start, MARK + "z" * 300, start[:50]})
    want = [plain(w, scores) for w in words]
    for segment in (20, 33, 64, 4096):
        monkeypatch.setattr(module, "SEGMENT", segment)
        assert long_counts(words, PieceTable(scores)) == want
    assert trie_counts(words, PieceTable(scores)).tolist() == want


def test_parts_of_a_long_text(monkeypatch):
    table = PieceTable(zipf_scores(read_pieces(VOCABULARY)))
    column = pa.array([" ".join(t for t in texts() if t)])
    ((_, _, data, offsets),) = text_blocks(column)
    whole = [n.tolist() for n in block_counts(data, offsets, table)]
    for size in (1, 100, 5000):
        monkeypatch.setattr(module, "PART_BYTES", size)
        both = [block_counts(*part, table) for part in module.parts(data, offsets)]
        assert [sum(n).tolist() for n in zip(*both)] == whole and len(both) > 1
