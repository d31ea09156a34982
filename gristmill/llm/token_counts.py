"""Token counts under a unigram segmentation, with forward scores shared along a trie of pre-tokens.

A pre-token is a word with its leading word mark. The pieces are those of a public vocabulary file;
a piece's log-probability follows Zipf's law over its rank in the file. Of the segmentations of a
pre-token the one with the highest score counts, of equal ones the one with fewest tokens. Text
that no piece covers falls back to one token a UTF-8 byte, at FALLBACK a character.

A task inserts the distinct pre-tokens of a part of its texts in a trie, level by level over sorted
arrays, and computes the best score of each node once for all pre-tokens below it, from its
ancestors one piece back. Terminal nodes keep the counts, which are summed by text. Pre-tokens of
more than LEVELS characters would make levels of one node each; their pieces are looked up for all
places of a segment at once, then the scores run along it, and a pre-token starts from the segment up
to which it has the same characters as the one before. Nothing is shuffled, and memory is bounded by
the part (PART_BYTES, or the longest pre-token).

Defined cases: null and empty texts and texts of white space count 0; very long words are words
like others; null ids and repeated rows are rows like others; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import mix64, text_blocks, word_bounds, word_end, word_hashes

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
PART_BYTES = 8 << 20
MARK = "▁"
#: Scores are whole millionths, so that equal scores are equal whatever the order of adding.
UNIT = 1_000_000
FALLBACK = -20 * UNIT
#: Characters up to which pre-tokens go through the trie level by level, and those of a segment of longer ones.
LEVELS, SEGMENT = 128, 4096

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def zipf_scores(pieces: list[str]) -> dict[str, int]:
    """Score of each piece by its rank; the shares 1 / (rank + 2.7) add up to 1."""
    whole = sum(1 / (r + 2.7) for r in range(1, len(pieces) + 1))
    return {p: round(UNIT * -math.log((r + 2.7) * whole)) for r, p in enumerate(pieces, 1)}


def read_pieces(path: str) -> list[str]:
    """The normal pieces of a sentencepiece model file in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class _Hashes:
    """Hashes of any stretch of an array of code points."""

    def __init__(self, points: np.ndarray):
        n = len(points) + 1
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        up, self.down = np.cumprod(up), np.cumprod(down)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(mix64(points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


class PieceTable:
    """By length in characters: the hashes of the pieces, ascending, and their scores."""

    def __init__(self, scores: dict[str, int]):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in sorted({len(p) for p in scores}):
            pieces = [p for p in scores if len(p) == k]
            points = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
            at = np.arange(len(pieces)) * k
            hashed = _Hashes(points).of(at, at + k)
            order = np.argsort(hashed)
            self.by_length[k] = hashed[order], np.array([scores[p] for p in pieces])[order]


@lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    return PieceTable(zipf_scores(read_pieces(path)))


def trie_counts(words: list[str], table: PieceTable) -> np.ndarray:
    """The number of tokens of each of the distinct, ascending words (with their marks)."""
    if not words:
        return np.zeros(0, np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    length = np.array([len(w) for w in words])
    start = np.cumsum(length) - length
    hashes = _Hashes(points)
    fallback = _fallback(points)
    # Best score and count of each prefix: place start + word index + characters, so that the empty prefix has a place, too.
    base = start + np.arange(len(words))
    score, count = np.zeros(len(points) + len(words), np.int64), np.zeros(len(points) + len(words), np.int64)
    alive, same = np.arange(len(words)), np.zeros(len(words), bool)
    same[1:] = True  # the empty prefix is shared by all
    for depth in range(int(length.max())):
        alive = alive[length[alive] > depth]
        before = alive - 1
        shared = same[alive] & (length[before] > depth) & (alive > 0)
        shared[shared] = points[start[alive[shared]] + depth] == points[start[before[shared]] + depth]
        same[alive] = shared
        node = alive[~shared]  # the first word below each node of this level
        end = start[node] + depth + 1
        best = score[base[node] + depth] + FALLBACK
        tokens = count[base[node] + depth] + fallback[end - 1]
        for k, (known, values) in table.by_length.items():
            if k > depth + 1:
                break
            wanted = hashes.of(end - k, end)
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            hit = np.flatnonzero(known[at] == wanted)
            if len(hit):
                back = base[node[hit]] + depth + 1 - k
                s, c = score[back] + values[at[hit]], count[back] + 1
                better = (s > best[hit]) | (s == best[hit]) & (c < tokens[hit])
                best[hit[better]], tokens[hit[better]] = s[better], c[better]
        group = np.cumsum(~shared) - 1  # the node of every word that goes on
        score[base[alive] + depth + 1], count[base[alive] + depth + 1] = best[group], tokens[group]
    return count[base + length]


def _fallback(points: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of each character."""
    return np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))


def long_counts(words: list[str], table: PieceTable) -> list[int]:
    """As trie_counts for long words: the states (scores and counts of the last places) before each segment are kept for the next word."""
    reach = max(table.by_length, default=1)
    out, last, states = [], "", []
    for word in words:
        shared = 0
        while shared < len(states) - 1 and word[shared * SEGMENT : (shared + 1) * SEGMENT] == last[shared * SEGMENT : (shared + 1) * SEGMENT] and len(word) > (shared + 1) * SEGMENT:
            shared += 1
        states, last = states[: shared + 1] or [([0], [0])], word
        for low in range(shared * SEGMENT, len(word), SEGMENT):
            before = min(low, reach)
            points = np.frombuffer(word[low - before : low + SEGMENT].encode("utf-32-le"), np.uint32)
            hashes, bytes_ = _Hashes(points), _fallback(points).tolist()
            found: list[list[tuple[int, int]]] = [[] for _ in points]
            for k, (known, values) in table.by_length.items():
                if k <= len(points):
                    end = np.arange(max(k, before + 1), len(points) + 1)
                    wanted = hashes.of(end - k, end)
                    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                    for e, value in zip(end[known[at] == wanted].tolist(), values[at[known[at] == wanted]].tolist(), strict=True):
                        found[e - 1].append((k, value))
            score, count = (list(x) for x in states[-1])  # of the empty prefix or the last places before the segment
            shift = len(score) - 1 - before
            for e in range(before + 1, len(points) + 1):
                best, tokens = score[e - 1 + shift] + FALLBACK, count[e - 1 + shift] + bytes_[e - 1]
                for k, value in found[e - 1]:
                    s, c = score[e - k + shift] + value, count[e - k + shift] + 1
                    if s > best or s == best and c < tokens:
                        best, tokens = s, c
                score.append(best)
                count.append(tokens)
            states.append((score[-reach - 1 :], count[-reach - 1 :]))
        out.append(states[-1][1][-1])
    return out


def parts(data: np.ndarray, offsets: np.ndarray):
    """A block as it is, but a longer text in parts of about PART_BYTES that cut no word."""
    if len(offsets) > 2 or len(data) <= PART_BYTES:
        yield data, offsets
        return
    low = 0
    while low < len(data):
        high = len(data) if low + PART_BYTES >= len(data) else word_end(data, offsets, low + PART_BYTES)
        yield data[low:high], np.array([0, high - low])
        low = high


def block_counts(data: np.ndarray, offsets: np.ndarray, table: PieceTable) -> tuple[np.ndarray, np.ndarray]:
    """Words and tokens of each text of a block."""
    starts, ends, first = word_bounds(data, offsets)
    _, one, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    words = [MARK + data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
    order = sorted(range(len(words)), key=words.__getitem__)
    counts = np.zeros(len(words), np.int64)
    for some, count in (([i for i in order if len(words[i]) <= LEVELS], trie_counts), ([i for i in order if len(words[i]) > LEVELS], long_counts)):
        counts[some] = count([words[i] for i in some], table)
    total = np.r_[0, np.cumsum(counts[inverse])]
    return np.diff(first), total[first[1:]] - total[first[:-1]]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_words, n_tokens) for each row. The vocabulary file must be at the same path on every executor."""
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches):
        table = piece_table(vocabulary)
        for batch in batches:
            tokens, words = [], []
            for _, _, data, offsets in text_blocks(batch.column(1), PART_BYTES):
                both = [block_counts(*part, table) for part in parts(data, offsets)]
                words.append(sum(n for n, _ in both))
                tokens.append(sum(n for _, n in both))
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([none, *words])), pa.array(np.concatenate([none, *tokens]))], ["id", "n_words", "n_tokens"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(count, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
