"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

Sizes are words. An item's window size is the largest of a ladder of sizes (each about a tenth above
the last) that it fills; every window of such a size in a document, at every word, gets a 64-bit
SimHash of its words, as do the item's own first windows (of items beyond the ladder, those of every
stretch of its last size). Two fingerprints within RADIUS bits agree
in one of RADIUS + 1 bit blocks at least, so looking up every block of a window's fingerprint finds
all item fingerprints in the radius. Each candidate is placed over the document and verified: the
weighted Jaccard similarity of the item's shingles with those of as many words of the document (a
shingle weighs 1 + log(items / items that hold it)) must reach the threshold.

An edit inside a short item moves more bits than the radius, so a second search finds what the first
misses: a place that reaches the threshold shares at least one of the item's heaviest shingles (those
that together weigh more than it may lack). Around each such shingle in a document running sums bound
the similarity of every place from above, and the places whose bound reaches the threshold are
verified. The two together find every place that the exact check accepts.

Items go to the executors in blocks of at most BLOCK_ITEMS, with a pass over the documents each whose
result is written before the next, so that neither the driver nor a task holds more than a block of
items. Documents of more than SEGMENT words are searched in segments that overlap by more than two
items, so memory doesn't grow with a text's windows. Defined cases: null texts count as empty; items without words match
nothing; items shorter than a shingle have their whole text as one; null ids and repeated rows are
rows like others. Extra columns are ignored or, when filtering, kept. An empty benchmark or table
gives no matches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .textblocks import LOWER, SHINGLE_WORDS, distinct, hashed_words, shingle_hashes, text_blocks, whole_runs
from .workspace import Workspace

RADIUS = 4
BLOCK_ITEMS = 2000
BLOCK_BYTES = 16 << 20
#: Words of a long document that are searched together.
SEGMENT = 1 << 18
#: Window sizes: all to 10, then each a tenth larger; counts of a window must fit into a byte.
LADDER = [*range(1, 11)]
while LADDER[-1] < 225:
    LADDER.append(max(LADDER[-1] + 1, int(LADDER[-1] * 1.1)))

_ONES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def _bit_blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, bits) of radius + 1 blocks that cover 64 bits."""
    edges = [round(k * 64 / (radius + 1)) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def window_fingerprints(words: np.ndarray, sizes: list[int]):
    """For each size the SimHash of every window of that many words: (size, fingerprints by first word).

    The bits of the word hashes are counted eight to a 64-bit number, one byte each, as running sums;
    a window's counts are a difference of these, and a majority shows in the top bit of its byte.
    """
    sums = np.zeros((8, len(words) + 1), np.uint64)
    for j in range(8):
        np.cumsum(words >> np.uint64(j) & _ONES, out=sums[j, 1:])
    for size in sizes:
        n = len(words) - size + 1
        if n <= 0:
            continue
        found, count = np.zeros(n, np.uint64), np.empty(n, np.uint64)
        lift = _ONES * np.uint64(127 - size // 2)
        for j in range(8):
            np.subtract(sums[j, size:], sums[j, :n], out=count)
            count += lift
            count &= _TOPS
            count >>= np.uint64(7 - j)
            found |= count
        yield size, found


@dataclass
class ItemIndex:
    """The fingerprints of a block of items by window size, with tables of their bit blocks."""

    ids: list
    lengths: list[int]
    shingles: list[dict[int, tuple[int, float]]]  # shingle -> (times, weight)
    rare: float  # the weight of a shingle that no item holds
    by_size: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)  # (fingerprint, item, first word)
    radius: int = RADIUS

    def tables(self):
        """By size: fingerprints, items, first words, and for each bit block (shift, mask, order, starts by value)."""
        out = {}
        for size, entries in self.by_size.items():
            prints = np.array([e[0] for e in entries], np.uint64)
            blocks = []
            for shift, bits in _bit_blocks(self.radius):
                value = (prints >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)
                order = np.argsort(value, kind="stable")
                blocks.append((np.uint64(shift), np.uint64((1 << bits) - 1), order, np.searchsorted(value[order], np.arange((1 << bits) + 1)).astype(np.int32)))
            out[size] = (prints, np.array([e[1] for e in entries]), np.array([e[2] for e in entries]), blocks)
        return out


class SharedShingles:
    """The shingles of which a place that reaches the threshold holds one at least, and the bound of its similarity."""

    def __init__(self, index: ItemIndex, threshold: float, words: int):
        self.index, self.threshold, self.words = index, threshold, words
        self.weights: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}
        needed: dict[int, list[tuple[int, int]]] = {}
        for item, held in enumerate(index.shingles):
            keys = needed.setdefault(min(words, index.lengths[item]), [])
            room = (1 - threshold) * sum(t * w for t, w in held.values()) * (1 + 1e-9)
            for s, (times, weight) in sorted(held.items(), key=lambda x: (-x[1][1], x[0])):
                keys.append((s, item))
                room -= times * weight
                if room < 0:
                    break
        self.needed = {}  # by words of a run: sorted shingles, their items, and which top bits occur
        for size, keys in needed.items():
            keys.sort()
            values = np.array([k[0] for k in keys], np.uint64)
            some = np.zeros(1 << 18, bool)
            some[values >> np.uint64(46)] = True
            self.needed[size] = (values, np.array([k[1] for k in keys]), some)

    def places(self, hashed: np.ndarray, first: np.ndarray):
        """(document, item, first and last place of needed shingles close to each other, runs of the block)."""
        for size, (values, owners, some) in self.needed.items():
            if len(hashed) < size:
                continue
            runs = next(shingle_hashes(hashed, np.array([0, len(hashed)]), size)) if size == self.words else whole_runs(hashed, np.arange(len(hashed) - size + 1), size)
            at = np.flatnonzero(some[runs >> np.uint64(46)])
            low = np.searchsorted(values, runs[at])
            count = np.searchsorted(values, runs[at], side="right") - low
            doc = np.searchsorted(first, at, side="right") - 1
            count[at + size > first[doc + 1]] = 0
            entry = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            at, doc, item = np.repeat(at, count), np.repeat(doc, count), owners[entry]
            order = np.lexsort((at, item))
            at, doc, item = at[order], doc[order], item[order]
            length = np.array(self.index.lengths)[item]
            far = 0 if size < self.words else 2 * length[1:]
            cuts = np.flatnonzero((np.diff(item) != 0) | (np.diff(doc) != 0) | (np.diff(at) > far)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(at)], strict=True):
                if b > a:
                    yield int(doc[a]), int(item[a]), int(at[a]), int(at[b - 1]), runs

    def bounds(self, item: int, low: int, high: int, start: int, end: int, runs: np.ndarray, opens: bool, closes: bool):
        """First words (of places with needed shingles from low to high in a text of words start to end) and bounds that reach the threshold, highest first."""
        n, words = self.index.lengths[item], self.words
        if n < words:
            return [(low, 1.0)]
        if item not in self.weights:
            held = self.index.shingles[item]
            values = np.array(sorted(held), np.uint64)
            self.weights[item] = values, np.array([held[int(s)][1] for s in values]), sum(t * w for t, w in held.values())
        values, weights, whole = self.weights[item]
        at = np.arange(max(low, start) - (n - words), min(high, end - words) + 1)
        a, b = np.maximum(at, start), np.minimum(at + n, end) - words + 1
        fits = (b > a) & (opens | (at >= start)) & (closes | (at + n <= end))
        if not fits.any():
            return []
        at, a, b = (x[fits] for x in (at, a, b))
        part = runs[a[0] : b[-1]]
        near = np.minimum(np.searchsorted(values, part), len(values) - 1)
        known = values[near] == part
        shared = np.r_[0, np.cumsum(np.where(known, weights[near], 0))]
        every = np.r_[0, np.cumsum(np.where(known, weights[near], self.index.rare))]
        a, b = a - a[0], b - a[0]
        both = np.minimum(shared[b] - shared[a], whole)
        bound = both / (whole + every[b] - every[a] - both)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] >= self.threshold - 1e-9]
        return list(zip(at[order].tolist(), bound[order].tolist(), strict=True))


def _shingle_counts(text_words: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    runs = next(shingle_hashes(text_words, np.array([0, len(text_words)]), words))
    return np.unique(runs, return_counts=True)


def _words_of(column: pa.Array):
    for row, end, data, offsets in text_blocks(column):
        yield row, end, *hashed_words(LOWER[data], offsets)


def item_blocks(work: Workspace, benchmark: DataFrame, id_col: str, text_col: str, words: int, radius: int):
    """Yield an ItemIndex for each block of the benchmark; weights come from all its items."""
    kind = benchmark.schema[id_col].dataType.simpleString()

    def split(batches):
        for batch in batches:
            lists, runs = [], []
            for _, _, hashed, first in _words_of(batch.column(1)):
                lists += [hashed[a:b].view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
                runs += [distinct(x).view(np.int64) for x in shingle_hashes(hashed, first, words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64())), pa.array(runs, pa.list_(pa.int64()))], ["id", "words", "shingles"])

    texts = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    items = texts.mapInArrow(split, f"id {kind}, words array<bigint>, shingles array<bigint>").filter("size(words) > 0")
    items = work.table(items.withColumn("row", F.monotonically_increasing_id()), "items")
    n, size = items.agg(F.count(F.lit(1)), F.sum(F.size("words"))).first()
    if not n:
        return
    parts = max(math.ceil(n / BLOCK_ITEMS), math.ceil(size * 16 / BLOCK_BYTES))
    places = items.select("row", F.explode("shingles").alias("shingle"))
    held = places.groupBy("shingle").agg(F.count(F.lit(1)).alias("items"))
    weights = places.join(held, "shingle").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("shingle", (1 + F.log(F.lit(float(n)) / F.col("items"))).alias("w")))).alias("weights"))
    ready = work.table(items.join(weights, "row").select("id", "words", "weights", F.expr(f"pmod(xxhash64(row), {parts})").alias("part")), "ready")
    for part in range(parts):
        index = ItemIndex([], [], [], 1 + math.log(n), radius=radius)
        for item, row in enumerate(ready.filter(F.col("part") == part).orderBy("id").toLocalIterator()):
            hashed = np.array(row["words"], np.int64).view(np.uint64)
            index.ids.append(row["id"])
            index.lengths.append(len(hashed))
            index.shingles.append({int(s): (int(c), row["weights"][int(np.uint64(s).astype(np.int64))]) for s, c in zip(*_shingle_counts(hashed, words), strict=True)})
            size = max(s for s in LADDER if s <= len(hashed))
            for begin in range(0, len(hashed) - size + 1, size):  # several stretches in items beyond the ladder
                for _, prints in window_fingerprints(hashed[begin : begin + size + size // 10 + 1], [size]):
                    index.by_size.setdefault(size, []).extend((int(p), item, begin + at) for at, p in enumerate(prints))
        yield index
    work.drop("items", "ready")


def _segments(hashed: np.ndarray, first: np.ndarray, overlap: int):
    """Yield (words, first, whether the document starts here, whether it ends here): a block, or the segments of one long text."""
    if len(first) > 2 or len(hashed) <= SEGMENT + overlap:
        yield hashed, first, True, True
        return
    for low in range(0, len(hashed) - overlap, SEGMENT):
        part = hashed[low : low + SEGMENT + overlap]
        yield part, np.array([0, len(part)]), low == 0, low + len(part) == len(hashed)


def _matches(column: pa.Array, index: ItemIndex, tables: dict, shared: SharedShingles, threshold: float, words: int):
    """(row, item) -> the best similarity that reaches the threshold."""
    best: dict[tuple[int, int], float] = {}
    overlap = 2 * max(index.lengths) + 2 * max(LADDER)
    for row, _, block, starts_of in _words_of(column):
        for hashed, first, opens, closes in _segments(block, starts_of, overlap):
            tried: dict[tuple[int, int], int] = {}  # place and item -> a window there
            for size, prints in window_fingerprints(hashed, list(tables)):
                known, items, offsets, blocks = tables[size]
                for shift, mask, order, starts in blocks:
                    value = (prints >> shift & mask).astype(np.int32)
                    low = starts[value]
                    some = np.flatnonzero(starts[value + 1] > low)
                    if not len(some):
                        continue
                    count = starts[value[some] + 1] - low[some]
                    window = np.repeat(some, count)
                    entry = order[np.repeat(low[some] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())]
                    near = np.bitwise_count(prints[window] ^ known[entry]) <= index.radius
                    places = zip((window[near] - offsets[entry[near]]).tolist(), items[entry[near]].tolist(), strict=True)
                    tried.update(zip(places, window[near].tolist(), strict=True))

            def judge(doc: int, item: int, at: int) -> None:
                a, b = max(at, int(first[doc])), min(at + index.lengths[item], int(first[doc + 1]))
                if b > a and (opens or at >= 0) and (closes or at + index.lengths[item] <= len(hashed)):
                    likeness = similarity(hashed[a:b], index.shingles[item], index.rare, words)
                    if likeness >= threshold and likeness > best.get((row + doc, item), 0):
                        best[row + doc, item] = likeness

            found: dict[tuple[int, int], list[int]] = {}
            for (at, item), window in tried.items():
                found.setdefault((int(np.searchsorted(first, window, side="right")) - 1, item), []).append(at)
            searched = list(shared.places(hashed, first))
            runs = next(shingle_hashes(hashed, np.array([0, len(hashed)]), words)) if found else None
            for (doc, item), places in found.items():
                room = index.lengths[item] - words
                if room < 0:
                    for at in places:
                        judge(doc, item, at)
                else:  # the places between the first and the last of each run of near ones
                    places.sort()
                    cuts = [0, *[k for k in range(1, len(places)) if places[k] - places[k - 1] > index.lengths[item]], len(places)]
                    searched += [(doc, item, places[x] + room, places[y - 1], runs) for x, y in zip(cuts, cuts[1:], strict=False)]
            for doc, item, low, high, runs in searched:
                start, end = int(first[doc]), int(first[doc + 1])
                for at, bound in shared.bounds(item, low, high, start, end, runs, opens, closes):
                    if bound <= best.get((row + doc, item), 0) + 1e-9:
                        break
                    judge(doc, item, at)
    return best


def similarity(window: np.ndarray, item: dict[int, tuple[int, float]], rare: float, words: int) -> float:
    """Weighted Jaccard similarity of the shingle multisets of a window and an item."""
    both = either = 0.0
    values, counts = _shingle_counts(window, words)
    rest = dict(item)
    for s, c in zip(values.tolist(), counts.tolist(), strict=True):
        times, weight = rest.pop(s, (0, rare))
        both += weight * min(c, times)
        either += weight * max(c, times)
    either += sum(times * weight for times, weight in rest.values())
    return both / either if either else 0.0


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", *, threshold: float = 0.8, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(id, item id, similarity), one row for each document row and benchmark item that it holds."""
    texts = docs.select(F.col(id_col).alias("a"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField(item_id_col, benchmark.schema[item_id_col].dataType), StructField("similarity", DoubleType())])
    work, waiting, several = Workspace(docs.sparkSession), None, False
    for index in item_blocks(work, benchmark, item_id_col, item_text_col, words, radius):
        if waiting is not None:  # of several blocks each is searched and its finds written before the next one is made
            work.append(waiting, "found")
            several = True
        waiting = texts.mapInArrow(_finder(index, schema, threshold, words), schema)
    if waiting is None:
        return docs.sparkSession.createDataFrame([], schema)
    if not several:
        return waiting
    work.append(waiting, "found")
    return work.appended("found", schema)


def _finder(index: ItemIndex, schema: StructType, threshold: float, words: int):
    from pyspark.sql.pandas.types import to_arrow_type

    item_type, names = to_arrow_type(schema.fields[1].dataType), schema.names

    def find(batches):
        tables, shared = index.tables(), SharedShingles(index, threshold, words)
        for batch in batches:
            best = _matches(batch.column(1), index, tables, shared, threshold, words)
            at = sorted(best)
            ids = batch.column(0).take(pa.array([r for r, _ in at], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([index.ids[i] for _, i in at], item_type), pa.array([best[x] for x in at], pa.float64())], names)

    return find


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", *, threshold: float = 0.8, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns."""
    work = Workspace(docs.sparkSession)
    for k, index in enumerate(item_blocks(work, benchmark, item_id_col, item_text_col, words, radius)):

        def keep(batches, index=index):
            tables, shared = index.tables(), SharedShingles(index, threshold, words)
            for batch in batches:
                best = _matches(batch.column(batch.schema.get_field_index(text_col)), index, tables, shared, threshold, words)
                clean = np.ones(batch.num_rows, bool)
                clean[[r for r, _ in best]] = False
                yield batch.filter(pa.array(clean))

        if k:  # what earlier blocks leave is written before the next one is searched
            docs = work.table(docs, f"kept-{k}")
            if k > 1:
                work.drop(f"kept-{k - 1}")
        docs = docs.mapInArrow(keep, docs.schema)
    return docs
