"""N-gram Jaccard self-join by vertical partitioning of the shingle order.

Texts become sets of 64-bit shingle hashes; rows with the same set are one node. The work then
follows the global order of shingles, rare ones first, which is cut into fragments:

1. *Shared counts by hash fragments.* Each fragment (a range of the hash space, sized by the corpus)
   counts for every text how many of its shingles there stand in another text, too. Summed over the
   fragments, a text with less than the similarity's share of shared shingles can't link to any
   other and leaves. In a batch of texts a shingle is counted before it is sent, so a shingle in
   a third of all texts arrives once a batch.
2. *Prefixes.* For the texts left, exact document frequencies order the shingles; two sets that
   link share one of the first ``n - ceil(s * n) + 1`` shingles of both.
3. *Partial overlaps.* Candidate pairs meet fragment by fragment (fragments of the global order are
   cut at powers of two of the frequency); each gives a partial overlap, the sum decides exactly.
   First each text meets one centre: of the texts with the commonest shingles among those that
   share a prefix shingle with it, the one it shares most with. What links merges, so a group of
   thousands of near copies takes as many pairs as it has texts.
4. *Blocks.* Then every two texts of different components that share a prefix shingle are compared,
   blocks of texts at a time inside tasks, fragment by fragment as well; a link comes out for each
   two components that a task finds to be one. Pairs inside a component can't change components; no
   pair across components is left out.

Defined cases: a null text counts as empty; a text without words has an empty set and is a component
of its own. A null id is no smallest id: a component with null ids only has a null component_id.
Repeated rows are one node, each gets its row. Extra columns are ignored, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .textblocks import LOWER, SHINGLE_WORDS, distinct, hashed_words, shingle_hashes, text_blocks
from .workspace import Workspace, broadcast_if_small, without

#: Texts of a batch that are counted together before their shingles are sent, and bytes of these.
SUB_ROWS, SUB_BYTES = 16384, 6 << 20
#: Shingles that a fragment of the hash space gets on average, at most.
FRAGMENT_SHINGLES = 2_000_000
#: Texts that meet one copy of their centre's segments.
STAR_TEXTS = 256
#: Texts and shingles of a block of texts that are compared with another block in one task.
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 500_000
#: The fragment of the global order that an entry (df, shingle) falls into.
BAND = "int(log2(e.df))"
_NO_ROW = 0xFFFF


def shingle_sets(column: pa.Array, words: int = SHINGLE_WORDS):
    """The sorted distinct shingle hashes of each text of an Arrow column."""
    for _, _, data, offsets in text_blocks(column):
        for runs in shingle_hashes(*hashed_words(LOWER[data], offsets), words):
            yield distinct(runs)


def _sub_batches(batch: pa.RecordBatch, text: int):
    """Cut a batch where the rows or the bytes of its texts get too many."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + SUB_ROWS]), SUB_BYTES)))
        yield batch.slice(at, min(end, batch.num_rows) - at)
        at = end


_HEAD = ("ids", "keys", "sizes", "signs", "own", "shared")
_BLANK = [pa.nulls(1, pa.binary())] * 5


def _one(values: np.ndarray) -> pa.Array:
    return pa.array([values.tobytes()], pa.binary())


def _pieces(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes between every two edges of an array."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _send(fragments: int, words: int, id_type: pa.DataType):
    """Map texts, block by block, to a row for each fragment that their shingles fall into, and one with the block's head.

    A block numbers its distinct sets; fragments name them by number. ``own`` is the number of each
    text's set (-1 for an empty one), ``shared`` counts what the block's other sets hold, too.
    """
    width = (1 << 64) // fragments + 1
    lows = np.array([k * width for k in range(fragments)], np.uint64)
    names = ["fragment", "block", "nodes", "shingles", *_HEAD]

    def send(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in _sub_batches(whole, 1):
                block += 1
                sets, own, sizes, signs, seen = [], [], [], [], {}
                for s in shingle_sets(batch.column(1), words):
                    sign = xxhash.xxh3_128_digest(s)
                    signs.append(sign)
                    sizes.append(len(s))
                    if len(s) and sign not in seen:
                        seen[sign] = len(sets)
                        sets.append(s)
                    own.append(seen[sign] if len(s) else -1)
                shared, many = np.zeros(len(sets), np.int64), len(sets)
                if sets:
                    values, owner = sets[0], np.zeros(len(sets[0]), np.uint16)
                    if len(sets) > 1:
                        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
                        order = np.argsort(values)
                        values, owner = values[order], owner[order]
                    sets.clear()
                    new = np.r_[True, values[1:] != values[:-1]]
                    several = ~(new & np.r_[new[1:], True])
                    shared += np.bincount(owner[several], minlength=many)
                    owner[several] = _NO_ROW  # counted here already; sent once, for the other blocks
                    values, owner = values[new], owner[new]
                    edges = np.append(np.searchsorted(values, lows), len(values))
                    part = (values - np.repeat(lows, np.diff(edges))) * np.uint64(fragments) >> np.uint64(32)  # 32 bits inside the fragment
                    some = np.flatnonzero(np.diff(edges))
                    edges, n = np.append(edges[some], len(values)), len(some)
                    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(n, block)), _pieces(owner, edges), _pieces(part.astype(np.uint32), edges), pa.nulls(n, pa.list_(id_type)), *[pa.nulls(n, pa.binary())] * 5], names)
                ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
                head = [ids, _one(np.asarray(batch.column(2)).astype(np.int64)), _one(np.array(sizes, np.int64)), pa.array([b"".join(signs)], pa.binary()), _one(np.array(own, np.int64)), _one(shared)]
                yield pa.RecordBatch.from_arrays([pa.array([-1 - block % fragments], pa.int32()), pa.array([block]), *_BLANK[:2], *head], names)

    return send


def _count(table: pa.Table) -> pa.Table:
    """Of a fragment: a row for each block, with the numbers of its sets and how many of their shingles here another block has. Heads pass."""
    names = ["block", "nodes", *_HEAD]
    if table.column("fragment")[0].as_py() < 0:
        return table.select(names)
    lists = [np.frombuffer(x, np.uint16).astype(np.int64) for x in table.column("nodes").to_pylist()]
    base = np.arange(len(lists)) * SUB_ROWS
    owner = np.concatenate([np.where(x == _NO_ROW, -1, x + b) for x, b in zip(lists, base, strict=True)])
    values = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("shingles").to_pylist()])
    order = np.argsort(values)
    values, owner = values[order], owner[order]
    new = np.r_[True, values[1:] != values[:-1]]
    several = np.sort(owner[~(new & np.r_[new[1:], True]) & (owner >= 0)])
    cuts = np.searchsorted(several, np.r_[base, len(lists) * SUB_ROWS])
    packed = [(several[a:b] - x).astype(np.uint16).tobytes() for a, b, x in zip(cuts[:-1], cuts[1:], base, strict=True)]
    ids = table.schema.field("ids").type
    return pa.table([table.column("block"), pa.array(packed, pa.binary()), pa.nulls(len(lists), ids), *[pa.nulls(len(lists), pa.binary())] * 5], names)


def _rows(percent: int):
    """Of a block: its texts, each with whether enough of its shingles stand in others to link."""

    def rows(table: pa.Table) -> pa.Table:
        head = next(k for k, x in enumerate(table.column("own").to_pylist()) if x is not None)
        ids = table.column("ids").slice(head, 1).combine_chunks().flatten()
        keys, sizes, own, shared = (np.frombuffer(table.column(c)[head].as_py(), np.int64) for c in ("keys", "sizes", "own", "shared"))
        total = np.append(shared, 0)
        for x in table.column("nodes").to_pylist():
            if x:
                total += np.bincount(np.frombuffer(x, np.uint16), minlength=len(total))
        signs = table.column("signs")[head].as_py()
        alive = (own >= 0) & (100 * total[own] >= percent * sizes)
        return pa.table([ids, pa.array(keys), pa.array(sizes), pa.array([signs[i : i + 16] for i in range(0, len(signs), 16)], pa.binary()), pa.array(alive)], ["id", "key", "n", "sign", "alive"])

    return rows


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 80, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, and ``text_key``, a hash of the text.

    Sets link when ``100 * intersection >= percent * union``; component_id is the smallest id reachable.
    """
    return _solve(docs, id_col, text_col, percent, words).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("key").alias("text_key"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 80, words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id stays (a null id is the largest)."""
    work = Workspace(docs.sparkSession)
    found = _solve(docs, id_col, text_col, percent, words)
    decided = work.table(found.filter("members > 1").select(F.col("id").alias(id_col), F.col("key").alias("digest"), F.expr("id <=> first_id AND key = first_key").alias("kept")), "decided")
    repeated = work.table(decided.filter("kept").groupBy(id_col, "digest").count().filter("count > 1").select(id_col, "digest"), "repeated")
    return without(docs, decided.filter("not kept").select(id_col, "digest"), repeated, _text_key(text_col))


def _text_key(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _solve(docs: DataFrame, id_col: str, text_col: str, percent: int, words: int) -> DataFrame:
    spark = docs.sparkSession
    work = Workspace(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), _text_key(text_col).alias("key"))
    kind = texts.schema["id"].dataType.simpleString()
    arrow_id = _arrow_type(texts)

    # 1. Shared counts by fragments of the hash space.
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / 6 / FRAGMENT_SHINGLES))
    head = f"ids array<{kind}>, keys binary, sizes binary, signs binary, own binary, shared binary"
    sent = texts.mapInArrow(_send(fragments, words, arrow_id), f"fragment int, block long, nodes binary, shingles binary, {head}")
    counted = sent.groupBy("fragment").applyInArrow(_count, f"block long, nodes binary, {head}")
    rows = counted.groupBy("block").applyInArrow(_rows(percent), f"id {kind}, key long, n long, sign binary, alive boolean")
    rows = work.table(rows, "rows")
    alive = rows.filter("alive").groupBy("sign").agg(F.min(F.struct("id", "key")).alias("one"))
    alive = work.table(alive.select("sign", F.col("one.id").alias("one_id"), F.col("one.key").alias("one_key")), "alive")

    # The sets of these texts, one for each distinct set.
    pick = broadcast_if_small(alive.select("one_id", "one_key"), "one_id")

    def sets_of(batches):
        for batch in batches:
            sets, signs = [], []
            for s in shingle_sets(batch.column(0), words):
                sets.append(s.view(np.int64))
                signs.append(xxhash.xxh3_128_digest(s))
            yield pa.RecordBatch.from_arrays([pa.array(signs, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["sign", "n", "shingles"])

    sets = texts.join(pick, texts["id"].eqNullSafe(pick["one_id"]) & (texts["key"] == pick["one_key"]), "left_semi").select("text").mapInArrow(sets_of, "sign binary, n long, shingles array<bigint>")
    sets = work.table(sets.dropDuplicates(["sign"]).withColumn("node", F.monotonically_increasing_id()), "sets")

    # 2. Frequencies among them give the global order.
    places = sets.select("node", "n", F.explode("shingles").alias("shingle"))
    often = work.table(places.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "often")
    ordered = places.join(often, "shingle").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("order"))
    ordered = ordered.filter(f"100 * size(order) >= {percent} * n").withColumn("common", F.expr("aggregate(order, 0D, (s, e) -> s + e.df) / n"))
    ordered = work.table(ordered, "ordered")
    # Shingles of no other text come first in the order and meet nothing; the prefix's rest is counted from there.
    prefix = f"size(order) - ({percent} * n + 99) div 100 + 1"
    heads = ordered.select("node", "n", "common", F.size("order").alias("rest"), F.posexplode(F.expr(f"slice(order, 1, int({prefix}))")).alias("at", "e"))
    # Early: with all shingles from here on shared, a text of the same size would link. Of a pair that links, the
    # first shared shingle is early in one of them at least, as else the smaller one hasn't enough left.
    early = F.expr(f"(rest - at) * (100 + {percent}) >= 2 * {percent} * n")
    heads = work.table(heads.select("node", "n", "common", F.col("e.shingle").alias("shingle"), early.alias("early")), "heads")

    # 3. Each text with the best of the centres of its prefix shingles; a shingle's centre is its text with the commonest shingles.
    centre = heads.groupBy("shingle").agg(F.max_by(F.struct("node", "n"), F.struct("common", "node")).alias("c"), F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    met = heads.join(work.table(centre.select("shingle", "c"), "centres"), "shingle").filter("node <> c.node")
    met = met.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("c.node").alias("b"), F.col("c.n").alias("nb")).filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    votes = met.groupBy("a", "na", "b", "nb").agg(F.count(F.lit(1)).alias("votes"))
    stars = work.table(votes.groupBy("a", "na").agg(F.max(F.struct("votes", "b", "nb")).alias("c")).select("a", "na", F.col("c.b").alias("b"), F.col("c.nb").alias("nb")), "stars")
    found = work.table(_linked(ordered, stars, percent), "star-links")
    labels = ordered.select("node", "n", F.col("node").alias("label"))
    if not found.isEmpty():
        labels = _relabelled(work, labels, found, "stars")

    # 4. All pairs across components that share a prefix shingle, block by block.
    now = work.table(heads.select("node", "shingle", "early").join(labels, "node"), "now")
    mixed = now.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("early").alias("early")).filter("early AND low < high").select("shingle")
    open_ = work.table(now.join(work.table(mixed, "mixed"), "shingle", "left_semi"), "open")
    if not open_.isEmpty():
        found = work.table(_across(work, ordered, open_, stars, percent), "block-links")
        if not found.isEmpty():
            ends = labels.select("node", "label")
            edges = found.join(ends.toDF("a", "la"), "a").join(ends.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
            roots = components(work, edges, "blocks").toDF("label", "root")
            labels = work.table(labels.join(roots, "label", "left").select("node", "n", F.coalesce("root", "label").alias("label")), "labels")

    # The set of the least node of a component names it; a set that links with no other names itself.
    named = labels.join(sets.select("node", "sign"), "node")
    name = sets.select(F.col("node").alias("label"), F.col("sign").alias("name"))
    names = work.table(named.join(name, "label").select("sign", "name").filter("sign <> name"), "names")
    placed = work.table(rows.join(names, "sign", "left").select("id", "key", "n", F.when(F.col("n") > 0, F.coalesce("name", "sign")).alias("name")), "placed")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    groups = placed.filter("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("least_id"), first.alias("first")).filter("members > 1")
    groups = work.table(groups.select("name", "members", "least_id", F.col("first.id").alias("first_id"), F.col("first.key").alias("first_key")), "groups")
    work.keep("placed", "groups")
    return placed.join(groups, "name", "left").select("id", "key", "n", F.coalesce("members", F.lit(1).cast("long")).alias("members"), F.expr("if(members is null, id, least_id)").alias("component_id"), "first_id", "first_key")


def _relabelled(work: Workspace, labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    roots = components(work, links, name).toDF("node", "root")
    return work.table(labels.join(roots, "node", "left").select("node", "n", F.coalesce("root", "label").alias("label")), f"{name}-labels")


def _linked(ordered: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Sum the partial overlaps of pairs (a, na, b, nb) over the fragments of the order; keep those that link."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    segments = ordered.join(ends, "node", "left_semi").select("node", F.explode("order").alias("e")).select("node", F.expr(BAND).alias("band"), F.col("e.shingle").alias("shingle"))
    segments = segments.groupBy("node", "band").agg(F.collect_list("shingle").alias("segment"))
    # A centre of many texts has a copy of its segments for each STAR_TEXTS of them, so that they meet in several tasks.
    copies = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / STAR_TEXTS).cast("int").alias("copies"))
    pairs = pairs.join(copies, "b").withColumn("copy", F.expr("int(pmod(xxhash64(a), copies))")).drop("copies")
    left = segments.select(F.col("node").alias("a"), "band", F.col("segment").alias("of_a"))
    right = segments.join(copies, F.col("node") == F.col("b")).select("b", "band", F.explode(F.expr("sequence(0, copies - 1)")).alias("copy"), F.col("segment").alias("of_b"))
    part = pairs.join(left, "a").join(right, ["b", "band", "copy"]).select("a", "na", "b", "nb", F.size(F.array_intersect("of_a", "of_b")).alias("overlap"))
    total = part.groupBy("a", "na", "b", "nb").agg(F.sum("overlap").alias("overlap"))
    return total.filter(f"100 * overlap >= {percent} * (na + nb - overlap)").select("a", "b")


def _across(work: Workspace, ordered: DataFrame, open_: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, from every two texts that share a shingle of ``open_``.

    Texts with the same centre stand in blocks of bounded size. Two blocks meet in one task when
    texts of different components in them share a shingle that is early in one of the blocks; pairs are
    counted there, in numpy, and only links come out.
    """
    texts = open_.select("node", "n", "label").distinct().join(stars.select(F.col("a").alias("node"), F.col("b").alias("centre")), "node", "left")
    texts = work.table(texts.withColumn("centre", F.coalesce("centre", "node")), "block-texts")
    parts = texts.groupBy("centre").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    texts = texts.join(work.table(parts, "block-parts"), "centre").select("node", "n", "label", F.expr("xxhash64(centre, pmod(xxhash64(node), parts))").alias("block"))
    texts = work.table(texts, "blocks")
    kinds = open_.join(texts.select("node", "block"), "node").groupBy("shingle", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("early").alias("early"))
    kinds = work.table(kinds, "block-kinds")
    meet = kinds.alias("x").join(kinds.alias("y"), "shingle").filter("(x.early OR y.early) AND (x.block < y.block AND NOT (x.low = x.high AND y.low = y.high AND x.low = y.low) OR x.block = y.block AND x.low < x.high)")
    pairs = work.table(meet.select(F.col("x.block").alias("p"), F.col("y.block").alias("q")).distinct(), "block-pairs")
    full = texts.join(ordered.select("node", F.expr("transform(order, e -> e.shingle)").alias("shingles"), F.expr(f"transform(order, e -> {BAND})").alias("bands")), "node")
    full = work.table(full, "block-sets")
    sent = pairs.join(full, pairs["p"] == full["block"]).withColumn("side", F.lit(0)).union(pairs.filter("p <> q").join(full, F.col("q") == F.col("block")).withColumn("side", F.lit(1)))

    def compare(table: pa.Table) -> pa.Table:
        a, b = _compare(table, percent)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return sent.drop("block").groupBy("p", "q").applyInArrow(compare, "a long, b long")


def _compare(table: pa.Table, percent: int) -> tuple[list[int], list[int]]:
    """Linking pairs between the sides 0 and 1, or inside side 0 if it is alone; one for each merge of labels is enough."""
    node, label, n, side = (np.asarray(table.column(c)).copy() for c in ("node", "label", "n", "side"))
    lists = table.column("shingles").combine_chunks()
    sizes = np.diff(np.asarray(lists.offsets))
    _, tokens = np.unique(np.asarray(lists.flatten()), return_inverse=True)
    bands = np.asarray(table.column("bands").combine_chunks().flatten())
    ends = np.cumsum(sizes)
    owner, width = np.repeat(np.arange(len(node)), sizes), int(bands.max(initial=0)) + 1
    flags, found = np.zeros(int(tokens.max(initial=-1)) + 1, bool), ([], [])
    alone = not (side == 1).any()
    for i in np.flatnonzero(side == 0):
        fits = (label != label[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
        fits &= np.arange(len(node)) > i if alone else side == 1
        if fits.any():
            own = tokens[ends[i] - sizes[i] : ends[i]]
            flags[own] = True
            some = np.flatnonzero(flags[tokens] & fits[owner])
            flags[own] = False
            partial = np.bincount(owner[some] * width + bands[some], minlength=len(node) * width).reshape(len(node), width)
            overlap = partial.sum(axis=1)  # over the fragments
            for j in np.flatnonzero(fits & (100 * overlap >= percent * (n + n[i] - overlap))):
                if label[j] != label[i]:
                    found[0].append(int(node[i]))
                    found[1].append(int(node[j]))
                    label[label == label[j]] = label[i]
    return found


def _arrow_type(texts: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(texts.schema["id"].dataType)
