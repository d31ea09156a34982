"""Document fingerprints by one-permutation MinHash, in DataFrame operations only.

Each word shingle is hashed once. The high bits of a hash choose one of ``bins`` bins, and a bin's
least hash represents it. Empty bins are filled by optimal densification: each visits other bins in
a random sequence of its own, the same for all documents, and takes the value of the first that
holds one. TRIES steps of it are hashed one by one; a bin that has met none takes, of the bins that hold
a value, the one that comes first in a random order of its own, which continues the sequence. Of each value the ``bits``
low bits are stored, packed as hexadecimal digits. Two fingerprints agree by chance in ``2**-bits`` of
the bins, and the likeness corrects for that: (agreeing share - chance) / (1 - chance), held in 0 to 1.
Its standard error is about ``sqrt(r (1 - r) / bins)`` for texts of more shingles than bins, and that of
their number of shingles for shorter ones.

All of it is one expression over a text's array of hashes, so no row is exploded and nothing but texts
moves. A sorted array takes the place of a table of bins: a bin's least hash is the first of its run.

Words are runs of other than white space after lower-casing A-Z, shingles runs of five words; a
shorter text has its whole sequence as one.

Defined cases: null is empty; a text without words has an empty fingerprint, which is like another
empty one (1) and like no other (0); repeated rows get equal fingerprints; null ids come last;
an empty table gives none; extra columns are ignored. A text's words and hashes are held as arrays of
the task, some 25 bytes for each of its bytes, so one of 64 MB asks for 1.6 GB of heap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, ranked

BINS, BITS, SHINGLE_WORDS = 256, 8, 5
WORD = r"[^\x20\x09-\x0D]+"
TRIES = 8
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; a plain reference inside a lambda is computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column, size: int = SHINGLE_WORDS) -> Column:
    """The 64-bit hashes of the shingles of a text in order."""
    words = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), F.lit(WORD), F.lit(0))

    def runs(h: Column) -> Column:
        whole = F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))
        each = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))
        return F.when(F.size(h) >= size, each).when(F.size(h) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def fingerprint(text: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """The low bits of each bin's value, as small integers; null for a text without words."""
    if bins < 2 or bins & (bins - 1) or bits not in (4, 8):
        raise ValueError("bins must be a power of two, bits 4 or 8")
    power = bins.bit_length() - 1
    # Hashes are signed, so their high bits run from -bins/2; ascending hashes have ascending bins.
    place = lambda x: (F.shiftright(x, 64 - power) + bins // 2).cast("int")
    low = lambda x: x.bitwiseAND((1 << bits) - 1).cast("smallint")
    none = F.lit(None).cast("smallint")
    step = lambda b, j: F.pmod(F.xxhash64(b, F.lit(j)), F.lit(bins)).cast("int")

    def least(hashes: Column) -> Column:
        return F.filter(hashes, lambda x, i: (i == 0) | (place(x) != place(F.get(hashes, i - 1))))

    def spaced(held: Column) -> Column:
        gap = lambda x, i: place(x) - F.when(i == 0, F.lit(0)).otherwise(place(F.get(held, i - 1)) + 1)
        before = F.flatten(F.transform(held, lambda x, i: F.concat(F.array_repeat(none, gap(x, i)), F.array(low(x)))))
        return F.concat(before, F.array_repeat(none, bins - 1 - place(F.element_at(held, -1))))

    def filled(held: Column) -> Column:
        def dense(spots: Column) -> Column:
            last = lambda b: F.array_min(F.transform(held, lambda x: F.struct(F.xxhash64(b, F.lit(TRIES), place(x)).alias("turn"), low(x).alias("value"))))["value"]
            return F.transform(spots, lambda v, b: F.coalesce(v, *[F.get(spots, step(b, j)) for j in range(TRIES)], last(b)))

        return F.when(F.size(held) == bins, F.transform(held, low)).when(F.size(held) > 0, let(spaced(held), dense))

    return let(F.sort_array(shingle_hashes(text)), lambda hashes: let(least(hashes), filled))


def packed(lows: Column, bits: int = BITS) -> Column:
    """The bins' low bits as hexadecimal digits, bin by bin; empty for a text without words."""
    digits = bits // 4
    table = F.split(F.lit(",".join(f"{x:0{digits}x}" for x in range(1 << bits))), ",")
    return F.coalesce(F.array_join(F.transform(lows, lambda x: F.get(table, x.cast("int"))), ""), F.lit(""))


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """The bias-corrected estimate of the Jaccard similarity from two arrays of low bits."""
    chance = 2.0**-bits
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.size(a)
    found = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(found)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """One row per input row: id and packed fingerprint; nothing moves."""
    return docs.select(F.col(id_col), packed(fingerprint(F.col(text_col).cast("string"), bins, bits), bits).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A text's edited form has its last half (of its code points, rounded down) replaced by as many of the
    first of the next document's, or all, in ascending order of id; the first follows the last. Documents
    of one id are ordered by a hash of their text, and rows that repeat id and text are one document in
    the order, so all have the same next.

    The order is made from ids and hashes alone. Texts are then dealt by the hash of their id and text, once:
    both joins read the same exchange, which brings a text to its own row and its beginning to the row before.
    """
    work = Workspace(docs.sparkSession)
    bare = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    named = F.col("id").cast("string")
    mark = F.coalesce(F.concat(F.char_length(named).cast("string"), F.lit(":"), named), F.lit("-"))
    key = F.unhex(F.sha2(F.concat(mark, F.col("text")).cast("binary"), 256))

    rows = bare.select("id", key.alias("key"), F.char_length("text").cast("long").alias("n_chars")).groupBy("id", "key", "n_chars").agg(F.count(F.lit(1)).alias("copies"))
    ordered = work.table(ranked(work, rows, [F.col("id").asc_nulls_last(), F.col("key").asc()], "sorted"), "ordered")
    total, most = ordered.agg(F.count(F.lit(1)), F.max("copies")).first()
    following = ordered.select(F.pmod(F.col("rank") - 2, F.lit(max(1, total))).alias("before"), F.col("key").alias("next_key"))
    pairs = work.table(ordered.join(following, F.col("rank") - 1 == F.col("before")).select("id", "key", "n_chars", F.expr("n_chars div 2").cast("int").alias("half"), "next_key"), "pairs")
    work.keep("pairs")

    texts = bare.select(key.alias("key"), "text", fingerprint(F.col("text"), bins, bits).alias("lows"))
    asked = pairs.select("next_key", F.col("key").alias("to"), F.col("half").alias("wanted")).hint("shuffle_hash")
    sent = texts.join(asked, F.col("key") == F.col("next_key")).select("to", F.expr("left(text, wanted)").alias("start"), F.col("lows").alias("next_lows"))
    if (most or 0) > 1:
        sent = sent.dropDuplicates(["to"])
    own = texts.join(pairs.select("id", F.col("key").alias("own_key"), "n_chars", "half").hint("shuffle_hash"), F.col("key") == F.col("own_key"))
    both = own.join(sent, F.col("key") == F.col("to")).withColumn("edited", F.concat(F.expr("left(text, int(n_chars - half))"), F.col("start")))
    both = both.withColumn("edited_lows", fingerprint(F.col("edited"), bins, bits))
    return both.select(
        F.col("id").alias(id_col), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), packed(F.col("lows"), bits).alias("fingerprint"), packed(F.col("edited_lows"), bits).alias("edited_fingerprint"),
        likeness(F.col("lows"), F.col("edited_lows"), bits).alias("near_edited"), likeness(F.col("lows"), F.col("next_lows"), bits).alias("near_next"),
    )
