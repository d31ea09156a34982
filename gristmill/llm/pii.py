"""Personal data by rules, and by contexts that the rules' finds induce.

The base rules find e-mail addresses, IPv4 addresses, payment cards and phone numbers. These seed a
bootstrap: one pass over the texts lists every *mention*, a seed or another token that looks like
an identifier, with the lexical patterns around it (the two words before, and the words on both
sides, digits masked). Mentions make a graph of patterns and instances, which Spark scores in
rounds: a pattern's confidence for a kind is the mass of its distinct instances of that kind over
all its instances and one more; an instance's mass is one for seeds, else one minus the product of
its patterns' doubts. Patterns with enough mass and confidence then mark the mentions in them that
no rule found and that have the kind's loose shape (so an address with a masked @, a number with
unusual grouping). Besides single tokens, mentions are runs of digit groups joined by spaces,
brackets and marks, and addresses with [@], (at), [.] or the like, whatever their length; of
overlapping finds that with the most confident pattern counts, then the longest.

Defined cases: null texts count as empty; null ids and repeated rows are rows like others (a
repeated row's instances count once in the graph); a table without seeds gets no further spans.
Extra columns are ignored. Spans count code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import joined, rows_with, sha256
from .textblocks import text_blocks
from .workspace import Workspace

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: What a pattern needs to count: the mass of instances of a kind, and its confidence.
LEAST_MASS, LEAST_CONFIDENCE = 3.0, 0.7

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MENTION = re.compile(r"[^\s:=,;\"'()<>\[\]{}]*[0-9@][^\s:=,;\"'()<>\[\]{}]*")
#: Runs of digit groups; addresses with a masked @ or dots. Each starts at one place of a word only, so long words cost no more than their length.
_GROUPS = re.compile(r"(?<![^\W_])[+(\[]*+[0-9]++(?:[\x20\xa0()\[\]./:,-]{1,3}[0-9]++)+")
_GROUP = re.compile(r"[0-9]+")
_AT = r"\s?[\[({<]\s?(?:@|at)\s?[\])}>]\s?"
_DOT = r"\s?[\[({<]\s?(?:\.|dot)\s?[\])}>]\s?"
_MASKED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:"
    rf"(?:{_AT}|\s?@\s?)[A-Za-z0-9-]++(?:(?:\.|{_DOT}|\sdot\s)[A-Za-z0-9-]++)*"
    rf"|\sat\s[A-Za-z0-9-]++(?:(?:{_DOT}|\sdot\s)[A-Za-z0-9-]++)+)", re.IGNORECASE | re.ASCII)  # fmt: skip
_MOST_DIGITS = 19
#: What every mention holds: a digit or an @, or the word "at" as a masked address has it.
_SEEN = np.zeros(256, bool)
_SEEN[[*range(48, 58), ord("@")]] = True
_S = r"[\s\x0b]"
_AT_WORD = rf"(?i)[\[({{<]{_S}?at{_S}?[\])}}>]|{_S}at{_S}[a-z0-9-]+({_S}?[\[({{<]{_S}?(\.|dot){_S}?[\])}}>]|{_S}dot{_S})"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address rule, found from their @ signs, so that long words cost no more than their length."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start, step = at, 64
        while start > done:
            low = max(done, start - step)
            start = low + _LOCAL.search(text[low:start]).start()
            if start > low:
                break
            step *= 2
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            done = domain.end()
            out.append((start, done))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The rules' finds by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


def wide_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, list[str]]]:
    """(start, end, loose kinds) of digit groups and masked addresses between the spans of ``taken``."""
    out, low = [], 0
    for a, b in [*taken, (len(text), len(text))]:
        out += [(*m.span(), ["email"]) for m in _MASKED.finditer(text, low, a)]
        for m in _GROUPS.finditer(text, low, a):
            start, end, digits = m.start(), m.start(), 0
            for g in _GROUP.finditer(text, start, m.end()):  # more digits than any kind has: the next run starts with this group
                if digits + g.end() - g.start() > _MOST_DIGITS:
                    out.append((start, end, loose_kinds(text[start:end])))
                    start, digits = g.start(), 0
                digits, end = digits + g.end() - g.start(), g.end()
            out.append((start, end, loose_kinds(text[start:end])))
        low = max(low, b)
    return [s for s in out if s[2]]


def loose_kinds(text: str) -> list[str]:
    """The kinds whose loose shape an unruled mention has."""
    digits = sum(c.isdigit() for c in text)
    out = ["email"] if "@" in text and (len(text) >= 5 or "@" in text[1:-1]) else []
    out += ["ip"] if digits >= 4 and text.count(".") + text.count(":") >= 3 else []
    out += ["card"] if 12 <= digits <= 19 and digits >= len(text) / 2 else []
    return out + (["phone"] if 7 <= digits <= 15 and digits >= len(text) / 2 else [])


def _mask(words: list[str]) -> str:
    return " ".join(re.sub(r"[0-9]+", "0", w).lower() if len(w) <= _LONG_WORD else "#" + hashlib.md5(w.lower().encode()).hexdigest() for w in words)


#: Longer words stand in patterns by a digest.
_LONG_WORD = 80
_BEFORE, _AFTER = re.compile(r"[^\s:=]+[:=]*"), re.compile(r"\s*(\S+)")


def _around(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a place: two words before; the word before and the one after; whole words, however long."""
    reach = 80
    while True:
        low = max(0, start - reach)
        found = _BEFORE.findall(text, low, start)
        if len(found) > 2 or not low:  # the first of three may be cut
            break
        reach *= 4
    before, behind = found[-2:], _AFTER.match(text, end)
    after = [behind[1]] if behind else []
    out = [f"{_mask(before)} _"] if len(before) == 2 else []
    return out + ([f"{_mask(before[-1:])} _ {_mask(after)}"] if before and after else [])


def mentions(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Seeds and other identifier-like tokens, each with its instance, kinds and patterns."""
    out = [{"kind": k, "seed": True, "start": a, "end": b, "instance": text[a:b].lower(), "patterns": _around(text, a, b)} for k, a, b in spans]
    taken = sorted((a, b) for _, a, b in spans)
    wide = {(a, b): kinds for a, b, kinds in wide_spans(text, taken)}
    tokens = [(m.start(), m.start() + len(m.group().rstrip(".!?"))) for m in _MENTION.finditer(text)]
    for a, b in [*wide, *[t for t in tokens if t not in wide]]:
        kinds = wide.get((a, b)) or loose_kinds(text[a:b])
        if (b - a < 5 and not kinds) or any(x < b and a < y for x, y in taken):
            continue
        patterns = _around(text, a, b)
        out += [{"kind": k, "seed": False, "start": a, "end": b, "instance": text[a:b].lower(), "patterns": patterns} for k in kinds]
        if not kinds:
            out.append({"kind": None, "seed": False, "start": a, "end": b, "instance": text[a:b].lower(), "patterns": patterns})
    return out


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_MENTIONS = pa.list_(pa.struct([("kind", pa.string()), ("seed", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
_SCHEMA = "n array<bigint>, base_sha256 string, base array<struct<kind:string,start:int,end:int>>, mentions array<struct<kind:string,seed:boolean,start:int,end:int,instance:string,patterns:array<string>>>"


def _scan(batches):
    empty = sha256("")
    for batch in batches:
        counts, shas, bases, found = ([None] * batch.num_rows for _ in range(4))
        column = batch.column(1)
        for row, end, data, offsets in text_blocks(column):
            some = rows_with(_SEEN, data, offsets) | np.asarray(pc.fill_null(pc.match_substring_regex(column.slice(row, end - row), _AT_WORD), False))
            for k in range(end - row):
                spans, seen = [], []
                if some[k]:
                    text = column[row + k].as_py() or ""
                    spans = base_spans(text)
                    seen = mentions(text, spans)
                counts[row + k] = [sum(s[0] == kind for s in spans) for kind in KINDS]
                shas[row + k] = sha256(joined(spans)) if spans else empty
                bases[row + k] = [{"kind": kind, "start": a, "end": b} for kind, a, b in spans]
                found[row + k] = seen
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.list_(pa.int64())), pa.array(shas, pa.string()), pa.array(bases, _SPAN), pa.array(found, _MENTIONS)], ["id", "n", "base_sha256", "base", "mentions"])


def _apart(batches):
    """The finds of each row, the best first, without those that overlap a better one."""
    for batch in batches:
        out = []
        for found in batch.column(1).to_pylist():
            starts, kept = [], []  # by start
            for s in found:
                at = bisect(starts, s["start"])
                if (at == 0 or kept[at - 1]["end"] <= s["start"]) and (at == len(kept) or s["end"] <= starts[at]):
                    starts.insert(at, s["start"])
                    kept.insert(at, {k: s[k] for k in ("kind", "start", "end")})
            out.append(kept)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _SPAN)], ["row", "added"])


def confident_patterns(work: Workspace, found: DataFrame, rounds: int = ROUNDS, least_mass: float = LEAST_MASS, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """(pattern, kind, confidence) after scoring the graph of patterns and instances in ``found`` (kind, seed, instance, pattern)."""
    edges = work.table(found.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    wide = work.table(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances")), "wide")
    seeds = work.table(found.filter("seed").select("instance", "kind").distinct().withColumn("mass", F.lit(1.0)), "seeds")
    shapes = work.table(found.filter("not seed AND kind is not null").select("instance", "kind").distinct().join(seeds.select("instance"), "instance", "left_anti"), "shapes")
    mass, patterns = seeds, None
    for step in range(rounds):
        reached = edges.join(mass, "instance").groupBy("pattern", "kind").agg(F.sum("mass").alias("mass"))
        scored = reached.join(wide, "pattern").withColumn("confidence", F.col("mass") / (F.col("instances") + 1))
        patterns = work.table(scored.filter((F.col("mass") >= least_mass) & (F.col("confidence") >= least_confidence)).select("pattern", "kind", "confidence"), f"patterns-{step}")
        held = edges.filter("not seed").join(patterns, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("mass"))
        mass = work.table(seeds.union(held.join(shapes, ["instance", "kind"]).select("instance", "kind", "mass")), f"mass-{step}")
    return patterns


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id, n (counts of the rules' finds by KINDS), base_sha256, and spans (kind, start, end), also those that patterns add."""
    kind = docs.schema[id_col].dataType.simpleString()
    work = Workspace(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = work.table(texts.mapInArrow(_scan, f"id {kind}, {_SCHEMA}").withColumn("row", F.monotonically_increasing_id()), "rows")
    one = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.kind", "m.seed", "m.start", "m.end", "m.instance", F.explode("m.patterns").alias("pattern"))
    one = work.table(one, "mentions")
    patterns = confident_patterns(work, one.select("kind", "seed", "instance", "pattern"), **options)
    marked = one.filter("not seed AND kind is not null").join(patterns, ["pattern", "kind"])
    best = marked.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"), F.max("confidence").alias("confidence"))
    ranked = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("doubt"), (F.col("start") - F.col("end")).alias("size"), "start", "end", "kind"))).alias("found"))
    added = work.table(ranked.mapInArrow(_apart, "row bigint, added array<struct<kind:string,start:int,end:int>>"), "added")
    work.keep("rows", "added")
    # Kinds as listed, then starts.
    place = F.expr("transform(" + "array(" + ",".join(f"'{k}'" for k in KINDS) + "), k -> array_sort(filter(every, s -> s.kind = k), (x, y) -> int(x.start - y.start)))")
    every = rows.join(added, "row", "left").withColumn("every", F.concat("base", F.coalesce("added", F.expr("CAST(array() AS array<struct<kind:string,start:int,end:int>>)"))))
    return every.select(F.col("id").alias(id_col), "n", "base_sha256", F.flatten(place).alias("spans"))
