"""Secret scans: rules, and a character convolutional network over candidates in their context.

The base rules find assignments to secret-like names, access keys and long lower-case hex. A
candidate is every run of LEAST or more letters, digits and ``+/_.=-``; those that overlap a rule's
find are the positive labelled findings, the others the negative ones. The network reads a window:
up to INSIDE characters of the candidate and some on both sides. A longer candidate has several
windows that cover it whole, one with a ``=`` also one for the value after it; the highest score
counts. One convolution over one-hot characters, its maxima before the candidate and from its start,
and one output are trained in numpy, half of the time without what stands before. Windows are scored
both ways, the higher output counts, and is calibrated on all held-back windows. The threshold never
exceeds the highest one that keeps the recall there at LEAST_RECALL; it lies halfway between that
and what the same share of negative findings stays below, as negatives that score like findings may
be secrets without a rule. Every candidate of every text is scored, and those over the threshold
that no rule found are added as spans of kind "learned".

Texts are read twice, for the windows and for the scores. All distinct windows move once, by a hash: a
fifth of them is held back, the others are dealt to shards. A first fit to one shard is the start for
one pass over every shard, each in a task; the fits' mean is the network, so each window has its part
in it. Half of a step's windows are findings, a quarter each other candidates with and without
a digit. Calibration, threshold and recall come from counts of the outputs of all held-back windows;
outputs are whole multiples of 1 / GRID, so these counts are exact and few. Defined cases: null texts count as empty; null ids and
repeated rows are rows like others; without findings of both labels nothing is added. Extra columns
are ignored. Spans count code points, end exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import code_points, joined, rows_with, runs, sha256
from .textblocks import text_blocks
from .workspace import Workspace

KINDS = ("assign", "access", "hex")
LEARNED = "learned"
LEAST = 12
LEAST_RECALL = 0.98
#: Characters of a window: before the candidate, of it, and after it.
BEFORE, INSIDE, AFTER = 20, 36, 8
#: Kernel width, filters, and steps of training with so many windows each.
WIDTH, FILTERS, STEPS, STEP_WINDOWS = 5, 24, 700, 64
#: Windows of a shard, learning rates of the first fit and of the pass over all shards, and steps of outputs.
SHARD_WINDOWS, RATE, PASS_RATE, GRID = 16_384, 0.01, 0.002, 256
#: Windows that a task holds before it sends them on without repeats.
SENT = 20_000
#: Windows that are scored together.
SCORED = 512

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_VALUE = re.compile(r"=(?=[^=])")
_CLASS, _UPPERS, _HEXES, _MARKS = (np.zeros(256, bool) for _ in range(4))
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.=-"]] = True
_UPPERS[[*range(48, 58), *range(65, 91)]] = True
_HEXES[[*range(48, 58), *range(97, 103)]] = True
_MARKS[[*b"=:"]] = True

#: Characters of the network: each letter, digits as one, some marks, space, others, and padding.
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0=:\"'+/_.-@ "
CHANNELS = len(_ALPHABET) + 4
_PLACE = np.full(128, len(_ALPHABET))
for _k, _c in enumerate(_ALPHABET):
    _PLACE[ord(_c)] = _k
_PLACE[[9, 10, 11, 12, 13]] = _ALPHABET.index(" ")
_PLACE[48:58] = _ALPHABET.index("0")
_UPPER, _PAD = len(_ALPHABET) + 1, len(_ALPHABET) + 2


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The rules' finds by start, then kind as listed."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


def windows(text: str, start: int, end: int):
    """Yield what the network sees of a candidate, INSIDE characters at a time, and from each value after a ``=`` in it; padded by NUL to one length."""
    values = [m.end() for m in _VALUE.finditer(text, start, end) if end - m.end() >= LEAST]
    for low in [*range(start, end - INSIDE, INSIDE), max(start, end - INSIDE), *values]:
        high = min(end, low + INSIDE)
        yield text[max(0, low - BEFORE) : low].rjust(BEFORE, "\0") + text[low:high].ljust(INSIDE, "\0") + text[high : high + AFTER].ljust(AFTER, "\0")


def encoded(some: list[str]) -> np.ndarray:
    """Channel numbers (windows, characters); those of upper-case letters are CHANNELS higher."""
    points = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32).reshape(len(some), -1)
    low = np.minimum(points, 127)
    out = np.where(points < 128, _PLACE[np.where((low >= 65) & (low <= 90), low + 32, low)], len(_ALPHABET))
    out = np.where((points >= 65) & (points <= 90), out + CHANNELS, out)
    return np.where(points == 0, _PAD, out)


@dataclass
class CharNetwork:
    kernel: np.ndarray  # (WIDTH, CHANNELS, FILTERS)
    shift: np.ndarray
    out: np.ndarray  # of the maxima before the candidate's start, then of those from there
    bias: float
    scale: float = 1.0  # calibration: sigmoid(scale * logit + move)
    move: float = 0.0
    threshold: float = 1.1
    recall: float = 0.0  # of held-back findings at the threshold
    false_share: float = 0.0  # of held-back other candidates over it

    def maps(self, codes: np.ndarray) -> np.ndarray:
        """The convolution (windows, places, filters): a one-hot character picks a row of the kernel, a capital adds that of upper case."""
        rows = np.concatenate([self.kernel, self.kernel + self.kernel[:, _UPPER : _UPPER + 1]], axis=1)
        places = codes.shape[1] - WIDTH + 1
        total = rows[0][codes[:, :places]]
        for w in range(1, WIDTH):
            total += rows[w][codes[:, w : w + places]]
        return total + self.shift

    def logits(self, codes: np.ndarray) -> np.ndarray:
        """The higher of the outputs with and without what stands before: a context may speak for a secret, words unseen there not against it. On a grid, from -50 to 50."""
        z = np.maximum(self._output(codes), self._output(_alone(codes)))
        return np.round(np.clip(z, -50, 50).astype(float) * GRID) / GRID

    def _output(self, codes: np.ndarray) -> np.ndarray:
        maps = self.maps(codes)
        tops = np.concatenate([maps[:, :BEFORE].max(axis=1), maps[:, BEFORE:].max(axis=1)], axis=1)
        return np.maximum(tops, 0) @ self.out + self.bias

    def probabilities(self, some: list[str]) -> np.ndarray:
        parts = [self.logits(encoded(some[k : k + SCORED])) for k in range(0, len(some), SCORED)]
        z = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.move, -50, 50)))


def _gradients(net: CharNetwork, codes: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    maps = net.maps(codes)
    best = np.concatenate([maps[:, :BEFORE].argmax(axis=1), BEFORE + maps[:, BEFORE:].argmax(axis=1)], axis=1)
    filters = np.tile(np.arange(FILTERS), 2)
    top = maps[np.arange(len(codes))[:, None], best, filters]
    active = np.maximum(top, 0)
    p = 1 / (1 + np.exp(-np.clip(active @ net.out + net.bias, -50, 50)))
    # Others count by the sigmoid loss: one that scores like a finding may be a secret without a rule, and isn't learned by heart.
    err = np.where(labels == 1, p - 1, p * (1 - p)).astype(np.float32) / len(labels)
    back = err[:, None] * net.out * (top > 0)
    shape = (WIDTH, 2 * CHANNELS, FILTERS)
    seen = codes[np.arange(len(codes))[:, None, None], best[:, :, None] + np.arange(WIDTH)]  # (windows, filters, width)
    at = np.ravel_multi_index(np.broadcast_arrays(np.arange(WIDTH), seen, filters[None, :, None]), shape)
    both = np.bincount(at.ravel(), np.repeat(back.ravel(), WIDTH), minlength=np.prod(shape)).reshape(shape)
    kernel = both[:, :CHANNELS] + both[:, CHANNELS:]
    kernel[:, _UPPER] += both[:, CHANNELS:].sum(axis=1)
    return [kernel + 1e-3 * net.kernel, back.reshape(len(codes), 2, FILTERS).sum(axis=(0, 1)), active.T @ err + 1e-3 * net.out, err.sum(keepdims=True)]


def _alone(codes: np.ndarray) -> np.ndarray:
    """Windows without what stands before the candidate."""
    return np.concatenate([np.full((len(codes), BEFORE), _PAD), codes[:, BEFORE:]], axis=1)


def _start(seed: int = 3) -> CharNetwork:
    rng = np.random.default_rng(seed)
    return CharNetwork(rng.normal(0, 0.1, (WIDTH, CHANNELS, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)


def _fitted(net: CharNetwork, some: list[str], kinds: np.ndarray, labels: np.ndarray, least_steps: int, rate: float, seed: int) -> list[np.ndarray]:
    """The parameters after steps from ``net``'s over all windows: each step takes half findings, and of other kinds as many of each; those of a kind in turn, so that every one is used."""
    rng = np.random.default_rng(seed)
    each = [rng.permutation(np.flatnonzero((kinds == k) & (labels == y))) for y, k in sorted(set(zip(labels.tolist(), kinds.tolist(), strict=True)))]
    alike = [sum(labels[e[0]] == labels[x[0]] for x in each) for e in each]  # kinds of the same label
    shares = [STEP_WINDOWS // (len(set(labels.tolist())) * a) for a in alike]
    steps = max(least_steps, *(-(-len(e) // k) for e, k in zip(each, shares, strict=True)))
    codes = encoded(some).astype(np.int16)
    params = [net.kernel.copy(), net.shift.copy(), net.out.copy(), np.full(1, net.bias, np.float32)]
    now = CharNetwork(*params[:3], net.bias)
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        picked = np.concatenate([np.take(e, np.arange((t - 1) * k, t * k), mode="wrap") for e, k in zip(each, shares, strict=True)])
        now.bias = float(params[3][0])
        seen = codes[picked].astype(np.int64)
        seen = np.where(rng.random((len(picked), 1)) < 0.5, _alone(seen), seen)
        for p, g, m, v in zip(params, _gradients(now, seen, labels[picked]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return params


def _with_params(params: list[np.ndarray]) -> CharNetwork:
    kernel, shift, out, bias = (np.asarray(p, np.float32) for p in params)
    return CharNetwork(kernel, shift, out, float(bias[0]))


def _quantile(values: np.ndarray, counts: np.ndarray, place: int) -> float:
    """The value at a place (0, 1, ...) of ascending values that stand ``counts`` times each."""
    return float(values[np.searchsorted(np.cumsum(counts), place, side="right")])


def _calibrated(net: CharNetwork, z: np.ndarray, y: np.ndarray, n: np.ndarray) -> CharNetwork:
    """Calibration and threshold from the outputs ``z`` of held-back windows with labels ``y``, each of which stands for ``n``."""
    order = np.argsort(z, kind="stable")
    z, y, n = z[order], y[order].astype(float), n[order]
    # Calibration: a logistic fit of the held-back labels to the logits, drawn to the identity; both labels weigh in by their numbers.
    mean = lambda x: np.average(x, weights=n)
    spread = max(1.0, float(np.sqrt(mean((z - mean(z)) ** 2))))
    a, b = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        a -= 0.5 * (mean((p - y) * z) + 0.02 * (a - 1)) / spread**2
        b -= 0.5 * (mean(p - y) + 0.02 * b)
    net.scale, net.move = a, b
    p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
    found, other = ((p[y == k], n[y == k]) for k in (1, 0))
    if a < 0:
        found, other = ((v[::-1], c[::-1]) for v, c in (found, other))
    top = _quantile(*found, int((1 - LEAST_RECALL) * found[1].sum()))  # the highest that keeps the recall
    net.threshold = (top + min(_quantile(*other, int(LEAST_RECALL * (other[1].sum() - 1))), top)) / 2
    net.recall, net.false_share = (float(c[v >= net.threshold].sum() / c.sum()) for v, c in (found, other))
    return net


def train(some: list[str], labels: np.ndarray, seed: int = 3) -> CharNetwork | None:
    """Fit on four fifths of the distinct windows, calibrate and set the threshold on the rest, without Spark; None without both labels in both."""
    order = np.random.default_rng(seed).permutation(len(some))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    if any(len(set(labels[part].tolist())) < 2 for part in (held, used)):
        return None
    net = _with_params(_fitted(_start(seed), [some[k] for k in used], labels[used], labels[used], STEPS, RATE, seed))
    z = np.concatenate([net.logits(encoded([some[k] for k in held[j : j + SCORED]])) for j in range(0, len(held), SCORED)])
    return _calibrated(net, z, labels[held], np.ones(len(held)))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _found(column: pa.Array):
    """Yield (row, text, rules' spans, candidates) of the texts of an Arrow column that have any."""
    for row, _, data, offsets in text_blocks(column):
        a, b = runs(_CLASS, data, offsets, LEAST)
        owner = np.searchsorted(offsets, a, side="right") - 1
        ruled = rows_with(_MARKS, data, offsets)
        for mask, least in ((_HEXES, 16), (_UPPERS, 18)):
            ruled[np.searchsorted(offsets, runs(mask, data, offsets, least)[0], side="right") - 1] = True
        for k in np.union1d(owner, np.flatnonzero(ruled)).tolist():
            text = column[row + k].as_py() or ""
            low, high = np.searchsorted(owner, [k, k + 1])
            places = np.stack([a[low:high], b[low:high]], axis=1).ravel() - offsets[k]
            if len(text) != offsets[k + 1] - offsets[k]:
                places = code_points(data[offsets[k] : offsets[k + 1]], places)
            yield row + k, text, base_spans(text) if ruled[k] else [], places.reshape(-1, 2).tolist()


def _open(spans: list[tuple[str, int, int]], candidates: list[list[int]]):
    """Each candidate with whether a rule's find overlaps it."""
    edges = sorted((a, b) for _, a, b in spans)
    k, reach = 0, 0
    for x, y in candidates:
        while k < len(edges) and edges[k][0] < y:
            reach = max(reach, edges[k][1])
            k += 1
        yield x, y, reach > x


#: Kinds of training windows: other candidates without and with a digit, and findings.
PLAIN, DIGITS, FINDING = 0, 1, 2


def _samples(sent: int):
    """All windows of a task with their kinds; of what it holds at once without repeats."""

    def samples(batches):
        held: dict[str, int] = {}

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held.values()), pa.int32()), pa.array(list(held), pa.string())], ["kind", "window"])
            held.clear()
            return out

        for batch in batches:
            for _, text, spans, candidates in _found(batch.column(0)):
                for x, y, ruled in _open(spans, candidates):
                    for w in windows(text, x, y):
                        kind = FINDING if ruled else DIGITS if any("0" <= c <= "9" for c in w[BEFORE : BEFORE + INSIDE]) else PLAIN
                        held[w] = max(kind, held.get(w, kind))
                        if len(held) >= sent:
                            yield given()
        yield given()

    return samples


#: Parameters are added as whole multiples of 1 / FIXED, so that the order of the shards doesn't count.
FIXED = 1 << 32


def _mean_fit(used: DataFrame, net: CharNetwork, least_steps: int, rate: float) -> CharNetwork:
    """The mean of the networks that the tasks fit from ``net``'s parameters, each to a whole shard; a row a task reaches the driver."""
    shapes = [net.kernel.shape, net.shift.shape, net.out.shape, (1,)]

    def fit(key, table):
        table = table.sort_by("window")
        kinds = table["kind"].to_numpy()
        params = _fitted(net, table["window"].to_pylist(), kinds, (kinds == FINDING).astype(np.int64), least_steps, rate, key[0].as_py())
        whole = np.round(np.concatenate([p.ravel() for p in params]).astype(float) * FIXED).astype(np.int64)
        return pa.table({"n": pa.array([1], pa.int64()), "params": pa.array([whole], pa.list_(pa.int64()))})

    def added(batches):
        n, total = 0, 0
        for batch in batches:
            for k, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, total = n + k, total + np.array(row, np.int64)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.list_(pa.int64()))], ["n", "params"])

    schema = "n long, params array<bigint>"
    rows = used.select("kind", "window", "shard").groupBy("shard").applyInArrow(fit, schema).mapInArrow(added, schema).collect()
    mean = sum(np.array(r.params, np.int64) for r in rows) / FIXED / sum(r.n for r in rows)
    cuts = np.cumsum([np.prod(shape) for shape in shapes])[:-1]
    return _with_params([p.reshape(shape) for p, shape in zip(np.split(mean, cuts), shapes, strict=True)])


def _outputs(net: CharNetwork):
    """Labels and outputs on the grid of a task's windows, with their numbers."""

    def outputs(batches):
        for batch in batches:
            some, label = batch.column(1).to_pylist(), np.asarray(batch.column(0)) == FINDING
            for k in range(0, len(some), SCORED):
                place = np.round(net.logits(encoded(some[k : k + SCORED])) * GRID).astype(np.int64)
                rows, n = np.unique(np.stack([label[k : k + SCORED].astype(np.int64), place]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(n.astype(np.int64))], ["label", "place", "n"])

    return outputs


def secret_network(docs: DataFrame, text_col: str = "text") -> CharNetwork | None:
    """The network trained on all distinct windows of ``docs``, a fifth of them held back; None without both labels in both parts."""
    work = Workspace(docs.sparkSession)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    found = texts.mapInArrow(_samples(SENT), "kind int, window string").groupBy("window").agg(F.max("kind").alias("kind"))
    all_ = work.table(found.withColumn("hash", F.xxhash64("window")), "windows").withColumn("held", F.pmod("hash", F.lit(5)) == 0)
    counts = {(r.held, r.label): r.n for r in all_.groupBy("held", (F.col("kind") == FINDING).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    net = None
    if len(counts) == 4:
        shards = -(-(counts[False, False] + counts[False, True]) // SHARD_WINDOWS)
        used = all_.filter("NOT held").withColumn("shard", F.pmod(F.shiftright("hash", 8), F.lit(shards)).cast("int"))
        net = _mean_fit(used.filter("shard = 0"), _start(), STEPS, RATE)
        if shards > 1:
            net = _mean_fit(used, net, 1, PASS_RATE)
        seen = all_.filter("held").select("kind", "window").mapInArrow(_outputs(net), "label long, place long, n long")
        places = seen.groupBy("label", "place").agg(F.sum("n").alias("n")).orderBy("place", "label").collect()  # two rows a place of the grid at most
        net = _calibrated(net, *(np.array([r[k] for r in places], float) / (GRID if k == "place" else 1) for k in ("place", "label", "n")))
    work.keep()
    return net


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n (counts of the rules' finds by KINDS), base_sha256, and spans (kind, start, end) by start, with learned ones."""
    kind = docs.schema[id_col].dataType.simpleString()
    net = secret_network(docs, text_col)

    def judge(batches):
        empty = sha256("")
        for batch in batches:
            n = batch.num_rows
            counts, shas, spans, waiting = [[0] * len(KINDS)] * n, [empty] * n, [[]] * n, []

            def score() -> None:
                scores = iter(net.probabilities([w for *_, some in waiting for w in some]))
                for row, x, y, some in waiting:
                    if max(next(scores) for _ in some) >= net.threshold and (LEARNED, x, y) not in spans[row][-1:]:
                        spans[row].append((LEARNED, x, y))
                waiting.clear()

            for row, text, base, candidates in _found(batch.column(1)):
                counts[row] = [sum(s[0] == kind for s in base) for kind in KINDS]
                shas[row] = sha256(joined(base))
                spans[row] = list(base)
                held = 0
                for x, y, ruled in _open(base, candidates) if net else ():
                    if not ruled:
                        some: list[str] = []
                        for w in windows(text, x, y):
                            some.append(w)
                            if len(some) == 8 * SCORED:  # a very long candidate is scored in parts
                                waiting.append((row, x, y, some))
                                score()
                                some = []
                        if some:
                            waiting.append((row, x, y, some))
                        held += len(some)
                        if held >= 8 * SCORED:
                            score()
                            held = 0
                if sum(len(some) for *_, some in waiting) >= SCORED:
                    score()
            score() if waiting else None
            places = {k: i for i, k in enumerate((*KINDS, LEARNED))}
            out = [[{"kind": k, "start": a, "end": b} for k, a, b in sorted(s, key=lambda x: (x[1], places[x[0]]))] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.list_(pa.int64())), pa.array(shas, pa.string()), pa.array(out, _SPANS)], ["id", "n", "base_sha256", "spans"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(judge, f"id {kind}, n array<bigint>, base_sha256 string, spans array<struct<kind:string,start:int,end:int>>").withColumnRenamed("id", id_col)
