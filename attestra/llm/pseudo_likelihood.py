"""Masked pseudo-likelihood: every word predicted from both sides, log-probabilities summed per document.

Words are hashed to a fixed number of buckets, and the buckets of the whole corpus are counted. Frequent
buckets are output classes of their own, the rest share classes of about equal mass: a word's probability is
that of its class in context times its bucket's share of the class. A small network over the embeddings of the
words on both sides, without the word itself, gives the class.

Training is data-parallel and takes every position of the corpus: positions are dealt out to the rounds, each
partition runs its own gradient steps from the shared weights, and the weights are averaged by weight of
evidence. What is gathered grows with the corpus; what reaches the driver has the fixed size of the counts and
the weights.

Cases: NULL and empty texts have no tokens, a sum of 0 and no mean; repeated rows get equal scores; an empty
corpus gives uniform probabilities; beyond the ends of a text there is a padding word; a text of any length is
scored whole; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F

from attestra.llm.common import per_text
from attestra.session import durable

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
CHUNKS = 64
RUN = 200_000                   # positions of a packed run, more only by its last text
PIECE = 1 << 16                 # windows spread out at a time; a multiple of the batch sizes


class Vocabulary(NamedTuple):
    output: np.ndarray              # class of each bucket
    share: np.ndarray               # log of each bucket's share of its class
    input: np.ndarray               # embedding row of each bucket; 0 is padding
    classes: int
    inputs: int
    bits: int


class Weights(NamedTuple):
    e: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray


def buckets(text: bytes | None, bits: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    w = (text or b"").translate(LOWER).split()
    return (np.fromiter(map(xxh64_intdigest, w), dtype=np.uint64, count=len(w)) >> np.uint64(64 - bits)).astype(np.int64)


def count_buckets(windows: DataFrame, bits: int) -> np.ndarray:
    """Occurrences of every bucket in the packed runs of all documents, summed on the cluster."""
    def count(batches):
        import pyarrow as pa

        total = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for run in batch.column(0).to_pylist():
                b = np.frombuffer(run, dtype=np.int32)
                total += np.bincount(b[b >= 0], minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = windows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << bits, dtype=np.int64)
    counts[rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return counts


def vocabulary(counts: np.ndarray, classes: int, inputs: int, bits: int) -> Vocabulary:
    order = np.argsort(-counts, kind="stable")
    own = classes * 3 // 4
    smooth = counts + 0.5                       # a bucket that was never seen is possible as well
    output = np.empty(len(counts), dtype=np.int64)
    output[order[:own]] = np.arange(own)
    tail = order[own:]
    mass = np.cumsum(smooth[tail])
    output[tail] = own + np.minimum(classes - own - 1, (mass / mass[-1] * (classes - own)).astype(np.int64))
    share = np.log(smooth / np.bincount(output, smooth, classes)[output])
    known = inputs * 3 // 4
    entry = 1 + known + np.arange(len(counts)) % (inputs - known - 1)
    entry[order[:known]] = 1 + np.arange(known)
    return Vocabulary(output, share.astype(np.float32), entry, classes, inputs, bits)


def windows_of(ids: np.ndarray, side: int) -> np.ndarray:
    """For each position the ``side`` inputs before and after it; 0 beyond the ends."""
    padded = np.concatenate((np.zeros(side, np.int64), ids, np.zeros(side, np.int64)))
    at = np.arange(len(ids))
    return np.stack([padded[at + k] for k in range(2 * side + 1) if k != side], axis=1)


def fresh(v: Vocabulary, side: int, width: int, hidden: int, counts: np.ndarray, seed: int = 3) -> Weights:
    r = np.random.default_rng(seed)
    prior = np.log(np.bincount(v.output, counts + 0.5, v.classes) / (counts + 0.5).sum())
    f = np.float32
    return Weights((r.normal(0, 0.1, (v.inputs, width))).astype(f),
                   (r.normal(0, 1, (2 * side * width, hidden)) / np.sqrt(2 * side * width)).astype(f),
                   np.zeros(hidden, f), (r.normal(0, 0.1, (hidden, v.classes))).astype(f), prior.astype(f))


def outputs(w: Weights, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class outputs whose exponentials are finite and not all zero, hidden layer, input layer) of some windows."""
    z = np.take(w.e, x, axis=0).reshape(len(x), -1)
    h = np.tanh(z @ w.w1 + w.b1)
    o = h @ w.w2
    o += w.b2
    if o.size and (o.max() > 60 or o.min() < -60):          # rarely: small outputs need no shift
        o -= o.max(axis=1, keepdims=True)
    return o, h, z


def log_classes(w: Weights, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-probabilities of the classes, hidden layer, input layer) of some windows."""
    o, h, z = outputs(w, x)
    o -= np.log(np.exp(o).sum(axis=1, keepdims=True))
    return o, h, z


def log_class(w: Weights, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log-probability of class ``y`` of each window."""
    o, _, _ = outputs(w, x)
    mine = o[np.arange(len(y)), y]
    np.exp(o, out=o)
    return mine - np.log(o @ np.ones(o.shape[1], o.dtype))


def steps_down(w: Weights, past: list[np.ndarray], x: np.ndarray, y: np.ndarray, rate: float, batch: int) -> None:
    """Adagrad steps over the windows ``x`` with classes ``y`` in their order; ``w`` and ``past`` change in place."""
    def step(k, grad):
        past[k] += grad * grad
        w[k][...] -= rate * grad / np.sqrt(past[k])

    width = w.e.shape[1]
    for i in range(0, len(x), batch):
        xb, yb = x[i:i + batch], y[i:i + batch]
        g, h, z = outputs(w, xb)
        np.exp(g, out=g)
        g *= (1 / (len(yb) * (g @ np.ones(g.shape[1], g.dtype))))[:, None]
        g[np.arange(len(yb)), yb] -= 1 / len(yb)
        dh = (g @ w.w2.T) * (1 - h * h)
        dz = (dh @ w.w1.T).reshape(-1, width)
        step(3, h.T @ g)
        step(4, g.sum(0))
        step(1, z.T @ dh)
        step(2, dh.sum(0))
        flat = xb.ravel()
        order = np.argsort(flat.astype(np.int16) if len(w.e) < 1 << 15 else flat, kind="stable")       # int16 sorts by digits
        inputs = flat[order]
        starts = np.flatnonzero(np.concatenate(([True], inputs[1:] != inputs[:-1])))
        de, rows = np.add.reduceat(np.take(dz, order, axis=0), starts, axis=0), inputs[starts]
        past[0][rows] += de * de
        w.e[rows] -= rate * de / np.sqrt(past[0][rows])


def start_of(w: Weights) -> tuple[Weights, list[np.ndarray]]:
    """A copy to descend from and its sums of squared gradients."""
    return Weights(*(a.copy() for a in w)), [np.full(a.shape, 1e-4, np.float32) for a in w]


def descend(w: Weights, x: np.ndarray, y: np.ndarray, rate: float, epochs: int, seed: int, batch: int = 256) -> Weights:
    """Adagrad steps over the windows ``x`` with classes ``y``; embeddings included."""
    w, past = start_of(w)
    r = np.random.default_rng(seed)
    for _ in range(epochs):
        order = r.permutation(len(x))
        steps_down(w, past, x[order], y[order], rate, batch)
    return w


def training_windows(docs: DataFrame, text: str, bits: int, side: int) -> DataFrame:
    """The buckets of all words of all documents, packed in runs with ``side`` places of padding (-1) behind each text."""
    def pick(batches):
        import pyarrow as pa

        held, size = [], 0
        gap = np.full(side, -1, np.int32)

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["w"])

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                b = buckets(t, bits)
                if not len(b):
                    continue
                held += [b.astype(np.int32), gap]
                size += len(b)
                if size > RUN:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    return durable(docs.select(F.col(text).cast("string").alias("t")).mapInArrow(pick, "w binary"), "windows")


def round_positions(count: int, number: int, rounds: int, steps: int, r: np.random.Generator) -> tuple[np.ndarray, int]:
    """The places among ``count`` positions of a run that a round trains on, in order, and the batch size.

    A long run is dealt out to the rounds, so that all of them together take every position once; a short one is taken whole,
    several times, in each round.
    """
    epochs = min(20, steps * 256 // count)
    if epochs >= 1:
        return np.concatenate([r.permutation(count) for _ in range(epochs)]), 256
    mine = np.arange(number % rounds, count, rounds)
    return r.permutation(mine), 2048 if len(mine) >= 16 * 2048 else 256


def train_round(windows: DataFrame, v: Vocabulary, w: Weights, side: int, rate: float, number: int, steps: int, rounds: int = 1,
                every: int = 1) -> Weights:
    """One round: every partition descends from ``w``, one run after the other; the average comes back in chunks of fixed size.

    With ``every`` above 1 only a hash-chosen share of the positions is trained on, the others are context.
    """
    shared = windows.sparkSession.sparkContext.broadcast((tuple(v), tuple(w)))
    shapes = [a.shape for a in w]

    def local(batches):
        import pyarrow as pa

        mine, n = None, 0
        gap = np.zeros(side, np.int64)
        offsets = np.array([k for k in range(2 * side + 1) if k != side])
        for batch in batches:
            voc = Vocabulary(*shared.value[0])
            for run in batch.column(0).to_pylist():
                b = np.frombuffer(run, dtype=np.int32)
                live = b >= 0
                padded = np.concatenate((gap, np.where(live, voc.input[b], 0), gap))
                if every > 1:
                    live &= (b + np.arange(len(b)) * 2654435761) * 40503 % 1000003 % every == 0
                live = np.flatnonzero(live)
                if not len(live):
                    continue
                mine = mine or start_of(Weights(*shared.value[1]))
                places, size = round_positions(len(live), number, rounds, steps, np.random.default_rng(number))
                at = live[places]
                for i in range(0, len(at), PIECE):
                    p = at[i:i + PIECE]
                    steps_down(*mine, padded[p[:, None] + offsets], voc.output[b[p]], rate, size)
                n += len(live)
        if n:
            total = np.concatenate([a.ravel() for a in mine[0]]).astype(np.float64) * n
            parts = np.array_split(total, CHUNKS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()),
                 pa.array([n] * CHUNKS, pa.int64())], names=["chunk", "sums", "n"])

    def add(batches):
        import pyarrow as pa

        sums, n = {}, {}
        for batch in batches:
            for c, blob, k in zip(*(batch.column(i).to_pylist() for i in range(3))):
                part = np.frombuffer(blob)
                sums[c] = part if c not in sums else sums[c] + part
                n[c] = n.get(c, 0) + k
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary()),
             pa.array(list(n.values()), pa.int64())], names=["chunk", "sums", "n"])

    schema = "chunk int, sums binary, n long"
    rows = (windows.mapInArrow(local, schema).repartition(CHUNKS, "chunk").mapInArrow(add, schema)
            .orderBy("chunk").collect())
    if not rows:
        return w
    flat = np.concatenate([np.frombuffer(r["sums"]) / r["n"] for r in rows])
    out, at = [], 0
    for shape in shapes:
        size = int(np.prod(shape))
        out.append(flat[at:at + size].reshape(shape).astype(np.float32))
        at += size
    return Weights(*out)


def train(docs: DataFrame, text: str = "text", classes: int = 128, inputs: int = 4096, bits: int = 17, side: int = 3,
          width: int = 16, hidden: int = 32, every: int = 1, rounds: int = 3, steps: int = 150,
          rate: float = 0.08) -> tuple[Vocabulary, Weights]:
    windows = training_windows(docs, text, bits, side)
    counts = count_buckets(windows, bits)
    v = vocabulary(counts, classes, inputs, bits)
    w = fresh(v, side, width, hidden, counts)
    for number in range(rounds):
        w = train_round(windows, v, w, side, rate, number, steps, rounds, every)
    return v, w


def text_scores(texts: list[bytes | None], v: Vocabulary, w: Weights, side: int, piece: int = 2048) -> list[tuple]:
    """(tokens, summed log-probability) of each text; texts are laid end to end with padding between."""
    each = [buckets(t, v.bits) for t in texts]
    sizes = np.array([len(b) for b in each])
    gap = np.zeros(side, dtype=np.int64)
    ids = np.concatenate([x for b in each for x in (v.input[b], gap)] or [gap])
    live = np.concatenate([x for b in each for x in (np.ones(len(b), bool), gap.astype(bool))] or [gap.astype(bool)])
    b = np.concatenate(each) if each else np.empty(0, np.int64)
    padded = np.concatenate((gap, ids, gap))
    at = np.flatnonzero(live)
    logs = np.empty(len(at))
    offsets = np.array([k for k in range(2 * side + 1) if k != side])
    for i in range(0, len(at), piece):
        p = at[i:i + piece]
        mine = b[i:i + piece]
        logs[i:i + piece] = log_class(w, padded[p[:, None] + offsets], v.output[mine]) + v.share[mine]
    ends = np.cumsum(sizes)
    run = np.concatenate(([0.0], np.cumsum(logs)))
    return [(int(n), float(run[e] - run[e - n])) for n, e in zip(sizes, ends)]


def score(docs: DataFrame, model: tuple[Vocabulary, Weights], text: str = "text", carry: list[str] | None = None,
          side: int = 3) -> DataFrame:
    """Every row (carried columns as struct ``doc``) with ``n_tokens``, ``log_likelihood`` and ``per_token``."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(map(tuple, model)))

    def answer(texts):
        v, w = Vocabulary(*shared.value[0]), Weights(*shared.value[1])
        out = []
        for i in range(0, len(texts), 128):
            out += text_scores(texts[i:i + 128], v, w, side)
        return [(n, s, s / n if n else None) for n, s in out]

    return per_text(docs, text, carry or ["doc_id"], answer,
                    "n_tokens long, log_likelihood double, per_token double", raw=True)
