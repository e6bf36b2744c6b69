"""Gated recurrent language model (operator 5).

Counts of all training tokens come first, folded in the tasks. The most frequent
words (``HEAD``) are modelled by the network, grouped in classes of
``CLASS_WORDS`` by rank; all other words belong to ``TAILS`` tail classes, by
their ending, and have a static probability inside their class by count. The output is factored: class given the state, then word given class
and state.

The network (numpy, in the tasks) is one gated recurrent layer. Training is
data-parallel: in each round every task starts from the same parameters, trains
on its documents by truncated backpropagation with the state carried from window
to window, and the parameters are averaged, weighted by tokens, in two levels.
Every training document adds to the counts and trains the network once, in the
round that its hash names.

Scoring carries the state through each whole document. Words beyond the ``KNOWN``
most frequent ones are not broadcast: a document's rare words are joined with their
counts by Spark, and their part of the score is added.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantweave.llm.base import query, read, staged
from quantweave.llm.simhash import normal_words

KNOWN, HEAD, CLASS_WORDS, TAILS = 200_000, 2048, 64, 32
HIDDEN, EMBED = 16, 8
ROUNDS, SHARE = 2, 1.0
LANES, WINDOW, RATE = 256, 32, 0.02
SCORE_LANES, SCORE_WINDOW = 512, 32
BLOCK, FAN, LOG_STEPS = 8192, 64, 256
END = b""
PUNCTUATION = b".,;:!?"
HEADS = HEAD // CLASS_WORDS


def tail_class(word: bytes) -> int:
    """By the last two bytes before closing punctuation, and whether there is any."""
    bare = word.rstrip(PUNCTUATION)
    return zlib.crc32(bare[-2:]) % (TAILS // 2) + TAILS // 2 * (len(bare) < len(word))


def token_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows of ``texts(text)``; the end token is the empty word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "c": pa.array(list(counts.values()), pa.int64())})
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(normal_words(text))
                counts[END] += 1
                if len(counts) > 500_000:
                    yield flush()
                    counts.clear()
        if counts:
            yield flush()
    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The known words, by rank, and the totals behind the static probabilities. Ids from
    ``KNOWN`` on stand for rare words of one tail class each."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, types: int, tail_total: np.ndarray, tail_types: np.ndarray):
        self.ids = {w: i for i, w in enumerate(words)}
        n, c = len(words), np.array(counts, float)
        self.rare, self.total, self.types = n, total, types
        tails = np.array([tail_class(w) for w in words], np.int64) if n else np.empty(0, np.int64)
        head = np.arange(n) < HEAD
        self.cls = np.r_[np.where(head, np.arange(n) // CLASS_WORDS, HEADS + tails), HEADS + np.arange(TAILS)].astype(np.int32)
        self.input = np.r_[np.where(head, np.arange(n), HEAD + tails), HEAD + np.arange(TAILS)].astype(np.int32)
        room = np.log(np.maximum(1, tail_total + tail_types + 1))
        self.static = np.r_[np.where(head, 0.0, np.log(c + 1) - room[tails]), -room]
        self.base = np.r_[np.log(c + 1), np.zeros(TAILS)] - np.log(total + types + 1)
        self.known = np.r_[np.ones(n), np.zeros(TAILS)]
        self.head_counts = np.zeros(HEAD)
        self.head_counts[:min(n, HEAD)] = c[:HEAD]
        self.class_counts = np.r_[self.head_counts.reshape(HEADS, -1).sum(1), tail_total]
        self.end = self.ids.get(END, n)

    def encode(self, words: list[bytes]) -> np.ndarray:
        ids = np.fromiter(map(self.ids.get, words, itertools.repeat(-1)), np.int32, len(words))
        rare = np.flatnonzero(ids < 0)
        ids[rare] = [self.rare + tail_class(words[i]) for i in rare.tolist()]
        return ids


def new_parameters(vocab: Vocabulary) -> dict[str, np.ndarray]:
    """Small random weights; output biases start at the counts, so training starts from the unigram model."""
    rng, H = np.random.default_rng(5), HIDDEN
    draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    return {"E": draw(HEAD + TAILS, EMBED) * 5, "Wx": draw(EMBED, 3 * H) * 3, "Wh": draw(H, 3 * H) * 2, "b": np.zeros(3 * H, np.float32),
            "Wc": draw(H, HEADS + TAILS), "bc": np.log(vocab.class_counts + 0.5).astype(np.float32),
            "Wo": draw(HEAD, H), "bo": np.log(vocab.head_counts + 0.5).astype(np.float32)}


def flat(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflat(v: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = v[at:at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


class Lanes:
    """Whole documents one after another in lanes of about equal length, longest first. A window reads
    only the lanes that still have tokens, so a very long document does not narrow the others."""

    def __init__(self, docs: list[np.ndarray], end: int, lanes: int, window: int):
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        lanes = max(1, min(lanes, len(docs)))
        held, fill = [[] for _ in range(lanes)], np.zeros(lanes, np.int64)
        for i in order:
            k = int(fill.argmin())
            held[k].append(i)
            fill[k] += len(docs[i]) + 1
        by_size = np.argsort(-fill, kind="stable")
        self.size, self.window = fill[by_size], window
        self.first = np.r_[0, np.cumsum(self.size + window)[:-1]]  # each lane ends with a window of padding
        n = int((self.size + window).sum())
        self.x, self.y, self.doc = np.full(n, end, np.int32), np.full(n, end, np.int32), np.full(n, -1, np.int32)
        self.start = np.zeros(n, bool)
        for lane, at in zip(by_size.tolist(), self.first.tolist(), strict=True):
            for i in held[lane]:
                m = len(docs[i])
                self.x[at + 1:at + m + 1], self.y[at:at + m] = docs[i], docs[i]
                self.doc[at:at + m + 1], self.start[at] = i, True
                at += m + 1

    def __iter__(self):
        """(input ids, target ids, documents (-1: none), start flags) of each window, arrays of (time, lane)."""
        steps = np.arange(self.window)[:, None]
        for at in range(0, int(self.size[0]), self.window):
            live = int(np.searchsorted(-self.size, -at, "left"))  # sizes fall
            places = self.first[:live] + at + steps
            yield self.x[places], self.y[places], self.doc[places], self.start[places]


def sigmoid(x):
    """In place."""
    np.negative(x, x)
    np.exp(x, x)
    x += 1
    return np.reciprocal(x, x)


def states(p: dict, x: np.ndarray, start: np.ndarray, h: np.ndarray, keep: bool = False):
    """States after each step of a window; with ``keep`` also what backpropagation needs."""
    H, (T, B) = HIDDEN, x.shape
    gx = (p["E"] @ p["Wx"] + p["b"])[x]  # one row for each input word
    W, U = np.ascontiguousarray(p["Wh"][:, :2 * H]), np.ascontiguousarray(p["Wh"][:, 2 * H:])
    out, begins = np.empty((T, B, H), np.float32), start.any(1)
    trace = np.empty((4, T, B, H), h.dtype) if keep else None  # state before, reset, update, candidate
    for t in range(T):
        prev = np.where(start[t][:, None], np.float32(0), h) if begins[t] else h
        rz = prev @ W
        rz += gx[t, :, :2 * H]
        rz = sigmoid(rz)
        r, z = rz[:, :H], rz[:, H:]
        c = (r * prev) @ U
        c += gx[t, :, 2 * H:]
        np.tanh(c, c)
        h = c - prev
        h *= z
        h += prev
        out[t] = h
        if keep:
            trace[0, t], trace[1, t], trace[2, t], trace[3, t] = prev, r, z, c
    return out, h, trace


def softmax_at(logits: np.ndarray, column: np.ndarray, grad: bool):
    """ln of the softmax at ``column`` of each row, and the sum of exponentials. With ``grad``, ``logits`` becomes
    the gradient times minus that sum: the caller scales the narrow side. Clipped only where an exponential could overflow."""
    if logits.size and logits.max() > 80:
        np.minimum(logits, np.float32(80), logits)
    rows = np.arange(len(column))
    at = logits[rows, column]
    np.exp(logits, logits)
    s = np.einsum("ij->i", logits)
    if grad:
        logits[rows, column] -= s
    return at - np.log(s), s


def class_log_probability(p: dict, h: np.ndarray, cls: np.ndarray, grads: dict | None = None):
    """ln P(class) of each row, and the gradient of its sum by the state if ``grads`` are asked for (None else)."""
    logits = h @ p["Wc"]
    logits += p["bc"]
    out, s = softmax_at(logits, cls, grads is not None)
    if grads is None:
        return out, None
    scale = -1 / s
    grads["Wc"], grads["bc"] = (h * scale[:, None]).T @ logits, scale @ logits
    dh = logits @ p["Wc"].T
    dh *= scale[:, None]
    return out, dh


def word_log_probability(p: dict, h: np.ndarray, ids: np.ndarray, cls: np.ndarray, grads: dict | None = None, dh: np.ndarray | None = None):
    """ln P(word | class) of head words, class by class; adds gradients if asked for."""
    order = np.argsort(cls.astype(np.uint16), kind="stable")
    hs, inside, out = h[order], ids[order] % CLASS_WORDS, np.empty(len(ids), np.float32)
    cuts = np.r_[0, np.cumsum(np.bincount(cls, minlength=HEADS))].tolist()
    back = np.empty_like(hs) if grads is not None else None
    for k in range(HEADS):
        a, b = cuts[k], cuts[k + 1]
        if a == b:
            continue
        span = slice(k * CLASS_WORDS, (k + 1) * CLASS_WORDS)
        W = p["Wo"][span]
        logits = hs[a:b] @ W.T
        logits += p["bo"][span]
        out[a:b], s = softmax_at(logits, inside[a:b], grads is not None)
        if grads is not None:
            scale = -1 / s
            grads["Wo"][span] = logits.T @ (hs[a:b] * scale[:, None])
            grads["bo"][span] = scale @ logits
            np.multiply(logits @ W, scale[:, None], back[a:b])
    if grads is not None:
        dh[order] = back
    gain = np.empty_like(out)
    gain[order] = out
    return gain


def gradients(p: dict, vocab: Vocabulary, x, y, live, start, h):
    """Gradient of the mean log probability over one window, its sum, and the last state."""
    H, (T, B) = HIDDEN, x.shape
    hs, last, trace = states(p, x, start, h, keep=True)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    rows = np.flatnonzero(live.ravel())
    hr, ids = hs.reshape(-1, H)[rows], y.ravel()[rows]
    cls = vocab.cls[ids]
    gain, dr = class_log_probability(p, hr, cls, g)
    head = np.flatnonzero(ids < min(HEAD, vocab.rare))
    dh = np.zeros((len(head), H), np.float32)
    gain = gain.sum() + word_log_probability(p, hr[head], ids[head], cls[head], g, dh).sum()
    dr[head] += dh
    dout = np.zeros((T * B, H), np.float32)
    dout[rows] = dr
    dout = dout.reshape(T, B, H)
    W, U = np.ascontiguousarray(p["Wh"][:, :2 * H].T), np.ascontiguousarray(p["Wh"][:, 2 * H:].T)
    P, R, Z, C = trace
    # What does not depend on the steps to come is computed for the whole window at once.
    to_c, to_z, to_r, stays = Z * (1 - C * C), (C - P) * (Z - Z * Z), P * (R - R * R), 1 - Z
    carry, begins = np.zeros((B, H), np.float32), start.any(1)
    dc, drz = np.empty((T, B, H), np.float32), np.empty((T, B, 2 * H), np.float32)
    for t in range(T - 1, -1, -1):
        dt = dout[t]
        dt += carry
        np.multiply(dt, to_c[t], dc[t])
        drp = dc[t] @ U
        np.multiply(drp, to_r[t], drz[t, :, :H])
        np.multiply(dt, to_z[t], drz[t, :, H:])
        carry = drz[t] @ W
        dt *= stays[t]
        carry += dt
        drp *= R[t]
        carry += drp
        if begins[t]:
            carry[start[t]] = 0
    dc, drz = dc.reshape(-1, H), drz.reshape(-1, 2 * H)
    g["Wh"][:, :2 * H], g["Wh"][:, 2 * H:] = P.reshape(-1, H).T @ drz, (R * P).reshape(-1, H).T @ dc
    dgx = np.concatenate([drz, dc], 1)
    inputs = x.ravel()
    g["b"], g["Wx"] = dgx.sum(0), p["E"][inputs].T @ dgx
    de = np.ascontiguousarray((dgx @ p["Wx"].T).T)
    for j in range(EMBED):
        g["E"][:, j] = np.bincount(inputs, weights=de[j], minlength=len(p["E"]))
    n = max(1, len(rows))
    return {k: v / n for k, v in g.items()}, float(gain), last


def train_on(p: dict, vocab: Vocabulary, docs: list[np.ndarray], moments: dict, lanes: int = LANES, window: int = WINDOW, rate: float = RATE) -> int:
    """Truncated backpropagation over whole documents, Adam steps in place; tokens seen. The step of a window
    with few lanes left is shorter by their share, so that a long document counts by its tokens."""
    h_lanes = max(1, min(lanes, len(docs)))
    h, seen = np.zeros((h_lanes, HIDDEN), np.float32), 0
    for x, y, doc, start in Lanes(docs, vocab.end, lanes, window):
        live = doc >= 0
        g, _, h = gradients(p, vocab, vocab.input[x], y, live, start, h[:x.shape[1]])
        tokens = int(live.sum())
        seen += tokens
        moments["n"] += 1
        size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        scale, n = min(1.0, 1.0 / max(size, 1e-12)), moments["n"]
        step = rate * np.sqrt(1 - 0.999 ** n) / (1 - 0.9 ** n) * tokens / (h_lanes * window)
        for k, v in g.items():
            m, q = moments["m"][k], moments["q"][k]
            v *= scale
            m *= 0.9
            m += 0.1 * v
            q *= 0.999
            v *= v
            v *= 0.001
            q += v
            np.sqrt(q, v)
            v += 1e-8
            np.divide(m, v, v)
            v *= step
            p[k] += v
    return seen


def score_docs(p: dict, vocab: Vocabulary, docs: list[np.ndarray], lanes: int = SCORE_LANES, window: int = SCORE_WINDOW) -> np.ndarray:
    """Natural log probability of every document under the network and the static classes, state carried through."""
    h, out = np.zeros((lanes, HIDDEN), np.float32), np.zeros(len(docs))
    for x, y, doc, start in Lanes(docs, vocab.end, lanes, window) if docs else ():
        hs, h, _ = states(p, vocab.input[x], start, h[:x.shape[1]])
        rows = np.flatnonzero(doc.ravel() >= 0)
        hr, ids = hs.reshape(-1, HIDDEN)[rows], y.ravel()[rows]
        cls = vocab.cls[ids]
        gain = class_log_probability(p, hr, cls)[0] + vocab.static[ids]
        head = np.flatnonzero(ids < min(HEAD, vocab.rare))
        gain[head] += word_log_probability(p, hr[head], ids[head], cls[head])
        out += np.bincount(doc.ravel()[rows], weights=gain, minlength=len(docs))
    return out


def build_vocabulary(counts: DataFrame) -> Vocabulary:
    """From the count table: at most the ``KNOWN`` most frequent words reach the driver (whole
    steps of a logarithmic count scale), all else as sums for each tail class."""
    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, types = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
        for batch in batches:
            k = np.array([tail_class(w) for w in batch.column(0).to_pylist()], np.int64)
            total += np.bincount(k, weights=batch.column(1).to_numpy(), minlength=TAILS).astype(np.int64)
            types += np.bincount(k, minlength=TAILS)
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(TAILS), pa.int32()), "total": pa.array(total), "types": pa.array(types)})
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    steps = F.floor(F.log(F.col("c")) * LOG_STEPS)
    least, held = 0, 0
    for step, m in sorted(counts.groupBy(steps.alias("step")).count().collect(), reverse=True):  # at most LOG_STEPS * ln(N) rows
        if held + m > KNOWN:
            least = step + 1
            break
        held += m
    top = sorted(((-c, bytes(w)) for w, c in counts.filter(steps >= least).collect()))
    words, freq = [w for _, w in top], [-c for c, _ in top]
    total, types = np.zeros(TAILS), np.zeros(TAILS)
    for k, t, m in counts.mapInArrow(tails, "k int, total long, types long").groupBy("k").agg(F.sum("total"), F.sum("types")).collect():
        total[k], types[k] = t, m
    for w, c in zip(words[:HEAD], freq[:HEAD], strict=True):  # the head is not part of the tail
        total[tail_class(w)] -= c
        types[tail_class(w)] -= 1
    return Vocabulary(words, freq, int(n), int(v), total, types)


def averaged(parts: DataFrame) -> np.ndarray | None:
    """Weighted mean of parameter blocks ``(fan, block, weight, v)``, in two levels."""
    kind = "fan int, block int, weight double, v binary"

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        weight = pdf["weight"].sum()
        v = sum(np.frombuffer(raw, "<f8") * w for raw, w in zip(pdf["v"], pdf["weight"], strict=True)) / weight
        return pdf.head(1).assign(weight=weight, v=v.astype("<f8").tobytes())
    rows = parts.groupBy("fan", "block").applyInPandas(mean, kind).groupBy("block").applyInPandas(mean, kind).orderBy("block").collect()
    return np.concatenate([np.frombuffer(bytes(r.v), "<f8") for r in rows]) if rows else None


#: Tokens that a task holds while it trains.
BUFFER = 4_000_000


def id_arrays(column: pa.ListArray) -> list[np.ndarray]:
    return [x.values.to_numpy() for x in column]


def encoded(rows: DataFrame, shared, id_kind: str) -> DataFrame:
    """Every row of ``rows(doc_id, held_out, round, text)`` with its word ids, its count of known tokens, the base score of those, and its rare words.
    The texts are cut and looked up once; training and scoring read the ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            ids, rare = [], []
            for t in batch.column(3).to_pylist():
                words = normal_words(t)
                ids.append(v.encode(words))
                rare.append([words[i] for i in np.flatnonzero(ids[-1] >= v.rare).tolist()])
            base = np.array([v.base[i].sum() + v.base[v.end] for i in ids])
            known = np.array([v.known[i].sum() + v.known[v.end] for i in ids]).astype(np.int64)
            sizes = np.cumsum([0, *map(len, ids)])
            flat_ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], flat_ids, pa.array(known), pa.array(base, pa.float64()), pa.array(rare, pa.list_(pa.binary()))],
                                             names=["doc_id", "held_out", "round", "ids", "n_known", "base", "rare"])
    kind = f"doc_id {id_kind}, held_out boolean, round int, ids array<int>, n_known long, base double, rare array<binary>"
    return staged(rows.select("doc_id", "held_out", "round", "text").mapInArrow(run, kind).withColumn("row", F.monotonically_increasing_id()), "encoded")


def trained(ids: DataFrame, shared, rounds: int = ROUNDS) -> dict:
    """Parameters after ``rounds`` rounds over ``ids(ids, round)``; a round trains on its own
    documents. ``shared`` is the broadcast vocabulary."""
    context = ids.sparkSession.sparkContext
    p = new_parameters(shared.value)
    for r in range(rounds):
        current = context.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], current=current) -> Iterator[pa.RecordBatch]:
            own = {k: v.copy() for k, v in current.value.items()}
            moments = {"n": 0, "m": {k: np.zeros_like(v) for k, v in own.items()}, "q": {k: np.zeros_like(v) for k, v in own.items()}}
            seen, docs, held = 0, [], 0
            for batch in batches:
                for doc in id_arrays(batch.column(0)):
                    docs.append(doc)
                    held += len(doc) + 1
                    if held > BUFFER:
                        seen, docs, held = seen + train_on(own, shared.value, docs, moments), [], 0
            if docs:
                seen += train_on(own, shared.value, docs, moments)
            if seen:
                v = flat(own).astype("<f8")
                cuts = range(0, len(v), BLOCK)
                yield pa.RecordBatch.from_pydict({
                    "fan": pa.array([seen % FAN] * len(cuts), pa.int32()), "block": pa.array([c // BLOCK for c in cuts], pa.int32()),
                    "weight": pa.array([float(seen)] * len(cuts)), "v": pa.array([v[c:c + BLOCK].tobytes() for c in cuts], pa.binary())})
        parts = ids.filter(F.col("round") == r).select("ids").mapInArrow(run, "fan int, block int, weight double, v binary")
        mean = averaged(parts)
        current.unpersist()
        if mean is not None:
            p = unflat(mean, p)
    return p


def log_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, share: float = SHARE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    Defined cases: a null or empty text is the end token alone; a null doc_id is hashed as the
    empty text and trains; without training documents counts are zero and the
    network stays at its start; repeated rows are each counted and scored; an
    empty table gives an empty result.
    """
    rest = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7
    pick = F.pmod(F.xxhash64(doc_id, F.lit("round")), F.lit(1_000_000)) / 1_000_000
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (rest == 2).alias("held_out"),
                       F.when((rest != 2) & (pick < share), F.floor(pick / share * rounds)).cast("int").alias("round"))
    counts = staged(token_counts(rows.filter(~F.col("held_out"))), "token-counts")
    vocab = build_vocabulary(counts)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(vocab)
    id_kind = dict(rows.dtypes)["doc_id"]
    coded = encoded(rows, shared, id_kind)
    weights = context.broadcast(trained(coded.filter(~F.col("held_out")), shared, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = id_arrays(batch.column(0))
            kept = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([len(i) + 1 for i in ids], pa.int64()), pa.array(score_docs(weights.value, shared.value, ids), pa.float64())],
                                             names=["row", "doc_id", "held_out", "n_known", "base", "n_tokens", "model"])
    scored = coded.select("ids", "row", "doc_id", "held_out", "n_known", "base").mapInArrow(
        run, f"row long, doc_id {id_kind}, held_out boolean, n_known long, base double, n_tokens long, model double")
    rare = coded.select("row", F.explode("rare").alias("word")).join(counts, "word").groupBy("row").agg(
        F.count(F.lit(1)).alias("more"), F.sum(F.log(F.col("c") + 1)).alias("gain"))
    gain = F.coalesce("gain", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        ((F.col("base") + gain) / F.log(F.lit(10.0))).alias("base_score"), ((F.col("model") + gain) / F.log(F.lit(10.0))).alias("score"))


@query("op5_gru_lm_scoring")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_scores(read(spark, sf_dir, "documents"))
