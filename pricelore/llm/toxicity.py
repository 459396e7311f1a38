"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the sum of a word embedding and the mean of its character n-gram embeddings, both by hashing. The network
reads windows of WINDOW words; windows overlap by WINDOW - STRIDE words and cover the whole text. Attention weighs the states of
both directions, and a text's score is its highest window's. Labels are of whole texts, so training looks for
the telling windows itself: after a first pass over random windows, each labelled text is stood for by those of its windows that
score highest so far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import batch_of, texts_of
from .decontam import words_of

WINDOW, STRIDE = 12, 8
WIDTH, HIDDEN = 16, 8
WORD_BUCKETS, GRAM_BUCKETS, GRAMS = 8192, 32_768, (3, 4, 5)
#: The bound of the training sample: texts of each label, and the longest text among them, in characters.
SAMPLE_TEXTS, SAMPLE_CHARS = 1000, 30_000
EPOCHS, BATCH, SEED = 6, 256, 7
#: Batches in an epoch at least; the first has twice as many.
STEPS = 40
#: Embeddings learn faster by this factor, as their common scale slows most of them.
EMBEDDING_RATE = 20
#: Words whose inputs a worker keeps, and windows that it scores at once.
KEPT_WORDS, WINDOWS_AT_ONCE = 400_000, 2048
#: Words whose n-grams are looked at together in training.
WORDS_AT_ONCE = 8192


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct words: word bucket of each, n-gram buckets of all in order, and where each word's begin."""
    from xxhash import xxh32_intdigest

    word = np.fromiter((xxh32_intdigest(w) % WORD_BUCKETS for w in words), np.int64, len(words))
    text = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint32)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    room = np.repeat(ends, sizes) - np.arange(len(text))
    buckets, owners = [], []
    for n in GRAMS:
        ok = np.flatnonzero(room >= n)
        h = np.full(len(ok), n, np.uint32)
        for j in range(n):
            h = (h ^ text[ok + j]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        buckets.append((h % np.uint32(GRAM_BUCKETS)).astype(np.int64))
        owners.append(owner[ok])
    buckets, owners = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return word, buckets[order], np.searchsorted(owners[order], np.arange(len(words)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def windows_of(ids: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """All windows of a text's word ids; the last is filled up with 0, a text without words has one of zeros."""
    n = max(1, -(-(len(ids) - window) // stride) + 1)
    padded = np.zeros((n - 1) * stride + window, ids.dtype)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, window)[::stride]


class Network:
    """Weights, and the inputs of words met so far: row 0 of the inputs is the padding's."""

    def __init__(self, rng: np.random.Generator | None = None):
        rng = rng or np.random.default_rng(SEED)
        f, h, d = np.float32, HIDDEN, WIDTH
        r = lambda *shape, s: (rng.standard_normal(shape) * s).astype(f)
        self.p = {
            "word": r(WORD_BUCKETS, d, s=0.02), "gram": r(GRAM_BUCKETS, d, s=0.1),
            "wx": r(d, 6 * h, s=d**-0.5), "bx": np.zeros(6 * h, f),
            "u0": r(h, 3 * h, s=h**-0.5), "u1": r(h, 3 * h, s=h**-0.5),
            "att": r(2 * h, s=0.3), "out": r(2 * h, s=0.3), "bias": np.array([-1.0], f),
        }

    def vectors(self, words: list[bytes]) -> np.ndarray:
        """Inputs of distinct words."""
        out = []
        for a in range(0, len(words), 20_000):
            word, grams, starts = _grams(words[a : a + 20_000])
            counts = np.diff(np.append(starts, len(grams)))
            out.append(self.p["word"][word] + np.add.reduceat(self.p["gram"][grams], starts, axis=0) / counts[:, None].astype(np.float32))
        return np.concatenate(out) if out else np.zeros((0, WIDTH), np.float32)

    def run(self, gates: np.ndarray, windows: np.ndarray, keep: bool = False):
        """Logits of windows of places in `gates`, the words' projected inputs; with keep, what backward() needs."""
        h, p = HIDDEN, self.p
        n, steps = windows.shape
        states = np.empty((steps, n, 2 * h), np.float32)
        kept = []
        for side, u in enumerate((p["u0"], p["u1"])):
            own = gates[:, side * 3 * h : (side + 1) * 3 * h]
            state = np.zeros((n, h), np.float32)
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                x = own[windows[:, t]]
                m = state @ u
                zr = _sigmoid(x[:, : 2 * h] + m[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(x[:, 2 * h :] + r * m[:, 2 * h :])
                after = new + z * (state - new)
                if keep:
                    kept.append((side, t, z, r, new, m[:, 2 * h :], state))
                state = after
                states[t, :, side * h : (side + 1) * h] = state
        weight = states @ p["att"]
        blank = windows.T == 0
        blank[0] = False
        weight[blank] = -1e9
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnd->nd", weight, states)
        logits = pooled @ p["out"] + p["bias"][0]
        return (logits, (states, weight, pooled, kept)) if keep else logits

    def backward(self, gates: np.ndarray, windows: np.ndarray, memory, dlogits: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the recurrent part, and of the gates."""
        h, p = HIDDEN, self.p
        states, weight, pooled, kept = memory
        g = {"out": pooled.T @ dlogits, "bias": dlogits.sum(keepdims=True)}
        dpooled = dlogits[:, None] * p["out"]
        dstates = weight[:, :, None] * dpooled
        dweight = np.einsum("tnd,nd->tn", states, dpooled)
        dscore = weight * (dweight - (weight * dweight).sum(axis=0))
        g["att"] = np.einsum("tn,tnd->d", dscore, states)
        dstates += dscore[:, :, None] * p["att"]
        dgates = np.zeros_like(gates)
        du = [np.zeros_like(p["u0"]), np.zeros_like(p["u1"])]
        carry = None
        for side, t, z, r, new, m, state in reversed(kept):
            if carry is None or carry[0] != side:
                carry = (side, np.zeros_like(state))
            dh = dstates[t, :, side * h : (side + 1) * h] + carry[1]
            dz = dh * (state - new) * z * (1 - z)
            dn = dh * (1 - z) * (1 - new * new)
            dr = dn * m * r * (1 - r)
            dx = np.concatenate((dz, dr, dn), axis=1)
            dm = np.concatenate((dz, dr, dn * r), axis=1)
            u = p["u1"] if side else p["u0"]
            du[side] += state.T @ dm
            carry = (side, dh * z + dm @ u.T)
            np.add.at(dgates[:, side * 3 * h : (side + 1) * 3 * h], windows[:, t], dx)
        g["u0"], g["u1"] = du
        return g, dgates


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Network:
    """A network from labelled texts. Either label may be missing: then all texts score alike."""
    rng = np.random.default_rng(SEED)
    net = Network(rng)
    place: dict[bytes, int] = {}
    texts_ids = [np.fromiter((place.setdefault(w, len(place) + 1) for w in words_of(t)), np.int64) for t in texts]
    words = list(place)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.p["out"][:] = 0
        net.p["bias"][0] = 2.0 if len(y) and y.max() > 0 else -2.0
        return net
    # In parts, as the n-grams of all words at once take some hundred megabytes on the driver.
    found = [_grams(words[a : a + WORDS_AT_ONCE]) for a in range(0, len(words), WORDS_AT_ONCE)]
    shifts = np.concatenate(([0], np.cumsum([len(g) for _, g, _ in found])))
    word, grams, starts = (np.concatenate([np.zeros(0, np.int32), *x]) for x in ([w.astype(np.int32) for w, _, _ in found], [g.astype(np.int32) for _, g, _ in found], [(s + shift).astype(np.int32) for (_, _, s), shift in zip(found, shifts)]))
    stops = np.append(starts[1:], len(grams)).astype(np.int32) if len(words) else starts
    del found, place
    every = [windows_of(i.astype(np.int32)) for i in texts_ids]
    owner = np.repeat(np.arange(len(every)), [len(w) for w in every])
    first = np.concatenate(([0], np.cumsum([len(w) for w in every])))
    every = np.concatenate(every)
    momentum = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0

    def inputs(of: np.ndarray):
        """Inputs of words by their places; the padding's is zero."""
        out = np.zeros((len(of), WIDTH), np.float32)
        real = np.flatnonzero(of > 0)
        k = of[real] - 1
        counts = stops[k] - starts[k]
        flat = np.repeat(starts[k] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        if len(k):
            out[real] = net.p["word"][word[k]] + np.add.reduceat(net.p["gram"][grams[flat]], np.concatenate(([0], np.cumsum(counts)[:-1])), axis=0) / counts[:, None]
        return out, real, k, counts, flat

    def learn(rows: np.ndarray, targets: np.ndarray, weights: np.ndarray, rate: float) -> None:
        nonlocal step
        of, windows = np.unique(every[rows], return_inverse=True)
        windows = windows.reshape(len(rows), -1)
        if of[0] != 0:  # place 0 stays the padding's
            of, windows = np.concatenate(([0], of)), windows + 1
        x, real, k, counts, flat = inputs(of)
        gates = x @ net.p["wx"] + net.p["bx"]
        logits, memory = net.run(gates, windows, keep=True)
        d = ((_sigmoid(logits) - targets) * weights / weights.sum()).astype(np.float32)
        g, dgates = net.backward(gates, windows, memory, d)
        g["wx"], g["bx"] = x.T @ dgates, dgates.sum(axis=0)
        dx = (dgates @ net.p["wx"].T)[real]
        g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
        np.add.at(g["word"], word[k], dx)
        np.add.at(g["gram"], grams[flat], np.repeat(dx / counts[:, None].astype(np.float32), counts, axis=0))
        step += 1
        for name, grad in g.items():
            momentum[name] += 0.1 * (grad - momentum[name])
            # Embeddings share one scale, so that a rare word or n-gram moves less than a frequent one and isn't learned by heart.
            square[name] += 0.01 * ((np.square(grad).max() if name in ("word", "gram") else grad * grad) - square[name])
            net.p[name] -= rate * (EMBEDDING_RATE if name in ("word", "gram") else 1) * (momentum[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-6)

    def scores() -> np.ndarray:
        gates = np.concatenate([inputs(np.arange(a, min(a + WORDS_AT_ONCE, len(words) + 1)))[0] @ net.p["wx"] + net.p["bx"] for a in range(0, len(words) + 1, WORDS_AT_ONCE)])
        return np.concatenate([net.run(gates, every[a : a + WINDOWS_AT_ONCE]) for a in range(0, len(every), WINDOWS_AT_ONCE)])

    positive, negative = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for epoch in range(epochs):
        if epoch == 0:
            # Any window of a text may be the telling one: some at random.
            pick = np.concatenate([first[i] + rng.choice(n, min(n, 12), replace=False) for i in range(len(y)) if (n := first[i + 1] - first[i])])
        else:
            s = scores()
            best = []
            for i in range(len(y)):
                own = s[first[i] : first[i + 1]]
                top = np.argsort(-own, kind="stable")[: 1 if y[i] else 2]
                best.append(first[i] + top)
                if not y[i]:
                    best.append(first[i] + rng.integers(0, len(own), 2))
            pick = np.concatenate(best)
        rng.shuffle(pick)
        target = y[owner[pick]]
        share = {1.0: 0.5 / max(1, (target == 1).sum()), 0.0: 0.5 / max(1, (target == 0).sum())}
        weight = np.array([share[float(t)] for t in target], np.float32) * len(target)
        for _ in range(max(1, -(-(STEPS if epoch else 2 * STEPS) * BATCH // len(pick)))):
            for a in range(0, len(pick), BATCH):
                learn(pick[a : a + BATCH], target[a : a + BATCH], weight[a : a + BATCH], 0.01 if epoch < epochs - 2 else 0.003)
    # The bias at which the two kinds of texts are told apart best, by their highest windows.
    s = scores()
    top = np.array([s[first[i] : first[i + 1]].max() for i in range(len(y))])
    order = np.argsort(top)
    miss = np.concatenate(([0], np.cumsum(y[order] == 1))) / len(positive) + (len(negative) - np.concatenate(([0], np.cumsum(y[order] == 0)))) / len(negative) * 3
    cut = int(np.flatnonzero(miss == miss.min())[len(np.flatnonzero(miss == miss.min())) // 2])
    edge = np.concatenate(([top[order][0] - 1], top[order], [top[order][-1] + 1]))
    net.p["bias"][0] -= float(edge[cut] + edge[cut + 1]) / 2
    return net


class Scorer:
    """Scores texts with a network, and keeps the projected inputs of the words that it has met."""

    def __init__(self, net: Network):
        self.net = net
        self.place: dict[bytes, int] = {}
        self.gates = np.zeros((1024, 6 * HIDDEN), np.float32)
        self.gates[0] = net.p["bx"]

    def _learn(self, new: list[bytes]) -> None:
        if len(self.place) + len(new) > KEPT_WORDS:
            self.place.clear()
        a = len(self.place) + 1
        while a + len(new) > len(self.gates):
            self.gates = np.concatenate((self.gates, np.zeros_like(self.gates)))
        self.gates[a : a + len(new)] = self.net.vectors(new) @ self.net.p["wx"] + self.net.p["bx"]
        self.place.update(zip(new, range(a, a + len(new))))

    def scores(self, texts: list[str]) -> list[float]:
        split = [words_of(t) for t in texts]
        out: list[float] = []
        at = 0
        while at < len(split):  # as many texts at a time as have words for the table
            seen: set[bytes] = set()
            until = at
            while until < len(split) and (until == at or len(seen) < KEPT_WORDS // 4):
                seen.update(split[until])
                until += 1
            new = seen.difference(self.place)
            if len(self.place) + len(new) > KEPT_WORDS:
                self.place.clear()
                new = seen
            self._learn(list(new))
            out += self._score(split[at:until])
            at = until
        return out

    def _score(self, split: list[list[bytes]]) -> list[float]:
        get = self.place.__getitem__
        windows = [windows_of(np.fromiter(map(get, words), np.int32, len(words))) for words in split]
        starts = np.concatenate(([0], np.cumsum([len(w) for w in windows])[:-1]))
        every = np.concatenate(windows)
        logits = np.concatenate([self.net.run(self.gates, every[a : a + WINDOWS_AT_ONCE]) for a in range(0, len(every), WINDOWS_AT_ONCE)])
        return _sigmoid(np.maximum.reduceat(logits, starts).astype(float)).tolist()


def crc_remainder(id_col: str):
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """Labelled texts for training: of each label those `texts` ids with the smallest hashes whose remainder isn't 0,
    without texts over `chars` characters."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (crc_remainder(id_col) != 0)).groupBy(F.col(id_col).alias("__i")).agg(F.max(label_col).alias("__y"))
    chosen = [r for y in (0, 1) for r in known.filter(F.col("__y") == y).orderBy(F.xxhash64("__i"), "__i").limit(texts).collect()]
    if not chosen:
        return [], []
    few = docs.sparkSession.createDataFrame([(r["__i"], int(r["__y"])) for r in chosen], T.StructType([T.StructField("__i", labels.schema[id_col].dataType), T.StructField("__y", T.IntegerType())]))
    found = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).filter(F.length("__text") <= chars)
    # At most 2 * texts rows are broadcast; of an id's texts the first in order counts.
    first = found.join(F.broadcast(few), F.col("__id") == F.col("__i")).groupBy("__id", "__y").agg(F.min("__text").alias("__text"))
    rows = sorted(((r["__id"], r["__text"], r["__y"]) for r in first.collect()), key=lambda r: (r[0], r[1]))
    return [r[1] for r in rows], [r[2] for r in rows]


def score_toxicity(df: DataFrame, net: Network, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The kept columns with score, from 0 to 1, and predicted: 1 if the score is 0.5 or more, else 0.

    Every window of the whole text is scored; the highest counts. A null or empty text has the score of an empty window. Rows
    stand for themselves.
    """
    shared = df.sparkSession.sparkContext.broadcast(net.p)
    kept = texts_of(df, text_col, *keep)
    fields = [f for f in kept.schema.fields if f.name != "__text"]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    arrow: pa.Schema = to_arrow_schema(schema)

    def run(batches):
        net = Network.__new__(Network)
        net.p = shared.value
        scorer = Scorer(net)
        for b in batches:
            scores = scorer.scores(b.column(b.num_columns - 1).to_pylist())
            yield batch_of(arrow, [*[b.column(i).cast(arrow.field(i).type) for i in range(len(fields))], scores, [int(s >= 0.5) for s in scores]])

    return kept.mapInArrow(run, schema)


def reject_toxic(df: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """df without the rows that the network finds toxic; columns stay as they are."""
    columns = df.columns
    scored = score_toxicity(df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__whole"), F.col(f"`{text_col}`").alias("__body")), net, ("__whole",), "__body")
    return scored.filter(F.col("predicted") == 0).select(*[F.col("__whole").getField(c).alias(c) for c in columns])
