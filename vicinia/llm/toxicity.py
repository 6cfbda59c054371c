"""Toxicity: a bidirectional gated recurrent network over characters and words, with attention pooling, in numpy.

A word's UTF-8 bytes pass a small bidirectional GRU; its two last states and the
word's own entry (if training knew the word) feed a second bidirectional GRU
over the words of a window. Attention pools that one's states into a logit. A
text's score is the largest over all its overlapping windows.

Training is multi-instance: a label belongs to a text, so every window of a clean
text is clean, and of a toxic text the windows that score highest are toxic. It
takes a bounded sample of labelled rows: SAMPLE texts of each class at most, the
first by the hash of their ids, and of those as many whole texts as SAMPLE_BYTES
hold. A sampled text is learned from in all its windows, which are cut as for
scoring. Scores depend on texts alone. Fits and scores repeat exactly.

Nulls and edges: a null or wordless text scores 0; words of more than LONGEST
bytes are taken as several; texts of any length are scored whole, in bounded
blocks of windows; rows with a null doc_id are scored and, as their label cannot
be known, not learned from; repeated rows score alike, and of rows with one doc_id
one text is learned from, the first in order; where one class has no labels, every text scores 0; an empty table gives an empty result; other columns
are ignored by `scores`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh, staged
from .shingles import CHUNK, GAPS, run_hashes, runs

#: Words of a window, and words from one window's start to the next's.
WINDOW, STRIDE = 32, 24
LONGEST = 24
#: Bounds of the training sample: rows of each class, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 1200, 16 << 20
#: Searches for the hardest windows, each followed by a pass over the sample, or by several where it is small, so that there are about STEPS.
EPOCHS, STEPS, BATCH, RATE = 6, 270, 128, 0.01
VOCABULARY = 4096
CHARS, HIDDEN, ATTEND = 8, 8, 8
#: Words whose windows are scored at once.
BLOCK = 1 << 17
#: A gate's input that keeps the state as it is, for what pads a word or a window.
KEEP = 30.0


# --- words and windows ----------------------------------------------------------


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes lowered, starts, ends, hashes) of the words in `data`, those of more than LONGEST bytes cut into several."""
    low = np.frombuffer(data.lower(), np.uint8)
    starts, ends = runs(low)
    if len(starts) and (ends - starts).max() > LONGEST:
        pieces = -(-(ends - starts) // LONGEST)
        first = np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(starts, pieces) + LONGEST * (np.arange(len(first)) - first)
        ends = np.minimum(starts + LONGEST, np.repeat(ends, pieces))
    return low, starts, ends, run_hashes(low, starts, ends)


def window_starts(n: int) -> np.ndarray:
    """Where the windows over `n` words start; the last one may be short."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else np.zeros(0, np.int64)


@dataclass
class Lexicon:
    """The distinct words of some windows: their bytes, lengths and hashes. Window entries point into it; its size means none."""

    letters: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[Lexicon, np.ndarray]:
        own, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        begin, lengths = starts[first], ends[first] - starts[first]
        place = np.arange(LONGEST)
        at = np.minimum(begin[:, None] + place, max(len(low) - 1, 0))
        letters = np.where(place < lengths[:, None], low[at].astype(np.int64), 256)
        return cls(letters, lengths, own), which.astype(np.int64)


def windows_over(texts: list[bytes]) -> tuple[Lexicon, np.ndarray, np.ndarray]:
    """The words of `texts`, their windows as rows of places in that lexicon, and the number of each window's text."""
    low, starts, ends, hashes = words_of(b"\n".join(texts))
    lexicon, which = Lexicon.of(low, starts, ends, hashes)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    word = np.append(np.searchsorted(starts, begin), len(starts))
    own = [window_starts(n) for n in np.diff(word).tolist()]
    counts = [len(w) for w in own]
    first = np.concatenate([np.zeros(0, np.int64), *(w + a for w, a in zip(own, word.tolist()))])
    upto, owner = np.repeat(word[1:], counts), np.repeat(np.arange(len(texts)), counts)
    at = first[:, None] + np.arange(WINDOW)
    windows = np.where(at < upto[:, None], which[np.minimum(at, len(which) - 1)] if len(which) else 0, len(lexicon.hashes))
    return lexicon, windows, owner


def by_length(lexicon: Lexicon) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and letters of words of like length, a bounded number at a time."""
    for low, high in ((0, 4), (4, 7), (7, 10), (10, 14), (14, LONGEST)):
        own = np.flatnonzero((lexicon.lengths > low) & (lexicon.lengths <= high))
        for k in range(0, len(own), 8192):
            some = own[k : k + 8192]
            yield some, lexicon.letters[some, :high]


# --- the network ------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gru(inputs: np.ndarray, u: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (T, N, H) over gate inputs (T, N, 3H), in the order given; what a backward pass needs if `keep`."""
    steps, n, wide = inputs.shape
    h = np.zeros((n, wide // 3), np.float32)
    size = h.shape[1]
    states, kept = np.empty((steps, n, size), np.float32), []
    for t in range(steps):
        x, s = inputs[t], h @ u
        gates = sigmoid(x[:, : 2 * size] + s[:, : 2 * size])
        z, r = gates[:, :size], gates[:, size:]
        new = np.tanh(x[:, 2 * size :] + r * s[:, 2 * size :])
        if keep:
            kept.append((h, z, r, new, s[:, 2 * size :]))
        h = new + z * (h - new)
        states[t] = h
    return states, kept


def gru_back(grads: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of `u` from those of the states."""
    steps, n, size = grads.shape
    d_inputs, du, dh = np.empty((steps, n, 3 * size), np.float32), np.zeros_like(u), np.zeros((n, size), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, new, s = kept[t]
        dh = dh + grads[t]
        dnew = dh * (1 - z) * (1 - new * new)
        dz = dh * (h - new) * z * (1 - z)
        dr = dnew * s * r * (1 - r)
        d_inputs[t, :, :size], d_inputs[t, :, size : 2 * size], d_inputs[t, :, 2 * size :] = dz, dr, dnew
        ds = np.concatenate([dz, dr, dnew * r], axis=1)
        du += h.T @ ds
        dh = dh * z + ds @ u.T
    return d_inputs, du


def pad_row(size: int) -> np.ndarray:
    row = np.zeros(3 * size, np.float32)
    row[:size] = KEEP
    return row


class Network:
    def __init__(self, known: np.ndarray, seed: int = 0):
        """`known`: the sorted hashes of the words with entries of their own."""
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.known = known
        self.slope, self.shift = 1.0, 0.0
        self.p = {}
        for side in "fb":
            self.p |= {f"letter_{side}": normal(256, 3 * CHARS), f"char_u_{side}": normal(CHARS, 3 * CHARS), f"word_{side}": normal(len(known) + 1, 3 * HIDDEN) * 0.1}
            self.p |= {f"to_word_{side}": normal(2 * CHARS, 3 * HIDDEN), f"word_u_{side}": normal(HIDDEN, 3 * HIDDEN)}
        self.p |= {"attend": normal(2 * HIDDEN, ATTEND), "attend_b": np.zeros(ATTEND, np.float32), "query": normal(ATTEND), "out": normal(2 * HIDDEN), "out_b": np.full(1, -1.0, np.float32)}

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words in the word tables; 0 for a word unknown."""
        at = np.searchsorted(self.known, hashes)
        at = np.minimum(at, max(len(self.known) - 1, 0))
        return np.where(self.known[at] == hashes, at + 1, 0) if len(self.known) else np.zeros(len(hashes), np.int64)

    def _letters(self, letters: np.ndarray, side: str) -> np.ndarray:
        table = np.concatenate([self.p[f"letter_{side}"], pad_row(CHARS)[None]])
        order = letters.T if side == "f" else letters.T[::-1]
        return table[order]

    def spelled(self, lexicon: Lexicon) -> np.ndarray:
        """The last states of both directions over each word's bytes; words of like length together."""
        out = np.empty((len(lexicon.lengths), 2 * CHARS), np.float32)
        for some, letters in by_length(lexicon):
            for j, side in enumerate("fb"):
                states, _ = gru(self._letters(letters, side), self.p[f"char_u_{side}"])
                out[some, j * CHARS : (j + 1) * CHARS] = states[-1]
        return out

    def inputs(self, chars: np.ndarray, ids: np.ndarray, side: str) -> np.ndarray:
        """Gate inputs of each word of a lexicon, and of padding behind them."""
        return np.concatenate([self.p[f"word_{side}"][ids] + chars @ self.p[f"to_word_{side}"], pad_row(HIDDEN)[None]])

    def logits(self, lexicon: Lexicon, windows: np.ndarray) -> np.ndarray:
        """A logit for each row of `windows`, entries of `lexicon`."""
        chars, ids = self.spelled(lexicon), self.ids(lexicon.hashes)
        tables = [self.inputs(chars, ids, side) for side in "fb"]
        out = []
        for k in range(0, len(windows), 2048):
            own = windows[k : k + 2048].T
            forth, _ = gru(tables[0][own], self.p["word_u_f"])
            back, _ = gru(tables[1][own[::-1]], self.p["word_u_b"])
            out.append(self._pooled(np.concatenate([forth, back[::-1]], axis=2), own == len(chars))[0])
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def _pooled(self, states: np.ndarray, padded: np.ndarray):
        bent = np.tanh(states @ self.p["attend"] + self.p["attend_b"])
        score = np.where(padded, np.float32(-1e9), bent @ self.p["query"])
        share = np.exp(score - score.max(0))
        share /= share.sum(0)
        pooled = (share[..., None] * states).sum(0)
        return pooled @ self.p["out"] + self.p["out_b"][0], (bent, share, pooled)

    def gradients(self, lexicon: Lexicon, windows: np.ndarray, wanted: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss over `windows`. Some known words are hidden, so that spelling has to tell."""
        p, g = self.p, {}
        chars, spelled = np.empty((len(lexicon.lengths), 2 * CHARS), np.float32), []
        for some, letters in by_length(lexicon):
            for j, side in enumerate("fb"):
                ran_letters = gru(self._letters(letters, side), p[f"char_u_{side}"], True)
                chars[some, j * CHARS : (j + 1) * CHARS] = ran_letters[0][-1]
                spelled.append((some, letters, j, side, ran_letters))
        ids = np.where(rng.random(len(lexicon.hashes)) < 0.5, 0, self.ids(lexicon.hashes))
        own = windows.T
        turned = {"f": own, "b": own[::-1]}
        ran = {side: gru(self.inputs(chars, ids, side)[turned[side]], p[f"word_u_{side}"], True) for side in "fb"}
        states = np.concatenate([ran["f"][0], ran["b"][0][::-1]], axis=2)
        padded = own == len(chars)
        logit, (bent, share, pooled) = self._pooled(states, padded)

        d = ((sigmoid(logit) - wanted) * weight / len(windows)).astype(np.float32)
        g["out"], g["out_b"] = pooled.T @ d, d.sum(keepdims=True)
        d_pooled = d[:, None] * p["out"]
        d_states = share[..., None] * d_pooled
        along = (states * d_pooled).sum(2)
        d_score = share * (along - (share * along).sum(0))
        g["query"] = np.einsum("tn,tna->a", d_score, bent)
        d_bent = d_score[..., None] * p["query"] * (1 - bent * bent)
        flat = d_bent.reshape(-1, ATTEND)
        g["attend"], g["attend_b"] = states.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(0)
        d_states = d_states + d_bent @ p["attend"].T
        d_chars = np.zeros_like(chars)
        for j, side in enumerate("fb"):
            own_grads = d_states[..., j * HIDDEN : (j + 1) * HIDDEN]
            d_in, g[f"word_u_{side}"] = gru_back(own_grads if side == "f" else own_grads[::-1], ran[side][1], p[f"word_u_{side}"])
            d_table = np.zeros((len(chars) + 1, 3 * HIDDEN), np.float32)
            np.add.at(d_table, turned[side].ravel(), d_in.reshape(-1, 3 * HIDDEN))
            d_table = d_table[:-1]
            g[f"word_{side}"] = np.zeros_like(p[f"word_{side}"])
            np.add.at(g[f"word_{side}"], ids, d_table)
            g[f"to_word_{side}"] = chars.T @ d_table
            d_chars += d_table @ p[f"to_word_{side}"].T
        for side in "fb":
            g[f"char_u_{side}"], g[f"letter_{side}"] = np.zeros_like(p[f"char_u_{side}"]), np.zeros_like(p[f"letter_{side}"])
        for some, letters, j, side, (own_states, kept) in spelled:
            d_last = np.zeros_like(own_states)
            d_last[-1] = d_chars[some, j * CHARS : (j + 1) * CHARS]
            d_in, d_u = gru_back(d_last, kept, p[f"char_u_{side}"])
            g[f"char_u_{side}"] += d_u
            order = (letters.T if side == "f" else letters.T[::-1]).ravel()
            real = order < 256
            np.add.at(g[f"letter_{side}"], order[real], d_in.reshape(-1, 3 * CHARS)[real])
        return g


class Adam:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.m, self.v, self.t = p, {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        for k, x in g.items():
            x = x * np.float32(scale)
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.002 * (x * x - self.v[k])
            self.p[k] -= (rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.998**self.t)) + 1e-6)).astype(np.float32)


# --- training ---------------------------------------------------------------------


def fit(texts: list[bytes], labels: list[int], seed: int = 0) -> Network | None:
    """A network trained on the windows of each text; None where a class is missing."""
    if not 0 < sum(labels) < len(labels):
        return None
    rng = np.random.default_rng(seed)
    lexicon, windows, owner = windows_over(texts)
    counts = np.bincount(windows[windows < len(lexicon.hashes)], minlength=1)  # by windows that a word is in
    common = np.argsort(-counts, kind="stable")[:VOCABULARY]
    network = Network(np.sort(lexicon.hashes[common[counts[common] >= 3]]), seed)
    adam, toxic = Adam(network.p), np.array(labels)[owner]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    each = max(1, 5 * len(texts) // (2 * BATCH))
    passes = -(-STEPS // (EPOCHS * each))
    total, done = EPOCHS * passes * each, 0
    logit = rng.random(len(owner))
    for turn in range(EPOCHS * passes):
        if turn and turn % passes == 0:
            logit = network.logits(lexicon, windows)
        apart = turn >= max(2, passes)  # until then nothing tells a toxic text's windows apart
        picked = []
        for i, label in enumerate(labels):
            own = np.arange(bounds[i], bounds[i + 1])
            if not len(own):
                continue
            ranked = own[np.argsort(-logit[own], kind="stable")]
            if label:  # the likeliest windows of a toxic text
                picked += [*(ranked[:1] if apart else ranked[:3]), *[w for w in ranked[1:3] if apart and logit[w] > 0]]
            else:  # the hardest window of a clean text, and any two
                picked += [ranked[0], *rng.choice(own, min(2, len(own)), replace=False)]
        picked = rng.permutation(np.array(picked))
        share = max(1e-6, toxic[picked].mean())
        for k in range(0, len(picked), BATCH):
            some = picked[k : k + BATCH]
            used, inverse = np.unique(windows[some], return_inverse=True)
            inverse = inverse.reshape(len(some), WINDOW)
            used = used[used < len(lexicon.hashes)]  # padding has the largest number, so it still points behind the rest
            small = Lexicon(lexicon.letters[used], lexicon.lengths[used], lexicon.hashes[used])
            wanted = toxic[some].astype(np.float32)
            weight = np.where(wanted > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
            if len(used):
                adam.step(network.gradients(small, inverse, wanted, weight, rng), RATE * max(0.1, 1 - 0.9 * done / total))
            done += 1
    logit = network.logits(lexicon, windows).astype(np.float64)
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, owner, logit)
    real = np.isfinite(best)
    network.slope, network.shift = calibrated(best[real], np.array(labels, float)[real])
    return network


def calibrated(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift by which the texts' largest logits fit their labels, both classes weighing alike; drawn to slope 1."""
    weight = np.where(labels > 0, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
    x = np.stack([logits, np.ones_like(logits)], axis=1)
    at, pull = np.array([1.0, 0.0]), np.array([0.05, 1e-4]) * len(labels)
    for _ in range(100):
        p = sigmoid(np.clip(x @ at, -30, 30))
        slope = x.T @ (weight * (p - labels)) + pull * (at - [1.0, 0.0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(curve, slope)
        at = at - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(at[0]), 0.05), float(at[1])


def taught(doc_id: Column | str = "doc_id") -> Column:
    """Whether a label may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 3 != 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, seed: int = 0) -> Network | None:
    """A network from the labelled rows of `docs` that may be learned from; the sample's bounds are the module's."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(taught())
    rank = F.xxhash64(F.lit(seed), "doc_id")
    both = [known.where(F.col("toxic") == c).orderBy(rank, "doc_id").limit(sample) for c in (0, 1)]
    chosen = {int(r["doc_id"]): (int(r["toxic"]), place) for half in both for place, r in enumerate(half.collect())}  # 2 * sample rows at most
    picks = docs.sparkSession.createDataFrame([(i, *told) for i, told in chosen.items()], "own long, toxic int, place int")
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picks), F.col("doc_id") == F.col("own"))
    # One text an id, however often it repeats; and of those, as many as fit into the bytes, both classes by turns.
    rows = staged(met.groupBy("own", "toxic", "place").agg(F.coalesce(F.min("text"), F.lit("")).alias("text")), "toxicity-sample")
    wanted, size = [], 0
    for r in sorted(rows.select("own", "place", F.octet_length("text").alias("bytes")).collect(), key=lambda r: (r["place"], r["own"])):
        if size + r["bytes"] <= sample_bytes:
            size += r["bytes"]
            wanted.append(r["own"])
    texts = sorted(rows.where(F.col("own").isin(wanted)).collect(), key=lambda r: r["own"])
    return fit([r["text"].encode("utf-8", "surrogatepass") for r in texts], [r["toxic"] for r in texts], seed)


# --- scoring ----------------------------------------------------------------------


def _pieces(data: bytes) -> Iterator[bytes]:
    """`data` in pieces that end at white space, to bound what is held; neighbours share a window of words."""
    at = 0
    while len(data) - at > CHUNK:
        end = at + CHUNK
        while end > at + CHUNK // 2 and not GAPS[data[end - 1]]:
            end -= 1
        yield data[at:end]
        back = end
        for _ in range(WINDOW):
            while back > at and GAPS[data[back - 1]]:
                back -= 1
            while back > max(at, end - CHUNK // 4) and not GAPS[data[back - 1]]:
                back -= 1
        at = back
    yield data[at:]


def score_texts(network: Network, texts: list[str | None]) -> np.ndarray:
    """The score of each text: the largest over its windows, 0 without any."""
    best = np.zeros(len(texts))
    held: list[tuple[int, bytes]] = []
    size = 0

    def run() -> None:
        lexicon, windows, owner = windows_over([piece for _, piece in held])
        if len(windows):
            text = np.array([i for i, _ in held])[owner]
            np.maximum.at(best, text, sigmoid(network.slope * network.logits(lexicon, windows).astype(np.float64) + network.shift))
        held.clear()

    for i, text in enumerate(texts):
        for piece in _pieces((text or "").encode("utf-8", "surrogatepass")):
            held.append((i, piece))
            size += len(piece)
            if size > 6 * BLOCK:
                run()
                size = 0
    if held:
        run()
    return best


def scores(docs: DataFrame, network: Network | None, name: str = "score") -> DataFrame:
    """`docs` with the score as column `name`: double."""
    columns = [c for c in docs.columns if c.lower() != name.lower()]
    if network is None:
        return docs.select(*columns, F.lit(0.0).alias(name))
    shipped = docs.sparkSession.sparkContext.broadcast(network)  # of a size that VOCABULARY bounds

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(score_texts(shipped.value, [t if isinstance(t, str) else None for t in part]))

    return docs.select(*columns, score(F.col("text").cast("string")).alias(name))


def toxic_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs`, by a network that learns from the labels that it may."""
    scored = scores(docs.select("doc_id", "text"), train(docs, labels))
    held_out = F.coalesce(~taught(), F.lit(False))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` that score below `threshold`, with their columns."""
    network = train(docs, labels)
    if network is None:
        return docs
    name = fresh(docs, "score")
    return scores(docs, network, name).where(F.col(name) < threshold).drop(name)
