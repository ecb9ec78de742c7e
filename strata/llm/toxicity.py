"""Operator 5: toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is an embedding of its hash beside the mean of its character trigrams' embeddings (with marks for
beginning and end). Two gated recurrent layers read windows of 32 words in both directions; attention pools their
states and a logistic unit scores the window. A text is cut into overlapping windows, half a window apart, the last
one at the text's end, and all of them are scored; the text's score is the calibrated highest of them.

Labels of at most ``sample_rows`` labelled documents (a bounded, documented sample, those of smallest hash) are learnt
from, never those of held-out rows (crc32 of the id's decimals divisible by 5). All windows of these documents take
part: executors score them with the network as it is at the time, and the driver gets as many as its steps draw, each
window alike. First each window has its document's label; then, of toxic documents, only windows that the network finds
toxic, the highest at least. Calibration (a logistic fit on the documents' highest window) takes the maximum over all
windows, as scoring does. Scoring covers everything.

Defined results: a null text, or one without words, is a single window with one empty word; a run of more than 64
characters is several words, in training as in scoring, so that very long texts and words need no more memory for a window;
without labels of both kinds all scores are the share of toxic labels (0 where there is none); an id with several labels
is toxic if one of them says so; of a labelled id that stands at several texts, the one of least hash is learnt from; a
null id isn't held out and has no label; repeated rows are scored one by one and alike; language, source and id are no
inputs; other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, drop_cut
from .texts import hold, map_texts


@dataclass(frozen=True)
class ToxicityParams:
    window: int = 32
    stride: int = 16
    word_rows: int = 8192
    char_rows: int = 4096
    width: int = 8
    hidden: int = 8
    sample_rows: int = 8000
    steps: int = 1000
    batch: int = 256
    rate: float = 0.01
    #: Share of a batch's distinct words that are told by their characters alone, and the embeddings' decay.
    drop: float = 0.8
    decay: float = 2.0
    seed: int = 5
    #: Whether calibration gives both labels the same weight.
    balanced: bool = False


CACHE_WORDS = 150_000
WORD_CHARS = 64


def words_of(text: str | None) -> list[str]:
    """Words in lower case; a run of more than WORD_CHARS characters is several words, so that windows stay small."""
    words = (text or "").lower().split() or [""]
    if max(map(len, words)) > WORD_CHARS:
        words = [w[k:k + WORD_CHARS] for w in words for k in range(0, len(w), WORD_CHARS)]
    return words


def starts(n: int, p: ToxicityParams) -> list[int]:
    """Where the windows over n words begin."""
    if n <= p.window:
        return [0]
    out = list(range(0, n - p.window, p.stride))
    return [*out, n - p.window]


def word_features(words: list[str], p: ToxicityParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word's embedding, rows of all words' trigrams one after the other, where each word's begin)."""
    ids = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % p.word_rows for w in words], np.int64)
    codes = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(w) + 2 for w in words])
    h = codes[:-2] * np.uint64(1_000_003) + codes[1:-1] * np.uint64(8_191) + codes[2:] * np.uint64(131) if len(codes) > 2 else np.zeros(0, np.uint64)
    h = (h ^ (h >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    tri = np.append(h % np.uint64(p.char_rows), [0, 0]).astype(np.int64)
    keep = np.ones(len(codes), bool)
    keep[ends - 1] = False
    keep[ends - 2] = False  # trigrams that would reach into the next word
    short = np.array([not w for w in words])
    keep[ends[short] - 2] = True  # an empty word has its two marks alone, whatever word comes next
    tri[ends[short] - 2] = 0
    sizes = np.array([max(1, len(w)) for w in words])
    return ids, tri[keep], np.cumsum(sizes) - sizes


class Network:
    def __init__(self, p: ToxicityParams, weights: dict[str, np.ndarray] | None = None):
        self.p = p
        if weights is None:
            rng = np.random.default_rng(p.seed)
            n = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
            e, h = 2 * p.width, p.hidden
            weights = {"Ew": n(p.word_rows, p.width, scale=0.3), "Ec": n(p.char_rows, p.width, scale=0.3), "v": n(h, scale=0.5), "Wa": n(2 * h, h, scale=0.35), "ba": np.zeros(h, np.float32), "w": n(2 * h, scale=0.35), "b": np.zeros(1, np.float32)}
            for d in "fr":
                weights |= {f"W{d}": n(e, 3 * h, scale=0.3), f"b{d}": np.zeros(3 * h, np.float32), f"U{d}": n(h, 3 * h, scale=0.35), f"c{d}": np.zeros(h, np.float32)}
        self.w = weights

    def embed(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        ids, tri, first = word_features(words, self.p)
        sizes = np.diff(np.append(first, len(tri)))
        chars = np.add.reduceat(self.w["Ec"][tri], first, axis=0) / sizes[:, None].astype(np.float32)
        return np.hstack([self.w["Ew"][ids], chars]).astype(np.float32), (ids, tri, sizes)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Inputs of both directions' gates for each word."""
        return np.hstack([x @ self.w["Wf"] + self.w["bf"], x @ self.w["Wr"] + self.w["br"]])

    def _direction(self, gates: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States (T, N, H) from gate inputs (T, N, 3H); mask (T, N, 1) or None."""
        steps, n, _ = gates.shape
        h_size, u, c = self.p.hidden, self.w[f"U{d}"], self.w[f"c{d}"]
        h = np.zeros((n, h_size), np.float32)
        out = np.empty((steps, n, h_size), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a, g = h @ u, gates[t]
            rz = 1 / (1 + np.exp(-(a[:, :2 * h_size] + g[:, :2 * h_size])))
            r, z = rz[:, :h_size], rz[:, h_size:]
            inner = a[:, 2 * h_size:] + c
            new = np.tanh(g[:, 2 * h_size:] + r * inner)
            if keep is not None:
                keep.append((t, h, r, z, inner, new))
            nxt = new + z * (h - new)
            h = nxt if mask is None else h + mask[t] * (nxt - h)
            out[t] = h
        return out

    def forward(self, gates: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
        """Window logits from gate inputs (T, N, 6H)."""
        h3 = 3 * self.p.hidden
        kf, kr = ([], []) if keep is not None else (None, None)
        states = np.concatenate([self._direction(gates[:, :, :h3], mask, "f", kf), self._direction(gates[:, :, h3:], mask, "r", kr)], axis=2)
        tilt = np.tanh(states @ self.w["Wa"] + self.w["ba"])
        score = tilt @ self.w["v"]
        if mask is not None:
            score = np.where(mask[:, :, 0] > 0, score, np.float32(-1e9))
        alpha = np.exp(score - score.max(axis=0))
        alpha /= alpha.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", alpha, states)
        if keep is not None:
            keep |= {"kf": kf, "kr": kr, "states": states, "tilt": tilt, "alpha": alpha, "pooled": pooled}
        return pooled @ self.w["w"] + self.w["b"]

    def gradients(self, idx: np.ndarray, mask: np.ndarray, x: np.ndarray, made: tuple, y: np.ndarray, told: np.ndarray | float = 1.0) -> tuple[float, dict[str, np.ndarray]]:
        """Mean logistic loss of windows (T, N) of words and its gradient by weight."""
        p, w, keep = self.p, self.w, {}
        h = p.hidden
        logit = self.forward(self.project(x)[idx], mask, keep)
        prob = 1 / (1 + np.exp(-logit))
        loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
        d = ((prob - y) / len(y)).astype(np.float32)
        g = {"w": keep["pooled"].T @ d, "b": d.sum(keepdims=True)}
        dpool = d[:, None] * w["w"]
        states, alpha, tilt = keep["states"], keep["alpha"], keep["tilt"]
        dstates = alpha[:, :, None] * dpool
        dalpha = np.einsum("tnh,nh->tn", states, dpool)
        dscore = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        g["v"] = np.einsum("tn,tnh->h", dscore, tilt)
        dtilt = dscore[:, :, None] * w["v"] * (1 - tilt * tilt)
        g["Wa"] = np.einsum("tni,tnj->ij", states, dtilt)
        g["ba"] = dtilt.sum(axis=(0, 1))
        dstates += dtilt @ w["Wa"].T
        dgates = np.zeros((*idx.shape, 6 * h), np.float32)
        for k, name in enumerate("fr"):
            u, part = w[f"U{name}"], slice(3 * h * k, 3 * h * (k + 1))
            gu, gc = np.zeros_like(u), np.zeros_like(w[f"c{name}"])
            dh = np.zeros((idx.shape[1], h), np.float32)
            for t, prev, r, z, inner, new in reversed(keep["k" + name]):
                dh = dh + dstates[t, :, h * k:h * (k + 1)]
                m = mask[t]
                dn = dh * m
                dprev = dh * (1 - m) + dn * z
                dz = dn * (prev - new) * z * (1 - z)
                da = dn * (1 - z) * (1 - new * new)
                dr = da * inner * r * (1 - r)
                dgates[t, :, part] = np.hstack([dr, dz, da])
                back = np.hstack([dr, dz, da * r])
                gu += prev.T @ back
                gc += back[:, 2 * h:].sum(axis=0)
                dh = dprev + back @ u.T
            g[f"U{name}"], g[f"c{name}"] = gu, gc
        dproj = np.zeros((len(x), 6 * h), np.float32)
        np.add.at(dproj, idx.ravel(), dgates.reshape(-1, 6 * h))
        dx = np.zeros_like(x)
        for k, name in enumerate("fr"):
            dp = dproj[:, 3 * h * k:3 * h * (k + 1)]
            g[f"W{name}"], g[f"b{name}"] = x.T @ dp, dp.sum(axis=0)
            dx += dp @ w[f"W{name}"].T
        dx *= told
        ids, tri, sizes = made
        g["Ew"], g["Ec"] = np.zeros_like(w["Ew"]), np.zeros_like(w["Ec"])
        np.add.at(g["Ew"], ids, dx[:, :p.width])
        np.add.at(g["Ec"], tri, np.repeat(dx[:, p.width:] / sizes[:, None].astype(np.float32), sizes, axis=0))
        return loss, g

    def batch(self, windows: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(word numbers (T, N), mask, the distinct words)."""
        place: dict[str, int] = {}
        idx = np.zeros((self.p.window, len(windows)), np.int64)
        mask = np.zeros((self.p.window, len(windows), 1), np.float32)
        for n, ws in enumerate(windows):
            idx[:len(ws), n] = [place.setdefault(x, len(place)) for x in ws]
            mask[:len(ws), n] = 1
        return idx, mask, list(place)

    def logits(self, windows: list[list[str]]) -> np.ndarray:
        out = []
        for k in range(0, len(windows), 4096):
            idx, mask, words = self.batch(windows[k:k + 4096])
            out.append(self.forward(self.project(self.embed(words)[0])[idx], mask))
        return np.concatenate(out) if out else np.zeros(0, np.float32)


@dataclass
class Model:
    params: ToxicityParams
    weights: dict[str, np.ndarray] | None  # None: no network could be trained
    slope: float
    offset: float  # without a network: the share of toxic labels


def rounds(p: ToxicityParams) -> list[tuple[int, int]]:
    """First step and number of steps of the rounds: windows are chosen anew in each."""
    at = [0, *(p.steps * k // 7 for k in (2, 3, 4, 5))]
    return [(a, b - a) for a, b in zip(at, [*at[1:], p.steps], strict=True)]


def fit(p: ToxicityParams, choose: Callable, tops: Callable) -> Model:
    """A network trained on the windows (words with single spaces between) that ``choose(net, steps)`` gives for a
    round's steps: of toxic documents, of others, and of others those that look toxic; net is None in the first round.
    ``tops(net)``: the calibrating documents' highest logits and their labels."""
    net, rng = Network(p), np.random.default_rng(p.seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    half = p.batch // 2
    sizes = (half, half // 2, p.batch - half - half // 2)
    y = np.repeat(np.array([1, 0], np.float32), [half, p.batch - half])
    for first, steps in rounds(p):
        pools = choose(net if first else None, steps)
        for step in range(first, first + steps):
            windows = [pool[i].split(" ") for pool, n in zip(pools, sizes, strict=True) for i in rng.integers(len(pool), size=n)]
            idx, mask, words = net.batch(windows)
            x, made = net.embed(words)
            told = np.ones_like(x)
            told[rng.random(len(words)) < p.drop, :p.width] = 0
            _, g = net.gradients(idx, mask, x * told, made, y, told)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():
                v = v / max(1.0, norm / 5)
                m, s = moment[k]
                m += 0.1 * (v - m)
                s += 0.01 * (v * v - s)
                rate = p.rate * (0.1 if step > p.steps * 4 // 5 else 1)
                net.w[k] -= (rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(s / (1 - 0.99 ** (step + 1))) + 1e-8)).astype(np.float32)
                if k in ("Ew", "Ec"):
                    net.w[k] *= np.float32(1 - rate * p.decay)
    top, labels = tops(net)
    a, b = 1.0, 0.0  # logistic fit by Newton's method
    weight = np.where(labels > 0, 0.5 / labels.sum(), 0.5 / (1 - labels).sum()) if p.balanced else np.full(len(labels), 1 / len(labels))
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(a * top + b, -30, 30)))
        r, s = weight * (q - labels), weight * q * (1 - q)
        grad = np.array([(r * top).sum() + 1e-4 * a, r.sum()])
        hess = np.array([[(s * top * top).sum() + 1e-4, (s * top).sum()], [(s * top).sum(), s.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -2, 2)
    return Model(p, net.w, float(max(a, 0.05)), float(b))


def apart(spare_toxic: int, spare_clean: int, other_toxic: int) -> bool:
    """Whether a fifth of the documents is kept for calibration alone: if both parts have enough of both labels."""
    return min(spare_toxic, spare_clean, other_toxic) >= 5


def train(rows: list[tuple[list[list[str]], int]], p: ToxicityParams) -> Model:
    """A network from (windows, label) of documents; every fifth is kept for calibration."""
    labels = np.array([y for _, y in rows], np.float32)
    if not len(labels) or labels.min() == labels.max():
        return Model(p, None, 0.0, float(labels.mean()) if len(labels) else 0.0)
    spare = np.arange(len(rows)) % 5 == 0
    if not apart(labels[spare].sum(), (1 - labels[spare]).sum(), labels[~spare].sum()):
        spare[:] = False
    windows = [w for ws, _ in rows for w in ws]
    owner = np.array([i for i, (ws, _) in enumerate(rows) for _ in ws])
    y = np.where(spare[owner], np.float32(-1), labels[owner])
    ones, zeros = np.flatnonzero(y > 0), np.flatnonzero(y == 0)
    texts = [" ".join(w) for w in windows]

    def choose(net, steps):
        some, hard = ones, zeros
        if net is not None:
            z = net.logits(windows)
            hard = zeros[np.argsort(-z[zeros])[:max(1, len(zeros) // 20)]]
            best = {int(owner[i]): i for i in ones[np.argsort(z[ones])]}
            some = np.array(sorted({*ones[z[ones] > 0].tolist(), *best.values()}))
        return [[texts[i] for i in pool] for pool in (some, zeros, hard)]

    def tops(net):
        top = np.full(len(rows), -np.inf)
        np.maximum.at(top, owner, net.logits(windows))
        use = spare if spare.any() else ~spare
        return top[use], labels[use]

    return fit(p, choose, tops)


class Scorer:
    """Scores whole texts; inputs of words are kept in a bounded table."""

    def __init__(self, model: Model):
        hold("words", lambda: None)
        self.model, self.net = model, Network(model.params, model.weights) if model.weights else None
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, 6 * model.params.hidden), np.float32)

    def __call__(self, texts: list[str | None]) -> list[float]:
        if self.net is None:
            return [self.model.offset] * len(texts)
        z = np.clip(self.model.slope * self.highest(texts) + self.model.offset, -30, 30)
        return np.round(1 / (1 + np.exp(-z)), 6).tolist()

    def highest(self, texts: list[str | None]) -> np.ndarray:
        """The highest logit over all windows of each text."""
        p, known = self.model.params, self.known
        if len(known) > CACHE_WORDS:
            known.clear()
            self.table = self.table[:0]
        split = [words_of(t) for t in texts]
        new: dict[str, None] = {}
        for ws in split:
            new.update(dict.fromkeys([w for w in ws if w not in known]))
        if new:
            names = list(new)
            more = [self.net.project(self.net.embed(names[k:k + 50_000])[0]) for k in range(0, len(names), 50_000)]
            known.update(zip(names, range(len(self.table), len(self.table) + len(names)), strict=True))
            self.table = np.vstack([self.table, *more])
        flat = np.array([known[w] for ws in split for w in ws], np.int64)
        sizes = np.array([len(ws) for ws in split])
        base = np.cumsum(sizes) - sizes
        begin, owner = [], []
        for i, n in enumerate(sizes.tolist()):
            s = starts(n, p)
            begin.extend([int(base[i]) + x for x in s])
            owner.extend([i] * len(s))
        begin, owner = np.array(begin), np.array(owner)
        left = np.minimum((base + sizes)[owner] - begin, p.window)
        best = np.full(len(texts), -np.inf)
        steps = np.arange(p.window)[:, None]
        for part, masked in ((np.flatnonzero(left == p.window), False), (np.flatnonzero(left < p.window), True)):
            for k in range(0, len(part), 4096):
                at = part[k:k + 4096]
                where = begin[at][None, :] + (np.minimum(steps, left[at][None, :] - 1) if masked else steps)
                mask = (steps < left[at][None, :]).astype(np.float32)[:, :, None] if masked else None
                np.maximum.at(best, owner[at], self.net.forward(self.table[flat[where]], mask))
        return best


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> Model:
    """Trains on the bounded sample of rows. All their windows stay with the executors; the driver gets what it draws."""
    rank = F.xxhash64(F.lit(p.seed), "doc_id")
    some = labels.select("doc_id", "toxic").dropna().filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(rank, "doc_id").limit(p.sample_rows)
    some = cut(some, "labels")  # sample_rows rows at most
    own = docs.select("doc_id", F.col("text").alias("t")).join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("t", F.xxhash64("t")).alias("text"))
    own = own.withColumn("row", F.xxhash64("doc_id"))

    def make() -> Callable:
        def work(texts):
            split = [words_of(t) for t in texts]
            return [[[" ".join(ws[a:a + p.window]) for a in starts(len(ws), p)] for ws in split]]

        return work

    every = map_texts(own, [("windows", "array<string>", pa.list_(pa.string()))], make, keep=("row", "toxic"))
    every = every.select("row", (F.col("toxic") > 0).alias("toxic"), (F.pmod(F.xxhash64(F.lit(p.seed), "row"), F.lit(5)) == 0).alias("spare"), F.posexplode("windows").alias("at", "text"))
    every = cut(every.repartition(24, "row", "at"), "windows")
    n = {(r["toxic"], r["spare"]): r["n"] for r in every.filter("at = 0").groupBy("toxic", "spare").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows
    toxic, clean = (sum(v for k, v in n.items() if k[0] == kind) for kind in (True, False))
    if not toxic or not clean:
        return Model(p, None, 0.0, float(bool(toxic)))
    kept = apart(n.get((True, True), 0), n.get((False, True), 0), n.get((True, False), 0))
    learnt = every.filter(~F.col("spare")) if kept else every
    half, turn = p.batch // 2, iter(range(len(rounds(p))))

    def logits(df: DataFrame, net: Network) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(Model(p, net.w, 1.0, 0.0))  # the weights: a fixed size

        def make() -> Callable:
            scorer = Scorer(sent.value)
            return lambda texts: [[round(float(z), 4) for z in scorer.highest(texts)]]

        return map_texts(df, [("z", "double", pa.float64())], make, keep=(*df.columns,))

    def choose(net, steps):
        draw = F.xxhash64(F.lit(next(turn)), "row", "at")
        drawn = lambda df, k: [r["text"] for r in df.orderBy(draw, "row", "at").limit(k * steps).select("text").collect()]  # noqa: E731 (what the steps draw)
        if net is None:
            zeros = drawn(learnt.filter("not toxic"), p.batch - half)
            return drawn(learnt.filter("toxic"), half), zeros, zeros
        now = cut(logits(learnt, net), "logits")
        best = now.filter("toxic").groupBy("row").agg(F.max("z").alias("best"))
        ones = now.filter("toxic").join(best, "row").filter("z > 0 or z = best")
        clean = now.filter("not toxic")
        edge = clean.agg(F.percentile_approx("z", 0.95, 10000)).first()[0]
        out = drawn(ones, half), drawn(clean, half // 2), drawn(clean.filter(F.col("z") >= edge), p.batch - half - half // 2)
        drop_cut(now)
        return out

    def tops(net):
        use = every.filter("spare") if kept else every
        rows = logits(use, net).groupBy("row", "toxic").agg(F.max("z").alias("z")).orderBy("row").collect()  # sample_rows rows at most
        return np.array([r["z"] for r in rows]), np.array([float(r["toxic"]) for r in rows])

    model = fit(p, choose, tops)
    drop_cut(every)
    return model


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the weights: a fixed size

    def make() -> Callable:
        scorer = Scorer(sent.value)
        return lambda texts: [scorer(texts)]

    return map_texts(docs, [(name, "double", pa.float64())], make, keep=keep)


def toxicity(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    out = scored(docs, learn(docs, labels, p))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op5_toxicity": query}
ORACLES: dict = {}
