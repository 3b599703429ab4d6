"""Toxicity scores by a gap-weighted subsequence kernel with Nystroem landmarks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kernel compares subsequences of three letters that span at most SPAN characters, weighted DECAY per character.
SPAN, DECAY = 6, 0.7
#: Classes of characters: 0 is none or no letter, 1-26 the letters a-z, the rest other letters.
CLASSES = 40
#: Characters of a unit; longer ones are covered by windows that overlap by half.
UNIT = 24
LANDMARKS = 96
#: Labelled documents the model is fitted on at most (those with the smallest hash of the id), characters of each at most, and clean units.
FIT_TOXIC, FIT_CLEAN, FIT_CHARS, FIT_UNITS = 1500, 3000, 50_000, 6000
#: Words of up to so many letters count as pieces of one word where they stand in a row.
PIECE = 3
#: Characters of texts whose units are held at a time.
HELD = 2_000_000
#: Evidence that a unit needs, as a share of the strongest unit's.
SURE = 0.3
_CACHED = 300_000
_GAPS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]
_SPACED = re.compile(rf"(?<!\S)\S{{1,{PIECE}}}(?:\s+\S{{1,{PIECE}}})+(?!\S)")


def _fitting(c: np.ndarray) -> list[tuple[int, int]]:
    return [(j, k) for j, k in _GAPS if k < c.shape[1]]


def letters(units: list[str]) -> np.ndarray:
    """One row of character classes per unit, as wide as the longest."""
    wide = max(map(len, units), default=1)
    c = np.frombuffer("".join(u.ljust(wide, "\0") for u in units).encode("utf-32-le", "replace"), "<u4").astype(np.int64).reshape(-1, wide)
    return np.where((c >= 97) & (c <= 122), c - 96, np.where(c > 170, 27 + c % (CLASSES - 27), 0))


def units(text: str) -> set[str]:
    """The lower-cased words of a text; pieces in a row are also joined, and long words and runs cut into overlapping windows."""
    text = text.lower()
    out = set(text.split())
    for run in _SPACED.findall(text):
        pieces = run.split()
        if any(len(p) > 1 for p in pieces) or len(pieces) > 2:
            out.add("".join(pieces))
    for w in [w for w in out if len(w) > UNIT]:
        out.update(w[i : i + UNIT] for i in range(0, len(w) - UNIT // 2, UNIT // 2))
    return {w for w in out if 2 < len(w) <= UNIT}


def _triples(c: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each pair of gaps, the codes of letter triples at all places (0: none) and their weight."""
    wide = c.shape[1]
    c = c.astype(np.int32)
    for j, k in _fitting(c):
        a, b, d = c[:, : wide - k], c[:, j : wide - k + j], c[:, k:]
        t = (a * CLASSES + b) * CLASSES + d
        t[(a == 0) | (b == 0) | (d == 0)] = 0
        yield t, DECAY ** (k - 1)


def norms(c: np.ndarray) -> np.ndarray:
    """Root of the self-kernel: for each row, squares of the summed weights of equal triples."""
    # A code and its span in one number, so that sorting brings equal triples together and keeps their weights.
    keys = [np.zeros((len(c), 1), np.int32)] + [t * SPAN + (k - 1) for (_, k), (t, _) in zip(_fitting(c), _triples(c))]
    keys = np.concatenate(keys, axis=1)
    keys.sort(axis=1)
    codes, span = np.divmod(keys, SPAN)
    by = np.where(codes > 0, (DECAY ** np.arange(SPAN))[span], 0.0)
    first = np.ones(codes.shape, bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    sums = np.add.reduceat(by.ravel(), np.flatnonzero(first)) if codes.size else np.zeros(0)
    rows = np.repeat(np.arange(len(c)), first.sum(axis=1))
    return np.sqrt(np.bincount(rows, sums * sums, len(c)) + 1e-12)


def features(c: np.ndarray) -> np.ndarray:
    """Explicit normalised feature map, one row per unit and one column per triple: only for landmarks."""
    out = np.zeros((len(c), CLASSES**3))
    rows = np.arange(len(c))[:, None]
    for t, w in _triples(c):
        np.add.at(out, (np.broadcast_to(rows, t.shape), t), w)
    out[:, 0] = 0
    return out / norms(c)[:, None]


def kernel(c: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised kernel of units with landmarks, the latter given by their feature rows."""
    out = np.zeros((len(c), len(landmarks)))
    by_triple = np.ascontiguousarray(landmarks.T)
    for low in range(0, len(c), 512):
        part = c[low : low + 512]
        for t, w in _triples(part):
            out[low : low + 512] += w * by_triple[t].sum(axis=1)
    return out / norms(c)[:, None]


def project(c: np.ndarray, weights: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """Kernel with a weighted sum of landmarks, folded into one weight per triple; of: the rows' norms where known."""
    total = np.zeros(len(c))
    for t, w in _triples(c):
        total += w * weights[t].sum(axis=1)
    return total / (norms(c) if of is None else of)


class Model:
    """score = sigmoid(slope * (SVM value of the worst unit) + shift)."""

    def __init__(self, weights: np.ndarray, slope: float, shift: float):
        self.weights, self.slope, self.shift = weights.astype(np.float32), slope, shift
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.weights, self.slope, self.shift

    def __setstate__(self, state):
        self.__init__(*state)

    def learn(self, texts: list[set[str]]) -> None:
        unknown = set().union(*texts) - self.known.keys()
        if len(self.known) + len(unknown) > _CACHED:
            self.known.clear()
            unknown = set().union(*texts)
        new = sorted(unknown, key=len)  # rows of a part are as wide as its longest unit
        for low in range(0, len(new), 4096):
            part = new[low : low + 4096]
            self.known.update(zip(part, project(letters(part), self.weights).tolist()))

    def scores(self, texts: list[str]) -> list[float]:
        """By the worst unit of each text, learnt for some hundred texts at a time, fewer if they are long."""
        out: list[float] = []
        at = 0
        while at < len(texts):
            of, held = [], 0
            while at < len(texts) and len(of) < 200 and held < HELD:
                of.append(units(texts[at]))
                held += len(texts[at])
                at += 1
            self.learn(of)
            out += [max(map(self.known.__getitem__, us), default=-2.0) for us in of]
        z = self.slope * np.array(out, float) + self.shift
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6).tolist()


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 300, c: float = 10.0) -> np.ndarray:
    """Linear SVM with squared hinge loss; accelerated gradient descent, bias in the last column."""
    z = np.hstack([z, np.ones((len(z), 1))])
    beta = look = np.zeros(z.shape[1])
    rate = 1 / (1 + 2 * c * np.linalg.norm(z * np.sqrt(weight)[:, None], 2) ** 2)
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (z @ look))
        grad = np.append(look[:-1], 0) - 2 * c * z.T @ (weight * y * slack)
        new = look - rate * grad
        look = new + t / (t + 3) * (new - beta)
        beta = new
    return beta


def _stems(unit: str) -> list[str]:
    return [unit[:k] for k in (4, 5) if len(unit) > k]


def fit(rows: list[tuple[int, str]], landmarks: int = LANDMARKS, rounds: int = 4, fit_units: int = FIT_UNITS) -> Model:
    """(toxic, text) -> Model.

    Landmarks are the units and stems most over-represented in toxic documents, and the most frequent units of the
    others. Labels are of documents: of a toxic document's sentences, the worst unit stands for it (the witness), chosen
    among over-represented ones by how much they or their stems are so first and by the last round's SVM later; units of the others are negative
    examples (about fit_units of them, from the most frequent to the rarest), and after the first round each clean
    document's worst unit weighs in as well.
    """
    docs = [(t, units(x)) for t, x in rows]
    n = {k: max(1, sum(t == k for t, _ in docs)) for k in (0, 1)}
    df, stems = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
    for t, us in docs:
        df[t].update(us)
        stems[t].update({x for u in us for x in _stems(u)})

    def excess(key: str, by: dict[int, Counter]) -> float:
        """How over-represented, and how surely: log odds times log frequency."""
        c = by[1][key]
        return float((np.log((c + 0.5) / n[1]) - np.log((by[0][key] + 0.5) / n[0])) * np.log(c + 1e-9)) if c > 1 else 0.0

    if not df[1] or not df[0]:
        return Model(np.zeros(CLASSES**3), 1.0, -5.0)
    strong = {u: max([excess(u, df), *(excess(x, stems) for x in _stems(u))]) for u in sorted(df[1])}
    floor = max(1.0, SURE * max(strong.values()))
    odds = strong
    best = sorted([(-excess(u, df), u) for u in df[1]] + [(-excess(x, stems), x) for x in stems[1]])
    marks = list(dict.fromkeys(u for v, u in best[: 2 * landmarks] if -v >= floor))[: landmarks * 2 // 3]
    marks += [u for u, _ in sorted(df[0].items(), key=lambda x: (-x[1], x[0]))[: landmarks - len(marks)]]
    phi = features(letters(marks))
    k = phi @ phi.T
    value, vector = np.linalg.eigh(k + 1e-6 * np.eye(len(k)))
    whiten = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-4))) @ vector.T
    negatives = sorted(df[0], key=lambda u: (-df[0][u], u))
    strength, weights, bias = odds, None, 0.0
    every = sorted(set(df[0]) | set(df[1]), key=lambda u: (len(u), u))  # rows of a part are as wide as its longest unit
    parts = [every[i : i + 4096] for i in range(0, len(every), 4096)]
    sizes = [norms(letters(p)) for p in parts]
    for r in range(rounds):
        witnesses = Counter()
        for t, us in docs:
            if t and (able := [u for u in sorted(us) if odds.get(u, 0.0) >= floor]):
                witnesses[max(able, key=strength.__getitem__)] += 1
        if not witnesses:
            return Model(np.zeros(CLASSES**3), 1.0, -5.0)
        hardest = Counter(max(sorted(us), key=lambda u: strength.get(u, -9.0)) for t, us in docs if not t and us) if r else Counter()
        pos, neg = sorted(witnesses), sorted(hardest) + negatives[:: max(1, len(negatives) // fit_units)]
        z = kernel(letters(pos + neg), phi) @ whiten
        y = np.array([1.0] * len(pos) + [-1.0] * len(neg))
        w = np.array([100 * witnesses[u] / witnesses.total() for u in pos] + [300 * hardest[u] / hardest.total() for u in sorted(hardest)] + [100 / (len(neg) - len(hardest))] * (len(neg) - len(hardest)))
        beta = _svm(z, y, w)
        weights, bias = phi.T @ (whiten @ beta[:-1]), beta[-1]
        strength = {u: v for p, of in zip(parts, sizes) for u, v in zip(p, project(letters(p), weights, of).tolist())}
    worst = [(t, max((strength[u] for u in us), default=-2.0)) for t, us in docs]
    x, y = np.array([v for _, v in worst]), np.array([t for t, _ in worst], float)
    return Model(weights, *_sigmoid(x, np.where(y == 1, 0.98, 0.02)))


def _sigmoid(x: np.ndarray, goal: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of Platt's sigmoid, every document weighed alike; Newton's steps, halved until the loss falls."""
    z = np.stack([x, np.ones(len(x))], axis=1)

    def loss(beta: np.ndarray) -> float:
        v = z @ beta
        return float(np.mean(np.logaddexp(0, v) - goal * v)) + 1e-6 * float(beta @ beta)

    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (p - goal) / len(x) + 2e-6 * beta
        curve = (z * (p * (1 - p))[:, None]).T @ z / len(x) + 2e-6 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        if float(gradient @ step) < 1e-12:
            break
        rate = 1.0
        while rate > 1e-6 and loss(beta - rate * step) > loss(beta):
            rate /= 2
        beta = beta - rate * step
    return max(float(beta[0]), 1e-3), float(beta[1])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame, fit_toxic: int = FIT_TOXIC, fit_clean: int = FIT_CLEAN, fit_chars: int = FIT_CHARS, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents -> doc_id, held_out, score in 0..1, predicted (1 if score >= cut).

    Labels are learnt from rows that aren't held out, at most fit_toxic and fit_clean of them and none of over fit_chars
    characters; their texts are the only ones that reach the driver, one for each id. Whole texts are scored. Null and empty texts have the lowest score; labels that are
    null, or of documents not in docs, are ignored, repeated ones count once (toxic if any says so). Repeated rows are
    scored each. Further columns are never inputs.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = lambda t, n: known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = first(1, fit_toxic).unionByName(first(0, fit_clean)).select(F.col("doc_id").alias("_id"), "toxic")
    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= fit_chars)
    rows = short.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")).collect()  # at most fit_toxic + fit_clean documents
    model = fit([(r["toxic"], r["text"] or "") for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"] or ""))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            got = model.scores([t or "" for t in rb.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
