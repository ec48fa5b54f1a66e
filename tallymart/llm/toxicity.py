"""Toxic spans by a linear-chain CRF, and document scores from its marginals.

Labels are given for documents, so tokens are labelled from them: over a bounded sample of labelled documents, words
and beginnings of words become cues if they stand in toxic documents more often than chance allows, over all that are tested.
A token with a cue is toxic in a toxic document and not in another. The CRF learns from windows of these tokens how far each cue, cues of some
purity and their neighbourhood are to be believed; it and the scores are fitted on each half of the sample with the cues of the other half.
Forward-backward marginals give each token's probability. A document's score is a logistic function of the log probability that no token is
toxic, of the surest one, and of their sum and density.

Tokens without a cue all have the same emission, and between cues the chain forgets its past at a known rate, so marginals are taken in
windows around cues, wide enough that what lies outside changes them by less than `FORGET`.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, give_back, id_text, parts, tidy
from .crf import Crf, padded

FORGET, STEP, CACHE, SHRINK = 1e-4, 4_000_000, 600_000, 1e-2
_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = range(4, 9)


def cues_of(word: str) -> Iterator[str]:
    """What a word may be recognized by: itself, and its beginnings followed by a star."""
    yield word
    for k in PREFIXES:
        if len(word) > k:
            yield word[:k] + "*"


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Where the tokens of each text begin and end in the flat list of tokens, lower-cased runs between white space."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    ends = np.asarray(lists.offsets)
    return ends - ends[0], lists.flatten().dictionary_encode()


class ToxicityModel:
    """Fitted on (text, label) pairs; `chance` is the expected number of cues that are none, `windows` how many of each half the chain is fitted on."""

    #: Features: a cue of at least each purity (the strongest is open upwards), no cue, a cue before, a cue behind, and the cue itself.
    PURITIES = 6
    NONE, BEFORE, BEHIND, WIDTH = PURITIES + 1, PURITIES + 2, PURITIES + 3, PURITIES + 4

    def __init__(self, sample: list[tuple[str, int]], seed: int = 3, chance: float = 0.05, windows: int = 8_000):
        sample = sorted({t: y for t, y in sorted(sample)}.items())
        random.Random(seed).shuffle(sample)
        self.rate = (sum(y for _, y in sample) + 0.5) / (len(sample) + 1)
        self.crf, self.margin, self.logistic = None, 2, None
        self.number: dict[str, int] = {}
        half, (names, of) = len(sample) // 2, self._documents(sample)
        made = []
        for mine, others in ((sample[:half], of[half:]), (sample[half:], of[:half])):
            self._learn(names, others, chance)
            if mine:
                made.append((*self.codes(pa.array([t for t, _ in mine], pa.string()))[:2], np.array([y for _, y in mine])))
        self._learn(names, of, chance)
        if self.cues and made and any(c.any() for _, c, _ in made):
            self._fit(made, random.Random(seed + 1), windows)

    @staticmethod
    def _documents(sample: list[tuple[str, int]]) -> tuple[list[str], list[tuple[int, int, np.ndarray]]]:
        """All cues, and label, least word hash and cues (as their numbers) of each text."""
        names: dict[str, int] = {}
        of: dict[str, tuple[int, list[int]]] = {}
        out = []
        for text, y in sample:
            words = set(_WORD.findall(text.lower()))
            for w in words:
                if w not in of:
                    of[w] = zlib.crc32(w.encode()), [names.setdefault(c, len(names)) for c in cues_of(w)]
            out.append((y, min((of[w][0] for w in words), default=0), np.unique(np.array([c for w in words for c in of[w][1]], np.int32))))
        return list(names), out

    def _learn(self, names: list[str], documents: list[tuple[int, int, np.ndarray]], chance: float) -> None:
        self.cues, self.known = self._cues(names, documents, chance), {}
        for cue in self.cues:
            self.number.setdefault(cue, len(self.number) + 1)

    @staticmethod
    def _cues(names: list[str], documents: list[tuple[int, int, np.ndarray]], chance: float) -> dict[str, tuple[int, float]]:
        """Purity (1 to PURITIES) and weight of each cue: minus the log probability of its share of toxic documents, were it as frequent in all.

        Documents that share their least word hash are taken for copies, and toxic ones among them count once.
        """
        none = [np.zeros(0, np.int64)]
        other = np.bincount(np.concatenate([*none, *(c for y, _, c in documents if not y)]).astype(np.int64), minlength=len(names))
        groups = tuple({copy for z, copy, _ in documents if z == y} for y in (0, 1))
        place = {copy: i for i, copy in enumerate(sorted(groups[1]))}
        pairs = np.unique(np.concatenate([*none, *(c.astype(np.int64) << 32 | place[copy] for y, copy, c in documents if y)]))
        toxic = np.bincount(pairs >> 32, minlength=len(names))
        rate = (len(groups[1]) + 1) / (len(groups[0]) + len(groups[1]) + 2)
        tested = sorted((names[c], int(toxic[c]), int(other[c])) for c in np.flatnonzero(toxic > 2).tolist())
        bound, out = math.log(max(1, len(tested)) / chance), {}
        for cue, k, m in tested:
            log_p = math.lgamma(k + m + 1) - math.lgamma(k + 1) - math.lgamma(m + 1) + k * math.log(rate) + m * math.log(1 - rate)
            if k >= m and -log_p > bound:
                odds = math.log((k + 0.5) / (m + 0.5) * (1 - rate) / rate)
                out[cue] = (min(ToxicityModel.PURITIES, max(1, int(odds))), -log_p)
        return out

    def code(self, token: str) -> int:
        """The purity of the cue in a token that has the most weight, with the cue's number above the lowest three bits; or 0."""
        best, code = 0.0, 0
        for w in _WORD.findall(token):
            for c in cues_of(w):
                if (got := self.cues.get(c)) and got[1] > best:
                    best, code = got[1], got[0] | self.number[c] << 3
        return code

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of texts in the flat tokens, the code of each token, and whether a text's first token is empty."""
        bounds, flat = tokens_of(texts)
        values, known = flat.dictionary.to_pylist(), self.known
        new = [v for v in values if v not in known]
        known.update(zip(new, map(self.code, new)))
        table = np.array([known[v] for v in values], np.int32) if values else np.zeros(0, np.int32)
        empty = np.array([not v for v in values], bool)
        indices = np.asarray(flat.indices)
        if len(known) > CACHE:
            self.known = dict(list(known.items())[: CACHE // 2])
        return bounds, table[indices] if len(values) else np.zeros(0, np.int32), empty[indices] if len(values) else np.zeros(0, bool)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Features of the tokens of a window."""
        near = codes > 0
        before, behind = np.r_[False, near[:-1]], np.r_[near[1:], False]
        pure = [((codes & 7) >= k) * k for k in range(1, self.PURITIES + 1)]
        return np.stack((~near * self.NONE, before * self.BEFORE, behind * self.BEHIND, near * (self.BEHIND + (codes >> 3)), *pure), axis=-1).astype(np.int64)

    def _windows(self, bounds: np.ndarray, codes: np.ndarray, margin: int, most: int = 2048) -> list[tuple[int, int, int, int, int]]:
        """(text, first, end, from, to) of token windows around cues, joined where they meet. A longer one than `most` is several, which overlap by the margin; from and to say what each is read for."""
        at = np.flatnonzero(codes)
        text = np.searchsorted(bounds, at, side="right") - 1
        out: list[list[int]] = []
        for d, k in zip(text.tolist(), at.tolist()):
            low, high = max(int(bounds[d]), k - margin), min(int(bounds[d + 1]), k + margin + 1)
            if out and out[-1][0] == d and low <= out[-1][2]:
                out[-1][2] = high
            else:
                out.append([d, low, high])
        return [(d, max(a, k - margin), min(b, k + most + margin), k, min(b, k + most)) for d, a, b in out for k in range(a, b, most)]

    def _fit(self, made: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rng: random.Random, most: int) -> None:
        """Fit the chain and the scores on (bounds, codes, labels) of texts."""
        rows, tags = [], []
        for bounds, codes, labels in made:
            windows = [w[:3] for w in self._windows(bounds, codes, 3, 64)]
            rng.shuffle(windows)
            windows = windows[:most]
            for _ in range(len(windows) // 4 + 20):  # and windows of any tokens
                d = rng.randrange(len(labels))
                a, b = int(bounds[d]), int(bounds[d + 1])
                if b > a:
                    k = rng.randrange(a, b)
                    windows.append((d, k, min(b, k + 7)))
            rows += [self.rows(codes[a:b]) for _, a, b in windows]
            tags += [((codes[a:b] > 0) & (labels[d] == 1)).astype(np.int64)[:, None] for d, a, b in windows]
        x, lengths = padded(rows, self.WIDTH)
        shrunk = np.r_[np.zeros(self.BEHIND + 1), np.full(len(self.number), SHRINK)][:, None]  # a single cue is believed less than its kind
        self.crf = Crf(self.BEHIND + len(self.number), 2).fit(x, padded(tags, 1)[0][..., 0], lengths, rounds=80, rate=0.15, l2=2e-5, more=shrunk)
        step = np.exp(self.crf.moves + self.crf.weights[self.NONE])
        ratio = math.sqrt(step[0, 0] * step[1, 1] / (step[0, 1] * step[1, 0]))
        forget = abs(ratio - 1) / (ratio + 1)  # Birkhoff's contraction of one step without a cue
        self.margin = max(2, math.ceil(math.log(FORGET) / math.log(forget)) if forget > 1e-9 else 2)
        summaries = [self._summary(p, n) for bounds, codes, _ in made for p, n in zip(self._probabilities(bounds, codes), np.diff(bounds).tolist())]
        self.logistic = _logistic(np.array(summaries), np.concatenate([y for _, _, y in made]).astype(float))

    def _probabilities(self, bounds: np.ndarray, codes: np.ndarray) -> list[list[tuple[int, float]]]:
        """For each text (token, probability) of the tokens with a cue."""
        out: list[list[tuple[int, float]]] = [[] for _ in range(len(bounds) - 1)]
        if self.crf is None:
            return out
        windows = sorted(self._windows(bounds, codes, self.margin), key=lambda w: w[2] - w[1])
        for at in range(0, len(windows), 512):
            some = windows[at : at + 512]
            rows, lengths = padded([self.rows(codes[a:b]) for _, a, b, _, _ in some], self.WIDTH)
            p = self.crf.marginals(self.crf.emissions(rows), lengths)[..., 1]
            for (d, a, _, low, high), q in zip(some, p):
                for k in (np.flatnonzero(codes[low:high]) + low).tolist():
                    out[d].append((k - int(bounds[d]), float(q[k - a])))
        return out

    @staticmethod
    def _summary(found: list[tuple[int, float]], n: int) -> tuple[float, ...]:
        none, total = -sum(math.log1p(-min(p, 1 - 1e-6)) for _, p in found), sum(p for _, p in found)
        most = min(max((p for _, p in found), default=0.0), 1 - 1e-6)
        return 1.0, min(none, 12.0), -math.log1p(-most), math.log1p(total), math.log1p(200 * total / max(n, 1))

    def __call__(self, texts: pa.Array) -> list[tuple[float, list[tuple[int, int, float]]]]:
        """(score, offending spans as start, end and probability) of each text. Without a single cue the score is the sample's rate."""
        bounds, codes, empty = self.codes(texts)
        out = []
        for d, found in enumerate(self._probabilities(bounds, codes)):
            if self.logistic is None:
                score = self.rate
            else:
                score = 1 / (1 + math.exp(-float(np.dot(self._summary(found, int(bounds[d + 1] - bounds[d])), self.logistic))))
            spans = []
            if any(p >= 0.5 for _, p in found):
                places = [m.span() for m in re.finditer(r"\S+", texts[d].as_py())]
                shift = int(empty[bounds[d]])
                spans = [(*places[k - shift], p) for k, p in sorted(found) if p >= 0.5]
            out.append((score, spans))
        return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weights of a logistic regression with a ridge, by Newton steps that are halved until the loss falls."""

    def loss(w):
        return np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w)).sum() + ridge / 2 * w @ w

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, most: int = 7_000, longest: int = 100_000, held_mod: int = 4, held: int = 2) -> ToxicityModel:
    """A model from at most `most` labelled rows whose crc32(doc_id) mod 4 isn't 2, drawn by a hash of their ids, with texts of up to `longest` characters.

    The ids are at most `most`, so they are broadcast. Labels that are null or repeat with both values are left out; of texts that share
    an id the first in order stands for it. Both bounds hold the sample, not what is scored.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).dropna()
    y = y.where(crc_mod(F.col("doc_id"), held_mod) != held).where("y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z")
    ids = F.broadcast(y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "y"))
    rows = id_text(docs).join(ids, "doc_id").where(F.length("text") <= longest).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    model = ToxicityModel([(r["text"], r["y"]) for r in rows.toLocalIterator()])
    give_back()  # of the driver, which trained it
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and spans (start, end in code points, probability) of every row.

    A null or empty text has the score of a text without cues. Repeated rows and null ids are rows like others; an empty table gives no rows.
    """
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])

    def run(batches):
        for given in parts(batches, STEP):
            found = model(given.column("text"))
            spans = [[{"start": s, "end": e, "probability": p} for s, e, p in x] for _, x in found]
            yield pa.RecordBatch.from_arrays([given.column("doc_id"), pa.array([s for s, _ in found], pa.float64()), pa.array(spans, pa.list_(kind))], ["doc_id", "score", "spans"])

    return id_text(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, score double, spans array<struct<start:long,end:long,probability:double>>")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""

    def run(batches):
        for given in parts(batches, STEP, text_col):
            texts = pc.fill_null(given.column(text_col).cast(pa.string()), "")
            yield given.filter(pa.array([s < threshold for s, _ in model(texts)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
