"""Secrets in texts: three fixed patterns, and runs that a Markov model of random strings explains better than one of identifiers.

Both models are first-order chains over characters. Their labelled samples are random strings of the alphabets that keys
are written in, drawn from a seed, and identifiers made by the usual rules (camel case, snake case, versions, paths) from words of a bounded
sample of the texts. A run is taken where the log-likelihood ratio per character and in total lies above every identifier of a
part of the sample that the model didn't see, plus a margin.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, steps, tidy

#: The patterns of the base, in their order.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_INDEX = np.zeros(256, np.int64)
for _i, _c in enumerate(ALPHABET, 1):
    _INDEX[ord(_c)] = _i
START = len(ALPHABET) + 1


def random_strings(n: int, rng: random.Random) -> list[str]:
    """Labelled 1: strings without structure, 16 to 64 long."""
    letters = ALPHABET[:52]
    kinds = (ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-", letters[:26] + "0123456789", letters[26:] + "0123456789", "0123456789abcdef")
    return ["".join(rng.choices(rng.choice(kinds), k=rng.randint(16, 64))) for _ in range(n)]


def identifiers(words: list[str], n: int, rng: random.Random) -> list[str]:
    """Labelled 0: words, and names, versions, dates and paths made of words."""
    out = []
    while len(out) < n:
        some = [rng.choice(words) for _ in range(rng.randint(2, 4))]
        number = str(rng.choice((rng.randint(0, 99), rng.randint(1900, 2100), rng.randint(0, 10**6))))
        forms = ("_".join(some), "".join(w.capitalize() for w in some), some[0] + "".join(w.capitalize() for w in some[1:]), "-".join(some), "/".join(some), "_".join(some).upper(), "_".join([*some, number]), "-".join(some) + number, f"{some[0]}={number}", "/".join((number, *some)), "".join(some), "=" * rng.randint(16, 40), "-" * rng.randint(16, 40), "_" * rng.randint(16, 40), number * 4)
        out.append(rng.choice(forms))
    return out


class Markov:
    """log P(character | character before), smoothed by `add`."""

    def __init__(self, strings: list[str], add: float = 0.5):
        counts = np.full((START + 1, START), add)
        for s in strings:
            x = _INDEX[np.frombuffer(s.encode("latin-1"), np.uint8)]
            np.add.at(counts, (np.r_[START, x[:-1]], x), 1)
        self.log = np.log(counts / counts.sum(1, keepdims=True))


class SecretModel:
    """Ratio of the two chains; `per_char` and `total` are what a run must exceed."""

    def __init__(self, words: list[str], samples: int = 6000, margin: float = 0.15, seed: int = 11):
        rng = random.Random(seed)
        words = sorted({w for w in words if w.isascii() and w.isalpha()}) or ["name", "value"]
        positive, negative = random_strings(samples, rng), identifiers(words, samples, rng) + rng.sample(words, min(len(words), samples))
        rng.shuffle(negative)
        cut = len(negative) * 3 // 4
        self.ratio = Markov(positive).log - Markov(negative[:cut]).log
        held = [self.score(s) for s in negative[cut:] if len(s) >= 16]
        self.per_char = max([0.4, *(total / n for total, n in held)]) + margin
        self.total = max([8.0, *(total for total, _ in held)]) * (1 + margin)

    def score(self, run: str) -> tuple[float, int]:
        x = _INDEX[np.frombuffer(run.encode("latin-1"), np.uint8)]
        return float(self.ratio[np.r_[START, x[:-1]], x].sum()), len(x)

    def random(self, run: str) -> bool:
        total, n = self.score(run)
        return total > self.total and total / n > self.per_char


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the matches of the patterns that pass their conditions, sorted."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def secret_spans(text: str, model: SecretModel) -> list[tuple[int, int, int]]:
    """Base spans, and runs that the model takes and that touch none of them."""
    found = base_spans(text)
    more, k, reach = [], 0, 0
    for m in RUN.finditer(text):
        while k < len(found) and found[k][0] < m.end():  # both are sorted by start: what begins before this run ends
            reach = max(reach, found[k][2])
            k += 1
        if reach <= m.start() and model.random(m.group()):
            more.append((m.start(), 3, m.end()))
    return sorted(found + more) if more else found


def sample_words(docs: DataFrame, most: int = 200, text_col: str = "text", longest: int = 20_000) -> list[str]:
    """Words of at most `most` distinct texts of up to `longest` characters, drawn by hash: the bounded sample that identifiers are made from.

    The hashes are drawn first, so that no more texts than that ever leave the executors.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(text.alias("t"), F.xxhash64(text).alias("h")).where(F.length("t") <= longest)
    drawn = [r["h"] for r in rows.select("h").distinct().orderBy("h").limit(most).collect()]
    texts = rows.where(F.col("h").isin(drawn)).dropDuplicates(["h"]).collect() if drawn else []
    return [w for r in sorted(texts, key=lambda r: r["h"]) for w in re.findall(r"[A-Za-z]{3,}", r["t"])]


def find_secrets(docs: DataFrame, model: SecretModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end in code points, by start, then kind) of every row.

    A null or empty text has none. Repeated rows and null ids are rows like others; an empty table gives no rows.
    """
    model = model or SecretModel(sample_words(docs, text_col=text_col))
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for given, texts in steps(batches):
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in secret_spans(t, model)] for t in texts]
            yield pa.RecordBatch.from_arrays([given.column("doc_id"), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    return id_text(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
