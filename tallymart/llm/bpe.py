"""Byte-pair encoding and decoding with an index of pair occurrences.

The distinct words of a step of a partition are laid out as one array of symbols, linked to their neighbours. The index
maps the rank of each pair that can merge to all positions where the pair stands. The lowest active rank is taken, all its
positions merge at once, and only the lists of the pairs beside them change. Every word thereby sees its merges in
ascending rank and from left to right, as if it were merged alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_text, parts, tidy
from .tokenizing import SPACES, STEP, Chunks, byte_symbols, tokenizer_path

_RUN = re.compile(f"[{SPACES}]+")


class PairIndexBpe:
    """Encoder and decoder of a tokenizer file of the kind "BPE with word ends" (see `check`)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.check(spec)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.shown = pa.array([(self.tokens[i] + " ").encode() if i in self.tokens else b"" for i in range(max(self.tokens) + 2)], pa.large_binary())
        symbols = byte_symbols()
        self.inner = np.array([self.vocab.get(c, -1) for c in symbols], np.int64)
        self.final = np.array([self.vocab.get(c + self.suffix, -1) for c in symbols], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([self.vocab[a] << 20 | self.vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        last = np.r_[key[order][1:] != key[order][:-1], True]  # a pair listed twice has its later rank
        self.pair_keys, self.pair_ranks = key[order][last], order[last]
        self.merged = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self.left, self.right = key >> 20, key & 0xFFFFF
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.chunks = Chunks("words", list(self.special), self.learn, 2)

    @staticmethod
    def check(spec: dict) -> None:
        """The steps this encoder knows; a file with others is refused rather than encoded differently."""
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        model = spec["model"]
        known = kinds == ["NFC", "Replace", "Lowercase"] and split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"] and level["type"] == "ByteLevel" and not level["add_prefix_space"] and not level["use_regex"]
        if not known or spec["decoder"] or model["type"] != "BPE" or model["dropout"] or model["unk_token"] or model.get("byte_fallback") or model.get("ignore_merges") or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("not a tokenizer file of the kind this encoder reads")

    def normal(self, chunk: str) -> str:
        """A run without white space, composed and lower-cased character by character."""
        if chunk.isascii():
            return chunk.lower()
        return "".join(map(str.lower, unicodedata.normalize("NFC", chunk)))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or -1."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ranks[at], -1)

    def merge(self, pre_tokens: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token."""
        lengths = np.array([len(w) for w in pre_tokens], np.int64)
        starts = np.cumsum(lengths + 1) - lengths  # a stop of -1 before each word, one after the last
        n = int(lengths.sum()) + len(pre_tokens) + 1
        symbol = np.full(n, -1, np.int64)
        data = np.frombuffer(b"".join(pre_tokens), np.uint8)
        filled = np.ones(n, bool)
        filled[starts - 1] = False
        filled[n - 1] = False
        symbol[filled] = self.inner[data]
        ends = (starts + lengths - 1)[lengths > 0]
        symbol[ends] = self.final[data[np.cumsum(lengths)[lengths > 0] - 1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = {}

        def note(at: np.ndarray) -> None:
            """List positions under the rank of the pair that starts there."""
            rank = self.ranks(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, found in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts)):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(found)

        active: list[int] = []
        note(np.flatnonzero(symbol[:-1] >= 0))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            at = at[symbol[at] == a]
            at = at[symbol[after[at]] == b]
            if a == b and len(at) > 1:  # of overlapping occurrences, the left one merges
                at, taken, gone = np.sort(at), [], -1
                for x, y in zip(at.tolist(), after[at].tolist()):
                    if x != gone:
                        taken.append(x)
                        gone = y
                at = np.array(taken, np.int64)
            if not len(at):
                continue
            dead = after[at]
            symbol[at] = self.merged[r]
            symbol[dead] = -2
            beyond = after[dead]
            after[at] = beyond
            before[beyond] = at
            ahead = before[at]
            note(np.unique(np.concatenate((at, ahead[symbol[ahead] >= 0]))))
        kept = np.flatnonzero(symbol > -2)
        flat, out = symbol[kept], []
        stops = np.flatnonzero(flat == -1)
        flat = flat.tolist()
        for i, j in zip(stops[:-1].tolist(), stops[1:].tolist()):
            out.append(flat[i + 1 : j])
        return out

    def learn(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """Of runs without white space the ids, in decimal with a space behind each and as numbers of 4 bytes."""
        pieces = [self.pattern.findall(self.normal(c)) for c in chunks]
        distinct = list({p for ps in pieces for p in ps})
        ids = dict(zip(distinct, self.merge([p.encode() for p in distinct])))
        text = {}
        for p, got in ids.items():
            got = [i for i in got if i >= 0]
            text[p] = "".join([f"{i} " for i in got]).encode(), array("I", got).tobytes()
        return [text[ps[0]] if len(ps) == 1 else (b"".join([text[p][0] for p in ps]), b"".join([text[p][1] for p in ps])) for ps in pieces]

    def decode(self, coded: list[np.ndarray]) -> list[bytes]:
        """The text of each array of ids, as the library decodes without a decoder: known tokens joined by a space."""
        ends = np.cumsum([0, *map(len, coded)])
        flat = np.concatenate([np.zeros(0, np.int64), *coded]).astype(np.int64)
        flat[(flat < 0) | (flat >= len(self.shown))] = len(self.shown) - 1
        shown = self.shown.take(pa.array(flat))
        at = np.frombuffer(shown.buffers()[1], np.int64)[: len(flat) + 1][ends].tolist() if len(flat) else [0] * len(ends)
        data = memoryview(shown.buffers()[2] or b"") if len(flat) else memoryview(b"")
        return [bytes(data[i : j - 1]) if j > i else b"" for i, j in zip(at, at[1:])]

    def whole(self, text: str) -> list[bytes]:
        """The same two values of a text that may hold strings of special tokens or odd separators."""
        out = [[], []]
        for k, part in enumerate(self.parts.split(text) if self.parts else [text]):
            if k % 2:
                found = [(f"{self.special[part]} ".encode(), array("I", [self.special[part]]).tobytes())]
            else:
                found = self.learn([c for c in _RUN.split(part) if c])
            for decimal, ids in found:
                out[0].append(decimal)
                out[1].append(ids)
        return [b"".join(x) for x in out]

    def __call__(self, texts: pa.Array) -> list[tuple[bytes, np.ndarray]]:
        """(ids in decimal joined by a space, ids) of each text."""
        found = [v if v is not None else self.whole(texts[i].as_py()) for i, v in enumerate(self.chunks(texts))]
        return [(decimal[:-1], np.frombuffer(ids, np.uint32)) for decimal, ids in found]


_coders: dict[str, PairIndexBpe] = {}


def coder(path: str) -> PairIndexBpe:
    """One for each worker process, kept between tasks."""
    if path not in _coders:
        _coders[path] = PairIndexBpe(path)
    return _coders[path]


def _per_text(docs: DataFrame, schema: str, make, tokenizer: str | None, id_col: str, text_col: str) -> DataFrame:
    path = tokenizer or tokenizer_path("word_bpe_49k.json")

    def run(batches):
        code = coder(path)
        for given in parts(batches, STEP):
            yield pa.RecordBatch.from_pydict({"doc_id": given.column("doc_id"), **make(code, code(given.column("text")))})

    return id_text(docs, id_col, text_col).mapInArrow(tidy(run), schema)


def bpe_encode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every text. A null or empty text has none; repeated rows and null ids stay as rows."""

    def make(_, coded):
        return {"ids": pa.array([ids.astype(np.int32) for _, ids in coded], pa.list_(pa.int32()))}

    return _per_text(docs, "doc_id long, ids array<int>", make, tokenizer, id_col, text_col)


def bpe_decode(encoded: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the decoded text of every row of ids; null ids give an empty text, unknown ids are left out."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")

    def run(batches):
        code = coder(path)
        for b in batches:
            ids = [np.array([-1 if i is None else i for i in ids or ()], np.int64) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": pa.array([t.decode() for t in code.decode(ids)], pa.string())})

    from pyspark.sql import functions as F

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def bpe_digest(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_tokens and SHA-256 of the ids and of the text decoded from them of every document, made in one pass."""

    def make(code, coded):
        ids, texts = [x for _, x in coded], [hashlib.sha256(decimal).hexdigest() for decimal, _ in coded]
        shown = [hashlib.sha256(x).hexdigest() for x in code.decode(ids)]
        return {"n_tokens": pa.array(list(map(len, ids)), pa.int64()), "ids_sha256": pa.array(texts, pa.string()), "decoded_sha256": pa.array(shown, pa.string())}

    return _per_text(docs, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make, tokenizer, id_col, text_col)
