"""Ids of whole texts by the tokenizers library, asked once per distinct chunk of text.

A chunk ends where the tokenizer's own splitting always ends a piece, so joining the ids of the chunks gives the ids of
the text. A text in which that isn't certain goes to the library whole. Arrow splits the texts and numbers the chunks;
Python handles each distinct chunk once a step, and each worker keeps the values of the chunks that it met first.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that a worker keeps, and bytes of text in a step.
CACHE, STEP = 800_000, 4_000_000

#: The white space of the tokenizers' \s, and separators that Arrow splits at although they aren't.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NOT_SPACES = "\x1c-\x1f"


#: Letters that are composed and have one lower-case letter each.
LETTERS = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Chunks:
    """Values of distinct chunks, bytes or with more than one column a tuple of bytes, by the function `learn`.

    split "words": runs between white space. split "spaced": runs after single spaces that stand between characters that
    aren't white space; the first chunk of a text is marked with FIRST.
    """

    FIRST = "\x00"

    def __init__(self, split: str, special: list[str], learn: Callable[[list[str]], list], columns: int = 1):
        self.split, self.learn, self.columns = split, learn, columns
        quoted = "|".join("".join(rf"\x{ord(c):02x}" for c in s) for s in special)
        odd = f"[{_NOT_SPACES}]" if split == "words" else f"  |\n | \n|^ | $|[\x00{SPACES.replace(' ', '')}]".replace("\t-\r", "\t\x0b-\r")
        self.unsafe = f"{odd}|{quoted}" if quoted else odd
        self.known: dict = {}

    def __call__(self, texts: pa.Array) -> list:
        """For each text its value or values, or None where its chunks can't be told apart safely."""
        unsafe = pc.match_substring_regex(texts, self.unsafe)
        safe = pc.if_else(unsafe, "", texts)
        if self.split == "words":
            lists = pc.utf8_split_whitespace(safe)
        else:
            lists = pc.split_pattern(pc.binary_join_element_wise(self.FIRST, safe, ""), " ")
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = self.known
        new = [x for x in distinct if x not in known]
        if new:
            known.update(zip(new, self.learn(new)))
        values = [known[x] for x in distinct]
        if len(known) > CACHE:
            self.known = dict(islice(known.items(), CACHE // 2))  # frequent chunks are met early
        ends = np.asarray(lists.offsets)
        ends = ends - ends[0]
        columns = []
        for column in [values] if self.columns == 1 else zip(*values) if values else [()] * self.columns:
            joined = pa.array(column, pa.large_binary()).take(coded.indices)
            offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
            data = memoryview(joined.buffers()[2]) if len(joined) and joined.buffers()[2] else memoryview(b"")
            at = offsets[ends].tolist() if len(joined) else [0] * len(ends)
            columns.append([bytes(data[i:j]) for i, j in zip(at, at[1:])])
        found = columns[0] if self.columns == 1 else zip(*columns)
        return [None if u else v for u, v in zip(unsafe.to_pylist(), found)]


class Encoder:
    """Ids of texts as bytes, each id little-endian in the machine type `code` of the array module ("H" or "I")."""

    #: Stands between chunks that are encoded together; a chunk that holds it is encoded alone.
    STOP = "\x01"

    def __init__(self, path: str, split: str, code: str):
        from tokenizers import Tokenizer

        self.lib, self.code, self.width = Tokenizer.from_file(path), code, array(code).itemsize
        self.lib.no_truncation()
        self.lib.no_padding()
        special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.chunks = Chunks(split, special, self.learn)
        self.between = f" {self.STOP}" if split == "spaced" else f" {self.STOP} "
        stop = self.lib.encode(self.between, add_special_tokens=False).ids
        self.stop, self.before = stop[-1], len(stop) - 1  # ids of the separator before its last, which no chunk has
        self.marks = {c: self.whole(c) for c in ".,"}
        symbols, model = byte_symbols(), self.lib.model
        self.symbol, self.tokenize = symbols.__getitem__, model.tokenize
        self.lower = self.whole("ÀB") == self.whole("àb")
        self.lead = symbols[32] if split == "spaced" else ""
        lead = " " if split == "spaced" else ""
        self.direct = all(self.one(w) == self.whole(lead + w) for w in ("a", "Word", "überGroß", "É", "chllando", "ÿÖþ"))

    def pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.lib.encode(text, add_special_tokens=False).ids)

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Letters and a point or comma behind them are pieces of their own, so such chunks reuse the letters' ids."""
        spaced, known = self.chunks.split == "spaced", self.chunks.known
        out: list = [None] * len(chunks)
        joint, lead, ended = [], " " if spaced else "", []
        for i, c in enumerate(chunks):
            if spaced and c[:1] == Chunks.FIRST:
                out[i] = self.whole(c[1:])
            elif self.STOP in c or not c:
                out[i] = self.whole(lead + c)
            elif c[-1] in ".," and c[:-1].isalpha() and c.isascii():
                ended.append(i)
            else:
                joint.append(c)
        found = dict(zip(joint, self.asked(joint, lead)))
        bare = [b for b in {chunks[i][:-1] for i in ended} if b not in known and b not in found]
        new = dict(zip(bare, self.asked(bare, lead)))
        for i in ended:
            b = chunks[i][:-1]
            out[i] = (known.get(b) or found.get(b) or new[b]) + self.marks[chunks[i][-1]]
        known.update(new)
        return [found[c] if v is None else v for c, v in zip(chunks, out)]

    def one(self, word: str) -> bytes:
        """Ids of a word of LETTERS, which is one piece, by the library's model alone."""
        text = word.lower() if self.lower else word
        if not text.isascii():
            text = "".join(map(self.symbol, text.encode()))
        return self.pack([t.id for t in self.tokenize(self.lead + text)])

    def asked(self, chunks: list[str], lead: str) -> list[bytes]:
        """The library's ids of chunks that hold no STOP: of plain words one by one by its model, of others by its whole chain."""
        if not self.direct:
            return self.chained(chunks, lead)
        plain = [LETTERS.fullmatch(c) is not None for c in chunks]
        others = iter(self.chained([c for c, p in zip(chunks, plain) if not p], lead))
        return [self.one(c) if p else next(others) for c, p in zip(chunks, plain)]

    def chained(self, chunks: list[str], lead: str) -> list[bytes]:
        """A hundred chunks to a call's text."""
        out: list[bytes] = []
        for at in range(0, len(chunks), 12_800):
            groups = [chunks[k : k + 100] for k in range(at, min(at + 12_800, len(chunks)), 100)]
            coded = self.lib.encode_batch_fast([lead + f"{self.between}{lead}".join(g) for g in groups], add_special_tokens=False)
            for g, e in zip(groups, coded):
                ids = np.array(e.ids, self.code)
                stops = np.flatnonzero(ids == self.stop)
                if len(stops) != len(g) - 1:
                    raise ValueError("the separator met a chunk")
                data, w = ids.tobytes(), self.width
                begin, end = [0, *((stops + 1) * w).tolist()], [*((stops - self.before) * w).tolist(), len(data)]
                out += [data[b:e_] for b, e_ in zip(begin, end)]
        return out

    def __call__(self, texts: pa.Array) -> list[bytes]:
        return [v if v is not None else self.whole(texts[i].as_py()) for i, v in enumerate(self.chunks(texts))]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, split: str, code: str) -> Encoder:
    """One for each worker process, kept between tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = (path, split, code)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
