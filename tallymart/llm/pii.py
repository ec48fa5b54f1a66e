"""Personal data in texts: four fixed patterns, and spans of a linear-chain CRF over the shapes of tokens.

The CRF is trained from a small labelled table that rules write out: sentences of ordinary words, numbers, versions,
dates and keys, into which addresses, cards, phones and mail addresses are set in several spellings. Its features are
the shape of a token (letters, digits and marks, runs shortened), those of its neighbours, its digit count and whether the digits pass the check
sum. A text is decoded in windows around tokens that hold a digit or an @: PLAIN tokens beside a PLAIN token can only be outside (the weights
of the fitted model are checked for that), so what lies between the windows is decoded too, only not one by one.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, id_text, steps, tidy
from .crf import Crf, padded

KINDS = ("email", "ip", "card", "phone")
OUT = len(KINDS)

#: The patterns of the base. Possessive runs match the same and never go back.
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MARKS = re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    """Whether the check sum of payment cards holds."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain, found from each @ in time linear in the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            start = at
            while start > free and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the matches of the patterns that pass their conditions, by kind, then start."""
    if not _MARKS.search(text):
        return []
    out = [(0, s, e) for s, e in _emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


_RUNS = ((re.compile("[A-Z]+"), "X"), (re.compile("[^\\W\\d_A-Z]+"), "x"))
_DIGITS = re.compile("[0-9]+")


def shape(token: str) -> str:
    """X, x for runs of letters, a digit run by its length (9 for more than 8), other characters as they are; of a shape beyond 24 the first 24 are the feature."""
    for run, sign in _RUNS:
        token = run.sub(sign, token)
    return _DIGITS.sub(lambda m: str(min(9, m.end() - m.start())), token)[:24]


def _core(token: str) -> str:
    return token.strip(".,;:!?\"'|#%&*$<>[]{}")


PLAIN = "plain"


def features(tokens: list[str]) -> list[list[str]]:
    """Features of each token: own shape and those around it, digit count, check sum, and the shape whatever the lengths of its digit runs."""
    shapes, counts, coarse = [], [], []
    for t in tokens:
        digits = _digits(t)
        if digits or "@" in t:
            shapes.append(shape(_core(t)))
            counts.append(f"n{min(len(digits), 20)}" + ("ok" if 16 <= len(digits) <= 19 and luhn(digits) else ""))
            coarse.append(_DIGITS.sub("9", shapes[-1]) + ("t" if digits[:1] == "0" else "") + str(min(len(digits) // 3, 5)))
        else:
            shapes.append(PLAIN)
            counts.append(PLAIN)
            coarse.append(PLAIN)
    n = len(tokens)
    return [[f"s={shapes[i]}", f"p={shapes[i - 1] if i else '^'}", f"q={shapes[i + 1] if i + 1 < n else '$'}", f"c={counts[i]}", f"pc={shapes[i - 1] if i else '^'}|{shapes[i]}", f"g={coarse[i]}"] for i in range(n)]


def labelled(n: int = 2000, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """The labelled table: tokens of a sentence and the kind of each, OUT for none."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghilmnoprstuvé", k=rng.randint(1, 9)))
    num = lambda k: "".join(rng.choices("0123456789", k=k))

    key = lambda k: "".join(rng.choices(rng.choice(("0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")), k=k))

    def card() -> str:
        body = num(15)
        return body + next(d for d in "0123456789" if luhn(body + d))

    def email() -> list[str]:
        return [f"{word()}{rng.choice(('', '.', '_', '-'))}{rng.choice((word(), num(2)))}@{word()}{rng.choice(('', num(1)))}.{rng.choice(('com', 'org', 'net', 'example.com', 'co.uk'))}"]

    def ip() -> list[str]:
        return [".".join(str(rng.randint(0, 255)) for _ in range(4)) + rng.choice(("", "", ":" + num(4), "/24"))]

    def cards() -> list[str]:
        c = card()
        fours = [c[i : i + 4] for i in range(0, 16, 4)]
        return rng.choice(([c], ["-".join(fours)], fours, [".".join(fours)]))

    def national() -> list[list[str]]:
        """Numbers as they are written at home: a trunk or foreign prefix, an area of two to four digits, groups of two to four."""
        groups = [num(rng.randint(2, 4)) for _ in range(rng.randint(2, 4))]
        area = "0" + num(rng.randint(1, 4))
        tail = [*groups[:-2], f"{groups[-2]}-{groups[-1]}"]
        return [[f"00{num(2)}", num(rng.randint(1, 3)), *groups], [f"({area})", *tail], [f"({area})", *groups], [f"{area}/{''.join(groups)}"[:14]], [area, *groups], ["-".join(("1", num(3), num(3), num(4)))], [num(2), num(3), num(2), num(2)], ["0" + num(1), *[num(2) for _ in range(4)]]]

    def phone() -> list[str]:
        a, b, c = num(3), num(3), num(4)
        home = "0" + num(2)
        return rng.choice(([f"+1", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"+{num(2)}", a, b, c], [f"{a}-{b}-{c}"], [f"+1-{a}-{b}-{c}"], [f"+{num(11)}"], [a, b, c], [home, num(4), c], [f"{home}/{num(rng.randint(5, 8))}"], [f"{a}.{b}.{c}"], [f"0{num(3)}", num(6)], *national()))

    def other() -> list[str]:
        if rng.random() < 0.2:  # thousands, and numbers that are counted up
            return rng.choice(([str(rng.randint(1, 999)), *[num(3) for _ in range(rng.randint(1, 3))]], [str(100 * k) for k in range(1, rng.randint(3, 6))]))
        if rng.random() < 0.25:  # numbers side by side that are none
            return [num(rng.choice((1, 2, 4, 5))).lstrip("0") or "7" for _ in range(rng.randint(2, 4))]
        return [rng.choice((num(rng.randint(1, 6)), f"{num(1)}.{num(1)}", f"{num(1)}.{num(1)}.{num(1)}", f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(2)}:{num(2)}", f"{num(3)}%", f"${num(3)}.{num(2)}", "".join(rng.choices("0123456789abcdef", k=40)), f"{word()}{num(2)}", num(16), num(18), f"v{num(1)}.{num(2)}", f"{num(4)}-{num(4)}", f"{word()}@{word()}", f"@{word()}", f"{num(1)},{num(3)}", f"({num(4)})", f"{num(3)}-{num(2)}", f"{word()}={key(rng.randint(6, 40))}", f'"{key(40)}"', f"{word()}:{key(rng.randint(6, 30))}", key(rng.randint(8, 64)), f"{word()}-{num(3)}-{word()}"))]

    out = []
    for _ in range(n):
        tokens, tags = [], []
        for _ in range(rng.randint(1, 4)):
            for _ in range(rng.randint(0, 4)):
                tokens.append(word() + rng.choice(("", "", "", ",", ".", "!!")))
                tags.append(OUT)
            k = rng.choice((0, 1, 2, 3, OUT, OUT, OUT))
            new = (email, ip, cards, phone, other)[k]()
            if k == OUT and len(_digits(new[0])) >= 16 and luhn(_digits(new[0])):
                continue
            tags += [k] * len(new)
            if rng.random() < 0.3:
                new[-1] += rng.choice((",", ".", ".", "%%%", "###", "!!", ";"))
            tokens += new
        out.append((tokens, tags))
    return out


class PiiModel:
    """The CRF, its feature numbers, and tokens on either side of a window."""

    MARGIN = 2

    def __init__(self, table: list[tuple[list[str], list[int]]] | None = None, rounds: int = 120):
        table = [(t, g) for t, g in (table or labelled()) if t]
        seen: dict[str, int] = {}
        feats = [features(t) for t, _ in table]
        for sentence in feats:
            for fs in sentence:
                for f in fs:
                    seen[f] = seen.get(f, 0) + 1
        self.number = {f: i for i, f in enumerate((f for f, c in seen.items() if c > 1), 1)}
        rows, lengths = padded([[self.row(fs) for fs in s] for s in feats], 6)
        tags = np.full(rows.shape[:2], OUT)
        for i, (_, g) in enumerate(table):
            tags[i, : len(g)] = g
        self.crf = Crf(len(self.number), OUT + 1).fit(rows, tags, lengths, rounds)
        lone = self.crf.emissions(np.array(self.row([f"s={PLAIN}", f"p={PLAIN}", f"q={PLAIN}", f"c={PLAIN}", f"pc={PLAIN}|{PLAIN}", f"g={PLAIN}"])))
        moves = self.crf.moves
        gain = moves.max() - min(moves[OUT, OUT], moves[OUT].min(), moves[:, OUT].min())
        if not (lone[OUT] - np.delete(lone, OUT).max() > 0 and 2 * (lone[OUT] - np.delete(lone, OUT).max()) > gain):
            raise ValueError("the labelled table doesn't make plain tokens outside")
        give_back()

    def row(self, fs: list[str]) -> list[int]:
        return [self.number.get(f, 0) for f in fs]

    def tag(self, windows: list[list[str]]) -> list[list[int]]:
        """The kind of each token of each window, by Viterbi over windows of like length."""
        out: list = [None] * len(windows)
        order = sorted(range(len(windows)), key=lambda i: len(windows[i]))
        for at in range(0, len(order), 256):
            some = order[at : at + 256]
            rows, lengths = padded([[self.row(fs) for fs in features(windows[i])] for i in some], 6)
            path = self.crf.viterbi(self.crf.emissions(rows), lengths)
            for i, p, n in zip(some, path, lengths):
                out[i] = p[:n].tolist()
        return out


_TOKEN = re.compile(r"\S+")
_HIT = re.compile("[0-9@]+")


def windows(text: str, margin: int) -> list[list[tuple[int, int]]]:
    """Spans of the tokens of each window: tokens with a digit or an @, with `margin` tokens around, joined where they meet."""
    if not _MARKS.search(text):
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts = [s for s, _ in tokens]
    out: list[list[int]] = []
    last = -1
    for m in _HIT.finditer(text):
        k = bisect_right(starts, m.start()) - 1
        if k == last:
            continue
        last = k
        if out and k - margin <= out[-1][1]:
            out[-1][1] = min(len(tokens), k + margin + 1)
        else:
            out.append([max(0, k - margin), min(len(tokens), k + margin + 1)])
    return [tokens[i:j] for i, j in out]


def _trimmed(text: str, kind: int, s: int, e: int) -> tuple[int, int, int] | None:
    """A tagged run without the marks around it, if it holds what its kind needs."""
    while s < e and not (text[s].isalnum() or text[s] in "+("):
        s += 1
    while s < e and not (text[e - 1].isalnum() or text[e - 1] == ")"):
        e -= 1
    n = len(_digits(text[s:e]))
    good = ("@" in text[s:e] and "." in text[s:e], text.count(".", s, e) >= 3, 12 <= n <= 19, 7 <= n <= 15)[kind]
    return (kind, s, e) if good else None


def _merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint intervals that the spans cover."""
    starts, ends = [], []
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _free(covered: tuple[list[int], list[int]], span: tuple[int, int, int]) -> bool:
    k = bisect_left(covered[0], span[2]) - 1  # the last interval that begins before the span ends
    return k < 0 or covered[1][k] <= span[1]


def both_spans(texts: list[str], model: PiiModel) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans, and the spans of the model that touch none of them, of each text."""
    found = [base_spans(t) for t in texts]
    covered = [_merged(f) for f in found]
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    where, asked = [], []
    for i, t in enumerate(texts):
        for w in windows(t, model.MARGIN):
            for at in range(0, len(w), 512):  # a longer window only where hundreds of tokens hold digits; pieces overlap by its margin
                part = w[max(0, at - 2 * model.MARGIN) : at + 512]
                where.append((i, part))
                asked.append([t[s:e] for s, e in part])
    for (i, part), tags in zip(where, model.tag(asked)):
        k = 0
        while k < len(tags):
            j = k + 1
            while j < len(tags) and tags[j] == tags[k]:
                j += 1
            if tags[k] != OUT:
                span = _trimmed(texts[i], tags[k], part[k][0], part[j - 1][1])
                if span and _free(covered[i], span) and not any(s < span[2] and span[1] < e for _, s, e in added[i][-4 * model.MARGIN :]):
                    added[i].append(span)  # spans come in order of the text, but for the few tokens that pieces share
            k = j
    return list(zip(found, added))


def find_spans(texts: list[str], model: PiiModel) -> list[list[tuple[int, int, int]]]:
    """Base spans, and the spans of the model that touch none of them, of each text by kind, then start."""
    return [sorted(f + a) for f, a in both_spans(texts, model)]


def find_pii(docs: DataFrame, model: PiiModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end in code points, and base, by kind, then start) of every row.

    base is true for spans of the fixed patterns and false for those that the model adds, which have the same kinds. A null or empty text has none. Repeated rows and null ids are rows like others; an empty table gives no rows.
    """
    model = model or PiiModel()
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches):
        for given, texts in steps(batches):
            marked = [sorted([(*x, True) for x in base] + [(*x, False) for x in added]) for base, added in both_spans(texts, model)]
            spans = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in found] for found in marked]
            yield pa.RecordBatch.from_arrays([given.column("doc_id"), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    return id_text(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def redact(docs: DataFrame, model: PiiModel | None = None, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets; of overlapping spans the earlier, then longer, stands.

    A null text stays null. A length column, if there is one, holds the new number of characters; other columns stay.
    """
    model = model or PiiModel()
    schema = docs.schema

    def hidden(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
            if s >= at:
                out += [text[at:s], f"[{KINDS[kind]}]"]
                at = e
        return "".join(out) + text[at:]

    def run(batches):
        for batch in batches:
            column, names = batch.schema.get_field_index(text_col), batch.schema.names
            texts = batch.column(column).to_pylist()
            spans = find_spans([t or "" for t in texts], model)
            new = [t if not s else hidden(t, s) for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == column else batch.column(i) for i in range(len(names))], names)

    out = docs.mapInArrow(tidy(run), schema)
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.char_length(text_col)).cast(schema[length_col].dataType))
    return out
