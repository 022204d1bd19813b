"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The patterns find well-formed e-mail addresses, IP addresses, card and phone
numbers. The random field (Sarawagi & Cohen, NeurIPS 2004) scores whole
candidate segments, so that a feature may look at all of a segment at once (how
many digits, how they are grouped, whether they pass Luhn). Dynamic programming
over segments of at most MAX_TOKENS tokens picks boundaries and types together.
It is trained here by conditional likelihood on generated lines.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, keyed_text

KINDS = ("email", "ip", "card", "phone", "secret", "iban")
BASE_KINDS = KINDS[:4]
MAX_TOKENS = 24
#: Words on each side of a telling mark that the random field reads: all segments with the mark, and what their features look at beside them.
REACH = MAX_TOKENS + 2

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    double = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(double[int(c)] if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards, in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Fours of the numbers in each dotted run, from its left; a number over 255 drops its four."""
    for run in _DOTTED.finditer(text):
        numbers, at = run.group().split("."), run.start()
        for k in range(0, len(numbers) - 3, 4):
            four = numbers[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(n.lstrip("0")) <= 3 and int(n.lstrip("0") or 0) <= 255 for n in four):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[Span]:
    """Pattern matches by kind as in BASE_KINDS, then by start."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", a, b) for a, b in addresses(text)]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


# --- the random field -----------------------------------------------------------------

_TOKEN = re.compile(r"[0-9A-Za-z]{24,}|[A-Za-z]+|[0-9]+|[^\W\d_]+|[^\s]")
_WORD = re.compile(r"\S+")
#: An e-mail address holds one of these.
_MARK = re.compile(r"@|\bat\b", re.IGNORECASE)
#: Every typed segment holds one of these, so the random field looks around them only.
_TELLING = re.compile(r"[0-9]|@|\b(?:dot|DOT)\b")
_HEX = re.compile(r"[0-9a-fA-F]+\Z")
_LABEL, _DOT, _AT = r"[A-Za-z0-9_%+-]+", r"\s*(?:\.|\[dot\]|\(dot\)|\bdot\b)\s*", r"\s*(?:@|\[at\]|\(at\)|\bat\b)\s*"
#: An address, spelt out or not: labels, one "at", labels, and a last one of letters.
_ADDRESS = re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})*{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}", re.IGNORECASE)
_ENDS = frozenset(("com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "uk"))
#: Keys with the prefixes that common services give theirs.
_KEY = re.compile(r"gh[pousr]_[0-9A-Za-z]{36}|(?:AKIA|ASIA)[0-9A-Z]{16}|sk-[0-9A-Za-z]{20,64}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,30}")
_CUE_WORDS = {"call": "phone", "phone": "phone", "tel": "phone", "mobile": "phone", "fax": "phone", "mail": "email", "email": "email", "contact": "email", "card": "card", "visa": "card", "key": "secret", "token": "secret", "secret": "secret", "password": "secret", "iban": "iban", "account": "iban", "host": "ip", "ip": "ip", "server": "ip", "version": "number", "page": "number", "year": "number", "section": "number"}


def iban(text: str) -> bool:
    """Whether a text has the form of an international account number, and its check digits."""
    if not _IBAN.fullmatch(text):
        return False
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def shape(text: str) -> str:
    """Runs of digits as 9, of letters as a, other characters as they are, 24 characters at most."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", text))[:24]


def segment_features(text: str, spans: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Features of tokens i to j - 1 as one segment."""
    a, b = spans[i][0], spans[j - 1][1]
    whole = text[a:b]
    digits = _NOT_DIGIT.sub("", whole)
    n, groups = len(digits), re.findall(r"[0-9]+", whole)
    form = shape(whole)
    before = text[spans[i - 1][0] : spans[i - 1][1]].lower() if i else "^"
    if before in ":=\"'([" and i > 1:
        before = text[spans[i - 2][0] : spans[i - 2][1]].lower()
    letters = len(re.findall(r"[^\W\d_]+", whole))
    lettered = f"+{min(letters, 5)}" if letters else ""
    out = [f"tokens{min(j - i, 12)}{lettered}", f"digits{min(n, 20)}{lettered}", f"groups{min(len(groups), 6)}{lettered}", f"form:{form}"]
    out += [f"cue:{_CUE_WORDS[before]}"] if before in _CUE_WORDS else []
    out += [f"first:{form[:1]}", f"last:{form[-1:]}"]
    joined = bool(a and text[a - 1].isalnum()) or bool(b < len(text) and text[b].isalnum())
    out += ["cut"] if joined or a > 1 and text[a - 1] in ".-" and text[a - 2].isdigit() or b + 1 < len(text) and text[b] in ".-" and text[b + 1].isdigit() else []
    if 13 <= n <= 19 and not re.search(r"[A-Za-z@+]", whole):
        out.append("luhn" if luhn(digits) else "not-luhn")
    if len(whole) >= 24 and _HEX.match(whole) and re.search("[a-fA-F]", whole) and n:
        out.append("hex")
    lower = whole.lower()
    marks = len(re.findall(r"@|[\[(]at[\])]|\bat\b", lower))
    dots = len(re.findall(r"[\[(]dot[\])]|\bdot\b", lower))
    if marks == 1 and (dots or "." in lower) and _ADDRESS.fullmatch(whole):
        out.append("address")
        out += ["known-end"] if re.split(r"[^a-z]+", lower)[-1] in _ENDS else []
    if n and _KEY.fullmatch(whole):
        out.append("key-form")
    if n >= 6 and iban(whole):
        out.append("account")
    if marks > 1:
        out.append("marks")
    if len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and n == len(re.sub(r"[^0-9]", "", lower)) and not re.search("[a-z]", lower):
        out.append("four-bytes")
    if re.search(r"[.,;:!?\n|]", re.sub(r"[0-9A-Za-z]\.[0-9A-Za-z]", "", whole)):
        out.append("stop")
    if "\n" in whole:
        out.append("line")
    # A key's or an account's form tells all; what it happens to consist of would only blur it.
    sure = [f for f in out if f in ("key-form", "account")]
    return [*sure, *(["cut"] if "cut" in out else [])] if sure else out


class Field:
    """Weights of (type, feature); type 0 is outside, whose segments are one token."""

    def __init__(self, seed: int = 7, lines: int = 480, rounds: int = 8):
        self.index: dict[str, int] = {}
        data = [self.lattice(t, gold, grow=True) for t, gold in generated(seed, lines)]
        self.weights = np.zeros((len(KINDS) + 1, len(self.index)))
        self.train(data, rounds, seed)

    def lattice(self, text: str, gold: list[Span] | None = None, grow: bool = False, blocked=()) -> tuple:
        """Candidate segments of a window: token count, starts, ends, feature ids, which may have a type, the gold ones, token spans."""
        spans = [m.span() for m in _TOKEN.finditer(text)]
        n = len(spans)
        live = [_usable(text[a:b]) and not any(x < b and a < y for x, y in blocked) for a, b in spans]
        starts, ends, feats = [], [], []

        def put(i: int, j: int) -> None:
            names = segment_features(text, spans, i, j)
            ids = [self.index.setdefault(f, len(self.index)) for f in names] if grow else [self.index[f] for f in names if f in self.index]
            starts.append(i), ends.append(j), feats.append(ids)

        for i in range(n):
            put(i, i + 1)
            if not live[i] or not _may_start(text[spans[i][0] : spans[i][1]]):
                continue
            for j in range(i + 2, min(n, i + MAX_TOKENS) + 1):
                if not live[j - 1] or "\n" in text[spans[j - 2][1] : spans[j - 1][0]]:
                    break
                if _may_end(text[spans[j - 1][0] : spans[j - 1][1]]) and _TELLING.search(text, spans[i][0], spans[j - 1][1]):
                    put(i, j)
        width = max(map(len, feats), default=1)
        ids = np.full((len(feats), width), -1)
        for k, f in enumerate(feats):
            ids[k, : len(f)] = f
        s, e = np.array(starts, int), np.array(ends, int)
        ends_well = lambda i, j: _may_start(text[spans[i][0] : spans[i][1]]) and _may_end(text[spans[j - 1][0] : spans[j - 1][1]])
        open_ = np.array([live[i] and ends_well(i, j) and bool(_TELLING.search(text, spans[i][0], spans[j - 1][1])) for i, j in zip(starts, ends, strict=True)], bool)
        label = None
        if gold is not None:
            at = {(a, b): KINDS.index(k) + 1 for k, a, b in gold}
            kinds = [at.get((spans[i][0], spans[j - 1][1]), 0) for i, j in zip(starts, ends, strict=True)]
            inside = np.zeros(n, bool)
            for i, j, k in zip(starts, ends, kinds, strict=True):
                inside[i:j] |= k > 0
            label = [(q, k) for q, (i, j, k) in enumerate(zip(starts, ends, kinds, strict=True)) if k or j == i + 1 and not inside[i]]
        # What an address, a key and an account must have, whatever else speaks for them.
        whole = [text[spans[i][0] : spans[j - 1][1]] for i, j in zip(starts, ends, strict=True)]
        must = {"email": [bool(_MARK.search(w)) for w in whole], "secret": [not re.search(r"\s", w) for w in whole], "iban": [iban(w) for w in whole]}
        return n, s, e, ids, open_, label, spans, {k: np.array(v, bool) for k, v in must.items()}

    def scores(self, lat: tuple) -> np.ndarray:
        """[segment, type]; -inf where a type may not be."""
        n, s, e, ids, open_, _, _, must = lat
        w = np.concatenate([self.weights, np.zeros((len(self.weights), 1))], 1)
        out = w[:, ids].sum(2).T if len(ids) else np.zeros((0, len(self.weights)))
        out[e - s > 1, 0] = -np.inf
        out[~open_, 1:] = -np.inf
        for kind, has in must.items():
            out[~has, 1 + KINDS.index(kind)] = -np.inf
        return out

    def train(self, data: list[tuple], rounds: int, seed: int, rate: float = 0.2, l2: float = 1e-3) -> None:
        """Stochastic gradient on the conditional likelihood, by forward and backward sums over segments (AdaGrad)."""
        order, past = random.Random(seed), np.full_like(self.weights, 1e-6)
        for _ in range(rounds):
            order.shuffle(data)
            for lat in data:
                n, s, e, ids, _, label, _, _ = lat
                z = self.scores(lat)
                total = np.logaddexp.reduce(z, 1)
                by_end, by_start = [np.flatnonzero(e == k) for k in range(n + 1)], [np.flatnonzero(s == k) for k in range(n + 1)]
                fore, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
                fore[0] = back[n] = 0
                for k in range(1, n + 1):
                    fore[k] = np.logaddexp.reduce(fore[s[by_end[k]]] + total[by_end[k]])
                for k in range(n - 1, -1, -1):
                    back[k] = np.logaddexp.reduce(back[e[by_start[k]]] + total[by_start[k]])
                grad = -np.exp(fore[s][:, None] + z + back[e][:, None] - fore[n])
                for q, k in label:
                    grad[q, k] += 1
                g = np.zeros((self.weights.shape[0], self.weights.shape[1] + 1))
                for k in range(grad.shape[1]):
                    g[k] = np.bincount(np.where(ids < 0, self.weights.shape[1], ids).ravel(), np.repeat(grad[:, k], ids.shape[1]), self.weights.shape[1] + 1)
                g = g[:, :-1] - l2 * self.weights
                past += g * g
                self.weights += rate * g / np.sqrt(past)

    def best(self, text: str, blocked=()) -> list[Span]:
        """The best segmentation's typed segments; none touches a blocked range."""
        lat = self.lattice(text, blocked=blocked)
        n, s, e, _, _, _, spans, _ = lat
        if not n:
            return []
        z = self.scores(lat)
        kind, top = z.argmax(1), z.max(1)
        value, back = [0.0] + [-np.inf] * n, [-1] * (n + 1)
        for q in np.lexsort((s, e)).tolist():
            if (v := value[s[q]] + top[q]) > value[e[q]]:
                value[e[q]], back[e[q]] = v, q
        out, k = [], n
        while k:
            q = back[k]
            if kind[q]:
                out.append((KINDS[kind[q] - 1], spans[s[q]][0], spans[e[q] - 1][1]))
            k = int(s[q])
        return out[::-1]


def _usable(token: str) -> bool:
    return token.isalnum() or token in "+-().[]@_%/:#"


def _may_start(token: str) -> bool:
    return token.isalnum() or token in "+("


def _may_end(token: str) -> bool:
    return token.isalnum()


def generated(seed: int, lines: int) -> Iterator[tuple[str, list[Span]]]:
    """Lines of filler with personal data in forms that the patterns know and forms that they don't, and with harmless numbers."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 8)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    letter = lambda: r.choice("ABDEFG") + r.choice("BERS")

    def card() -> str:
        digits = r.choice("3456") + num(r.choice((13, 14, 14, 14)))
        return next(digits + c for c in "0123456789" if luhn(digits + c))

    def entity() -> tuple[str, str]:
        kind = r.choice(KINDS)
        if kind == "email":
            name, host = f"{word()}{r.choice(['', '.' + num(2), '_' + word()])}", f"{word()}{r.choice(['', num(1)])}"
            end = r.choice(["com", "org", "net", "de"])
            at, dot = r.choice([("@", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), (" AT ", " DOT "), ("[at]", "[dot]"), (" @ ", ".")])
            return kind, f"{name}{at}{host}{r.choice(['', dot + word()])}{dot}{end}"
        if kind == "ip":
            four = [str(r.randint(0, 255)) for _ in range(4)]
            return kind, r.choice([".", ".", "[.]", " . "]).join(four)
        if kind == "card":
            c = card()
            return kind, r.choice([c, r.choice(" -./").join(c[k : k + 4] for k in range(0, len(c), 4))])
        if kind == "phone":
            a, b, c = num(3), num(3), num(4)
            return kind, r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)} {num(3)} {num(7)}", f"1-{a}-{b}-{c}"])
        mixed = lambda k, of: "".join(r.choice(of) for _ in range(k - 1)) + r.choice("0123456789")
        if kind == "iban":
            country, account = r.choice(["DE", "FR", "GB", "ES"]), r.choice(["", "".join(r.choice("ABCDEFGH") for _ in range(4))]) + num(r.choice((14, 18)))
            check = 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97
            whole = f"{country}{check:02d}{account}"
            return kind, r.choice([whole, " ".join(whole[k : k + 4] for k in range(0, len(whole), 4))])
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        every = letters + letters.lower() + "0123456789"
        return kind, r.choice([mixed(r.choice((32, 40, 40, 64)), "0123456789abcdef")] * 3 + ["ghp_" + mixed(36, every), "AKIA" + mixed(16, letters + "0123456789"), "sk-" + mixed(r.choice((32, 48)), every)])

    def harmless() -> str:
        return r.choice([f"{r.randint(0, 9)}.{r.randint(0, 9)}", num(4), f"{num(2)}.{num(2)}.{num(4)}", f"{num(1)},{num(3)}", num(r.randint(1, 12)), num(16), num(16), num(15), num(20), f"{num(3)}-{num(2)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", "dot", "at", f"{word()} at {word()}", f"{word()} at {word()} {word()} {word()}", f"{word()} at {num(1)} dot {num(1)} {word()}", f"{word()} dot {word()} at {word()}", f"{word()} at {word()} dot", f"{letter()}{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)}", letter() + num(14), " ".join(f"w{num(3)}" for _ in range(12)), f"v{num(1)}.{num(1)}.{num(1)}"])

    for _ in range(lines):
        text, gold = "", []
        for _ in range(r.randint(3, 8)):
            text += r.choice(["", "", "", "(", "\n"]) if text else ""
            pick = r.random()
            if pick < 0.35:
                kind, what = entity()
                if r.random() < 0.4:
                    cues = [w for w, k in _CUE_WORDS.items() if k == kind]
                    text += r.choice(cues) + r.choice([" ", ": ", "=", ' = "'])
                gold.append((kind, len(text), len(text) + len(what)))
                text += what
            elif pick < 0.6:
                if r.random() < 0.3:
                    text += r.choice(["version", "page", "year", "section"]) + " "
                text += harmless()
            else:
                text += word()
            text += r.choice([" ", " ", " ", ". ", ", ", '" '])
        yield text, gold


@lru_cache(maxsize=1)
def field() -> Field:
    """Trained once a process, from the same seed everywhere."""
    return Field()


def added_spans(text: str, base: list[Span], model: Field) -> list[Span]:
    """Segments that the random field finds beside the base spans: those of its best path over the whole text.

    It is run in windows of REACH words to each side of a telling mark that no base
    span covers. A word is a token or more, so windows hold every segment that may
    have a type, with all that its features look at; windows that touch are one.
    """
    taken = sorted((a, b) for _, a, b in base)
    first = [a for a, _ in taken]
    telling = [m.start() for m in _TELLING.finditer(text) if not ((k := bisect_right(first, m.start())) and m.end() <= max(b for _, b in taken[max(0, k - 4) : k]))]
    if not telling:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    begins = [a for a, _ in words]
    windows: list[list[int]] = []
    for at in telling:
        k = bisect_right(begins, at) - 1
        lo, hi = max(0, k - REACH), min(len(words) - 1, k + REACH)
        if windows and lo <= windows[-1][1]:
            windows[-1][1] = max(hi, windows[-1][1])
        else:
            windows.append([lo, hi])
    out = []
    for lo, hi in windows:
        a, b = words[lo][0], words[hi][1]
        near = [(x - a, y - a) for x, y in taken if x < b and a < y]
        out += [(k, x + a, y + a) for k, x, y in model.best(text[a:b], near)]
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and spans of personal data in every whole text.

    Null or empty text: counts 0, the digest of nothing, no spans. Each row is
    read by itself, so ties, repeated rows and extra columns change nothing. Very
    long texts are read whole; the random field holds one window at a time.
    Offsets are code points, ends exclusive. n_added counts the random field's.
    """
    bounded_batches(docs.sparkSession)
    model = field()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf = shared.value
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base = base_spans(text)
                more = added_spans(text, base, crf)
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in BASE_KINDS), sha256(written(base).encode()).hexdigest(), written(base + more), len(more)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield out

    return keyed_text(docs, id_col, text_col).mapInPandas(found, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str, crf: Field) -> str:
    """text with [EMAIL], [IP] and so on in the place of spans; overlapping spans become one, named by the first."""
    base = base_spans(text)
    out, end = [], 0
    merged: list[list] = []
    for k, a, b in sorted(base + added_spans(text, base, crf), key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[end:a], f"[{k.upper()}]"]
        end = b
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in the text replaced by its kind in brackets; a null text stays null."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field())

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        crf = shared.value
        return pd.Series([None if t is None else redacted(t, crf) for t in texts], dtype=object)

    return docs.withColumn(text_col, masked(F.col(text_col)))
