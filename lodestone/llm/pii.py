"""Redaction of personal data by boosted trees over proposed spans.

Generators propose every span that might be personal data, freely and
overlapping. Gradient-boosted trees score each from its format (lengths, digit
groups, checksums, entropy) and its context (the words and signs around it). The scores are
calibrated on held-out candidates; each kind's threshold is the cut of best F1
among those that are precise enough there, halfway to the next lower score. Of
overlapping spans that pass the likeliest is redacted, of equally likely ones the
longest, then the first.

The training candidates are made here: values of each kind and look-alikes
(versions, dates, amounts, order numbers, identifiers) are written into the
texts of a bounded sample of the documents, with and without telling words.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import features as X
from lodestone.llm.common import column, lean, slices
from lodestone.llm.toxicity import pick_threshold

KINDS = ("email", "phone", "ip", "card", "secret", "ssn", "iban")
#: Documents whose texts carry the training candidates, and candidates written of each kind and look-alike.
SAMPLE, EACH = 1500, 500
PRECISION = 0.98
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("score", T.DoubleType())]))

GENERATORS = [
    (0, re.compile(r"[^\s@<>\"'(),;:=|]+@[^\s@<>\"'(),;:=|]+")),
    (0, re.compile(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+")),
    (1, re.compile(r"(?<![\w.@-])\+?\(?\d(?:[ ./()-]{0,2}\d){6,14}(?![\w@])")),
    (1, re.compile(r"(?<![\w.@-])\+?\d{0,3}[ .-]?\(?\d{2,4}\)?[ .-]\d{3,4}[ .-]\d{3,4}(?![\w@])")),
    (2, re.compile(r"(?<![\w.-])\d{1,3}(?:\.\d{1,3}){2,4}(?![\w-])")),
    (2, re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f:]{1,4}(?![\w:])")),
    (3, re.compile(r"(?<![\w.-])\d{12,19}(?![\w-])")),
    (3, re.compile(r"(?<![\w.-])\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,4})?(?![\w-])")),
    (3, re.compile(r"(?<![\w.-])\d{4}[ -]\d{6}[ -]\d{5}(?![\w-])")),
    (4, re.compile(r"(?i)(?:pass|pwd|token|secret|credential|key|auth|bearer)\w{0,12}[\"']?\s{0,2}(?:[=:]|\bis\b)\s{0,2}[\"']?(?P<v>[^\s\"',;|]{4,})")),
    (4, re.compile(r"(?<![\w/+-])(?P<v>[A-Za-z0-9_+/-]{16,}={0,2})(?![\w/+-])")),
    (5, re.compile(r"(?<![\w.-])\d{3}[- ]\d{2}[- ]\d{4}(?![\w-])")),
    (6, re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{2,4}){3,8}(?!\w)")),
]
#: Texts without any of this have no candidate; a long run of letters alone is no secret unless its cases change within.
TRIGGER = r"[\pN@]|[a-z][A-Z]|(?i:(?:pass|pwd|token|secret|credential|key|auth|bearer)[\w-]*[\"']?\s*(?:[=:]|\bis\b))"
TELLING = [
    re.compile(r"(?i)e-?mail|mail|contact|write to"),
    re.compile(r"(?i)phone|tel\b|call|fax|mobile|cell|whatsapp"),
    re.compile(r"(?i)\bip\b|host|server|address|from|login"),
    re.compile(r"(?i)card|visa|amex|payment|credit|debit"),
    re.compile(r"(?i)pass|pwd|token|secret|key|credential|auth|bearer"),
    re.compile(r"(?i)ssn|social|security|insured"),
    re.compile(r"(?i)iban|account|bank|transfer"),
]
PASSWORD = re.compile(r"(?i)(?:pass(?:word|wd|phrase|code)?|pwd)\w*[\"']?\s*(?:[=:]|is)\s*[\"']?$")
OTHER = re.compile(r"(?i)version|release|\bv\b|\bv\.|isbn|order|ref|invoice|figure|table|section|page|\bno\.?|licen|\bcc\b|date|year|since|total|build|commit|\bid\b|serial|item")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    v = value.replace(" ", "")
    try:
        return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
    except ValueError:
        return False


#: Every candidate holds, or follows at once on, one of these.
SEED = re.compile(r"[0-9@]|[a-z][A-Z]|(?i:pass|pwd|token|secret|credential|key|auth|bearer)\w*[\"']?\s{0,2}(?:[=:]|is\b)")
WHITE = re.compile(r"\s")


def regions(text: str, margin: int = 64) -> Iterator[tuple[int, int]]:
    """The parts of a text around its seeds, from white space to white space, apart from each other."""
    start = stop = -1
    at = 0
    while m := SEED.search(text, at):
        s, e = m.start() - margin, m.end() + margin
        while s > 0 and not text[s].isspace():
            s -= 1
        e = w.start() if e < len(text) and (w := WHITE.search(text, e)) else len(text)
        if start >= 0 and s > stop:
            yield start, stop
            start = -1
        if start < 0:
            start = max(s, 0)
        stop = e
        at = max(m.end(), e - margin)
    if start >= 0:
        yield start, stop


MIXED = re.compile(r"[a-z][A-Z]")


def opaque(token: str) -> bool:
    """Whether a token that nothing names may be a secret: letters with digits, or a long one whose cases change within."""
    return any(c.isdigit() for c in token) or len(token) >= 20 and bool(MIXED.search(token))


def propose(text: str) -> list[tuple[int, int, int]]:
    """(start, stop, kind) of every candidate; they may overlap."""
    parts = list(regions(text))
    out = set()
    for kind, pattern in GENERATORS:
        named = "v" in pattern.groupindex
        for m in (m for s, e in parts for m in pattern.finditer(text, s, e)):
            s, e = m.span("v" if named else 0)
            if kind == 0:
                while e > s and text[e - 1] in ".,!?:;":
                    e -= 1
            if kind == 4 and not named:
                continue
            if kind == 4 and m.start() == s and not opaque(text[s:e]):
                continue
            while kind == 4 and e > s and text[e - 1] in ".)]}":
                e -= 1
            if e > s:
                out.add((s, e, kind))
    return sorted(out)


def describe(text: str, start: int, stop: int, kind: int) -> list[float]:
    """Format and context of a candidate, as numbers."""
    v = text[start:stop]
    n = len(v)
    digits = re.sub(r"[^0-9]", "", v)
    nd, nu, nl = len(digits), sum(c.isupper() for c in v), sum(c.islower() for c in v)
    counts: dict[str, int] = {}
    for c in v:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    parts = v.split(".")
    octets = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    runs = [len(x) for x in re.findall(r"\d+", v)]
    local, _, domain = v.partition("@")
    before, after = text[max(0, start - 24) : start], text[stop : stop + 12]
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(v, v[1:]))
    first = int(digits[:4] or 0)
    return [
        kind, n, nd, nu, nl, n - nd - nu - nl, entropy, changes, len(runs), max(runs, default=0), min(runs, default=0), runs[-1] if runs else 0,
        float(12 <= nd <= 19 and luhn(digits)), float(octets), float(parts[0].lstrip("0") == parts[0]) if octets else 0.0, float(iban_valid(v)),
        float(v.startswith("+")), v.count("(") + v.count(")"), v.count("-"), v.count("."), v.count(" "), v.count("/"), v.count(":"), v.count("_"),
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", v))), float("@" in v and bool(re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}", domain))), len(domain.rpartition(".")[2]) if domain else 0, len(local),
        float(bool(TELLING[kind].search(before))), float(bool(PASSWORD.search(before))), float(v.isalpha()), float(bool(MIXED.search(v))), float(bool(OTHER.search(before))), float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(before[-1:] in "\"'"),
        float(not before or before[-1].isspace()), float(not after or after[0].isspace()), float(after[:1] in "\"'"), float(after[:1] in ".,!?"), float(before[-1:] in "$€£#§"), float(after[:1] in "%°"),
        float(first in range(1900, 2100)), float(bool(re.fullmatch(r"(19|20)\d\d[-/. ]\d{1,2}[-/. ]\d{1,2}|\d{1,2}[-/. ]\d{1,2}[-/. ](19|20)\d\d", v))),
    ]


# --- training candidates


def _card(r: random.Random) -> str:
    body = r.choice(["4", "5", "37", "6", "35", str(r.randint(1, 9))])
    size = 15 if body == "37" else r.choice([16, 16, 16, 13, 19])
    body += "".join(r.choice("0123456789") for _ in range(size - 1 - len(body)))
    body += next(c for c in "0123456789" if luhn(body + c))
    return body if size != 16 or r.random() < 0.6 else r.choice(" -").join(body[i : i + 4] for i in range(0, 16, 4))


def _not_luhn(r: random.Random, size: int) -> str:
    body = "".join(r.choice("0123456789") for _ in range(size - 1))
    return body + r.choice([c for c in "0123456789" if not luhn(body + c)])


def _iban(r: random.Random) -> str:
    land, body = r.choice(["DE", "FR", "ES", "GB", "NL", "IT"]), "".join(r.choice("0123456789") for _ in range(r.choice([14, 18, 20, 23])))
    check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
    v = f"{land}{check:02d}{body}"
    return v if r.random() < 0.6 else " ".join(v[i : i + 4] for i in range(0, len(v), 4))


def _secret(r: random.Random) -> str:
    al = r.choice(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"])
    if r.random() < 0.15:
        al = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
        return r.choice(["", "sk_", "ghp_"]) + "".join(r.choice(al) for _ in range(r.choice([24, 32, 36, 40])))
    return r.choice(["", "", "sk_", "AKIA", "ghp_"]) + "".join(r.choice(al) for _ in range(r.choice([16, 18, 20, 24, 32, 36, 40, 64])))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _phone(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    return r.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{r.randint(1, 99)} {d(3)} {d(3)} {d(4)}", f"+{r.randint(20, 99)}{d(9)}", f"+49 {d(3)} {d(7)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(2)} {d(4)} {d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}"])


def _word(r: random.Random, words: list[str]) -> str:
    return re.sub(r"\W", "", r.choice(words)) or "item"


def _positive(kind: int, r: random.Random, words: list[str]) -> tuple[str, str, str]:
    """(before, value, after)"""
    q = r.choice(["", "", '"', "'"])
    if kind == 0:
        local = r.choice([_word(r, words), f"{_word(r, words)}.{r.randint(1, 99)}", f"{_word(r, words)}.{_word(r, words)}", f"{_word(r, words)}_{r.randint(1, 999)}", f"{_word(r, words)}+{_word(r, words)}"])
        host = r.choice([f"{_word(r, words)}.{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io', 'co.uk', 'edu'])}", f"mail{r.randint(1, 9)}.example.com", "example.org", "mail.com"])
        host = host.encode("ascii", "ignore").decode().lower().lstrip(".-") or "example.com"
        return r.choice(["", "", "", "mail: ", "contact ", "<", "email "]), f"{local}@{host}", r.choice(["", "", ".", ",", ">"])
    if kind == 1:
        return r.choice(["", "", "", "call ", "tel: ", "phone "]), _phone(r), r.choice(["", "", ".", ","])
    if kind == 2:
        return r.choice(["", "", "", "host ", "ip ", "from "]), ".".join(str(r.randint(1, 255)) for _ in range(4)), r.choice(["", "", ".", ","])
    if kind == 3:
        return r.choice(["", "", "", "card ", "visa "]), _card(r), r.choice(["", "", ".", ","])
    if kind == 4:
        v = _secret(r)
        name = r.choice(["password", "token", "secret", "api_key", "key", "pwd", "access_key", "client_secret", "auth_token", "credential"])
        mark = r.choice(["=", " = ", ": ", ":"])
        kind_of = r.random()
        if kind_of < 0.2:  # a password with digits or signs
            name, mark = r.choice(["password", "passwd", "pwd", "pass", "Password", "passphrase", "PASSWORD"]), r.choice([mark, mark, " is "])
            v = _word(r, words)[:9] + r.choice("!$#%&") * r.randint(0, 1) + _digits(r, r.randint(1, 4))
        elif kind_of < 0.3:  # one of letters alone
            name = r.choice(["password", "passwd", "pwd", "Password", "passphrase", "PASSWORD"])
            while len(v := _word(r, words).lower() + _word(r, words).lower()) < 10 or not v.isalpha():
                words = [*words, "correct", "horse", "battery", "staple"]
            v = v[:20]
        elif kind_of < 0.6:
            return "", v, r.choice(["", ".", ","])
        return f"{name}{mark}{q}", v, q
    if kind == 5:
        return r.choice(["", "", "ssn ", "social security "]), f"{r.randint(100, 899)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", r.choice(["", ".", ","])
    return r.choice(["", "", "iban ", "account "]), _iban(r), r.choice(["", ".", ","])


def _negative(r: random.Random, words: list[str]) -> tuple[str, str, str]:
    d = lambda n: _digits(r, n)
    y, mo, da = r.randint(1900, 2030), r.randint(1, 12), r.randint(1, 28)
    return r.choice([
        lambda: (r.choice(["version ", "release ", "v", "licence "]), ".".join(str(r.randint(0, 40)) for _ in range(r.choice([2, 3, 3, 4]))), r.choice(["", "."])),
        lambda: ("", ".".join(str(r.randint(0, 20)) for _ in range(3)), r.choice(["", "."])),
        lambda: ("", ".".join([str(r.randint(256, 999)), *(str(r.randint(0, 999)) for _ in range(3))]), ""),
        lambda: (r.choice(["", "since ", "date "]), r.choice([f"{y}-{mo:02d}-{da:02d}", f"{da:02d}.{mo:02d}.{y}", f"{da:02d}/{mo:02d}/{y}", f"{y}{mo:02d}{da:02d}", f"{y}-{mo:02d}-{da:02d} {d(2)}:{d(2)}"]), ""),
        lambda: ("", f"{y}-{y + r.randint(1, 9)} {y}", ""),
        lambda: (r.choice(["order ", "ref ", "invoice no. ", "item ", "id ", ""]), _not_luhn(r, r.choice([13, 14, 16, 16, 16, 18])), ""),
        lambda: (r.choice(["order ", "ref ", "serial ", "item "]), d(r.randint(7, 11)), ""),
        lambda: ("ISBN ", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", ""),
        lambda: (r.choice(["", "$", "€", "total "]), f"{r.randint(1, 999)},{d(3)},{d(3)}", ""),
        lambda: (r.choice(["", "$", "total "]), f"{d(7)}.{d(2)}", r.choice(["", "%"])),
        lambda: ("", "-".join(_word(r, words).lower() for _ in range(3)) + f"-{r.randint(1, 99)}", ""),
        lambda: ("", f"{_word(r, words)}{_word(r, words)}{_word(r, words)}{r.randint(1, 9)}", ""),
        lambda: ("", f"{_word(r, words)}/{_word(r, words)}/{_word(r, words)}{r.randint(1, 20)}", ""),
        lambda: (r.choice(["key: ", "token: ", "the secret is ", "password is ", "the key is ", "token = ", "password: ", "password = "]), r.choice(["none", "null", "required", "missing", "changed", "reset", "unknown", "true", "false", _word(r, words).lower()[:8]]), r.choice(["", ".", ","])),
        lambda: (r.choice(["the secret is ", "the key is ", "a token is ", "key: ", "the password is "]), _word(r, words).lower(), r.choice(["", ".", ",", " of it"])),
        lambda: ("", _word(r, words) + _word(r, words).capitalize() + _word(r, words).capitalize() + r.choice(["", _word(r, words).capitalize()]), r.choice(["", ".", "("])),
        lambda: ("", "".join(_word(r, words).capitalize() for _ in range(r.randint(2, 4))), ""),
        lambda: (r.choice(["commit ", "build ", "id "]), "-".join(_digits(r, 4) for _ in range(2)) + f"-{_word(r, words).lower()}", ""),
        lambda: ("", f"{_word(r, words)}@{r.choice([_word(r, words), '', '3pm', 'home'])}", ""),
        lambda: ("", f"@{_word(r, words)}", ""),
        lambda: ("", f"{d(2)}:{d(2)}:{d(2)}:{d(2)}", ""),
        lambda: (r.choice(["figure ", "table ", "section "]), f"{r.randint(1, 9)}.{r.randint(1, 30)}.{r.randint(1, 30)}", "."),
        lambda: ("", " ".join(d(r.randint(2, 4)) for _ in range(r.randint(3, 5))), ""),
        lambda: ("CC BY-NC ", "4.0", "."),
    ])()


def candidates(texts: list[str], each: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Descriptions of training candidates, and which are personal data."""
    r = random.Random(seed)
    usable = [t[k : k + 400] for t in texts if (k := r.randint(0, max(0, len(t) - 400))) >= 0] or ["a line of words."]
    words = [w for t in usable for w in t.split() if w.isalpha()] or ["word"]
    x, y = [], []
    plans = [k for k in range(len(KINDS)) for _ in range(each)] + [-1] * (6 * each)
    r.shuffle(plans)
    for plan in plans:
        host = r.choice(usable).split(" ")
        cut = r.randint(0, len(host))
        before, value, after = _positive(plan, r, words) if plan >= 0 else _negative(r, words)
        head = " ".join(host[:cut]) + (" " if cut else "") + before
        text = head + value + after + (" " if cut < len(host) else "") + " ".join(host[cut:])
        s, e = len(head), len(head) + len(value)
        for a, b, kind in propose(text):
            if b <= s or a >= e:
                continue
            x.append(describe(text, a, b, kind))
            y.append(plan >= 0 and kind == plan and a == s and b == e)
    return np.array(x, dtype=np.float32), np.array(y, dtype=np.float32)


# --- boosted trees


@dataclass
class Boosted:
    """Trees of depth DEPTH over binned features, as arrays of (feature, cut) by node and of leaf values."""

    edges: list[np.ndarray]
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)]).astype(np.uint8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        rows, out = np.arange(len(b)), np.full(len(b), self.base)
        for f, c, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(b), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, f[node]] > c[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


DEPTH, TREES, RATE, BINS, LAMBDA = 4, 80, 0.2, 48, 1.0


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    edges = []
    for k in range(x.shape[1]):
        u = np.unique(x[:, k])
        mids = (u[1:] + u[:-1]) / 2
        edges.append(mids if len(mids) < BINS else np.unique(np.quantile(mids, np.linspace(0, 1, BINS - 1))))
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    out = Boosted(edges, base=float(np.log(p / (1 - p))))
    b, m = out.bins(x), np.full(len(x), out.base)
    rows = np.arange(len(x))
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-m))
        g, h = q - y, q * (1 - q)
        node = np.zeros(len(x), dtype=np.int64)
        feats, cuts = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, 255, np.int64)
        for level in range(DEPTH):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-6)
            for k in range(x.shape[1]):
                key = (node - first) * (BINS + 1) + b[:, k]
                gl = np.bincount(key, weights=g, minlength=n * (BINS + 1)).reshape(n, -1).cumsum(1)
                hl = np.bincount(key, weights=h, minlength=n * (BINS + 1)).reshape(n, -1).cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + LAMBDA) + (gt - gl) ** 2 / (ht - hl + LAMBDA) - gt**2 / (ht + LAMBDA)
                gain = np.where((hl >= 0.5) & (ht - hl >= 0.5), gain, 0)
                at = gain.argmax(1)
                top = gain[np.arange(n), at]
                better = top > best
                best = np.where(better, top, best)
                feats[first : first + n] = np.where(better, k, feats[first : first + n])
                cuts[first : first + n] = np.where(better, at, cuts[first : first + n])
            node = 2 * node + 1 + (b[rows, feats[node]] > cuts[node])
        leaf = node - (2**DEPTH - 1)
        gs, hs = np.bincount(leaf, weights=g, minlength=2**DEPTH), np.bincount(leaf, weights=h, minlength=2**DEPTH)
        value = -RATE * gs / (hs + LAMBDA)
        out.features.append(feats)
        out.cuts.append(cuts)
        out.leaves.append(value)
        m = m + value[leaf]
    return out


@dataclass
class Redactor:
    trees: Boosted
    slope: float
    offset: float
    thresholds: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.trees.margin(x) + self.offset)))

    def redact(self, texts: list[str | None]) -> list[tuple[str | None, list[dict] | None]]:
        spans, rows = [], []
        for i, text in enumerate(texts):
            for s, e, kind in propose(text) if text else ():
                spans.append((i, s, e, kind))
                rows.append(describe(text, s, e, kind))
        picked: dict[int, list[tuple]] = {}
        if rows:
            p = self.score(np.array(rows, dtype=np.float32))
            for (i, s, e, kind), q in zip(spans, p):
                if q >= self.thresholds[kind]:
                    picked.setdefault(i, []).append((-round(float(q), 4), s - e, s, e, kind))
        out = []
        for i, text in enumerate(texts):
            taken: list[tuple] = []
            for q, _, s, e, kind in sorted(picked.get(i, ())):
                if all(e <= a or s >= b for a, b, *_ in taken):
                    taken.append((s, e, kind, -q))
            taken.sort()
            if text is not None and taken:
                parts, at = [], 0
                for s, e, kind, _ in taken:
                    parts += [text[at:s], f"<{KINDS[kind].upper()}>"]
                    at = e
                text = "".join([*parts, text[at:]])
            out.append((text, None if text is None else [{"start": s, "stop": e, "kind": KINDS[k], "score": q} for s, e, k, q in taken]))
        return out


def train(texts: list[str], each: int = EACH, seed: int = 3) -> Redactor:
    x, y = candidates(texts, each, seed)
    held = np.random.default_rng(seed).random(len(x)) < 0.3
    trees = boost(x[~held], y[~held])
    m, yh = trees.margin(x[held]), y[held]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic fit of the held-out margins, slightly damped
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        grad = np.array([((p - yh) * m).sum() + 0.1 * (a - 1), (p - yh).sum() + 0.1 * b])
        hess = np.array([[(w * m * m).sum() + 0.1, (w * m).sum()], [(w * m).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        a, b = a - 0.5 * step[0], b - 0.5 * step[1]
    out = Redactor(trees, float(a), float(b), np.full(len(KINDS), 0.5))
    p = out.score(x[held])
    for k in range(len(KINDS)):
        mine = x[held][:, 0] == k
        if yh[mine].any():
            out.thresholds[k] = pick_threshold(p[mine], yh[mine], PRECISION)
    return out


def model(docs: DataFrame, bound: int = SAMPLE, each: int = EACH, seed: int = 3) -> Redactor:
    """The redactor trained on the texts of least hash, in a task; neither they nor any text comes to the driver."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where("length(text) > 0").withColumn("key", F.xxhash64("text"))
    few = X.thinned(texts, bound, F.col("key")).orderBy("key", "text").limit(bound).select("text")
    return X.trained(few, lambda t: train(sorted(t["text"].to_pylist()), each, seed), pa.schema([("text", pa.string())]), lambda t: t)


def _redacted(docs: DataFrame, found: Redactor, extra: bool) -> DataFrame:
    schema = T.StructType(list(docs.schema))
    if extra:
        schema = T.StructType([*docs.schema, T.StructField("n_redacted", T.IntegerType()), T.StructField("spans", SPANS)])
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = column(batch, "text")
                hot = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, TRIGGER), False).to_numpy(zero_copy_only=False))
                done = found.redact(texts.take(pa.array(hot)).to_pylist())
                new = dict(zip(hot.tolist(), done))
                cols = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
                if any(s for _, s in done):
                    old = texts.to_pylist()
                    cols["text"] = pa.array([new[i][0] if i in new else t for i, t in enumerate(old)], texts.type)
                if extra:
                    null = texts.is_null().to_pylist()
                    spans = [None if null[i] else (new[i][1] if i in new else []) for i in range(len(texts))]
                    cols["n_redacted"] = pa.array([None if s is None else len(s) for s in spans], pa.int32())
                    cols["spans"] = pa.array(spans, span)
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(lean(run), schema)


def redact(docs: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """doc_id, text with <KIND> for each redacted span, n_redacted, and spans (places in the old text, in characters).

    A null text stays null, with null for n_redacted and spans; an empty one has
    none. Of overlapping spans the likeliest is redacted, then the longest, then the
    first. Any length of text is searched whole; repeated rows and equal or null
    doc_ids keep a row each; other columns are ignored; an empty table gives an
    empty one.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _redacted(base, model(base, bound), True)


def apply(docs: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """docs with redacted texts, and n_chars where there is one counted anew."""
    out = _redacted(docs, model(docs, bound), False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
