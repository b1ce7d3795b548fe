"""Secret scans: base patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a run of token characters. For each character class that holds the whole candidate (hex, base-36,
base-64) a window slides over it; the entropy of the window's character counts is kept up to date by adding the
character that enters and taking off the one that leaves. Windows at or over the class's threshold join into a span.
Candidates on the allow list (identifiers, paths, plain words and numbers) are suppressed.

Defined results: null and empty texts have no span; every repeated row gets its spans; spans are code points, end
exclusive, and may overlap across kinds; spans that begin together are in the order of ``KINDS``. Texts of any length are
scanned whole. An empty table gives an empty one. An input column named ``secrets`` is replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from .common import map_text

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A maximal run of 16 or more is the same as a greedy match that has 16 or more.
HEX = re.compile(r"[0-9a-f]{16,}")
HINTS = ("passw", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

WINDOW = 20
#: Bits a character that a window must reach, by class; the most a window of 20 can have is 4.32.
THRESHOLDS = {"hex": 3.2, "alnum": 3.7, "base64": 3.85}
CLASSES = (("hex", re.compile(r"[0-9a-fA-F]+")), ("alnum", re.compile(r"[A-Za-z0-9]+")), ("base64", re.compile(r"[A-Za-z0-9+/_=-]+")))
ALLOW = (
    re.compile(r"[0-9]+"),  # plain numbers
    re.compile(r"[A-Za-z]+"),  # words
    re.compile(r"[A-Za-z]+([-_/=+]+[A-Za-z]*)*"),  # joined words and paths of words
    re.compile(r"[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),  # UUIDs
    re.compile(r"[-_=+/]*"),  # rules
    re.compile(r"[0-9]+([-_/=+]+[0-9]+)*"),  # dates and numbers in groups
)
ALLOW_WORDS = ("example", "placeholder", "changeme", "xxxxxxxx", "00000000", "12345678", "abcdefgh")
_PLOGP = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def entropy_windows(s: str, window: int = WINDOW) -> list[float]:
    """Entropy in bits of each window of ``s``, by counts kept up to date."""
    if len(s) < window:
        return []
    counts = Counter(s[:window])
    plogp = _PLOGP if window == WINDOW else [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    total, top = sum(plogp[c] for c in counts.values()), math.log2(window)
    out = [top - total / window]
    for i in range(window, len(s)):
        gone, new = s[i - window], s[i]
        if gone != new:
            total -= plogp[counts[gone]] - plogp[counts[gone] - 1]
            counts[gone] -= 1
            total += plogp[counts[new] + 1] - plogp[counts[new]]
            counts[new] += 1
        out.append(top - total / window)
    return out


def allowed(s: str) -> bool:
    if any(p.fullmatch(s) for p in ALLOW):
        return True
    low = s.lower()
    return any(w in low for w in ALLOW_WORDS)


def entropy_spans(text: str) -> list[tuple[int, int]]:
    found = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if allowed(s):
            continue
        kind = next(k for k, p in CLASSES if p.fullmatch(s))
        least, at, to = THRESHOLDS[kind], -1, -1
        for i, e in enumerate(entropy_windows(s)):
            if e >= least:
                if i > to and to >= 0:
                    found.append((m.start() + at, m.start() + to))
                    at = -1
                at = i if at < 0 else at
                to = i + WINDOW
        if at >= 0:
            found.append((m.start() + at, m.start() + to))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the three base kinds, by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def all_spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and these with the method's own; an entropy span inside a base span adds nothing and is left out."""
    if not text:
        return [], []
    base = base_spans(text)
    own, k, reach = [], 0, 0  # both lists go by start: reach is the furthest end of base spans that begin no later
    for a, b in entropy_spans(text):
        while k < len(base) and base[k][1] <= a:
            reach = max(reach, base[k][2])
            k += 1
        if reach < b:
            own.append(("entropy", a, b))
    return base, sorted(base + own, key=lambda x: (x[1], KINDS.index(x[0]))) if own else base


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) and secrets: array<struct<kind, start, stop>> of every whole text, base spans flagged."""

    def work(texts):
        out = []
        for t in texts:
            base, every = all_spans(t)
            own = set(base)
            out.append([{"kind": k, "start": a, "stop": b, "base": (k, a, b) in own} for k, a, b in every])
        return [out]

    return map_text(df, text, df.columns if keep is None else keep, "secrets array<struct<kind:string,start:int,stop:int,base:boolean>>", work)


def redact(text: str | None) -> str | None:
    """The text with each span, joined where spans overlap, replaced by a mark of the first span's kind. Null stays null."""
    if not text:
        return text
    out, at = [], 0
    for k, a, b in all_spans(text)[1]:
        if a >= at:
            out += [text[at:a], f"[{k} removed]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """The same columns, in the same order, with ``text`` redacted."""
    made = map_text(df, text, [c for c in df.columns if c != text], f"`{text}` string", lambda texts: [list(map(redact, texts))])
    return made.select(df.columns)


def base_digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
