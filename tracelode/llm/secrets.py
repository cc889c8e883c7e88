"""Secret scans: three fixed patterns, and entropy windows over candidate strings.

Candidates are maximal runs of token characters of one class (hexadecimal digits, letters and digits, base-64, letters of both
cases). A window slides over each; its Shannon entropy is kept by incremental counts. Where the highest window reaches the
class's threshold and no allow-list rule speaks for the string, a span of kind ``entropy`` is added. Where a string holds an
allowed word, its parts between separators are looked at by themselves. Allow-list rules only suppress added spans, never those
of the patterns.

Defined cases: a null or empty text has no spans; offsets are code points, ends exclusive; repeated rows have equal
spans; texts of any length are scanned whole; an empty table gives an empty one; extra columns pass through, one named
like the output is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import code_points, field, joined, lut, map_texts, only_cache, runs

# The kinds in the order in which spans of one start are listed, and the patterns of the first three.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST = {"assign": 12, "access": 18, "hex": 16}
HEX = b"0123456789abcdef"
TOKEN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Class of a candidate: length of its window, and the bits a character that make it random.
WINDOWS = {"hex": (24, 3.2), "alnum": (24, 3.9), "base64": (24, 4.0), "alpha": (24, 4.0)}
CANDIDATE = 20
# Strings that look random and are known not to be secrets, as a whole or where a part holds such a word.
ALLOWED = (
    r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    r"(?i)(https?|ftp|www)[/:._-].*",
    r"([A-Za-z]+[/_=-])+[A-Za-z]+",
)
WORDS_ALLOWED = r"example|sample|dummy|placeholder|changeme|xxxxxx|abcdefgh|01234567|12345678|qwerty"

TYPE = "array<struct<kind:string,start:int,end:int,entropy:double>>"

_assign, _access = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS)
_token, _hex, _digit = lut(TOKEN), lut(HEX), re.compile(r"[0-9]")
_part = re.compile(r"[A-Za-z0-9]+")
_alpha, _upper = re.compile(r"[A-Za-z]"), re.compile(r"[0-9a-fA-F]+\Z")


def window_entropy(s: str, width: int) -> float:
    """The highest Shannon entropy, in bits a character, of any window of ``width`` characters (or of all, if fewer)."""
    w = min(width, len(s))
    if w == 0:
        return 0.0
    part = [0.0, *(c * math.log2(c) for c in range(1, w + 1))]
    counts = Counter(s[:w])
    total = sum(part[c] for c in counts.values())
    least = total
    for out, new in zip(s, s[w:], strict=False):
        if out != new:
            c = counts[out]
            total += part[c - 1] - part[c]
            counts[out] = c - 1
            c = counts[new]
            total += part[c + 1] - part[c]
            counts[new] = c + 1
            least = min(least, total)
    return math.log2(w) - least / w


def classify(s: str) -> str | None:
    """The character class that sets window and threshold; None for digits alone, and for letters that are hardly of both cases."""
    if not _alpha.search(s):
        return None
    if not _digit.search(s):
        high = sum(map(str.isupper, s[1:]))
        return "alpha" if s.isalpha() and min(high, len(s) - 1 - high) >= 4 else None
    if _upper.match(s):
        return "hex"
    return "alnum" if s.isalnum() else "base64"


class Scanner:
    def __init__(self, windows: dict[str, tuple[int, float]], allowed: tuple[str, ...], candidate: int):
        self.windows, self.candidate = windows, candidate
        self.allowed = re.compile("|".join(f"(?:{x.replace('(?i)', '')})" for x in allowed), re.I) if allowed else None
        self.words = re.compile(WORDS_ALLOWED, re.I) if allowed else None

    def entropy(self, s: str) -> list[tuple[int, int, float]]:
        """The random stretches of a string: all of it, or those of its parts that hold no allowed word."""
        kind = classify(s)
        if kind is None and not (self.words and self.words.search(s)) or self.allowed and self.allowed.fullmatch(s):
            return []
        if self.words and self.words.search(s):
            parts = [m for m in _part.finditer(s) if self.candidate <= len(m[0]) < len(s)]
            return [(m.start() + a, m.start() + b, h) for m in parts for a, b, h in self.entropy(m[0])]
        width, least = self.windows[kind]
        h = window_entropy(s, width)
        return [(0, len(s), h)] if h >= least else []

    def scan(self, texts: list[str]) -> list[list[tuple[str, int, int, float | None]]]:
        data, starts, ends = joined(texts)
        raw = data.tobytes()
        found: list[list[tuple[str, int, int, float | None]]] = [[] for _ in texts]

        def holders(needles: tuple[bytes, ...], where: bytes) -> list[int]:
            out = set()
            for x in needles:
                at = where.find(x)
                while at >= 0:
                    i = int(np.searchsorted(ends, at))
                    out.add(i)
                    at = where.find(x, int(ends[i]))
            return sorted(out)

        for i in holders(ASSIGN_WORDS, raw.lower()):
            found[i] += [("assign", *m.span(), None) for m in _assign.finditer(texts[i]) if len(m[2]) >= LEAST["assign"]]
        for i in holders((b"AKIA",), raw):
            found[i] += [("access", *m.span(), None) for m in _access.finditer(texts[i]) if len(m[0]) >= LEAST["access"]]
        hits: dict[int, list[tuple[str, int, int]]] = {}
        for kind, mask, least in (("hex", _hex[data], LEAST["hex"]), ("entropy", _token[data], self.candidate)):
            a, b = runs(mask, least)
            for i, s, e in zip(np.searchsorted(ends, a).tolist(), a.tolist(), b.tolist(), strict=True):
                hits.setdefault(i, []).append((kind, s - int(starts[i]), e - int(starts[i])))
        for i, spans in hits.items():
            t = texts[i]
            if not t.isascii():
                flat = np.array(sorted({x for _, s, e in spans for x in (s, e)}))
                to = dict(zip(flat.tolist(), code_points(data[starts[i] : ends[i]], flat).tolist(), strict=True))
                spans = [(k, to[s], to[e]) for k, s, e in spans]
            for kind, s, e in spans:
                if kind == "hex":
                    found[i].append((kind, s, e, None))
                    continue
                for a, b, h in self.entropy(whole := t[s:e].strip("=-_/+")):
                    found[i].append((kind, s, e, h) if b - a == len(whole) else (kind, (x := t.index(whole, s)) + a, x + b, h))
        for x in found:
            x.sort(key=lambda y: (y[1], KINDS.index(y[0])))
        return found


def find_secrets(df: DataFrame, text_col: str = "text", out_col: str = "secrets", windows: dict | None = None, allowed: tuple[str, ...] = ALLOWED, candidate: int = CANDIDATE) -> DataFrame:
    """Add ``out_col``: the spans of each text by start, then kind as listed; ``entropy`` is set for added ones."""
    windows = windows or WINDOWS
    kind = field(out_col, TYPE)

    def make():
        from pyspark.sql.pandas.types import to_arrow_type

        only_cache("secrets")
        scanner, arrow = Scanner(windows, allowed, candidate), to_arrow_type(kind.dataType)

        def run(batch: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
            return [pa.array([[dict(zip(("kind", "start", "end", "entropy"), s, strict=True)) for s in x] for x in scanner.scan(texts)], arrow)]

        return run

    return map_texts(df, text_col, [kind], make)


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with each maximal stretch of overlapping spans replaced by ``mask``; spans ascend by start."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        seen = s["end"] <= acc["at"]
        overlap = (s["start"] < acc["at"]) & ~seen
        piece = F.concat(acc["out"], F.when(overlap, F.lit("")).otherwise(F.concat(text.substr(acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit(mask))))
        return F.when(seen, acc).otherwise(F.struct(s["end"].alias("at"), piece.alias("out")))

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) > 0, F.concat(done["out"], text.substr(done["at"] + 1, F.char_length(text)))).otherwise(text)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
