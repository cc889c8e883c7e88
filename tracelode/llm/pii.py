"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, schemes and identifier cues. A deterministic
parser for each kind of anchor expands it to the boundaries of an email address, a number, a web address or an account
and validates it. ``url`` and ``account`` are the kinds that the method adds.

Defined cases: a null or empty text has no spans; offsets are code points, ends exclusive; repeated rows have equal spans;
texts of any length are scanned whole, in time proportional to it; an empty table gives an empty one; extra columns pass
through, one named like the output is replaced.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import field, map_texts

# The kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "url", "account")
# Anchors of the added kinds.
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "mailto:", "tel:")
CUES = ("account", "acct", "iban", "customer id", "user id", "passport", "ssn", "tax id", "konto", "compte", "cuenta")

TYPE = "array<struct<kind:string,start:int,end:int>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_run = re.compile(r"[0-9]+")
_phone = re.compile(r"[0-9][\x20().0-9-]+")
_url = re.compile(r"[^\s<>\"'`{}|\\^]+")
_host = re.compile(r"(?:[A-Za-z0-9_.~%+-]+(?::[^@/]*)?@)?(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?::[0-9]{1,5})?(?:[/?#].*)?", re.S)
_scheme = re.compile("|".join(SCHEMES), re.I | re.A)
#: More groups than an account may have characters are not read.
_account = re.compile(r"(?:\s{0,4}(?i:number|no|nr|num|id))?[.:#=\s]{0,4}([A-Z]{0,4}[0-9][A-Za-z0-9]*(?:[\x20-][A-Za-z0-9]*[0-9][A-Za-z0-9]*){0,35})")
_iban = re.compile(r"(?:\s{0,4}(?i:number|no|nr))?[.:#=\s]{0,4}([A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]){11,30})")
_word = re.compile(r"\w")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def iban_reach(value: str) -> int:
    """Characters of the longest start of ``value`` whose check digits hold, 0 where none do: the remainders of all starts in one pass."""
    head, rest, n, best = "", 0, 0, 0
    for i, c in enumerate(value):
        if c in " -":
            continue
        n += 1
        digits = str(int(c, 36))
        if n <= 4:
            head += digits
            continue
        rest = (rest * 10 ** len(digits) + int(digits)) % 97
        if n >= 15 and (rest * 10 ** len(head) + int(head)) % 97 == 1:
            best = i + 1
    return best


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for x in SCHEMES:
        a.add_word(x, ("scheme", len(x)))
    for x in CUES:
        a.add_word(x, ("cue", len(x)))
    a.make_automaton()
    return a


#: A to Z in lower case, where the whole text's lower case would be longer.
_fold = {c: c + 32 for c in range(65, 91)}


class Finder:
    def __init__(self):
        self.anchors = automaton()

    def find(self, text: str) -> list[tuple[str, int, int]]:
        out: list[tuple[str, int, int]] = []
        n = len(text)
        email = ip = card = phone = url = account = 0  # where the last match of the kind ended, or a failed one may be skipped to
        failed = 0  # where the last stretch ended that is no web address; within it, each scheme reaches to the next one only
        lower = text.lower()
        if len(lower) != n:
            lower = text.translate(_fold)
        for last, (kind, size) in self.anchors.iter(lower):
            at = last + 1 - size
            if kind == "digit":
                if at >= ip:
                    if m := _ip.match(text, at):
                        ip = m.end()
                        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                            out.append(("ip", at, ip))
                    else:
                        ip = _run.match(text, at).end()
                if at >= card:
                    if m := _card.match(text, at):
                        card = m.end()
                        if 14 <= card - at <= 37 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                            out.append(("card", at, card))
                    else:
                        card = at + 1
            elif kind == "at":
                start = at
                while start > email and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _domain.match(text, at + 1)):
                    email = m.end()
                    out.append(("email", start, email))
            elif kind == "plus":
                if at >= phone and (m := _phone.match(text, at + 1)):
                    body = m[0].rstrip(" ().-")
                    if len(body) >= 3:
                        phone = at + 1 + len(body)
                        if 10 <= sum(map(str.isdigit, body)) <= 15:
                            out.append(("phone", at, phone))
            elif kind == "scheme":
                if at >= url and not (at and _word.match(text[at - 1])) and (m := _url.match(text, last + 1, self._reach(text, last + 1, failed))):
                    body = m[0].rstrip(".,;:!?)]")
                    if _host.fullmatch(body) or lower.startswith("tel:", at) and sum(map(str.isdigit, body)) >= 5:
                        url = last + 1 + len(body)
                        out.append(("url", at, url))
                    else:
                        failed = max(failed, m.end())
            elif at >= account and not (at and _word.match(text[at - 1])):
                if lower.startswith("iban", at) and (m := _iban.match(text, last + 1)):
                    if reach := iban_reach(m[1]):
                        account = m.start(1) + reach
                        out.append(("account", m.start(1), account))
                elif m := _account.match(text, last + 1):
                    value = re.sub(r"[\x20-]", "", m[1])
                    if 4 <= sum(map(str.isdigit, value)) and 6 <= len(value) <= 34:
                        account = m.end(1)
                        out.append(("account", m.start(1), account))
        out.sort(key=lambda x: (x[1], KINDS.index(x[0])))
        return out

    @staticmethod
    def _reach(text: str, at: int, failed: int) -> int:
        """How far a web address that begins at ``at`` may reach."""
        if at >= failed:
            return len(text)
        m = _scheme.search(text, at, failed)
        return m.start() if m else failed


def find_personal(df: DataFrame, text_col: str = "text", out_col: str = "personal") -> DataFrame:
    """Add ``out_col``: the spans of each text by start, then kind as listed."""
    kind = field(out_col, TYPE)

    def make():
        from pyspark.sql.pandas.types import to_arrow_type

        finder, arrow = Finder(), to_arrow_type(kind.dataType)

        def run(batch: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
            return [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in finder.find(t)] for t in texts], arrow)]

        return run

    return map_texts(df, text_col, [kind], make)
