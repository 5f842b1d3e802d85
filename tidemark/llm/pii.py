"""Personal data by anchor expansion: an Aho-Corasick automaton finds cues, small parsers expand and check the spans.

Cues are at-signs, plus signs, digits, URL schemes and words that name an identifier. Everything else of a text is
passed over by the automaton alone. Kinds: email, ip, card, phone (the base), and beside them account (numbers that a
cue word names, valid IBANs with or without one, user parts of URLs) and secret (values that a cue word assigns).
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fresh, values

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "secret")
ACCOUNT_CUES = ("iban", "account", "acct", "passport", "ssn")
SECRET_CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api-key")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NUMBER = re.compile(r"(?:[ \t]*(?:no|number|nr|#|:|=|is)\.?)*[ \t]*([A-Za-z]{0,4}[0-9][A-Za-z0-9-]{5,33})(?![A-Za-z0-9])", re.ASCII | re.IGNORECASE)
ASSIGNED = re.compile(r"[ \t]*[=:][ \t]*[\"']?([A-Za-z0-9_/+.-]{8,})", re.ASCII)
USER = re.compile(r"([A-Za-z0-9._~%!$&'()*+,;=-]+:[A-Za-z0-9._~%!$&'()*+,;=-]+)@", re.ASCII)

#: Characters of an IBAN by country.
IBAN = {
    country: int(n)
    for n, own in (
        x.split(":")
        for x in (
            "15:NO 16:BE 18:DK,FO,FI,GL,NL,SD,FK 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK,MN 21:CH,HR,LI,LV "
            "22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG "
            "25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA "
            "30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
        ).split()
    )
    for country in own.split(",")
}
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for cue in ("@", "+", *"0123456789"):
        found.add_word(cue, (cue if cue in "@+" else "0", 1))
    found.add_word("://", ("://", 3))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def checked(s: str) -> bool:
    """The check digits of an IBAN without spaces."""
    moved = (s[4:] + s[:4]).upper()
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def iban(text: str, at: int) -> int:
    """The end of the valid IBAN that begins at a place, 0 if there is none.

    Single spaces are stepped over behind each fourth character, and elsewhere before a digit.
    """
    n = IBAN.get(text[at : at + 2].upper(), 0)
    if not n or at and text[at - 1].isalnum():
        return 0
    found, i = [], at
    while len(found) < n and i < len(text):
        if text[i] in ALNUM:
            found.append(text[i])
        elif text[i] != " " or text[i - 1] == " " or len(found) % 4 and not "0" <= text[i + 1 : i + 2] <= "9":
            return 0
        i += 1
    if len(found) < n or i < len(text) and text[i].isalnum():
        return 0
    s = "".join(found)
    return i if all("0" <= c <= "9" for c in s[2:4]) and checked(s) else 0


def valid_account(s: str) -> bool:
    """Six digits or more; what looks like an IBAN has to pass its check digits."""
    if re.fullmatch(r"[A-Za-z]{2}[0-9]{2}[A-Za-z0-9]{11,30}", s):
        return checked(s)
    return sum(c.isdigit() for c in s) >= 6


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), by start, of a whole text; positions are code points."""
    # the automaton reads ASCII letters as small ones; bytes are lowered, so that positions stay
    small = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    found, last = [], dict.fromkeys(range(len(KINDS)), 0)

    def digits(m: re.Match) -> str:
        return "".join(c for c in m[0] if "0" <= c <= "9")

    def take(kind: int, m: re.Match, good: bool) -> None:
        last[kind] = m.end()
        if good:
            found.append((m.start(), kind, m.end()))

    for end, (cue, n) in automaton().iter(small):
        at = end - n + 1
        if cue == "0":
            if at and "0" <= text[at - 1] <= "9":
                continue  # inside a run of digits; a match begins at its start or nowhere in it
            if at >= last[1] and (m := IP.match(text, at)):
                take(1, m, all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")))
            if at >= last[2] and (m := CARD.match(text, at)):
                d = digits(m)
                take(2, m, 12 <= len(d) <= 19 and luhn(d))
            if at - 2 >= last[4] and text[at - 1] in ALNUM and (stop := iban(text, at - 2)):
                last[4] = stop
                found.append((at - 2, 4, stop))
        elif cue == "+":
            if at >= last[3] and (m := PHONE.match(text, at)):
                take(3, m, 9 <= len(digits(m)) <= 15)
        elif cue == "@":
            start = at
            while start > last[0] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                last[0] = m.end()
                found.append((start, 0, m.end()))
        elif cue == "://":
            if m := USER.match(text, end + 1):
                take(4, _group(m), True)
        elif at >= last[kind := KINDS.index(cue)] and not (at and text[at - 1].isalnum()) and (m := (NUMBER if cue == "account" else ASSIGNED).match(text, end + 1)):
            if cue == "account" and (stop := iban(text, m.start(1))):
                last[kind] = stop
                found.append((m.start(1), kind, stop))
            else:
                take(kind, _group(m), cue == "secret" or valid_account(m[1]))
    return sorted(found)


class _group:
    """The first group of a match, seen as a match."""

    def __init__(self, m: re.Match):
        self.m = m

    def start(self) -> int:
        return self.m.start(1)

    def end(self) -> int:
        return self.m.end(1)


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each run of spans that touch or overlap replaced by its first kind in brackets."""
    out, at = [], 0
    for a, k, b in found:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if found else text


REPORT = T.StructType([*(T.StructField(f"n_{k}", T.LongType()) for k in BASE), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("clean", T.StringType())])


def _reports(with_text: bool):
    @F.arrow_udf(REPORT)
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for text in values(texts):
            text = text or ""
            found = spans(text)
            base = [x for x in found if x[1] < len(BASE)]
            counts = {f"n_{k}": sum(x[1] == i for x in base) for i, k in enumerate(BASE)}
            clean = redact(text, found) if with_text else None
            rows.append(counts | {"base_sha256": hashlib.sha256(_joined(base).encode()).hexdigest(), "spans": _joined(found), "clean": clean})
        kinds = [pa.int64()] * len(BASE) + [pa.string()] * 3
        return pa.StructArray.from_arrays([pa.array([r[f.name] for r in rows], kind) for f, kind in zip(REPORT.fields, kinds, strict=True)], names=REPORT.names)

    return run


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base counts, base_sha256 and all spans of each row's whole text. Null and empty texts have none."""
    found = docs.select(F.col(doc_id).alias("doc_id"), _reports(False)(F.col(text)).alias("r"))
    return found.select("doc_id", *(f"r.{n}" for n in REPORT.names if n != "clean"))


def redacted(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with personal data in text replaced by its kind in brackets, and n_chars counted anew; a null text stays."""
    (new,) = fresh(docs, "clean")
    found = docs.withColumn(new, F.when(F.col(text).isNotNull(), _reports(True)(F.col(text))["clean"]))
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col(new).alias(c))
        elif n_chars and c == n_chars:
            columns.append(F.coalesce(F.length(new).cast(docs.schema[c].dataType), F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return found.select(columns)
