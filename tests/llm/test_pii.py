import hashlib
import random
import re

from tests.llm.helpers import docs
from tidemark.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    good = {
        0: (EMAIL, lambda m: True),
        1: (IP, lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        2: (CARD, lambda m: 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))),
        3: (PHONE, lambda m: 9 <= len(digits(m)) <= 15),
    }
    return sorted((m.start(), k, m.end()) for k, (p, ok) in good.items() for m in p.finditer(text) if ok(m))


TEXTS = [
    None,
    "",
    "mail a.b+c@x-y.example.com, or b@c.de@f.gh and @no.pe and q@z and é😀 r@s.t.",
    "ip 1.2.3.4 1.2.3.4.5.6.7.8 999.1.1.1 10.0.0.255.3 01.002.0003.00000255",
    "card 4524132264652876 4524-1322-6465-2876 4524 1322 6465 2876 1 and 12",
    "call +1 (269) 555-3296 or +49 30 1234567 8 and ++12345 and +1-2-3",
    "password=b7db7aa4a5fcc78305 token = \"839756d1d951091d\" iban DE89370400440532013000 account no. 12345678 https://bob:pw1@host.org/x",
    "x" * 200_000 + "@a.b",
    "1" * 3000,
]
#: The plain expressions take quadratic time on this one; too many digits for a card, and nothing else to find.
LONG = "1" * 300_000


def test_base_spans_are_the_regular_expressions(spark):
    r = random.Random(4)
    alphabet = ["a", "B", "@", ".", "1", "2", "25", "+", "-", " ", "(", ")", "é", "4524132264652876", "İ", "%", "\n", "😀"]
    for text in [*(t or "" for t in TEXTS), *("".join(r.choice(alphabet) for _ in range(80)) for _ in range(4000))]:
        assert [x for x in pii.spans(text) if x[1] < 4] == base(text), repr(text)


def test_long_run_of_digits(spark):
    assert pii.spans(LONG) == []
    (row,) = pii.report(docs(spark, [LONG])).collect()
    assert [row[f"n_{k}"] for k in pii.BASE] == [0] * 4 and row.spans == ""
    assert pii.redacted(docs(spark, [LONG])).first().text == LONG


def test_report(spark):
    found = {r.doc_id: r for r in pii.report(docs(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        want = base(t or "")
        assert [found[i][f"n_{k}"] for k in pii.BASE] == [sum(x[1] == k for x in want) for k in range(4)]
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert found[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    text = TEXTS[6]
    more = [(k, text[int(a) : int(b)]) for k, a, b in (x.split(":") for x in found[6].spans.split(","))]
    assert {("secret", "b7db7aa4a5fcc78305"), ("secret", "839756d1d951091d"), ("account", "DE89370400440532013000"), ("account", "12345678"), ("account", "bob:pw1")} <= set(more)


def test_redaction_keeps_columns(spark):
    frame = docs(spark, TEXTS)
    rows = {r.doc_id: r for r in pii.redacted(frame).collect()}
    assert pii.redacted(frame).columns == frame.columns and len(rows) == len(TEXTS)
    assert rows[0].text is None and rows[5].text.startswith("call [PHONE] or [PHONE]") and rows[5].n_chars == len(rows[5].text)
    assert not any(pii.spans(r.text or "") for r in rows.values())
    assert pii.report(frame.limit(0)).collect() == []


def test_ibans_with_spaces_and_without_cue(spark):
    good = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "de89 37040044 0532013000", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606"]
    bad = ["DE88 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 0", "DE89  3704 0044 0532 0130 00", "xDE89370400440532013000", "DE893704004405320130001", "DE89", "ZZ89370400440532013000"]
    for before in ("", "iban ", "pay to ", "IBAN: ", "account no. "):
        for s in good:
            text = f"{before}{s} and more"
            assert [(text[a:b], k) for a, k, b in pii.spans(text) if k == 4] == [(s, 4)], text
    for s in bad:
        assert not [x for x in pii.spans(f"pay to {s} and more") if x[1] == 4], s
    text = "account DE893704 0044 0532 0130 00."
    assert pii.redact(text, pii.spans(text)) == "account [ACCOUNT]."
    clean = pii.redacted(docs(spark, ["send DE89 3704 0044 0532 0130 00, GB29NWBK60161331926819 now"])).first()
    assert clean.text == "send [ACCOUNT], [ACCOUNT] now" and clean.n_chars == len(clean.text)


def test_a_column_named_clean_stays(spark):
    frame = docs(spark, ["write to a.b@example.org now", None]).withColumnRenamed("fp", "clean").withColumnRenamed("rank", "_clean")
    rows = {r.doc_id: r for r in pii.redacted(frame).collect()}
    assert pii.redacted(frame).columns == frame.columns and all(r.clean == 1 and r["_clean"] == 3 for r in rows.values())
    assert "example" not in rows[0].text and rows[1].text is None
