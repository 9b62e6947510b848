"""Personal data by anchor expansion.

An Aho-Corasick automaton walks each whole text once and stops at anchors: at-signs,
plus signs, digits, schemes (``https://``, ``mailto:`` ...) and identifier cues (``iban``,
``account`` ...).  From each anchor a deterministic local parser expands to the
boundaries of the item and checks it.

Base kinds, each leftmost and non-overlapping: email, ip, card, phone.  A parser first
takes what the kind's pattern matches and then drops it if the check fails, without
another try inside it.  Added kinds: ``url`` (a scheme and what follows up to white space,
quotes or brackets; user data in front of a host stays inside), ``mail`` (``mailto:``),
``account`` (an identifier after its cue, 6 to 34 letters and digits with a digit among
them; an IBAN must pass its checksum).  Spans are in code points, end exclusive.

Defined cases: null text has no spans; texts are read whole.  Spans of different kinds
may overlap, as each kind is on its own; redaction replaces the union of overlapping spans once, under
the kind that starts first (then the longer one), and leaves a ``url`` without user data (an at-sign) as it is.  Rows are independent, so repeated
rows repeat their result; other columns are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tillsight.llm.batches import bounded_batches

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "mail", "account")
KINDS = BASE + ADDED
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
MAILTO = "mailto:"
CUES = ("iban", "account", "acct", "ssn", "passport", "konto", "compte", "cuenta")
SPANS = "array<struct<kind:string,start:int,end:int>>"

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL = re.compile(r"[a-z]+://[^\s\"'<>()\[\]{}]+", re.I)
ADDRESSES = re.compile(r"[^\s\"'<>()\[\]{}?]*+")
ACCOUNT = re.compile(r"(?:[ ](?:no\.?|number|nr\.?))?[ ]*+(?:[:#=][ ]*+)?([A-Z0-9](?:[ -]?[A-Z0-9]){5,33})(?![A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban_checks(code: str) -> bool:
    moved = code[4:] + code[:4]
    return code[:2].isalpha() and code[2:4].isdigit() and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


class Anchors:
    """Text -> spans.  Built once per Python worker."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for mark, what in (("@", "@"), ("+", "+"), *((d, "0") for d in "0123456789")):
            self.automaton.add_word(mark, (what, 1))
        for words, what in ((SCHEMES, "url"), ((MAILTO,), "mail"), (CUES, "cue")):
            for w in words:
                for form in {w, w.upper(), w.capitalize()}:
                    self.automaton.add_word(form, (what, len(w)))
        self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[str, int, int]]:
        if not text:
            return []
        out: list[tuple[str, int, int]] = []
        email_end = phone_end = chain_end = quad_end = url_end = mail_end = 0
        for at, (what, n) in self.automaton.iter(text):
            if what == "0":
                if at >= chain_end:
                    m = CHAIN.match(text, at)
                    if m:
                        chain_end = m.end()
                        digits = m.group().replace(" ", "").replace("-", "")
                        if 16 <= len(digits) <= 19 and luhn(digits):
                            out.append(("card", at, m.end()))
                    else:
                        chain_end = at + 1
                if at >= quad_end:
                    m = QUAD.match(text, at)
                    if m:
                        quad_end = m.end()
                        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                            out.append(("ip", at, m.end()))
                    else:
                        quad_end = DIGITS.match(text, at).end()
            elif what == "@":
                start = at
                while start > email_end and text[start - 1] in LOCAL_CHARS:
                    start -= 1
                m = DOMAIN.match(text, at + 1) if start < at else None
                if m:
                    email_end = m.end()
                    out.append(("email", start, email_end))
            elif what == "+":
                m = PHONE.match(text, at) if at >= phone_end else None
                if m:
                    phone_end = m.end()
                    if 8 <= sum(map(str.isdigit, m.group())) <= 15:
                        out.append(("phone", at, phone_end))
            elif what == "url":
                start = at + 1 - n
                m = URL.match(text, start) if start >= url_end and (start == 0 or not text[start - 1].isalnum()) else None
                if m:
                    url_end = start + len(m.group().rstrip(".,;:!?"))
                    if url_end > at + 1:
                        out.append(("url", start, url_end))
            elif what == "mail":
                if at + 1 - n >= mail_end:  # what follows is read once, whether an address is in it or not
                    mail_end = ADDRESSES.match(text, at + 1).end()
                    if text.find("@", at + 2, mail_end - 1) > 0:
                        out.append(("mail", at + 1 - n, mail_end))
            else:
                start = at + 1 - n
                if (start == 0 or not text[start - 1].isalnum()) and (m := ACCOUNT.match(text, at + 1)):
                    code = m.group(1).replace(" ", "").replace("-", "")
                    if any(c.isdigit() for c in code) and (text[start : at + 1].lower() != "iban" or iban_checks(code)):
                        out.append(("account", m.start(1), m.end(1)))
        return out


def spans_column(text: Column) -> Column:
    """``text`` -> array of (kind, start, end), kinds in their order, then by start."""

    @arrow_udf(SPANS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of, order = Anchors(), {k: i for i, k in enumerate(KINDS)}
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for texts in batches:
            found = [sorted(of(t), key=lambda s: (order[s[0]], s[1])) for t in (t.as_py() for t in texts)]
            yield pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found], pa.list_(kind))

    bounded_batches()
    return find(text)


def redacted_column(text: Column) -> Column:
    """``text`` with each union of overlapping spans replaced by its kind in brackets."""

    @arrow_udf("string")
    def redact(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = Anchors()
        for texts in batches:
            yield pa.array([redact_text(t, of(t)) for t in (t.as_py() for t in texts)], pa.string())

    bounded_batches()
    return redact(text)


def redact_text(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    spans = [s for s in spans if s[0] != "url" or "@" in text[s[1] : s[2]]]
    if not spans:
        return text
    out, done, end = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= end:  # starts a new union; what the last one covered is left out
            out += [text[max(done, 0) : a], f"[{kind.upper()}]"]
            end = done = b
        else:
            end = done = max(end, b)
    return "".join([*out, text[done:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``spans``."""
    return docs.select(F.col(id_col), spans_column(F.col(text_col)).alias("spans"))


def written(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, digest of the base spans, and all spans as text."""
    base = F.filter(F.col("spans"), lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter(F.col("spans"), lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, *[count(k) for k in BASE], F.sha2(written(base), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))
