"""Personal data by anchor expansion.

One Aho-Corasick pass over the whole text finds anchors: at-signs, plus signs, digits, URL schemes and the cues of
identifiers. A local parser expands each anchor to the left and right and validates what it found. Parsers never
restart inside what they have consumed and use possessive patterns, so the time is linear in the text.

Kinds email, ip, card and phone are found exactly as leftmost, non-overlapping matches of their grammars. The
method adds three kinds: ``account`` (an identifier after a cue such as IBAN or account number), ``address`` (a URL
that carries user information, or a mailto link) and ``secret`` (a value with letters and digits that is assigned after
a cue such as password or token, a key with a known prefix, the head of a private key). Added spans never remove base spans.

Defined results: a null or empty text has no spans; offsets are code points, the end exclusive; repeated rows are
reported each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("account", "address", "secret")
KINDS = (*BASE_KINDS, *ADDED_KINDS)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Cues of account identifiers, as written in running text.
CUES = ("account number", "account no", "account", "acct", "iban", "konto", "kontonummer", "cuenta", "compte", "passport no", "passport", "ssn", "social security")
ACCOUNT = re.compile(r"(?:[\x20\t]*(?:number|no|nr|id)\b)?[\x20\t]*[.:#=]{0,2}[\x20\t]*([A-Za-z]{0,4}[0-9](?:[A-Za-z0-9]|[\x20-](?=[0-9]))+)", re.I)
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30}")
ADDRESS = re.compile(r"[^\s/?#@<>\"]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?")
MAILTO = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Cues of secrets that are assigned, and prefixes of keys with what follows them.
ASSIGNED = ("password", "passwd", "pwd", "passphrase", "token", "secret", "api_key", "api-key", "api key", "apikey", "access_key", "access key", "private_key", "credential")
PREFIXES = {"AKIA": r"[A-Z0-9]{16}", "ASIA": r"[A-Z0-9]{16}", "ghp_": r"[A-Za-z0-9]{36}", "github_pat_": r"[A-Za-z0-9_]{22,}", "sk_live_": r"[A-Za-z0-9]{16,}", "xoxb-": r"[A-Za-z0-9-]{20,}", "xoxp-": r"[A-Za-z0-9-]{20,}", "AIza": r"[A-Za-z0-9_-]{35}"}
PRIVATE = re.compile(r"(?:[A-Z]+ ){0,2}PRIVATE KEY-----")
VALUE = re.compile(r"(?:[_-]?(?:key|id|value))?[\"']?[\x20\t]*(?:=>|:=|[=:])[\x20\t]*[\"']?([A-Za-z0-9_.~+/$!%*-]{8,}+=*)")
KEYS = {prefix: re.compile(rest) for prefix, rest in PREFIXES.items()}


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(form, ("cue", len(form)))
    for form in ("mailto:", "Mailto:", "MAILTO:"):
        found.add_word(form, ("mailto", len(form)))
    for cue in ASSIGNED:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(form, ("assigned", len(form)))
    for prefix in PREFIXES:
        found.add_word(prefix, ("key", len(prefix)))
    found.add_word("-----BEGIN ", ("private", 11))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban_holds(raw: str) -> bool:
    s = raw.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def account_span(text: str, at: int) -> tuple[int, int] | None:
    """An identifier just after a cue that ends at ``at``: a valid IBAN, or 6 to 20 digits with few letters."""
    if at < len(text) and (text[at].isalpha() and text[at] != "s"):
        return None
    if not (m := ACCOUNT.match(text, at)):
        return None
    start = m.start(1)
    if b := IBAN.match(text, start):
        # The pattern may run into the next words; the longest valid part that ends at a word's end is the number.
        for end in range(b.end(), start + 14, -1):
            if (end == len(text) or not text[end].isalnum()) and text[end - 1] != " " and iban_holds(text[start:end]):
                return start, end
    digits = sum(c.isdigit() for c in m[1])
    if 6 <= digits <= 20 and sum(c.isalpha() for c in m[1]) <= 4:
        return start, m.end(1)
    return None


def secret_span(text: str, what: str, at: int, end: int) -> tuple[int, int] | None:
    """A secret at a cue text[at:end]: a key or the head of a private key with the cue, an assigned value without it."""
    if what == "private":
        return (at, m.end()) if (m := PRIVATE.match(text, end)) else None
    if at and (text[at - 1].isalnum() and what == "key"):
        return None
    if what == "key":
        m = KEYS[text[at:end]].match(text, end)
        return (at, m.end()) if m and not (m.end() < len(text) and text[m.end()].isalnum()) else None
    if (m := VALUE.match(text, end)) and any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1]):
        return m.start(1), m.end(1)
    return None


def spans(text: str, found) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = ip_end = card_end = account_end = address_end = secret_end = 0
    for last, (what, length) in found.iter(text):
        i = last - length + 1
        if what == "digit":
            if i >= ip_end:
                if m := IP.match(text, i):
                    ip_end = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split(".")):
                        out["ip"].append((i, ip_end))
                else:
                    ip_end = DIGITS.match(text, i).end()
            if i >= card_end and (m := CARD.match(text, i)):
                card_end = m.end()
                if card_end - i >= 16:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append((i, card_end))
        elif what == "at":
            start = i
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < i and (m := DOMAIN.match(text, i + 1)):
                email_end = m.end()
                out["email"].append((start, email_end))
        elif what == "plus":
            if m := PHONE.match(text, i):
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out["phone"].append((i, m.end()))
        elif what == "scheme":
            start = i
            while start > address_end and text[start - 1] in SCHEME:
                start -= 1
            if start < i and (m := ADDRESS.match(text, last + 1)):
                address_end = m.end()
                out["address"].append((start, address_end))
        elif what == "mailto":
            if i >= address_end and (m := MAILTO.match(text, last + 1)):
                address_end = m.end()
                out["address"].append((i, address_end))
        elif what in ("assigned", "key", "private"):
            if i >= secret_end and (got := secret_span(text, what, i, last + 1)):
                secret_end = got[1]
                out["secret"].append(got)
        elif i >= account_end and (i == 0 or not text[i - 1].isalnum()):
            if got := account_span(text, last + 1):
                account_end = got[1]
                out["account"].append(got)
    return out


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, " + ", ".join(f"n_{k} long" for k in ADDED_KINDS) + ", n_spans long"


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: key, the counts of the base kinds, their digest, all spans, the counts of the other kinds and of all."""
    one = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    kind = one.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        none = {k: [] for k in KINDS}
        for batch in batches:
            got = [spans(t, anchors) if t else none for t in batch.column(1).to_pylist()]
            cols = [batch.column(0)]
            cols += [pa.array([len(g[k]) for g in got], pa.int64()) for k in BASE_KINDS]
            cols += [pa.array([hashlib.sha256(joined(g, BASE_KINDS).encode()).hexdigest() for g in got], pa.string()), pa.array([joined(g, KINDS) for g in got], pa.string())]
            cols += [pa.array([len(g[k]) for g in got], pa.int64()) for k in ADDED_KINDS]
            cols += [pa.array([sum(map(len, g.values())) for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[key, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", *(f"n_{k}" for k in ADDED_KINDS), "n_spans"])

    return one.mapInArrow(work, f"`{key}` {kind}, {SCHEMA}")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


QUERIES = {"op2_pii": op2_pii}
ORACLES: dict[str, str] = {}
