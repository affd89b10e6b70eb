"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, digits, plus signs, scheme separators and cues of accounts and
credentials. At an anchor a deterministic parser expands to the span's boundaries and validates it: address
labels, number ranges, Luhn and mod-97 sums, digit counts. Each kind keeps its own position, so spans of
one kind never overlap and a failed candidate is skipped whole. Texts without anchors cost the one pass.

Kinds: email, ip, card, phone; and url, iban, account, key, secret. Offsets are code points, ends exclusive.
Null and empty texts have no spans. Every row comes back, repeated ones too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, ids_and_texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account", "key", "secret")
_ORDER = {k: i for i, k in enumerate(KINDS)}

_AT, _DIGIT, _PLUS, _SCHEME, _ACCOUNT, _KEY, _SECRET = range(7)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+")
_HOST = re.compile(r"[^\s<>\"'|]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NUMBER = re.compile(r"[ \t]*(?:number|no\.?|nr\.?|id)?[ \t]*[:#=]?[ \t]*([A-Z]{0,3}[0-9][0-9 -]{4,30}[0-9])(?![A-Za-z0-9])", re.I)
_AWS = re.compile(r"AKIA[0-9A-Z]{16}(?![A-Za-z0-9])")
_VALUE = re.compile(r"[\"']?[ \t]*[=:][ \t]*[\"']?([^\s\"',;]{6,})")
_SCHEME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    cues = {"@": _AT, "+": _PLUS, "://": _SCHEME, "akia": _KEY} | dict.fromkeys("0123456789", _DIGIT)
    for word, kind in (("account", _ACCOUNT), ("acct", _ACCOUNT), ("passport", _ACCOUNT), ("ssn", _ACCOUNT), ("password", _SECRET), ("token", _SECRET), ("secret", _SECRET), ("api_key", _SECRET), ("apikey", _SECRET)):
        cues[word] = kind
    for word, kind in cues.items():
        machine.add_word(word, kind)
    machine.make_automaton()
    return machine


def _lowered(text: str) -> str:
    """``text`` with A-Z in lower case, every character where it was."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _luhn(digits: list[int]) -> bool:
    back = digits[::-1]
    return (sum(back[::2]) + sum(x * 2 - 9 * (x > 4) for x in back[1::2])) % 10 == 0


def _mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans of a text, by start and then kind."""
    found: list[tuple[int, int, str]] = []
    past = dict.fromkeys(KINDS, 0)

    def add(kind: str, start: int, end: int) -> None:
        found.append((start, end, kind))
        past[kind] = end

    for last, kind in anchors().iter(_lowered(text)):
        if kind == _DIGIT:
            if last >= past["ip"]:
                if m := _IP.match(text, last):
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups()):
                        add("ip", last, m.end())
                    past["ip"] = m.end()
                else:
                    past["ip"] = _DIGITS.match(text, last).end()
            if last >= past["card"] and (m := _CARD.match(text, last)):
                past["card"] = m.end()
                if 12 <= m.end() - last <= 37:
                    digits = [int(c) for c in m.group() if c.isdigit()]
                    if 12 <= len(digits) <= 19 and _luhn(digits):
                        add("card", last, m.end())
            if last - 2 >= past["iban"] and text[last - 2 : last].isupper() and (last < 3 or not text[last - 3].isalnum()) and (m := _IBAN.match(text, last - 2)) and _mod97(m.group()):
                add("iban", last - 2, m.end())
        elif kind == _AT:
            low = past["email"]
            start = last
            while start > low and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                add("email", start, m.end())
        elif kind == _PLUS:
            if last >= past["phone"] and (m := _PHONE.match(text, last)):
                run = m.group().rstrip(" ().-")
                if len(run) >= 4:
                    past["phone"] = last + len(run)
                    if 9 <= sum(c.isdigit() for c in run) <= 15:
                        add("phone", last, last + len(run))
        elif kind == _SCHEME:
            start = at = last - 2
            while start > past["url"] and text[start - 1] in _SCHEME_CHARS:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            if start < at and start >= past["url"] and (m := _HOST.match(text, last + 1)):
                add("url", start, last + 1 + len(m.group().rstrip(".,;:!?)]}")))
        elif kind == _ACCOUNT:
            if (m := _NUMBER.match(text, last + 1)) and m.start(1) >= past["account"]:
                add("account", *m.span(1))
        elif kind == _KEY:
            at = last - 3
            if (at == 0 or not text[at - 1].isalnum()) and (m := _AWS.match(text, at)):
                add("key", at, m.end())
        elif (m := _VALUE.match(text, last + 1)) and m.start(1) >= past["secret"]:
            add("secret", *m.span(1))
    found.sort(key=lambda s: (s[0], _ORDER[s[2]]))
    return found


def redact(text: str) -> str:
    """The text with each span replaced by its kind's mark; spans that overlap become the first one's."""
    out, at = [], 0
    for start, end, kind in spans(text):
        if start >= at:
            out += (text[at:start], f"[{kind.upper()}]")
        at = max(at, end)
    return "".join((*out, text[at:])) if out else text


def _joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


_EMPTY = hashlib.sha256(b"").hexdigest()


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, 1):
        counts: dict[str, list[int]] = {k: [] for k in BASE}
        digest, listed = [], []
        for text in batch.column(1).to_pylist():
            found = spans(text) if text else []
            base = [s for s in found if s[2] in counts] if found else found
            kinds = [s[2] for s in base]
            for k, n in counts.items():
                n.append(kinds.count(k))
            digest.append(hashlib.sha256(_joined(base).encode()).hexdigest() if base else _EMPTY)
            listed.append(_joined(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n, pa.int64()) for n in counts.values()), pa.array(digest, pa.string()), pa.array(listed, pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of ``docs``."""
    return ids_and_texts(docs).mapInArrow(_report, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _redacted(i: int, n: int):
    """Column i's texts redacted, and column n (if not -1) their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, i):
            texts = [t and redact(t) for t in batch.column(i).to_pylist()]
            out = batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))
            if n >= 0:
                length = [None if t is None else len(t) for t in texts]
                out = out.set_column(n, batch.schema.field(n), pa.array(length, batch.schema.field(n).type))
            yield out

    return run


def without_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with spans in ``text`` replaced and ``n_chars`` set anew; all other columns stay as they are."""
    n = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1
    return docs.mapInArrow(_redacted(docs.columns.index("text"), n), docs.schema)
