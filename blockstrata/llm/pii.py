r"""Personal data: patterns propose spans, checksums confirm them, context scores them.

Four base kinds (email, ip, card, phone) are leftmost, non-overlapping matches of
their pattern that pass their check; a match that fails is dropped and not tried
again from a later start. Further kinds come from the method: ``iban`` (mod-97, tried at
the country's length, then at each word end of a match from the last), ``ssn`` (needs a context word), ``secret`` (access keys and assigned passwords).
Offsets are code points, ends are exclusive.

Defined results: null and empty text have no spans; whole texts are scanned however
long, in time linear in their length; repeated rows give repeated results; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from blockstrata.llm.common import arrow_batches, id_text, map_rows, ship

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
#: Score of a span by its kind before context, after its checksum passed.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.35, "secret": 0.8}
#: What a context word adds, and the score from which a span of the method's own kinds counts.
CONTEXT_BONUS, ACCEPT = 0.25, 0.5
CONTEXT_CHARS = 40
CONTEXT = {
    "email": r"e-?mail|contact|write", "ip": r"\bip\b|address|host|server", "card": r"card|visa|credit|payment",
    "phone": r"phone|tel\b|call|mobile|fax", "iban": r"iban|account|bank|konto", "ssn": r"\bssn\b|social security|taxpayer",
    "secret": r"secret|token|key|password|credential",
}
_CONTEXT = {k: re.compile(v, re.I) for k, v in CONTEXT.items()}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can only begin where a run of digits begins: an earlier match ends with its run.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b")
#: Characters of an account number by country, as registered under ISO 13616.
_IBAN_SIZE = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH DE GB GE IE ME RS", 23: "AE GI IL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT",
}.items() for c in cs.split()}
_IBAN_WORD = re.compile(r"[A-Z0-9]++")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ACCESS_KEY = re.compile(r"AKIA[A-Z0-9]{16}\b")
_ASSIGNED = re.compile(r"(?i:password|passwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_.-]{8,})")
_ASSIGN_HINT = ("password", "passwd", "secret", "token", "key")
_NOT_DIGIT = re.compile(r"[^0-9]")
_ANY_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number passes the ISO 13616 check."""
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ibans(text: str):
    """Account numbers: from each start the word end of the country's length, else the last one, at which mod-97 passes."""
    at = 0
    while m := _IBAN.search(text, at):
        start, ends = m.start(), [w.end() for w in _IBAN_WORD.finditer(text, m.start(), m.end())]
        size = _IBAN_SIZE.get(text[start : start + 2])
        at = ends[0]
        for e in sorted(ends, key=lambda e: (len(text[start:e].replace(" ", "")) != size, -e)):
            if mod97(text[start:e]):
                yield start, e
                at = e
                break


def _octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) <= 3 and (not s or int(s) <= 255)


def emails(text: str):
    """Matches of the e-mail pattern, found from each at sign so that long runs cost once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the base kinds, in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if not _ANY_DIGIT.search(text):
        return out
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def spans(text: str | None) -> list[tuple[int, int, int, float]]:
    """(start, index of kind, end, score) of all kinds, by start and then kind."""
    if not text:
        return []
    found = base_spans(text)
    more: list[tuple[int, int, int]] = []
    if _ANY_DIGIT.search(text):
        more += [(s, 4, e) for s, e in ibans(text)]
        more += [(m.start(), 5, m.end()) for m in _SSN.finditer(text)]
    if "AKIA" in text:
        more += [(m.start(), 6, m.end()) for m in _ACCESS_KEY.finditer(text)]
    if ("=" in text or ":" in text) and any(w in low for low in (text.lower(),) for w in _ASSIGN_HINT):
        more += [(m.start(1), 6, m.end()) for m in _ASSIGNED.finditer(text)]
    out = []
    for s, k, e in found + more:
        near = text[max(0, s - CONTEXT_CHARS) : s] + " " + text[e : e + CONTEXT_CHARS]
        p = min(1.0, PRIOR[KINDS[k]] + CONTEXT_BONUS * bool(_CONTEXT[KINDS[k]].search(near)))
        if k < len(BASE) or p >= ACCEPT:
            out.append((s, k, e, p))
    return sorted(out)


def _said(rows) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in rows)


def mask(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlaps merge under the first."""
    found = spans(text)
    if not found:
        return text
    out, at = [], 0
    for s, k, e, _ in found:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """One row for each span: doc_id, kind, start, end, score."""
    def make():
        def run(ids, texts):
            rows = [(i, KINDS[k], s, e, p) for i, t in zip(ids, texts, strict=True) for s, k, e, p in spans(t)]
            return dict(zip(("doc_id", "kind", "start", "end", "score"), map(list, zip(*rows, strict=True)) if rows else ([], [], [], [], []), strict=True))

        return run

    return map_rows(id_text(docs), ["doc_id", "text"], "doc_id long, kind string, start long, end long, score double", make)


def summary(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, their digest and all spans, for each document."""

    def make():
        def run(ids, texts):
            cols = {"doc_id": ids, "n_email": [], "n_ip": [], "n_card": [], "n_phone": [], "base_sha256": [], "spans": []}
            for t in texts:
                got = spans(t)
                own = [r for r in got if r[1] < len(BASE)]
                for k, kind in enumerate(BASE):
                    cols[f"n_{kind}"].append(sum(r[1] == k for r in own))
                cols["base_sha256"].append(hashlib.sha256(_said(own).encode()).hexdigest())
                cols["spans"].append(_said(got))
            return cols

        return run

    return map_rows(id_text(docs), ["doc_id", "text"], "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", make)


def mask_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text`` and ``n_chars`` counted again, where there is such a column."""
    spark = docs.sparkSession
    ship(spark)
    arrow_batches(spark)
    names, schema = docs.columns, docs.schema

    def run(batches):
        for b in batches:
            cols = list(b.columns)
            masked = [mask(t) for t in cols[names.index("text")].to_pylist()]
            cols[names.index("text")] = pa.array(masked, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                cols[k] = pa.array([None if t is None else len(t) for t in masked], pa.int64()).cast(cols[k].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, schema)
