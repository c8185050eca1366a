"""Personal data in whole texts.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97
for IBANs), and words nearby raise or lower a score. Spans of the base kinds (email,
ip, card, phone) stand by themselves; further kinds need their score.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "short_card", "local_phone", "secret")

#: letters before an @ are looked for backwards, since a search from each letter would take quadratic time
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*[0-9])[A-Za-z0-9_/+-]{16,}+={0,2}")
_OTHER_THAN_DIGITS = re.compile(r"[^0-9]+")


@dataclass(frozen=True)
class PiiRules:
    """Parameters: the score a further kind needs, how far context reaches (characters), scores, and context words by kind."""

    threshold: float = 0.6
    reach: int = 40
    raises: float = 0.4
    lowers: float = 0.4
    batch_rows: int = 256


#: Before context: how much a proposal and its checksum weigh.
_START = {"email": 1.0, "ip": 0.8, "card": 0.9, "phone": 0.8, "iban": 0.7, "short_card": 0.4, "local_phone": 0.4, "secret": 0.3}
_FOR = {
    "email": r"e-?mail|contact|write to|@",
    "ip": r"\bip\b|address|host|server",
    "card": r"card|visa|master|amex|credit|payment",
    "phone": r"phone|tel\b|tel[.:]|call|mobile|fax|whatsapp",
    "iban": r"iban|bank|account|konto|transfer",
    "short_card": r"card|visa|master|amex|credit|payment",
    "local_phone": r"phone|tel\b|tel[.:]|call|mobile|fax|whatsapp",
    "secret": r"token|secret|password|passwd|api[ _-]?key|credential|bearer",
}
_AGAINST = {"ip": r"version|release|section", "card": r"isbn|order|invoice|serial", "short_card": r"isbn|order|invoice|serial", "local_phone": r"isbn|order|invoice|serial", "secret": r"sha|md5|commit|checksum|hash|https?:"}
_FOR_PATTERNS = {k: re.compile(v, re.I) for k, v in _FOR.items()}
_AGAINST_PATTERNS = {k: re.compile(v, re.I) for k, v in _AGAINST.items()}


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN's digits, its first four characters moved to the end and letters as 10 to 35, leave 1."""
    rest = 0
    for c in iban[4:] + iban[:4]:
        value = int(c, 36)
        rest = (rest * (100 if value > 9 else 10) + value) % 97
    return rest == 1


Span = tuple[str, int, int, float]

_WORD = re.compile(r"[A-Z0-9]+")
#: after a word that is no IBAN the next one may start one
_IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Spans of IBANs: of each proposal the longest end at a word's border that mod 97 confirms."""
    at = 0
    while start := _IBAN_START.search(text, at):
        at = start.end()
        m = _IBAN.match(text, start.start())
        if not m:
            continue
        for end in sorted((w.end() for w in _WORD.finditer(text, m.start(), m.end())), reverse=True):
            iban = text[m.start() : end].replace(" ", "")
            if 15 <= len(iban) <= 34 and mod97(iban):
                yield m.start(), end
                at = end
                break


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _digits(text: str) -> str:
    return _OTHER_THAN_DIGITS.sub("", text)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the base kinds: leftmost, not overlapping within a kind, failing matches dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if "@" in text:
        out["email"] = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            out["ip"].append(m.span())
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                out["phone"].append(m.span())
    return out


def _score(kind: str, text: str, a: int, b: int, rules: PiiRules) -> float:
    near = text[max(0, a - rules.reach) : a] + " \n " + text[b : b + rules.reach // 2]
    score = _START[kind]
    if _FOR_PATTERNS[kind].search(near):
        score += rules.raises
    if kind in _AGAINST_PATTERNS and _AGAINST_PATTERNS[kind].search(near):
        score -= rules.lowers
    return min(1.0, max(0.0, score))


def _random_looking(word: str) -> bool:
    """Digits and letters mixed: at least three of each and as many changes between them."""
    kinds = [c.isdigit() for c in word]
    return sum(kinds) >= 3 and len(word) - sum(kinds) >= 3 and sum(x != y for x, y in zip(kinds, kinds[1:], strict=False)) >= 3


def _confirmed(pattern: re.Pattern, confirms: Callable[[str], bool]) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text) if confirms(m.group()))


_MORE: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {
    "iban": _ibans,
    "short_card": _confirmed(_DIGITS, lambda m: 13 <= len(d := _digits(m)) <= 15 and luhn(d)),
    "local_phone": _confirmed(_LOCAL_PHONE, lambda m: True),
    "secret": _confirmed(_SECRET, _random_looking),
}


def _union(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what `spans` cover, in order and apart."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def find(text: str, rules: PiiRules) -> list[Span]:
    """All spans (kind, start, end, score) by kind and start; characters, end exclusive.

    Spans of one kind don't overlap; base kinds may overlap each other, further kinds overlap nothing, the earlier kind
    first. A text of any length is searched whole, in time that grows with it and not with its square.
    """
    base = base_spans(text)
    out: list[Span] = [(k, a, b, _score(k, text, a, b, rules)) for k in BASE for a, b in base[k]]
    if not any(c in text for c in "0123456789"):
        return out
    taken = [(a, b) for _, a, b, _ in out]
    for kind, proposals in _MORE.items():
        starts, ends = _union(taken)
        fresh = []
        for a, b in proposals(text):
            k = bisect_right(ends, a)
            if k < len(starts) and starts[k] < b:
                continue
            if (score := _score(kind, text, a, b, rules)) >= rules.threshold:
                fresh.append((a, b))
                out.append((kind, a, b, score))
        taken += fresh
    return out


def redact(text: str, spans: list[Span]) -> str:
    """`text` with each span replaced by its kind in capitals; overlapping spans become the first one's."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _per_text(docs: DataFrame, columns: list[str], make, schema, rules: PiiRules) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rules.batch_rows):
                part = batch.slice(at, rules.batch_rows)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                yield make(part, texts, [find(t or "", rules) for t in texts])

    return docs.select(*columns).mapInArrow(each, schema)


def find_pii(docs: DataFrame, rules: PiiRules | None = None) -> DataFrame:
    """(doc_id, spans: array of kind, start, end, score) for each row of `docs` (doc_id, text). Null text has none."""

    def make(part: pa.RecordBatch, _: list, found: list[list[Span]]) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        spans = pa.array([[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in f] for f in found], kind)
        return pa.RecordBatch.from_arrays([part.column(0), spans], names=["doc_id", "spans"])

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _per_text(typed, ["doc_id", "text"], make, "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>", rules or PiiRules())


def redact_documents(docs: DataFrame, rules: PiiRules | None = None) -> DataFrame:
    """`docs` with its columns as they are, but text redacted and n_chars, where there is one, its new length. Null text stays null."""
    names = docs.columns

    def make(part: pa.RecordBatch, texts: list, found: list[list[Span]]) -> pa.RecordBatch:
        clean = [t if t is None or not f else redact(t, f) for t, f in zip(texts, found, strict=True)]
        arrays = list(part.columns)
        arrays[names.index("text")] = pa.array(clean, pa.string())
        if "n_chars" in names:
            at = names.index("n_chars")
            old = arrays[at].to_pylist()
            arrays[at] = pa.array([n if not f else len(c) for n, c, f in zip(old, clean, found, strict=True)], arrays[at].type)
        return pa.RecordBatch.from_arrays(arrays, names=names)

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    return _per_text(docs, names, make, schema, rules or PiiRules())


def digests(docs: DataFrame, rules: PiiRules | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of `find_pii`'s spans, made in SQL, for each row of `docs`.

    Null text has no spans. Rows that repeat, or share a doc_id, are judged each by its own text. Other columns are
    not looked at. An empty table gives no rows.
    """
    found = find_pii(docs, rules)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    base = of(*BASE)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
