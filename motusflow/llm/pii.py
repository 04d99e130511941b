"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Kinds and patterns (fixed values): email, ip (parts at most 255), card (16 to 19 digits that pass Luhn), phone (a plus sign, 8
to 15 digits), found leftmost and without overlap for each kind; a match that fails its test is dropped, not retried. These
base spans always stay. The method adds IBANs (mod 97) and local phone numbers; the latter need a word such as "phone" nearby
to reach the score; context words count as whole words. Positions are code points, ends exclusive.

Every kind is found in time proportional to the text: a run in which one start fails is left as a whole, as every other start in
it fails for the same reason.

Defined cases: a null or empty text has no spans; equal rows are handled one by one; texts of any length are read whole;
other columns are not read by ``spans`` and pass through ``redacted``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "phone_local")
#: The parts of the patterns. An email's part before the sign is a run of LOCAL; an ip is four members of a chain of numbers.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
NUMBER = re.compile(r"[0-9]+")
PATTERNS = {
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "phone_local": re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
}
#: What a pattern is worth by itself, once its checksum has confirmed it, and what a context word nearby adds.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.95, "phone_local": 0.35}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "server", "host", "address"),
    "card": ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "telephone", "tel", "call", "mobile", "cell", "fax", "telefon", "llamar"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "phone_local": ("phone", "telephone", "tel", "call", "mobile", "cell", "fax", "telefon", "llamar"),
}
NEAR, BOOST, ACCEPT = 40, 0.3, 0.5
_NEARBY = {k: re.compile(rf"(?<!\w)(?:{'|'.join(w)})(?!\w)", re.IGNORECASE) for k, w in CONTEXT.items()}
_DIGITS = re.compile(r"[0-9]{2}|[0-9][\x20-][0-9]|[0-9]\.[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")  # free: where the next match may begin
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    chain: list[tuple[int, int]] = []
    for m in NUMBER.finditer(text):
        a, z = m.span()
        if chain and not (a == chain[-1][1] + 1 and text[a - 1] == "."):
            chain = []
        chain.append((a, z))
        if len(chain) == 4:
            yield chain[0][0], z
            chain = []


def _proposed(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches without overlap."""
    if kind == "email":
        return _emails(text)
    return _ips(text) if kind == "ip" else (m.span() for m in PATTERNS[kind].finditer(text))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    held = iban.replace(" ", "")
    return 15 <= len(held) <= 34 and int("".join(str(int(c, 36)) for c in held[4:] + held[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _confirmed(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in found.split(".")))
    if kind == "card":
        d = _digits(found)
        return 16 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(_digits(found)) <= 15
    return kind != "iban" or mod_97(found)


def _score(kind: str, text: str, start: int, end: int) -> float:
    last = min(len(text), end + NEAR)
    while last < len(text) and last < end + 2 * NEAR and text[last].isalnum():  # no word is cut
        last += 1
    near = _NEARBY[kind].search(text, max(0, start - NEAR), start) or _NEARBY[kind].search(text, end, last)
    return min(1.0, SCORES[kind] + BOOST * (near is not None))


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for a, z in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], z)
        else:
            starts.append(a)
            ends.append(z)
    return starts, ends


def found(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed, then start."""
    text = text or ""
    out: list[tuple[str, int, int, float]] = []
    digits = _DIGITS.search(text) is not None
    ready = {"email": "@" in text, "ip": digits, "card": digits, "phone": "+" in text and re.search(r"[0-9]", text) is not None, "iban": digits, "phone_local": digits}
    for kind in KINDS:
        if not ready[kind]:
            continue
        starts, ends = _merged([(a, z) for _, a, z, _ in out]) if kind not in BASE else ([], [])
        for a, z in _proposed(kind, text):
            before = bisect_right(starts, z - 1) - 1  # the last covered stretch that begins before the end
            if before >= 0 and ends[before] > a or not _confirmed(kind, text[a:z]):
                continue
            score = _score(kind, text, a, z)
            if kind in BASE or score >= ACCEPT:
                out.append((kind, a, z, round(score, 2)))
    return out


def _listed(spans: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z, _ in spans)


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"


def spans(docs: DataFrame) -> DataFrame:
    """A row a document: counts of the base kinds, the digest of the base spans, all spans, and their scores."""

    def run(frames):
        for b in batches(frames):
            all_ = [found(t) for t in b.column("text").to_pylist()]
            base = [[s for s in one if s[0] in BASE] for one in all_]
            cols = [pa.array([sum(s[0] == k for s in one) for one in base], pa.int64()) for k in BASE]
            digest = pa.array([hashlib.sha256(_listed(one).encode()).hexdigest() for one in base], pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *cols, digest, pa.array([_listed(one) for one in all_], pa.string()), pa.array([",".join(f"{s[3]:g}" for s in one) for one in all_], pa.string())],
                names=[x.split()[0] for x in OUT.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


def redact(text: str | None) -> str | None:
    """Every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    if not text or not (all_ := found(text)):
        return text
    out, last, end = [], 0, 0
    for a, z, kind in sorted((a, z, k) for k, a, z, _ in all_):
        if a < end:
            if z > end:
                last = end = z
            continue
        out += [text[last:a], f"<{kind.split('_')[0].upper()}>"]
        last = end = z
    return "".join([*out, text[last:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; ``n_chars``, if there is such a column, counts the new text."""
    schema = docs.schema

    def run(frames):
        for b in batches(frames):
            new = [redact(t) for t in b.column("text").to_pylist()]
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            cols["text"] = pa.array(new, b.schema.field("text").type)
            if "n_chars" in cols:
                kind = b.schema.field("n_chars").type
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(kind)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(run, schema)
