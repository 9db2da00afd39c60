"""Personal data: regular expressions propose spans, checksums confirm them, and context words adjust their scores."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Kinds in the order in which spans of one start are listed; the first four are always kept, the others by score.
BASE = ("email", "ip", "card", "phone")
#: Characters on either side of a span in which context words count, and what one adds to the score or takes from it.
NEAR, CONTEXT = 40, 0.35
#: Words nearby that speak of other numbers, and so lower a score.
AGAINST = frozenset({"order", "invoice", "part", "version", "isbn", "serial", "model", "sku", "tracking", "article"})
#: Least score of a span of the added kinds.
LEAST = 0.6
KEPT = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))
SPANS = "array<struct<kind: string, start: long, end: long, score: double, base: boolean>>"


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(text: str) -> bool:
    """Whether the digits of ``text`` pass the Luhn checksum."""
    total = 0
    for i, c in enumerate(reversed(_digits(text))):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    """Whether an international account number passes the mod-97 checksum."""
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


#: Length of an international account number by country, as its public registry has them.
IBAN_LENGTHS = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 "
        "LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SD18 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}


@dataclass(frozen=True)
class Kind:
    """A pattern, what confirms its matches, a first score, and the words that raise it when nearby."""

    name: str
    pattern: re.Pattern
    confirm: Callable[[str], bool]
    score: float
    words: frozenset[str]


DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
IBAN_REST = {n: re.compile(rf"(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in {*IBAN_LENGTHS.values()}}
#: An address part begins where its run of digits begins: inside a run nothing can match that did not match before.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
KINDS = (
    Kind("email", DOMAIN, lambda s: True, 0.8, frozenset({"mail", "email", "contact", "write"})),
    Kind("ip", IP, lambda s: all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in s.split(".")), 0.6, frozenset({"ip", "host", "server", "address"})),
    Kind("card", re.compile(r"[0-9](?:[ -]?[0-9])+"), lambda s: 14 <= len(_digits(s)) <= 19 and luhn(s), 0.8, frozenset({"card", "visa", "credit", "pay", "payment"})),
    Kind("phone", re.compile(r"\+[0-9][ ().0-9-]+[0-9]"), lambda s: 10 <= len(_digits(s)) <= 15, 0.7, frozenset({"phone", "tel", "call", "mobile", "fax"})),
    Kind("iban", IBAN, mod97, 0.95, frozenset({"iban", "account", "bank", "konto", "compte", "cuenta"})),
    Kind("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), lambda s: s[:3] not in {"000", "666"} and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000", 0.3, frozenset({"ssn", "social", "security"})),
    Kind("national_phone", re.compile(r"(?<![0-9+(-])(?:\([0-9]{3}\) |[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])"), lambda s: True, 0.3, frozenset({"phone", "tel", "telephone", "call", "mobile", "fax"})),
)
ORDER = {k.name: i for i, k in enumerate(KINDS)}
WORD = re.compile(r"[^\W\d_]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[LOCAL]+@domain(.domain)+`` from the left, each sign looked at a bounded number of times."""
    done = 0
    at = text.find("@")
    while at >= 0:
        low = at
        while low > done and (text[low - 1].isascii() and (text[low - 1].isalnum() or text[low - 1] in "._%+-")):
            low -= 1
        found = DOMAIN.match(text, at) if low < at else None
        done = found.end() if found else at + 1
        if found:
            yield low, done
        at = text.find("@", done)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Stretches as long as an account number of the country that they begin with; words that follow don't belong to it."""
    for m in IBAN.finditer(text):
        size = IBAN_LENGTHS.get(m[0][:2])
        if size and (rest := IBAN_REST[size].match(text, m.end())):
            yield m.start(), rest.end()


def _score(kind: Kind, text: str, start: int, end: int) -> float:
    around = WORD.findall((text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower())
    return max(0.0, min(1.0, kind.score + CONTEXT * (any(w in kind.words for w in around) - any(w in AGAINST for w in around))))


def spans_of(text: str | None) -> list[dict]:
    """All spans of a text in code points, the end exclusive, by start and then by kind."""
    found: list[dict] = []
    if not text:
        return found
    has_digit = any(d in text for d in "0123456789")
    taken: bytearray | None = None
    for kind in KINDS:
        if kind.name == "email":
            matches = _emails(text)
        elif kind.name == "iban":
            matches = _ibans(text) if has_digit else iter(())
        else:
            matches = (m.span() for m in kind.pattern.finditer(text)) if has_digit else iter(())
        base = kind.name in BASE
        for start, end in matches:
            if not kind.confirm(text[start:end]):
                continue
            score = _score(kind, text, start, end)
            if not base:
                if score < LEAST:
                    continue
                if taken is None:
                    taken = bytearray(len(text))
                    for s in found:
                        taken[s["start"] : s["end"]] = b"\1" * (s["end"] - s["start"])
                if taken.find(1, start, end) >= 0:
                    continue
                taken[start:end] = b"\1" * (end - start)
            found.append({"kind": kind.name, "start": start, "end": end, "score": score, "base": base})
    return sorted(found, key=lambda s: (s["start"], ORDER[s["kind"]]))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every whole text; ``spans`` are structs (kind, start, end, score, base).

    Every confirmed match of a base kind stays, whatever its score; the added kinds need ``LEAST`` and lie outside
    earlier spans. A null or empty text has no spans. Repeated rows come back repeated, further columns are ignored,
    and an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = pa.array([spans_of(t) for t in batch.column(1).to_pylist()], KEPT)
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def masked(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first covers both."""
    if not text:
        return text
    out, done = [], 0
    for s in spans_of(text):
        if s["end"] <= done:
            continue
        if s["start"] >= done:
            out += [text[done : s["start"]], f"[{s['kind'].upper()}]"]
        done = s["end"]
    return "".join([*out, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``text`` masked, and ``n_chars``, where there is one, counted anew.

    Every row stays, repeated ones and those of a null doc_id too. A null text stays null, an empty one empty; whole
    texts of any length are read. Further columns stay as they were, and an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = pa.array([masked(t) for t in batch.column(at).to_pylist()], pa.string())
            yield batch.set_column(at, "text", texts)

    out = docs.withColumn("text", F.col("text").cast("string"))
    out = map_texts(out, run, out.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
