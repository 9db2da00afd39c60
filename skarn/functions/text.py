"""Text columns: words, identifiers, typed checks, dates, escapes and validators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layouts in which dates are read.
DATE_LAYOUTS = {
    "YYYY-MM-DD": ("^\\d{4}-\\d{2}-\\d{2}$", "yyyy-MM-dd"),
    "MM/DD/YYYY": ("^\\d{2}/\\d{2}/\\d{4}$", "MM/dd/yyyy"),
    "DD/MM/YYYY": ("^\\d{2}/\\d{2}/\\d{4}$", "dd/MM/yyyy"),
    "DD.MM.YYYY": ("^\\d{2}\\.\\d{2}\\.\\d{4}$", "dd.MM.yyyy"),
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text: str | Column) -> Column:
    """Runs of letters and digits, A-Z lower-cased."""
    return F.filter(F.split(F.translate(_c(text), UPPER, LOWER), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def matched_share(query: str, text: str | Column) -> Column:
    """Share of a query's words that the text, A-Z lower-cased, holds as substrings; 0 for a query without words."""
    asked = [w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split()]
    if not asked:
        return F.lit(0.0)
    low = F.translate(_c(text), UPPER, LOWER)
    return sum((F.when(F.contains(low, F.lit(w)), 1.0).otherwise(0.0) for w in asked), F.lit(0.0)) / len(asked)


def normal_doi(raw: str | Column) -> Column:
    """A DOI without scheme, host or prefix, in lower case; null if it does not begin with ``10.`` and have a suffix."""
    bare = F.regexp_replace(F.lower(F.trim(_c(raw))), "^(https?://)?((dx\\.)?doi\\.org/)?(doi:\\s*)?", "")
    return F.when(bare.rlike("^10\\.[^/]+/.+$"), bare)


def doi_prefix(doi: str | Column) -> Column:
    return F.substring_index(_c(doi), "/", 1)


def identity(*parts: str | Column) -> Column:
    """A stable identifier in UUID form from a kind and a key."""
    h = F.sha2(F.concat_ws("\x1f", *(_c(p) if isinstance(p, Column) else F.lit(p) for p in parts)), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def best_suggestion(value: str | Column, candidates: list[str], most: int = 2) -> Column:
    """The candidate within ``most`` edits of the lower-cased value, the nearest and first; else null."""
    v = F.lower(_c(value))
    told = F.array(*(F.struct(F.levenshtein(v, F.lit(c.lower())).alias("d"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(candidates)))
    best = F.array_min(told)
    return F.when(best["d"] <= most, best["c"])


def iso_date(value: str | Column, layouts: list[str] | None = None) -> Column:
    """The date of a text in ISO form: the one date that the layouts give; null if none or more than one does."""
    v = F.trim(_c(value))
    read = []
    for name in layouts or list(DATE_LAYOUTS):
        shape, layout = DATE_LAYOUTS[name]
        read.append(F.when(v.rlike(shape), F.date_format(F.try_to_timestamp(v, F.lit(layout)), "yyyy-MM-dd")))
    found = F.array_distinct(F.array_compact(F.array(*read)))
    return F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1)))


def is_type(kind: str, value: str | Column) -> Column:
    """Whether a text is a string, integer, decimal, (ISO) date or bool."""
    v = _c(value)
    return {
        "string": F.lit(True),
        "integer": v.rlike("^[+-]?\\d+$") & v.try_cast("bigint").isNotNull(),
        "decimal": v.rlike("^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$"),
        "date": iso_date(v, ["YYYY-MM-DD"]).isNotNull(),
        "bool": v.isin("true", "false"),
    }[kind]


def is_utc_timestamp(value: str | Column) -> Column:
    """ISO 8601 with seconds, in UTC (``Z``), on a day that exists."""
    v = _c(value)
    return v.rlike("^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?Z$") & F.try_to_timestamp(F.substring(v, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull()


def iso_millis(ms: str | Column) -> Column:
    return F.date_format(F.timestamp_millis(_c(ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def is_iri(value: str | Column) -> Column:
    return _c(value).rlike("^[A-Za-z][A-Za-z0-9+.-]*:[^\\s<>\"{}|\\\\^`]+$")


def is_uuid(value: str | Column) -> Column:
    return _c(value).rlike("^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def is_language_tag(value: str | Column) -> Column:
    """Well-formed by RFC 5646: language, script, region, variants, extensions and private use."""
    tag = "^(?i)(?:[a-z]{2,3}(?:-[a-z]{3}){0,3}|[a-z]{4}|[a-z]{5,8})(?:-[a-z]{4})?(?:-(?:[a-z]{2}|\\d{3}))?(?:-(?:[a-z0-9]{5,8}|\\d[a-z0-9]{3}))*(?:-[0-9a-wy-z](?:-[a-z0-9]{2,8})+)*(?:-x(?:-[a-z0-9]{1,8})+)?$|^(?i)x(?:-[a-z0-9]{1,8})+$"
    return _c(value).rlike(tag)


def is_duration(value: str | Column) -> Column:
    """ISO 8601 duration with at least one part; weeks stand alone."""
    return _c(value).rlike("^P(?:\\d+(?:\\.\\d+)?W|(?=\\d|T\\d)(?:\\d+(?:\\.\\d+)?Y)?(?:\\d+(?:\\.\\d+)?M)?(?:\\d+(?:\\.\\d+)?D)?(?:T(?=\\d)(?:\\d+(?:\\.\\d+)?H)?(?:\\d+(?:\\.\\d+)?M)?(?:\\d+(?:\\.\\d+)?S)?)?)$")


def language_value(map_json: str | Column, accept: str = "en") -> Column:
    """The value of a language map (JSON) for a tag: exact, then of the same language, then the first."""
    m = F.from_json(_c(map_json), "map<string,string>")
    entries = F.map_entries(m)
    want = accept.lower()
    exact = F.filter(entries, lambda e: F.lower(e["key"]) == want)
    near = F.filter(entries, lambda e: F.substring_index(F.lower(e["key"]), "-", 1) == want.split("-")[0])
    return F.try_element_at(F.concat(exact, near, entries), F.lit(1))["value"]


def csv_cell(value: str | Column) -> Column:
    """Quoted where it holds a comma, quote or line break."""
    v = _c(value).cast("string")
    return F.when(v.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(v, F.lit("")))


def tsv_cell(value: str | Column) -> Column:
    """Tabs and line breaks as blanks."""
    return F.regexp_replace(F.coalesce(_c(value).cast("string"), F.lit("")), "[\\t\\r\\n]+", " ")


def mime_of(head: str | Column) -> Column:
    """Media type by the first bytes of binary content."""
    signs = (("25504446", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("504B0304", "application/zip"), ("1F8B", "application/gzip"), ("49534F2D31303330332D3231", "model/step"), ("7B", "application/json"), ("5B", "application/json"), ("3C3F786D6C", "application/xml"))
    start = F.hex(F.substring(_c(head), 1, 16))
    found = F.lit("application/octet-stream")
    for sign, kind in reversed(signs):
        found = F.when(F.startswith(start, F.lit(sign)), kind).otherwise(found)
    return found
