"""Names as keys and for display. Accents are folded in the JVM, by a table made from Unicode."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Latin letters with marks and the letters they stand on."""
    source, target = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFKD", chr(code).casefold())
        base = "".join(c for c in base if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base != chr(code):
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


def folded(text: Column) -> Column:
    """Lower case without accents; the sharp s becomes ss and loose combining marks go."""
    plain = F.translate(F.lower(F.replace(F.replace(text, F.lit("ß"), F.lit("ss")), F.lit("ẞ"), F.lit("ss"))), *_accents())
    return F.regexp_replace(plain, r"\p{M}+", "")


def name_key(name: Column, kind: Column | None = None) -> Column:
    """Key of a place name: folded letters and digits, mt for mount, without the words of its own kind."""
    text = F.trim(F.regexp_replace(folded(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " "))
    text = F.regexp_replace(text, r"\bmt\b", "mount")
    text = F.regexp_replace(text, r"\bcamp ground\b", "campground")
    if kind is not None:
        text = (
            F.when(kind == "campground", F.regexp_replace(text, r"\s+(?:campground|camp\s+ground)$", ""))
            .when(kind == "trailhead", F.regexp_replace(text, r"\s+trail\s*head$", ""))
            .when(kind == "visitor_center", F.regexp_replace(text, r"\s+visitor\s+cent(?:er|re)$", ""))
            .otherwise(text)
        )
    return F.replace(text, F.lit(" "), F.lit(""))


def plain_name(name: Column) -> Column:
    """Folded letters and digits only."""
    return F.regexp_replace(folded(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "")


def trail_name(name: Column) -> Column:
    """Key of a trail or road name: ASCII, long forms of its words, without the words for its kind."""
    text = F.lower(F.regexp_replace(F.translate(F.lower(F.coalesce(name, F.lit(""))), *_accents()), r"[^\x00-\x7f]", ""))
    for short, long in (("mt", "mount"), ("mtn", "mountain"), ("blvd", "boulevard"), ("sp", "spur"), ("hwy", "highway")):
        text = F.regexp_replace(text, rf"\b{short}\b", long)
    return F.regexp_replace(F.regexp_replace(text, r"\b(trail|trl|road|rd)\b", ""), "[^a-z0-9]", "")


# Words that stay in capitals.
CAPITALS = ("PCT", "TRT", "JMT", "CDT", "AT", "US", "USFS", "NPS", "FS", "FR", "NF", "NFSR", "SR", "CR", "OHV", "ATV", "II", "III", "IV")


def display_name(name: Column) -> Column:
    """A name all in capitals in title case, but for acronyms, single letters and words with digits."""
    word = lambda w: (
        F.when(w == "CG", "Campground")
        .when(w.isin(*CAPITALS) | w.rlike("[0-9]") | (F.length(w) == 1), w)
        .otherwise(F.array_join(F.transform(F.split(w, "'"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))), "'"))
    )
    # Words and what lies between them, in turn.
    pieces = F.regexp_extract_all(name, F.lit(r"([A-Z0-9]+(?:'[A-Z]+)?|[^A-Z0-9]+)"), 1)
    titled = F.array_join(F.transform(pieces, lambda w: F.when(w.rlike("^[A-Z0-9]"), word(w)).otherwise(w)), "")
    return F.when((name == F.upper(name)) & name.rlike("[A-Z]"), titled).otherwise(F.coalesce(name, F.lit("")))


# Character entities that source texts use.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def clean_text(text: Column, limit: int = 1000) -> Column:
    """Without tags, entities resolved, white space collapsed, cut to a length."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.left(F.trim(F.regexp_replace(out, r"\s+", " ")), F.lit(limit))


def active_flag(value: Column) -> Column:
    """Whether a tag says yes: '', no, false, 0, none and null do not."""
    return F.coalesce(~F.lower(F.trim(value)).isin("", "no", "false", "0", "none"), F.lit(False))


def road_refs(ref: Column) -> Column:
    """The set of road numbers in a reference list, without forest-road prefixes; those with a digit."""
    parts = F.transform(F.split(F.upper(F.coalesce(ref, F.lit(""))), ";"), lambda v: F.regexp_replace(F.trim(v), r"^(?:NFSR|NF|FR|FS)\s*[- ]?\s*(?=[0-9])", ""))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda v: v.rlike("[0-9]"))))


# Long-distance routes by their short names.
ROUTES = (
    ("PCT", "Pacific Crest Trail"), ("AT", "Appalachian Trail"), ("CDT", "Continental Divide Trail"), ("JMT", "John Muir Trail"),
    ("TRT", "Tahoe Rim Trail"), ("PNT", "Pacific Northwest Trail"), ("AZT", "Arizona Trail"), ("FT", "Florida Trail"),
    ("IAT", "Ice Age Trail"), ("NCT", "North Country Trail"), ("NET", "New England Trail"), ("PHT", "Potomac Heritage Trail"),
    ("NTT", "Natchez Trace Trail"),
)


def route_ref(name: Column) -> Column:
    """Short name of the long-distance route that a trail name is of; '' for spurs, accesses and others."""
    upper = F.upper(F.coalesce(name, F.lit("")))
    out = F.when(upper.rlike(r"\b(SPUR|CONNECTOR|ACCESS|APPROACH)\b"), "")
    for ref, full in ROUTES:
        hit = upper.contains(full.upper().removesuffix(" TRAIL"))
        out = out.when(hit | upper.rlike(rf"^{ref}(\s|$)") if len(ref) >= 3 else hit, ref)
    return out.otherwise("")
