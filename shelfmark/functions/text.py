"""Text functions of the catalogue as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that searches treat as their plain form, and those forms.
ACCENTED = "éèêëÉÈÊËàáâäÀÁÂÄìíîïÌÍÎÏòóôöÒÓÔÖùúûüÙÚÛÜçÇšŠ"
PLAIN = "eeeeeeeeaaaaaaaaiiiiiiiioooooooouuuuuuuuccss"
#: The same in the letter's own case.
PLAIN_CASED = "".join(p.upper() if a.isupper() else p for a, p in zip(ACCENTED, PLAIN))
_MARKS = "".join(map(chr, range(0x300, 0x370)))
_LATIN = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if unicodedata.decomposition(chr(c))[:1] not in ("", "<")]
#: Every accented Latin letter, then marks of their own; the plain letters, and nothing for marks.
FOLD = "".join(_LATIN) + _MARKS, "".join(unicodedata.normalize("NFD", ch)[0] for ch in _LATIN)
# First path components that are a computer's, not a folder its owner made.
FURNITURE = ["desktop", "documents", "pictures", "downloads", "users", "volumes"]
#: White space of any script.
SPACES = r"[\t-\r \x85\p{Z}]+"


def sanitize_query(q: Column) -> Column:
    """A search box's text as quoted phrases joined by OR; words without letters or digits go.

    Letters and digits of all scripts stay; what else a word holds parts it to a phrase."""
    words = F.filter(F.split(q, SPACES), lambda w: w.rlike(r"[\p{L}\p{N}]"))
    phrases = F.transform(words, lambda w: F.trim(F.regexp_replace(w, r"[^\p{L}\p{N}]+", " ")))
    return F.array_join(F.transform(phrases, lambda p: F.concat(F.lit('"'), p, F.lit('"'))), " OR ")


def folder_key(path: Column) -> Column:
    """The first folder of a path behind the computer's own, or "(top of the drive)".

    Folders at the end that name a stage of work (raw, edits) are never the first unless
    they are the only one, so they need no step."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.coalesce(F.get(F.filter(dirs, lambda p: ~F.lower(p).isin(*FURNITURE)), F.lit(0)), F.lit("(top of the drive)"))


def month_phrase(first: Column, last: Column) -> Column:
    """When a folder's photographs were taken, in words, from ISO dates."""
    month = F.element_at(F.split(F.lit("January,February,March,April,May,June,July,August,September,October,November,December"), ","), F.substring(first, 6, 2).cast("int"))
    y1, y2 = F.substring(first, 1, 4), F.substring(last, 1, 4)
    return (
        F.when(first.isNull() | last.isNull(), "dates unknown")
        .when(F.substring(first, 1, 7) == F.substring(last, 1, 7), F.concat(F.lit("from "), month, F.lit(" "), y1))
        .when(y1 == y2, F.concat(F.lit("from "), y1))
        .otherwise(F.concat(F.lit("from "), y1, F.lit(" to "), y2))
    )


def year_from_text(text: Column) -> Column:
    """The first four digits in a row, at any place, that read as 1900 to 2099."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit("(?=((?:19|20)[0-9]{2}))"), F.lit(1)), F.lit(1)).cast("int")


def fold_nocase(text: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(text: Column) -> Column:
    """Lower case without the accents of Latin letters, as searches compare words."""
    return F.lower(F.translate(text, *FOLD))


def fold_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def _plain_words(text: Column) -> Column:
    """Words of A-Z, a-z and digits with one space between; apostrophes go."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(text, ACCENTED, PLAIN_CASED), "['’]", ""), "[^A-Za-z0-9]+", " "))


def normalise(text: Column) -> Column:
    """Plain lower-case words with one space between; apostrophes go."""
    return fold_nocase(_plain_words(text))


def case_mask(text: Column) -> Column:
    """For each character of :func:`normalise` whether it was a capital: 1 or 0."""
    return F.regexp_replace(F.regexp_replace(_plain_words(text), "[^A-Z]", "0"), "[A-Z]", "1")


def to_tag(text: Column) -> Column:
    return F.replace(normalise(text), F.lit(" "), F.lit("-"))


def canonical(text: Column) -> Column:
    """As :func:`to_tag`, with '&' read as a word."""
    return to_tag(F.replace(text, F.lit("&"), F.lit(" and ")))


def xml_escape(text: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def parse_size(text: Column) -> Column:
    """"20GB" as bytes with binary units; null for what isn't a size."""
    t = F.upper(F.trim(text))
    number = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?) *([KMGT]?)I?B?$", 1)
    unit = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?) *([KMGT]?)I?B?$", 2)
    power = F.when(unit == "K", 1024.0).when(unit == "M", 1024.0**2).when(unit == "G", 1024.0**3).when(unit == "T", 1024.0**4).otherwise(1.0)
    return (F.nullif(number, F.lit("")).cast("double") * power).cast("long")


def human_bytes(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = F.when(n >= 1024**k, F.concat(F.floor(n / 1024**k).cast("string"), F.lit(" " + unit))).otherwise(out)
    return out


def display_name(name: Column, n: Column, first: Column, last: Column) -> Column:
    """A session's name, or how many photographs of which days."""
    count = F.concat(n.cast("string"), F.lit(" photographs"))
    return F.coalesce(
        F.when(F.length(F.trim(name)) > 0, name),
        F.when(first == last, F.concat(count, F.lit(" on "), first)).when(first.isNotNull() & last.isNotNull(), F.concat(count, F.lit(", "), first, F.lit(" to "), last)),
        F.concat(count, F.lit(", date unknown")),
    )


def excluded(path: Column, pattern: str) -> Column:
    """A pattern without '*' is a substring; with it, its parts in order, anywhere."""
    if "*" not in pattern:
        return F.contains(path, F.lit(pattern))
    parts = [p for p in pattern.split("*") if p]
    quoted = ".*".join("".join(ch if ch.isalnum() else "\\" + ch for ch in p) for p in parts)
    return path.rlike("(?s)" + quoted)


def system_file(path: Column) -> Column:
    """Files that operating systems leave on drives."""
    return path.rlike("(^|/)(\\._[^/]*|\\.DS_Store|\\.localized|Icon\r)$|(^|/)(__MACOSX|\\.Spotlight-V100|\\.Trashes|\\.fseventsd)(/|$)")


def contained(path: Column, root: str) -> Column:
    """Whether a path stays below a root."""
    return ~path.rlike(r"(^|/)\.\.(/|$)") & F.startswith(path, F.lit(root.rstrip("/") + "/"))
