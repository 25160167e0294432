"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Emoji blocks that are stripped (fixed values).
EMOJI = r"[\x{2600}-\x{27BF}\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}]"
#: A latitude and a longitude with six decimals (fixed value).
COORDINATES = r"(-?\d{1,2}\.\d{6})\s?,\s?(-?\d{1,2}\.\d{6})"
#: Two or three lower-case letters before white space, a slash or the end; the group may be missing (fixed value).
TLD = r"[^\s\/](?:\.([a-z]{2,3}))?(?:\s|\/|$)"
#: A domain, with its scheme left out (fixed value); group 2 is the domain.
DOMAIN = r"(https?:\/\/)?([\da-z\.-]+\.[a-z\.]{2,6})([\/\w\.-]*)\/?"
#: United States zones and their codes (fixed values).
US_ZONES = (("Pacific Time (US & Canada)", "PST"), ("Eastern Time (US & Canada)", "EST"), ("Central Time (US & Canada)", "CST"))


def without_emoji(text: Column) -> Column:
    return F.regexp_replace(text, EMOJI, "")



def coordinates(text: Column) -> Column:
    """struct(lat, lon) of the first pair of coordinates in a text, or null."""
    part = lambda k: F.regexp_extract(text, COORDINATES, k)
    return F.when(part(1) != "", F.struct(part(1).cast("double").alias("lat"), part(2).cast("double").alias("lon")))


def top_level_domains(url: Column) -> Column:
    return F.array_remove(F.regexp_extract_all(url, F.lit(TLD), F.lit(1)), "")


def domains(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DOMAIN), F.lit(2))


def zone_name(name: Column) -> Column:
    """A zone's name without what stands in brackets, spaces as underscores."""
    return F.replace(F.trim(F.regexp_replace(name, r"\(.*\)", "")), F.lit(" "), F.lit("_"))


def us_code(name: Column) -> Column:
    """The code of a United States zone, or null."""
    out = None
    for zone, code in US_ZONES:
        out = F.when(name.contains(zone), code) if out is None else out.when(name.contains(zone), code)
    return out


def parts(text: Column, mark: str) -> Column:
    """The parts of a text between marks, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(text, F.lit(rf"\Q{mark}\E")), lambda x: F.trim(x)), lambda x: x != "")


def last_segment(path: Column) -> Column:
    """What follows the last slash, underscores as spaces."""
    return F.replace(F.substring_index(path, "/", -1), F.lit("_"), F.lit(" "))


def or_terms(terms: Column) -> Column:
    return F.replace(terms, F.lit(","), F.lit(" OR "))


def uptime(seconds: Column) -> Column:
    """Seconds as d:h:mm:ss."""
    unit = lambda size, of: F.pmod(F.floor(seconds / size), F.lit(of))
    return F.format_string("%d:%d:%02d:%02d", F.floor(seconds / 86400), unit(3600, 24), unit(60, 60), F.pmod(seconds, F.lit(60)))


def tracks(text: Column, track: str) -> Column:
    """Whether a text holds all words of any of the comma-separated terms, whatever the case."""
    out = F.lit(False)
    for term in track.split(","):
        hit = F.lit(True)
        for word in term.split():
            hit = hit & F.lower(text).contains(word.lower())
        out = out | (hit if term.split() else F.lit(False))
    return out


def repaired(text: Column) -> Column:
    """A text whose UTF-8 was read as Latin-1, set right; any other text stays as it is. JVM-side only."""
    again = F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")
    suspect = text.rlike("[\\x{00C2}-\\x{00F4}][\\x{0080}-\\x{00BF}]") & ~text.rlike("[^\\x{0000}-\\x{00FF}]")
    return F.when(suspect & ~again.contains("�"), again).otherwise(text)
