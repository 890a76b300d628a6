"""Scalar functions as column expressions: identity, text, units."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MILE, FOOT = 1609.344, 0.3048
#: Fixed values of the 32-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def fnv1a(text: str | Column) -> Column:
    """32-bit FNV-1a over the UTF-16 code units of a text; a character above U+FFFF is two of them."""
    text = F.col(text) if isinstance(text, str) else text
    units = F.hex(F.encode(text, "UTF-16BE"))

    def of(units: Column) -> Column:
        at = F.when(F.length(units) > 0, F.sequence(F.lit(0), (F.length(units) / 4).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        numbers = F.transform(at, lambda i: F.conv(F.substring(units, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
        return F.aggregate(numbers, F.lit(FNV_OFFSET).cast("long"), lambda h, c: (h.bitwiseXOR(c) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))

    return F.get(F.transform(F.array(units), of), F.lit(0))  # a lambda's argument: the text is made once, not for each character


def times32(a: Column, b: int) -> Column:
    """The low 32 bits of a product of numbers below 2^32."""
    low = F.lit(65536).cast("long")
    return (F.floor(a / low) * b % low * low + a % low * b) % F.lit(1 << 32)


def jitter(identity: str | Column, number: int | Column) -> Column:
    """A fixed factor of 0.8 to 1.2 for a trail in a search pass (a number, or a column of them); 1 in pass 0."""
    identity = F.col(identity) if isinstance(identity, str) else identity
    number = F.lit(number) if isinstance(number, int) else number
    key = times32(number.cast("long"), 0x9E3779B9)
    value = times32(identity.bitwiseXOR(key), 0x85EBCA6B)
    value = times32(value.bitwiseXOR(F.floor(value / 65536)), 0xC2B2AE35)
    spread = F.lit(0.8) + value.bitwiseXOR(F.floor(value / 65536)) / F.lit(float(1 << 32)) * F.lit(0.4)
    return F.when(number == 0, F.lit(1.0)).otherwise(spread)


def plain_number(x: str | Column) -> Column:
    """A number of at most 7 decimals as text, without zeros at its end."""
    x = F.col(x) if isinstance(x, str) else x
    return F.regexp_replace(F.round(x, 7).cast("decimal(14,7)").cast("string"), r"\.?0+$", "")


def highway_label(ref: str | Column) -> Column:
    """I90 as I-90, US2 as US 2, WA20 as SR 20."""
    ref = F.col(ref) if isinstance(ref, str) else ref
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(ref, r"\bWA(\d+)\b", "SR $1"), r"\bUS(\d+)\b", "US $1"), r"\bI(\d+)\b", "I-$1")


def high_point_text(low: Column, high: Column, metric: bool = False) -> Column:
    """A range of heights, either end of which may be open."""
    n = lambda m: F.format_number(F.floor((m if metric else m / FOOT) + 0.5), 0)
    dash = F.concat(n(low), F.lit("\u2013"), n(high))
    return F.concat(F.when(low.isNull(), F.concat(F.lit("\u2264"), n(high))).when(high.isNull(), F.concat(F.lit("\u2265"), n(low))).otherwise(dash), F.lit(" m" if metric else " ft"))


def stepped(value: Column, by: Column, low: float, high: float) -> Column:
    """A value moved by a step, within limits, without a tail of decimals."""
    return F.round(F.least(F.lit(high), F.greatest(F.lit(low), value + by)), 10)


def identifier_ok(text: Column) -> Column:
    return text.rlike(r"^[a-zA-Z0-9][a-zA-Z0-9._-]{0,127}$")


def digest_ok(text: Column) -> Column:
    return text.rlike("^[a-f0-9]{64}$")


def date_ok(text: Column) -> Column:
    """Whether a text is an ISO date that exists."""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.coalesce(F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd") == text, F.lit(False))


def url_ok(text: Column, folder: bool = False) -> Column:
    """An absolute web address without user and fragment; a folder has no query and ends with a slash."""
    form = r"^https?://[^/?#@\s]+(/[^?#\s]*)?/$" if folder else r"^https?://[^/?#@\s]+(/[^?#\s]*)?(\?[^#\s]*)?$"
    return text.rlike(form)


def short_sha(text: str | Column, length: int = 32) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def road_ref(ref: str | Column, network: str | Column) -> Column:
    """A road reference without spaces, in capitals, SR as WA, with the network's prefix if it has none."""
    bare = F.regexp_replace(F.upper(F.regexp_replace(ref, r"\s+", "")), "^SR", "WA")
    return F.when(bare.rlike("^[0-9]"), F.concat(F.col(network) if isinstance(network, str) else network, bare)).otherwise(bare)


def xml_escape(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


@F.pandas_udf(StringType())
def without_marks(text: pd.Series) -> pd.Series:
    """NFKD without combining marks."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def slug(text: str | Column) -> Column:
    """Lower case, runs of anything but letters and digits as one hyphen, at most 150 characters."""
    bare = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(bare, "^-+|-+$", ""), 1, 150), "-+$", "")


def gpx_filename(name: str | Column, distance: str | Column, metric: bool = False) -> Column:
    length = F.col(distance) / (1000 if metric else MILE) if isinstance(distance, str) else distance / (1000 if metric else MILE)
    shown = F.replace(F.format_number(length, 1), F.lit(","), F.lit(""))
    return F.concat(slug(without_marks(name)), F.lit("_"), shown, F.lit("km" if metric else "mi"), F.lit(".gpx"))


def distance_text(metres: str | Column, metric: bool = False) -> Column:
    m = F.col(metres) if isinstance(metres, str) else metres
    return F.concat(F.replace(F.format_number(m / (1000 if metric else MILE), 1), F.lit(","), F.lit("")), F.lit(" km" if metric else " mi"))


def climb_text(metres: str | Column, metric: bool = False) -> Column:
    m = F.col(metres) if isinstance(metres, str) else metres
    return F.concat(F.round(m if metric else m / FOOT, 0).cast("long").cast("string"), F.lit(" m" if metric else " ft"))


def kilobytes_text(size: str | Column) -> Column:
    """Bytes as whole kilobytes, however many."""
    b = F.col(size) if isinstance(size, str) else size
    return F.concat(F.round(b / 1e3, 0).cast("long").cast("string"), F.lit(" kB"))


def bytes_text(size: str | Column) -> Column:
    """Bytes in KB, MB from a million on, GB from a billion on, with one decimal unless it is zero; halves go up."""
    b = (F.col(size) if isinstance(size, str) else size).cast("long")
    unit = lambda kilo, mega, giga: F.when(b >= 1_000_000_000, giga).when(b >= 1_000_000, mega).otherwise(kilo)
    d = unit(*(F.lit(x).cast("long") for x in (1_000, 1_000_000, 1_000_000_000)))
    twice = b * 20 + d
    tenths = ((twice - twice % (2 * d)) / (2 * d)).cast("long")
    decimal = F.when(tenths % 10 == 0, "").otherwise(F.concat(F.lit("."), (tenths % 10).cast("string")))
    return F.concat(F.format_number(F.floor(tenths / 10), 0), decimal, F.lit(" "), unit("KB", "MB", "GB"))


def elapsed_text(seconds: str | Column) -> Column:
    s = F.col(seconds).cast("long") if isinstance(seconds, str) else seconds.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    part = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(h > 0, F.concat_ws(" ", part(h, "h"), part(m, "m"))).when(m > 0, F.concat_ws(" ", part(m, "m"), part(r, "s"))).otherwise(part(r, "s"))


def tick_step(span: str | Column, ticks: int = 5) -> Column:
    """The step of 1, 2, 5 or 10 times a power of ten that gives about so many ticks."""
    rough = (F.col(span) if isinstance(span, str) else span) / ticks
    power = F.pow(F.lit(10.0), F.floor(F.log10(rough)))
    return power * F.when(rough <= power, 1.0).when(rough <= 2 * power, 2.0).when(rough <= 5 * power, 5.0).otherwise(10.0)


def coordinate(text: str | Column) -> Column:
    """struct<lon, lat> of a pair of coordinates; null if it is none or out of range.

    Two decimals are latitude and longitude. Otherwise each part has degrees and, if these are whole, minutes and seconds;
    with letters N, S, E, W before or after them (on both parts, of both kinds, and no signs) in either order, else latitude first.
    """
    text = F.col(text) if isinstance(text, str) else text
    text = F.regexp_replace(F.translate(F.trim(text), "\u2212\u2032\u2019\u2033\u201d", "-''\"\""), r"^\s*[(\[]\s*|\s*[)\]]\s*$", "")
    number = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)"
    two = rf"^({number})\s*(?:[,;]\s*|\s+)({number})$"
    angle = rf"{number}(?:\s*\u00b0)?(?:\s*\d+(?:\.\d+)?(?:\s*')?)?(?:\s*\d+(?:\.\d+)?(?:\s*\")?)?"
    part = rf"(?:[NSEW]\s*{angle}|{angle}\s*[NSEW])"
    directed = rf"(?i)^({part})\s*[,;]?\s*({part})$"
    halves = F.split(text, "[,;]")
    first = F.when(text.rlike(directed), F.regexp_extract(text, directed, 1)).when(F.size(halves) == 2, halves[0])
    second = F.when(text.rlike(directed), F.regexp_extract(text, directed, 2)).when(F.size(halves) == 2, halves[1])
    one = rf"(?i)^([NSEW])?\s*({number})(?:\s*\u00b0)?(?:\s*(\d+(?:\.\d+)?)(?:\s*')?)?(?:\s*(\d+(?:\.\d+)?)(?:\s*\")?)?\s*([NSEW])?$"

    def parsed(half: Column) -> tuple[Column, Column]:
        half = F.trim(half)
        group = lambda i: F.regexp_extract(half, one, i)
        real = lambda i: F.coalesce(group(i).try_cast("double"), F.lit(0.0))
        side = F.upper(F.concat(group(1), group(5)))
        degrees, minutes, seconds = real(2), real(3), real(4)
        bad = ~half.rlike(one) | (F.length(side) > 1) | (minutes >= 60) | (seconds >= 60) | ((group(4) != "") & (minutes != F.floor(minutes))) | ((group(3) != "") & (degrees != F.floor(degrees))) | ((side != "") & group(2).rlike("^[+-]"))
        size = F.abs(degrees) + minutes / 60 + seconds / 3600
        sign = F.when(side.isin("S", "W") | ((side == "") & group(2).startswith("-")), -1.0).otherwise(1.0)
        return F.when(~F.coalesce(bad, F.lit(True)), size * sign), side

    (a, side_a), (b, side_b) = parsed(first), parsed(second)
    north = lambda side: side.isin("N", "S")
    mixed = ((side_a == "") != (side_b == "")) | ((side_a != "") & (north(side_a) == north(side_b)))
    turned = (side_a != "") & ~north(side_a)
    decimal = lambda i: F.regexp_extract(text, two, i).try_cast("double")
    lat = F.when(text.rlike(two), decimal(1)).when(~mixed, F.when(turned, b).otherwise(a))
    lon = F.when(text.rlike(two), decimal(2)).when(~mixed, F.when(turned, a).otherwise(b))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lon.alias("lon"), lat.alias("lat")))
