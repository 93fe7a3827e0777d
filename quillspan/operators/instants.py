"""Publication moments in many notations, brought to one instant in UTC.

The raw strings are reduced to a dictionary of distinct (text, zone, date order)
values; each is parsed once, the result is kept in a Parquet table that later runs
extend, and the instants are joined back to the rows.  Of a value that two runs add at once, or a retried one adds again, readers
take one entry.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.shared import kept_path, written
from quillspan.skew import salted_lookup

# Month names by language, as feeds write them (lower case, without accents and full stops).
MONTHS = {
    1: "january jan januar janner jan janvier janv enero ene gennaio gen januari",
    2: "february feb februar febr fevrier fevr fev febrero febbraio februari",
    3: "march mar marz maerz mrz mars marzo maart",
    4: "april apr avril avr abril abr aprile",
    5: "may mai mayo maggio mag mei",
    6: "june jun juni juin junio giugno giu",
    7: "july jul juli juillet juil julio luglio lug",
    8: "august aug aout agosto ago augustus",
    9: "september sep sept septembre septiembre set settembre",
    10: "october oct oktober okt octobre octubre ottobre ott",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez decembre diciembre dic dicembre",
}
MONTH = {name: number for number, names in MONTHS.items() for name in names.split()}

# Minutes east of UTC of zone abbreviations whose meaning does not depend on the country.
OFFSETS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "MEZ": 60, "CET": 60, "MESZ": 120, "CEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "SGT": 480, "HKT": 480, "JST": 540, "KST": 540, "PHT": 480, "WIB": 420,
    "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EDT": -240, "EST": -300, "CDT": -300, "CST": -360, "MDT": -360, "MST": -420, "PDT": -420, "PST": -480,
    "AKDT": -480, "AKST": -540, "HST": -600, "BST": 60, "IST": 330,
}

# Abbreviations that mean something else in some countries, by the first part that matches the home zone.
LOCAL_OFFSETS = {
    "EST": (("Australia/", 600),), "EDT": (("Australia/", 660),), "CST": (("Asia/", 480), ("Australia/", 570)),
    "CDT": (("Australia/", 630),), "WST": (("Australia/", 480),), "IST": (("Europe/Dublin", 60), ("Asia/Jerusalem", 120)),
    "BST": (("Asia/Dhaka", 360),), "PST": (("Asia/Manila", 480),), "MST": (("Asia/Kuala_Lumpur", 480),),
}

# Names of wall clocks, which follow daylight saving.
WALL_CLOCKS = {
    "ET": "America/New_York", "CT": "America/Chicago", "MT": "America/Denver", "PT": "America/Los_Angeles",
    "AET": "Australia/Sydney", "UK": "Europe/London",
}

_WORD = r"[^\W\d_]+"
_DATES = [
    ("ymd", r"(?P<y>\d{4})(?P<sep>[-/.])(?P<m>\d{1,2})(?P=sep)(?P<d>\d{1,2})"),
    ("ymd", r"(?P<y>\d{4}) ?年 ?(?P<m>\d{1,2}) ?月 ?(?P<d>\d{1,2}) ?日"),
    ("ymd", r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?=T)"),
    ("week", r"(?P<y>\d{4})-?W(?P<w>\d{2})-?(?P<d>[1-7])(?=[T ])"),
    ("day", r"(?P<y>\d{4})-?(?P<d>\d{3})(?=[T ])"),
    ("numbers", r"(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<c>\d{4}|\d{2})(?!\d)"),
    ("name", rf"(?P<d>\d{{1,2}})(?:\.|st|nd|rd|th|er)?(?: de| of)?[ -](?P<name>{_WORD})\.?(?:,| de)?[ -](?P<y>\d{{4}}|\d{{2}})(?!\d)"),
    ("name", rf"(?P<name>{_WORD})\.? (?P<d>\d{{1,2}})(?:st|nd|rd|th)?,? (?P<y>\d{{4}})"),
    ("name", rf"(?P<y>\d{{4}})[ -](?P<name>{_WORD})\.?[ -](?P<d>\d{{1,2}})(?!\d)"),
]
_DATES = [(kind, re.compile(p, re.I)) for kind, p in _DATES]
_JOIN = re.compile(r"(?:T|,? (?:à|um|at|a las|las|@|-) ?|, ?| )", re.I)
_TIME = re.compile(
    r"(?P<h>\d{1,2})(?:"
    r":(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?"
    r"| ?[hH] ?(?P<mi2>\d{2})(?: ?(?:m|min|:) ?(?P<s2>\d{2}) ?s?)?"
    r"| ?時 ?(?P<mi3>\d{1,2}) ?分(?: ?(?P<s3>\d{1,2}) ?秒)?"
    r"|\.(?P<mi4>\d{2})(?= ?Uhr)"
    r"|(?= ?[AaPp]\.?[Mm]\.?(?![a-zA-Z]))"
    r")(?: ?Uhr)?(?: ?(?P<ap>[AaPp])\.?[Mm]\.?(?![a-zA-Z]))?"
)
_COMPACT_TIME = re.compile(r"(?P<h>\d{2})(?P<mi>\d{2})(?:(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?!\d)")
_WEEKDAY = re.compile(rf"^(?!\d){_WORD}\.?,? (?=\d)|^{_WORD}, (?={_WORD})")
_OFFSET = re.compile(r"(?P<sign>[+\-−])(?P<h>\d{1,2}):?(?P<m>\d{2})?")
#: As the C library writes moments: month, day, time, perhaps a zone, and the year last.
_YEAR_LAST = re.compile(rf"(?:{_WORD}\.?,? )?(?P<name>{_WORD})\.? (?P<d>\d{{1,2}}),? (?P<time>\d{{1,2}}:\d{{2}}(?::\d{{2}})?)(?P<zone> [^ ]+)? (?P<y>\d{{4}})")
_EPOCH = re.compile(r"(\d{9,10})(?:[.,](\d{1,9}))?")
_IANA = re.compile(r"[A-Za-z]+(?:/[A-Za-z0-9_+\-]+)+")
_EPOCH_START = datetime(1970, 1, 1)


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


def _bare(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def _offset(text: str) -> timezone | None:
    m = _OFFSET.fullmatch(text)
    if not m:
        return None
    minutes = int(m["h"]) * 60 + int(m["m"] or 0)
    if int(m["m"] or 0) > 59 or minutes > 18 * 60:
        return None
    return timezone(timedelta(minutes=-minutes if m["sign"] != "+" else minutes))


@lru_cache(maxsize=4096)
def _named_zone(text: str, home: str):
    """The tzinfo a zone text means in a feed of the zone ``home``; None if it means none."""
    text = text.strip().strip("()").strip()
    bracket = re.fullmatch(r"(.*?)\s*[\[(]([^\])]+)[\])]", text)
    if bracket:  # an offset in front rules over the name behind it
        return _named_zone(bracket[1] or bracket[2], home)
    if fixed := _offset(text):
        return fixed
    upper = text.upper().replace(".", "")
    shifted = re.fullmatch(r"(?:UTC|GMT|UT|Z) ?([+\-−] ?\d{1,2}(?::?\d{2})?)", upper)
    if shifted:
        return _offset(shifted[1].replace(" ", ""))
    for start, minutes in LOCAL_OFFSETS.get(upper, ()):
        if home.startswith(start):
            return timezone(timedelta(minutes=minutes))
    if upper in OFFSETS:
        return timezone(timedelta(minutes=OFFSETS[upper]))
    if upper in WALL_CLOCKS:
        return _zone(WALL_CLOCKS[upper])
    return _zone(text) if _IANA.fullmatch(text) else None


def _date(text: str, order: str):
    """(year, month, day, rest), or None."""
    for kind, pattern in _DATES:
        m = pattern.match(text)
        if not m:
            continue
        if kind in ("week", "day"):
            try:
                at = date.fromisocalendar(int(m["y"]), int(m["w"]), int(m["d"])) if kind == "week" else date(int(m["y"]), 1, 1) + timedelta(days=int(m["d"]) - 1)
            except (ValueError, OverflowError):
                return None
            if kind == "day" and (at.year != int(m["y"]) or m["d"] == "000"):
                return None
            return at.year, at.month, at.day, text[m.end() :]
        if kind == "numbers":
            a, b, c = m["a"], m["b"], m["c"]
            if order == "YMD" and len(c) == 2:
                y, mo, d = a, b, c
            elif order == "MDY":
                mo, d, y = a, b, c
            elif order == "DMY":
                d, mo, y = a, b, c
            else:
                return None
        else:
            y, d = m["y"], m["d"]
            mo = m["m"] if kind == "ymd" else MONTH.get(_bare(m["name"]))
            if mo is None:
                continue
        y = int(y) + (0 if len(y) == 4 else 2000 if int(y) < 70 else 1900)
        return y, int(mo), int(d), text[m.end() :]
    return None


def _date_first(text: str, order: str, home: str) -> str | None:
    """A text that begins with the time or ends with the year, with its date in front; None if it is neither."""
    if m := _YEAR_LAST.fullmatch(text):
        return f"{m['d']} {m['name']} {m['y']} {m['time']}{m['zone'] or ''}"
    m = _TIME.match(text)
    if not m or m.end() == len(text):
        return None
    rest, zone = text[m.end() :].lstrip(" ,"), ""
    first, _, others = rest.partition(" ")
    if others and _named_zone(first.rstrip(","), home) is not None:
        zone, rest = first.rstrip(","), others.lstrip(" ,-")
    rest = re.sub(r"(?i)^(?:on|le|am|el|il|op) (?=\w)", "", rest)
    found = _date(rest + " ", order)
    if not found and (weekday := _WEEKDAY.match(rest)):
        rest = rest[weekday.end() :]
        found = _date(rest + " ", order)
    if not found or found[3].strip() and (zone or _named_zone(found[3].strip(" ,"), home) is None):
        return None
    behind = found[3].strip(" ,")
    return f"{rest[: len(rest) + 1 - len(found[3])].rstrip(' ,')} {m[0].strip()} {zone or behind}".strip()


def parse_instant(raw: str | None, home_zone: str | None, date_order: str | None) -> int | None:
    """Microseconds since 1970-01-01 UTC, or None where the text fixes no instant.

    A zone in the text rules; otherwise ``home_zone`` (None: such texts fix nothing).  A wall-clock time that
    occurs twice is the earlier instant, one that is skipped takes the offset in force before the change.
    Digits beyond microseconds are cut.  Dates or times that don't exist, a date or a time alone: None.
    """
    if raw is None:
        return None
    text = raw if raw.isascii() else unicodedata.normalize("NFKC", raw)
    text = " ".join("".join(c for c in text if unicodedata.category(c) != "Cf").split())
    if not text:
        return None
    if text.isdigit() or _EPOCH.fullmatch(text):
        if m := _EPOCH.fullmatch(text):
            return int(m[1]) * 1_000_000 + int(((m[2] or "") + "000000")[:6])
        if len(text) == 13:
            return int(text) * 1000
        if len(text) == 16:
            return int(text)
        if len(text) == 19:
            return int(text) // 1000
        if len(text) in (12, 14):
            text = f"{text[:8]}T{text[8:]}"
        else:
            return None
    weekday = _WEEKDAY.match(text)
    found = _date(text, date_order or "") or (_date(text[weekday.end() :], date_order or "") if weekday else None)
    if not found:
        turned = _date_first(text, date_order or "", home_zone or "")
        return parse_instant(turned, home_zone, date_order) if turned else None
    y, mo, d, rest = found
    join = _JOIN.match(rest)
    if not join:
        return None
    rest = rest[join.end() :]
    m = _TIME.match(rest) or (_COMPACT_TIME.match(rest) if join[0].upper() == "T" else None)
    if not m:
        return None
    part = m.groupdict()
    h = int(part["h"])
    mi = int(part["mi"] or part.get("mi2") or part.get("mi3") or part.get("mi4") or 0)
    s = int(part["s"] or part.get("s2") or part.get("s3") or 0)
    us = int(((part["f"] or "") + "000000")[:6])
    if half := part.get("ap"):
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if half in "pP" else 0)
    rest = rest[m.end() :].strip().lstrip(",").strip()
    zone = _named_zone(rest, home_zone or "") if rest else _zone(home_zone) if home_zone else None
    if zone is None:
        return None
    try:
        wall = datetime(y, mo, d, h, mi, s, us)  # fold 0: the earlier of two, the offset before a gap
        return (wall - wall.replace(tzinfo=zone).utcoffset() - _EPOCH_START) // timedelta(microseconds=1)
    except (ValueError, OverflowError):
        return None


#: Raised when the parser changes, so that a dictionary never holds what an older one made of a text.
PARSER_VERSION = 2

_PARSED = T.StructType([T.StructField("key", T.StringType()), T.StructField("instant_us", T.LongType())])


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        values = [parse_instant(r, z, o) for r, z, o in zip(pdf["raw"], pdf["zone"], pdf["date_order"], strict=True)]
        yield pdf[["key"]].assign(instant_us=pd.array(values, dtype="Int64"))


def dictionary_path(spark: SparkSession) -> str:
    """Where the dictionary of this parser is kept in the shared folder, for all runs."""
    return kept_path(spark, f"instants-{PARSER_VERSION}")


def extend_dictionary(values: DataFrame, path: str) -> DataFrame:
    """Parse those of ``values`` (key, zone, date_order, raw) whose key the dictionary at ``path`` lacks and append them.

    Returns the dictionary (key, instant_us), each key once.  A text without an instant is kept with a NULL instant, so it isn't
    parsed again either.
    """
    spark = values.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    new = values.select("key", "zone", "date_order", "raw")
    if folder.getFileSystem(conf).exists(folder):
        new = new.join(spark.read.schema(_PARSED).parquet(path), "key", "left_anti")
    new.mapInPandas(_parse_batches, _PARSED).write.mode("append").parquet(path)
    return spark.read.schema(_PARSED).parquet(path).groupBy("key").agg(F.first("instant_us").alias("instant_us"))


def normalise_instants(rows: DataFrame, feeds: DataFrame, *, text: str = "published", source: str = "source", dictionary: str | None = None) -> DataFrame:
    """``rows`` with the column ``instant_us``: microseconds since 1970-01-01 UTC of the moment in ``text``.

    ``feeds`` (source, home_zone, date_order; its rows are agreed on by people, one a source) says how each source
    writes; of a source listed twice any one row counts.  Rows whose text fixes no instant, is NULL, or names no
    zone while its source is unknown or NULL, keep a NULL instant.  Repeated rows stay repeated; all columns of
    ``rows`` stay, and one of the name ``instant_us`` is replaced.  An empty table gives an empty table.
    ``dictionary`` is the Parquet folder of the values parsed so far, which is extended; without it the one of
    ``dictionary_path`` is used, so that later runs parse only what is new to them.
    """
    keep = [F.col(f"`{c}`") for c in rows.columns if c != "instant_us"]
    how = feeds.select(F.col(source).alias("_source"), F.col("home_zone").alias("_zone"), F.col("date_order").alias("_order")).where("_source is not null").dropDuplicates(["_source"])
    key = F.concat_ws("\x01", F.coalesce("_zone", F.lit("\x02")), F.coalesce("_order", F.lit("\x02")), F.col(text))
    read = rows.join(how, F.col(source) == F.col("_source"), "left").withColumn("_key", F.when(F.col(text).isNotNull(), key))
    counted = read.where("_key is not null").groupBy(F.col("_key").alias("key")).agg(F.first("_zone").alias("zone"), F.first("_order").alias("date_order"), F.first(text).alias("raw"), F.count("*").alias("n"))
    values = written(counted, "instant-values")
    known = extend_dictionary(values, dictionary or dictionary_path(rows.sparkSession))
    parsed = values.select("key", "n").join(known, "key").where("instant_us is not null").select(F.col("key").alias("_key"), "n", "instant_us")
    return salted_lookup(read.select(*keep, "_key"), written(parsed, "instants"), "_key", how="left").select(*keep, "instant_us")
