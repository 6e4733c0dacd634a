"""File name dialects and times (X19, N1 to N9, X20, X21). The seven dialects are kept apart on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import let

# The patterns of the dialects.
CALL = r"^(.*?)_(\d+)_(\d{14})(?:_(\d{6}))?$"
CALLER_PHONE_TIME = r"^(.+?)_(\d{10,11})_(\d{14})$"
#: What stands before a time, and the line's end that $ allows behind it.
TIMED = r"^(.+)_(\d{14})$(?s:.*)"
DERIVED = r"^(.+_\d{14})_\d{6}$(?s:.*)"
EXPORT_NAMED, EXPORT_PHONE = r"^(.+?)_(\d{7,12})_(\d{14})\.txt$", r"^(\d{7,12})_(\d{14})\.txt$"
MOBILE = r"(0(?:1[0-6789]|10)\d{7,8})"
DATED_NAME, NAMED = r"^\d{8}_\d{4}_(.+?)_(0(?:1[0-6789]|10)\d{7,8})$", r"^(.+?)_(0(?:1[0-6789]|10)\d{7,8})$"


def basename(path: Column) -> Column:
    whole = F.replace(path, F.lit("\\"), F.lit("/"))
    last = F.substring_index(whole, "/", -1)
    # Slashes, or a line's end, may stand behind the name; what is longer than a line's end is the name, and needs no pattern.
    return F.when(F.length(last) > 2, last).otherwise(F.regexp_extract(whole, r"([^/]*)/*$", 1))


def stem(path: Column) -> Column:
    """The base name without its last suffix; a leading dot begins no suffix."""
    name = basename(path)
    return F.when(F.regexp_like(name, F.lit(r"(?s)^.+\.[^.]+$")), F.regexp_extract(name, r"(?s)^(.+)\.[^.]+$", 1)).otherwise(name)


def stamp(digits: Column) -> Column:
    """A 14-digit time, null if there is no such time."""
    return F.try_to_timestamp(F.when(F.regexp_like(digits, F.lit(r"^\d{14}$")), digits), F.lit("yyyyMMddHHmmss"))


def kst_iso(digits: Column) -> Column:
    """ISO 8601 at UTC+9, empty if there is no such time."""
    return F.coalesce(F.concat(F.date_format(stamp(digits), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00")), F.lit(""))


def call_context(name: Column) -> Column:
    base = stem(F.coalesce(name, F.lit("")))
    fits = F.regexp_like(base, F.lit(CALL))
    return F.struct(
        F.when(fits, F.regexp_extract(base, CALL, 1)).otherwise(base).alias("caller"),
        F.regexp_extract(base, CALL, 2).alias("phone"),
        F.when(fits, kst_iso(F.regexp_extract(base, CALL, 3))).otherwise("").alias("called_at"),
        F.regexp_extract(base, CALL, 4).alias("suffix"),
    )


def stem_parts(s: Column) -> Column:
    return let(F.struct(s.alias("s"), timed(s).alias("r")), lambda c: let(stem_cut(c["s"], c["r"]), stem_struct))


def timed(s: Column) -> Column:
    """time, comma and what stands before the time of a stem, which can't be the stem itself; a stem without a time as it is."""
    return F.regexp_replace(s, TIMED, "$2,$1")


def stem_cut(s: Column, r: Column) -> Column:
    """Struct (head, last, date) of a stem and timed() of it: what stands before the time, and the last of it."""
    fits = F.coalesce(r != s, F.lit(False))
    head = F.when(fits, F.substring(r, 16, 1 << 30)).otherwise("")
    return F.struct(head.alias("head"), F.substring_index(head, "_", -1).alias("last"), F.when(fits, F.substring(r, 1, 14)).otherwise("").alias("date"))


def stem_struct(cut: Column) -> Column:
    """Struct (caller, phone, date) of stem_cut(): a phone alone, one with a caller before it, or a caller."""
    head, last = cut["head"], cut["last"]
    phoned = F.length(last).isin(10, 11) & (F.translate(last, "0123456789", "") == "") & (F.length(head) != F.length(last) + 1)
    return F.struct(F.when(phoned, F.substring(head, F.lit(1), F.length(head) - F.length(last) - 1)).otherwise(head).alias("caller"), F.when(phoned, last).otherwise("").alias("phone"), cut["date"].alias("date"))


def canonical_stem(s: Column) -> Column:
    return F.regexp_replace(s, DERIVED, "$1")


def export_name(name: Column) -> Column:
    """counterparty (null if there is only a phone), phone, at; null if the name or its time doesn't fit."""
    named, only = F.regexp_like(name, F.lit(EXPORT_NAMED)), F.regexp_like(name, F.lit(EXPORT_PHONE))
    at = stamp(F.when(named, F.regexp_extract(name, EXPORT_NAMED, 3)).when(only, F.regexp_extract(name, EXPORT_PHONE, 2)))
    phone = F.when(named, F.regexp_extract(name, EXPORT_NAMED, 2)).otherwise(F.regexp_extract(name, EXPORT_PHONE, 1))
    return F.when(at.isNotNull(), F.struct(F.when(named, F.regexp_extract(name, EXPORT_NAMED, 1)).alias("counterparty"), phone.alias("phone"), at.alias("at")))


def caller_info(s: Column) -> Column:
    fits = F.regexp_like(s, F.lit(CALLER_PHONE_TIME))
    return F.struct(F.when(fits, F.regexp_extract(s, CALLER_PHONE_TIME, 1)).alias("caller"), F.when(fits, F.regexp_extract(s, CALLER_PHONE_TIME, 2)).alias("phone"))


def schedule_name(s: Column) -> Column:
    p = F.split(s, "_")
    n = F.size(p)
    last, before = F.element_at(p, -1), F.when(n >= 2, F.try_element_at(p, F.lit(-2)))
    dated = (n >= 3) & F.regexp_like(last, F.lit(r"^\d{14}$"))
    at = F.concat(F.substring(last, 1, 4), F.lit("-"), F.substring(last, 5, 2), F.lit("-"), F.substring(last, 7, 2), F.lit(" "), F.substring(last, 9, 2), F.lit(":"), F.substring(last, 11, 2))
    return F.struct(
        F.when(dated, F.array_join(F.slice(p, F.lit(1), F.greatest(n - 2, F.lit(0))), "_")).otherwise("Unknown").alias("counterparty"),
        F.when(dated & F.regexp_like(before, F.lit(r"^\d{10,}$")), before).otherwise("").alias("phone"),
        F.when(dated, at).alias("called_at"),
    )


def resolver_phone(name: Column) -> Column:
    """The first mobile number anywhere, also inside longer runs of digits."""
    return F.nullif(F.regexp_extract(stem(name), MOBILE, 1), F.lit(""))


def resolver_counterparty(name: Column) -> Column:
    s = stem(name)
    other = F.regexp_extract(s, NAMED, 1)
    return F.when(F.regexp_like(s, F.lit(DATED_NAME)), F.regexp_extract(s, DATED_NAME, 1)).when(
        F.regexp_like(s, F.lit(NAMED)) & ~F.regexp_like(other, F.lit(r"^\d{8}_\d{4}$")), other
    )


def backoff(now: Column, attempts: Column) -> Column:
    """15 minutes, doubled with each further attempt, a day at most."""
    minutes = F.least(F.lit(1440), 15 * F.pow(F.lit(2.0), F.least(F.greatest(F.lit(0), attempts - 1), F.lit(10)))).cast("int")
    return now + F.make_interval(mins=minutes)


def hours_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 3.6e9


def chunk_offsets(duration: Column, each: int = 300) -> Column:
    """Starts of chunks; the end is exclusive."""
    return F.filter(F.sequence(F.lit(0), F.ceil(duration).cast("int"), F.lit(each)), lambda x: x < duration)


def clock_seconds(text: Column) -> Column:
    """Seconds of the first HH:MM:SS.ff in a text."""
    p = r"(\d+):(\d+):(\d+(?:\.\d+)?)"
    return F.when(F.regexp_like(text, F.lit(p)), F.regexp_extract(text, p, 1).cast("int") * 3600 + F.regexp_extract(text, p, 2).cast("int") * 60 + F.regexp_extract(text, p, 3).cast("double"))


def real_time_factor(audio: Column, elapsed: Column) -> Column:
    return F.when(elapsed > 0, audio / elapsed).otherwise(F.lit(0.0))


def notice_time(text: Column) -> Column:
    """M/D HH:MM, or the first 16 characters of what is no time."""
    at = F.try_to_timestamp(text)
    return F.coalesce(F.date_format(at, "M/d HH:mm"), F.substring(text, 1, 16))


def safe_file_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"))


def slug(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.trim(text), r"(?U)[^\w.-]", "_"), 1, 80)




def drive_to_mount(path: Column) -> Column:
    """X:\\a\\b as /mnt/x/a/b; other paths as they are."""
    fits = F.substring(path, 2, 2) == ":\\"
    rest = F.replace(F.substring(path, F.lit(4), F.length(path)), F.lit("\\"), F.lit("/"))
    return F.when(fits & (F.length(path) >= 3), F.concat(F.lit("/mnt/"), F.lower(F.substring(path, 1, 1)), F.lit("/"), rest)).otherwise(path)


def mount_to_drive(path: Column) -> Column:
    """/mnt/x/a/b as X:\\a\\b; other paths as they are."""
    fits = path.startswith("/mnt/") & (F.length(path) >= 7) & (F.substring(path, 7, 1) == "/")
    rest = F.replace(F.substring(path, F.lit(8), F.length(path)), F.lit("/"), F.lit("\\"))
    return F.when(fits, F.concat(F.upper(F.substring(path, 6, 1)), F.lit(":\\"), rest)).otherwise(path)


def next_batch(last_completed: Column, updated: Column, today: Column) -> Column:
    """The batch after the last completed one; from the beginning if the checkpoint is of another day."""
    return F.when(F.replace(F.substring(updated, 1, 10), F.lit("-"), F.lit("")) == today, F.coalesce(last_completed, F.lit(-1)) + 1).otherwise(0)
