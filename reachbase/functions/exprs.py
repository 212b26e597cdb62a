"""Scalar rules as Column expressions. Times are whole seconds since the service day's midnight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
WALK_M_PER_S = 1.1


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Metres on a sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def java_round(x: Column) -> Column:
    """Half up, also below zero: -2.5 gives -2."""
    return F.floor(x + 0.5)


def room_type(area: Column | str) -> Column:
    a = _c(area)
    return F.when(a <= 0, None).when(a <= 33, "ONE").when(a <= 50, "TWO").otherwise("THREE")


def phase_hash(text: Column | str) -> Column:
    """h = h * 31 + code over the characters in 32 bits, folded to 26 bits; kept in 64 bits throughout."""
    codes = F.transform(F.filter(F.split(_c(text), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return h.bitwiseXOR(F.shiftrightunsigned(h, 15)).bitwiseAND(F.lit(0x3FFFFFF))


def bake(start: Column, end: Column, headway: Column, phase: Column) -> tuple[Column, Column]:
    """A window's first and last departure after its phase; one departure survives a phase past the end."""
    first = start + F.pmod(phase, headway)
    last = F.when(first > end, first).otherwise(first + F.floor((end - first) / headway) * headway)
    return first, last


def earliest_start(first: Column, last: Column, headway: Column, ready: Column, offset: Column) -> Column:
    """The first departure with which a stop at ``offset`` is left at ``ready`` or later; null after the last (inclusive)."""
    start = first + F.ceil(F.greatest(F.lit(0), ready - offset - first) / headway) * headway
    return F.when(ready.isNotNull() & (start <= last), start)


def minutes_or_null(seconds: Column | str, cap: int) -> Column:
    """Rounded minutes; at the cap or above is out of reach."""
    m = F.floor((_c(seconds) + 30) / 60).cast("int")
    return F.when(m < cap, m)


def clock(seconds: Column | str) -> Column:
    """HH:MM:SS, beyond 24 hours too."""
    s = _c(seconds).cast("int")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60)


def seconds_of(text: Column | str) -> Column:
    """Seconds of HH:MM:SS beyond 24 hours too; null if it isn't of that form."""
    t = F.trim(_c(text))
    part = [F.regexp_extract(t, r"^(\d{1,3}):([0-5]\d):([0-5]\d)$", i) for i in (1, 2, 3)]
    return F.when(part[0] != "", part[0].try_cast("int") * 3600 + part[1].try_cast("int") * 60 + part[2].try_cast("int"))


def clock_or(text: Column | str, default: str) -> Column:
    """HHmm with hours 00 to 27, or the default."""
    t = F.trim(_c(text))
    return F.when(F.regexp_like(t, F.lit(r"^(?:[01]\d|2[0-7])[0-5]\d$")), t).otherwise(default)


def unescape_xml(text: Column | str) -> Column:
    out = _c(text)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def escape_html(text: Column | str) -> Column:
    out = _c(text)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def strip_parenthetical(text: Column | str) -> Column:
    """Without a trailing (...), unless the name starts with it."""
    return F.trim(F.regexp_replace(_c(text), r"^([^(]+)\(.*$", "$1"))


def stop_name_key(text: Column | str) -> Column:
    """Without (...) and without spaces and marks."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"\([^)]*\)", ""), r"[\s.·,\-]", "")


def station_name_key(text: Column | str) -> Column:
    """The stop key without a last 역 where more than two characters stand."""
    k = stop_name_key(text)
    return F.when(F.length(k) > 2, F.regexp_replace(k, "역$", "")).otherwise(k)


def split_route_name(text: Column | str) -> Column:
    """struct(number, tail): the Hangul at the end apart, if a number is left before it."""
    head, tail = F.regexp_extract(_c(text), r"^(.*?)([가-힣]+)$", 1), F.regexp_extract(_c(text), r"^(.*?)([가-힣]+)$", 2)
    split = (head != "") & (tail != "")
    return F.struct(F.when(split, head).otherwise(_c(text)).alias("number"), F.when(split, tail).otherwise("").alias("tail"))


def gtfs_id(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), "[^0-9A-Za-z가-힣]", "")


def money(text: Column | str) -> Column:
    """Whole number without its commas, or 0."""
    return F.coalesce(F.trim(F.replace(_c(text), F.lit(","), F.lit(""))).try_cast("int"), F.lit(0))


def price_label(amount: Column | str) -> Column:
    """From 10,000 in units of that with one decimal, else grouped."""
    a = _c(amount)
    tenths = F.floor(a / 1000 + 0.5).cast("int")
    whole = F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 > 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise(""), F.lit("억"))
    return F.when(a >= 10000, whole).otherwise(F.concat(F.format_number(a, 0), F.lit("만")))


def climb_word(metres: Column | str) -> Column:
    m = _c(metres)
    return F.when(m >= 40, "steep").when(m >= 20, "hilly").when(m > 10, "rising").otherwise("flat")


def top_speed(meters: Column | str) -> Column:
    m = _c(meters)
    return F.when(m < 500, 60).when(m < 1500, 80).otherwise(110)


def length_bin(meters: Column | str) -> Column:
    """0 to 8: below 200, 400, 700, 1200, 2000, 3500, 6000, 10000 metres, or more."""
    out, m = F.lit(8), _c(meters)
    for i, edge in reversed(list(enumerate((200, 400, 700, 1200, 2000, 3500, 6000, 10000)))):
        out = F.when(m < edge, i).otherwise(out)
    return out


# Edges of the periods of a service day, in minutes.
PERIODS = ((330, 420), (420, 540), (540, 1020), (1020, 1200), (1200, 1380), (1380, 1480))


def period_of(minute: Column | str) -> Column:
    """0 to 5, or null; minutes before 04:00 belong to the day before."""
    m = _c(minute)
    m = F.when(m < 240, m + 1440).otherwise(m)
    out = F.lit(None).cast("int")
    for i, (a, b) in reversed(list(enumerate(PERIODS))):
        out = F.when((m >= a) & (m < b), i).otherwise(out)
    return out


def rail_seconds(meters: Column | str, dwell: int = 10) -> Column:
    """A rail segment at 32 km/h below 1500 m and 50 above, 30 s at least, and the dwell."""
    m = _c(meters)
    return F.greatest(F.lit(30), F.floor(m / (F.when(m < 1500, 32.0).otherwise(50.0) / 3.6)).cast("int")) + dwell


def transfer_seconds(meters: Column | str, overhead: int) -> Column:
    return F.greatest(F.lit(60), F.floor(overhead + _c(meters) / 1.2).cast("int"))


def walk_seconds(meters: Column | str) -> Column:
    """Between stops: 1.4 times the straight line at walking speed, 30 s at least."""
    return F.greatest(F.lit(30), F.floor(_c(meters) * 1.4 / WALK_M_PER_S).cast("int"))


def segment_meters(road: Column, straight: Column, detour: float) -> Column:
    """The given distance unless it is shorter than the straight line; 400 without coordinates."""
    return F.when((road > 0) & (straight.isNull() | (road >= straight)), road.cast("double")).when(straight.isNull(), 400.0).otherwise(F.greatest(F.lit(30.0), straight * detour))


def mercator_y(lat: Column | str) -> Column:
    return F.degrees(F.log(F.tan(F.radians(_c(lat)) / 2 + 0.7853981633974483)))


def band_breaks(budget: Column | str, bands: int = 4) -> Column:
    """0, step, 2 step ... budget, with the step whose number of bands is nearest; of equals the widest."""
    b = _c(budget)
    scored = F.array(*[F.struct(F.abs(F.ceil(b / s) - bands).alias("off"), F.lit(-s).alias("wide"), F.lit(s).alias("step")) for s in (5, 10, 15, 20, 30, 60)])
    step = F.array_min(scored)["step"]
    inner = F.filter(F.sequence(F.lit(0), b, step), lambda v: v < b)
    return F.concat(inner, F.array(b))


def ramp_index(minutes: Column, budget: Column, size: int) -> Column:
    return java_round(F.least(minutes / budget, F.lit(1.0)) * (size - 1)).cast("int")


def slot_label(arrive: Column, seconds: Column) -> Column:
    return F.format_string("%s %02d:%02d", F.when(arrive, "도착").otherwise("출발"), F.floor(seconds / 3600).cast("int") % 24, F.floor(seconds % 3600 / 60).cast("int"))


# How much longer headways are on some lines, by what their names contain, in this order.
LINE_FACTORS = {
    "경의중앙": 2.5, "경춘": 3.0, "수인분당": 1.6, "경강": 2.5, "서해": 2.2, "공항철도": 1.8, "인천1": 1.3, "인천2": 1.3,
    "의정부": 1.3, "용인": 1.3, "우이신설": 1.3, "김포": 1.2, "GTX": 3.5, "신분당": 1.4, "신림": 1.2,
}

# Speeds in km/h by kind of bus where nothing was measured or learned.
TYPE_KMH = {
    "공항버스": 40.0, "광역버스": 30.0, "직행좌석버스": 30.0, "좌석버스": 24.0, "간선버스": 19.0, "일반버스": 19.0,
    "지선버스": 16.0, "마을버스": 14.0, "순환버스": 15.0, "농어촌버스": 22.0, "인천버스": 22.0, "경기버스": 22.0,
}


def line_factor(name: Column | str) -> Column:
    """The factor of the first listed part that the line's name contains, else 1."""
    out = F.lit(1.0)
    for part, factor in reversed(list(LINE_FACTORS.items())):
        out = F.when(F.contains(_c(name), F.lit(part)), factor).otherwise(out)
    return out


def type_speed(kind: Column | str) -> Column:
    """The fixed speed of a kind of bus, null for an unknown one."""
    return F.create_map(*[F.lit(x) for pair in TYPE_KMH.items() for x in pair])[_c(kind)]


def is_pass_through(name: Column | str) -> Column:
    """Points that shape a route without a stop."""
    return F.contains(_c(name), F.lit("(미정차)")) | F.contains(_c(name), F.lit("(가상)"))


def slot_floor(minute: Column | str) -> Column:
    return F.floor(_c(minute) / 30) * 30


def coordinate_key(lat: Column | str, lon: Column | str, places: int = 5) -> Column:
    """A cache key; joins are safer on the rounded whole numbers."""
    return F.format_string(f"%.{places}f,%.{places}f", _c(lat), _c(lon))


def period_label(index: Column | str) -> Column:
    labels = [f"{a // 60:02d}:{a % 60:02d}~{b // 60 % 24:02d}:{b % 60:02d}" for a, b in PERIODS]
    return F.try_element_at(F.array(*[F.lit(x) for x in labels]), _c(index).cast("int") + 1)


def recent_months(last: Column | str, count: int) -> Column:
    """yyyyMM of the months before a date, the latest first."""
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.date_format(F.add_months(_c(last), -i), "yyyyMM"))


def headway_of(text: Column | str) -> Column:
    """The mean of the numbers from 1 to 300 in a text, half to even; null if there is none."""
    found = F.filter(F.transform(F.regexp_extract_all(_c(text), F.lit(r"(\d+)"), 1), lambda x: x.try_cast("int")), lambda x: x.between(1, 300))
    total = F.aggregate(found, F.lit(0), lambda s, x: s + x)
    return F.when(F.size(found) > 0, F.bround(total / F.size(found)).cast("int"))


def building_key(apartment: Column | str, district: Column | str, area: Column | str, parcel: Column | str) -> Column:
    """An apartment's own number, else its district, area and parcel."""
    own = F.nullif(F.trim(_c(apartment)), F.lit(""))
    return F.coalesce(own, F.concat_ws("|", _c(district), _c(area), F.coalesce(F.nullif(F.trim(_c(parcel)), F.lit("")), F.lit("DONG"))))


def road_address(road: Column | str, main: Column | str, sub: Column | str) -> Column:
    """Road and number without leading zeros, ``-sub`` if there is one."""
    digits = lambda c: F.ltrim(F.trim(_c(c)), F.lit("0"))
    number = F.concat(digits(main), F.when(F.coalesce(digits(sub), F.lit("")) != "", F.concat(F.lit("-"), digits(sub))).otherwise(""))
    return F.trim(F.concat_ws(" ", _c(road), number))


# Codes of the kinds of city bus routes.
ROUTE_TYPES = {"1": "공항버스", "2": "마을버스", "3": "간선버스", "4": "지선버스", "5": "순환버스", "6": "광역버스", "7": "인천버스", "8": "경기버스"}
# Display names of lines by their codes.
LINE_NAMES = {
    "K": "경의중앙", "B": "수인분당", "G": "경춘", "A": "공항철도", "S": "신분당", "I": "인천1", "I2": "인천2", "U": "의정부",
    "W": "우이신설", "E": "용인에버라인", "KK": "경강", "KP": "김포골드", "SH": "서해",
}
# Provinces by the first two digits of a district's code.
PROVINCES = {"11": "서울", "28": "인천", "41": "경기"}
# Colours of a drawing by minutes, each from its number on.
DRAWN = ((0, "#1a4d8f"), (10, "#2b6cb0"), (20, "#4a90c4"), (30, "#7fb3d5"), (45, "#aecfe4"), (60, "#d3e3f0"))


def _mapped(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def repaired(text: Column | str, names: dict[str, str]) -> Column:
    """The name, or what a table of known misspellings puts in its place."""
    return F.coalesce(_mapped(names, _c(text)), _c(text)) if names else _c(text)


def alternatives(text: Column | str) -> Column:
    """The names between slashes, trimmed, without empty ones; an empty array for null."""
    parts = F.transform(F.split(F.coalesce(_c(text), F.lit("")), "/"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def first_word(text: Column | str) -> Column:
    return F.substring_index(_c(text), " ", 1)


def longest_prefix(text: Column | str, codes: dict[str, str]) -> Column:
    """The code of the longest listed name that the trimmed text starts with; null without one."""
    out = F.lit(None).cast("string")
    for name, code in sorted(codes.items(), key=lambda x: len(x[0])):
        out = F.when(F.startswith(F.trim(_c(text)), F.lit(name)), code).otherwise(out)
    return out


def route_type_name(code: Column | str) -> Column:
    return F.coalesce(_mapped(ROUTE_TYPES, _c(code).cast("string")), F.lit("일반버스"))


def province(code: Column | str) -> Column:
    """The province of a district's code by its first two digits; null for an unknown one."""
    return _mapped(PROVINCES, F.substring(_c(code).cast("string"), 1, 2))


def line_name(code: Column | str) -> Column:
    """A line's display name: the listed one, number and 호선, or the code itself."""
    c = _c(code).cast("string")
    return F.coalesce(_mapped(LINE_NAMES, c), F.when(F.regexp_like(c, F.lit("^[0-9]+$")), F.concat(c, F.lit("호선"))), c)


def _digits(text: Column) -> Column:
    return F.substring(F.lpad(F.regexp_replace(text, "[^0-9]", ""), 4, "0"), 1, 4)


def clock_text(text: Column | str) -> Column:
    """The digits of HHmm as HH:MM:00."""
    d = _digits(_c(text))
    return F.concat(F.substring(d, 1, 2), F.lit(":"), F.substring(d, 3, 2), F.lit(":00"))


def clock_after(text: Column | str, first: Column | str) -> Column:
    """HHmm as HH:MM:00; not later than the first one, it belongs to the next day: 24 hours more."""
    a, b = _digits(_c(text)), _digits(_c(first))
    minutes = [F.substring(x, 1, 2).cast("int") * 60 + F.substring(x, 3, 2).cast("int") for x in (a, b)]
    hours = F.substring(a, 1, 2).cast("int") + F.when(minutes[0] <= minutes[1], 24).otherwise(0)
    return F.concat(F.lpad(hours.cast("string"), 2, "0"), F.lit(":"), F.substring(a, 3, 2), F.lit(":00"))


def minutes_of(text: Column | str) -> Column:
    """Minutes of HH:MM or HH:MM:SS; null if it isn't of that form."""
    parts = F.split(_c(text), ":")
    return F.try_element_at(parts, F.lit(1)).try_cast("int") * 60 + F.try_element_at(parts, F.lit(2)).try_cast("int")


def minutes_clock(minutes: Column | str) -> Column:
    m = _c(minutes).cast("int")
    return F.format_string("%02d:%02d:00", F.floor(m / 60).cast("int"), m % 60)


def day_fraction_seconds(text: Column | str) -> Column:
    """Seconds of a spreadsheet's fraction of a day, half to even; null for an empty or other text."""
    return F.bround(F.trim(_c(text)).try_cast("double") * 86_400).cast("int")


def station_short(name: Column | str) -> Column:
    """Without a last 역, but for the one station whose name needs it."""
    n = F.trim(_c(name))
    return F.when(n != "서울역", F.regexp_replace(n, "역$", "")).otherwise(n)


def drawn_colour(minutes: Column | str) -> Column:
    """The colour of the last step that the minutes reach."""
    out = F.lit(None).cast("string")
    for at, colour in DRAWN:
        out = F.when(_c(minutes) >= at, colour).otherwise(out)
    return out


def offset_text(value: Column | str, places: int = 1) -> Column:
    """A number with its sign, as reports print errors."""
    return F.format_string(f"%+.{places}f", _c(value).cast("double"))


def state_text(state: Column) -> Column:
    """A search's state (a struct) as a query string; what is at its default isn't in it."""
    part = lambda key, value: F.concat(F.lit(f"{key}="), F.url_encode(value.cast("string")))
    parts = [
        part("o", state["origin"]), part("d", F.when(state["arrive"], "a").otherwise("d")), part("t", state["slot"]), part("b", state["budget"]), part("w", state["walk_cap"]),
        part("r", state["room"]), part("n", F.when(state["tenure"] == "WOLSE", "w").otherwise("j")),
        F.when(state["cap"] > 0, part("c", state["cap"])), F.when(F.size(state["amenities"]) > 0, part("am", F.array_join(state["amenities"], ","))), F.when(state["flat_only"], F.lit("fl=1")),
    ]
    return F.concat_ws("&", *parts)


def state_of(text: Column | str) -> Column:
    """The state that a query string holds; what is missing, out of its range or unknown is null."""
    fields = F.str_to_map(F.regexp_replace(_c(text), "^#", ""), F.lit("&"), F.lit("="))
    get = lambda key: F.url_decode(F.try_element_at(fields, F.lit(key)))

    def number(key: str, low: int, high: int) -> Column:
        v = get(key).try_cast("double")
        return F.when(v.between(low, high), v).cast("int")

    known = F.filter(F.split(get("am"), ","), lambda c: F.regexp_like(c, F.lit("^[A-Z]{2}[0-9]$")))
    return F.struct(
        F.nullif(get("o"), F.lit("")).alias("origin"),
        F.when(get("d") == "a", True).when(get("d") == "d", False).alias("arrive"),
        number("t", 0, 200).alias("slot"),
        number("b", 10, 120).alias("budget"),
        number("w", 0, 15).alias("walk_cap"),
        F.when(get("r").isin("ONE", "TWO", "THREE"), get("r")).alias("room"),
        F.when(get("n") == "w", "WOLSE").when(get("n") == "j", "JEONSE").alias("tenure"),
        number("c", 0, 100_000).alias("cap"),
        known.alias("amenities"),
        F.when(get("fl").isNotNull(), get("fl") == "1").alias("flat_only"),
    )
