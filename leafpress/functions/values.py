"""Codecs and units: tri-state flags, measures, colours, numbers in letters, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafpress.functions.text import col

# EMU in each unit of length.
EMU = {"in": 914400, "cm": 360000, "mm": 36000, "pt": 12700, "pc": 152400, "px": 9525, "pi": 152400}
TWIPS_PER_POINT = 20
# Roman numerals.
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def on_off(c: Column | str, present: Column | None = None) -> Column:
    """Absent is null; a present element without a value, 1, true and on are true; 0, false and off are false."""
    v = F.lower(F.trim(col(c)))
    known = F.when(v.isin("1", "true", "on"), True).when(v.isin("0", "false", "off"), False)
    return known if present is None else F.when(present, F.when(col(c).isNull(), True).otherwise(known))


def hex_colour(c: Column | str) -> Column:
    """struct(auto, rgb, raw): the automatic colour, six hex digits in capitals, or the text as it came."""
    v = col(c)
    return F.struct((v == "auto").alias("auto"), F.when(v.rlike("^[0-9A-Fa-f]{6}$"), F.upper(v)).alias("rgb"), F.when((v != "auto") & ~v.rlike("^[0-9A-Fa-f]{6}$"), v).alias("raw"))


def value_or_raw(c: Column | str, kind: str) -> Column:
    """struct(value, raw): the typed value, or the text that can't be one."""
    v = col(c).try_cast(kind)
    return F.struct(v.alias("value"), F.when(v.isNull(), col(c)).alias("raw"))


def channel(c: Column | str, i: int) -> Column:
    return F.conv(F.substring(col(c), 2 * i + 1, 2), 16, 10).cast("int")


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    return F.upper(F.concat(*[F.lpad(F.hex(x.cast("long")), 2, "0") for x in (r, g, b)]))


def tint_shade(rgb: Column | str, tint: Column | None = None, shade: Column | None = None) -> Column:
    """A shade (0 to 255) darkens each channel in proportion, then a tint moves it towards white."""
    out = []
    for i in range(3):
        x = channel(rgb, i).cast("double")
        x = x if shade is None else F.when(shade.isNull(), x).otherwise(x * shade / 255)
        x = x if tint is None else F.when(tint.isNull(), x).otherwise(x * tint / 255 + (255 - tint))
        out.append(F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x + 0.5))))
    return rgb_hex(*out)


def mean_colour(colours: Column | str) -> Column:
    """The mean of an array of rgb texts, channel by channel, rounded half up."""
    c = col(colours)

    def total(i: int) -> Column:
        return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + channel(x, i).cast("long"))

    mean = [F.floor(total(i) / F.size(c) + 0.5) for i in range(3)]
    return F.when(F.size(c) > 0, rgb_hex(*mean))


def emu(amount: Column, unit: str) -> Column:
    return F.floor(amount * EMU[unit] + 0.5).cast("long")


def from_emu(amount: Column, unit: str) -> Column:
    return amount / F.lit(float(EMU[unit]))


def parse_length(c: Column | str) -> Column:
    """A text such as 12pt or 1.5in, in EMU; a bare number counts as pixels; null if it is none."""
    v = F.lower(F.trim(col(c)))
    number = F.regexp_extract(v, r"^([+-]?[0-9]*\.?[0-9]+)\s*(in|cm|mm|pt|pc|pi|px)?$", 1).try_cast("double")
    unit = F.regexp_extract(v, r"^[+-]?[0-9]*\.?[0-9]+\s*(in|cm|mm|pt|pc|pi|px)?$", 1)
    factor = F.create_map(*[F.lit(x) for kv in EMU.items() for x in kv])[F.when(unit == "", "px").otherwise(unit)]
    return F.floor(number * factor + 0.5).cast("long")


def parse_measure(c: Column | str, per_point: int) -> Column:
    """A measure with a unit suffix, in units of which a point has per_point; a bare integer is taken as it is."""
    v = F.trim(col(c))
    number = F.regexp_extract(v, r"^([+-]?[0-9]*\.?[0-9]+)(mm|cm|in|pt|pc|pi)$", 1).try_cast("double")
    unit = F.regexp_extract(v, r"(mm|cm|in|pt|pc|pi)$", 1)
    points = F.create_map(*[F.lit(x) for k, n in EMU.items() for x in (k, n / EMU["pt"])])
    return F.when(v.rlike("^[+-]?[0-9]+$"), v.try_cast("long")).otherwise(F.floor(number * points[unit] * per_point + 0.5).cast("long"))


def style_pairs(c: Column | str) -> Column:
    """'k:v;k:v' as a map; keys in lower case, blanks trimmed."""
    m = F.str_to_map(F.regexp_replace(F.regexp_replace(col(c), r"\s*([:;])\s*", "$1"), ";+$", ""), F.lit(";"), F.lit(":"))
    return F.transform_keys(m, lambda k, v: F.lower(F.trim(k)))


def serial_date(c: Column | str) -> Column:
    """The date of a spreadsheet serial number."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(col(c)).cast("int"))


def roman(n: Column | str) -> Column:
    """Roman numerals of 1 to 3999; null outside."""
    n = col(n).cast("int")
    digits = [(1000, ["", "M", "MM", "MMM"])] + [
        (b, ["", x, x * 2, x * 3, x + y, y, y + x, y + x * 2, y + x * 3, x + z]) for b, x, y, z in ((100, "C", "D", "M"), (10, "X", "L", "C"), (1, "I", "V", "X"))
    ]
    out = [F.element_at(F.array(*[F.lit(t) for t in table]), (F.floor(n / b) % 10 + 1).cast("int")) for b, table in digits]
    return F.when((n >= 1) & (n <= 3999), F.concat(*out))


def letters(n: Column | str) -> Column:
    """a to z, then aa, bb, ...: the letter of (n - 1) mod 26, repeated; null under 1."""
    n = col(n).cast("int")
    return F.when(n >= 1, F.repeat(F.char((n - 1) % 26 + 97), (F.floor((n - 1) / 26) + 1).cast("int")))


def format_number(kind: Column | str, n: Column | str) -> Column:
    """A counter in a number format; null for a format that isn't known."""
    k, n = col(kind), col(n).cast("int")
    return (
        F.when(k == "decimal", n.cast("string")).when(k == "decimalZero", F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string")))
        .when(k == "upperRoman", roman(n)).when(k == "lowerRoman", F.lower(roman(n))).when(k == "upperLetter", F.upper(letters(n))).when(k == "lowerLetter", letters(n)).when(k == "none", F.lit(""))
    )


def language_font(lang: Column | str) -> Column:
    """The East Asian face that an empty theme slot falls back to."""
    v = F.lower(col(lang))
    # Faces by language.
    return F.when(v.startswith("ja"), "MS Mincho").when(v.startswith("ko"), "Batang").when(v.isin("zh-tw", "zh-hk", "zh-mo"), "PMingLiU").when(v.startswith("zh"), "SimSun")


def signature_mime(content: Column | str) -> Column:
    """The kind of an image by its first bytes; null if none is known."""
    h = F.hex(F.substring(col(content), 1, 12))
    # Signatures.
    return (
        F.when(h.startswith("89504E470D0A1A0A"), "image/png").when(h.startswith("FFD8FF"), "image/jpeg").when(h.startswith("474946383761") | h.startswith("474946383961"), "image/gif")
        .when(h.startswith("52494646") & h.endswith("57454250"), "image/webp").when(h.startswith("49492A00") | h.startswith("4D4D002A"), "image/tiff").when(h.startswith("424D"), "image/bmp")
    )


def transform_colour(rgb: Column | str, transforms: list[tuple[str, float]]) -> Column:
    """Colour transforms in order on an rgb text: lumMod, lumOff, satMod, satOff, hueOff, tint, shade (shares of 1; hue in turns)."""
    r, g, b = (channel(rgb, i) / F.lit(255.0) for i in range(3))
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = hi - lo
    light = (hi + lo) / 2
    sat = F.when(d == 0, 0.0).otherwise(F.try_divide(d, 1 - F.abs(2 * light - 1)))
    turn = F.when(d == 0, 0.0).when(hi == r, F.pmod(F.try_divide(g - b, d), F.lit(6.0))).when(hi == g, F.try_divide(b - r, d) + 2).otherwise(F.try_divide(r - g, d) + 4) / 6
    clamp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    for kind, x in transforms:
        if kind == "lumMod":
            light = clamp(light * x)
        elif kind == "lumOff":
            light = clamp(light + x)
        elif kind == "satMod":
            sat = clamp(sat * x)
        elif kind == "satOff":
            sat = clamp(sat + x)
        elif kind == "hueOff":
            turn = F.pmod(turn + x, F.lit(1.0))
        elif kind == "shade":
            light = clamp(light * x)
        elif kind == "tint":
            light = clamp(light * x + (1 - x))
        else:
            raise ValueError(f"unknown transform {kind}")
    c = (1 - F.abs(2 * light - 1)) * sat
    m = light - c / 2

    six = F.pmod(turn * 6, F.lit(6.0))
    shares = (F.abs(six - 3) - 1, 2 - F.abs(six - 2), 2 - F.abs(six - 4))
    return rgb_hex(*[F.floor((m + c * clamp(k)) * 255 + 0.5) for k in shares])
