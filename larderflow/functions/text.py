"""Column functions on text and amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1c-\x1f]"
# The code points of that class: controls, then spaces and separators of Unicode.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x20), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Without white space of any script at either end (trim() only knows the space); no pattern, as it runs on every row."""
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """Tokens between runs of white space; no token for a blank text."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def strip_chars(text: Column, chars: str) -> Column:
    """Without any of ``chars`` at either end."""
    return F.btrim(text, F.lit(chars))


def blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def unit_key(unit: Column) -> Column:
    """Lower case, one trailing s less; a missing unit is the empty unit."""
    return F.regexp_replace(F.lower(strip(F.coalesce(unit, F.lit("")))), r"s\z", "")


def _six_digits(q: Column, digits: Column) -> Column:
    """|q| with ``digits`` decimals, rounded by its exact binary value with ties to even, as text without trailing zeros.

    The shortest decimal of a double may end in a 5 that its binary value isn't
    quite; then mantissa and power of two are compared with the tie in integers.
    """
    at = lambda values, kind, n: F.element_at(F.array(*[F.lit(str(v)).cast(kind) for v in values]), F.greatest(F.lit(1), F.least(F.lit(len(values)), n)))
    ten = at([10**k for k in range(10)], "decimal(10,0)", digits + 1)
    scaled = F.abs(q).cast("decimal(27,20)") * ten
    low = F.floor(scaled).cast("decimal(9,0)")
    rest = scaled - low
    # |q| = m / 2^p with whole m below 2^54, for numbers between 1e-4 and 1e6
    p = (F.lit(53) - F.floor(F.log2(F.abs(q)))).cast("int")
    m = (F.abs(q) * F.pow(F.lit(2.0), p)).cast("decimal(17,0)")
    exact, tie = m * (ten * 2).cast("decimal(11,0)"), (low * 2 + 1).cast("decimal(10,0)") * at([2**k for k in range(30, 72)], "decimal(22,0)", p - 29)
    up = F.when(rest != 0.5, rest > 0.5).when(exact != tie, exact > tie).otherwise(low % 2 == 1)
    number = (low.cast("bigint") + up.cast("bigint")).cast("string")
    padded = F.lpad(number, F.greatest(F.length(number), digits + 1), F.lit("0"))
    text = F.concat(F.substring(padded, F.lit(1), F.length(padded) - digits), F.lit("."), F.right(padded, digits))
    return F.regexp_replace(text, r"\.?0*\z", "")


def _exponent(q: Column) -> Column:
    """Six digits in scientific form, for numbers below 1e-4 or from 1e6."""
    magnitude = F.floor(F.log10(F.abs(q)))
    mantissa = F.round(q / F.pow(F.lit(10.0), magnitude), 5)
    # rounding may carry into the next power of ten
    carried = F.abs(mantissa) >= 10
    magnitude = F.when(carried, magnitude + 1).otherwise(magnitude).cast("int")
    digits = F.regexp_replace(F.when(carried, mantissa / 10).otherwise(mantissa).cast("decimal(7,5)").cast("string"), r"\.?0+\z", "")
    return F.concat(digits, F.when(magnitude < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(magnitude).cast("string"), 2, "0"))


def format_quantity(q: Column) -> Column:
    """'' for null, integers plainly, else six significant digits without trailing zeros, with an exponent below 1e-4 or from 1e6."""
    size = F.abs(q)
    # 999999.5 and above round up to a seventh digit
    digits = (F.lit(5) - F.floor(F.log10(size)).cast("int")).cast("int")
    plain = F.concat(F.when(q < 0, F.lit("-")).otherwise(F.lit("")), _six_digits(q, digits))
    whole = (q == F.floor(q)) & (size < 1e18)
    return (
        F.when(q.isNull(), F.lit("")).when(F.isnan(q), F.lit("nan")).when(whole, q.try_cast("bigint").cast("string"))
        .when((size >= 1e-4) & (size < 999999.5), plain).otherwise(_exponent(q))
    )


def format_amount(q: Column, unit: Column) -> Column:
    """Quantity and unit with one space between what there is of them."""
    amount = format_quantity(q)
    return F.when(F.coalesce(unit, F.lit("")) != "", strip(F.concat(amount, F.lit(" "), unit))).otherwise(amount)


def to_double(text: Column) -> Column:
    return text.try_cast("double")


def clean_unit(unit: Column) -> Column:
    return F.nullif(strip(unit), F.lit(""))


def join_notes(*parts: Column) -> Column:
    """What isn't blank, stripped, comma-separated."""
    return F.array_join(F.filter(F.array(*[F.coalesce(strip(p), F.lit("")) for p in parts]), lambda p: p != ""), ", ")


def name_words(name: Column) -> Column:
    """The distinct lower-case words of a name, each with one trailing s less."""
    plain = F.regexp_replace(F.lower(name), "[^a-z0-9 ]", " ")
    return F.array_distinct(F.transform(F.filter(F.split(plain, " +"), lambda w: w != ""), lambda w: F.regexp_replace(w, r"s\z", "")))


def csv_field(text: Column) -> Column:
    """Quoted if it holds a comma, quote or line end."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\r\n]'), quoted).otherwise(text)


def json_object(raw: Column) -> Column:
    """The text as a JSON object, or an empty one if it is anything else."""
    v = F.try_parse_json(raw)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v).otherwise(F.parse_json(F.lit("{}")))
