"""Scalar column expressions (all JVM-side built-ins, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and formats that must equal the reference behaviour.
CHARGE_LINE_PATTERN = "freight|tax|charge"
NON_ITEM_UNIT = "-"
FORMULA_PREFIXES = "^[=+@-]"
DAY_FIRST_FORMATS = ("d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "d-MMM-yyyy", "d MMM yyyy", "d-M-yy", "d/M/yy", "yyyy-MM-dd",
                     "d-MMM-yy", "d MMM yy", "d-MMMM-yyyy", "d MMMM yyyy", "d-MMMM-yy", "d MMMM yy")
CENTURY_PIVOT = 69  # two-digit years from here on lie in the last century
TIME_OF_DAY = r"[ T]+[0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?\s*$"
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
MACHINE_EPS = 2.220446049250313e-16


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_number(c: str | Column) -> Column:
    """Strip thousands separators; anything that is not a plain decimal number becomes NULL."""
    s = F.replace(col(c).cast("string"), F.lit(","), F.lit(""))
    return F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))


def parse_day_first_date(c: str | Column) -> Column:
    """Day-first date text -> DATE, trying an explicit ordered format list; a time of day is left out;
    two-digit years lie between 1969 and 2068; bad dates -> NULL.

    A failed try costs an exception, so a format is tried only where the text has what it asks for: its separator, letters or none,
    and digits for its year.
    """
    text = col(c).cast("string")
    s = F.trim(F.when(F.instr(text, ":") > 0, F.regexp_replace(text, TIME_OF_DAY, "")).otherwise(text))

    def parsed(fmt: str) -> Column:
        d = F.try_to_timestamp(s, F.lit(fmt)).cast("date")
        d = d if "yyyy" in fmt else F.when(F.year(d) < 2000 + CENTURY_PIVOT, d).otherwise(F.add_months(d, -1200))
        year = "^.{0,1}[0-9]{4}" if fmt.startswith("y") else "[0-9]{4}$" if "yyyy" in fmt else "[^0-9][0-9]{2}$"
        return F.when((F.instr(s, next(x for x in "-/. " if x in fmt)) > 0) & s.rlike(year), d)
    named = F.coalesce(*[parsed(x) for x in DAY_FIRST_FORMATS if "MMM" in x])
    return F.when(s.rlike("[A-Za-z]"), named).otherwise(F.coalesce(*[parsed(x) for x in DAY_FIRST_FORMATS if "MMM" not in x]))


def strip_text(c: str | Column) -> Column:
    """Python ``str.strip()``: removes Unicode whitespace at both ends (tab, NBSP too)."""
    return F.regexp_replace(col(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def normalise_name(c: str | Column, null_keys: str = "keep") -> Column:
    out = F.lower(strip_text(c))
    if null_keys == "literal":
        out = F.coalesce(out, F.lit("nan"))
    return out


def is_charge_line(item: str | Column) -> Column:
    """Lower-cased item contains freight/tax/charge (plain substring); NULL item is not."""
    return F.coalesce(F.lower(col(item)).rlike(CHARGE_LINE_PATTERN), F.lit(False))


def is_non_item_unit(unit: str | Column) -> Column:
    """Unit equal to '-' (NULL-safe, so a NULL unit is kept)."""
    return col(unit).eqNullSafe(F.lit(NON_ITEM_UNIT))


def sanitise_cell(c: str | Column) -> Column:
    """Prefix a quote to text that a spreadsheet would read as a formula."""
    c = col(c)
    return F.when(c.rlike(FORMULA_PREFIXES), F.concat(F.lit("'"), c)).otherwise(c)


def base_name(c: str | Column) -> Column:
    """Entity name without (...) and [...] parts (non-greedy), stripped."""
    no_paren = F.regexp_replace(col(c), r"\(.*?\)", "")
    return strip_text(F.regexp_replace(no_paren, r"\[.*?\]", ""))


def risk_colour(tier: str | Column) -> Column:
    """HIGH -> red, else MEDIUM -> yellow, else LOW -> green (first match wins)."""
    t = F.upper(F.coalesce(col(tier), F.lit("")))
    return (F.when(t.contains("HIGH"), F.lit("red"))
            .when(t.contains("MEDIUM"), F.lit("yellow"))
            .when(t.contains("LOW"), F.lit("green")))


def month_start(c: str | Column) -> Column:
    return F.trunc(col(c), "MM")


def counter_month(idx: str | Column) -> Column:
    """Calendar month derived from a month counter: (idx % 12) + 1."""
    return (col(idx) % 12 + 1).cast("int")


def counter_quarter(idx: str | Column) -> Column:
    """Quarter derived from a month counter: ((idx // 3) % 4) + 1."""
    return (F.floor(col(idx) / 3) % 4 + 1).cast("int")


def ape(actual: str | Column, pred: str | Column) -> Column:
    """Absolute percentage error with the denominator floored at machine epsilon."""
    a = col(actual)
    return F.abs(a - col(pred)) / F.greatest(F.abs(a), F.lit(MACHINE_EPS))


def money_sum(c: str | Column, scale: int = 2) -> Column:
    """Exact sum of a currency column: DECIMAL arithmetic at ``scale`` places, NULL-free (0 when empty)."""
    dec = f"decimal(18,{scale})"
    return F.coalesce(F.sum(col(c).cast(dec)), F.lit(0).cast(dec))


def mape_percent(frac: str | Column) -> Column:
    """A MAPE fraction as a percentage with 2 decimals, rounding half up on the binary value
    (``floor(x * 10000 + 0.5) / 100``) so every engine gets the same double."""
    return F.floor(col(frac) * 10000.0 + 0.5) / 100.0


def ceil_growth(c: str | Column, growth: float) -> Column:
    return F.ceil(col(c) * F.lit(growth)).cast("double")
