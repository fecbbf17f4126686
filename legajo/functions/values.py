"""Date, amount and identifier expressions (scalar rules of the engine)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from legajo.fixed_values import LOSS_KEYWORDS, LOSS_TYPES, MONTHS, NULL_TOKENS
from legajo.functions.text import ColumnLike, as_column, bound, is_blank, strip

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
PLAIN_NUMBER = r"^-?(\d+\.?\d*|\.\d+)$"


def to_number(value: ColumnLike, pattern: str = NUMBER) -> Column:
    """Text to double, null unless the whole trimmed text is a number."""
    return bound(
        strip(value), lambda text: F.when(text.rlike(pattern), text.try_cast("double"))
    )


def null_if_token(value: ColumnLike) -> Column:
    column = as_column(value)
    return F.when(~column.isin(NULL_TOKENS), column)


# --- amounts ------------------------------------------------------------------
def first_pass_amount(value: ColumnLike) -> Column:
    """Digits and separators only, thousands commas dropped; text if unreadable."""
    column = as_column(value)

    def reading(kept: Column) -> Column:
        number = to_number(F.replace(kept, F.lit(","), F.lit("")), PLAIN_NUMBER)
        fallback = F.when(kept == "", column).otherwise(kept)
        return F.struct(number.alias("number"), fallback.alias("text"))

    return bound(F.regexp_replace(column, r"[^\d.,\-]", ""), reading)


def clean_amount(value: ColumnLike) -> Column:
    """Both cleaning passes in order; double or null."""
    return bound(first_pass_amount(value), second_pass_amount)


def second_pass_amount(first: Column) -> Column:
    """The number of the first pass, else its text read with either decimal sign."""

    def second(kept: Column) -> Column:
        latin = F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        both = kept.contains(",") & kept.contains(".")
        return F.when(both, to_number(latin, PLAIN_NUMBER)).otherwise(
            to_number(F.replace(kept, F.lit(","), F.lit("")), PLAIN_NUMBER)
        )

    kept = F.regexp_replace(first["text"], r"[^\d.,\-]", "")
    return F.coalesce(first["number"], bound(kept, second))


def guided_amount(value: ColumnLike) -> Column:
    """Guided reading: drop ',' and '$', then number; null when unreadable."""
    column = as_column(value)
    return to_number(F.replace(F.replace(column, F.lit(","), F.lit("")), F.lit("$"), F.lit("")))


def number_text(value: ColumnLike) -> Column:
    """A double as the shortest text that reads back: 1234.5, 1234.0, 1e+16, 5e-05."""
    return bound(as_column(value), _number_text)


def _number_text(number: Column) -> Column:
    shown = number.cast("string")
    plain = F.regexp_replace(
        F.regexp_replace(shown.try_cast("decimal(38,20)").cast("string"), r"0+$", ""), r"\.$", ".0"
    )
    mantissa = F.regexp_replace(F.regexp_extract(shown, r"^([^E]+)", 1), r"\.0$", "")
    power = F.regexp_extract(shown, r"E(-?)(\d+)$", 2)
    sign = F.when(shown.contains("E-"), "-").otherwise("+")
    scientific = F.concat(
        mantissa, F.lit("e"), sign, F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power)
    )
    size = F.abs(number)
    ordinary = (number == 0) | ((size >= 1e-4) & (size < 1e16))
    return F.when(number.isNotNull(), F.when(ordinary, plain).otherwise(scientific))


def money(value: ColumnLike) -> Column:
    return as_column(value).try_cast("decimal(18,2)")


def display_money(value: ColumnLike) -> Column:
    """`$1,234.50 MXN` when the whole text is an amount, else squeezed text."""

    def shown(text: Column) -> Column:
        number = F.regexp_replace(text, r"[^\d.]", "").try_cast("double")
        formatted = F.concat(F.lit("$"), F.format_number(number, 2), F.lit(" MXN"))
        readable = text.rlike(r"^\$?\s?\d[\d,.]*$")
        return F.when(text == "", F.lit("")).otherwise(
            F.coalesce(F.when(readable, formatted), text)
        )

    given = strip(F.coalesce(as_column(value), F.lit("")))
    return bound(F.regexp_replace(given, r"(?U)\s+", " "), shown)


# --- dates --------------------------------------------------------------------
def _parsed(text: Column, guard: str, pattern: str) -> Column:
    return F.when(text.rlike(guard), F.try_to_timestamp(text, F.lit(pattern)).cast("date"))


def _two_digit_year(text: Column, guard: str, pattern: str) -> Column:
    return bound(
        _parsed(text, guard, pattern),
        lambda day: F.when(F.year(day) > 2068, F.add_months(day, -1200)).otherwise(day),
    )


def checked_date(value: ColumnLike) -> Column:
    """First of the five accepted formats that is a real calendar day."""
    return bound(
        strip(value),
        lambda text: F.coalesce(
            _parsed(text, r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
            _parsed(text, r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
            _parsed(text, r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
            _parsed(text, r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
            _parsed(text, r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
        ),
    )


def display_date(value: ColumnLike) -> Column:
    """DD/MM/YYYY from six formats or the first date of a range, else the text."""
    return bound(strip(F.coalesce(as_column(value), F.lit(""))), _display_date)


def _display_date(text: Column) -> Column:
    known = F.coalesce(
        _parsed(text, r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
        _parsed(text, r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        _parsed(text, r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
        _parsed(text, r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
        _two_digit_year(text, r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy"),
        _two_digit_year(text, r"^\d{1,2}-\d{1,2}-\d{2}$", "d-M-yy"),
    )
    day = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
    from_range = bound(
        F.regexp_extract(text, f"({day}).{{0,12}}({day})", 1),
        lambda start: _parsed(start, r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    )
    return F.coalesce(F.date_format(F.coalesce(known, from_range), "dd/MM/yyyy"), text)


def slashed_date(value: ColumnLike) -> Column:
    """Month names to numbers, then DD/MM/YYYY by shape alone (no calendar check)."""
    column = as_column(value)
    numbered = column
    for name, number in MONTHS.items():
        numbered = F.replace(numbered, F.lit(name), F.lit(number))

    def padded(day_first: Column) -> Column:
        parts = F.split(day_first, "/")
        return F.concat_ws(
            "/", F.lpad(F.get(parts, 0), 2, "0"), F.lpad(F.get(parts, 1), 2, "0"), F.get(parts, 2)
        )

    def slashed(text: Column) -> Column:
        iso = F.regexp_extract(text, r"^\d{4}-\d{2}-\d{2}", 0)
        day_first = F.regexp_extract(text, r"^\d{1,2}/\d{1,2}/\d{4}", 0)
        return (
            F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"),
                   F.regexp_replace(iso, r"(\d{4})-(\d{2})-(\d{2})", "$3/$2/$1"))
            .when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"), bound(day_first, padded))
            .otherwise(text)
        )

    # names need letters: most dates hold none
    text = F.when(column.rlike("[A-Z]{3}"), numbered).otherwise(column)
    return F.when(column == "", F.lit(None)).otherwise(bound(text, slashed))


def report_date(value: ColumnLike) -> Column:
    """Ten-character ISO dates reversed, other text as it is."""
    from legajo.fixed_values import NOT_SPECIFIED

    text = as_column(value)
    parts = F.split(text, "-")
    iso = (F.length(text) == 10) & (F.substring(text, 5, 1) == "-") & (F.size(parts) == 3)
    reversed_parts = F.concat_ws("/", F.get(parts, 2), F.get(parts, 1), F.get(parts, 0))
    return (
        F.when(is_blank(text), F.lit(NOT_SPECIFIED)).when(iso, reversed_parts).otherwise(text)
    )


# --- identifier checks: null means valid, otherwise the message ----------------
def rfc_error(value: ColumnLike, fixed: bool = False) -> Column:
    """Tax-id check; `fixed` reads the date right after the letters."""
    text = strip(F.upper(as_column(value)))
    if fixed:
        digits = F.regexp_extract(text, r"^[A-ZÑ&]{3,4}(\d{6})", 1)
        year, month, day = (F.substring(digits, at, 2) for at in (1, 3, 5))
    else:
        year, month, day = (F.substring(text, at, 2) for at in (5, 7, 9))
    as_int = [F.when(p.rlike(r"^\d{2}$"), p.cast("int")) for p in (year, month, day)]
    return (
        F.when(is_blank(value), F.lit("RFC vacío"))
        .when(
            ~text.rlike(r"^[A-ZÑ&]{3,4}\d{6}[A-Z\d]{3}$"),
            F.concat(F.lit("Formato inválido: "), text),
        )
        .when(
            as_int[0].isNull() | as_int[1].isNull() | as_int[2].isNull(),
            F.lit("Fecha no numérica en RFC"),
        )
        .when(~as_int[1].between(1, 12), F.concat(F.lit("Mes inválido: "), month))
        .when(~as_int[2].between(1, 31), F.concat(F.lit("Día inválido: "), day))
    )


def policy_error(value: ColumnLike) -> Column:
    text = strip(value)
    return (
        F.when(is_blank(value), F.lit("Número de póliza vacío"))
        .when(~text.rlike(r"(?U)\d"), F.lit("No contiene números"))
        .when(F.length(text) < 3, F.lit("Muy corto (< 3 caracteres)"))
        .when(F.length(text) > 50, F.lit("Muy largo (> 50 caracteres)"))
        .when(text.rlike(r"(?U)[^\w\s\-/]"), F.lit("Contiene caracteres no válidos"))
    )


def amount_error(value: ColumnLike) -> Column:
    column = as_column(value)
    text = column
    for part in (",", "$", "MXN", "MN"):
        text = F.replace(text, F.lit(part), F.lit(""))
    number = to_number(text)
    return (
        F.when(column.isNull(), F.lit("Monto nulo"))
        .when(number.isNull(), F.concat(F.lit("No se pudo convertir a número: "), column))
        .when(number <= 0, F.lit("Monto debe ser positivo"))
        .when(number > 1_000_000_000, F.lit("Monto excesivamente alto"))
    )


def date_error(
    value: ColumnLike, first_year: int = 2000, last_year: int = 2030, year: Column | None = None
) -> Column:
    """Date check; ``year`` saves reading the date again."""
    column = as_column(value)
    year = F.year(checked_date(column)) if year is None else year
    return (
        F.when(is_blank(column), F.lit("Fecha vacía"))
        .when(year.isNull(), F.concat(F.lit("Formato de fecha no reconocido: "), column))
        .when(year < first_year, F.concat(F.lit("Año muy antiguo: "), year))
        .when(year > last_year, F.concat(F.lit("Año muy futuro: "), year))
    )


def float_error(
    value: ColumnLike, minimum: float | None = None, number: Column | None = None
) -> Column:
    number = to_number(value) if number is None else number
    error = F.when(number.isNull(), F.lit("No es un número válido"))
    if minimum is not None:
        error = error.when(number < minimum, F.lit(f"Valor menor al mínimo ({minimum})"))
    return error


def loss_type(value: ColumnLike) -> Column:
    """Catalogue entry, first in catalogue order, then keyword map, else the text."""
    column = as_column(value)

    def listed(text: Column) -> Column:
        result = F.when(is_blank(text), F.lit(None))
        for entries in LOSS_TYPES.values():
            for entry in entries:
                low = entry.lower()
                result = result.when(
                    text.contains(low) | F.lit(low).contains(text), F.lit(entry)
                )
        for keyword, entry in LOSS_KEYWORDS.items():
            result = result.when(text.contains(keyword), F.lit(entry))
        return result

    return F.when(~is_blank(column), F.coalesce(bound(F.lower(column), listed), column))
