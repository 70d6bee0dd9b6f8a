"""Text and number helpers as pure column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as white space when text is trimmed.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression, so that it is not computed per use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def head_bytes(c: Column, n: int) -> Column:
    """The first n bytes of a text; a character cut in two becomes U+FFFD."""
    return F.make_valid_utf8(F.substring(F.encode(c, "UTF-8"), 1, n).cast("string"))


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """Words joined by single blanks."""
    return trim_space(F.regexp_replace(c, f"{SPACE}+", " "))


def normalize_text(c: Column) -> Column:
    """Trim, then runs of ASCII white space become one blank."""
    return F.regexp_replace(trim_space(c), r"[\t\n\f\r ]+", " ")


def first_non_empty(*cols: Column) -> Column:
    """First value that is not blank, normalised; '' when there is none."""
    return F.coalesce(*[F.nullif(normalize_text(c), F.lit("")) for c in cols], F.lit(""))


def price_amount(c: Column) -> Column:
    """Number after a currency sign, else every digit and dot of the text."""
    s = normalize_text(c)
    hit = F.regexp_extract(s, r"[¥$€£][\t\n\f\r ]*([0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(hit != "", hit).otherwise(F.regexp_replace(s, r"[^\p{Nd}.]", ""))


def price_currency(c: Column) -> Column:
    """Currency of a signed number, read from the same text as its amount; '' without one."""
    signed = normalize_text(c).rlike(r"[¥$€£][\t\n\f\r ]*[0-9]")
    return (
        F.when(~signed, "")
        .when(c.contains("$"), "USD")
        .when(c.contains("€"), "EUR")
        .when(c.contains("£"), "GBP")
        .otherwise("CNY")
    )


def round_half_up(c: Column, digits: int) -> Column:
    """Round a non-negative number by truncating c * 10^digits + 0.5."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def fail_tone(rate: Column) -> Column:
    """bad above 10 %, warn above 5 %; rates up to 1 are fractions, larger ones percents."""
    pct = F.when(F.coalesce(rate, F.lit(0.0)) <= 1, F.coalesce(rate, F.lit(0.0)) * 100).otherwise(rate)
    return F.when(pct > 10, "bad").when(pct > 5, "warn").otherwise("ok")


def backoff_ms(attempt: Column, base_ms: Column | None = None) -> Column:
    """Wait before a retry: base * 2^attempt, attempt within 0..6, at most 8 s."""
    base = F.lit(None).cast("double") if base_ms is None else base_ms.cast("double")
    base = F.when(base > 0, base).otherwise(F.lit(200.0))
    step = F.greatest(F.lit(0), F.least(F.lit(6), attempt)).cast("double")
    return F.least(base * F.pow(F.lit(2.0), step), F.lit(8000.0))


def retryable(status: Column, error: Column) -> Column:
    """Transport error or one of the retry statuses."""
    return error.isNotNull() | status.isin(429, 502, 503, 504)


def blocked(status: Column) -> Column:
    return status.isin(429, 403)


def failed(status: Column) -> Column:
    """Counts as failure: status from 400 on, or blocked (P5)."""
    return (status >= 400) | blocked(status)


def looks_like_html(body: Column, content_type: Column) -> Column:
    """Content type names html, or a doctype / html tag stands in the first 256 bytes."""
    head = F.lower(head_bytes(body, 256))
    return F.contains(F.lower(content_type), F.lit("html")) | head.contains("<html") | head.contains("<!doctype")


def is_safe_ident(c: Column) -> Column:
    """Usable as a CSS name without quoting."""
    return F.coalesce(c, F.lit("")).rlike(r"^[A-Za-z_-][A-Za-z0-9_-]*\z")


def css_to_xpath(css: Column) -> Column:
    """Rough translation of a simple CSS selector."""
    s = trim_space(css)
    name = F.substring(s, 2, 2**31 - 1)
    by_class = F.concat(
        F.lit("//*[contains(concat(' ', normalize-space(@class), ' '), ' "), name, F.lit(" ')]")
    )
    return (
        F.when(s.startswith("#") & is_safe_ident(name), F.concat(F.lit("//*[@id='"), name, F.lit("']")))
        .when(s.startswith(".") & is_safe_ident(name), by_class)
        .otherwise(F.concat(F.lit("//"), s))
    )


def json_long(m: Column, key: str) -> Column:
    """Counter value in a string map: a number, cut to a whole one; 0 when absent (F16)."""
    return F.coalesce(F.element_at(m, F.lit(key)).try_cast("double").cast("bigint"), F.lit(0).cast("bigint"))


def json_add(m: Column, key: str, delta: Column) -> Column:
    """The map with one counter raised by delta (F16)."""
    base = F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, _: k != key)
    return F.map_concat(base, F.create_map(F.lit(key), (json_long(m, key) + delta).cast("string")))


def add_stats(a: Column, b: Column) -> Column:
    """Sum two counter maps key by key."""
    zero = F.lit(0).cast("bigint")
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))


def candidate_score(kind: Column, expr: Column, hits: Column) -> Column:
    """Quality of a selector between 0.05 and 1."""
    base = (
        F.when(expr.startswith("#") | expr.contains("[@id="), 0.98)
        .when(expr.contains("data-"), 0.93)
        .when(expr.contains(".") & ~expr.contains("nth-child"), 0.82)
        .when(expr.contains("["), 0.7)
        .otherwise(0.45)
    )
    by_hits = F.when(hits == 1, 0.05).when(hits > 1, -0.15).otherwise(0.0)
    by_kind = F.when(kind == "xpath", -0.04).otherwise(0.0)
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), base + by_hits + by_kind))


def clip_box(x: Column, y: Column, w: Column, h: Column, width: float, height: float) -> Column:
    """Part of a box inside the viewport."""
    x0, y0 = F.greatest(x, F.lit(0.0)), F.greatest(y, F.lit(0.0))
    w1 = w + F.least(x, F.lit(0.0))
    h1 = h + F.least(y, F.lit(0.0))
    w2 = F.greatest(F.when(x0 + w1 > width, F.lit(width) - x0).otherwise(w1), F.lit(0.0))
    h2 = F.greatest(F.when(y0 + h1 > height, F.lit(height) - y0).otherwise(h1), F.lit(0.0))
    return F.struct(x0.alias("x"), y0.alias("y"), w2.alias("w"), h2.alias("h"))
