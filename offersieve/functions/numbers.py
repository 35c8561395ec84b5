"""Numbers: amounts, bands, rates, rounding, formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SALARY_EDGES = (3000, 4000, 5000, 6000)
#: Fewest values for which quantiles are shown.
MIN_SAMPLE = 5


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def valid_amount(c: Column) -> Column:
    """The amount if finite and not negative, else null."""
    return F.when(finite(c) >= 0, c)


def edges_of(edges: Sequence[float]) -> list[float]:
    out = sorted({e for e in edges if e == e and abs(e) != float("inf")})
    return [int(e) if float(e).is_integer() else e for e in out]


def _banded(c: Column, labels: list[tuple[float, str]], lowest: str) -> Column:
    out = F
    for edge, label in reversed(labels):
        out = out.when(c >= edge, F.lit(label))
    return out.otherwise(F.when(c.isNotNull(), F.lit(lowest)))


def band_of(c: Column, edges: Sequence[float]) -> Column:
    """Left-closed bands for grouping: <e0, lo–hi-1, ≥last; null without a value or edges."""
    e = edges_of(edges)
    if not e:
        return F.lit(None).cast("string")
    labels = [(lo, f"{lo}–{e[i + 1] - 1}" if i + 1 < len(e) else f"≥{lo}") for i, lo in enumerate(e)]
    return _banded(finite(c), labels, f"<{e[0]}")


def band_labels(edges: Sequence[float]) -> list[str]:
    e = edges_of(edges)
    return [f"<{e[0]}", *[f"{lo}–{e[i + 1] - 1}" if i + 1 < len(e) else f"≥{lo}" for i, lo in enumerate(e)]] if e else []


def salary_band_of(c: Column, edges: Sequence[float] = SALARY_EDGES) -> Column:
    """Bands of published reports: <3000, 3000-4000, … >=6000; null for negative amounts."""
    e = [x for x in edges_of(edges) if x >= 0]
    if not e:
        return F.lit(None).cast("string")
    labels = [(lo, f"{lo}-{e[i + 1]}" if i + 1 < len(e) else f">={lo}") for i, lo in enumerate(e)]
    return _banded(valid_amount(c), labels, f"<{e[0]}")


def cycle_band_of(days: Column, width: int = 10) -> Column:
    """0-9天, 10-19天, …; null for none or negative days."""
    low = (F.floor(days / width) * width).cast("int")
    return F.when(days >= 0, F.format_string("%d-%d天", low, low + (width - 1)))


def round_half_up(c: Column, digits: int = 2) -> Column:
    """Half goes towards plus infinity, for negative numbers too."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def rate(numerator: Column, denominator: Column) -> Column:
    """Null, not zero, without a denominator."""
    return F.when(denominator != 0, numerator.cast("double") / denominator.cast("double"))


def extract_amount(text: Column) -> Column:
    """The first number of a text, thousands separators removed."""
    return F.regexp_replace(F.nullif(F.regexp_extract(text, r"((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)", 1), F.lit("")), ",", "").try_cast("double")


def parse_edges(text: str) -> tuple[list[float], list[str]]:
    """Comma-separated edges (either comma) -> sorted distinct edges and the parts that are none."""
    good, bad = set(), []
    for part in text.replace("，", ",").split(","):
        part = part.strip()
        if not part:
            continue
        try:
            value = float(part)
            if not 0 <= value < float("inf"):
                raise ValueError(part)
            good.add(value)
        except ValueError:
            bad.append(part)
    return edges_of(sorted(good)), bad


def quantiles(c: Column, sufficient: Column | None = None) -> Column:
    """Exact p25, p50, p75 with linear interpolation, null if not sufficient."""
    q = F.percentile(c, [0.25, 0.5, 0.75])
    return q if sufficient is None else F.when(sufficient, q)


# ---------------------------------------------------------------- formats; — stands for missing
def percent_text(c: Column, digits: int = 1) -> Column:
    return F.coalesce(F.format_string(f"%.{digits}f%%", finite(c) * 100), F.lit("—"))


def integer_text(c: Column) -> Column:
    return F.coalesce(F.format_number(finite(c.cast("double")), 0), F.lit("—"))


def days_text(c: Column, digits: int = 1) -> Column:
    return F.coalesce(F.format_string(f"%.{digits}f 天", finite(c.cast("double"))), F.lit("—"))


def decimal_text(c: Column, digits: int = 2) -> Column:
    return F.coalesce(F.format_string(f"%.{digits}f", finite(c.cast("double"))), F.lit("—"))


def currency_text(c: Column, currency: str = "CNY", digits: int = 0) -> Column:
    sign = {"CNY": "¥"}.get(currency, currency + " ")
    return F.coalesce(F.concat(F.lit(sign), F.format_number(finite(c.cast("double")), digits)), F.lit("—"))


def date_text(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("—"))


def rate_cell(value: Column, numerator: Column, denominator: Column, suppressed: Column) -> Column:
    """12.34%（n ÷ d）, or — if suppressed or missing."""
    text = F.format_string("%.2f%%（%d ÷ %d）", value * 100, numerator.cast("long"), denominator.cast("long"))
    return F.when(suppressed | value.isNull(), F.lit("—")).otherwise(text)


def input_tokens(chars: Column) -> Column:
    """Rough token count of a prompt: characters by 1.5, rounded up."""
    return F.ceil(chars / 1.5)


def highest_cost(chars: Column, output_tokens: Column, input_price: float, output_price: float) -> Column:
    """The most that a request may cost, prices being those of a million tokens, without anything cached."""
    tokens = F.when(finite(chars.cast("double")) > 0, input_tokens(chars)).otherwise(0)
    return tokens / 1e6 * input_price + F.greatest(F.round(output_tokens), F.lit(0)) / 1e6 * output_price


def cost_text(cost: Column) -> Column:
    """Four places, as an upper bound."""
    return F.when(cost < 0.0001, F.lit("< 0.0001 元")).otherwise(F.format_string("%.4f 元", cost))


def salary_band_of_label(label: Column, edges: Sequence[float]) -> Column:
    """A group's label if the edges can give it as a band, else null."""
    return F.when(label.isin(band_labels(edges)), label)
