"""Small column functions: forms of numbers, times and symbols, range checks, look-ups, threat scores, pattern and transition scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.text import fixed, nearest
from tickloom.operators.strategies import at_least, at_most, points

# Production regions of commodities, marks of automated clients.
REGIONS = {
    "C": ("Iowa", "Illinois", "Nebraska", "Minnesota"), "S": ("Illinois", "Iowa", "Minnesota", "Indiana"), "W": ("Kansas", "North Dakota", "Montana", "Washington"), "SB": ("Brazil", "India", "China", "Thailand"),
    "CC": ("Ivory Coast", "Ghana", "Ecuador", "Brazil"), "KC": ("Brazil", "Vietnam", "Colombia", "Indonesia"), "CT": ("China", "India", "United States", "Pakistan"),
}
AGENTS = ("bot", "crawler", "spider", "scraper", "curl", "wget", "python-requests", "nikto", "sqlmap", "nmap")


def listed(key: Column, values: dict[str, tuple[str, ...]], other: tuple[str, ...]) -> Column:
    """The list of a key."""
    array = lambda x: F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<string>")
    out = array(other)
    for name, items in values.items():
        out = F.when(key == name, array(items)).otherwise(out)
    return out


def format_percentage(value: Column, digits: int = 2, sign: bool = True) -> Column:
    """A share up to 1 in size counts as such, more as percent; rises with a plus."""
    percent = F.when(F.abs(value) > 1, value).otherwise(value * 100)
    text = F.concat(fixed(nearest(percent, digits), digits), F.lit("%"))
    return F.when(F.lit(sign) & (percent > 0), F.concat(F.lit("+"), text)).otherwise(text)


def format_number(value: Column, digits: int = 2, thousands: bool = True) -> Column:
    return fixed(value, digits, thousands)


def format_timestamp(ts: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(ts, pattern)


def in_range(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """False for null and nan too."""
    out = value.isNotNull() & ~F.isnan(value)
    out = out & (value >= low) if low is not None else out
    return F.coalesce(out & (value <= high) if high is not None else out, F.lit(False))


def exchange_symbol(symbol: Column) -> Column:
    """BASE/QUOTE and BASE-QUOTE in one word of capitals."""
    return F.upper(F.regexp_replace(symbol, "[/-]", ""))


def growing_stage(commodity: Column, month: Column) -> Column:
    stage = F.when(month.between(3, 5), "Planting").when(month.between(6, 8), "Growing").when(month.between(9, 11), "Harvest").otherwise("Dormant")
    return F.when(commodity.isin("C", "S"), stage).otherwise("Unknown")


def suspicious_agent(agent: Column) -> Column:
    low = F.lower(F.coalesce(agent, F.lit("")))
    return F.exists(F.array(*[F.lit(x) for x in AGENTS]), lambda x: F.contains(low, x))


def threat_level(bad_address: Column, bad_agent: Column, bad_requests: Column, bad_place: Column) -> Column:
    score = points((bad_address, 30.0), (bad_agent, 20.0), (bad_requests, 25.0), (bad_place, 15.0), most=None)
    return F.when(score >= 70, "CRITICAL").when(score >= 50, "HIGH").when(score >= 30, "MEDIUM").otherwise("LOW")


def transition_probability(high_volatility: Column, transitions: Column, rsi: Column, duration: Column, consistency: Column) -> Column:
    return points((high_volatility, 0.3), (transitions > 2, 0.2), ((rsi > 80) | (rsi < 20), 0.2), (duration > 30, 0.1), (consistency < 0.3, 0.1))


def triangle_confidence(kind: Column, peak_slope: Column, valley_slope: Column) -> Column:
    """How flat the flat side is and how steep the other, for a symmetrical one how alike both slopes are; in 0.1..0.95."""
    flat, steep = lambda s: at_least(1 - F.abs(s) * 1000, 0.0), lambda s: at_most(s * 500, 1.0)
    up, down = (flat(peak_slope) + steep(valley_slope)) / 2, (steep(F.abs(peak_slope)) + flat(valley_slope)) / 2
    both = at_least(1 - F.abs(F.abs(peak_slope) - F.abs(valley_slope)) * 1000, 0.0)
    return at_least(at_most(F.when(kind == "ascending", up).when(kind == "descending", down).otherwise(both), 0.95), 0.1)


def reliability(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "VERY_HIGH").when(confidence >= 0.8, "HIGH").when(confidence >= 0.6, "MEDIUM").when(confidence >= 0.4, "LOW").otherwise("VERY_LOW")


def crossing(slope_a: Column, level_a: Column, slope_b: Column, level_b: Column) -> Column:
    """Where two lines meet; null if they are parallel."""
    return F.when(F.abs(slope_a - slope_b) > 1e-10, (level_b - level_a) / (slope_a - slope_b))
