"""Text of news and posts as column expressions: cleaning, lexicon scores, symbols, tags, hashes, buckets. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A small lexicon of finance words with weights, stop tickers, and keyword groups by category in order of precedence.
LEXICON = {"bull": 0.6, "bullish": 0.8, "buy": 0.5, "gain": 0.5, "growth": 0.5, "profit": 0.6, "rally": 0.7, "strong": 0.4, "surge": 0.8, "up": 0.3, "bear": -0.6, "bearish": -0.8, "crash": -0.9, "decline": -0.5, "down": -0.3, "drop": -0.5, "fear": -0.6, "loss": -0.6, "risk": -0.3, "sell": -0.5, "weak": -0.4}
STOP_TICKERS = ("A", "AND", "ARE", "CEO", "FOR", "I", "IPO", "IS", "IT", "NEW", "OF", "ON", "THE", "TO", "USA", "USD")
CATEGORIES = {"EARNINGS": ("earnings", "revenue", "quarter"), "MERGER": ("merger", "acquisition"), "REGULATION": ("regulation", "lawsuit"), "MARKET": ("market", "trading", "index"), "TECHNOLOGY": ("software", "technology"), "CRYPTO": ("bitcoin", "crypto")}


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def nearest(value: Column, digits: int) -> Column:
    """The double to so many digits as the SQL rounds it: scaled, halves away from zero. Spark's round reads the shortest decimal form instead, which takes 1.005 for a half."""
    scaled = F.round(value * 10.0**digits)
    return F.when(F.abs(scaled) < float("inf"), scaled / 10.0**digits).otherwise(value)


def fixed(value: Column, digits: int, thousands: bool = False) -> Column:
    """The double with so many digits as the SQL writes it: null stays null, what is not finite is nan, inf or -inf."""
    written = F.format_number(value, digits) if thousands else F.format_string(f"%.{digits}f", value)
    return F.when(F.abs(value) < float("inf"), written).otherwise(F.replace(F.lower(value.cast("string")), F.lit("inity")))


def clean(text: Column) -> Column:
    """Without links, at and hash signs; runs of white space as one blank; lower case."""
    bare = F.regexp_replace(F.regexp_replace(_text(text), r"https?://\S+", ""), r"[@#]", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters of the clean text."""
    return F.regexp_extract_all(clean(text), F.lit(r"([a-z]+)"), 1)


def lexicon_score(text: Column, lexicon: dict[str, float] | None = None) -> Column:
    """Mean weight of the tokens that the lexicon has, each as often as it comes; 0 without any."""
    weights = F.create_map(*[F.lit(x) for pair in (lexicon or LEXICON).items() for x in pair])
    found = F.filter(F.transform(tokens(text), lambda t: F.try_element_at(weights, t)), lambda w: w.isNotNull())
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda s, w: s + w) / F.size(found)).otherwise(0.0)


def substring_score(text: Column, lexicon: dict[str, float] | None = None) -> Column:
    """Mean weight of lexicon words that stand anywhere in the text, also inside a word, to 9 digits; 0 without any."""
    low = F.lower(_text(text))
    hits = [F.contains(low, F.lit(k)) for k in (lexicon or LEXICON)]
    total = sum((F.when(h, w).otherwise(0.0) for h, w in zip(hits, (lexicon or LEXICON).values(), strict=True)), F.lit(0.0))
    n = sum((h.cast("int") for h in hits), F.lit(0))
    return F.when(n > 0, F.round(total / n, 9)).otherwise(0.0)


def label(score: Column) -> Column:
    """Five labels, cut at -0.6, -0.2, 0.2 and 0.6."""
    return F.when(score <= -0.6, "VERY_BEARISH").when(score <= -0.2, "BEARISH").when(score <= 0.2, "NEUTRAL").when(score <= 0.6, "BULLISH").otherwise("VERY_BULLISH")


def agreement(scores: list[Column]) -> Column:
    """1 less the population variance of several scores, in 0.1..1."""
    mean = sum(scores[1:], scores[0]) / len(scores)
    parts = [(s - mean) * (s - mean) for s in scores]
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1 - sum(parts[1:], parts[0]) / len(scores)))


def fear_greed(score: Column, confidence: Column, sources: Column) -> Column:
    """(score + 1) * 50 + (confidence - 0.5) * 20 + sources / 4 * 10, in 0..100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (score + 1) * 50 + (confidence - 0.5) * 20 + sources / 4 * 10))


def trading_signal(score: Column, confidence: Column) -> Column:
    return F.when((score > 0.4) & (confidence > 0.6), "BUY").when((score < -0.4) & (confidence > 0.6), "SELL").otherwise("HOLD")


def content_hash(*parts: Column) -> Column:
    """MD5 of the parts in lower case, white space as one blank."""
    joined = F.concat_ws(" ", *[_text(p) for p in parts])
    return F.md5(F.trim(F.regexp_replace(F.lower(joined), r"\s+", " ")))


def hashtags(text: Column) -> Column:
    """Tags in lower case, repeats kept."""
    return F.transform(F.regexp_extract_all(_text(text), F.lit(r"#(\w+)"), 1), F.lower)


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(r"@(\w+)"), 1)


def symbols(text: Column) -> Column:
    """Tickers: $ABC, (ABC) and capitals of 2 to 5 letters, distinct, without stop tickers."""
    found = [F.regexp_extract_all(_text(text), F.lit(p), 1) for p in (r"\$([A-Z]{1,5})\b", r"\(([A-Z]{2,5})\)", r"\b([A-Z]{2,5})\b")]
    return F.array_sort(F.array_except(F.array_distinct(F.flatten(F.array(*found))), F.array(*[F.lit(x) for x in STOP_TICKERS])))


def keywords(text: Column, known: list[str], most: int = 10) -> Column:
    """Known words among the tokens, distinct, the first `most` by name."""
    return F.slice(F.array_sort(F.array_intersect(tokens(text), F.array(*[F.lit(k) for k in known]))), 1, most)


def category(text: Column) -> Column:
    """The first category of which a keyword stands in the text, else GENERAL."""
    low, out = F.lower(_text(text)), None
    for name, words in CATEGORIES.items():
        hit = F.contains(low, F.lit(words[0]))
        for word in words[1:]:
            hit = hit | F.contains(low, F.lit(word))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("GENERAL")


def recency(published: Column, as_of: Column) -> Column:
    """1 under an hour, 0.8 under 6, 0.6 under 24, 0.4 under 72, else 0.2; to the microsecond."""
    age, under = as_of - published, lambda n: F.make_dt_interval(hours=F.lit(n))
    return F.when(age < under(1), 1.0).when(age < under(6), 0.8).when(age < under(24), 0.6).when(age < under(72), 0.4).otherwise(0.2)


def relevance(title: Column, text: Column, target: str, weights: dict[str, float], reliability: Column, recent: Column) -> Column:
    """0.1 w for each keyword in the text, 0.5 for the target, times reliability; then 0.1 recency and 0.1 for each keyword in the title; at most 1."""
    low, head = F.lower(_text(text)), F.lower(_text(title))
    score = sum((F.when(F.contains(low, F.lit(k)), 0.1 * w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    score = (score + F.when(F.contains(low, F.lit(target.lower())), 0.5).otherwise(0.0)) * reliability
    in_title = sum((F.when(F.contains(head, F.lit(k)), 0.1).otherwise(0.0) for k in weights), F.lit(0.0))
    return F.least(F.lit(1.0), score + 0.1 * recent + in_title)


def unspammed(text: Column) -> Column:
    """A post without links, at and hash signs; three or more of one sign in a row become one."""
    bare = F.regexp_replace(F.regexp_replace(_text(text), r"https?://\S+", ""), r"[@#]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"([^\w\s])\1{2,}", "$1"), r"\s+", " "))


def engagement(platform: Column, likes: Column, shares: Column, comments: Column, views: Column, followers: Column, verified: Column) -> Column:
    """Likes, shares, comments and views by platform, raised by followers (at most twice) and verification, at most 1000."""
    base = likes + 2 * shares + 1.5 * comments + 0.01 * views
    score = F.when(platform == "TWITTER", base / 10).when(platform == "REDDIT", F.greatest(F.lit(0), likes) + 2 * comments).otherwise(base)
    score = score * F.least(F.lit(2.0), 1 + followers / 100000) * F.when(verified, 1.5).otherwise(1.0)
    return F.least(F.lit(1000.0), score)


def author_tier(followers: Column) -> Column:
    return F.when(followers >= 1_000_000, "MEGA").when(followers >= 100_000, "MACRO").when(followers >= 10_000, "MICRO").when(followers >= 1_000, "NANO").otherwise("REGULAR")


def strip_html(text: Column) -> Column:
    """Without scripts, styles and tags; white space as one blank."""
    bare = F.regexp_replace(_text(text), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"\s+", " "))


def looks_hostile(text: Column) -> Column:
    """Marks of SQL or script injection."""
    return F.rlike(F.lower(_text(text)), F.lit(r"(union\s+select|drop\s+table|insert\s+into|or\s+1\s*=\s*1|<script|javascript:|onerror\s*=)"))


def valid_symbol(symbol: Column) -> Column:
    return F.coalesce(F.rlike(symbol, F.lit(r"^[A-Z]{1,10}$")), F.lit(False))


def valid_email(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")), F.lit(False))


def safe_divide(top: Column, bottom: Column, default: float = 0.0) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(default)


def percent_change(old: Column, new: Column) -> Column:
    """Infinite from 0 to anything else, 0 from 0 to 0."""
    return F.when(old != 0, (new - old) / F.abs(old) * 100).when(new == 0, 0.0).otherwise(float("inf"))


def format_large(value: Column, digits: int = 2) -> Column:
    """1234567 as 1.23M."""
    size, out = F.abs(value), None
    for limit, mark in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")):
        text = F.concat(fixed(nearest(value / limit, digits), digits), F.lit(mark))
        out = F.when(size >= limit, text) if out is None else out.when(size >= limit, text)
    return out.otherwise(fixed(value, digits))


def format_duration(seconds: Column) -> Column:
    one = lambda v, mark: F.concat(fixed(nearest(v, 1), 1), F.lit(mark))
    return F.when(seconds < 1, one(seconds * 1000, "ms")).when(seconds < 60, one(seconds, "s")).when(seconds < 3600, one(seconds / 60, "m")).otherwise(one(seconds / 3600, "h"))


def format_currency(value: Column, sign: str = "$", digits: int = 2, minus_first: bool = True) -> Column:
    """-$5.00, or $-5.00."""
    if not minus_first:
        return F.concat(F.lit(sign), fixed(value, digits, thousands=True))
    return F.concat(F.when(value < 0, "-").otherwise(""), F.lit(sign), fixed(F.abs(value), digits, thousands=True))


def is_trading_day(ts: Column) -> Column:
    """Monday to Friday."""
    return ~F.dayofweek(ts).isin(1, 7)


def in_market_hours(ts_utc: Column, zone: str = "America/New_York") -> Column:
    """9:30 to 16:00 on a weekday of the zone."""
    there = F.from_utc_timestamp(ts_utc, zone)
    minute = F.hour(there) * 60 + F.minute(there)
    return is_trading_day(there) & (minute >= 570) & (minute < 960)


def business_days(start: Column, end: Column) -> Column:
    """Weekdays from start to end inclusive, without listing them: whole weeks, then the rest."""
    days = F.datediff(end, start) + 1
    rest, first = days % 7, F.weekday(start)
    over = sum((((F.lit(k) < rest) & ((first + k) % 7 < 5)).cast("int") for k in range(6)), F.lit(0))
    return F.when(days > 0, F.floor(days / 7) * 5 + over).otherwise(0)


def growing_stage(month: Column) -> Column:
    return F.when(month.between(3, 5), "PLANTING").when(month.between(6, 8), "GROWING").when(month.between(9, 11), "HARVEST").otherwise("DORMANT")
