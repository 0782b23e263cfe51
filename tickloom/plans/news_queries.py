"""Queries of news and posts, each with its SQL. The test tables have no news: every event is given a title, a summary and counts from its own numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import text as T
from tickloom.operators import news
from tickloom.plans.base import Registry, r, rounded
from tickloom.sources.market import table

WORDS = ("rally", "earnings", "breaking", "merger", "fed", "weather", "crash", "product launch", "profit", "ceo", "lawsuit", "partnership", "guidance", "dividend", "interview", "strong", "loss", "alert", "buy")
PLATFORMS = ("TWITTER", "REDDIT", "STOCKTWITS", "DISCORD")
SOURCES = ("NEWS", "ANALYST", "SOCIAL", "MARKET", "OTHER")
AS_OF = "2024-01-30 23:30:00"
_LIST = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
N = len(WORDS)

_has = lambda text, word: f"contains({text}, '{word}')"
_CATS = "case " + " ".join(f"when {' or '.join(_has('low', w) for w in ws)} then '{n}'" for n, ws in news.CATEGORIES.items()) + " else 'GENERAL' end"
_IMPACT = "case " + " ".join(f"when {_has('low', w)} then '{v}'" for w, v in news.IMPACT.items()) + " when source_reliability > 0.9 and relevance > 0.7 then 'MEDIUM' when relevance > 0.5 then 'LOW' else 'MINIMAL' end"
_KEYS = " + ".join(f"case when {_has('low', w)} then {0.1 * x} else 0.0 end" for w, x in news.KEYWORDS.items())
_HEAD = " + ".join(f"case when {_has('lower(title)', w)} then 0.1 else 0.0 end" for w in news.KEYWORDS)
_SUB = lambda low: (" + ".join(f"case when {_has(low, w)} then {x} else 0.0 end" for w, x in T.LEXICON.items()), " + ".join(f"{_has(low, w)}::int" for w in T.LEXICON))
_S, _H = _SUB("lower(summary)")

ARTICLES_SQL = f"""n0 as (select event_id as article_id, event_type as symbol, {_LIST}[event_id % {N} + 1] || ' report' as title, 'The ' || {_LIST}[user_id % {N} + 1] || ' in ' || case when event_id % 3 = 0 then event_type else 'markets' end as summary,
        (0.70 + (event_id % 4) * 0.08)::double as source_reliability, ts as published, ({list(SOURCES)})[event_id % 5 + 1] as source, epoch(timestamp '{AS_OF}') - floor(epoch(ts)) as seconds from events),
    n1 as (select *, lower(title || ' ' || summary) as low, case when seconds / 3600 < 1 then 1.0 when seconds / 3600 < 6 then 0.8 when seconds / 3600 < 24 then 0.6 when seconds / 3600 < 72 then 0.4 else 0.2 end::double as recency, ({_H}) as hits, ({_S}) as points from n0),
    n2 as (select *, round(least(1.0, ({_KEYS} + case when contains(low, lower(symbol)) then 0.5 else 0.0 end)::double * source_reliability + 0.1 * recency + ({_HEAD})::double), 9) as relevance, case when hits > 0 then round(points::double / hits, 9) else 0.0 end as sentiment, {_CATS} as category from n1),
    n3 as (select *, {_IMPACT} as impact from n2),
    articles as (select *, case when contains(low, 'breaking') or contains(low, 'urgent') or contains(low, 'alert') then 'BREAKING' when seconds / 3600 < 1 and impact in ('VERY_HIGH', 'HIGH') then 'URGENT' when seconds / 3600 < 6 and relevance > 0.7 then 'IMPORTANT' else 'NORMAL' end as urgency,
        round(0.7 * relevance + 0.3 * recency, 9) as rank_score from n3)"""


def raw(spark, d):
    words = F.array(*[F.lit(w) for w in WORDS])
    at = lambda c: F.element_at(words, (F.col(c) % N + 1).cast("int"))
    e = table(spark, d, "events")
    summary = F.concat(F.lit("The "), at("user_id"), F.lit(" in "), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise("markets"))
    sources = F.array(*[F.lit(s) for s in SOURCES])
    return e.select(
        F.col("event_id").alias("article_id"), F.col("event_type").alias("symbol"), F.concat(at("event_id"), F.lit(" report")).alias("title"), summary.alias("summary"), (0.70 + (F.col("event_id") % 4) * 0.08).alias("source_reliability"),
        F.col("ts").alias("published"), F.element_at(sources, (F.col("event_id") % 5 + 1).cast("int")).alias("source"), T.substring_score(summary).alias("sentiment"),
    )


AS_OF_COLUMN = lambda: F.lit(AS_OF).cast("timestamp_ntz")


def articles(spark, d):
    return news.annotated(raw(spark, d), AS_OF_COLUMN())


_PS, _PH = _SUB("lower(content)")
POSTS_SQL = f"""p0 as (select event_id as post_id, event_type as symbol, ({list(PLATFORMS)})[user_id % 4 + 1] as platform, user_id as author, {_LIST}[event_id % {N} + 1] || ' ' || {_LIST}[user_id % {N} + 1] || case when event_id % 2 = 0 then ' ' || event_type else '' end || '!!!! @all' as content,
        value as likes, (event_id % 7) as shares, (user_id % 11) as comments, value * 20 as views, (user_id * user_id * 37) % 1500000 as followers, event_id % 9 = 0 as verified from events),
    p1 as (select *, case platform when 'TWITTER' then (likes + 2 * shares + 1.5 * comments + 0.01 * views) / 10 when 'REDDIT' then greatest(0.0, likes) + 2 * comments else likes + 2 * shares + 1.5 * comments + 0.01 * views end * least(2.0, 1 + followers / 100000) * case when verified then 1.5 else 1.0 end as g,
        case when followers >= 1000000 then 'MEGA' when followers >= 100000 then 'MACRO' when followers >= 10000 then 'MICRO' when followers >= 1000 then 'NANO' else 'REGULAR' end as tier, ({_PH}) as hits, ({_PS}) as points from p0),
    p2 as (select *, least(1000.0, g) as engagement, case when hits > 0 then round(points::double / hits, 9) else 0.0 end as sentiment, lower(content) as low from p1),
    posts as (select *, least(1.0, case when followers > 0 then least(0.5, followers / 1e6) + least(0.3, engagement / greatest(1, followers) * 1000) else 0.0 end + case when verified then 0.2 else 0.0 end) as influence,
        round(least(1.0, case when contains(low, lower(symbol)) then 0.4 else 0.0 end + {" + ".join(f"case when {_has('low', w)} then 0.1 else 0.0 end" for w in news.KEYWORDS)} + case platform when 'STOCKTWITS' then 0.2 when 'REDDIT' then 0.1 else 0.0 end + case when engagement > 50 then 0.1 else 0.0 end + case when verified then 0.1 else 0.0 end)::double, 9) as relevance from p2)"""
METRICS_SQL = f"""{POSTS_SQL}, m0 as (select symbol, platform, count(*) as posts, count(*) filter (where sentiment > 0.1) as positive, count(*) filter (where sentiment < -0.1) as negative, avg(sentiment) as mean_sentiment, count(distinct author) as authors,
        coalesce(avg(case when tier in ('MEGA', 'MACRO', 'MICRO') then sentiment end), 0.0) as influencer_sentiment, least(1.0, sum(engagement) / 1000) as trending from posts group by all),
    metrics as (select *, posts - positive - negative as neutral, least(1.0, posts / 20) * least(1.0, authors / 10) as confidence, least(1.0, posts / 50) as quality from m0)"""


def posts(spark, d):
    words, platforms = F.array(*[F.lit(w) for w in WORDS]), F.array(*[F.lit(p) for p in PLATFORMS])
    at = lambda c: F.element_at(words, (F.col(c) % N + 1).cast("int"))
    text = F.concat(at("event_id"), F.lit(" "), at("user_id"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), "event_type")).otherwise(""), F.lit("!!!! @all"))
    e = table(spark, d, "events")
    made = e.select(
        F.col("event_id").alias("post_id"), F.col("event_type").alias("symbol"), F.element_at(platforms, (F.col("user_id") % 4 + 1).cast("int")).alias("platform"), F.col("user_id").alias("author"), text.alias("text"), F.col("value").alias("likes"),
        (F.col("event_id") % 7).alias("shares"), (F.col("user_id") % 11).alias("comments"), (F.col("value") * 20).alias("views"), ((F.col("user_id") * F.col("user_id") * 37) % 1500000).alias("followers"), (F.col("event_id") % 9 == 0).alias("verified"),
    )
    return news.scored_posts(made)


def scores(spark, d):
    return articles(spark, d).select("symbol", "source", F.col("sentiment").alias("score"), F.col("source_reliability").alias("confidence"))


def register(reg: Registry) -> None:
    base = f"with {ARTICLES_SQL}"
    cols = ("article_id", "symbol", "relevance", "recency", "category", "impact", "urgency", "rank_score")
    reg.add("news_annotated", lambda spark, d: rounded(articles(spark, d).select(*cols)), f"{base} select {', '.join(cols)} from articles")
    short = ("article_id", "symbol", "title", "category", "urgency", "relevance", "published")
    pick = f"select {', '.join(short)} from articles"
    reg.add("news_best", lambda spark, d: news.best(articles(spark, d), 0.3, 50).select(*short), f"{base} {pick} where relevance > 0.3 order by rank_score desc, article_id limit 50")
    reg.add("news_breaking", lambda spark, d: news.breaking(articles(spark, d), AS_OF_COLUMN(), 24, 10).select(*short), f"{base} {pick} where urgency in ('BREAKING', 'URGENT') and published > timestamp '{AS_OF}' - interval 24 hours order by published desc, article_id limit 10")
    reg.add("news_search", lambda spark, d: news.search(articles(spark, d), "Merger", AS_OF_COLUMN(), 168, 40).select(*short), f"{base} {pick} where (contains(lower(title), 'merger') or contains(lower(summary), 'merger')) and published > timestamp '{AS_OF}' - interval 168 hours order by relevance desc, published desc, article_id limit 40")
    reg.add("news_latest_by_symbol", lambda spark, d: news.latest_by_symbol(articles(spark, d), ["click", "view", "signup"], 20).select(*short), f"{base} {pick} where symbol in ('click', 'view', 'signup') qualify row_number() over (partition by symbol order by rank_score desc, article_id) <= 6 order by published desc, article_id limit 20")
    reg.add("news_earnings", lambda spark, d: articles(spark, d).where("category = 'EARNINGS'").select(*short), f"{base} {pick} where category = 'EARNINGS'")
    fold = "coalesce(sum(relevance * greatest(0.1, 1 - floor(seconds / 86400) / 7) * sentiment) / nullif(sum(relevance * greatest(0.1, 1 - floor(seconds / 86400) / 7)), 0), 0.0)"
    reg.add("news_weighted_sentiment", lambda spark, d: rounded(news.weighted_sentiment(articles(spark, d), AS_OF_COLUMN())), f"{base} select symbol, {r(fold, 'sentiment')} from articles group by symbol")
    weight = "case source " + " ".join(f"when '{k}' then {v}" for k, v in news.SOURCES.items()) + " else 0.1 end"
    agg = f"""{base}, g0 as (select symbol, source, avg(sentiment) as s, avg(source_reliability) as c, count(*) as n, count(*) filter (where sentiment > 0.1) as up, count(*) filter (where sentiment < -0.1) as down from articles group by all),
        g1 as (select symbol, sum(s * c * {weight}) / greatest(sum(c * {weight}), 0.01) as score, avg(c) as confidence, count(*) as sources, sum(up) / sum(n) as bullish, sum(down) / sum(n) as bearish, 1 - (sum(up) + sum(down)) / sum(n) as neutral, least(1.0, sum(n) / 10) as quality from g0 group by symbol),
        g2 as (select *, case when score <= -0.6 then 'VERY_BEARISH' when score <= -0.2 then 'BEARISH' when score <= 0.2 then 'NEUTRAL' when score <= 0.6 then 'BULLISH' else 'VERY_BULLISH' end as label, greatest(0.0, least(100.0, (score + 1) * 50 + (confidence - 0.5) * 20 + sources / 4 * 10)) as fear_greed from g1)"""
    reg.add("news_aggregated", lambda spark, d: rounded(news.aggregated(scores(spark, d))), f"{agg} select symbol, {', '.join(r(f'({c})::double', c) for c in ('score', 'confidence', 'bullish', 'bearish', 'neutral', 'quality', 'fear_greed'))}, sources, label from g2")
    # by article, so that every branch is met
    said = ("strength", "advice", "risk", "factors", "trust", "action", "action_strength", "risk_score")

    def each(spark, d):
        a = articles(spark, d).select("article_id", F.col("sentiment").alias("score"), F.col("source_reliability").alias("confidence"), F.col("recency").alias("quality"), (F.col("relevance") * 100).alias("fear_greed"), F.col("relevance").alias("bullish"), (1 - F.col("relevance")).alias("bearish"))
        return rounded(news.insights(a).select("article_id", *said))

    reg.add("news_insights", each, f"""{base}, i as (select article_id, sentiment as score, source_reliability as c, recency as q, relevance * 100 as fg, relevance as bull, 1 - relevance as bear from articles),
        j as (select *, case when score > 0.4 and c > 0.6 then 'BUY' when score < -0.4 and c > 0.6 then 'SELL' else 'HOLD' end as action from i)
        select article_id, case when abs(score) > 0.6 and c > 0.7 then 'strong' when abs(score) > 0.3 and c > 0.5 then 'medium' else 'weak' end as strength, case when score > 0.3 and c > 0.6 then 'bullish' when score < -0.3 and c > 0.6 then 'bearish' else 'hold' end as advice,
        case when q < 0.5 or c < 0.4 then 'high' when c > 0.7 and q > 0.7 then 'low' else 'medium' end as risk, concat_ws(';', case when bull > 0.7 then 'bullish consensus' end, case when bear > 0.7 then 'bearish consensus' end, case when fg > 80 then 'extreme greed' end, case when fg < 20 then 'extreme fear' end) as factors,
        case when c > 0.7 then 'high' when c > 0.5 then 'medium' else 'low' end as trust, action, {r("case when action <> 'HOLD' then least(1.0, abs(score) * c) else 0.0 end", 'action_strength')}, case when q < 0.5 then 0.8 else 0.5 end::double as risk_score from j""")

    def trend(spark, d):
        hourly = articles(spark, d).groupBy("symbol", F.date_trunc("hour", F.col("published").cast("timestamp")).cast("timestamp_ntz").alias("ts")).agg(F.avg("sentiment").alias("score"))
        return rounded(news.score_trend(hourly).select("symbol", "ts", "slope", "trend", "trend_momentum"))

    win = "over (partition by symbol order by ts rows 9 preceding)"
    reg.add("news_score_trend", trend, f"""{base}, h as (select symbol, date_trunc('hour', published)::timestamp as ts, avg(sentiment) as score from articles group by all), k as (select *, row_number() over (partition by symbol order by ts) as i from h),
        l as (select *, case when count(score) {win} >= 3 then regr_slope(score, i) {win} end as slope from k) select symbol, ts, {r('slope', 'slope')}, case when slope > 0.05 then 'improving' when slope < -0.05 then 'declining' else 'stable' end as trend, {r('case when slope is null then 0.0 else least(1.0, abs(slope) * 10) end', 'trend_momentum')} from l""")
    keys = " + ".join(f"{_has('low', w)}::int" for w in news.KEYWORDS)
    reg.add("news_quality", lambda spark, d: rounded(table(spark, d, "documents").select("doc_id", news.quality(F.col("text")).alias("content_quality"))), f"""with q as (select doc_id, coalesce(text, '') as t, lower(coalesce(text, '')) as low from documents),
        w as (select *, len(list_filter(regexp_split_to_array(t, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> ''))::double as words, len(string_split(t, '.')) as sentences, ({keys})::double as hits from q)
        select doc_id, {r("case when length(t) > 0 then least(1.0, case when length(t) > 500 then 0.3 when length(t) > 200 then 0.2 else 0.1 end + least(0.4, hits / greatest(1.0, words / 100)) + case when words / sentences between 10 and 25 then 0.3 else 0.1 end) else 0.0 end", 'content_quality')} from w""")
    pb = f"with {POSTS_SQL}"
    seen = ("engagement", "tier", "sentiment", "influence", "relevance")
    reg.add("social_posts", lambda spark, d: rounded(posts(spark, d).select("post_id", "symbol", "platform", *seen), 10), f"{pb} select post_id, symbol, platform, {r('engagement', 'engagement', 10)}, tier, {r('sentiment', 'sentiment', 10)}, {r('influence', 'influence', 10)}, {r('relevance', 'relevance', 10)} from posts")
    reg.add("social_best_posts", lambda spark, d: rounded(news.best_posts(posts(spark, d), 0.3, 40).select("post_id", "symbol", "rank_score")), f"{pb}, b as (select *, round(0.6 * engagement / 1000 + 0.4 * relevance, 9) as rank_score from posts where relevance > 0.3) select post_id, symbol, {r('rank_score', 'rank_score')} from b order by b.rank_score desc, post_id limit 40")
    mcols = ("mean_sentiment", "influencer_sentiment", "trending", "confidence", "quality")
    shown = f"symbol, platform, posts, positive, negative, neutral, authors, {', '.join(r(c, c) for c in mcols)}"
    reg.add("social_platforms", lambda spark, d: rounded(news.platform_metrics(posts(spark, d))), f"with {METRICS_SQL} select {shown} from metrics")
    reg.add("social_main_platform", lambda spark, d: rounded(news.main_platform(news.platform_metrics(posts(spark, d)))), f"with {METRICS_SQL}, t as (select * from metrics qualify row_number() over (partition by symbol order by posts desc, platform) = 1) select {shown} from t")
    reg.add("social_signal", lambda spark, d: rounded(news.social_signal(news.platform_metrics(posts(spark, d)), 0.05, 0.2).select("symbol", "platform", "momentum", "action", "strength", "notes")), f"""with {METRICS_SQL}, a as (select *, case when mean_sentiment > 0.05 and positive / posts > 0.2 and confidence > 0.5 then 'buy' when mean_sentiment < -0.05 and negative / posts > 0.2 and confidence > 0.5 then 'sell' else 'hold' end as action from metrics)
        select symbol, platform, {r('positive / posts - negative / posts', 'momentum')}, action, {r("case when action <> 'hold' then least(1.0, abs(mean_sentiment) * confidence) else 0.0 end", 'strength')},
        concat_ws(';', case when trending > 0.7 then 'trending' end, case when influencer_sentiment > 0.5 then 'influencers positive' when influencer_sentiment < -0.5 then 'influencers negative' end) as notes from a""")
    reg.add("social_both_sources", lambda spark, d: rounded(news.weighted_sentiment(articles(spark, d), AS_OF_COLUMN()).join(posts(spark, d).groupBy("symbol").agg(F.avg("sentiment").alias("social")), "symbol", "full").select("symbol", F.col("sentiment").alias("news"), "social", ((F.col("sentiment") + F.col("social")) / 2).alias("both"))), f"with {ARTICLES_SQL}, {POSTS_SQL}, x as (select symbol, {fold} as n from articles group by symbol), y as (select symbol, avg(sentiment) as s from posts group by symbol) select symbol, {r('n', 'news')}, {r('s', 'social')}, {r('(n + s) / 2', 'both')} from x full join y using (symbol)")
