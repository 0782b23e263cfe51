"""Queries of text functions over documents, pages and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import text
from tickloom.plans.base import Registry, r, rounded
from tickloom.sources.market import table

CLEAN_SQL = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce({}, ''), 'https?://\S+', '', 'g'), '[@#]', '', 'g'), '\s+', ' ', 'g')))"


def _case(pairs, other: str) -> str:
    return "case " + " ".join(f"when {cond} then {value}" for cond, value in pairs) + f" else {other} end"


def register(reg: Registry) -> None:
    docs = lambda spark, d: table(spark, d, "documents")
    clean = CLEAN_SQL.format("text")
    words = ", ".join(f"('{w}', {x}::double)" for w, x in text.LEXICON.items())
    label = lambda s: _case([(f"{s} <= -0.6", "'VERY_BEARISH'"), (f"{s} <= -0.2", "'BEARISH'"), (f"{s} <= 0.2", "'NEUTRAL'"), (f"{s} <= 0.6", "'BULLISH'")], "'VERY_BULLISH'")
    scored = f"""with lex(w, x) as (values {words}), t as (select doc_id, unnest(regexp_extract_all({clean}, '[a-z]+')) as w from documents),
        s as (select doc_id, avg(x) as score from t join lex using (w) group by doc_id), f as (select doc_id, coalesce(score, 0.0) as score from documents left join s using (doc_id))"""
    reg.add("text_scores", lambda spark, d: rounded(docs(spark, d).select("doc_id", text.lexicon_score(F.col("text")).alias("score")).withColumn("label", text.label(F.col("score")))), f"{scored} select doc_id, {r('score', 'score')}, {label('score')} as label from f")
    sub = " + ".join(f"case when contains(lower(coalesce(text, '')), '{w}') then {x} else 0.0 end" for w, x in text.LEXICON.items())
    hits = " + ".join(f"contains(lower(coalesce(text, '')), '{w}')::int" for w in text.LEXICON)
    reg.add("text_substring_scores", lambda spark, d: rounded(docs(spark, d).select("doc_id", text.substring_score(F.col("text")).alias("score"))), f"with s as (select doc_id, ({sub})::double as s, {hits} as n from documents) select doc_id, {r('case when n > 0 then s / n else 0.0::double end', 'score')} from s")
    reg.add("text_clean", lambda spark, d: docs(spark, d).select("doc_id", F.md5(text.clean(F.col("text"))).alias("clean_md5")), f"select doc_id, md5({clean}) as clean_md5 from documents")
    reg.add("text_content_hash", lambda spark, d: docs(spark, d).select("doc_id", text.content_hash(F.col("source"), F.col("text")).alias("content_hash")), r"select doc_id, md5(trim(regexp_replace(lower(coalesce(source, '') || ' ' || coalesce(text, '')), '\s+', ' ', 'g'))) as content_hash from documents")
    reg.add(
        "text_dedup_by_hash",
        lambda spark, d: docs(spark, d).groupBy(text.content_hash(F.col("text")).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")),
        r"select md5(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))) as content_hash, min(doc_id) as doc_id, count(*) as copies from documents group by 1",
    )
    reg.add("text_tags", lambda spark, d: docs(spark, d).select("doc_id", F.concat_ws(",", text.hashtags(F.col("text"))).alias("tags"), F.concat_ws(",", text.mentions(F.col("text"))).alias("mentions")), r"""select doc_id, array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '#(\w+)', 1), lambda x: lower(x)), ',') as tags, array_to_string(regexp_extract_all(coalesce(text, ''), '@(\w+)', 1), ',') as mentions from documents""")
    stops = ", ".join(f"'{x}'" for x in text.STOP_TICKERS)
    reg.add("text_symbols", lambda spark, d: docs(spark, d).select("doc_id", F.concat_ws(",", text.symbols(F.col("text"))).alias("symbols")), rf"""select doc_id, array_to_string(list_sort(list_filter(list_distinct(list_concat(list_concat(regexp_extract_all(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', 'a', 'g'), '\$([A-Z]{{1,5}})\b', 1), regexp_extract_all(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', 'a', 'g'), '\(([A-Z]{{2,5}})\)', 1)), regexp_extract_all(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', 'a', 'g'), '\b([A-Z]{{2,5}})\b', 1))), lambda x: x not in ({stops}))), ',') as symbols from documents""")
    cats = _case([(" or ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in ws), f"'{n}'") for n, ws in text.CATEGORIES.items()], "'GENERAL'")
    reg.add("text_categories", lambda spark, d: docs(spark, d).groupBy(text.category(F.col("text")).alias("category")).agg(F.count("*").alias("documents")), f"select {cats} as category, count(*) as documents from documents group by 1")
    as_of = "2024-01-30 23:30:00"
    age = f"epoch(timestamp '{as_of}' - ts) / 3600"
    reg.add("text_recency", lambda spark, d: table(spark, d, "events").groupBy(text.recency(F.col("ts"), F.lit(as_of).cast("timestamp_ntz")).alias("recency")).agg(F.count("*").alias("events")), f"select {_case([(f'{age} < 1', '1.0::double'), (f'{age} < 6', '0.8::double'), (f'{age} < 24', '0.6::double'), (f'{age} < 72', '0.4::double')], '0.2::double')} as recency, count(*) as events from events group by 1")
    reg.add("text_strip_html", lambda spark, d: table(spark, d, "pages").select("page_id", F.md5(text.strip_html(F.col("html"))).alias("text_md5"), text.looks_hostile(F.col("html")).alias("hostile")), r"""select page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) as text_md5,
        regexp_matches(lower(coalesce(html, '')), '(union\s+select|drop\s+table|insert\s+into|or\s+1\s*=\s*1|<script|javascript:|onerror\s*=)') as hostile from pages""")
    large = _case([(f"o_totalprice >= {x}", f"printf('%.2f', round(o_totalprice / {x}, 2)) || '{m}'") for x, m in (("1e12", "T"), ("1e9", "B"), ("1e6", "M"), ("1e3", "K"))], "printf('%.2f', o_totalprice)")
    reg.add("text_formats", lambda spark, d: table(spark, d, "orders").select("o_orderkey", text.format_large(F.col("o_totalprice")).alias("large"), text.format_duration(F.col("o_orderkey").cast("double")).alias("duration")), f"select o_orderkey, {large} as large, {_case([('o_orderkey < 1', "printf('%.1f', round(o_orderkey * 1000.0, 1)) || 'ms'"), ('o_orderkey < 60', "printf('%.1f', o_orderkey * 1.0) || 's'"), ('o_orderkey < 3600', "printf('%.1f', round(o_orderkey / 60, 1)) || 'm'")], "printf('%.1f', round(o_orderkey / 3600, 1)) || 'h'")} as duration from orders")
    reg.add(
        "text_business_days",
        lambda spark, d: table(spark, d, "orders").select("o_orderkey", text.business_days(F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 40).cast("int"))).cast("long").alias("days"), text.is_trading_day(F.to_date("o_orderdate")).alias("trading"), text.growing_stage(F.month("o_orderdate")).alias("stage")),
        f"""with d as (select o_orderkey, o_orderdate::date as a, o_orderdate::date + (o_orderkey % 40)::int as b from orders) select o_orderkey, len(list_filter(generate_series(a, b, interval 1 day), lambda x: isodow(x) < 6))::bigint as days, isodow(a) < 6 as trading,
        {_case([('month(a) between 3 and 5', "'PLANTING'"), ('month(a) between 6 and 8', "'GROWING'"), ('month(a) between 9 and 11', "'HARVEST'")], "'DORMANT'")} as stage from d""",
    )
