"""Queries of text: keywords, criteria, rules, extraction, normal forms."""

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import tagging
from tessera.plans.catalog import register

TERMS = ["thing", "the", "eau", "mente"]


def hit_sql(column, term):
    if len(term) <= 3:
        return f"regexp_matches(lower({column}), '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"
    return f"contains(lower({column}), '{term}')"


@register("keyword_hits", "SELECT doc_id, " + " + ".join(f"{hit_sql('text', x)}::INTEGER" for x in TERMS) + " AS hits FROM documents")
def keyword_hits(t):
    return t.documents.select("doc_id", C.keyword_count(F.col("text"), TERMS).alias("hits"))


@register(
    "keyword_relevance",
    "WITH h AS (SELECT doc_id, length(text) AS size, least(1, (" + " + ".join(f"{hit_sql('(source || chr(32) || text)', x)}::INTEGER" for x in TERMS) + ") / 4.0::DOUBLE) AS base FROM documents) SELECT doc_id, CASE WHEN size = 0 THEN base * 0.7 WHEN size > 300 THEN base + 0.08 WHEN size > 100 THEN base + 0.03 ELSE base END AS relevance FROM h",
    "relevance",
)
def keyword_relevance(t):
    return t.documents.select("doc_id", C.relevance(F.col("source"), F.col("text"), TERMS).alias("relevance"))


@register(
    "criteria_triage",
    f"""WITH h AS (SELECT doc_id, {hit_sql("text", "thing")} AS a, {hit_sql("text", "eau")} AS b, {hit_sql("text", "mente")} AS c FROM documents)
    SELECT doc_id, CASE WHEN a AND b AND c THEN 'pass' WHEN a AND (b OR c) THEN 'borderline' WHEN a::INTEGER + b::INTEGER + c::INTEGER >= 2 THEN 'borderline' ELSE 'fail' END AS verdict FROM h""",
)
def criteria_triage(t):
    a, b, c = (C.keyword_hit(F.col("text"), x) for x in ("thing", "eau", "mente"))
    passed = a.cast("int") + b.cast("int") + c.cast("int")
    return t.documents.select("doc_id", C.first_match([(a & b & c, "pass"), (a & (b | c), "borderline"), (passed >= 2, "borderline")], "fail").alias("verdict"))


@register(
    "rule_tagger",
    """SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'legal' WHEN contains(text, '|') THEN 'table' WHEN contains(text, '###') THEN 'noise' ELSE 'prose' END AS kind,
    concat_ws(' | ', CASE WHEN contains(text, '@') THEN 'mail' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'number' END, CASE WHEN contains(text, 'token') THEN 'secret' END) AS tags FROM documents""",
)
def rule_tagger(t):
    x = F.col("text")
    has = lambda s: F.contains(x, F.lit(s))
    kind = C.first_match([(F.contains(F.lower(x), F.lit("license")), "legal"), (has("|"), "table"), (has("###"), "noise")], "prose")
    return t.documents.select("doc_id", kind.alias("kind"), C.multi_tags({"mail": has("@"), "number": x.rlike("[0-9]"), "secret": has("token")}).alias("tags"))


@register(
    "quality_quota",
    """WITH r AS (SELECT doc_id, lang, n_chars, CASE WHEN n_chars < 50 THEN 'blacklist' ELSE 'keep' END AS status FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY lang, status ORDER BY n_chars DESC, doc_id) AS k FROM r)
    SELECT doc_id, CASE WHEN status = 'blacklist' THEN status WHEN lang <> 'en' AND k > 10 THEN 'deferred' ELSE 'keep' END AS status FROM n""",
)
def quality_quota(t):
    from pyspark.sql import Window

    rows = t.documents.select("doc_id", "lang", "n_chars", F.when(F.col("n_chars") < 50, "blacklist").otherwise("keep").alias("status"))
    k = F.row_number().over(Window.partitionBy("lang", "status").orderBy(F.desc("n_chars"), "doc_id"))
    return rows.withColumn("k", k).select("doc_id", C.first_match([(F.col("status") == "blacklist", "blacklist"), ((F.col("lang") != "en") & (F.col("k") > 10), "deferred")], "keep").alias("status"))


@register("regex_extract_entities", "SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '[a-z]+://[a-z0-9.]+'))), ';') AS hosts FROM pages")
def regex_extract_entities(t):
    return t.pages.select("page_id", F.array_join(C.found_all(F.col("html"), "[a-z]+://[a-z0-9.]+"), ";").alias("hosts"))


@register("normal_keys", "SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) AS key, left(md5(url), 10) AS short, left(sha256(url), 12) AS long FROM pages")
def normal_keys(t):
    return t.pages.select("page_id", C.normal_key(F.col("url")).alias("key"), C.short_hash(F.col("url")).alias("short"), C.short_hash(F.col("url"), "sha256", 12).alias("long"))


@register("first_number", "SELECT c_custkey, try_cast(nullif(regexp_extract(c_name, '-?[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE) AS number FROM customer", "number")
def first_number(t):
    return t.customer.select("c_custkey", C.first_number(F.col("c_name")).alias("number"))


@register("safe_cast", "SELECT doc_id, try_cast(CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 2 THEN '1.5' ELSE '-3e2' END AS DOUBLE) AS number FROM documents", "number")
def safe_cast(t):
    raw = C.first_match([(F.col("doc_id") % 4 == 0, ""), (F.col("doc_id") % 4 == 1, "x"), (F.col("doc_id") % 4 == 2, "1.5")], "-3e2")
    return t.documents.select("doc_id", C.safe_double(raw).alias("number"))


@register("coalesce_blank", "SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE c_mktsegment END), ''), c_name) AS name FROM customer")
def coalesce_blank(t):
    return t.customer.select("c_custkey", C.first_nonblank(F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(F.col("c_mktsegment")), F.col("c_name")).alias("name"))


@register("dict_map_passthrough", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE o_orderstatus END AS status FROM orders")
def dict_map_passthrough(t):
    return t.orders.select("o_orderkey", C.mapped(F.col("o_orderstatus"), {"O": "open", "F": "filled"}).alias("status"))


@register("prefix_labels", "SELECT doc_id, CASE WHEN upper(lang) LIKE 'E%' THEN 'E-like' WHEN upper(lang) LIKE 'F%' THEN 'F-like' ELSE 'other' END AS label FROM documents")
def prefix_labels(t):
    return t.documents.select("doc_id", C.label_by_prefix(F.col("lang"), {"E": "E-like", "F": "F-like"}, "other").alias("label"))


@register("clamp_and_weight", "SELECT s_suppkey, greatest(0, least(1, s_acctbal / 10000)) AS clamped, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal ELSE (0.38 * s_acctbal + 0.24 * s_suppkey) / 0.62 END AS blended, CAST(printf('%.1f', s_acctbal) AS DOUBLE) AS even FROM supplier", "clamped blended even")
def clamp_and_weight(t):
    two = C.weighted_mean([(F.col("s_acctbal"), 0.38), (F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey")), 0.24)])
    return t.supplier.select("s_suppkey", C.clamp01(F.col("s_acctbal") / 10000).alias("clamped"), two.alias("blended"), C.half_even(F.col("s_acctbal"), 1).alias("even"))


@register("token_split", "SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(p_type || ';' || p_brand || ',,', '[;,|]'), lambda x: trim(x)), lambda x: x <> ''), '/') AS tokens FROM part")
def token_split(t):
    return t.part.select("p_partkey", F.array_join(C.tokens(F.concat("p_type", F.lit(";"), "p_brand", F.lit(",,"))), "/").alias("tokens"))


@register("text_cleanup", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS collapsed, regexp_replace(text, '\\s+', '', 'g') AS bare, regexp_replace(regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe FROM documents")
def text_cleanup(t):
    text = F.col("text")
    return t.documents.select("doc_id", C.collapsed(text).alias("collapsed"), C.without_space(text).alias("bare"), C.safe_name(text).alias("safe"))


@register("word_overlap", "SELECT item_id, len(list_intersect(list_filter(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+')), lambda w: w <> ''), ['the', 'of', 'and', 'in', 'to'])) AS shared FROM benchmark")
def word_overlap(t):
    return t.benchmark.select("item_id", C.word_overlap(F.col("text"), F.lit("the of and in to")).alias("shared"))


@register("json_property", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_property(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@register("risk_reasons", "SELECT p_partkey, (CASE WHEN p_size > 40 THEN 4 ELSE 0 END) + (CASE WHEN p_retailprice > 1500 THEN 2 ELSE 0 END) + (CASE WHEN p_brand = 'Brand#11' THEN -3 ELSE 0 END) AS points, concat_ws('; ', CASE WHEN p_size > 40 THEN 'large' END, CASE WHEN p_retailprice > 1500 THEN 'dear' END, CASE WHEN p_brand = 'Brand#11' THEN 'known' END) AS reasons FROM part")
def risk_reasons(t):
    points, why = C.reasons([(F.col("p_size") > 40, 4, "large"), (F.col("p_retailprice") > 1500, 2, "dear"), (F.col("p_brand") == "Brand#11", -3, "known")])
    return t.part.select("p_partkey", points.alias("points"), why.alias("reasons"))


@register(
    "property_window",
    """WITH p AS (SELECT p_partkey, p_retailprice / 2 AS mw, p_size / 5.0::DOUBLE - 2 AS logp, p_size * 4.0::DOUBLE AS tpsa, p_size % 15 AS rot, p_size % 9 AS hbd, p_size % 17 AS hba FROM part)
    SELECT p_partkey, greatest(0, least(1, 1 - CASE WHEN mw > 900 THEN least(.06, (mw - 900) / 1500) WHEN mw > 500 THEN least(.03, (mw - 500) / 1000) WHEN mw < 250 THEN least(.15, (250 - mw) / 250) ELSE 0 END
    - CASE WHEN logp > 5 THEN least(.25, (logp - 5) / 5) ELSE 0 END - CASE WHEN logp < -1 THEN least(.15, (-1 - logp) / 4) ELSE 0 END - CASE WHEN tpsa > 140 THEN least(.25, (tpsa - 140) / 200) ELSE 0 END
    - CASE WHEN rot > 10 THEN least(.20, (rot - 10) / 20.0::DOUBLE) ELSE 0 END - CASE WHEN hbd > 5 THEN least(.15, (hbd - 5) / 10.0::DOUBLE) ELSE 0 END - CASE WHEN hba > 10 THEN least(.15, (hba - 10) / 15.0::DOUBLE) ELSE 0 END)) AS score FROM p""",
    "score",
)
def property_window(t):
    s = F.col("p_size")
    return t.part.select("p_partkey", C.property_window(F.col("p_retailprice") / 2, s / 5.0 - 2, s * 4.0, s % 15, s % 9, s % 17).alias("score"))


#: Twenty fields, one for each stem of the invented words, whose tags are endings; and one of license terms.
STEMS = "th on in or he er an re en at ou ai eau que ein ver be gen st nd".split()
ENDINGS = "tion ing ble ment heit lich keit ung re eux".split()
TAG_RULES = [(f"stem_{s}", e, s + e) for s in STEMS for e in ENDINGS] + [("license", "apache", "apache license"), ("license", "apache", "apache-2.0"), ("license", "mit", "mit license"), ("license", "terms", "licensed under"), ("license", "terms", "released under")]


def tag_sql(field: str) -> str:
    """SQL of a field's tags in order."""
    terms: dict[str, list[str]] = {}
    for f, tag, term in TAG_RULES:
        if f == field:
            terms.setdefault(tag, []).append(term.replace(".", "[.]"))
    each = ", ".join(f"CASE WHEN regexp_matches(t, '(^|[^a-z0-9])({'|'.join(words)})($|[^a-z0-9])') THEN '{tag}' END" for tag, words in terms.items())
    return f"concat_ws(';', {each}) AS {field}"


TAG_FIELDS = list(dict.fromkeys(f for f, _, _ in TAG_RULES))


@register("term_tags", f"SELECT doc_id, {', '.join(map(tag_sql, TAG_FIELDS))} FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)")
def term_tags(t):
    """Tags of twenty-one fields from a table of terms, in one walk over each text."""
    return tagging.tagged(t.documents.select("doc_id", "text"), "text", TAG_RULES).select("doc_id", *TAG_FIELDS)
