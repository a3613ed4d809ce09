"""Queries of keys, maps, labels, identifiers and small ordered matrices."""

from pyspark.sql import functions as F

from tessera.functions import columns as C, sql as Q
from tessera.operators import graphs as G, joins as J, selection as S
from tessera.plans.catalog import register
from tessera.plans.texts import hit_sql


@register("accession_keys", "SELECT c_custkey, upper(c_mktsegment) || c_custkey AS accession FROM customer")
def accession_keys(t):
    raw = F.concat(F.lit(" UniRef90_"), F.col("c_mktsegment"), F.col("c_custkey"), F.lit(".2 "))
    return t.customer.select("c_custkey", C.normal_accession(raw).alias("accession"))


@register("shortened_texts", "SELECT doc_id, CASE WHEN length(text) > 40 THEN rtrim(substr(text, 1, 37)) || '...' ELSE text END AS title FROM documents")
def shortened_texts(t):
    """A title of 40 characters from each whole text: the cut is the function's own."""
    return t.documents.select("doc_id", C.shortened(F.col("text"), 40).alias("title"))


CRITERION = C.expanded_terms("thing eau mente", {"eau": ["wasser", "agua"]})


def any_form(term):
    return "(" + " OR ".join(hit_sql("text", form) for form in sorted({term, term.replace("-", " "), term.replace(" ", "-")})) + ")"


@register("criteria_terms", "SELECT doc_id, " + " + ".join(f"{any_form(x)}::INTEGER" for x in CRITERION) + " AS hits FROM documents WHERE text IS NOT NULL")
def criteria_terms(t):
    return t.documents.where("text IS NOT NULL").select("doc_id", C.keyword_count(F.col("text"), CRITERION).alias("hits"))


@register(
    "point_rmsd",
    "SELECT vec_id, sqrt((" + " + ".join(f"(embedding[{k}]::DOUBLE - embedding[{k + 9}]::DOUBLE) ** 2" for k in range(1, 7)) + ") / 2) AS rmsd FROM embeddings",
    "rmsd",
)
def point_rmsd(t):
    """Two points against three: the shorter list counts."""
    points = lambda start, n: F.array(*[F.transform(F.slice("embedding", start + 3 * k, 3), lambda x: x.cast("double")) for k in range(n)])
    return t.embeddings.select("vec_id", C.rmsd(points(1, 2), points(10, 3)).alias("rmsd"))


@register(
    "merged_tags",
    """SELECT p_partkey, p_name AS title, '{"brand":"' || p_brand || '","name":"' || p_name || '","size":"' || CASE WHEN p_partkey % 2 = 0 THEN 'none' ELSE p_size::VARCHAR END || '"}' AS tags FROM part""",
)
def merged_tags(t):
    left = F.create_map(F.lit("size"), F.lit("none"), F.lit("name"), F.col("p_name"))
    right = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.when(F.col("p_partkey") % 2 == 1, F.col("p_size").cast("string")))
    both = C.merged_maps(left, right)
    return t.part.select("p_partkey", C.alias_value(both, "title", "name").alias("title"), C.sorted_json(both).alias("tags"))


@register("residue_labels", "SELECT s_suppkey, 'HIS:A:' || s_nationkey AS label, 'HIS' AS name, 'A' AS chain, s_nationkey AS number FROM supplier")
def residue_labels(t):
    rows = t.supplier.withColumn("label", C.residue_label(F.lit("HIS"), F.lit("A"), F.col("s_nationkey")))
    return rows.select("s_suppkey", "label", C.residue_parts(F.col("label")).alias("p")).select("s_suppkey", "label", "p.*")


PRIORITY, WORDS = [("Cold", ["cold", "ice"]), ("Promo", ["promo"])], [("widget", "Tool"), ("gear", "Wheel"), ("eco", "Plain")]


@register(
    "kingdom_labels",
    """WITH w AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN 'Stated' END AS stated, lower(p_name || ' ' || p_type) AS words FROM part), f AS (SELECT *, lower(coalesce(stated, '')) || ' ' || words AS every FROM w)
    SELECT p_partkey, CASE """
    + " ".join(f"WHEN contains(every, '{x}') THEN '{name}'" for name, own in PRIORITY for x in own)
    + " WHEN stated <> '' THEN stated "
    + " ".join(f"WHEN contains(words, '{x}') THEN '{name}'" for x, name in WORDS)
    + " ELSE 'Unknown' END AS kingdom FROM f",
)
def kingdom_labels(t):
    stated = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "Stated")
    return t.part.select("p_partkey", C.settled_kingdom(stated, F.col("p_name"), F.col("p_type"), PRIORITY, WORDS).alias("kingdom"))


@register(
    "cliff_hypotheses",
    """WITH p AS (SELECT a.p_partkey, a.p_retailprice AS sa, b.p_retailprice AS sb, CASE WHEN a.p_retailprice >= b.p_retailprice THEN b.p_size - a.p_size ELSE a.p_size - b.p_size END AS d,
        CASE WHEN a.p_retailprice >= b.p_retailprice THEN length(b.p_name) - length(a.p_name) ELSE length(a.p_name) - length(b.p_name) END AS e FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
    SELECT p_partkey, coalesce(nullif(concat_ws(';', CASE WHEN e <= -3 THEN 'lost_hbond_network' END, CASE WHEN e >= 3 THEN 'more_hbonds_but_score_lower_possible_bad_geometry_or_desolvation' END,
        CASE WHEN abs(d) >= 25 THEN 'polar_surface_or_desolvation_shift' END), ''), 'unexplained_by_current_features_check_pose_or_assay') AS reasons FROM p""",
)
def cliff_hypotheses(t):
    return with_next_part(t, C.delta_reasons, "reasons")


def with_next_part(t, told, name):
    """What is told of each part and the next one."""
    b = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_retailprice").alias("score_b"), F.col("p_size").alias("size_b"), F.length("p_name").alias("long_b"))
    first = {"score": F.col("p_retailprice"), "area": F.col("p_size"), "hbonds": F.length("p_name")}
    second = {"score": F.col("score_b"), "area": F.col("size_b"), "hbonds": F.col("long_b")}
    return t.part.join(b, "p_partkey").select("p_partkey", told(first, second, "score").alias(name))


@register(
    "cliff_evidence",
    """WITH p AS (SELECT a.p_partkey, CASE WHEN a.p_retailprice >= b.p_retailprice THEN b.p_size - a.p_size ELSE a.p_size - b.p_size END AS d,
        CASE WHEN a.p_retailprice >= b.p_retailprice THEN length(b.p_name) - length(a.p_name) ELSE length(a.p_name) - length(b.p_name) END AS e FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
    SELECT p_partkey, coalesce(nullif(concat_ws(';', CASE WHEN e <= -3 THEN 'hbond_delta_low_minus_high=' || e || '.0' END, CASE WHEN e >= 3 THEN 'hbond_delta_low_minus_high=+' || e || '.0' END,
        CASE WHEN abs(d) >= 25 THEN 'tpsa_delta_low_minus_high=' || d || '.0' END), ''), 'current_descriptor_contact_features_do_not_explain_cliff') AS evidence FROM p""",
)
def cliff_evidence(t):
    return with_next_part(t, C.delta_evidence, "evidence")


@register(
    "identifiers",
    """SELECT p_partkey, CASE WHEN p_size % 10 = 5 THEN '' ELSE p_size % 10 || 'ABC' END AS structures, '1.2.' || p_size || '.' || p_partkey AS enzymes, 'Q' || p_size % 10 || 'ABC' || p_size % 10 AS proteins, 'A' || (1 + p_partkey % 999) || 'V' AS mutations FROM part""",
)
def identifiers(t):
    digit = F.col("p_size") % 10
    text = F.concat(
        F.lit("in 2023 we saw "), digit, F.lit("abc, "), digit, F.lit("ABC (EC 1.2."), F.col("p_size"), F.lit("."), F.col("p_partkey"), F.lit("); Q"), digit, F.lit("ABC"), digit,
        F.lit(" with A"), 1 + F.col("p_partkey") % 999, F.lit("V, xA1V and 1.2.3"),
    )
    rows = t.part.withColumn("found", text)
    each = {"structures": C.identifiers(F.col("found"), "structure", ["5abc"]), "enzymes": C.identifiers(F.col("found"), "enzyme"), "proteins": C.identifiers(F.col("found"), "protein"), "mutations": C.identifiers(F.col("found"), "mutation")}
    return rows.select("p_partkey", *[F.array_join(c, ";").alias(n) for n, c in each.items()])


@register("scored_by_first_column", "SELECT o_orderkey, -o_totalprice AS score FROM orders", "score")
def scored_by_first_column(t):
    """The first candidate column that has values, with its sign turned as lower is better."""
    rows = t.orders.withColumns({"official": F.lit(None).cast("double"), "docked": F.lit(float("nan"))})
    name = S.first_scored(rows, ["official", "docked", "o_totalprice"])
    return rows.select("o_orderkey", C.directed(F.col(name), True).alias("score"))


PLACE = "(n_nationkey * n_nationkey * 37) % 101"


@register(
    "nearest_chain",
    f"""WITH RECURSIVE p AS (SELECT n_nationkey AS id, {PLACE} AS place FROM nation), c AS (SELECT 0 AS turn, id, place, [id] AS seen FROM p WHERE id = 0 UNION ALL
    SELECT turn + 1, n.id, n.place, list_append(seen, n.id) FROM c, LATERAL (SELECT p.id, p.place FROM p WHERE NOT list_contains(c.seen, p.id) ORDER BY abs(p.place - c.place), p.id::VARCHAR LIMIT 1) n) SELECT turn, id FROM c""",
)
def nearest_chain(t):
    """The nations in a chain of nearest places: a matrix of 25 rows."""
    at = {r.n_nationkey: r.at for r in t.nation.selectExpr("n_nationkey", f"{PLACE} AS at").collect()}
    chain = S.greedy_chain(list(at), {(a, b): abs(at[a] - at[b]) for a in at for b in at}, 0)
    return t._spark.createDataFrame(list(enumerate(chain)), "turn int, id int")


TARGETS = [1000.0, 150000.0, 150000.0, 150000.0, 400000.0]


@register(
    "nearest_unused",
    """SELECT g.target, g.turn, o.o_orderkey FROM (VALUES (1000.0, 1), (150000.0, 1), (150000.0, 2), (150000.0, 3), (400000.0, 1)) g(target, turn), LATERAL
    (SELECT o_orderkey, row_number() OVER (ORDER BY abs(o_totalprice - g.target), o_orderkey) AS r FROM orders) o WHERE o.r = g.turn""",
    "target",
)
def nearest_unused(t):
    found = J.greedy_targets(TARGETS, t.orders, "o_orderkey", "o_totalprice")
    turn = [TARGETS[: k + 1].count(x) for k, x in enumerate(TARGETS)]
    return t._spark.createDataFrame([(a, n, b) for (a, b), n in zip(found, turn, strict=True)], "target double, turn int, o_orderkey long")


@register("distinct_tags", "SELECT p_partkey, p_brand || ';' || p_type AS tags FROM part")
def distinct_tags(t):
    return t.part.select("p_partkey", F.array_join(S.distinct_parts(F.array("p_brand", F.upper("p_brand"), "p_type", F.lower("p_type"))), ";").alias("tags"))


@register(
    "sql_function_scores",
    "SELECT c_custkey, greatest(0, least(1, c_acctbal / 10000)) AS held, ((c_acctbal + 180) % 360 + 360) % 360 - 180 AS turned, greatest(0, least(1, (c_acctbal + 1000) / 5000)) AS scaled FROM customer",
    "held turned scaled",
)
def sql_function_scores(t):
    Q.register(t._spark)
    return t.customer.selectExpr("c_custkey", "clamp01(c_acctbal / 10000) AS held", "circular_delta(c_acctbal, 0D) AS turned", "robust_scale(c_acctbal, -1000D, 4000D) AS scaled")


@register("butina_centres")
def butina_centres(t):
    """Nations within eight places of one another, by the neighbour count of their centre: a table of 25 rows."""
    at = {r.n_nationkey: r.at for r in t.nation.selectExpr("n_nationkey", f"{PLACE} AS at").collect()}
    centres = G.butina({a: {b for b in at if b != a and abs(at[a] - at[b]) <= 8} for a in at})
    return t._spark.createDataFrame(sorted(centres.items()), "id int, centre int")


@register("linkage_scan")
def linkage_scan(t):
    """Clusters of the nations' places at three cutoffs, and each cluster's medoid."""
    import numpy as np

    rows = t.nation.selectExpr("n_nationkey", f"{PLACE} AS at").orderBy("n_nationkey").collect()
    at = np.array([r.at for r in rows], float)
    apart = np.abs(at[:, None] - at[None, :])
    out = []
    for cutoff in (5.0, 15.0, 40.0):
        labels = G.average_linkage(apart, cutoff)
        centre = G.medoids(apart, labels)
        out += [(cutoff, r.n_nationkey, int(c), rows[centre[int(c)]].n_nationkey) for r, c in zip(rows, labels, strict=True)]
    return t._spark.createDataFrame(out, "cutoff double, id int, cluster int, medoid int")
