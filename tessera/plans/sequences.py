"""Queries of sequences: translation, motifs, identity, alignment. Sequences are made from digests of the texts."""

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import kernels as K, joins as J
from tessera.plans.catalog import register

DNA = "translate(sha256(text), '0123456789abcdef', 'TCAGTCAGTCAGTCAG')"
HEX = "0123456789abcdef"


def dna(t):
    return t.documents.select("doc_id", F.translate(F.sha2("text", 256), HEX, "TCAGTCAGTCAGTCAG").alias("dna"))


def protein_sql(column):
    place = lambda i: f"(instr('{C.BASES}', substr({column}, k * 3 + {i}, 1)) - 1)"
    return f"array_to_string(list_transform(range(length({column}) // 3), lambda k: substr('{C.AMINO}', {place(1)} * 16 + {place(2)} * 4 + {place(3)} + 1, 1)), '')"


@register(
    "translate_codons",
    f"""WITH s AS (SELECT doc_id, dna, {protein_sql("dna")} AS raw FROM (SELECT doc_id, {DNA} AS dna FROM documents))
    SELECT doc_id, replace(raw, '*', '') AS protein, raw LIKE '%*' AS terminal_stop, CAST(length(raw) - length(replace(raw, '*', '')) - (raw LIKE '%*')::INTEGER AS INTEGER) AS internal_stops, CAST(length(dna) % 3 AS INTEGER) AS rest FROM s""",
)
def translate_codons(t):
    return dna(t).select("doc_id", C.translation(F.col("dna")).alias("x")).select("doc_id", "x.*")


MOTIFS = ["TCA", "GATT", "CAGCA"]


@register("motif_score", f"SELECT doc_id, 100.0::DOUBLE * (" + " + ".join(f"contains({DNA}, '{m}')::INTEGER" for m in MOTIFS) + f") / 3 AS score, instr({DNA}, 'GATT') - 1 AS place FROM documents", "score")  # noqa: F541
def motif_score(t):
    return dna(t).select("doc_id", C.motif_score(F.col("dna"), MOTIFS).alias("score"), C.motif_places(F.col("dna"), MOTIFS)["GATT"].alias("place"))


@register(
    "positional_identity",
    f"""WITH s AS (SELECT doc_id, {DNA} AS a, translate(md5(text), '{HEX}', 'TCAGTCAGTCAGTCAG') AS b FROM documents)
    SELECT doc_id, len(list_filter(range(1, 33), lambda k: substr(a, k, 1) = substr(b, k, 1))) / 64.0::DOUBLE AS identity FROM s""",
    "identity",
)
def positional_identity(t):
    rows = t.documents.select("doc_id", F.translate(F.sha2("text", 256), HEX, "TCAGTCAGTCAGTCAG").alias("a"), F.translate(F.md5("text"), HEX, "TCAGTCAGTCAGTCAG").alias("b"))
    return rows.select("doc_id", C.positional_identity(F.col("a"), F.col("b")).alias("identity"))


@register(
    "aligned_identity",
    f"""WITH s AS (SELECT doc_id, translate(md5(text), '{HEX}', 'TCAG-TCAG-TCAG-T') AS a, translate(left(sha256(text), 32), '{HEX}', 'TCAG-TCAG-TCAG-T') AS b FROM documents),
    c AS (SELECT doc_id, list_filter(list_transform(range(1, 33), lambda k: substr(a, k, 1) || substr(b, k, 1)), lambda p: p <> '--') AS p FROM s) SELECT doc_id, len(list_filter(p, lambda x: x[1] = x[2])) / nullif(len(p), 0)::DOUBLE AS identity FROM c""",
    "identity",
)
def aligned_identity(t):
    gapped = lambda c: F.translate(c, HEX, "TCAG-TCAG-TCAG-T")
    return t.documents.select("doc_id", C.aligned_identity(gapped(F.md5("text")), gapped(F.substring(F.sha2("text", 256), 1, 32))).alias("identity"))


@register(
    "window_identity",
    f"""WITH s AS (SELECT doc_id, {DNA} AS a, left(translate(md5(text), '{HEX}', 'TCAGTCAGTCAGTCAG'), 12) AS b FROM documents)
    SELECT doc_id, list_max(list_transform(range(0, 53), lambda o: len(list_filter(range(1, 13), lambda k: substr(a, o + k, 1) = substr(b, k, 1))) / 12.0::DOUBLE)) AS identity FROM s""",
    "identity",
)
def window_identity(t):
    rows = t.documents.select("doc_id", F.translate(F.sha2("text", 256), HEX, "TCAGTCAGTCAGTCAG").alias("a"), F.substring(F.translate(F.md5("text"), HEX, "TCAGTCAGTCAGTCAG"), 1, 12).alias("b"))
    return rows.select("doc_id", C.window_identity(F.col("a"), F.col("b")).alias("identity"))


def named(t):
    return t.nation.select("n_nationkey", "n_regionkey", "n_name")


@register("nw_identity")
def nw_identity(t):
    pairs = J.pairs_within(named(t), "n_nationkey", ["n_regionkey"], ["n_name"])
    return K.aligned_pairs(pairs, "n_name_a", "n_name_b").select("n_nationkey_a", "n_nationkey_b", "score", "identical", "compared", "identity")


@register("lcs_identity")
def lcs_identity(t):
    pairs = J.pairs_within(named(t), "n_nationkey", ["n_regionkey"], ["n_name"])
    return pairs.select("n_nationkey_a", "n_nationkey_b", K.subsequence_identity("n_name_a", "n_name_b").alias("identity"))


@register("formula_elements", "SELECT p_partkey, array_to_string(list_distinct(regexp_extract_all('C' || p_size || 'H' || p_partkey || 'FeCl2', '[A-Z][a-z]?')), '') <> '' AS any_element, len(list_distinct(regexp_extract_all('C' || p_size || 'H' || p_partkey || 'FeCl2', '[A-Z][a-z]?'))) AS n FROM part")
def formula_elements(t):
    e = C.elements_of(F.concat(F.lit("C"), F.col("p_size").cast("string"), F.lit("H"), F.col("p_partkey").cast("string"), F.lit("FeCl2")))
    return t.part.select("p_partkey", (F.size(e) > 0).alias("any_element"), F.size(e).cast("long").alias("n"))


@register("name_alignments", None, "score identity subsequence affine")
def name_alignments(t):
    """Every part's name aligned with the next part's: identity of a global alignment, longest common subsequence, and the score with affine gaps."""
    after = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next_name"))
    made = K.aligned_pairs(t.part.select("p_partkey", "p_name").join(after, "p_partkey"), "p_name", "next_name")
    return made.select("p_partkey", "score", "identical", "compared", "identity", K.subsequence_identity("p_name", "next_name").alias("subsequence"), K.affine_score("p_name", "next_name").alias("affine"))
