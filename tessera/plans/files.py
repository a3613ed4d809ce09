"""Queries of sources and sinks: tables are written whole in a format and read back by the source of that format."""

import sqlite3
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import selection as S
from tessera.plans.catalog import register
from tessera.sources import scientific as X, sinks as K, tables as T
from tessera.sources.shared import scratch
from tessera.streaming import ledgers as L


def folder(t, kind):
    return scratch(t._spark, kind)


# --- Delimited files ---------------------------------------------------------------------------------------------------


@register("csv_round_trip", "SELECT doc_id::VARCHAR AS doc_id, sha256(text) AS sha, source, coalesce(lang, '') AS lang FROM documents")
def csv_round_trip(t):
    at = folder(t, "csv")
    K.write_csv(t.documents, at, ["doc_id", "text", "source", "lang"])
    return T.csv(t._spark, at, blank=True).select("doc_id", F.sha2("text", 256).alias("sha"), "source", "lang")


@register("csv_gzip", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders", "o_totalprice")
def csv_gzip(t):
    at = folder(t, "csv")
    t.orders.write.option("header", True).option("compression", "gzip").csv(at)
    rows = T.csv(t._spark, at)
    return rows.select(*[F.col(c).cast("long").alias(c) for c in ("o_orderkey", "o_custkey")], C.safe_double(F.col("o_totalprice")).alias("o_totalprice"), "o_orderpriority")


@register("csv_encodings", "SELECT doc_id, sha256(text) AS sha, 'csv' AS ending FROM documents")
def csv_encodings(t):
    """One half of the texts in UTF-16, the other in UTF-8: each file is read in the first encoding that fits."""
    at = folder(t, "csv")
    for k, encoding in enumerate(("UTF-8", "UTF-16")):
        part = t.documents.where(F.col("doc_id") % 2 == k).select("doc_id", "text")
        part.write.option("header", True).option("encoding", encoding).option("escape", '"').option("quoteAll", True).csv(f"{at}/part={k}")
    rows = T.csv_any_encoding(t._spark, f"{at}/*/*.csv", ["doc_id", "text"], ("utf-8-sig", "utf-16"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2("text", 256).alias("sha"), F.element_at(F.split("source_file", r"\."), -1).alias("ending"))


@register("csv_union_files", "SELECT n_name AS name, n_nationkey::VARCHAR AS key, NULL AS region, true AS named FROM nation UNION ALL SELECT r_name, NULL, r_regionkey::VARCHAR, true FROM region")
def csv_union_files(t):
    a, b = folder(t, "csv"), folder(t, "csv")
    K.write_csv(t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")), a, ["name", "key"])
    K.write_csv(t.region.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region")), b, ["name", "region"])
    rows = T.csv_union(t._spark, [a, b])
    return rows.select("name", "key", "region", F.col("source_batch_file").endswith(".csv").alias("named"))


@register("only_file", "SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM region")
def only_file(t):
    """The one batch that a pattern matches, and no rows of a file that is not there."""
    at = folder(t, "batches")
    K.write_csv(t.region, f"{at}/batch-1", ["r_regionkey", "r_name"])
    found = T.csv(t._spark, T.only_match(t._spark, f"{at}/batch-*"))
    return found.union(T.csv_or_empty(t._spark, f"{at}/other", ["r_regionkey", "r_name"]))


# --- Workbooks and databases ---------------------------------------------------------------------------------------------


@register("workbook_sheets", "SELECT n_regionkey::VARCHAR || '.xlsx' AS path, n_nationkey::VARCHAR AS key, n_name AS name FROM nation")
def workbook_sheets(t):
    files = K.workbooks(t.nation.withColumnRenamed("n_name", "Nation Name"), "n_regionkey", ["Nation Name", "n_nationkey"])
    return T.sheet_table(T.workbook_rows(files), {"key": ["key", "n_nationkey"], "name": ["nationname", "name"]}).select("path", "key", "name")


@register("sheet_folders", "SELECT 'nation' AS sheet, n_name AS name FROM nation UNION ALL SELECT 'region', r_name FROM region")
def sheet_folders(t):
    at = folder(t, "sheets")
    K.write_sheets({"nation": t.nation.select(F.col("n_name").alias("name")), "region": t.region.select(F.col("r_name").alias("name"))}, at)
    one = lambda name: T.csv(t._spark, f"{at}/{name}").select(F.lit(name).alias("sheet"), "name")
    return one("nation").union(one("region"))


@register("sqlite_join", "SELECT r_name, n_name, s_name, s_acctbal FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON n_nationkey = s_nationkey", "s_acctbal")
def sqlite_join(t):
    """A database file of three tables for each nation with suppliers, each read by one join."""
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))

    def database(pdf: pd.DataFrame) -> pd.DataFrame:
        with tempfile.NamedTemporaryFile(suffix=".sqlite") as f:
            with sqlite3.connect(f.name) as db:
                pdf[["r_regionkey", "r_name"]].drop_duplicates().to_sql("region", db, index=False)
                pdf[["n_nationkey", "n_name", "n_regionkey"]].drop_duplicates().to_sql("nation", db, index=False)
                pdf[["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]].to_sql("supplier", db, index=False)
            db.close()
            return pd.DataFrame({"content": [open(f.name, "rb").read()]})

    files = rows.groupBy("n_nationkey").applyInPandas(database, "content binary")
    query = "SELECT r_name, n_name, s_name, s_acctbal FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON n_nationkey = s_nationkey"
    return T.sqlite_rows(files, query, "r_name string, n_name string, s_name string, s_acctbal double")


# --- Scientific formats --------------------------------------------------------------------------------------------------


@register(
    "fasta_records",
    """SELECT 'P' || p_partkey AS id, p_name AS os, p_size::VARCHAR AS ox, p_brand AS gn, regexp_replace(upper(p_type || p_name || p_brand), '[^A-Z]', '', 'g') AS sequence FROM part""",
)
def fasta_records(t):
    at = folder(t, "fasta")
    header = F.concat(F.lit("P"), F.col("p_partkey"), F.lit(" OS="), F.col("p_name"), F.lit(" OX="), F.col("p_size"), F.lit(" GN="), F.col("p_brand"))
    K.write_fasta(t.part.select(header.alias("header"), C.normal_sequence(F.concat("p_type", "p_name", "p_brand")).alias("sequence")), at, width=8)
    rows = X.header_values(X.fasta(t._spark, at))
    return rows.select(F.split("header", " ")[0].alias("id"), "os", "ox", "gn", "sequence")


def atom_line(serial, number, x, y, z, name="CA", element="C"):
    return F.format_string(f"ATOM  %5d {name:^4} GLY A%4d    %8.3f%8.3f%8.3f  1.00  0.00           {element}", serial, number, x, y, z)


@register(
    "atom_records",
    "SELECT c_custkey % 100000 AS serial, 'CA' AS atom, 'GLY' AS residue, 'A' AS chain, c_nationkey AS number, c_acctbal / 10 AS x, c_nationkey AS y, -(c_custkey % 1000) AS z, 'C' AS element FROM customer",
    "x y z",
)
def atom_records(t):
    at = folder(t, "atoms")
    line = atom_line(F.col("c_custkey") % 100000, F.col("c_nationkey"), F.col("c_acctbal") / 10, F.col("c_nationkey").cast("double"), -(F.col("c_custkey") % 1000).cast("double"))
    t.customer.select(line.alias("value")).write.text(at)
    rows = X.atoms(X.lines(t._spark, at))
    return rows.select(F.col("serial").cast("long").alias("serial"), "atom", "residue", "chain", "number", "x", "y", "z", "element")


@register(
    "pose_models",
    """SELECT s_nationkey::VARCHAR AS file, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS model, s_acctbal AS affinity, 1 AS atoms, s_suppkey % 1000 AS x FROM supplier""",
    "affinity x",
)
def pose_models(t):
    """A file of models for each nation: the hydrogen of each is left out."""
    at = folder(t, "poses")
    x, zero = (F.col("s_suppkey") % 1000).cast("double"), F.lit(0.0)
    body = F.concat_ws("\n", F.lit("MODEL"), F.format_string("REMARK VINA RESULT:   %.2f  0.0  0.0", "s_acctbal"), atom_line(F.lit(1), F.lit(7), x, zero, zero), atom_line(F.lit(2), F.lit(7), zero, zero, zero, "H1", "H"), F.lit("ENDMDL"))
    rows = t.supplier.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey")
    rows.select("s_nationkey", body.alias("value")).write.partitionBy("s_nationkey").text(at)
    found = X.poses(X.lines(t._spark, at).withColumn("path", F.element_at(F.split("path", "/"), -2)))
    return found.select(F.split("path", "=")[1].alias("file"), F.col("model").cast("long").alias("model"), "affinity", F.size("atoms").alias("atoms"), F.col("atoms")[0]["x"].alias("x"))


@register("mmcif_first_models", "SELECT n_regionkey::VARCHAR AS file, 'N' || n_nationkey AS atom, 'X' AS chain, n_nationkey AS x, n_regionkey AS y FROM nation", "x y")
def mmcif_first_models(t):
    """A structure for each region with its nations as atoms, in two models; author names come before label names."""
    at = folder(t, "mmcif")
    names = ["group_PDB", "type_symbol", "label_atom_id", "auth_asym_id", "label_asym_id", "label_comp_id", "label_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "pdbx_PDB_model_num"]
    atom = lambda model: F.format_string(f"HETATM C N%d X Q LIG 1 %d.0 %d.0 0.0 {model}", "n_nationkey", "n_nationkey", "n_regionkey")
    loop = lambda model: F.array_join(F.array_sort(F.collect_list(atom(model))), "\n")
    head = "data_X\nloop_\n" + "\n".join(f"_atom_site.{n}" for n in names)
    files = t.nation.groupBy("n_regionkey").agg(F.concat_ws("\n", F.lit(head), loop(1), loop(2), F.lit("#")).alias("value"))
    files.write.partitionBy("n_regionkey").text(at)
    rows = X.mmcif_atoms(t._spark, f"{at}/*/*.txt")
    return rows.select(F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).alias("file"), "atom", "chain", "x", "y")


@register(
    "chemical_components",
    "SELECT 'C' || p_partkey AS comp_id, p_name AS name, p_type AS kind, 'C' || p_size || ' H' || p_partkey % 9 || CASE WHEN p_size % 2 = 0 THEN ' F' ELSE ' Cl2' END AS formula, CASE WHEN p_size % 2 = 0 THEN 'C;H;F' ELSE 'C;H;CL' END AS elements FROM part",
)
def chemical_components(t):
    at = folder(t, "components")
    formula = F.format_string("C%d H%d", F.col("p_size"), F.col("p_partkey") % 9)
    lines = F.concat(
        F.lit("data_C"), F.col("p_partkey"), F.lit("\n_chem_comp.id C"), F.col("p_partkey"), F.lit("\n_chem_comp.name '"), F.col("p_name"), F.lit("'\n_chem_comp.type '"), F.col("p_type"),
        F.lit("'\n_chem_comp.formula '"), formula, F.when(F.col("p_size") % 2 == 0, " F").otherwise(" Cl2"), F.lit("'"),
    )
    t.part.select(lines.alias("value")).write.option("compression", "gzip").text(at)
    return X.components(t._spark, at).withColumn("elements", F.array_join("elements", ";"))


@register("series_files", "SELECT event_id::DOUBLE AS t, value FROM events", "t value")
def series_files(t):
    at = folder(t, "series")
    t.events.select(F.concat(F.when(F.col("event_id") % 10 == 0, "# a comment\n@ title\n").otherwise(""), F.col("event_id"), F.lit("   "), F.coalesce(F.col("value").cast("string"), F.lit("-")), F.lit(" ")).alias("value")).write.text(at)
    return X.series(t._spark, at, ["t", "value"]).select("t", "value")


def run_logs(t):
    at = folder(t, "logs")
    line = F.format_string("   %d  0  0   -%d.5   -0.25  0.5  %.2f", F.col("s_suppkey"), F.col("s_suppkey"), F.abs("s_acctbal"))
    end = F.when((F.col("s_suppkey") % 3) == 0, F.lit("\n DENSITY CONVERGED")).otherwise("")
    rows = t.supplier.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey")
    rows.select("s_nationkey", F.concat(F.lit(" ITER EX DEM\n"), line, end).alias("value")).write.partitionBy("s_nationkey").text(at)
    return X.lines(t._spark, at).withColumn("path", F.split(F.element_at(F.split("path", "/"), -2), "=")[1])


@register("log_iterations", "SELECT s_nationkey::VARCHAR AS file, s_suppkey AS iter, -s_suppkey - 0.5 AS energy, -0.25 AS change, 0.5 AS density, abs(s_acctbal) AS metric FROM supplier", "energy change density metric")
def log_iterations(t):
    return X.iterations(run_logs(t)).select(F.col("path").alias("file"), F.col("iter").cast("long").alias("iter"), "energy", "change", "density", "metric")


@register("log_markers", "SELECT s_nationkey::VARCHAR AS file, bool_or(s_suppkey % 3 = 0) AS converged, false AS failed FROM supplier GROUP BY ALL")
def log_markers(t):
    return X.markers(run_logs(t), {"converged": "DENSITY CONVERGED", "failed": "ABNORMAL"}).withColumnRenamed("path", "file")


@register("titration_tables", "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'ASP' ELSE 'HIS' END AS residue, c_custkey AS number, c_nationkey / 2 AS pk FROM customer", "pk")
def titration_tables(t):
    at = folder(t, "titration")
    name = F.when(F.col("c_custkey") % 2 == 0, "ASP").otherwise("HIS")
    t.customer.select(F.concat(F.lit("Site and pK\n"), name, F.lit("-"), F.col("c_custkey"), F.lit("   "), F.format_string("%.1f", F.col("c_nationkey") / 2)).alias("value")).write.text(at)
    return X.titration(X.lines(t._spark, at)).select("residue", F.col("number").cast("long").alias("number"), "pk")


@register("settings_files", "SELECT s_nationkey::VARCHAR AS file, 'size_' || s_suppkey % 3 AS key, max_by(s_acctbal, s_suppkey) AS value FROM supplier GROUP BY ALL", "value")
def settings_files(t):
    """A file for each nation; a key's last line counts."""
    at = folder(t, "settings")
    line = F.concat(F.lit("# box\nname = none\nsize_"), F.col("s_suppkey") % 3, F.lit(" = "), F.col("s_acctbal"), F.lit("  # in all"))
    rows = t.supplier.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey")
    rows.select("s_nationkey", line.alias("value")).write.partitionBy("s_nationkey").text(at)
    rows = X.lines(t._spark, at).withColumn("path", F.split(F.element_at(F.split("path", "/"), -2), "=")[1])
    return X.settings(rows).select(F.col("path").alias("file"), "key", "value")


@register(
    "structure_ids",
    "SELECT o_orderkey, array_to_string(list_sort(list_concat([year(o_orderdate)::VARCHAR], CASE o_orderkey % 3 WHEN 0 THEN ['1ABC', '9XYZ'] WHEN 1 THEN [] ELSE ['2A0B'] END)), ';') AS ids FROM orders",
)
def structure_ids(t):
    text = F.concat_ws(" ", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority", C.first_match([(F.col("o_orderkey") % 3 == 0, "see 9xyz, 1abc, 9XYZ, 0ABC"), (F.col("o_orderkey") % 3 == 1, "none 12345")], "in 2a0b."))
    return X.structure_ids(t.orders.withColumn("text", text), "text").select("o_orderkey", F.array_join("ids", ";").alias("ids"))


# --- Snapshots and exports ----------------------------------------------------------------------------------------------


@register("snapshot_lines", "SELECT event_id, event_type, value FROM events", "value")
def snapshot_lines(t):
    at = folder(t, "json")
    t.events.select("event_id", "event_type", "value").write.json(at)
    return T.snapshots(t._spark, at, "event_id long, event_type string, value double")


@register("snapshot_variants", "SELECT event_id, event_type FROM events")
def snapshot_variants(t):
    at = folder(t, "json")
    t.events.select("event_id", F.struct("event_type").alias("more")).write.json(at)
    pick = lambda path, kind: F.try_variant_get("document", path, kind)
    return T.snapshots(t._spark, at).select(pick("$.event_id", "long").alias("event_id"), pick("$.more.event_type", "string").alias("event_type"))


@register("best_hit_scores", "SELECT p_brand AS accession, least(min(p_retailprice), min(p_size)) AS evalue FROM part GROUP BY p_brand", "evalue")
def best_hit_scores(t):
    hits = F.struct(F.array(F.struct(F.col("p_brand").alias("Accession"), F.col("p_retailprice").alias("EValue"))).alias("hits"), F.struct(F.col("p_brand").alias("ACCESSION"), F.col("p_size").cast("string").alias("evalue")).alias("more"))
    return T.best_hits(t.part.select(F.to_json(hits).alias("answer")), "answer")


@register("library_export", "SELECT DISTINCT 'Title ' || p_size AS Title, left(md5('10.1/x' || p_size), 10) AS id FROM part")
def library_export(t):
    at = folder(t, "library")
    rows = t.part.select(F.concat(F.lit("Title "), F.col("p_size")).alias("Title"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "https://doi.org/10.1/X").otherwise("doi: 10.1/x"), F.col("p_size")).alias("DOI"))
    K.write_csv(rows.union(t.region.select(F.lit(" "), F.col("r_name"))), at, ["Title", "DOI"])
    return T.library(T.csv(t._spark, at)).select("Title", "id")


# --- Sinks -----------------------------------------------------------------------------------------------------------------


@register("ledger_appends", "SELECT r_regionkey, count(*) AS n FROM (SELECT r_regionkey FROM region UNION ALL SELECT r_regionkey FROM region) GROUP BY r_regionkey")
def ledger_appends(t):
    at = folder(t, "ledger")
    for _ in range(2):
        K.append_ledger(t.region, at, ["r_regionkey"])
    return t._spark.read.parquet(at).groupBy("r_regionkey").agg(F.count("*").alias("n"))


@register("ledger_lookup", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def ledger_lookup(t):
    return L.unprocessed(t.orders, t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("o_orderkey")


@register("table_versions", "SELECT 'now' AS version, r_name FROM region WHERE r_regionkey > 1 UNION ALL SELECT 'backup', r_name FROM region")
def table_versions(t):
    """A rewrite that is only tried leaves the table; one that is applied leaves a backup."""
    at = folder(t, "table")
    K.replace_table(t.region, at)
    K.rewrite(t._spark, at, F.col("r_regionkey") > 3)
    K.rewrite(t._spark, at, F.col("r_regionkey") > 1, apply=True)
    one = lambda df, name: df.select(F.lit(name).alias("version"), "r_name")
    return one(K.current_table(t._spark, at), "now").union(one(t._spark.read.parquet(at + ".bak"), "backup"))


@register("manifest_text", """SELECT '{' || chr(10) || '  "customers": ' || (SELECT count(*) FROM customer) || ',' || chr(10) || '  "source": "tables"' || chr(10) || '}' AS manifest""")
def manifest_text(t):
    return t._spark.createDataFrame([(K.manifest({"source": "tables", "customers": t.customer.count()}),)], "manifest string")


@register("payload_text", """SELECT '[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}', ',' ORDER BY n_nationkey) || ']' AS payload FROM nation""")
def payload_text(t):
    return t._spark.createDataFrame([(K.payload(t.nation, ["n_nationkey"]),)], "payload string")


STRIP = {"AFRICA": "#aa0000", "ASIA": "#00aa00", "Unknown": "#999999"}


@register(
    "strip_lines",
    "SELECT n_name AS node, "
    + "CASE r_name "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STRIP.items())
    + " ELSE '#999999' END AS colour, r_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'DATASET_LABEL', 'Region', NULL UNION ALL SELECT 'LEGEND_COLORS', '#aa0000', '#00aa00'",
)
def strip_lines(t):
    at = folder(t, "strip")
    K.write_strip(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")), at, "Region", "n_name", "r_name", STRIP, "Unknown")
    parts = t._spark.read.text(at).select(F.split("value", "\t").alias("p"))
    rows = parts.where(F.col("p")[0].startswith("NATION") | F.col("p")[0].isin("DATASET_LABEL", "LEGEND_COLORS"))
    return rows.select(F.col("p")[0].alias("node"), F.get("p", F.lit(1)).alias("colour"), F.get("p", F.lit(2)).alias("label"))


@register("edge_lines", "SELECT n_name AS src, n_regionkey::VARCHAR AS dst, 25 + 0 * n_nationkey AS nodes FROM nation")
def edge_lines(t):
    """Nations to regions as lines of edges; the same graph as GEXF has a node for each nation."""
    at = folder(t, "edges")
    K.write_lines(t.nation, at, ["n_name", "n_regionkey"], required="n_name")
    graph = K.gexf(t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label")), t.nation.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst")))
    return t._spark.read.text(at).select(F.split("value", "\t")[0].alias("src"), F.split("value", "\t")[1].alias("dst"), F.lit(graph.count("<node ")).alias("nodes"))


@register("markdown_lines", "SELECT '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' AS line FROM nation UNION ALL SELECT '| n_nationkey | n_name | n_regionkey |' UNION ALL SELECT '| --- | --- | --- |'")
def markdown_lines(t):
    made = t._spark.createDataFrame([(K.markdown(t.nation, ["n_nationkey"]),)], "value string")
    return made.select(F.explode(F.split("value", "\n")).alias("line"))


@register("structure_lines", "SELECT p_type || ' P' || p_partkey AS line FROM part WHERE p_size % 4 <> 0")
def structure_lines(t):
    at = folder(t, "lines")
    rows = t.part.select(F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.col("p_type")).alias("smiles"), F.concat(F.lit("P"), F.col("p_partkey")).alias("id"))
    K.write_lines(rows, at, ["smiles", "id"], separator=" ", required="smiles")
    return t._spark.read.text(at).select(F.col("value").alias("line"))


@register("complete_rows", "SELECT doc_id, n_chars FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL AND doc_id % 7 <> 0")
def complete_rows(t):
    rows = t.documents.withColumn("score", F.when(F.col("doc_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.lit(1.0)))
    return S.complete_rows(rows, ["lang", "text", "score"]).select("doc_id", "n_chars")
