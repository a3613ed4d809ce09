"""Scientific text formats: sequences, coordinates, time series, run logs, settings."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.functions import columns as C


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, sequence) of each record; letters only, upper case. Records begin with a > at a line's start; others belong to the header."""
    text = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.trim("value") != "")
    at = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    return text.select(F.trim(at).alias("header"), C.normal_sequence(F.substring(F.col("value"), F.length(at) + 1, F.length("value"))).alias("sequence"))


def header_values(df: DataFrame, column: str = "header", keys: Sequence[str] = ("OS", "OX", "GN")) -> DataFrame:
    """KEY=value parts of a header, each up to the next KEY=."""
    pick = lambda k: F.trim(F.regexp_extract(column, rf"(?:^|[\s|]){k}=(.*?)(?=[\s|]+[A-Za-z_]+=|\||$)", 1))
    return df.withColumns({k.lower(): F.when(pick(k) != "", pick(k)) for k in keys})


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): numbered lines of each file, which is read whole."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))


def atoms(df: DataFrame) -> DataFrame:
    """Fixed-width atom records of lines, with the running number of the MODEL that they stand in (0 before the first)."""
    model = F.sum(F.col("value").startswith("MODEL").cast("int")).over(Window.partitionBy("path").orderBy("line"))
    cut = lambda a, b: F.trim(F.substring("value", a, b - a + 1))
    rows = df.withColumn("model", model).where(F.substring("value", 1, 6).isin("ATOM  ", "HETATM"))
    element = F.regexp_extract(F.when(cut(77, 78) != "", cut(77, 78)).otherwise(cut(13, 16)), "([A-Za-z]+)", 1)
    return rows.select(
        "path", "model", "line", cut(1, 6).alias("record"), cut(7, 11).try_cast("int").alias("serial"), cut(13, 16).alias("atom"), cut(18, 20).alias("residue"), cut(22, 22).alias("chain"),
        cut(23, 26).try_cast("int").alias("number"), *[C.safe_double(cut(a, b)).alias(n) for n, a, b in (("x", 31, 38), ("y", 39, 46), ("z", 47, 54))], F.upper(element).alias("element"),
    )


def poses(df: DataFrame) -> DataFrame:
    """(path, model, affinity, atoms): the modes of pose files without hydrogens."""
    model = F.sum(F.col("value").startswith("MODEL").cast("int")).over(Window.partitionBy("path").orderBy("line"))
    score = C.first_number(F.regexp_extract("value", r"^REMARK.*RESULT:\s*(\S+)", 1))
    scores = df.withColumn("model", model).groupBy("path", "model").agg(F.first(score, ignorenulls=True).alias("affinity"))
    each = atoms(df).where(F.col("element") != "H").groupBy("path", "model").agg(F.array_sort(F.collect_list(F.struct("line", "atom", "element", "x", "y", "z"))).alias("atoms"))
    return each.join(scores, ["path", "model"])


def mmcif_atoms(spark: SparkSession, path: str) -> DataFrame:
    """First-model atoms of _atom_site loops; author names before label names."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    names = ["path", "record", "element", "atom", "residue", "chain", "number", "x", "y", "z"]

    def read(batches):
        import shlex

        for pdf in batches:
            out = []
            for file, text in zip(pdf["path"], pdf["value"], strict=True):
                head: list[str] = []
                inside = False
                for line in text.splitlines():
                    s = line.strip()
                    if s.startswith("_atom_site."):
                        head.append(s.split(".", 1)[1].split()[0])
                        inside = True
                    elif inside and (not s or s.startswith(("#", "loop_", "_", "data_"))):
                        if out or s.startswith("#"):
                            break
                    elif inside:
                        r = dict(zip(head, shlex.split(s) if "'" in s or '"' in s else s.split(), strict=False))
                        if r.get("pdbx_PDB_model_num", "1") != "1":
                            continue
                        own = lambda k, r=r: r.get(f"auth_{k}") or r.get(f"label_{k}")
                        out.append((file, r.get("group_PDB"), r.get("type_symbol"), own("atom_id"), own("comp_id"), own("asym_id"), own("seq_id"), *[float(r[f"Cartn_{a}"]) for a in "xyz"]))
            yield pd.DataFrame(out, columns=names)

    return files.mapInPandas(read, "path string, record string, element string, atom string, residue string, chain string, number string, x double, y double, z double")


def components(spark: SparkSession, path: str) -> DataFrame:
    """(comp_id, name, kind, formula, elements) of a dictionary of data_ blocks, gzip files included."""
    block = spark.read.option("lineSep", "\ndata_").text(path).where(F.col("value").contains("_chem_comp."))
    pick = lambda k: F.regexp_replace(F.trim(F.regexp_extract("value", rf"(?m)^_chem_comp\.{k}\s+(.+?)\s*$", 1)), r"^[\"']|[\"']$", "")
    out = block.select(pick("id").alias("comp_id"), pick("name").alias("name"), pick("type").alias("kind"), pick("formula").alias("formula"))
    return out.withColumn("elements", F.transform(C.elements_of("formula"), F.upper))


def series(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Numeric columns of whitespace-separated files, comment lines (# and @) left out."""
    rows = lines(spark, path).where(~F.col("value").rlike(r"^\s*([#@]|$)")).withColumn("p", F.split(F.trim("value"), r"\s+"))
    return rows.select("path", "line", *[C.safe_double(F.get("p", F.lit(k))).alias(n) for k, n in enumerate(names)])


def iterations(df: DataFrame, pattern: str = r"^\s*(\d+)\s+\d+\s+\d+\s+(-?\d+\.\d+)\s+(-?\d+\.\d+)\s+(\d+\.\d+)\s+(\d+\.\d+)") -> DataFrame:
    """(path, line, iter, energy, change, density, metric) of a run log's iteration lines."""
    g = lambda k: F.regexp_extract("value", pattern, k)
    rows = df.where(F.col("value").rlike(pattern))
    return rows.select("path", "line", g(1).try_cast("int").alias("iter"), *[C.safe_double(g(k)).alias(n) for k, n in ((2, "energy"), (3, "change"), (4, "density"), (5, "metric"))])


def markers(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Whether each file has a line that matches each marker's pattern."""
    return df.groupBy("path").agg(*[F.coalesce(F.bool_or(F.col("value").rlike(p)), F.lit(False)).alias(n) for n, p in names.items()])


def titration(df: DataFrame) -> DataFrame:
    """(path, residue, number, pk) of lines like 'ASP-12   3.9'."""
    p = r"^\s*([A-Z]{2,3})[- ]?(\d+)\s+[<>]?\s*(-?\d+\.?\d*)"
    g = lambda k: F.regexp_extract("value", p, k)
    return df.where(F.col("value").rlike(p)).select("path", g(1).alias("residue"), g(2).try_cast("int").alias("number"), C.safe_double(g(3)).alias("pk"))


def settings(df: DataFrame) -> DataFrame:
    """(path, key, value): numeric key = value lines, comments left out; a key's last line counts."""
    rows = df.where(~F.col("value").rlike(r"^\s*(#|$)") & F.contains("value", F.lit("="))).withColumn("p", F.split(F.regexp_replace("value", "#.*$", ""), "=", 2))
    each = rows.select("path", "line", F.trim(F.col("p")[0]).alias("key"), C.safe_double(F.trim(F.col("p")[1])).alias("number")).where("number IS NOT NULL")
    return each.groupBy("path", "key").agg(F.max_by("number", "line").alias("value"))


def structure_ids(df: DataFrame, column: str) -> DataFrame:
    """Different four-character structure ids in texts, sorted."""
    return df.withColumn("ids", C.found_all(F.upper(column), r"\b[1-9][A-Z0-9]{3}\b"))
