"""Sinks: delimited files, ledgers, sequences, payloads, graphs, reports."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """A fixed list of fields, nulls as empty cells; quotes are doubled and white space stays, so that csv() reads the same texts."""
    made = df.select(*fields).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"')
    made.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("quoteAll", True).csv(path)


def append_ledger(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """Append rows; raises where the ledger has other fields."""
    spark = df.sparkSession
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at) and spark.read.parquet(path).columns != list(fields):
        raise ValueError("the ledger has other fields")
    df.select(*fields).write.mode("append").parquet(path)


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def replace_table(df: DataFrame, path: str) -> None:
    """A new version beside the old one, then swapped in; the old one stays as a backup. A crash between leaves a whole version, which current_table() finds."""
    fs, at = _store(df.sparkSession, path)
    df.write.mode("overwrite").parquet(path + ".new")
    if fs.exists(at(path)):
        if fs.exists(at(path + ".bak")):
            fs.delete(at(path + ".last"), True)
            fs.rename(at(path + ".bak"), at(path + ".last"))
        fs.rename(at(path), at(path + ".bak"))
    fs.rename(at(path + ".new"), at(path))
    fs.delete(at(path + ".last"), True)


def current_table(spark: SparkSession, path: str) -> DataFrame:
    """The table of replace_table(): the newest whole version, also after a crash between its renames."""
    fs, at = _store(spark, path)
    versions = [path, path + ".new", path + ".bak", path + ".last"]
    whole = [v for v in versions if fs.exists(at(v)) and (v == path or fs.exists(at(v + "/_SUCCESS")))]
    if not whole:
        raise FileNotFoundError(path)
    return spark.read.parquet(whole[0])


def rewrite(spark: SparkSession, path: str, keep: Column, apply: bool = False) -> tuple[int, int]:
    """(rows kept, rows rejected) of a table by a condition; nothing is written unless it is told to apply, and then the old version stays as a backup."""
    rows = current_table(spark, path)
    good = F.coalesce(keep, F.lit(False))
    kept, rejected = rows.agg(F.count_if(good), F.count_if(~good)).first()
    if apply:
        replace_table(rows.where(good), path)
    return kept, rejected


def write_sheets(tables: dict[str, DataFrame], path: str) -> None:
    """A directory of CSV for each sheet."""
    for name, df in tables.items():
        write_csv(df, f"{path}/{name}", df.columns)


def write_fasta(df: DataFrame, path: str, header: str = "header", sequence: str = "sequence", width: int = 80) -> None:
    """Different records, sequences wrapped."""
    body = F.regexp_replace(F.regexp_replace(sequence, f"(.{{{width}}})", "$1\n"), "\n$", "")
    df.dropDuplicates([header, sequence]).select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), body).alias("value")).write.mode("overwrite").text(path)


def write_lines(df: DataFrame, path: str, fields: Sequence[str], separator: str = "\t", required: str | None = None) -> None:
    """Delimited lines without a header (structures, annotations, edge lists), rows without the required field left out."""
    rows = df.where(F.trim(required) != "") if required else df
    rows.select(F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]).alias("value")).write.mode("overwrite").text(path)


def workbooks(df: DataFrame, by: str, fields: Sequence[str], most: int = 1_048_575) -> DataFrame:
    """(path, content): a workbook for each value of a column, its rows as texts under a header; raises where a sheet can't hold them."""

    def book(pdf: pd.DataFrame) -> pd.DataFrame:
        from xml.sax.saxutils import escape

        if len(pdf) > most:
            raise ValueError("too many rows for a sheet")
        name = str(pdf["__by"].iloc[0])
        letter = lambda k: (letter(k // 26 - 1) if k > 25 else "") + chr(65 + k % 26)
        rows = [list(fields), *pdf[list(fields)].itertuples(index=False)]
        cells = "".join(f'<row r="{n}">' + "".join(f'<c r="{letter(k)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for k, v in enumerate(row) if v is not None) + "</row>" for n, row in enumerate(rows, 1))
        main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006"
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
            "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>',
        }
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            for part, text in parts.items():
                z.writestr(part, text)
        return pd.DataFrame({"path": [f"{name}.xlsx"], "content": [raw.getvalue()]})

    rows = df.select(F.col(by).cast("string").alias("__by"), *[F.col(c).cast("string").alias(c) for c in fields])
    return rows.groupBy("__by").applyInPandas(book, "path string, content binary")


# The lines that open a colour strip for tree viewers.
STRIP_HEAD = ["DATASET_COLORSTRIP", "SEPARATOR TAB", "DATASET_LABEL\t{title}", "COLOR\t#000000", "LEGEND_TITLE\t{title}", "LEGEND_SHAPES\t{shapes}", "LEGEND_COLORS\t{colours}", "LEGEND_LABELS\t{labels}", "DATA"]


def write_strip(df: DataFrame, path: str, title: str, node: str, label: str, colours: Mapping[str, str], other: str) -> None:
    """A tree's colour strip: the head, then node, colour and label of each row that names a node, in order of nodes; labels without a colour of their own take the other label's."""
    head = "\n".join(STRIP_HEAD).format(title=title, shapes="\t".join("1" * len(colours)), colours="\t".join(colours.values()), labels="\t".join(colours))
    name = F.coalesce(F.when(F.trim(label) != "", F.col(label)), F.lit(other))
    table = F.create_map(*[F.lit(x) for kv in colours.items() for x in kv])
    lines = df.where(F.trim(node) != "").select(F.lit(1).alias("part"), F.col(node).cast("string").alias("at"), F.concat_ws("\t", node, F.coalesce(F.try_element_at(table, name), F.lit(colours[other])), name).alias("value"))
    first = df.sparkSession.createDataFrame([(0, "", head)], "part int, at string, value string")
    first.union(lines).orderBy("part", "at", "value").select("value").write.mode("overwrite").text(path)


def manifest(values: dict[str, object]) -> str:
    return json.dumps(values, sort_keys=True, indent=2, default=str)


def payload(df: DataFrame, order: Sequence[str], most: int = 10_000) -> str:
    """A small table as a JSON array, in order; raises beyond the most."""
    rows = df.orderBy(*order).limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError("the table is too large for a payload")
    return "[" + ",".join(rows) + "]"


def gexf(nodes: DataFrame, edges: DataFrame, most: int = 100_000) -> str:
    """A small graph (id, label; src, dst) as GEXF."""
    from xml.sax.saxutils import quoteattr

    n, e = nodes.orderBy("id").limit(most + 1).collect(), edges.orderBy("src", "dst").limit(most + 1).collect()
    if max(len(n), len(e)) > most:
        raise ValueError("the graph is too large")
    body = "".join(f"<node id={quoteattr(str(r['id']))} label={quoteattr(str(r['label']))}/>" for r in n)
    links = "".join(f'<edge id="{k}" source={quoteattr(str(r["src"]))} target={quoteattr(str(r["dst"]))}/>' for k, r in enumerate(e))
    return f'<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed"><nodes>{body}</nodes><edges>{links}</edges></graph></gexf>'


def markdown(df: DataFrame, order: Sequence[str], most: int = 200) -> str:
    """A small result as a Markdown table; raises ValueError beyond that many rows."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    text = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *["| " + " | ".join(text(v) for v in r) + " |" for r in rows]])
