"""Sources, sinks and streams on files made here."""

import gzip
import io
import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import scientific as X, sinks as K, tables as T
from tessera.streaming import ledgers as L


def test_csv_kinds(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"two\nlines"\n2,\n')
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("x,z\n3,q\n")
    (tmp_path / "c.csv").write_bytes("x,y\n4,中\n".encode("gb18030"))
    assert [tuple(r) for r in T.csv(spark, str(tmp_path / "a.csv"), blank=True).collect()] == [("1", "two\nlines"), ("2", "")]
    both = T.csv_union(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv.gz")])
    assert {(r.x, r.source_batch_file) for r in both.collect()} == {("1", "a.csv"), ("2", "a.csv"), ("3", "b.csv.gz")}
    assert T.csv_any_encoding(spark, str(tmp_path / "c.csv"), ["x", "y"]).first().y == "中"
    assert T.csv_or_empty(spark, str(tmp_path / "none.csv"), ["x"]).count() == 0
    with pytest.raises(FileNotFoundError):
        T.only_match(spark, str(tmp_path / "*.csv"))


def test_workbook(spark, tmp_path):
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>Gene Name</t></si><si><t>abc</t></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{ns}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><v>7</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(raw.getvalue())
    rows = T.sheet_table(T.workbook(spark, str(tmp_path / "b.xlsx")), {"gene": ["genename", "gene"], "n": ["n"]}).collect()
    assert [(r.row, r.gene, r.n) for r in rows] == [(3, "abc", "7")]


def test_sqlite_and_json(spark, tmp_path):
    with sqlite3.connect(tmp_path / "d.sqlite") as db:
        db.execute("CREATE TABLE t (a INTEGER, b TEXT)")
        db.execute("INSERT INTO t VALUES (1, 'x')")
    assert tuple(T.sqlite(spark, str(tmp_path / "d.sqlite"), "SELECT a, b FROM t", "a long, b string").first()) == (1, "x")
    doc = json.dumps({"hits": [{"Accession": "P1", "EValue": 1e-5}, {"more": {"accession": "P1", "evalue": "1e-9"}}]})
    assert tuple(T.best_hits(spark.createDataFrame([(doc,), ("not json",)], "j string"), "j").first()) == ("P1", 1e-9)


def test_library(spark):
    rows = spark.createDataFrame([("A", "10.1/X"), ("B", "doi:10.1/x"), ("", "10.1/y"), ("C", None)], "Title string, DOI string").coalesce(1)
    assert [r.Title for r in T.library(rows).orderBy("Title").collect()] == ["A", "C"]


def test_sequences(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">P1 thing OS=Homo sapiens OX=9606\nMK-\nlv\n>P2\nAA\n")
    rows = {r.header.split()[0]: r for r in X.header_values(X.fasta(spark, str(tmp_path / "a.fasta"))).collect()}
    assert rows["P1"].sequence == "MKLV" and rows["P1"].os == "Homo sapiens" and rows["P1"].ox == "9606" and rows["P2"].os is None
    K.write_fasta(spark.createDataFrame([("h", "A" * 100)], "header string, sequence string"), str(tmp_path / "out"), width=80)
    assert X.fasta(spark, str(tmp_path / "out")).first().sequence == "A" * 100


def test_structures(spark, tmp_path):
    line = "ATOM      1  CA  GLY A   7      11.000  12.500 -13.000  1.00  0.00           C  "
    (tmp_path / "p.pdbqt").write_text(f"MODEL 1\nREMARK VINA RESULT:   -7.5  0.0  0.0\n{line}\nENDMDL\nMODEL 2\nREMARK VINA RESULT:   -6.0  0.0  0.0\n{line}\nENDMDL\n")
    rows = X.poses(X.lines(spark, str(tmp_path / "p.pdbqt"))).orderBy("model").collect()
    assert [(r.model, r.affinity, r.atoms[0].z) for r in rows] == [(1, -7.5, -13.0), (2, -6.0, -13.0)]
    (tmp_path / "m.cif").write_text("data_X\nloop_\n_atom_site.group_PDB\n_atom_site.type_symbol\n_atom_site.label_atom_id\n_atom_site.auth_asym_id\n_atom_site.label_comp_id\n_atom_site.label_seq_id\n_atom_site.Cartn_x\n_atom_site.Cartn_y\n_atom_site.Cartn_z\n_atom_site.pdbx_PDB_model_num\nHETATM F F1 A LIG 1 1.0 2.0 3.0 1\nHETATM F F1 A LIG 1 1.0 2.0 3.0 2\n#\n")
    assert [(r.atom, r.chain, r.z) for r in X.mmcif_atoms(spark, str(tmp_path / "m.cif")).collect()] == [("F1", "A", 3.0)]
    (tmp_path / "c.cif").write_text("data_ABC\n_chem_comp.id ABC\n_chem_comp.name 'a name'\n_chem_comp.type NON-POLYMER\n_chem_comp.formula 'C6 H5 F'\n")
    assert tuple(X.components(spark, str(tmp_path / "c.cif")).first()) == ("ABC", "a name", "NON-POLYMER", "C6 H5 F", ["C", "H", "F"])


def test_series_logs_settings(spark, tmp_path):
    (tmp_path / "s.xvg").write_text("# c\n@ title\n0 1.5\n 1  2.5\n")
    assert [(r.t, r.v) for r in X.series(spark, str(tmp_path / "s.xvg"), ["t", "v"]).orderBy("t").collect()] == [(0.0, 1.5), (1.0, 2.5)]
    (tmp_path / "run.log").write_text(" ITER\n   1  0  0   -100.5   -0.5  0.25  0.125\n DENSITY CONVERGED\n")
    log = X.lines(spark, str(tmp_path / "run.log"))
    assert [(r.iter, r.energy, r.metric) for r in X.iterations(log).collect()] == [(1, -100.5, 0.125)]
    assert X.markers(log, {"done": "DENSITY CONVERGED", "bad": "ABNORMAL"}).first()[1:] == (True, False)
    (tmp_path / "box.conf").write_text("# c\ncenter_x = 1.5 # x\nname = z\ncenter_x=2\n")
    assert [(r.key, r.value) for r in X.settings(X.lines(spark, str(tmp_path / "box.conf"))).collect()] == [("center_x", 2.0)]
    assert X.structure_ids(spark.createDataFrame([("see 1abc, 2XYZ and 1ABC",)], "t string"), "t").first().ids == ["1ABC", "2XYZ"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "k int, v string").coalesce(1)
    K.write_csv(df, str(tmp_path / "csv"), ["v", "k"])
    assert sorted(r.k for r in T.csv(spark, str(tmp_path / "csv")).collect()) == ["1", "2"]
    K.append_ledger(df, str(tmp_path / "ledger"), ["k"])
    K.append_ledger(df, str(tmp_path / "ledger"), ["k"])
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 4
    with pytest.raises(ValueError, match="other fields"):
        K.append_ledger(df, str(tmp_path / "ledger"), ["v"])
    K.replace_table(df, str(tmp_path / "t"))
    K.replace_table(df.limit(1), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1 and spark.read.parquet(str(tmp_path / "t.bak")).count() == 2
    assert json.loads(K.payload(df, ["k"]))[1] == {"k": 2, "v": "b"} and "| 2 | b |" in K.markdown(df, ["k"])
    g = K.gexf(spark.createDataFrame([(1, "a")], "id int, label string"), spark.createDataFrame([(1, 1)], "src int, dst int"))
    assert '<node id="1" label="a"/>' in g


def test_a_swap_survives_a_crash(spark, tmp_path):
    at = str(tmp_path / "t")
    one = lambda k: spark.createDataFrame([(k,)], "k int")
    with pytest.raises(FileNotFoundError):
        K.current_table(spark, at)
    K.replace_table(one(1), at)
    K.replace_table(one(2), at)
    assert K.rewrite(spark, at, F.col("k") > 5) == (0, 1) and K.current_table(spark, at).first().k == 2
    # After the first rename, before the second: the new version is whole.
    one(3).write.parquet(at + ".new")
    (tmp_path / "t").rename(tmp_path / "t.gone")
    assert K.current_table(spark, at).first().k == 3
    # While the new version is being written there is no mark of success.
    (tmp_path / "t.new" / "_SUCCESS").unlink()
    assert K.current_table(spark, at).first().k == 1
    K.replace_table(one(4), at)
    assert spark.read.parquet(at).first().k == 4


def test_texts_survive_a_csv(spark, tmp_path):
    texts = ['a "quoted" one', " space ", "back\\slash", "two\nlines", "comma, here", "\\", '"', "tab\there"]
    K.write_csv(spark.createDataFrame(list(enumerate(texts)), "k int, v string"), str(tmp_path / "c"), ["k", "v"])
    assert [r.v for r in T.csv(spark, str(tmp_path / "c")).orderBy(F.col("k").cast("int")).collect()] == texts


def test_workbooks_written_here_are_read_here(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x & <y>", None), ("a", " two ", "q"), ("b", "only", "z")], "book string, v string, w string").coalesce(1)
    made = T.sheet_table(T.workbook_rows(K.workbooks(rows, "book", ["v", "w"])), {"v": ["v"], "w": ["w"]})
    assert sorted((r.path, r.v, r.w or "") for r in made.collect()) == [("a.xlsx", " two ", "q"), ("a.xlsx", "x & <y>", ""), ("b.xlsx", "only", "z")]
    assert K.workbooks(rows.limit(0), "book", ["v"]).count() == 0


def test_strip_names_colours_and_others(spark, tmp_path):
    rows = spark.createDataFrame([("n2", "A"), ("n1", "new"), ("n3", None), ("", "A")], "node string, kind string")
    K.write_strip(rows, str(tmp_path / "s"), "Kind", "node", "kind", {"A": "#111111", "Other": "#222222"}, "Other")
    text = "".join(p.read_text() for p in sorted((tmp_path / "s").glob("part-*")))
    assert text.splitlines()[:4] == ["DATASET_COLORSTRIP", "SEPARATOR TAB", "DATASET_LABEL\tKind", "COLOR\t#000000"]
    assert text.splitlines()[-4:] == ["DATA", "n1\t#222222\tnew", "n2\t#111111\tA", "n3\t#222222\tOther"]


def test_resuming_stream(spark, tmp_path):
    src, ledger = str(tmp_path / "in"), str(tmp_path / "ledger")
    spark.createDataFrame([(1,), (2,), (2,)], "k long").coalesce(1).write.parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema("k long").parquet(src)
        L.resuming(stream, ledger, "k", lambda df: df.withColumn("done", F.lit(True))).option("checkpointLocation", str(tmp_path / f"c{_}")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(ledger).collect()) == [1, 2]


def test_sessions(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (1, "2024-01-01 02:00:00")], "u int, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in L.sessions(rows, "t", "10 minutes", ["u"]).collect()) == [1, 2]


def test_guard_and_windows_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 5.0, "2024-01-01 00:00:00"), ("a", 1.0, "2024-01-01 00:01:00"), ("a", 400.0, "2024-01-01 00:02:00"), ("b", 1.0, "2024-01-01 01:00:00")], "k string, v double, t string")
    rows.withColumn("t", F.to_timestamp("t")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, v double, t timestamp").parquet(str(tmp_path / "in"))
    for name, df, mode in (("guard", L.guarded(stream, "k", "v", 300.0), "update"), ("win", L.windowed(stream, "t", "1 hour", ["k"], "v"), "complete"), ("seen", L.first_seen(stream, "k", "t", "1 hour"), "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert {r.key: (r.n, r.verdict) for r in spark.table("guard").collect()} == {"a": (3, "cliff"), "b": (1, "watching")}
    assert sorted((r.k, r.n, r.total) for r in spark.table("win").collect()) == [("a", 3, 406.0), ("b", 1, 1.0)]
    assert sorted(r.k for r in spark.table("seen").collect()) == ["a", "b"]


def old_workbook(strings, formula):
    """A workbook of the older format: a column of shared strings, in records of at most 8,224 bytes, and a formula with a text."""
    import struct

    record = lambda kind, b: struct.pack("<HH", kind, len(b)) + b
    parts, now = [], struct.pack("<II", len(strings), len(strings))
    for s in strings:
        wide = not s.isascii()
        head = struct.pack("<HB", len(s), wide)
        if len(now) + len(head) + 2 > 8224:
            parts.append(now)
            now = b""
        now += head
        for c in s:
            b = c.encode("utf-16-le" if wide else "latin-1")
            if len(now) + len(b) > 8224:
                parts.append(now)
                now = bytes([wide])
            now += b
    parts.append(now)
    table = record(0xFC, parts[0]) + b"".join(record(0x3C, p) for p in parts[1:])
    name = b"\x04\x00Data"
    start = record(0x809, b"\0" * 16)
    first = len(start) + 4 + 6 + len(name) + len(table)
    sheet = record(0x809, b"\0" * 16) + b"".join(record(0xFD, struct.pack("<HHHI", k, 0, 0, k)) for k in range(len(strings)))
    sheet += record(0x06, struct.pack("<HHH", len(strings), 0, 0) + b"\0" * 6 + b"\xff\xff" + b"\0" * 6) + record(0x207, struct.pack("<HB", len(formula), 0) + formula.encode())
    book = start + record(0x85, struct.pack("<IH", first, 0) + name) + table + sheet
    book += b"\0" * (-len(book) % 512)
    n = len(book) // 512
    chain = [*range(1, n), -2, -2, -3]
    fat = struct.pack(f"<{len(chain)}i", *chain)
    assert len(fat) <= 512
    entry = lambda name, kind, at, size: (name + "\0").encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<iI", at, size) + b"\0" * 4
    folder = (entry("Root Entry", 5, -2, 0) + entry("Workbook", 2, 0, len(book))).ljust(512, b"\0")
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IiIIiIiI", 1, n, 0, 4096, -2, 0, -2, 0) + struct.pack("<109i", n + 1, *[-1] * 108)
    return head.ljust(512, b"\0") + book + folder + fat.ljust(512, b"\xff")


def test_strings_across_records():
    from tessera.sources.tables import xls_rows

    strings = [f"string number {k} " + "abcdé"[k % 5] * (k % 90) for k in range(400)] + ["x" * 9000, "ü" * 9000, "end"]
    rows = xls_rows(old_workbook(strings, "computed"))
    assert [r[2] for r in rows] == [[s] for s in strings] + [["computed"]] and {r[0] for r in rows} == {"Data"}


def test_a_file_in_no_encoding_raises(spark, tmp_path):
    for name, raw in (("a.csv", "x,y\n1,é\n".encode("latin-1")), ("b.csv", b"x,y\n1,2\n")):
        (tmp_path / name).write_bytes(raw)
    with pytest.raises(Exception, match="in none of the encodings"):
        T.csv_any_encoding(spark, str(tmp_path / "*.csv"), ["x", "y"], ("utf-8",)).collect()


def test_csv_lines_may_be_split(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n" + "".join(f"{k},\"v {k}\"\n" for k in range(50)))
    assert sorted(map(tuple, T.csv(spark, str(tmp_path / "a.csv"), multi_line=False).collect())) == sorted((str(k), f"v {k}") for k in range(50))


def test_records_begin_at_a_line(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one 5->3 exonuclease\nACG\nT\r\n>two > three\r\nGG\n>\nAA\n")
    got = {(r.header, r.sequence) for r in X.fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert got == {("one 5->3 exonuclease", "ACGT"), ("two > three", "GG"), ("", "AA")}
    (tmp_path / "c.cif").write_text("data_AB\n_chem_comp.id AB\n_chem_comp.name 'has data_ inside'\n_chem_comp.type x\n_chem_comp.formula 'C2 H4'\ndata_CD\n_chem_comp.id CD\n_chem_comp.name y\n_chem_comp.type z\n_chem_comp.formula O\n")
    assert {(r.comp_id, r.name) for r in X.components(spark, str(tmp_path / "c.cif")).collect()} == {("AB", "has data_ inside"), ("CD", "y")}


def test_guard_by_time_under_shuffled_arrival(spark, tmp_path):
    """The same verdicts whatever the order of arrival, and those of the table; idle keys end and are forgotten."""
    import random

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rng = random.Random(4)
        readings = [(k, 60 * m + rng.randint(0, 50), rng.choice((1.0, 5.0, 400.0, 320.0))) for k in ("a", "b", "c") for m in range(8)] + [("a", 70, None)]
        frame = lambda rows: spark.createDataFrame(rows, "k string, s long, v double").withColumn("t", F.timestamp_seconds("s")).drop("s")
        want = sorted((r.key, r.at, r.n, r.best, r.last, r.verdict) for r in L.guard_table(frame(readings), "k", "t", "v", 300.0).collect())
        for trial in range(2):
            rng.shuffle(readings)
            folder = tmp_path / f"in{trial}"
            parts = [readings[i::4] for i in range(4)] + [[("z", 20_000, 1.0)], [("z", 40_000, 1.0)]]
            for i, part in enumerate(parts):
                frame(part).coalesce(1).write.mode("append").parquet(str(folder / f"{i}"))
            stream = spark.readStream.schema("k string, v double, t timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
            guarded = L.guarded_by_time(stream, "k", "t", "v", 300.0, "2 hours", "30 minutes")
            name = f"timed{trial}"
            guarded.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
            made = [tuple(r) for r in spark.table(name).collect()]
            assert sorted(r for r in made if r[5] != "ended" and r[0] != "z") == want
            assert sorted(r[0] for r in made if r[5] == "ended" and r[0] != "z") == ["a", "b", "c"]
        assert {r[5] for r in want} == {"cliff", "watching"}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
