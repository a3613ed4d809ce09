"""Homomorphic document fingerprints: wide vectors hashed from paragraphs, summed modulo powers of two.

A paragraph is a line, empty ones included. Its vector has WIDE lanes modulo 2**62, hashed from the whole paragraph, and
LANES lanes modulo 2**32, which count the paragraph's phrases whose hash has that lane's bit; one more lane counts the phrases. A
text's vector is the sum over its paragraphs, whatever their order: equal multisets of paragraphs have equal
fingerprints, and paragraphs are inserted or deleted by adding or subtracting their vector (added()). The
counting lanes are a random projection, so that the cosine of two of them estimates how many phrases two texts share.

All of it is DataFrame expressions. Successors by id are found on ids and hashes alone, in ranges of a sort; a text then
sends its successor's part of the edited text, and its lanes, to the one before.

Defined results: a null or empty text has one empty paragraph; equal texts have equal fingerprints;
repeated rows are neighbours of each other; rows of one id follow by the text's hash; null ids come first (and the lowest
long counts as none); an empty table gives an empty result; other columns are ignored.
Very long texts are taken in whole: their phrases are rows of a table before they are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm import common

LANES = 64
MODULUS = 2**62 - 1
NONE = -(2**63)
#: A paragraph's phrases end at white space after punctuation or after a word of six letters or more, about every third word,
#: and at each letter of a script that puts no spaces between words.
UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\x{20000}-\x{3FFFF}]"
PHRASES = rf"(?=\s)(?:(?<=\p{{P}})|(?<=\S{{6}}))[^\S\n]+|(?<={UNSPACED})(?=\S)"
SEEDS = (1, 2, 3)


def paragraph_sums(text: Column) -> Column:
    """The wide lanes of a text: paragraph hashes, summed modulo 2**62."""
    start = F.array(*[F.lit(0).cast("long") for _ in SEEDS])
    add = lambda acc, p: F.array(*[(acc[k] + F.xxhash64(p, F.lit(s)).bitwiseAND(F.lit(MODULUS))).bitwiseAND(F.lit(MODULUS)) for k, s in enumerate(SEEDS)])
    return F.aggregate(F.split(text, "\n"), start, add)


def vectors(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and vector, a struct of wide and counted lanes, of a table with the column text and keys of its rows; counts are summed after partial aggregation."""
    # A line's end ends a phrase, so one split gives the phrases of all paragraphs.
    wide = texts.select(*keys, paragraph_sums(F.col("text")).alias("wide"), "text").select(*keys, *[F.col("wide")[k].alias(f"_w{k}") for k in range(len(SEEDS))], "text")
    named = [c for c in wide.columns if c != "text"]
    each = wide.select(*named, F.explode(F.split("text", rf"\n|{PHRASES}")).alias("phrase")).select(*named, F.xxhash64("phrase").alias("h"))
    half = LANES // 2
    # Bits k and k + 32 of the hash are counted in the two halves of a long.
    pair = F.lit((1 << 32) | 1)
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(pair)).alias(f"_s{k}") for k in range(half)]
    grouped = each.groupBy(*named).agg(F.count("*").alias("_n"), *sums)
    low = [F.col(f"_s{k}").bitwiseAND(F.lit(2**32 - 1)) for k in range(half)]
    high = [F.shiftrightunsigned(f"_s{k}", 32) for k in range(half)]
    return grouped.select(*keys, F.struct(F.array(*[f"_w{k}" for k in range(len(SEEDS))]).alias("wide"), F.array(*low, *high, "_n").alias("counts")).alias("vector"))


def added(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of a text with the paragraphs of another put in (sign 1) or taken out (sign -1)."""
    lanes = lambda name, modulus: F.transform(F.zip_with(a[name], b[name], lambda x, y: x + F.lit(sign) * y), lambda v: v.bitwiseAND(F.lit(modulus))).alias(name)
    return F.struct(lanes("wide", MODULUS), lanes("counts", 2**32 - 1))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two counted lanes about their means, from 0 to 1; 1 where they are equal."""
    centred = lambda v: F.transform(F.slice(v, 1, LANES), lambda c: (2 * c - F.element_at(v, -1)).cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(centred(x), centred(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(a == b, F.lit(1.0)).when(norm == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def shown(vector: Column) -> Column:
    """The fingerprint in hexadecimal."""
    digits = lambda lanes, n: F.array_join(F.transform(lanes, lambda c: F.lpad(F.hex(c), n, "0")), "")
    return F.lower(F.concat(digits(vector["wide"], 16), digits(vector["counts"], 8)))


def successors(keys: DataFrame) -> DataFrame:
    """The rows of a table of distinct (kid, th), and next_kid and next_th: the next in ascending order, after the last the first.

    The order is cut into ranges; the next one is found inside each, and beyond it from the ranges' first keys, one for each partition.
    """
    ranged = common.written(keys.repartitionByRange("kid", "th").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy("kid", "th")
    firsts = ranged.groupBy("part").agg(F.min(F.struct("kid", "th")).alias("first"))
    over = Window.orderBy("part")
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    beyond = firsts.select("part", F.coalesce(F.lead("first").over(over), F.first("first").over(whole)).alias("beyond"))
    led = ranged.withColumn("next", F.lead(F.struct("kid", "th")).over(inside)).join(beyond, "part").withColumn("next", F.coalesce("next", "beyond"))
    return led.select(*keys.columns, F.col("next")["kid"].alias("next_kid"), F.col("next")["th"].alias("next_th"))


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): a text against its edited form, whose last quarter is the next one's start, and against the next text."""
    base = common.slim(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NONE)).alias("kid"), F.xxhash64("text").alias("th"), "text")
    # Rows of one id and text are one row here, and follow each other.
    order = common.written(successors(base.groupBy("kid", "th").agg(F.count("*").alias("copies"), F.max(F.length("text")).alias("n"))))
    texts = base.groupBy("kid", "th").agg(F.first("text").alias("text"))
    quarter = F.expr("n div 4").cast("int")
    # What the successor gives of its start, keyed by the text before it.
    asked = order.select(F.col("next_kid").alias("kid"), F.col("next_th").alias("th"), F.col("kid").alias("to_kid"), F.col("th").alias("to_th"), "n", "copies", quarter.alias("quarter"))
    given = texts.join(asked, ["kid", "th"]).select(F.col("to_kid").alias("kid"), F.col("to_th").alias("th"), "n", "copies", F.substring(F.col("text"), F.lit(1), F.col("quarter")).alias("given"))
    rows = texts.join(given, ["kid", "th"])
    edited = lambda start: F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - quarter), start)
    form = lambda which, text: F.struct(F.lit(which).alias("which"), text.alias("text"))
    forms = F.array(form(0, F.col("text")), form(1, edited(F.col("given"))))
    own = F.array(form(2, edited(F.substring(F.col("text"), F.lit(1), quarter))))
    each = rows.select("kid", "th", F.inline(F.when(F.col("copies") > 1, F.concat(forms, own)).otherwise(forms)))
    each = each.select("kid", "th", "which", F.when(F.col("which") > 0, F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), "text")
    of = lambda which: F.first(F.when(F.col("which") == which, F.struct("sha", "vector")), ignorenulls=True)
    made = common.written(vectors(each, ["kid", "th", "which", "sha"]).groupBy("kid", "th").agg(of(0).alias("own"), of(1).alias("edit"), of(2).alias("self")))
    ahead = made.select(F.col("kid").alias("next_kid"), F.col("th").alias("next_th"), F.col("own.vector.counts").alias("ahead"))
    out = made.join(order, ["kid", "th"]).join(ahead, ["next_kid", "next_th"])
    counts = lambda name: F.col(f"{name}.vector.counts")
    result = lambda name, near_next: F.struct(
        F.col(name)["sha"].alias("edited_sha256"), shown(F.col("own.vector")).alias("fingerprint"), shown(F.col(f"{name}.vector")).alias("edited_fingerprint"),
        likeness(counts("own"), counts(name)).alias("near_edited"), near_next.alias("near_next"),
    )
    last = out.select("kid", "n", "copies", result("edit", likeness(counts("own"), F.col("ahead"))).alias("r"))
    # All copies but the last are followed by a copy.
    before = out.where("copies > 1").select("kid", "n", result("self", F.lit(1.0)).alias("r"), F.explode(F.sequence(F.lit(2).cast("long"), "copies"))).drop("col")
    every = last.drop("copies").union(before)
    return every.select(F.when(F.col("kid") != NONE, F.col("kid")).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "r.*")
