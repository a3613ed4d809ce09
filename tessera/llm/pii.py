"""Personal data by bootstrapped contextual extraction.

Base entities are found by pattern and checked. They seed a graph of lexical patterns (the word before an
identifier-like token, with the symbols between them) and instances (the token, with a digit or an @): a pattern's score is the
instances' scores over all occurrences of its word in the corpus, an instance's score that of its best
other pattern of high confidence, seeds staying at one. Instances pass their score and kind on, so each round
may trust new patterns. After a few rounds, identifier-like tokens that patterns of high confidence
introduce are spans too, of the kind that most occurrences of the pattern's scored instances have.

Everything is DataFrame expressions. A text's own matches are placed by lengths, without a shuffle; only
identifier-like tokens and counts by word are shuffled, after partial aggregation. Running sums are taken in
blocks, so that a text with very many tokens takes time in proportion.

Defined results: a null or empty text has no spans; equal texts have equal spans; repeated rows are kept;
null ids are kept (as is the lowest long, as null); an empty table gives an empty result; other columns are ignored.
Very long texts are taken in whole, in time in proportion to their tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm import common

# The kinds in their listed order and their Java patterns. Runs are possessive and start at a run's first letter
# (or where the last match ended), which finds the same leftmost matches in linear time.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NAMES = list(KINDS)
#: What a text must contain for a kind's pattern to be worth trying.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Tokens that look like identifiers; what lies between two of them has no digit and no @.
TOKEN = r"(?<!\S)\S*?[0-9@]\S*"
EDGES = r"^[^\p{L}0-9+]+|[^\p{L}0-9]+$"
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
NONE = -(2**63)


def held(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, fold, block: int = 256) -> Column:
    """The results of folding an array of ints from its start to each place, in two levels, as an array grows by copying."""
    none = F.expr("CAST(array() AS array<int>)")
    grow = lambda acc, v: F.concat(acc, F.array(F.coalesce(fold(F.get(acc, F.size(acc) - 1), v), v)))

    def of(every):
        cut = F.transform(F.sequence(F.lit(0), F.expr("0") + ((F.size(every) - 1) / block).cast("int")), lambda b: F.slice(every, b * block + 1, F.lit(block)))
        return held(F.transform(cut, lambda part: F.aggregate(part, none, grow)), joined)

    def joined(parts):
        ends = F.aggregate(F.transform(parts, lambda p: F.element_at(p, -1)), none, grow)
        return held(ends, lambda e: F.flatten(F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(F.transform(p, lambda v: fold(F.get(e, k - 1), v))))))

    return held(values, lambda every: F.when(F.size(every) > 0, of(every)).otherwise(none))


def placed(text: Column, pattern: str, kind: int) -> Column:
    """(start, kind, end, value, before) of each match: the texts between matches give the places; before has the last words ahead of it, each with a space after it."""

    def of(found, parts):
        reach = running(F.zip_with(found, F.slice(parts, 1, F.size(found)), lambda m, p: F.length(m) + F.length(p)), lambda a, v: a + v)

        def one(end, k):
            value = F.get(found, k)
            before = F.substring_index(F.regexp_replace(F.get(parts, k), r"\s+", " "), " ", -4)
            return F.struct((end - F.length(value)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value"), before.alias("before"))

        return F.transform(reach, one)

    return held(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: held(F.split(text, pattern, -1), lambda parts: of(found, parts)))


def introduction(before: Column) -> tuple[Column, Column]:
    """(word, pattern): the last word with a letter, at most two words of symbols before the token aside, and all from there on; empty where there is none."""

    def of(words):
        lettered = lambda k: F.coalesce(F.get(words, F.size(words) - 1 - k).rlike(r"\p{L}"), F.lit(False))
        back = F.when(lettered(1), 1).when(lettered(2), 2).when(lettered(3), 3)
        first = F.size(words) - back
        return F.when(back.isNotNull(), F.struct(F.element_at(words, first).alias("word"), F.array_join(F.slice(words, first, back + 1), " ").alias("pattern")))

    # What comes last is empty: white space goes before every token but a text's first.
    found = held(F.split(F.lower(before), " "), of)
    return F.coalesce(found["word"], F.lit("")), F.coalesce(found["pattern"], F.lit(""))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    each = F.transform(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda s, v: s + v - F.when(v > 9, F.lit(9)).otherwise(F.lit(0))) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern passes its check."""
    if kind == "ip":
        small = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(small(p)) <= 3) & (F.substring(small(p), 1, 3).cast("int") <= 255))
    n = F.length(digits(value))
    if kind == "card":
        return n.between(14, 19) & luhn(F.substring(digits(value), 1, 19))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def checked(kind: str):
    return lambda s: holds(kind, s["value"])


def base_spans(text: Column) -> Column:
    """All kinds' spans by start, then kind."""
    none = F.expr(f"CAST(array() AS {SPAN})")
    every = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        kept = F.transform(F.filter(placed(text, pattern, k), checked(kind)), lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"]))
        hint = F.contains(text, F.lit(HINTS[kind])) if HINTS[kind] else F.lit(True)
        digit = F.lit(True) if kind == "email" else text.rlike("[0-9]")
        every.append(F.when(hint & digit, kept).otherwise(none))
    return F.array_sort(F.concat(*every))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return common.slim(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NONE)).alias("kid"), F.xxhash64("text").alias("th"), "text")


def with_seeds(tokens: Column, base: Column) -> Column:
    """The tokens with seed, the kind of the first base span that they overlap; of a span's tokens only its first one stays."""

    def of(reach):
        """reach: how far the base spans up to each one go. As many as end by a token's start lie before the first that may overlap it."""
        ends = F.transform(reach, lambda r: F.struct(r.alias("at"), F.lit(1).alias("end")))
        merged = F.array_sort(F.concat(ends, F.transform(tokens, lambda t: F.struct(t["start"].alias("at"), F.lit(2).alias("end")))))
        return held(merged, lambda m: counted(m, running(F.transform(m, lambda x: 2 - x["end"]), lambda a, v: a + v)))

    def counted(merged, before):
        mine = F.filter(F.zip_with(merged, before, lambda x, n: F.struct(x["end"].alias("end"), n.alias("n"))), lambda x: x["end"] == 2)
        return F.zip_with(tokens, mine, lambda t, x: token(t, F.get(base, x["n"])))

    def token(t, b):
        over = b["start"] < t["end"]
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value"), t["before"].alias("before"), F.when(over, b["kind"]).alias("seed"), (~F.coalesce(over, F.lit(False)) | (t["start"] <= b["start"])).alias("first"))

    return F.filter(held(running(F.transform(base, lambda b: b["end"]), F.greatest), of), lambda t: t["first"])


def discovered(found: DataFrame, texts: DataFrame, rounds: int = 3, support: int = 3, confidence: float = 0.7) -> DataFrame:
    """(kid, th, extra): spans that patterns of at least that confidence and support (different instances) introduce."""
    each = found.select("kid", "th", F.inline(with_seeds(F.col("tokens"), F.col("base"))))
    each = each.select(
        "kid", "th", "start", "end", "value", "seed",
        introduction(F.col("before"))[0].alias("word"), introduction(F.col("before"))[1].alias("pattern"),
    ).where("pattern <> ''")
    each = common.written(each.withColumn("core", F.when(F.col("seed").isNull(), F.regexp_replace("value", EDGES, "")).otherwise(F.col("value"))).where("core RLIKE '[0-9@]'"))
    # Counts by pattern and instance: the graph's edges.
    edges = each.groupBy("pattern", "word", "core").agg(F.count("*").alias("n"))
    seeds = each.where("seed IS NOT NULL").groupBy("core").agg(F.max("seed").alias("seed"))
    edges = common.written(edges.join(seeds, "core", "left"))
    words = texts.select(F.explode(F.split("text", r"\s+")).alias("w")).select(F.lower("w").alias("word"))
    none = each.where(F.lit(False))
    totals = none.select("word", F.lit(0).cast("long").alias("total"))
    strong = none.select("pattern", F.lit(0.0).alias("weight"), F.lit(0).alias("kind"))
    known = None
    for _ in range(rounds):
        # An instance's two best patterns that are trusted: its score for a pattern comes from another one.
        # Only the first two of each task's part are shuffled, however many patterns an instance has.
        first = F.row_number().over(Window.partitionBy("core").orderBy(F.desc("weight"), "kind", F.desc("pattern")))
        two = edges.where("seed IS NULL").join(strong, "pattern").select("core", "weight", "kind", "pattern", first.alias("nth")).where("nth <= 2")
        best = two.groupBy("core").agg(F.sort_array(F.collect_list(F.struct("nth", "weight", "pattern", "kind"))).alias("best"))
        scored = edges.join(best, "core", "left").withColumn("from", F.filter("best", lambda b: b["pattern"] != F.col("pattern")))
        scored = scored.withColumn("from", F.when(F.size("from") > 0, F.element_at("from", 1)))
        seeded = F.col("seed").isNotNull()
        scored = scored.select("pattern", "word", "n", F.when(seeded, F.lit(1.0)).otherwise(F.col("from.weight")).alias("score"), F.coalesce("seed", "from.kind").alias("kind"))
        votes = scored.where("score IS NOT NULL").groupBy("pattern", "word", "kind").agg(F.count("*").alias("different"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("score")).alias("mass"))
        mass = votes.groupBy("pattern", "word").agg(F.sum("different").alias("different"), F.sum("mass").alias("mass"), F.max_by("kind", F.col("n") * 8 - F.col("kind")).alias("kind"))
        mass = common.written(mass.where(F.col("different") >= support))
        fresh = mass.select("word").distinct().join(totals, "word", "left_anti")
        if not fresh.isEmpty():
            fresh = common.written(fresh)
            totals = common.written(totals.union(words.join(fresh, "word", "left_semi").groupBy("word").agg(F.count("*").alias("total"))))
        weight = F.round(F.least(F.lit(1.0), F.col("mass") / F.col("total")), 9)
        strong = common.written(mass.join(totals, "word").select("pattern", weight.alias("weight"), "kind").where(F.col("weight") >= confidence))
        state = strong.agg(F.count("*"), F.sum(F.xxhash64("pattern", "weight", "kind").cast("decimal(38,0)"))).first()
        if state == known:
            break
        known = state
    new = each.where("seed IS NULL").join(strong, "pattern")
    lead = F.length(F.regexp_extract("value", r"^[^\p{L}0-9+]*", 0))
    start = F.col("start") + lead
    return new.groupBy("kid", "th").agg(F.array_distinct(F.collect_list(F.struct(start.alias("start"), "kind", (start + F.length("core")).alias("end"), F.col("core").alias("value")))).alias("extra"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3) -> DataFrame:
    """(doc_id, kid, th, base, spans) of every document; th is the text's hash."""
    texts, text = keyed(docs, id_col, text_col), F.col("text")
    found = common.written(texts.select("kid", "th", base_spans(text).alias("base"), F.when(text.rlike("[0-9@]"), placed(text, TOKEN, -1)).alias("tokens")))
    extra = discovered(found, texts, rounds)
    every = F.array_sort(F.concat("base", F.coalesce("extra", F.expr(f"CAST(array() AS {SPAN})"))))
    return found.select("kid", "th", "base").join(extra, ["kid", "th"], "left").select(F.when(F.col("kid") != NONE, F.col("kid")).alias("doc_id"), "kid", "th", "base", every.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda k: F.element_at(F.array(*[F.lit(n) for n in NAMES]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column) -> list[Column]:
    of = lambda k: lambda s: s["kind"] == k
    return [F.size(F.filter(spans, of(k))).cast("long").alias(f"n_{n}") for k, n in enumerate(NAMES)]


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets; spans in ascending order."""
    name = lambda k: F.element_at(F.array(*[F.lit(f"[{n.upper()}]") for n in NAMES]), k + 1)

    # Four bytes a code point: a place is found without a walk from the text's start.
    cut = lambda whole, at, to: F.decode(F.substring(whole, at * 4 + 1, (to - at) * 4), "UTF-32")

    def of(whole, reach):
        """reach: how far the spans up to each one go."""

        def piece(s, k):
            at = F.coalesce(F.get(reach, k - 1), F.lit(0))
            return F.when(s["start"] >= at, F.concat(cut(whole, at, s["start"]), name(s["kind"]))).otherwise(F.lit(""))

        rest = F.coalesce(F.get(reach, F.size(reach) - 1), F.lit(0))
        return F.concat(F.array_join(F.transform(spans, piece), ""), cut(whole, rest, F.length(text)))

    return held(F.encode(text, "UTF-32"), lambda whole: held(running(F.transform(spans, lambda s: s["end"]), F.greatest), lambda reach: of(whole, reach)))


def without(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, with every span replaced by its kind."""
    found = spans(docs, id_col, text_col).where(F.size("spans") > 0).select("kid", "th", "spans").dropDuplicates(["kid", "th"])
    own, text = common.plain(docs), F.col(common.spot(docs, text_col))
    keyed = own.withColumns({"kid": F.coalesce(F.col(common.spot(docs, id_col)).cast("long"), F.lit(NONE)), "th": F.xxhash64(F.coalesce(text, F.lit("")))})
    new = F.when(F.col("spans").isNotNull(), redacted(text, F.col("spans"))).otherwise(text)
    return keyed.join(found, ["kid", "th"], "left").select(*[new.alias(c) if c == common.spot(docs, text_col) else c for c in own.columns]).toDF(*docs.columns)
