"""Column functions: casts, labels, text, arrays, geometry, scores and sequences. Inputs and results are Columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, functions as F

BLANK = ("", "nan", "none", "null")


# --- Casts and projections ------------------------------------------------------------------------------------


def safe_double(c: Column) -> Column:
    """A number, or null where there is none; NaN and infinities are null too."""
    x = c.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def first_number(c: Column) -> Column:
    """The first decimal number in a text."""
    found = F.regexp_extract(c, r"-?\d+(\.\d+)?", 0)
    return F.when(found != "", found).try_cast("double")


def nonblank(c: Column) -> Column:
    """Null where a text is missing or spells that it is."""
    return F.when(~F.lower(F.trim(c)).isin(*BLANK), c)


def first_nonblank(*columns: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def mapped(c: Column, names: Mapping[str, str]) -> Column:
    """The name's value, or the name itself."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[c], c) if names else c


def label_by_prefix(c: Column, prefixes: Mapping[str, str], default: str | None = None) -> Column:
    """The label of the first prefix that an upper-cased text starts with."""
    up = F.upper(F.trim(c))
    return first_match([(up.startswith(p.upper()), label) for p, label in prefixes.items()], default)


def first_match(cases: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return F.lit(default) if out is None else out.otherwise(F.lit(default) if not isinstance(default, Column) else default)


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))))


def directed(c: Column, lower_is_better: bool) -> Column:
    return -c if lower_is_better else c


def half_even(c: Column, places: int) -> Column:
    """Rounded to the nearest, ties to even, by the exact binary value of a double (2.675 lies below 2.675 and gives 2.67)."""
    scale, split = 10.0**places, 2.0**27 + 1
    high = split * scale - (split * scale - scale)
    low = scale - high
    x = c.cast("double")
    product = x * scale
    x_high = x * split - (x * split - x)
    x_low = x - x_high
    # What the product lost to rounding, exactly.
    lost = ((x_high * high - product) + x_high * low + x_low * high) + x_low * low
    below = F.floor(product).cast("double")
    rest = product - below
    up = (rest > 0.5) | ((rest == 0.5) & ((lost > 0) | ((lost == 0) & (below % 2 != 0))))
    return F.when(F.abs(product) < 2.0**52, (below + F.when(up, 1.0).otherwise(0.0)) / scale).otherwise(x)


# --- Text -----------------------------------------------------------------------------------------------------


def collapsed(c: Column) -> Column:
    """Runs of white space, no-break space included, as one space; trimmed."""
    return F.trim(F.regexp_replace(F.translate(c, " ", " "), r"\s+", " "))


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def plain_dashes(c: Column) -> Column:
    return F.translate(c, "‐‑‒–—−", "------")


def normal_key(c: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def normal_doi(c: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    return nonblank(bare)


def normal_accession(c: Column) -> Column:
    """Upper case, without a cluster prefix and a version."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), r"^UNIREF\d+_", ""), r"\.\d+$", "")


def tokens(c: Column, delimiters: str = r"[;,|]") -> Column:
    """The non-empty parts of a delimited text."""
    return F.filter(F.transform(F.split(c, delimiters), lambda t: F.trim(t)), lambda t: t != "")


def safe_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def shortened(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 3)), F.lit("..."))).otherwise(c)


def short_hash(c: Column, kind: str = "md5", size: int = 10) -> Column:
    digest = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda x: F.sha2(x, 256)}[kind](c.cast("binary"))
    return F.substring(digest, 1, size)


def found_all(c: Column, pattern: str, group: int = 0, known_false: Sequence[str] = ()) -> Column:
    """Distinct matches in ascending order, less known false ones."""
    every = F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(group))))
    return F.array_except(every, F.array(*[F.lit(x) for x in known_false])) if known_false else every


def keyword_hit(c: Column, term: str) -> Column:
    """Whether a text has a term: as a word where the term is short, else anywhere; hyphens and spaces are alike."""
    low = F.lower(c)
    forms = sorted({term.lower(), term.lower().replace("-", " "), term.lower().replace(" ", "-")})
    out = F.lit(False)
    for form in forms:
        out = out | (low.rlike(rf"(^|[^a-z0-9]){_quoted(form)}([^a-z0-9]|$)") if len(form) <= 3 else low.contains(form))
    return F.coalesce(out, F.lit(False))


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


def expanded_terms(phrase: str, synonyms: Mapping[str, Sequence[str]] | None = None) -> list[str]:
    """A criterion's terms: the phrase, its words of four letters or more, its word pairs, and synonyms of any of them."""
    words = [w for w in phrase.lower().split() if w]
    terms = [phrase.lower(), *[w for w in words if len(w) >= 4], *[" ".join(p) for p in zip(words, words[1:], strict=False)]]
    for t in list(terms):
        terms += [s.lower() for s in (synonyms or {}).get(t, ())]
    return list(dict.fromkeys(terms))


def keyword_count(c: Column, terms: Sequence[str]) -> Column:
    out = F.lit(0)
    for t in terms:
        out = out + keyword_hit(c, t).cast("int")
    return out


def relevance(title: Column, abstract: Column, terms: Sequence[str]) -> Column:
    """Share of four hits, a little more for a long abstract, less for a missing one."""
    size = F.length(F.coalesce(abstract, F.lit("")))
    hits = keyword_count(F.concat_ws(" ", title, abstract), terms)
    base = F.least(F.lit(1.0), hits / F.lit(4.0))
    return F.when(size == 0, base * 0.7).when(size > 300, base + 0.08).when(size > 100, base + 0.03).otherwise(base)


def word_overlap(a: Column, b: Column) -> Column:
    """How many different lower-case words two texts share."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    return F.size(F.array_intersect(words(a), words(b)))


def multi_tags(rules: Mapping[str, Column]) -> Column:
    """The labels of all rules that hold, joined by ' | '."""
    return F.concat_ws(" | ", *[F.when(condition, F.lit(label)) for label, condition in rules.items()])


def residue_label(name: Column, chain: Column, number: Column) -> Column:
    return F.concat_ws(":", name, chain, number.cast("string"))


def residue_parts(label: Column) -> Column:
    """(name, chain, number) of a label made by residue_label()."""
    parts = F.split(label, ":")
    return F.struct(parts[0].alias("name"), parts[1].alias("chain"), parts[2].try_cast("int").alias("number"))


def elements_of(formula: Column) -> Column:
    """The different element symbols of a formula, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)"), F.lit(1)))


def sorted_json(m: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def alias_value(m: Column, *names: str) -> Column:
    """The first non-blank value under any of a map's names."""
    return F.coalesce(*[nonblank(F.try_element_at(m, F.lit(n))) for n in names])


def merged_maps(left: Column, right: Column) -> Column:
    """Both maps' entries; the right one wins."""
    return F.map_zip_with(left, right, lambda k, a, b: F.coalesce(b, a))


# --- Arrays, vectors, angles ------------------------------------------------------------------------------------


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all different members; two empty sets share nothing."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / every)


def tanimoto(a: Column, b: Column) -> Column:
    """Tanimoto similarity of two bit sets in binary or long form."""
    both, either = F.bit_count(a.bitwiseAND(b)), F.bit_count(a.bitwiseOR(b))
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclid(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return norm(gap)


def cosine_distance(a: Column, b: Column) -> Column:
    """One less the cosine; one where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when((norm(a) <= 1e-12) | (norm(b) <= 1e-12), F.lit(1.0)).otherwise(1 - dot(a, b) / size)


def cross(a: Column, b: Column) -> Column:
    at = lambda v, k: F.element_at(v, k + 1)
    return F.array(*[at(a, i) * at(b, j) - at(a, j) * at(b, i) for i, j in ((1, 2), (2, 0), (0, 1))])


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 1e-12, F.transform(a, lambda x: x / n))


def angle(a: Column, b: Column) -> Column:
    """Degrees between two vectors."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), norm(a) * norm(b))))))


def triple(a: Column, b: Column, c: Column) -> Column:
    """The signed volume of three vectors."""
    return dot(a, cross(b, c))


def dihedral(p: Column, q: Column, r: Column, s: Column) -> Column:
    """Degrees of the torsion of four points."""
    b1, b2, b3 = minus(q, p), minus(r, q), minus(s, r)
    n1, n2 = cross(b1, b2), cross(b2, b3)
    return F.degrees(F.atan2(dot(cross(n1, n2), unit(b2)), dot(n1, n2)))


def plane_height(point: Column, origin: Column, normal: Column) -> Column:
    return dot(minus(point, origin), unit(normal))


def rmsd(a: Column, b: Column) -> Column:
    """Root mean square distance of two arrays of points over the shorter one."""
    n = F.least(F.size(a), F.size(b))
    squares = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda p, q: dot(minus(p, q), minus(p, q)))
    return F.sqrt(F.try_divide(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v), n))


def minimum_image(delta: Column, box: Column) -> Column:
    """A component of a distance in a periodic box."""
    return delta - box * F.rint(delta / box)


def circular_delta(a: Column, b: Column) -> Column:
    """Degrees from b to a, from -180 up to 180."""
    return F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0


def wrapped(a: Column) -> Column:
    return F.pmod(a, F.lit(360.0))


# --- Scores ------------------------------------------------------------------------------------------------------


def robust(x: Column, low: Column, high: Column) -> Column:
    """Where x lies between two bounds, held to [0, 1]; a half where it can't be told."""
    known = x.isNotNull() & low.isNotNull() & high.isNotNull() & (F.abs(high - low) >= 1e-12)
    return F.when(known, clamp01(F.try_divide(x - low, high - low))).otherwise(F.lit(0.5))


def weighted_mean(parts: Sequence[tuple[Column, float]]) -> Column:
    """Weighted mean over the parts that are there."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for c, w in parts:
        top, bottom = top + F.coalesce(c * w, F.lit(0.0)), bottom + F.when(c.isNotNull(), F.lit(float(w))).otherwise(0.0)
    return F.try_divide(top, bottom)


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26: off by 1.5e-7 at most."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - series * F.exp(-x * x))


def normal_score(z: Column, lower_is_better: bool = False) -> Column:
    p = 0.5 * (1 + erf(z / F.lit(2.0**0.5)))
    return 1 - p if lower_is_better else p


def excess(x: Column, start: float, span: float, most: float, below: bool = False) -> Column:
    """A penalty that grows from start over span up to most."""
    over = (F.lit(start) - x if below else x - start) / span
    return F.when(x < start if below else x > start, F.least(F.lit(most), over)).otherwise(F.lit(0.0))


def property_window(weight: Column, logp: Column, area: Column, rotors: Column, donors: Column, acceptors: Column) -> Column:
    """One less a penalty for each property outside its window."""
    heavy = F.when(weight > 900, F.least(F.lit(0.06), (weight - 900) / 1500)).when(weight > 500, F.least(F.lit(0.03), (weight - 500) / 1000)).otherwise(excess(weight, 250, 250, 0.15, True))
    return clamp01(
        1 - heavy - excess(logp, 5, 5, 0.25) - excess(logp, -1, 4, 0.15, True) - excess(area, 140, 200, 0.25) - excess(rotors, 10, 20, 0.20) - excess(donors, 5, 10, 0.15) - excess(acceptors, 10, 15, 0.15)
    )


def drug_likeness(qed: Column, logp: Column, area: Column, rotors: Column, at: tuple[float, float] = (2.5, 90.0)) -> Column:
    return 0.45 * clamp01(qed) + 0.20 * (1 - clamp01(F.abs(logp - at[0]) / 4)) + 0.20 * (1 - clamp01(F.abs(area - at[1]) / 120)) + 0.15 * (1 - clamp01(rotors / 16))


def reasons(rules: Sequence[tuple[Column, int, str]]) -> tuple[Column, Column]:
    """(sum of the points of the rules that hold, their texts joined by '; ')."""
    points, texts = F.lit(0), []
    for condition, n, text in rules:
        points = points + F.when(condition, F.lit(n)).otherwise(0)
        texts.append(F.when(condition, F.lit(text)))
    return points, F.concat_ws("; ", *texts)


# --- Sequences -----------------------------------------------------------------------------------------------------

# The standard genetic code in T, C, A, G order.
BASES = "TCAG"
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def normal_sequence(c: Column) -> Column:
    """Upper-case letters only."""
    return F.regexp_replace(F.upper(c), "[^A-Z]", "")


def translated(dna: Column) -> Column:
    """Amino acids of the whole codons, X where unknown, * for stops."""
    place = lambda base: F.instr(F.lit(BASES), base) - 1
    n = F.floor(F.length(dna) / 3).cast("int")

    def one(k):
        codon = F.substring(dna, k * 3 + 1, F.lit(3))
        a, b, c = (place(F.substring(codon, i, 1)) for i in (1, 2, 3))
        return F.when((a >= 0) & (b >= 0) & (c >= 0), F.substring(F.lit(AMINO), a * 16 + b * 4 + c + 1, F.lit(1))).otherwise(F.lit("X"))

    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), one), "")).otherwise(F.lit(""))


def translation(dna: Column) -> Column:
    """(protein without stops, terminal_stop, internal_stops, rest) of a coding sequence."""
    raw = translated(dna)
    ends = raw.endswith("*")
    return F.struct(
        F.regexp_replace(raw, r"\*", "").alias("protein"), ends.alias("terminal_stop"),
        (F.length(raw) - F.length(F.regexp_replace(raw, r"\*", "")) - ends.cast("int")).alias("internal_stops"), (F.length(dna) % 3).alias("rest"),
    )


def motif_places(sequence: Column, motifs: Sequence[str]) -> Column:
    """Zero-based first place of each motif, -1 where it is not."""
    return F.create_map(*[x for m in motifs for x in (F.lit(m), F.instr(sequence, F.lit(m)) - 1)])


def motif_score(sequence: Column, motifs: Sequence[str]) -> Column:
    """Per cent of the motifs that a sequence has."""
    return 100.0 * sum((F.contains(sequence, F.lit(m)).cast("int") for m in motifs), F.lit(0)) / len(motifs)


def letters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def positional_identity(a: Column, b: Column) -> Column:
    """Places with equal letters over the longer length."""
    same = F.size(F.filter(F.zip_with(letters(a), letters(b), lambda x, y: x == y), lambda v: F.coalesce(v, F.lit(False))))
    return F.try_divide(same.cast("double"), F.greatest(F.length(a), F.length(b)))


def aligned_identity(a: Column, b: Column) -> Column:
    """Equal letters over compared columns of two rows of an alignment; columns with two gaps are not compared."""
    pairs = F.filter(F.zip_with(letters(a), letters(b), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: ~((p["x"] == "-") & (p["y"] == "-")))
    return F.try_divide(F.size(F.filter(pairs, lambda p: p["x"] == p["y"])).cast("double"), F.size(pairs))


def window_identity(a: Column, b: Column) -> Column:
    """The best positional identity of the shorter sequence slid along the longer one; one where it is contained."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    n = F.length(short)
    every = F.transform(F.sequence(F.lit(1), F.length(long) - n + 1), lambda k: positional_identity(short, F.substring(long, k, n)))
    return F.when(n == 0, F.lit(0.0)).when(F.contains(long, short), F.lit(1.0)).otherwise(F.array_max(every))


def kingdom(c: Column, keywords: Sequence[tuple[str, str]], default: str = "unknown") -> Column:
    """The kingdom of the first keyword that a lower-cased text contains."""
    return first_match([(F.contains(F.lower(c), F.lit(k)), v) for k, v in keywords], default)


def settled_kingdom(stated: Column, organism: Column, phylum: Column, priority: Sequence[tuple[str, Sequence[str]]], keywords: Sequence[tuple[str, str]], default: str = "Unknown") -> Column:
    """The first kingdom in order of priority whose words the three texts contain; else the stated one; else that of organism and phylum."""
    text = lambda *c: F.lower(F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in c]))
    every = text(stated, organism, phylum)
    named = first_match([(F.contains(every, F.lit(word)), name) for name, words in priority for word in words])
    return F.coalesce(named, F.when(stated != "", stated), kingdom(text(organism, phylum), keywords, default))


# Fixed values: (feature, relation, threshold, text) of what may explain a lower score, by the lower row's feature less the higher one's.
CLIFF_RULES = [
    ("affinity", "<", -0.5, "vina_false_positive_or_missing_physics"),
    ("affinity", ">", 1.0, "vina_affinity_consistent_with_cliff"),
    ("hbonds", "<=", -3, "lost_hbond_network"),
    ("hbonds", ">=", 3, "more_hbonds_but_score_lower_possible_bad_geometry_or_desolvation"),
    ("hydrophobic", "<=", -5, "lost_hydrophobic_contacts"),
    ("hydrophobic", ">=", 5, "hydrophobic_gain_not_translating_possible_wrong_region"),
    ("vdw", ">=", 35, "more_vdw_but_score_lower_possible_overpacking_or_pose_artifact"),
    ("vdw", "<=", -25, "lost_vdw_surface_contact"),
    ("inner_rmsd", ">=", 1.5, "less_consistent_pose_family"),
    ("area", "<=", -25, "polar_surface_or_desolvation_shift"),
    ("area", ">=", 25, "polar_surface_or_desolvation_shift"),
    ("logp", "<=", -0.8, "lipophilicity_shift"),
    ("logp", ">=", 0.8, "lipophilicity_shift"),
    ("rotors", ">=", 3, "higher_conformational_entropy_penalty"),
]
UNEXPLAINED = "unexplained_by_current_features_check_pose_or_assay"


# What is told of a rule that holds, by feature and relation: the change, or for the affinity the lower row's value and the higher one's.
CLIFF_EVIDENCE = {
    ("affinity", "<"): "low_official_has_better_vina(%.2f<%.2f)",
    ("affinity", ">"): "low_official_has_weaker_vina(%.2f>%.2f)",
    ("hbonds", "<="): "hbond_delta_low_minus_high=%.1f",
    ("hbonds", ">="): "hbond_delta_low_minus_high=+%.1f",
    ("hydrophobic", "<="): "hydrophobic_delta_low_minus_high=%.1f",
    ("hydrophobic", ">="): "hydrophobic_delta_low_minus_high=+%.1f",
    ("vdw", ">="): "vdw_delta_low_minus_high=+%.1f",
    ("vdw", "<="): "vdw_delta_low_minus_high=%.1f",
    ("inner_rmsd", ">="): "inner_rmsd_delta=%.2f",
    ("area", "<="): "tpsa_delta_low_minus_high=%.1f",
    ("area", ">="): "tpsa_delta_low_minus_high=%.1f",
    ("logp", "<="): "logp_delta_low_minus_high=%.2f",
    ("logp", ">="): "logp_delta_low_minus_high=%.2f",
    ("rotors", ">="): "rot_bonds_delta_low_minus_high=+%.1f",
}
NO_EVIDENCE = "current_descriptor_contact_features_do_not_explain_cliff"


def _told(c: Column) -> Column:
    """A number, null where it is NaN: Spark holds NaN larger than any number."""
    return F.when(~F.isnan(c.cast("double")), c)


def _between(first: Mapping[str, Column], second: Mapping[str, Column], score: str, rules: Sequence[tuple[str, str, float, str]], say: Callable[[str, str, str, Column, Column], Column], default: str, once: bool) -> Column:
    """What say() gives of each rule that holds between two rows, joined; say gets feature, relation, text and the lower and the higher row's value."""
    up = first[score] >= second[score]
    low, high = (lambda f: _told(F.when(up, second[f]).otherwise(first[f]))), (lambda f: _told(F.when(up, first[f]).otherwise(second[f])))
    relation = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    texts = [F.when(relation[sign](low(f) - high(f), at), say(f, sign, text, low(f), high(f))) for f, sign, at, text in rules if f in first and f in second]
    every = F.array_compact(F.array(*texts)) if texts else F.array().cast("array<string>")
    made = F.array_join(F.array_distinct(every) if once else every, ";")
    known = _told(first[score]).isNotNull() & _told(second[score]).isNotNull()
    return F.when(~known, F.lit("")).otherwise(F.when(made == "", F.lit(default)).otherwise(made))


def delta_reasons(first: Mapping[str, Column], second: Mapping[str, Column], score: str, rules: Sequence[tuple[str, str, float, str]] = CLIFF_RULES, default: str = UNEXPLAINED) -> Column:
    """The different texts of the rules that hold between two rows, joined by ';'; features that the rows lack, or that are NaN, count for nothing. The default where no rule holds, nothing
    where a score is missing; on a tie the first row is the higher one."""
    return _between(first, second, score, rules, lambda f, sign, text, low, high: F.lit(text), default, True)


def delta_evidence(first: Mapping[str, Column], second: Mapping[str, Column], score: str, rules: Sequence[tuple[str, str, float, str]] = CLIFF_RULES, formats: Mapping[tuple[str, str], str] = CLIFF_EVIDENCE, default: str = NO_EVIDENCE) -> Column:
    """What the rules of delta_reasons() that hold have to show, each by its format: of one number the change, of two the lower row's value and the higher one's."""

    def say(f: str, sign: str, text: str, low: Column, high: Column) -> Column:
        form = formats[f, sign]
        numbers = [low - high] if form.count("%.") == 1 else [low, high]
        return F.format_string(form, *[n.cast("double") for n in numbers])

    return _between(first, second, score, rules, say, default, False)


# Identifier patterns. Look-arounds hold to ASCII letters and digits.
IDENTIFIERS = {
    "structure": r"(?<![A-Za-z0-9_])[0-9](?=[A-Za-z0-9]{0,2}[A-Za-z])[A-Za-z0-9]{3}(?![A-Za-z0-9_])",
    "enzyme": r"(?<![A-Za-z0-9_.])[1-7]\.[0-9]+\.[0-9]+\.(?:n?[0-9]+|-)(?![A-Za-z0-9_.])",
    "protein": r"(?<![A-Za-z0-9_])(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9][A-Z][A-Z0-9]{2}[0-9](?:-[0-9]+)?)(?![A-Za-z0-9_])",
    "mutation": r"(?<![A-Za-z0-9_])[ACDEFGHIKLMNPQRSTVWY][1-9][0-9]{0,3}[ACDEFGHIKLMNPQRSTVWY](?![A-Za-z0-9_])",
}


def identifiers(c: Column, kind: str, known_false: Sequence[str] = ()) -> Column:
    """Distinct identifiers of a kind (structure, enzyme, protein, mutation) in upper case and order, less known false ones."""
    every = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(IDENTIFIERS[kind]), F.lit(0)), F.upper)))
    return F.array_except(every, F.array(*[F.lit(x.upper()) for x in known_false])) if known_false else every
