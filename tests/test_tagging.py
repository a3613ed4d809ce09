"""Tags by terms against a search for each term."""

import random
import re

from tessera.operators import tagging


def test_tags_are_those_of_a_search_for_each_term(spark):
    rng = random.Random(5)
    rules = [("metal", "iron", "iron"), ("metal", "iron", "Fe(II)"), ("metal", "copper", "cu"), ("kind", "oxidase", "oxidase"), ("kind", "oxidase", "iron oxidase"), ("kind", "none", ""), ("dot", "x", "a.b"), ("metal", "tin", "tin")]
    words = ["iron", "Iron", "irons", "fe(ii)", "FE(II),", "cu", "cue", "cu-", "oxidase", "a.b", "aab", "tin", "étin", "tiné", "x9", ".", "\n"]
    texts = ["".join(rng.choice(words) + rng.choice((" ", " ", "", "-")) for _ in range(rng.randint(0, 8))) for _ in range(300)] + [None, "", "iron", "cu" * 5000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    got = {r.id: (r.metal, r.kind, r.dot) for r in tagging.tagged(df, "text", rules).collect()}
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    for k, t in enumerate(texts):
        want = {"metal": [], "kind": [], "dot": []}
        for field, tag, term in rules:
            w = lower(term)
            edge = (r"(?<![a-z0-9])" if re.match("[a-z0-9]", w) else "", r"(?![a-z0-9])" if re.search("[a-z0-9]$", w) else "")
            if term and re.search(edge[0] + re.escape(w) + edge[1], lower(t or "")) and tag not in want[field]:
                want[field].append(tag)
        assert got[k] == tuple(";".join(v) for v in want.values()), t
    made = tagging.tagged(df, "text", rules).select(tagging.first_tag("metal", "no metal").alias("m")).distinct().collect()
    assert {r.m for r in made} >= {"no metal", "iron", "copper"}
    assert tagging.tagged(df, "text", []).columns == ["id", "text"] and tagging.tagged(df.limit(0), "text", rules).count() == 0
