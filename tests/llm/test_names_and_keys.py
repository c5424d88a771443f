"""Column names with dots, many languages, texts under null ids, keys of texts."""

import numpy as np
from pyspark.sql import functions as F

from proofset.llm import chat, decontaminate, jaccard, language_id, secrets
from proofset.llm.common import text_key

WORDS = "the of and to in that it was for on are with as his they be at one have this from".split()
DOTTED = "doc_id long, text string, lang string, source string, `meta.url` string, `odd name` long"


def dotted(spark):
    body = " ".join(WORDS)
    rows = [(1, body, "en", "a", "u1", 1), (2, body, "en", "b", "u2", 2), (3, 'password = "abcdef123" ' + body[::-1], "en", "a", "u3", 3), (4, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOTTED)


def test_stages_keep_columns_with_dots_in_their_names(spark):
    docs = dotted(spark)
    bench = spark.createDataFrame([("i", " ".join(WORDS[:12])), ("j", "zzz yyy")], "item_id string, text string")
    net = language_id.train([b"the of and to in that it was"] * 4 + ["été où ça là été".encode()] * 4, ["en"] * 4 + ["fr"] * 4)
    made = {
        "identified": language_id.keep_identified(docs, net, 0.0),
        "one": jaccard.keep_one(docs, jaccard.Rule(width=5, num=4, den=5)),
        "clean": decontaminate.remove_contamination(docs, bench),
        "clean in groups": decontaminate.remove_contamination(docs, bench, group_bytes=8),
        "redacted": secrets.redact_live(docs),
    }
    for name, out in made.items():
        assert out.columns == docs.columns, name
        assert {r["meta.url"] for r in out.collect()} <= {"u1", "u2", "u3", None} and out.count() > 0, name


def test_two_keys_of_a_text_are_independent(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "t string").select(*[h.alias(c) for h, c in zip(text_key(F.col("t")), "ab")])
    first = rows.withColumn("from_a", F.expr("xxhash64(a)")).collect()
    chained = spark.createDataFrame([("a",)], "t string").select(F.xxhash64("t", F.lit(1)).alias("x")).first().x
    assert chained != first[0].b and len({r.b for r in first} | {r.a for r in first}) == 4


def test_more_languages_than_a_byte_counts():
    names = [f"l{k:03d}" for k in range(140)]
    net = language_id.train([f"{n} {n}".encode() for n in names], names)
    mean, votes = language_id.pooled(net, [b"some text", b"l139"])
    assert mean.shape == votes.shape == (2, 140) and votes.sum(1).tolist() == [9, 4]


def test_texts_under_null_ids_are_compared_once(spark, monkeypatch):
    rng = np.random.default_rng(0)
    texts = []
    for _ in range(100):
        w = rng.choice(WORDS, 60).tolist()
        texts += [" ".join(w), " ".join(w[:-1] + ["changed"])]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    rule = jaccard.Rule(width=4, num=85, den=100)
    seen = spark.sparkContext.accumulator(0)
    whole = jaccard.verified

    def counted(t, rule):
        seen.add(t.num_rows)
        return whole(t, rule)

    monkeypatch.setattr(jaccard, "verified", counted)
    groups = jaccard.similar_groups(docs, rule).groupBy("group").count().collect()
    assert sorted(r["count"] for r in groups) == [2] * 100
    assert 200 <= seen.value <= 800, seen.value


def test_windows_stay_inside_the_budget():
    w = chat.Windows(1, 256, 100)
    made = []
    for k, n in enumerate([200, 40, 100, 30, 90, 300, 20]):
        made += list(w.add("system" if k == 0 else ["user", "assistant"][k % 2], f"t{k}", n))
    made.append(w.flush())
    fresh = {r["first_turn"]: r for r in made}
    assert all(r["n_tokens"] <= 256 for r in made if r["first_turn"] != 5) and fresh[5]["n_tokens"] == 300
    assert sorted(fresh) == [0, 2, 4, 5, 6]
