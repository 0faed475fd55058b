import random

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import line_quality as Q

SUBJECTS, VERBS, OBJECTS = ["The shop", "A customer", "Our support team", "My sister"], ["asked for", "sent back", "looked at", "liked"], ["the blue lamp because it was small", "a parcel that had not arrived", "the price of the set", "two of them in the spring"]


def make(kind, r):
    n = r.randint(3, 12)
    if kind == "prose":
        return " ".join(f"{r.choice(SUBJECTS)} {r.choice(VERBS)} {r.choice(OBJECTS)}." for _ in range(n))
    if kind == "list":
        return "\n".join(f"- {r.randint(1, 9)} x {r.choice(['Ember', 'Dune'])} {r.choice(['Mug', 'Lamp', 'Tee'])}" for _ in range(n))
    if kind == "table":
        return "sku,title,price\n" + "\n".join(f"SKU-{r.randint(10000, 99999)},{r.choice(['Mug', 'Lamp'])},{r.random() * 90:.2f}" for _ in range(n))
    return "\n".join(f"2024-01-{r.randint(10, 28)} INFO [{r.randint(0, 1 << 30):x}] phase=mine ms={r.randint(1, 9999)}" for _ in range(n))


def corpus(spark, n, seed):
    r = random.Random(seed)
    return spark.createDataFrame([(i, make(Q.KINDS[i % 4], r), Q.KINDS[i % 4]) for i in range(n)], "doc_id long, text string, kind string")


def test_held_out_accuracy(spark):
    train, test = corpus(spark, 80, 1), corpus(spark, 80, 2)
    model = Q.fit_model(train, train.select("doc_id", "kind"))
    wrong = [r for r in test.collect() if Q.KINDS[int(model.shares(r["text"]).argmax())] != r["kind"]]
    assert len(wrong) <= 2
    mixed = make("prose", random.Random(5)) + "\n" + make("prose", random.Random(6)) + "\n- 2 x Ember Mug\n- 1 x Dune Tee"
    assert model.shares(mixed)[0] > 0.5
    extra = spark.createDataFrame([(1, None, "x"), (2, "  \n", "x"), (3, "a " * 50_000, "x"), (4, mixed, "x"), (4, mixed, "x")], "doc_id long, text string, prose string")
    got = {r["doc_id"]: r for r in Q.document_quality(extra, model).collect()}
    assert got[1]["words"] == got[2]["words"] == 0 and got[1]["prose"] is None and got[3]["words"] == 50_000
    assert abs(sum(got[4][k] for k in Q.KINDS) - 1) < 1e-9
    assert Q.document_quality(extra.limit(0), model).count() == 0
    # the same labels in another order give the same model
    again = Q.fit_model(train.orderBy(F.desc("doc_id")), train.select("doc_id", "kind").orderBy(F.rand(3)))
    assert np.allclose(again.weights, model.weights)


def test_posteriors_sum_to_one():
    r = random.Random(4)
    m = Q.LineModel(steps=50).fit([(Q.line_statistics(Q.lines_of(make(k, r))), i) for i, k in enumerate(Q.KINDS)])
    p = m.posteriors(Q.line_statistics(Q.lines_of(make("list", r))))
    assert np.allclose(p.sum(1), 1)


def test_statistics_of_many_lines_are_those_of_each():
    lines = ["a\tb", "  ", "x\x1cy . ", "...", "a,,b", ", ,", "é", "ﬁ 12%", "a. b", "日本語。はい", "q " * 9, "A;b|c=d\t", "One two, three four five six seven two.", "- item <b>x</b>", ""]
    every = Q.line_statistics(lines)
    assert (every == np.vstack([Q.line_statistics([x]) for x in lines])).all()
    at = dict(zip(Q.NAMES, every[12]))
    assert round(np.expm1(at["words"])) == 8 and at["distinct_share"] == 7 / 8 and at["top_word_share"] == 2 / 8 and at["capital_share"] == 1 / 8 and at["ends_sentence"] == 1
    assert at["stop_rate"] == 1 / 8 and at["comma_rate"] == 1 / 8 and round(np.expm1(at["segment_words"])) == 4
    assert dict(zip(Q.NAMES, every[13]))["bullet"] == 1 and dict(zip(Q.NAMES, every[13]))["tag_rate"] == 2 / 3
    assert Q.line_statistics([]).shape == (0, len(Q.NAMES))
