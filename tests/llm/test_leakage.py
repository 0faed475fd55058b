from tallyloom.llm import leakage as L

from ..conftest import rows

ITEM = "A pilot store called Dorvexkel stocks 937 crates of rope hammocks and 94 crates of cork boards"
WORDS = ITEM.split()


def test_normalised_words():
    assert L.normalised("Café ＡＢＣ１２ x​y, soft­ened ﬁn İ") == " cafe abc12 xy softened fin i "
    assert L.normalised("!!!") == "  "


def test_leaks(spark):
    twelve, eleven = " ".join(WORDS[2:14]), " ".join(WORDS[2:13])
    docs = [
        (1, f"before {twelve} after", 0), (1, f"before {twelve} after", 0), (2, f"before {eleven} other after", 0), (3, None, 0), (4, "", 0), (5, twelve.upper().replace(" ", " -- "), 0),
        (6, "ＣＡＬＬＥＤ".join(twelve.split("called")), 0), (7, "x" + twelve, 0), (8, twelve + "s", 0), (9, twelve.replace("store", "sto​ré"), 0), (10, "pad " * 50_000 + ITEM, 0), (11, " ".join(WORDS[:8] + ["new"] + WORDS[8:]), 0),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(70, ITEM), (70, ITEM), (71, "too short for a case"), (72, None), (73, ITEM + " too")], "item_id long, item_text string")
    want = sorted([(i, j) for i in (1, 5, 6, 9, 10) for j in (70, 73)], key=repr)
    assert rows(L.find_leaks(d, items)) == want
    assert rows(L.find_leaks(d, items, bound=150)) == want
    assert L.find_leaks(d, items.limit(0)).count() == 0 and L.find_leaks(d.limit(0), items).count() == 0


def test_places_are_of_the_original_text(spark):
    text = "Vorwörter! " + ITEM.replace("store", "STÖRE".replace("Ö", "Ö")) + "."
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, item_text string")
    ((_, _, a, b),) = rows(L.find_leaks(d, items, places=True), "doc_id", "item_id", "first_char", "last_char")
    assert text[a : b + 1].startswith("A pilot") and text[a : b + 1].endswith("cork boards")


def test_against_brute_force_with_repeats():
    import random

    r = random.Random(5)
    for _ in range(300):
        words = r.choice([1, 2, 3, 5, 12])
        items = [(i, " ".join(r.choices("ab", k=r.randint(0, 3 * words)))) for i in range(4)]
        text = " ".join(r.choices("abz", weights=[5, 5, 1], k=80))
        there = text.split()
        windows = {tuple(there[a : a + words]): 1 for a in range(len(there) - words + 1)}
        want = {i for i, t in items if any(tuple(t.split()[a : a + words]) in windows for a in range(len(t.split()) - words + 1))}
        s = L.Items(items, words)
        assert set(s.find(text)) == set(s.find(text, True)) == want
        for i, passages in s.find(text).items():
            starts = {k for a, n in passages for k in range(a, a + n - words + 1)}
            own = dict(items)[i].split()
            runs = {tuple(own[a : a + words]) for a in range(len(own) - words + 1)}
            assert starts == {a for a in range(len(there) - words + 1) if tuple(there[a : a + words]) in runs}


def test_many_items_are_one_scan(spark):
    """20 000 items: the plan reads the documents once."""
    items = spark.range(20_000).selectExpr("id AS item_id", "concat('question ', id, ' asks about ', id * 7, ' things that were seen in the year ', id % 2000, ' by ', id, ' people') AS item_text")
    text = "x " + items.where("item_id = 17").first()["item_text"] + " y"
    d = spark.createDataFrame([(1, text), (2, text.replace("people", "persons")), (3, "things that were seen in the year")], "doc_id long, text string")
    found = L.find_leaks(d, items)
    assert rows(found) == [(1, 17), (2, 17)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
