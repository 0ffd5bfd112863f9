import random
import re

from codeweft.llm import leakage

DOC, ITEM = "doc_id long, text string, item_id string", "item_id long, passage string, doc_id string"


def brute(docs, items, run):
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    grams = lambda w: {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
    return {(d, i) for d, t, _ in docs for i, p, _ in items if d is not None and i is not None and grams(words(t)) & grams(words(p))}


def test_leaks_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["a", "be", "sea", "deal", "eagle", "ferret", "gazelle", "i", "x1"])
    items = [(n, " ".join(word() for _ in range(rng.randrange(5, 40))), "z") for n in range(25)] + [(None, "a " * 20, "z"), (90, None, "z"), (91, "a b c", "z"), (92, "a b c d e f g h i j k l", "z")]
    docs = [(92, "A, b; c\nd-e f (g) h i j K L!", "y"), (93, None, "y"), (94, "", "y"), (None, "a b c d e f g h i j k l", "y"), (95, "a b c d e f g h i j k", "y")]
    for n in range(60):
        p = rng.choice(items[:25])[1].split(" ")
        cut = rng.randrange(0, max(1, len(p) - 8))
        docs.append((n, " ".join(word() for _ in range(30)) + " " + ", ".join(p[cut : cut + rng.randrange(8, 20)]).upper() + " " + word(), "y"))
    docs.append(docs[-1])
    got = leakage.leaked_items(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM))
    rows = [(r.doc_id, r.item_id) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(docs, items, 12) and (92, 92) in rows


def test_edits_are_allowed(spark):
    passage = "once the table is merged with another each of the rows that carry it must point back exactly once"
    near = passage.replace("merged", "joined")
    docs = spark.createDataFrame([(1, "so " + near + " end", "")], DOC)
    items = spark.createDataFrame([(1, passage, "")], ITEM)
    assert leakage.leaked_items(docs, items, run_words=18).count() == 0
    assert leakage.leaked_items(docs, items, run_words=18, edits=1).count() == 1


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    assert leakage.leaked_items(docs, items).count() == 0
    assert leakage.leak_report(leakage.leaked_items(docs, items)).count() == 0


def test_longest_run_band():
    a, b = "x a b c d y".split(), "a b c d".split()
    assert leakage.longest_run(a, b, 0, 2, 0) == 4
    assert leakage.longest_run(a, b, 2, 3, 0) == 0
    assert leakage.longest_run("a b q c d".split(), b, 0, 2, 1) == 4
