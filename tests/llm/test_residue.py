import random
from collections import defaultdict

import pytest
from codeweft.llm import near_dup, residue

PLACES = [
    "Dear {{ name }}, your report was closed.", "Release ${VERSION} is out.", "By <your name here> today.", "Maintained by [date goes here] since May.", "Hello %USER_NAME%, welcome.",
    "This page describes undefined and its parts.", "Welcome to [object Object], friend.", "Reviewed by (fill in owner) on Monday.", "The $$OWNER$$ decides.", "See <file-name> for more.", "Name is «owner» now.",
]
FINE = [
    "Use `{{ name }}` in the template.", "```\n{{ name }}\n```\nThe loop prints one.", "We write `undefined` as an empty cell.", "The result is undefined if the list is empty.", "Access denied errors are logged with the id.",
    "A 502 bad gateway from the proxy made it retry.", "The page works without JavaScript since this release.", "The seed job fills the tree with lorem ipsum, so don't measure on it.", "def f(x):\n    return x", "", "   ",
    "Call foo() and see <https://example.org/a>.", "We need it for every JavaScript file.",
]
TRUSTED = {
    "Error 502: bad gateway. The upstream did not answer in time.": "error_page",
    "Skip to content\n\n404 Not Found\n\nSearch or jump to…": "error_page",
    '{"status": 503, "message": "Service Unavailable"}': "error_page",
    "# A title here\n\nThis page needs JavaScript. Turn it on and reload.": "script_notice",
    "JAVASCRIPT IS DISABLED IN YOUR BROWSER.": "script_notice",
    "Lorem ipsum dolor sit amet lorem tempor magna.": "filler",
    "Overview: text text text\nIntro to follow": "filler",
    "## What happened?\n\n<!-- describe the problem -->\n\n## Steps\n\n1.\n2.\n": "empty_form",
    "Title:\nOwner:\nRisk: low / medium / high": "empty_form",
}
CONTENT = "The resolver keeps every edge of the graph in one table, since a second one would have to be joined with it in each step of the plan."


@pytest.mark.parametrize("text", PLACES)
def test_open_places(text):
    assert residue.open_place(text)


@pytest.mark.parametrize("text", FINE)
def test_text_about_residue_is_fine(text):
    assert not residue.open_place(text) and residue.trusted(text, residue._Passages())[0] == -1


@pytest.mark.parametrize(("text", "kind"), TRUSTED.items())
def test_trusted_labels(text, kind):
    found, held = residue.trusted(text, residue._Passages())
    assert residue.KINDS[found] == kind
    assert residue.trusted("\n".join([text, *[CONTENT.replace("edge", w * 3).replace("second", w * 4) for w in "abcdefgh"]]), residue._Passages())[0] == -1


def found_in(spark, texts):
    rows = [(n, t, "x") for n, t in enumerate(texts)]
    return {r.doc_id: (r.label, r.seeded) for r in residue.residue_documents(spark.createDataFrame(rows, "doc_id long, text string, node string")).collect()}


def test_residue_documents_and_propagation(spark):
    texts = [
        "404 Not Found\n\nThe owner of this page has been told.", "Gone away\n\nThe owner of this page has been told. You can go back.", "Nothing here. You can go back.",  # a chain of shared passages
        CONTENT, PLACES[0], None, "", "404 Not Found\n\nThe owner of this page has been told.",
        "The viewer of the graph can't start without scripts in this browser.", "This page needs JavaScript. The list can't start without scripts in this browser.",  # equal closings
        CONTENT + " The reviewer wrote: you can go back.", CONTENT + " A quoted note.",
    ]
    assert found_in(spark, texts) == {
        0: ("error_page", True), 1: ("error_page", False), 2: ("error_page", False), 4: ("placeholder", True), 7: ("error_page", True), 8: ("script_notice", False), 9: ("script_notice", True)
    }
    empty = residue.residue_documents(spark.createDataFrame([], "doc_id long, text string, label string"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "label", "seeded"]
    rows = spark.createDataFrame([(1, texts[0], "a"), (1, texts[0], "b"), (None, texts[0], "c")], "doc_id long, text string, label string")
    assert residue.residue_documents(rows).count() == 1


def brute(texts):
    """The same labelling without Spark and without near-duplicate links."""
    read = {}
    for n, text in enumerate(texts):
        if not residue.open_place(text):
            read[n] = residue.trusted(text, residue._Passages())
    ends = lambda p: {p[1], p[2], p[3]}
    holders = defaultdict(set)
    for n, (_, held) in read.items():
        for p, _ in held.values():
            for f in ends(p):
                holders[f].add(n)
    labelled = {n for n, (kind, _) in read.items() if kind >= 0}
    known = {p[1] for n in labelled for p, k in read[n][1].values() if k >= 0}
    while True:
        known |= {f for f, ns in holders.items() if len(ns) > 1 and len(ns & labelled) >= residue.CONDUCTING_SHARE * len(ns) and ns & labelled}
        fresh = set()
        for n in set(read) - labelled:
            b = sum(p[0] for p, _ in read[n][1].values() if ends(p) & known)
            c = sum(p[0] for p, _ in read[n][1].values() if not ends(p) & known and any(len(holders[f]) > 1 for f in ends(p)))
            if b and b >= residue.LABELLED_SHARE * (b + c):
                fresh.add(n)
        if not fresh:
            return labelled
        labelled |= fresh


def test_spread_equals_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(residue, "CONDUCTING_SHARE", 0.3)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    pools = [[" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 4, 6, 7]))) for _ in range(30)] for _ in range(2)]
    pools[0] += ["not found", "internal server error", "this page needs javascript"]
    made = [rng.choices(pools[n % 3 > 0], k=rng.randrange(1, 6)) + rng.choices(pools[n % 2], k=n % 5 == 0) for n in range(150)]
    texts = list(dict.fromkeys(". ".join(parts) + "." for parts in made))
    got = {n for n, (label, _) in found_in(spark, texts).items() if label != "placeholder"}
    assert got == brute(texts) and 10 < len(got) < len(texts)


def test_tables_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 + str(rng.randrange(90)) for _ in range(400)] for _ in range(6)]
    texts = []
    for b in base:
        for _ in range(6):
            w = list(b)
            w[rng.randrange(400)] = "changed"
            texts.append(" ".join(w))
    rows = [(f"n{i:03}", t) for i, t in enumerate(dict.fromkeys(texts))]
    monkeypatch.setattr(near_dup, "CELL", 3)
    got = {(r.left_node, r.right_node) for r in near_dup.similar_links(spark.createDataFrame(rows, "node string, text string"), beyond=False).collect()}
    want = {
        (a, b)
        for i, (a, s) in enumerate(rows)
        for b, t in rows[i + 1 :]
        if (near_dup.simhash(s) ^ near_dup.simhash(t)).bit_count() <= 3 and near_dup.jaccard(near_dup.shingles(s), near_dup.shingles(t)) >= 0.8
    }
    assert got == want and want


def test_long_texts_stay_linear():
    for part in ("<!-- ", "word ", "a/b/", "(note) ", "`x", "Title:\n", "a b " * 5 + ". "):
        residue.trusted(part * 20_000, residue._Passages())
