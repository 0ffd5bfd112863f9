import random

import pytest
from codeweft.llm import near_dup, residue


def test_near_duplicate_passages_conduct(spark):
    rng = random.Random(2)
    words = " ".join(chr(97 + rng.randrange(26)) * 3 for _ in range(300))
    texts = [(1, f"404 not found. {words}"), (2, "zz zz " + words + " wenting"), (3, "plain text on graphs")]
    found = residue.residue_documents(spark.createDataFrame(texts[:1] + [(2, "zz " + words[4:-4] + " wenting")] + texts[2:], "doc_id long, text string")).collect()
    assert not found  # two words of three hundred are no trusted share
    long = " ".join("abcdefghijklmnopqrs"[i] * 3 for i in range(16))
    rows = [(1, "404 not found. " + long), (2, "zz " + long + " wenting"), (3, "plain text on graphs")]
    found = residue.residue_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.label, r.seeded) for r in found} == {1: ("error_page", True), 2: ("error_page", False)}


@pytest.mark.parametrize("frequent", [0, 20, 100_000])
def test_similar_links_have_every_pair_of_the_threshold(spark, monkeypatch, frequent):
    rng = random.Random(5)
    texts = ["", "...", "one two", "One, two!", "a b c d e f g h i", "a b c d e f g h i j"]
    for length in (8, 9, 12, 30, 60, 100, 200):
        base = [rng.choice("abcdefgh") * 3 + str(rng.randrange(90)) for _ in range(length)]
        for changes in (0, 0, 1, 1, 1, 2, 3, 5):
            words = list(base)
            for _ in range(changes):
                words[rng.randrange(length)] = f"w{rng.randrange(9)}"
            texts += [" ".join(words), " ".join(words).upper()][: 1 + (changes == 1)]
    texts = list(dict.fromkeys(texts))
    rows = [(f"n{i:03}", t) for i, t in enumerate(texts)]
    monkeypatch.setattr(near_dup, "CELL", 3)
    monkeypatch.setattr(near_dup, "FREQUENT", frequent)
    got = {(r.left_node, r.right_node) for r in near_dup.similar_links(spark.createDataFrame(rows, "node string, text string")).collect()}
    sets = {n: near_dup.shingles(t) for n, t in rows}
    rep = {n: min(m for m in sets if sets[m] == s) for n, s in sets.items()}
    far = 0
    want = {(rep[n], n) for n in sets if rep[n] != n}
    for a in set(rep.values()):
        for b in set(rep.values()):
            if a < b and near_dup.jaccard(sets[a], sets[b]) >= 0.8:
                want.add((a, b))
                far += (near_dup.simhash(texts[int(a[1:])]) ^ near_dup.simhash(texts[int(b[1:])])).bit_count() > near_dup.HAMMING
    assert got == want and far > 5


def test_near_texts_of_some_nodes(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "CELL", 2)
    base = [f"w{i}" for i in range(80)]
    texts = [(n, " ".join(base[:i] + [f"v{n}"] * (i > 0) + base[i + (i > 0) :])) for n, i in enumerate([0, 0, 5, 9, 14, 0])]
    texts += [(6, " ".join(base).upper()), (7, "other words"), (8, "Other, words!")]
    near = near_dup.NearTexts(spark.createDataFrame(texts, "node long, text string").dropDuplicates(["text"]))
    got = {(r.node, r.other) for r in near.of(spark.createDataFrame([(2,), (6,), (8,)], "node long")).collect()}

    present = {r.node for r in near.sets.select("node").unionByName(near.members.select("node")).collect()}

    want = {(a, b) for a in (2, 6, 8) if a in present for b in present if a != b and near_dup.jaccard(near_dup.shingles(dict(texts)[a]), near_dup.shingles(dict(texts)[b])) >= 0.8}
    assert got == want and len(want) > 3
