import time

import pytest
from codeweft.llm import residue

LONG = "the title of the report that the owner of the project will send to all of its readers"


@pytest.mark.parametrize(
    "text",
    [
        'By {{ author|default("not known") }} today.', "{{#each items}} is left.", "See {{> part}} here.", f"Dear {{{{ {LONG} }}}}, hello.", "So {{ f({'a': 1}) }} stays.", f"A {{% if a == '{LONG}' and {{}} %}} b.", f"A <%= {LONG} 5 % 3 %> b.",
        f"It is [INSERT {LONG}] now.", f"It is <insert {LONG}> now.", f"Now [{LONG} goes here].", f"Now (fill in {LONG}).", "Runs ${VERSION:-1.0 or so} now.", "See <file-name> in <b>all</b> folders.", "Hello {" + "a" * 60 + "}.",
    ],
)
def test_places_of_any_length_and_wording(text):
    assert residue.open_place(text)


@pytest.mark.parametrize("text", ["<my-part>one</my-part> is an element.", "<my-part>\n" + "text " * 200 + "\n</my-part>", "The sets {{1, 2}, {3}} and {{1, 2}} differ.", r"A {{\bf word}} here.", "<%>", "{{}}"])
def test_no_places(text):
    assert not residue.open_place(text)


@pytest.mark.parametrize("part", ["{{ a", "{% a ", "<% a ", "[insert ", "(fill in ", "<my-part></my-part>", "[a goes ", "{{ a{1,} "])
def test_places_stay_linear(part):
    began = time.process_time()
    assert not residue.open_place(part * 20_000)
    assert time.process_time() - began < 5
