import pytest
from codeweft.llm import syntax
from codeweft.llm.languages import LANGUAGES

#: Beyond the 20,000 frames that a worker allows itself: a level takes three at least, but one in JSON and TOML.
DEEP, DEEPER = 8_000, 25_000
#: extension, before, opening, valid, invalid though each token pair is permissible, closing, after
FORMS = [
    ("py", "x = ", "(", "a", "(a = b)", ")", "\n"),
    ("go", "package p\n\nvar x = ", "(", "a", "(a = b)", ")", "\n"),
    ("js", "x = ", "(", "a", "(a: b)", ")", ";\n"),
    ("ts", "x = ", "(", "a", "(a: b)", ")", ";\n"),
    ("java", "class A { int x = ", "(", "a", "(a : b)", ")", "; }\n"),
    ("rs", "fn f() { let x = ", "(", "a", "(a: b)", ")", "; }\n"),
    ("c", "int x = ", "(", "a", "(a : b)", ")", ";\n"),
    ("json", "", "[", '{"a": 1}', '["a": 1]', "]", "\n"),
    ("toml", "x = ", "[", "1", "[1 = 2]", "]", "\n"),
]


def tokens(language, text):
    return "".join(syntax.Lexer(LANGUAGES[language]).lines(text))


def test_deep_files_are_judged(spark):
    files = [
        (2 * n + bad, "r", f"f{n}.{e}", before + opening * depth + (wrong if bad else right) + closing * depth + after, 1)
        for n, (e, before, opening, right, wrong, closing, after) in enumerate(FORMS)
        for depth in [DEEPER if e in ("json", "toml") else DEEP]
        for bad in (0, 1)
    ]
    df = spark.createDataFrame(files, "file_id long, repo_key string, file_path string, content string, ingested_at int")
    assert {r.file_id: r.code for r in syntax.parse_status(df).collect()} == {2 * n + 1: "E_PRODUCTION" for n in range(len(FORMS))}


@pytest.mark.parametrize(
    ("language", "before", "step", "right", "wrong", "after"),
    [
        ("Python", "x = ", "lambda: ", "a", "(a = b)", "\n"),
        ("JavaScript", "x = ", "a ? b : ", "c", "(a: b)", ";\n"),
        ("Go", "package p\nvar x ", "*", "a", "a = (a = b)", "\n"),
        ("C", "int f(void) { ", "if (a) ; else ", ";", "(a : b);", " }\n"),
    ],
)
def test_depth_without_brackets(language, before, step, right, wrong, after):
    accepts = LANGUAGES[language].grammar.recogniser()
    assert accepts(tokens(language, before + step * DEEP + right + after))
    assert not accepts(tokens(language, before + step * DEEP + wrong + after))


@pytest.mark.parametrize(
    ("language", "before", "opening", "closing", "after", "right", "wrong"),
    [
        ("JavaScript", "x = ", "(a = ", ")", ";\n", "1", "(a: b)"),
        ("Rust", "fn f() { let x = ", "{ m(", ") }", "; }\n", "1", "(a: b)"),
        ("Python", "x = ", "{", "}", "\n", "1", "(a = b)"),
        ("C", "int f(void) { ", "f(", ")", "; }\n", "1", "(a : b)"),
    ],
)
def test_deep_text_that_is_read_again(language, before, opening, closing, after, right, wrong):
    accepts = LANGUAGES[language].grammar.recogniser()
    assert accepts(tokens(language, before + opening * DEEP + right + closing * DEEP + after))
    assert not accepts(tokens(language, before + opening * DEEP + wrong + closing * DEEP + after))


def test_a_deep_unit_hides_no_later_one():
    accepts = LANGUAGES["Go"].grammar.recogniser()
    deep = "package p\nvar x = " + "(" * DEEP + "1" + ")" * DEEP + "\n"
    assert accepts(tokens("Go", deep + "var y = 1\n")) and not accepts(tokens("Go", deep + "var y = (a = b)\n"))
