import pytest
from codeweft.llm import handwritten

LICENCE = "Permission is granted to use, copy and change this text in all ways.\n" * 100


@pytest.mark.parametrize(
    ("path", "text", "rule"),
    [
        ("a.js", f"foo();\n/*\n * Code generated by tool. DO NOT EDIT.\n{LICENCE}*/\n", "generated_header"),
        ("a.js", f"foo(); /* one */\n/* Copied from lib 1.2; fix bugs upstream.\n{LICENCE}src/*.js\n*/", "vendored_header"),
        ("a.py", f'foo()\n"""\nCode generated by tool. DO NOT EDIT.\n{LICENCE}"""\n', "generated_header"),
        ("a.py", "foo()\n# Code generated by tool. DO NOT EDIT.\n" + LICENCE.replace("Perm", "# Perm") + "\n", "generated_header"),
        ("a.js", f"/* one */ foo('/* Code generated by tool */');\nbar();\n{LICENCE}\nx('*/')", None),
        ("a.js", "foo();\n/* Code generated by tool. DO NOT EDIT. */\nbar();\n/* end */\n", None),
    ],
)
def test_closing_comments_of_any_length(path, text, rule):
    assert handwritten.squeezed_or_written(path, text, "gh/me/own") == rule
