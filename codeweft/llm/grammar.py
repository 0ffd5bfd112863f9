"""Small grammars: one notation gives permissible token pairs and a recogniser.

A grammar is text, one rule a line: ``name = alternative | alternative``, with
quoted tokens, token classes (``id``, ``num``, ``str`` and those a language
names) and rules, groups in parentheses, the suffixes ``? * +`` and, before a part, ``&`` and
``!`` for what must or must not follow. Choices are
ordered and don't give back what they matched; ``eos`` ends a statement of a
script language. Each token or class is one
character of the text that is recognised, assigned in order of appearance.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Characters that stand for tokens; one or two bytes each in UTF-8.
ALPHABET = [chr(c) for c in [*range(0x30, 0x7F), *range(0xC0, 0x250)] if chr(c).isprintable()]
#: A token no grammar knows.
UNKNOWN = "\u0001"
NEWLINE = "\n"
#: Where line breaks matter inside statements, a token after one has this added to its character.
AFTER_BREAK = 0x1000
#: Parts read within a rule beyond which its end is kept, where rules don't call each other.
KEPT = 64
PART = re.compile(r"\s*(?:'([^']+)'|([A-Za-z_]\w*)|([()|?*+&!]))")


class Grammar:
    """``code``: token or class to character; ``pairs``: permissible neighbours; ``recogniser()``: whether a text is a ``unit``."""

    def __init__(self, text: str, classes: tuple[str, ...], breaks: bool = False) -> None:
        self.code: dict[str, str] = {}
        self.classes = classes
        self.breaks = breaks
        self.rules: dict[str, tuple] = {}
        for line in filter(None, map(str.strip, text.splitlines())):
            name, _, body = line.partition(" = ")
            if not body:
                raise ValueError(f"no rule: {line}")
            parts = PART.findall(body)
            node, at = self._choice(parts, 0)
            if at != len(parts):
                raise ValueError(f"left over in {line}")
            self.rules[name.strip()] = node
        self._neighbours()

    def char(self, token: str) -> str:
        if token not in self.code:
            self.code[token] = ALPHABET[len(self.code)]
        return self.code[token]

    # ---- reading the notation
    def _choice(self, parts: list, at: int) -> tuple[tuple, int]:
        options = []
        while True:
            items = []
            while at < len(parts) and parts[at][2] not in ("|", ")"):
                item, at = self._item(parts, at)
                items.append(item)
            options.append(("seq", items))
            if at < len(parts) and parts[at][2] == "|":
                at += 1
                continue
            return (("any", options) if len(options) > 1 else options[0]), at

    def _item(self, parts: list, at: int) -> tuple[tuple, int]:
        token, name, sign = parts[at]
        if sign in ("&", "!"):
            node, at = self._item(parts, at + 1)
            return (sign, node), at
        if sign == "(":
            node, at = self._choice(parts, at + 1)
            at += 1
        else:
            node = ("tok", self.char(token)) if token else ("tok", self.char("<" + name + ">")) if name in self.classes else ("ref", name)
            at += 1
        while at < len(parts) and parts[at][2] in ("?", "*", "+"):
            node = (parts[at][2], node)
            at += 1
        return node, at

    # ---- permissible pairs: whatever may end one part before what may begin the next
    def _neighbours(self) -> None:
        facts = {name: (False, frozenset(), frozenset()) for name in self.rules}  # nullable, first, last
        while True:
            fresh = {name: self._facts(node, facts) for name, node in self.rules.items()}
            if fresh == facts:
                break
            facts = fresh
        self.pairs: set[tuple[str, str]] = set()
        self.facts = facts
        for node in self.rules.values():
            self._collect(node, facts)
        self.pairs |= {(a, b) for a in facts["unit"][2] for b in facts["unit"][1]}

    def _facts(self, node: tuple, facts: dict) -> tuple[bool, frozenset, frozenset]:
        kind, body = node
        if kind == "tok":
            return False, frozenset([body]), frozenset([body])
        if kind == "ref":
            semicolon = frozenset([self.char(";")])
            return (True, semicolon, semicolon) if body == "eos" else facts[body]
        if kind == "any":
            all_ = [self._facts(n, facts) for n in body]
            return any(n for n, _, _ in all_), frozenset().union(*(f for _, f, _ in all_)), frozenset().union(*(x for _, _, x in all_))
        if kind == "seq":
            all_ = [self._facts(n, facts) for n in body]
            first, last = set(), set()
            for n, f, _ in all_:
                first |= f
                if not n:
                    break
            for n, _, x in reversed(all_):
                last |= x
                if not n:
                    break
            return all(n for n, _, _ in all_), frozenset(first), frozenset(last)
        if kind in ("&", "!"):
            return True, frozenset(), frozenset()
        n, f, x = self._facts(body, facts)
        return n or kind in "?*", f, x

    def _collect(self, node: tuple, facts: dict) -> None:
        kind, body = node
        if kind in ("any", "seq"):
            for n in body:
                self._collect(n, facts)
        if kind == "seq":
            open_: set[str] = set()
            for n in body:
                null, first, last = self._facts(n, facts)
                self.pairs |= {(a, b) for a in open_ for b in first}
                open_ = (open_ | last) if null else set(last)
        elif kind in ("?", "*", "+"):
            self._collect(body, facts)
            if kind != "?":
                _, first, last = self._facts(body, facts)
                self.pairs |= {(a, b) for a in last for b in first}

    # ---- the recogniser: one Python function a rule, choices taken by the next character
    def recogniser(self) -> Callable[[str], bool]:
        """A function that tells whether a text of token characters is a run of ``unit``s.

        Linear but for what a choice reads again; a unit nested deeper than
        Python's stack allows is read by the same rules without it (``_end``).
        """
        unit, deep = self._compiled("r_{}(s, {})", "return"), None

        def accepts(text: str) -> bool:
            nonlocal deep
            p, ended = 0, text + "\0"
            while p < len(text):
                try:
                    q = unit(ended, p)
                except RecursionError:
                    deep = deep or self._compiled("(yield r_{}, {})", "yield")
                    q = _end(deep, ended, p)
                if q <= p:
                    return False
                p = q
            return True

        return accepts

    def _compiled(self, call: str, give: str) -> Callable:
        """The rule ``unit`` as a Python function; ``call`` reads another rule, ``give`` hands over the end."""
        self._made, self._call = 0, call
        self._sets: dict[str, frozenset] = {}
        lines = []
        for name, node in self.rules.items():
            lines.append(f"def r_{name}(s, p):")
            out = self._emit(node, "p", 1, lines)
            lines.append(f"    {give} {out}")
        space: dict = dict(self._sets)
        exec("\n".join(lines), space)  # noqa: S102: the text is made from the grammar alone
        return space["r_unit"]

    def _after(self, chars: frozenset) -> frozenset:
        return chars | {chr(ord(c) + AFTER_BREAK) for c in chars} if self.breaks else chars

    def _set(self, chars: frozenset) -> str:
        chars = self._after(chars)
        name = next((n for n, c in self._sets.items() if c == chars), None)
        if name is None:
            name = f"F{len(self._sets)}"
            self._sets[name] = chars
        return name

    def _emit(self, node: tuple, p: str, depth: int, lines: list[str]) -> str:
        """Appends code that matches ``node`` at position ``p``; the name it returns holds the end, or -1."""
        kind, body = node
        self._made += 1
        r, pad = f"v{self._made}", "    " * depth
        null, first, _ = self._facts(node, self.facts)
        if kind == "tok":
            test = f"s[{p}] in {self._set(frozenset([body]))}" if self.breaks else f"s[{p}] == {body!r}"
            lines.append(f"{pad}{r} = {p} + 1 if {test} else -1")
        elif kind == "ref" and body == "eos":
            close, end = self._set(frozenset([self.char("}")])), self._set(frozenset([self.char(";")]))
            lines.append(f"{pad}{r} = {p} + 1 if s[{p}] in {end} else {p} if s[{p}] in {close} or s[{p}] == '\\0' or s[{p}] >= {chr(ord(ALPHABET[0]) + AFTER_BREAK)!r} else -1")
        elif kind == "ref":
            got = self._call.format(body, p)
            lines.append(f"{pad}{r} = {got}" if null else f"{pad}{r} = {got} if s[{p}] in {self._set(first)} else -1")
        elif kind == "any":
            lines += [f"{pad}{r} = -1", f"{pad}while 1:"]
            for option in body:
                can_be_empty, begin, _ = self._facts(option, self.facts)
                deeper = depth + 1
                if not can_be_empty:
                    lines.append(f"{pad}    if s[{p}] in {self._set(begin)}:")
                    deeper += 1
                got = self._emit(option, p, deeper, lines)
                lines.append(f"{'    ' * deeper}if {got} >= 0:")
                lines += [f"{'    ' * deeper}    {r} = {got}", f"{'    ' * deeper}    break"]
            lines.append(f"{pad}    break")
        elif kind == "seq":
            lines += [f"{pad}{r} = {p}", f"{pad}while 1:"]
            for item in body:
                got = self._emit(item, r, depth + 1, lines)
                lines += [f"{pad}    {r} = {got}", f"{pad}    if {r} < 0:", f"{pad}        break"]
            lines.append(f"{pad}    break")
        elif kind in ("&", "!"):
            got = self._emit(body, p, depth, lines)
            lines.append(f"{pad}{r} = {p} if {got} {'>=' if kind == '&' else '<'} 0 else -1")
        elif kind == "?":
            can_be_empty, begin, _ = self._facts(body, self.facts)
            lines.append(f"{pad}{r} = {p}")
            lines.append(f"{pad}if s[{p}] in {self._set(begin)}:" if not can_be_empty else f"{pad}if 1:")
            got = self._emit(body, p, depth + 1, lines)
            lines += [f"{pad}    if {got} >= 0:", f"{pad}        {r} = {got}"]
        else:
            begin = self._set(self._facts(body, self.facts)[1])
            if kind == "+":
                got = self._emit(body, p, depth, lines)
                lines.append(f"{pad}{r} = {got}")
                lines.append(f"{pad}while {r} >= 0 and s[{r}] in {begin}:")
            else:
                lines += [f"{pad}{r} = {p}", f"{pad}while s[{r}] in {begin}:"]
            got = self._emit(body, r, depth + 1, lines)
            lines += [f"{pad}    if {got} <= {r}:", f"{pad}        break", f"{pad}    {r} = {got}"]
        return r


def _end(rule: Callable, s: str, p: int) -> int:
    """Where ``rule``, a generator that yields the rules it calls and then its end, ends at position ``p``, or -1.

    Open calls wait in a list, so the depth is bounded by memory alone. Ends of
    long readings are kept: what a choice reads again costs at most ``KEPT`` parts.
    """
    open_: list[tuple] = []
    ends: dict[tuple, int] = {}
    parts, began, call, read, got = 0, 0, (rule, p), rule(s, p).send, None
    while True:
        got = read(got)
        parts += 1
        if type(got) is tuple:
            end = ends.get(got)
            if end is None:
                open_.append((read, call, began))
                began, call, read = parts, got, got[0](s, got[1]).send
            got = end
            continue
        if parts - began > KEPT:
            ends[call] = got
        if not open_:
            return got
        read, call, began = open_.pop()
