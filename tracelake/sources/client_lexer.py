"""Client files (TypeScript, JavaScript, with or without markup) as tokens, and the HTTP calls among them.

One pass over a text keeps a stack of what is open: brackets, template literals with expressions inside, markup tags and their children.
Strings, comments, regular expressions and markup text never count as code. Brackets, templates and type arguments are paired as they
close, so that every later step looks at a few tokens only, and the time grows with the length of the text, whatever it holds.
What does not close stays open; the rest of the file is read alike.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

# Names that mark a client call.
CALLEES = ("fetch", "axios", "apiclient", "client", "request", "http")
VERBS = ("get", "post", "put", "delete", "patch", "head", "options")

_CODE = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<s>'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*")
    |(?P<i>(?:[^\W\d]|\$)[\w$]*)
    |(?P<n>\d[\w.]*)
    |(?P<o>=>|\?\.(?!\d)|[=!]==?|[<>]=|&&|\|\||\?\?|\+\+|--|.)""",
    re.S | re.X,
)
_LITERAL = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_TAG = re.compile(r"\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|\"[^\"]*\"|'[^']*'|/>|[{>]|[^\s\"'{/>]+|.", re.S)
_OPENS_TAG = re.compile(r"<(?:>|[^\W\d][\w$.:-]*(?=[\s/>{]))")
_TYPE_PARAMETERS = re.compile(r"<\s*[^\W\d][\w$]*\s*(?:,|extends\b)")
_KIDS = re.compile(r"[^<{]*")
_END_TAG = re.compile(r"</[^>]*>?")
#: Words after which an expression begins.
_BEFORE = frozenset("return typeof case in of delete void throw new else do await yield default instanceof".split())
_CLOSES = {")": "(", "]": "[", "}": "{"}
#: Tokens that may stand among type arguments.
_IN_TYPES = frozenset(["i", "s", "n", ".", ",", "|", "&", "?", ":", "=>"])


class Tokens:
    """Kinds, bounds and partners of the tokens of one text.

    Kinds: i name, s string, n number, r regular expression, ` and t the ends of a template, $ and e those of an expression in a template or in markup,
    x and X those of a markup element; anything else stands for itself.
    """

    def __init__(self, text: str, markup: bool):
        self.text = text
        self.kind: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.mate: list[int] = []
        self._read(markup)
        self._pair_types()
        self._find_heads()

    def _put(self, kind: str, start: int, end: int, mate: int = -1) -> int:
        k = len(self.kind)
        self.kind.append(kind)
        self.start.append(start)
        self.end.append(end)
        self.mate.append(mate)
        if mate >= 0:
            self.mate[mate] = k
        return k

    def ends_operand(self, k: int) -> bool:
        kind = self.kind[k] if k >= 0 else ""
        return kind in ("s", "n", "r", "t", ")", "]", "X") or kind == "i" and self.text[self.start[k] : self.end[k]] not in _BEFORE

    def _read(self, markup: bool) -> None:
        text, size, at = self.text, len(self.text), 0
        stack: list[tuple[str, int]] = []  # what is open, with its token; brackets count by region, which is a file or an expression inside something
        regions = [{"(": 0, "[": 0, "{": 0}]

        def close(opening: str) -> int:
            """Take brackets off the stack up to the opening one; those above it stay without a partner."""
            while True:
                kind, k = stack.pop()
                regions[-1][kind] -= 1
                if kind == opening:
                    return k

        while at < size:
            mode = stack[-1][0] if stack else ""
            if mode == "`":
                at = _TEMPLATE.match(text, at).end()
                if text.startswith("${", at):
                    stack.append(("$", self._put("$", at, at + 2)))
                    regions.append({"(": 0, "[": 0, "{": 0})
                    at += 2
                elif at < size:
                    self._put("t", at, at + 1, stack.pop()[1])
                    at += 1
            elif mode == "kids":
                at = _KIDS.match(text, at).end()
                if text.startswith("{", at):
                    stack.append(("$", self._put("$", at, at + 1)))
                    regions.append({"(": 0, "[": 0, "{": 0})
                    at += 1
                elif text.startswith("</", at):
                    end = _END_TAG.match(text, at).end()
                    self._put("X", at, end, stack.pop()[1])
                    at = end
                elif at < size:
                    stack.append(("tag", self._put("x", at, at + 1)))
                    at += 1
            elif mode == "tag":
                m = _TAG.match(text, at)
                found = m.group()
                if found == "{":
                    stack.append(("$", self._put("$", at, at + 1)))
                    regions.append({"(": 0, "[": 0, "{": 0})
                elif found == "/>":
                    self._put("X", at, m.end(), stack.pop()[1])
                elif found == ">":
                    stack[-1] = ("kids", stack[-1][1])
                at = m.end()
            else:
                m = _CODE.match(text, at)
                kind, found, end = m.lastgroup, m.group(), m.end()
                if kind == "o":
                    kind, last = found, len(self.kind) - 1
                    if found == "/" and not self.ends_operand(last) and (literal := _LITERAL.match(text, at)):
                        kind, end = "r", literal.end()
                    elif found == "<" and markup and not self.ends_operand(last) and (last < 0 or self.kind[last] != "}") and _OPENS_TAG.match(text, at) and not _TYPE_PARAMETERS.match(text, at):
                        kind = "x"
                    if kind in ("(", "[", "{"):
                        stack.append((kind, self._put(kind, at, end)))
                        regions[-1][kind] += 1
                    elif kind == "`":
                        stack.append(("`", self._put("`", at, end)))
                    elif kind == "x":
                        stack.append(("tag", self._put("x", at, end)))
                    elif kind in _CLOSES and regions[-1][_CLOSES[kind]]:
                        self._put(kind, at, end, close(_CLOSES[kind]))
                    elif kind == "}" and len(regions) > 1:
                        while stack[-1][0] != "$":
                            stack.pop()
                        regions.pop()
                        self._put("e", at, end, stack.pop()[1])
                    else:
                        self._put(kind, at, end)
                elif kind != "skip":
                    self._put(kind, at, end)
                at = end

    def _pair_types(self) -> None:
        """Partners of ``<`` and ``>`` that may enclose type arguments."""
        levels: list[list[int]] = [[]]
        for k, kind in enumerate(self.kind):
            if kind == "<":
                levels[-1].append(k)
            elif kind == ">":
                if levels[-1]:
                    low = levels[-1].pop()
                    self.mate[k], self.mate[low] = low, k
            elif kind in ("(", "[", "{"):
                levels.append([])
            elif kind in (")", "]", "}"):
                if len(levels) > 1:
                    levels.pop()
            elif kind not in _IN_TYPES:
                levels[-1].clear()

    def before(self, k: int) -> int:
        """The token before an argument list: type arguments and an optional mark are passed over."""
        k -= 1
        if k >= 0 and self.kind[k] == ">" and self.mate[k] >= 0:
            k = self.mate[k] - 1
        if k >= 0 and self.kind[k] == "?.":
            k -= 1
        return k

    def _find_heads(self) -> None:
        """For each token that ends an operand, where the operand starts, and whether it has an argument list."""
        n = len(self.kind)
        self.head, self.called = list(range(n)), [False] * n
        for k, kind in enumerate(self.kind):
            back = -1
            if kind == "i":
                if k > 1 and self.kind[k - 1] in (".", "?."):
                    back = k - 2
            elif kind == "!" and k and self.ends_operand(k - 1):
                back = k - 1
            elif kind in (")", "]", "t", "X") and self.mate[k] >= 0:
                self.head[k] = self.mate[k]
                j = self.before(self.mate[k]) if kind == ")" else self.mate[k] - 1
                if kind != "X" and j >= 0 and (self.ends_operand(j) or self.kind[j] == "!"):
                    back = j
                    self.called[k] = kind == ")"
            if back >= 0 and (self.ends_operand(back) or self.kind[back] == "!" or self.kind[back] == "i"):
                self.head[k] = self.head[back]
                self.called[k] |= self.called[back]


def _method(tokens: Tokens, first: int, stop: int) -> str | None:
    """The value of ``method`` among the entries of an object that starts at a token."""
    if first >= stop or tokens.kind[first] != "{":
        return None
    k, key = first + 1, True
    while k < stop and k != tokens.mate[first]:
        if key and tokens.kind[k] in ("i", "s") and tokens.kind[k + 1 : k + 2] == [":"]:
            name = tokens.text[tokens.start[k] : tokens.end[k]].strip("'\"")
            if name.lower() == "method" and tokens.kind[k + 2 : k + 3] and tokens.kind[k + 2] in ("i", "s") and tokens.kind[k + 3 : k + 4] in ([","], ["}"]):
                return tokens.text[tokens.start[k + 2] : tokens.end[k + 2]].strip("'\"")
        key = tokens.kind[k] == ","
        k = max(tokens.mate[k], k) + 1 if tokens.kind[k] in ("(", "[", "{", "`", "x") else k + 1
    return None


def client_calls(text: str, markup: bool = True) -> Iterator[tuple[int, str, str, list[str], bool, str, str | None]]:
    """(line, raw URL, normal path, parameters, is a template, verb, method of the options) of each call, in the order of the text."""
    tokens = Tokens(text, markup)
    kinds, n = tokens.kind, len(tokens.kind)
    breaks = [m.start() for m in re.finditer("\n", text)]
    for k in range(1, n - 1):
        if kinds[k] != "(":
            continue
        name = tokens.before(k)
        if name < 0 or kinds[name] != "i":
            continue
        word = text[tokens.start[name] : tokens.end[name]].lower()
        member = name > 0 and kinds[name - 1] in (".", "?.")
        if not (word in VERBS or word == "request" if member else word in CALLEES):
            continue
        head = tokens.head[name]
        lead = text[tokens.start[head - 1] : tokens.end[head - 1]] if head and kinds[head - 1] == "i" else ""
        if lead == "function" or lead == "new" and not tokens.called[name]:
            continue
        first, last = k + 1, k + 1
        if kinds[first] == "`":
            last = tokens.mate[first]
        elif kinds[first] != "s":
            continue
        after = kinds[last + 1] if 0 <= last < n - 1 else ""
        if last < 0 or after not in (",", ")") and (tokens.mate[k] >= 0 or after not in ("", "i", ";", "}")):
            continue
        raw = text[tokens.end[first] : tokens.start[last]] if last > first else text[tokens.start[first] + 1 : tokens.end[first] - 1]
        if last == first and "/" not in raw and "http" not in raw:
            continue
        params: list[str] = []
        path, at = [], tokens.end[first]
        j = first + 1
        while j < last:  # the expressions of this template itself
            if kinds[j] == "$":
                inner = text[tokens.end[j] : tokens.start[tokens.mate[j]]].strip()
                path += [text[at : tokens.start[j]], "{", inner, "}"]
                params.append(inner)
                at, j = tokens.end[tokens.mate[j]], tokens.mate[j]
            j += 1
        path.append(text[at : tokens.start[last]])
        stop = tokens.mate[k] if tokens.mate[k] >= 0 else n
        option = _method(tokens, last + 2, stop) if after == "," and (not member or word == "request") else None
        yield bisect_right(breaks, tokens.start[head]) + 1, raw, "".join(path) if last > first else raw, params, last > first, word if member and word != "request" else "", option
