"""Assignment-aware lexing: from source and configuration syntax to name-literal pairs.

A text is read once, from left to right, as tokens that most languages share: names, quoted strings
of all sorts, comments, brackets and operators. What gives a value to a name becomes a pair:
`name = value`, `name: value`, `"name": value`, `["name"] = value`, keyword arguments, call arguments
(`set_password("..")`, `getenv("NAME", "..")`), YAML block scalars, XML elements and attributes,
`${NAME:-value}` and command-line options.

A value is an expression of literals and names. Constants are not evaluated: an expression holds its
literals' places and references to other expressions, and what it may be is summed up from them, so
a constant that is built from itself again and again costs no more than its text. References follow
scopes (functions and classes by braces or indentation) and fall back to a later definition.
Comments and the insides of strings are read too, as scopes of their own.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""(?P<n>\n)
    |(?P<t>(?:\b[rbufRBUF]{1,2})?(?:\"\"\"|'''))
    |(?P<s>(?<![\\])(?:\b[rbufRBUF]{1,2})?(?:\"(?:[^\"\\\n]|\\.)*\"|(?<![A-Za-z0-9_])'(?:[^'\\\n]|\\.)*')|(?:\b[rbufRBUF]{1,2})'(?:[^'\\\n]|\\.)*')
    |(?P<g>`[^`]*`)
    |(?P<k>/\*|<!--)
    |(?P<c>(?<![^\s])\#[^\n]*|(?<![:\w])//[^\n]*|(?<![^\n]);[^\n]*)
    |(?P<e>\$\{)
    |(?P<d>(?<![\w-])--?(?=[A-Za-z]))
    |(?P<i>[A-Za-z_$][\w$]*(?:(?:\.|->|::|-)[A-Za-z_$][\w$]*)*)
    |(?P<o>=>|:=|===?|!==?|[<>]=|\?\?=?|\+=|[:=])
    |(?P<b>[(){}\[\],;])""",
    re.VERBOSE | re.ASCII,
)
STRING = re.compile(r"""(?P<f>[rbufRBUF]{0,2})(?:(?P<t>\"\"\"|''')|(?P<q>["'])(?P<text>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q)|(?P<g>`)(?P<gtext>[^`]*)`)""")
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""")
NAME = re.compile(r"[A-Za-z_$][\w$]*(?:(?:\.|->|::|-)[A-Za-z_$][\w$]*)*", re.ASCII)
BLANK, ANY_BLANK = re.compile(r"(?:[ \t\r]|\\\r?\n)*"), re.compile(r"(?:\s|\\\n)*")
JOIN = re.compile(r"\+|\.\.|&(?!&)|\|\||\?\?|or\b|(?<=\s)\.(?=\s)|<<")
PAIRED = re.compile("[:=]")
PLUS, INDENT = re.compile(r"[ \t]*\+"), re.compile(r"[ \t]*(?:-[ \t]+)*")
METHOD = re.compile(r"\.[A-Za-z_]\w*\s*\(", re.ASCII)
BLOCK = re.compile(r"[ \t]*[|>][+-]?\d?[+-]?[ \t]*(?:#[^\n]*)?\n")
INSERTED = re.compile(r"\$?\{([A-Za-z_$][\w$.]*)[^{}\"']*\}")
DEFAULT = re.compile(r"([A-Za-z_]\w*):?[-=]([^{}\s\"']*)\}", re.ASCII)
TAG = re.compile(r"<([A-Za-z_][\w.:-]*)([^<>]*)>", re.ASCII)
ATTRIBUTE = re.compile(r"""([A-Za-z_][\w.:-]*)\s*=\s*(?:"([^"]*)"|'([^']*)')""", re.ASCII)

#: Words that begin a definition with a scope of its own, or a block without one; types that stand between a name and its value; functions whose first argument is the name of something, not its value; words before a credential.
HEADS = {"def", "class", "function", "func", "fn", "sub", "struct", "interface", "impl", "module", "namespace", "object"}
CONTROL = {"if", "for", "while", "switch", "catch", "else", "try", "do", "elif", "with", "match", "finally", "foreach"}
TYPES = {"str", "string", "String", "char", "text", "bytes", "object", "auto", "varchar", "any", "Optional"}
LOOKUP = re.compile(r"get|env|input|prompt|read|load|fetch|find|lookup|config|request|param|query|select|vault|type|name|len|print|log|format|info|warn|error|assert|test", re.IGNORECASE)
LABELS = {"name", "key", "id"}
SCHEMES = {"bearer", "basic", "token", "apikey", "digest"}


class Scope:
    """Definitions by name: places in ascending order, and the expression made at each.

    Scopes that lie in one another are numbered in the order in which they open, so a scope encloses
    those whose numbers lie between its own and its last one's. The outermost scope knows, for each
    name, the scopes that define it and which of those encloses which; a lookup is one bisection
    there, whatever lies between. Lookups begin when all is read.
    """

    def __init__(self, parent: Scope | None):
        self.parent = parent
        self.root: Scope = parent.root if parent else self
        if not parent:
            self.inside: list[Scope] = []
            self.definers: dict[str, list[Scope]] = {}
            self.ordered: dict[str, tuple[list[int], list[Scope], list[int]]] = {}
        self.number = self.last = len(self.root.inside)
        self.root.inside.append(self)
        self.names: dict[str, tuple[list[int], list[Expression]]] = {}

    def define(self, name: str, at: int, value: Expression) -> None:
        if name not in self.names:
            self.names[name] = ([], [])
            self.root.definers.setdefault(name, []).append(self)
        places, values = self.names[name]
        places.append(at)
        values.append(value)

    def defining(self, name: str) -> tuple[list[int], list[Scope], list[int]]:
        """Of the outermost scope: numbers of the scopes that define the name, those, and for each the place of the next one around it, or -1."""
        if not self.ordered:
            for s in reversed(self.inside):
                if s.parent:
                    s.parent.last = max(s.parent.last, s.last)
        if name not in self.ordered:
            scopes = sorted(self.definers.get(name, ()), key=lambda s: s.number)
            around, open_ = [], []
            for k, s in enumerate(scopes):
                while open_ and scopes[open_[-1]].last < s.number:
                    open_.pop()
                around.append(open_[-1] if open_ else -1)
                open_.append(k)
            self.ordered[name] = ([s.number for s in scopes], scopes, around)
        return self.ordered[name]

    def find(self, name: str, at: int) -> Expression | None:
        """The last definition before `at` in the nearest scope that has one, else the nearest later one."""
        numbers, scopes, around = self.root.defining(name)
        k, later = bisect.bisect_right(numbers, self.number) - 1, None
        while k >= 0 and scopes[k].last < self.number:
            k = around[k]
        while k >= 0:
            places, values = scopes[k].names[name]
            n = bisect.bisect_left(places, at)
            if n:
                return values[n - 1]
            later = later or values[0]
            k = around[k]
        return later


@dataclass(eq=False)
class Expression:
    """Places of literals, and references (name, place, bare literal if the name stands for itself)."""

    scope: Scope
    leaves: list[tuple[int, int]] = field(default_factory=list)
    refs: list[tuple[str, int, tuple[int, int] | None]] = field(default_factory=list)

    def parts(self) -> tuple[list[tuple[int, int, bool]], list[Expression]]:
        """Literals (start, end, whether quoted) and the expressions that the references lead to."""
        own, others = [(i, j, True) for i, j in self.leaves], []
        for name, at, bare in self.refs:
            found = self.scope.find(name, at)
            if found is not None:
                others.append(found)
            elif bare:
                own.append((*bare, False))
        return own, others


class Lexer:
    """Reads a text; `pairs` then holds (name, expression) in the order of the text."""

    def __init__(self, text: str, worth):
        """worth: tells whether a piece of text, such as a string's inside, is worth reading."""
        self.text, self.worth = text, worth
        self.pairs: list[tuple[str, Expression]] = []
        self.closed: dict[str, int] = {}
        self.region(0, len(text), True)
        self.elements()

    def closing(self, mark: str, at: int) -> int:
        """Place of the next mark; -1 if there is none, which is looked up once only."""
        known = self.closed.get(mark)
        if known is None or 0 <= known < at:
            known = self.closed[mark] = self.text.find(mark, at)
        return known

    def pair(self, name: str, value: Expression, at: int, define: bool = True) -> None:
        if value.leaves or value.refs:
            self.pairs.append((name, value))
        if define:
            value.scope.define(name, at, value)
            last = re.split(r"\.|->|::", name)[-1]
            if last != name and name.startswith(("self.", "this.", "$this->", "@")):
                value.scope.define(last, at, value)

    def region(self, lo: int, hi: int, code: bool) -> None:
        """Reads text[lo:hi] in a scope of its own; code: comments count, as they don't inside strings and comments."""
        text, at = self.text, lo
        scope = Scope(None)
        blocks: list[tuple[str, Scope, int]] = []  # what ends the block, the scope around it, its indentation
        calls: list[str | None] = []  # open brackets: a call's function, else None
        name, before, name_end = None, None, lo  # the last name, the one before it, and where the last ended
        head = control = arrow = False
        params: list[str] = []
        start = lo  # of the line
        first = False  # the next token is a call's first argument
        labelled: str | None = None  # what the pair before said to be a name
        dashed = False
        while m := TOKEN.search(text, at, hi):
            kind, i, at = m.lastgroup, m.start(), m.end()
            was_first, first = first, False
            if kind == "n":
                while at < hi and text[at] in "\n\r":
                    at += 1
                start = at
                own = self.indent(at) if at < hi else 0
                while blocks and blocks[-1][0] == "dedent" and own <= blocks[-1][2] and at < hi:
                    scope = blocks.pop()[1]
                if not calls and text[at + own : at + own + 1] != "{":
                    head = control = False
                name = None
            elif kind in ("c", "k"):
                end = at
                if kind == "k":
                    close = self.closing("*/" if m[0] == "/*" else "-->", at)
                    end = at = min(hi, close + len(m[0])) if close >= 0 else at
                if code and end > m.start() + 2:
                    if self.worth(i, end):
                        self.region(i + 1 if kind == "c" else i + 2, end, False)
                elif not code and kind == "c":
                    at = i + 1
                name = None
            elif kind in ("t", "s", "g"):
                body, at = self.string(i, hi, m)
                if body is None:
                    continue
                a, b, inserts = body
                if name is not None and kind == "s" and not calls and name_end <= i and text[name_end:i].strip(" \t") == "" and name_end < i and self.worth(*self.name_place):
                    value = Expression(scope, self.pieces(a, b, inserts), inserts)
                    self.pair(name, value, i, False)
                    name = None
                    continue
                if code and b > a and self.worth(a, b) and PAIRED.search(text, a, b):
                    self.region(a, b, False)
                following = BLANK.match(text, at, hi).end()
                if was_first and calls and calls[-1] and text[following : following + 1] == "," and self.worth(a, b):
                    value, at = self.expression(following + 1, hi, scope, 1)
                    self.pair(text[a:b], value, i, False)
                    name = None
                    continue
                before, name, name_end, self.name_place = None, text[a:b], at, (a, b)
            elif kind == "e":
                if d := DEFAULT.match(text, at, hi):
                    self.pair(d[1], Expression(scope, [], [("", d.start(), d.span(2))]), i, False)
                    at = d.end()
            elif kind == "d":
                dashed = True
                continue
            elif kind == "i":
                before, name, name_end, self.name_place = name, m[0], at, m.span()
                if name in HEADS:
                    head, params, self.head_line = True, [], start
                elif name in CONTROL:
                    control = True
                elif calls and (head or calls[-1] is None):
                    params.append(name)
                if dashed:  # an option and its value
                    word = BARE.match(text, min(at + 1, hi), hi) if text[at : at + 1] == " " else None
                    if word and word[0][0] not in "-=:" and self.worth(*m.span()):
                        self.pair(name, Expression(scope, [], [("", word.start(), word.span())]), i, False)
                dashed = False
                after = BLANK.match(text, at, hi).end()
                if text[after : after + 1] == "(" and not head:
                    calls.append(name)
                    first = True
                    at = after + 1
                    if self.worth(*m.span()) and not LOOKUP.search(name):
                        value, at = self.expression(at, hi, scope, 1)
                        self.pair(name, value, i, False)
                        if text[at - 1] == ")":
                            calls.pop()
                continue
            elif kind == "o":
                if m[0] == "=>":
                    arrow = True
                if m[0] == ":" and head and self.ends_line(at, hi):
                    name = None
                    blocks.append(("dedent", scope, self.indent(self.head_line)))
                    scope = self.inner(scope, params, i)
                    head, params = False, []
                    continue
                if name is None or m[0] in ("<=", ">=", "!=", "!=="):
                    if m[0] == "=>":
                        continue
                    name = None
                    continue
                if text[name_end:i].strip(" \t\r?!]"):
                    name = None
                    continue
                if name in TYPES and before and m[0] == "=":
                    name = before
                if m[0] == "=" and params and params[-1] == name:
                    params.pop()
                if m[0] == ":" and (b := BLOCK.match(text, at, hi)):
                    value, at = self.block(b.end(), hi, self.indent(start), scope)
                    start = at
                    self.pair(name, value, at)
                    name = None
                    continue
                value, at = self.expression(at, hi, scope, 0)
                if m[0] == ":" and len(value.refs) == 1 and not value.leaves:
                    blank = BLANK.match(text, at, hi).end()
                    if text[blank : blank + 1] == "=" and text[blank + 1 : blank + 2] != "=":  # a type stood between
                        value, at = self.expression(blank + 1, hi, scope, 0)
                self.pair(name, value, at, not m[0].startswith("=="))
                # a list of names and values: the value belongs to the name said just before
                if labelled and name.lower() == "value":
                    self.pair(labelled, value, at, False)
                said = self.word_of(value) if name.lower() in LABELS else None
                labelled = text[slice(*said)] if said else None
                name = None
            elif kind == "b":
                if m[0] in "([":
                    if not calls:
                        params = []
                    calls.append(None)
                    if m[0] == "(":
                        first = True
                    continue
                if m[0] in ")]":
                    if calls:
                        calls.pop()
                    if m[0] == "]":
                        name_end = at
                        continue
                    name = None
                    continue
                if m[0] == "{":
                    own = head or arrow or (not control and self.follows_bracket(lo, i))
                    blocks.append(("}", scope, 0))
                    if own:
                        scope = self.inner(scope, params, i)
                    head = control = arrow = False
                    params = []
                elif m[0] == "}":
                    while blocks and blocks[-1][0] != "}":
                        scope = blocks.pop()[1]
                    if blocks:
                        scope = blocks.pop()[1]
                elif m[0] == ";":
                    head = control = arrow = False
                elif m[0] == "," and not calls:
                    arrow = False
                name = None
            dashed = False

    @staticmethod
    def inner(scope: Scope, params: list[str], at: int) -> Scope:
        made = Scope(scope)
        for p in params:
            made.define(p, at, Expression(made))
        return made

    @staticmethod
    def word_of(value: Expression) -> tuple[int, int] | None:
        """Where the value stands, if it is one literal or bare word."""
        places = value.leaves + [bare for _, _, bare in value.refs if bare]
        return places[0] if len(places) == 1 and len(value.refs) + len(value.leaves) == 1 else None

    def follows_bracket(self, lo: int, at: int) -> bool:
        """Whether a closing bracket is the last before `at` but blanks; a run of blanks lies before one place only."""
        while at > lo and self.text[at - 1].isspace():
            at -= 1
        return at > lo and self.text[at - 1] == ")"

    def indent(self, at: int) -> int:
        return INDENT.match(self.text, at).end() - at

    def ends_line(self, at: int, hi: int) -> bool:
        end = BLANK.match(self.text, at, hi).end()
        return end >= hi or self.text[end] in "\n#"

    def string(self, i: int, hi: int, m: re.Match | None = None):
        """((start, end, references) of a string's inside, its end); (None, place to go on) if it isn't closed."""
        s = STRING.match(self.text, i, hi)
        if s and s["t"]:
            close = self.closing(s["t"], s.end())
            if close < 0 or close + 3 > hi:
                return None, s.end()
            a, b, end = s.end(), close, close + 3
        elif s and s["g"]:
            a, b, end = *s.span("gtext"), s.end()
        elif s:
            a, b, end = *s.span("text"), s.end()
        else:
            return None, (m.end() if m else i + 1)
        inserts = []
        if s["g"] or "f" in s["f"].lower() or "${" in self.text[a:b]:
            inserts = [(x[1], i, None) for x in INSERTED.finditer(self.text, a, b)]
        return (a, b, inserts), end

    def pieces(self, a: int, b: int, inserts: list) -> list[tuple[int, int]]:
        """What a string holds besides the names that are put into it."""
        if not inserts:
            return [(a, b)] if b > a else []
        edges = [a, *(x for m in INSERTED.finditer(self.text, a, b) for x in m.span()), b]
        return [(i, j) for i, j in zip(edges[::2], edges[1::2], strict=True) if j > i]

    def block(self, at: int, hi: int, indent: int, scope: Scope) -> tuple[Expression, int]:
        """The lines of a block scalar that have no blanks inside, and where it ends."""
        value = Expression(scope)
        while at < hi:
            end = self.text.find("\n", at, hi)
            end = hi if end < 0 else end
            line = self.text[at:end]
            if line.strip():
                if len(line) - len(line.lstrip(" \t")) <= indent:
                    break
                if len(line.split()) == 1:
                    a = at + len(line) - len(line.lstrip())
                    value.leaves.append((a, a + len(line.strip())))
            at = min(hi, end + 1)
        return value, at

    def expression(self, at: int, hi: int, scope: Scope, depth: int) -> tuple[Expression, int]:
        """An expression from `at` on, inside `depth` brackets, and where it ends."""
        text, value = self.text, Expression(scope)
        skip_first = False
        while True:  # an operand
            place = (ANY_BLANK if depth else BLANK).match(text, at, hi).end()
            if place >= hi:
                return value, hi
            if depth and (m := TOKEN.match(text, place, hi)) and m.lastgroup == "c":
                at = m.end()
                continue
            c = text[place]
            if c in "([":
                depth, at = depth + 1, place + 1
                continue
            if c in ")]":
                if not depth:
                    return value, at
                at = place
            elif (s := STRING.match(text, place, hi)) and (found := self.string(place, hi))[0]:
                (a, b, inserts), at = found
                after = ANY_BLANK.match(text, at, hi).end() if depth else at
                if depth and text[after : after + 1] in (":", "=") and text[after : after + 2] != "==":
                    return value, place  # another pair
                if self.worth(a, b) and PAIRED.search(text, a, b):
                    self.region(a, b, False)
                if not skip_first:
                    value.leaves += self.pieces(a, b, inserts)
                    value.refs += inserts
                elif text[after : after + 1] == "," and self.worth(a, b):
                    self.pairs.append((text[a:b], value))  # the name of something, and what it is if there is none
                skip_first = False
            elif s:
                return value, max(at, place)
            elif text.startswith("${", place):
                return value, place
            else:
                m = NAME.match(text, place, hi)
                after = (ANY_BLANK if depth else BLANK).match(text, m.end(), hi).end() if m else place
                if m and text[after : after + 1] == "(":
                    depth, at, skip_first = depth + 1, after + 1, bool(LOOKUP.search(m[0]))
                    continue
                if m and depth and text[after : after + 1] in ("=", ":") and text[after : after + 2] != "==":
                    return value, place
                bare = BARE.match(text, place, hi)
                if not bare:
                    return value, max(at, place)
                if depth or value.leaves or value.refs:
                    if not m:
                        return value, place
                    value.refs.append((m[0], place, None))
                    at = m.end()
                else:
                    word = bare[0].rstrip(".:")
                    if word.lower() in SCHEMES and (more := BARE.match(text, BLANK.match(text, bare.end(), hi).end(), hi)):
                        value.refs.append(("", place, more.span()))
                        return value, more.end()
                    name = m[0] if m and m.end() == place + len(word) else ""
                    if m and PLUS.match(text, m.end(), hi) and not word[m.end() - place :].strip("+"):
                        name = word = m[0]
                    value.refs.append((name, place, (place, place + len(word)) if word else None))
                    at = place + max(1, len(word))
                    if not name:
                        return value, at
            while True:  # what joins it to another
                place = (ANY_BLANK if depth else BLANK).match(text, at, hi).end()
                if depth and place < hi and text[place] in ")]":
                    depth, at, skip_first = depth - 1, place + 1, False
                    continue
                if m := METHOD.match(text, place, hi):
                    depth, at = depth + 1, m.end()
                    if text[at : at + 1] == ")":
                        depth, at = depth - 1, at + 1
                        continue
                    break
                if m := JOIN.match(text, place, hi):
                    at = ANY_BLANK.match(text, m.end(), hi).end()
                    break
                line_end = ANY_BLANK.match(text, at, hi).end()
                if text[line_end : line_end + 2] in ("+ ", '+"', "+'") or text[line_end : line_end + 3] == ".. ":
                    at = ANY_BLANK.match(text, line_end + (2 if text[line_end] == "." else 1), hi).end()
                    break
                if depth and text[place : place + 1] == ",":
                    at = place + 1
                    break
                if text[place : place + 1] in ('"', "'") and value.leaves:
                    break
                return value, at

    def elements(self) -> None:
        """Pairs of XML elements: what stands between a tag and its end, and attributes that name each other's value."""
        text, scope = self.text, Scope(None)
        for m in TAG.finditer(text):
            if not self.worth(*m.span()):
                continue
            attributes = {a[1].lower(): a for a in ATTRIBUTE.finditer(m[2])} if m[2] else {}
            said = next((a[2] or a[3] or "" for k in ("name", "key", "id") if (a := attributes.get(k))), "")
            name = said or m[1]
            if said and (a := attributes.get("value")):
                g = 2 if a[2] is not None else 3
                self.pair(name, Expression(scope, [(m.start(2) + a.start(g), m.start(2) + a.end(g))]), m.start(), False)
            end = text.find("<", m.end())
            if end < 0:
                continue
            lo, close = m.end(), f"</{m[1]}"
            if text.startswith("<![CDATA[", end):
                lo, end = end + 9, text.find("]]>", end)
                if end < 0:
                    continue
                tail = end + 3
            else:
                tail = end
            if text.startswith(close, tail):
                body = text[lo:end]
                a = lo + len(body) - len(body.lstrip())
                if body.strip():
                    self.pair(name, Expression(scope, [(a, a + len(body.strip()))]), m.start(), False)
