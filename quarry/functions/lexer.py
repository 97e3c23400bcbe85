"""A linear lexer for sources, and the definitions, literals and occurrences that follow from its tokens.

One pass over a source, with a stack of open brackets on which the substitutions of template
strings lie as well: so code inside ``${...}`` is code, and a brace in a string or comment is not a
brace.  Every bracket knows its partner, so nested ranges need no second pass.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

# Languages by extension.
SCRIPT = {".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts"}
TYPED = {".ts", ".tsx", ".mts", ".cts"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
COMMENT, STRING, WORD, OTHER = "comment", "string", "word", "other"
_C_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTED = r"'(?:[^'\\\n]|\\.)*'?|\"(?:[^\"\\\n]|\\.)*\"?"
_IDENTIFIER = r"\#?[A-Za-z_$\u0080-\uffff][\w$]*"
_SYMBOL = r"=>|\d[\w.]*|[^\w\s]"


def _rules(comment: str, string: str, word: str = _IDENTIFIER) -> re.Pattern:
    return re.compile(rf"(?P<{COMMENT}>{comment})|(?P<{STRING}>{string})|(?P<{WORD}>{word})|(?P<{OTHER}>{_SYMBOL})", re.S)


_SCRIPT_RULES = _rules(_C_COMMENT, _QUOTED)
_GO_RULES = _rules(_C_COMMENT, _QUOTED + r"|`[^`]*`?")
_PYTHON_RULES = _rules(r"\#[^\n]*", r"[rRbBfFuU]{0,2}(?:'''(?:[^\\]|\\.)*?(?:'''|\Z)|\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|" + _QUOTED + ")")
_CSS_RULES = _rules(r"/\*.*?(?:\*/|\Z)", _QUOTED, r"[@\w-][\w-]*")
_JSON_RULES = _rules(r"(?!)", _QUOTED)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_PARTNER = {")": "(", "]": "[", "}": "{"}
# Words after which an expression begins, so that a slash begins a pattern.
_BEFORE_EXPRESSION = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    depth: int = 0
    mate: int = -1  # the number of the partner of a bracket


def tokens(code: str, ext: str) -> list[Token]:
    """Tokens in order; blanks belong to none.  Unpaired brackets have no partner."""
    rules = _SCRIPT_RULES if ext in SCRIPT else {".go": _GO_RULES, ".py": _PYTHON_RULES, ".css": _CSS_RULES, ".json": _JSON_RULES}.get(ext, _SCRIPT_RULES)
    out: list[Token] = []
    open_: list[int] = []  # numbers of open brackets; of "${" too
    before: Token | None = None  # the last token that is no comment
    at = 0

    def template(start: int, at: int) -> int:
        """A piece of a template string: up to its end, or through the next ``${``."""
        end = _TEMPLATE.match(code, at).end()
        goes_on = code.startswith("${", end)
        end += 2 if goes_on else 1
        out.append(Token(STRING, code[start:end], start, min(end, len(code)), len(open_)))
        if goes_on:
            open_.append(len(out) - 1)
        return end

    while m := rules.search(code, at):
        kind, text, start, at = m.lastgroup, m[0], m.start(), m.end()
        if text == "`" and rules is _SCRIPT_RULES:
            at = template(start, at)
            before = out[-1]
            continue
        if text == "}" and open_ and out[open_[-1]].kind == STRING:
            n = open_.pop()
            at = template(start, at)
            before = out[-1]
            out[n].mate = len(out) - 1
            continue
        if text == "/" and rules is _SCRIPT_RULES and (before is None or (before.text in _BEFORE_EXPRESSION if before.kind == WORD else before.kind == OTHER and before.text not in (")", "]", "}") and not before.text[0].isdigit())):
            if found := _REGEX.match(code, start):
                kind, text, at = STRING, found[0], found.end()
        token = Token(kind, text, start, at, len(open_))
        out.append(token)
        if kind == OTHER:
            if text in ("(", "[", "{"):
                open_.append(len(out) - 1)
            elif text in _PARTNER:
                # A bracket that fits closes what is left open inside it; one that fits nothing is let go.
                k = len(open_) - 1
                while k >= 0 and out[open_[k]].kind == OTHER and out[open_[k]].text != _PARTNER[text]:
                    k -= 1
                if k >= 0 and out[open_[k]].kind == OTHER:
                    n = open_[k]
                    del open_[k:]
                    token.depth, token.mate, out[n].mate = len(open_), n, len(out) - 1
        if kind != COMMENT:
            before = token
    return out


# Scripts are read in two steps, each of which leaves most characters to one pattern: first strings, comments and
# brackets, which tell where code is, then the words and symbols of each stretch of code at once.
_BLANK = "\t\n\v\f\r\x1c\x1d\x1e\x1f "
_SPOTS = re.compile(rf"{_C_COMMENT}|{_QUOTED}|`(?:[^`\\$]|\\.|\$(?!\{{))*(?:\$\{{|.)?|[()\[\]{{}}/]", re.S)
_CODE = re.compile(rf"[\t-\r\x1c-\x1f ]+|{_IDENTIFIER}|{_SYMBOL}|.", re.S)
#: What a token begins with that is a bracket or a piece of a template.
_MARKS = set("()[]{}`")
_SINGLE = set(_BLANK + "()[]{};,")
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def _is_token(text: str) -> bool:
    """Whether a match of ``_CODE`` is a token: no blanks, and no letter that no word begins with."""
    return text[0] not in _BLANK and not (text > "\uffff" and text.isalnum())


def _is_word(text: str) -> bool:
    return bool(text) and (text[0].isalpha() or text[0] in "_$" or "\x80" <= text[0] <= "\uffff" or text[0] == "#" and len(text) > 1) and text[0] <= "\uffff"


def _pattern_may_begin(code: str, spans: list[tuple[int, int, bool]], at: int) -> bool:
    """Whether an expression begins at ``at``, by the token before it that is no comment."""
    for begin, end, comment in [*reversed(spans), (0, 0, True)] if spans else [(0, 0, True)]:
        while at > end and code[at - 1] in _BLANK:
            at -= 1
        while at > end:
            # No token goes on over a blank or a bracket.
            first = at - 1
            while first > end and code[first] not in _SINGLE and code[first - 1] not in _SINGLE:
                first -= 1
            found = [t for t in _CODE.findall(code, first, at) if _is_token(t)]
            if found:
                t = found[-1]
                return t in _BEFORE_EXPRESSION if _is_word(t) else t not in (")", "]", "}") and not t[0].isdigit()
            at = first
        if not comment:
            return False
        at = begin
    return True


def _spots(code: str) -> tuple[list[tuple[int, int, bool]], list[int], list[int], list[int]]:
    """Of a script: where strings and comments are, and whether it is a comment; for each bracket and piece of a template
    the number of its partner, its depth, and the depth after it."""
    spans: list[tuple[int, int, bool]] = []
    mates: list[int] = []
    depths: list[int] = []
    after: list[int] = []
    open_: list[tuple[int, str]] = []  # number and text of open brackets; of "${" a backtick

    def piece(start: int, end: int) -> None:
        """A piece of a template; one that ends with ``${`` opens a substitution."""
        spans.append((start, min(end, len(code)), False))
        depths.append(len(open_))
        if code.startswith("${", end - 2) and end - 2 > start - (code[start] == "}"):
            open_.append((len(mates), "`"))
        mates.append(-1)
        after.append(len(open_))

    at: int | None = 0
    level = 0  # how many are open
    while at is not None:
        begin, at = at, None
        for m in _SPOTS.finditer(code, begin):
            start = m.start()
            c = code[start]
            if c in "([{":
                depths.append(level)
                open_.append((len(mates), c))
                mates.append(-1)
                level += 1
                after.append(level)
            elif c in ")]}":
                wanted = _PARTNER[c]
                if level and open_[-1][1] == wanted:
                    n = open_.pop()[0]
                    level -= 1
                    mates[n] = len(mates)
                    mates.append(n)
                elif c == "}" and level and open_[-1][1] == "`":
                    mates[open_.pop()[0]] = len(mates)
                    end = _TEMPLATE.match(code, start + 1).end()
                    at = end + (2 if code.startswith("${", end) else 1)
                    piece(start, at)
                    level = len(open_)
                    break
                else:
                    # A bracket that fits closes what is left open inside it; one that fits nothing is let go.
                    k = level - 1
                    while k >= 0 and open_[k][1] != "`" and open_[k][1] != wanted:
                        k -= 1
                    if k >= 0 and open_[k][1] == wanted:
                        n = open_[k][0]
                        del open_[k:]
                        level = k
                        mates[n] = len(mates)
                        mates.append(n)
                    else:
                        mates.append(-1)
                depths.append(level)
                after.append(level)
            elif c == "`":
                piece(start, m.end())
                level = len(open_)
            elif c != "/":
                spans.append((start, m.end(), False))
            elif m.end() - start > 1:
                spans.append((start, m.end(), True))
            elif (found := _REGEX.match(code, start)) and _pattern_may_begin(code, spans, start):
                at = found.end()
                spans.append((start, at, False))
                break
    return spans, mates, depths, after


_LITERAL = re.compile(rf"/\*.*?(?:\*/|\Z)|{_QUOTED}", re.S)
_NO_BREAKS = re.compile(r"[^\n]+")


def _blanks(text: str) -> str:
    return _NO_BREAKS.sub(lambda m: " " * len(m[0]), text) if "\n" in text else " " * len(text)


def blank(code: str, ext: str = ".ts") -> str:
    """Strings and comments turned into blanks; every other character, code in substitutions too, keeps its line and column."""
    if ext == ".css":
        return _LITERAL.sub(lambda m: _blanks(m[0]), code)
    if ext in (".go", ".py", ".json"):
        spans = [(t.start, t.end) for t in tokens(code, ext) if t.kind in (STRING, COMMENT)]
    else:
        spans = [s[:2] for s in _spots(code)[0]]
    out, at = [], 0
    for start, end in spans:
        out += [code[at:start], _blanks(code[start:end])]
        at = end
    return "".join(out) + code[at:]


# --- definitions ----------------------------------------------------------------------

#: Words that may stand before a definition and belong to it.
_PREFIXES = {"export", "default", "async", "static", "public", "private", "protected", "readonly", "override", "get", "set", "declare"}
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "function", "return", "with", "new", "super", "typeof", "await", "else", "do"}
# After these a word stands in an expression, not at the beginning of a statement.
_IN_EXPRESSION = {"=", "(", ",", ":", "?", "=>", "[", "&", "|", "!", "+", "...", "return", "new", "extends", "implements", "abstract", "typeof", "."}
_OBJECT_AFTER = {"=", "(", ",", ":", "[", "?", "return", "|", "&"}
_GOES_ON = {"=", "=>", "+", "-", "*", "/", "%", "&", "|", "^", "?", ":", ",", ".", "<", ">", "(", "[", "!", "~"}

_GOES_ON_AT_LINE = (_GOES_ON - {"!", "~", "+", "-"}) | {"(", "["}
#: Words that a definition begins with; others are names before a bracket.
_DECLARES = {"class", "function", "interface", "type", "const", "let"}

Chunk = tuple[str, str, int, int]  # kind, name, start, end


class _Tokens:
    """The tokens of a source without its comments."""

    def __init__(self, code: str, ext: str):
        self.code = code
        every = tokens(code, ext)
        kept = [n for n, t in enumerate(every) if t.kind != COMMENT]
        number = {n: k for k, n in enumerate(kept)}
        self.t = [every[n] for n in kept]
        #: For each token the bracket around it, or -1.
        self.around: list[int] = []
        open_: list[int] = []
        for k, x in enumerate(self.t):
            x.mate = number.get(x.mate, -1)
            if open_ and self.t[open_[-1]].mate == k:
                open_.pop()
            self.around.append(open_[-1] if open_ else -1)
            if x.mate > k:
                open_.append(k)

    def text(self, k: int) -> str:
        return self.t[k].text if 0 <= k < len(self.t) else ""

    def is_word(self, k: int) -> bool:
        return 0 <= k < len(self.t) and self.t[k].kind == WORD

    def after(self, k: int) -> int:
        """The place after the bracket at ``k`` and its partner."""
        return self.t[k].mate + 1 if self.t[k].mate > k else len(self.t)

    def end(self, k: int) -> int:
        """Where the text of the bracket at ``k`` ends, or the whole text if it is left open."""
        return self.t[self.t[k].mate].end if self.t[k].mate > k else len(self.code)

    def new_line(self, k: int) -> bool:
        return k > 0 and "\n" in self.code[self.t[k - 1].end : self.t[k].start]


class _Script:
    """Definitions of TypeScript and JavaScript, from the texts, places and partners of its tokens without comments."""

    def __init__(self, code: str, ext: str):
        self.code, self.typed = code, ext in TYPED
        spans, mates, depths, after = _spots(code)
        found: list[str] = []
        at = 0
        for start, end, comment in spans:
            found += _CODE.findall(code, at, start)
            found.append(" " * (end - start) if comment else code[start:end])
            at = end
        found += _CODE.findall(code, at)
        starts = list(itertools.accumulate(map(len, found), initial=0))
        kept = [k for k, t in enumerate(found) if t > " " and t[0] not in _BLANK]
        if not code.isascii() and _ASTRAL.search(code):
            literal = {s[0] for s in spans}
            kept = [k for k in kept if starts[k] in literal or _is_token(found[k])]
        texts = [found[k] for k in kept]
        self.n = len(texts)
        self.start = [starts[k] for k in kept]
        #: With empty texts behind the last one, so a place before the first or after the last has one.
        self.texts = texts + [""] * 8
        marks = [k for k, t in enumerate(texts) if t[0] in _MARKS]
        mate = [-1] * self.n
        depth: list[int] = []
        #: For each token the bracket around it, or -1.
        around: list[int] = []
        open_: list[int] = []
        level, inner, done, closes = 0, -1, 0, -1
        for k, m, own, later in zip(marks, mates, depths, after, strict=True):
            if k > done:
                depth += [level] * (k - done)
                around += [inner] * (k - done)
            if k == closes:
                open_.pop()
                inner = open_[-1] if open_ else -1
                closes = mate[inner] if open_ else -1
            depth.append(own)
            around.append(inner)
            done, level = k + 1, later
            if m >= 0:
                mate[k] = other = marks[m]
                if other > k:
                    open_.append(k)
                    inner, closes = k, other
        self.mate, self.depth, self.around = mate, depth + [level] * (self.n - done), around + [inner] * (self.n - done)

    def text(self, k: int) -> str:
        return self.texts[k] if -8 <= k < self.n else ""

    def is_word(self, k: int) -> bool:
        return 0 <= k < self.n and _is_word(self.texts[k])

    def after(self, k: int) -> int:
        """The place after the bracket at ``k`` and its partner."""
        return self.mate[k] + 1 if self.mate[k] > k else self.n

    def end(self, k: int) -> int:
        """Where the token at ``k`` ends."""
        return self.start[k] + len(self.texts[k])

    def new_line(self, k: int) -> bool:
        return k > 0 and "\n" in self.code[self.end(k - 1) : self.start[k]]

    def after_generics(self, k: int) -> int:
        depth = 0
        while k < self.n and self.text(k) == "<" or depth:
            x = self.text(k)
            depth += (x == "<") - (x == ">")
            k = self.after(k) if x in ("(", "[", "{") else k + 1
            if not depth or k >= self.n:
                break
        return k

    def body(self, k: int) -> int:
        """The brace that opens the body after parameters that begin at ``k``, or -1."""
        k = self.after_generics(k)
        if self.text(k) != "(":
            return -1
        k = self.after(k)
        typed = self.text(k) == ":"
        while k < self.n:
            x = self.text(k)
            if x == "{" and not (typed and self.text(k - 1) in (":", "|", "&", "<", ",", "=>")):
                return k
            if x in (";", "}", ")", ",", "=") or not typed:
                return -1
            k = self.after(k) if x in ("{", "(", "[") else k + 1
        return -1

    def first(self, k: int) -> int:
        """Where the words before the definition at ``k`` begin."""
        while k and self.text(k - 1) in _PREFIXES or self.text(k - 1) == "*" and self.text(k - 2) in ("{", "}", ";", "async"):
            k -= 1
        return k

    def is_statement(self, k: int) -> bool:
        return k == 0 or self.text(k - 1) not in _IN_EXPRESSION

    def statement_end(self, k: int) -> int:
        """The last token of the declaration at ``k``: up to a semicolon, or a line end after which no expression goes on."""
        depth, last = self.depth[k], k
        while k < self.n:
            text, own = self.texts[k], self.depth[k]
            if own < depth or text == "}" and own == depth:
                return last
            if own == depth and text == ";":
                return k
            if k > last and text not in _GOES_ON_AT_LINE and self.text(last) not in _GOES_ON and "\n" in self.code[self.end(last) : self.start[k]]:
                return last
            nxt = self.after(k) if self.mate[k] > k else k + 1
            last, k = nxt - 1, nxt
        return self.n - 1

    def is_function(self, k: int) -> bool:
        """Whether the value that begins at ``k`` is an arrow function or a function."""
        k += self.text(k) == "async"
        if self.text(k) == "function":
            return self.text(k + 1) != "*"
        if self.is_word(k) and self.text(k + 1) == "=>":
            return True
        k = self.after_generics(k)
        if self.text(k) != "(" or self.mate[k] < 0:
            return False
        k = self.after(k)
        if self.text(k) == ":":
            depth = self.depth[k]
            while k < self.n and self.text(k) not in ("=>", ";") and self.depth[k] >= depth:
                k = self.after(k) if self.text(k) in ("{", "(", "[") else k + 1
        return self.text(k) == "=>"

    def declared(self, k: int) -> tuple[str, str, int, int] | None:
        """The let or const at ``k``: of any depth if it holds a function, else of the file alone."""
        if not self.is_word(k + 1) or not self.is_statement(k):
            return None
        depth, at = self.depth[k], k + 2
        if self.text(at) == ":":
            while at < self.n and not (self.text(at) in ("=", ";") and self.depth[at] == depth) and self.depth[at] >= depth:
                at = self.after(at) if self.mate[at] > at else at + 1
        function = self.text(at) == "=" and self.is_function(at + 1)
        if not function and depth:
            return None
        return ("func" if function else "var"), self.text(k + 1), self.first(k), self.statement_end(k)

    def chunks(self) -> Iterator[Chunk]:
        texts = self.texts
        # Braces whose members may be methods.
        members = {k for k, t in enumerate(texts) if t == "{" and texts[k - 1] in _OBJECT_AFTER}
        asked = {k for k, t in enumerate(texts) if t in _DECLARES} | {k - 1 for k, t in enumerate(texts) if k and (t == "(" or t == "<")}
        for k in sorted(asked):
            found: tuple[str, str, int, int] | None = None
            text = texts[k]
            if texts[k - 1] == "." or not _is_word(text):
                continue
            if text == "class" and self.is_word(k + 1) and self.text(k + 1) not in ("extends", "implements"):
                at = k + 2
                while at < self.n and self.text(at) not in ("{", ";"):
                    at = self.after_generics(at) if self.text(at) == "<" else self.after(at) if self.text(at) in ("(", "[") else at + 1
                if self.text(at) == "{":
                    members.add(at)
                    if self.is_statement(self.first(k)) and self.text(k - 1) != "abstract":
                        found = "class", self.text(k + 1), self.first(k), self.after(at) - 1
            elif text == "class" and self.text(k + 1) == "{":
                members.add(k + 1)
            elif text == "function" and self.is_word(k + 1) and self.is_statement(self.first(k)) and (b := self.body(k + 2)) >= 0:
                found = "func", self.text(k + 1), self.first(k), self.after(b) - 1
            elif self.typed and text == "interface" and self.is_word(k + 1) and self.is_statement(k):
                at = k + 2
                while at < self.n and self.text(at) != "{":
                    at = self.after_generics(at) if self.text(at) == "<" else at + 1
                if at < self.n:
                    found = "interface", self.text(k + 1), k, self.after(at) - 1
            elif self.typed and text == "type" and self.is_word(k + 1) and self.text(k + 2) in ("=", "<") and self.is_statement(k):
                found = "type", self.text(k + 1), k, self.statement_end(k)
            elif text in ("const", "let"):
                found = self.declared(k)
            elif text not in _NOT_NAMES and self.text(k + 1) in ("(", "<") and self.depth[k] and not self.text(k - 1) == "abstract" and (b := self.body(k + 1)) >= 0:
                begin = self.first(k)
                if self.around[k] in members and (self.text(begin - 1) in ("{", "}", ";", ",") or self.new_line(begin)):
                    found = "method", text, begin, self.after(b) - 1
            if found:
                yield found[0], found[1], self.start[found[2]], self.end(found[3])


def _python(code: str) -> Iterator[Chunk]:
    """Classes and functions: from their word to the last token that is indented deeper."""
    ts = _Tokens(code, ".py").t
    lines: list[tuple[int, int]] = []  # indent and number of the first token of each logical line
    for k, t in enumerate(ts):
        begin = code.rfind("\n", 0, t.start) + 1
        if t.depth == 0 and not code[begin : t.start].strip() and (k == 0 or ts[k - 1].end <= begin):
            lines.append((t.start - begin, k))
    open_: list[tuple[int, str, str, int]] = []
    for indent, k in [*lines, (-1, len(ts))]:
        while open_ and open_[-1][0] >= indent:
            _, kind, name, start = open_.pop()
            yield kind, name, start, ts[k - 1].end
        if k < len(ts):
            at = k + (ts[k].text == "async")
            if at + 1 < len(ts) and ts[at].text in ("def", "class"):
                open_.append((indent, "func" if ts[at].text == "def" else "class", ts[at + 1].text, ts[k].start))


def _go(code: str) -> Iterator[Chunk]:
    """Functions, methods and types of the package."""
    s = _Tokens(code, ".go")
    for k, t in enumerate(s.t):
        if t.depth or t.kind != WORD:
            continue
        if t.text == "func":
            kind, name = ("method", s.after(k + 1)) if s.text(k + 1) == "(" else ("func", k + 1)
            at = name + 1
            while at < len(s.t) and s.text(at) != "{" and not s.new_line(at):
                typed = s.text(at) in ("interface", "struct") and s.text(at + 1) == "{"
                at = s.after(at + 1) if typed else s.after(at) if s.text(at) in ("(", "[") else at + 1
            if s.text(at) == "{" and s.is_word(name):
                yield kind, s.text(name), t.start, s.end(at)
        elif t.text == "type":
            if s.text(k + 1) == "(":
                if s.is_word(k + 2):
                    yield "type", s.text(k + 2), t.start, s.end(k + 1)
            elif s.is_word(k + 1):
                at = k + 2
                while at < len(s.t) and not s.new_line(at):
                    at = s.after(at) if s.text(at) in ("(", "{", "[") else at + 1
                yield "type", s.text(k + 1), t.start, s.t[at - 1].end


def _css(code: str) -> Iterator[Chunk]:
    """Rules and at-rules, nested ones too; names without dots, hashes and commas."""
    s = _Tokens(code, ".css")
    ts, begin, steps = s.t, 0, 0  # steps: where the last keyframes end, whose steps are no rules
    for k, t in enumerate(ts):
        if t.text in (";", "}", "{"):
            head, start = ts[begin:k], ts[begin].start if begin < k else t.start
            end = s.end(k) if t.text == "{" else t.end
            name = " ".join(re.sub(r"[.#,]", " ", re.sub(r"(?s)/\*.*?\*/", " ", code[start : t.start])).split())
            word = head[0].text if head else ""
            if word == "@media" and t.text == "{":
                if head[1:2] and head[1].text == "(" and head[-1].text == ")":
                    yield "class", " ".join(code[head[1].start : t.start].split()), start, end
            elif word.endswith("keyframes") and word.startswith("@") and t.text == "{":
                yield "class", head[1].text if len(head) > 1 else "", start, end
                steps = end
            elif word == "@import":
                yield "class", next((h.text for h in head if h.kind == STRING), ""), start, end
            elif word.startswith("@") and word not in ("@charset", "@namespace", "@supports"):
                yield "class", word, start, end
            elif t.text == "{" and head and start >= steps:
                yield "class", name, start, end
            begin = k + 1


#: Characters of a style sheet that are read at once, if its rules end in them.
PART = 1 << 16
_CSS_SPOTS = re.compile(rf"/\*.*?(?:\*/|\Z)|{_QUOTED}|[()\[\]{{}}]", re.S)


def parts(code: str, ext: str) -> Iterator[str]:
    """The source in pieces that can be read one by one: style sheets are cut after rules in no other, the rest is whole."""
    begin = 0
    if ext == ".css" and len(code) > PART:
        open_: list[str] = []
        for m in _CSS_SPOTS.finditer(code):
            c = m[0]
            if c in ("(", "[", "{"):
                open_.append(c)
            elif c in _PARTNER:
                k = len(open_) - 1
                while k >= 0 and open_[k] != _PARTNER[c]:
                    k -= 1
                if "{" in open_[k + 1 :] and k >= 0:
                    break  # a rule that is left open ends with the source
                if k >= 0:
                    del open_[k:]
                if c == "}" and not open_ and m.end() - begin >= PART:
                    yield code[begin : m.end()]
                    begin = m.end()
    yield code[begin:] if begin else code


def _json(code: str) -> Iterator[Chunk]:
    """The pairs of the object that the text is, not those inside them."""
    ts = tokens(code, ".json")
    if not ts or ts[0].text != "{":
        return
    for k, t in enumerate(ts):
        if t.depth == 1 and t.kind == STRING and k + 2 < len(ts) and ts[k + 1].text == ":" and ts[k - 1].text in ("{", ","):
            first = ts[k + 2]
            end = ts[first.mate].end if first.mate > 0 else next((x.start for x in ts[k + 2 :] if x.depth <= 1 and x.text in (",", "}")), len(code))
            yield "class", re.sub(r"^[\"']|[\"']$", "", t.text).strip(), t.start, len(code[:end].rstrip()) if first.mate <= 0 else end


_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][\w:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<![^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_RAW_END = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I)}


def _html(code: str) -> Iterator[Chunk]:
    """Elements with an id or a class, one chunk for each of them; an element that is not closed ends with its parent."""
    open_: list[tuple[str, int, list[str]]] = []
    out: list[Chunk] = []

    def close(n: int, end: int) -> None:
        while len(open_) > n:
            _, start, names = open_.pop()
            out.extend(("class", name, start, end) for name in names)

    at = 0
    while m := _TAG.search(code, at):
        at = m.end()
        if m["name"] is None:
            continue
        tag = m["name"].lower()
        if m["close"]:
            n = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == tag), -1)
            if n >= 0:
                close(n + 1, m.start())
                close(n, m.end())
            continue
        if tag in _RAW_END:
            found = _RAW_END[tag].search(code, at)
            at = found.end() if found else len(code)
            continue
        names = [next(v for v in a.groups()[1:] if v is not None).strip() for a in _ATTRIBUTE.finditer(m["attrs"]) if a[1] in ("id", "class")]
        if tag in VOID or m["attrs"].endswith("/"):
            out.extend(("class", name, m.start(), at) for name in names)
        else:
            open_.append((tag, m.start(), names))
    close(0, len(code))
    yield from (c for c in out if c[1])


def chunks(code: str, ext: str, most: int | None = None) -> list[Chunk]:
    """The definitions of a source by place: kind, name, first character and the one after the last.

    A definition inside another of the same name, and one with the same range, is not listed
    twice; pages, styles and data list every name of a range.  ``most`` cuts the list.
    """
    if ext in SCRIPT:
        found = _Script(code, ext).chunks()
    else:
        of = {".py": _python, ".go": _go, ".css": _css, ".json": _json, ".html": _html}.get(ext)
        found = of(code) if of else iter(())
    web = ext in (".css", ".json", ".html")
    out: list[Chunk] = []
    seen: set[tuple] = set()
    ends: dict[str, int] = {}  # where the last listed definition of a name ends
    for kind, name, start, end in sorted(found, key=lambda c: (c[2], -c[3])):
        key = (start, end, name) if web else (start, end)
        if key in seen or not web and start < ends.get(name, -1):
            continue
        seen.add(key)
        ends[name] = max(end, ends.get(name, -1))
        out.append((kind, name, start, end))
    return out if most is None else out[:most]


def lines_of(code: str, places: list[int]) -> list[int]:
    """The lines, from 1, of places in a source."""
    breaks = [m.start() for m in re.finditer("\n", code)]
    return [bisect_right(breaks, p - 1) + 1 for p in places]


# --- occurrences ----------------------------------------------------------------------

_KEY_LANGUAGES = SCRIPT | {".py", ".go", ".json"}


_NAME = re.compile(r"(?<![\w$])[A-Za-z_$][\w$]*")


def occurrences(code: str, names: set[str], ext: str = ".ts") -> list[tuple[str, int, int, str]]:
    """(name, line, column, confidence) where any of ``names`` occurs: ``high`` where it is used as such in code.

    ``review`` where a rename may be wrong: in strings and comments, as a member after a dot, as the key or the
    shorthand of an object, and alone in a substitution of a template.
    """
    ts = tokens(code, ext)
    code_tokens = [t for t in ts if t.kind != COMMENT]
    found = []
    for t in ts:
        if t.kind in (STRING, COMMENT):
            found += [(t.start + m.start(), m[0], "review") for m in _NAME.finditer(t.text) if m[0] in names]
    objects: list[bool] = []  # for each open brace whether it is an object's
    for k, t in enumerate(code_tokens):
        before, after = code_tokens[k - 1] if k else None, code_tokens[k + 1] if k + 1 < len(code_tokens) else None
        if t.text == "{" and t.kind == OTHER:
            objects.append(before is not None and before.text in _OBJECT_AFTER)
        elif t.text == "}" and t.kind == OTHER and objects:
            objects.pop()
        if t.kind == WORD and t.text in names:
            member = before is not None and before.text == "."
            substituted = before is not None and before.kind == STRING and before.text.endswith("${") and after is not None and after.kind == STRING and after.text.startswith("}")
            in_braces = before is not None and before.text in ("{", ",") and after is not None
            key = in_braces and after.text == ":" and ext in _KEY_LANGUAGES
            short = in_braces and after.text in (",", "}") and bool(objects and objects[-1]) and ext in SCRIPT
            found.append((t.start, t.text, "review" if member or substituted or key or short else "high"))
    found.sort()
    rows = lines_of(code, [f[0] for f in found])
    return [(name, line, p - code.rfind("\n", 0, p), how) for (p, name, how), line in zip(found, rows, strict=True)]
