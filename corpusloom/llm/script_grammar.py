"""Grammar check of JavaScript and TypeScript files: yes or no, no tree.

A file becomes a line of token classes (every name is `i`, every string `s`). Innermost brackets are judged first
and replaced by a symbol that says as what they could be read (arguments, parameters, a block, an object, ...), so
each judgement sees a short line; equal lines are judged once and remembered, which is most of them in real code.

One regular expression cuts most files into tokens. Where it can't (templates in templates in templates, regular
expressions after a condition, HTML-like comments, elements of .jsx and .tsx files) a second, slower reader follows that keeps a
stack. Rules about names (twice declared, unknown labels, octal numbers in strict code, super outside a method) aren't checked.
"""

from __future__ import annotations

import re
from functools import lru_cache

# The words of the languages.
_RESERVED = "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
_CONTEXTUAL = "abstract accessor as assert asserts async await constructor declare from get global infer is keyof let module namespace of out override private protected public readonly require satisfies set static type interface unique using yield".split()
_WORDS = {*_RESERVED, *_CONTEXTUAL}
_IDENTIFIER = {"i", *_CONTEXTUAL}
_NAME = {"i", *_WORDS}
_LITERAL = {"s", "t", "0", "r", "this", "super", "null", "true", "false"}
_BINARY = {"o", "*", "-", "<", ">", "|", "&", "/", "in", "instanceof"}

_OPERATOR = r"=>|\.\.\.|\?\?=?|&&=?|\|\|=?|\*\*=?|[=!]==?|<<=|<<|<=|[-+*%&|^]=|/=(?=\s)|\?\.(?!\d)|\+\+|--|[-+*%&|^!~<>=?:;,.@{}()\[\]/]"
_REGEX = r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*"
_BEFORE_REGEX = r"(?:=>|\.\.\.|\?\?|&&|\|\||[=!]==?|<=|[-+*%&|^]=|[-+*%&|^!~<>=?:;,{(\[]|\b(?:return|typeof|case|in|of|instanceof|new|delete|void|throw|do|else|await|yield)\b)"
_STRING = r"""'(?:\\.|[^'\\\n])*+'|"(?:\\.|[^"\\\n])*+\""""
_SIMPLE = rf"""(?:[^{{}}`'"]|{_STRING}|\{{[^{{}}`]*\}})*+"""
for _ in range(3):  # templates inside templates
    _TEMPLATE = rf"`(?:\\[\s\S]|[^`\\$]|\$(?!\{{)|\$\{{{_SIMPLE}\}})*+`"
    _SIMPLE = rf"""(?:[^{{}}`'"]|{_STRING}|\{{(?:[^{{}}`]|{_TEMPLATE})*\}}|{_TEMPLATE})*+"""
_TOKEN = re.compile(
    r"[ \t\f\v\u00a0\ufeff]+|//[^\n]*|/\*(?:.|\n)*?\*/"
    rf"|{_BEFORE_REGEX}\s*{_REGEX}"
    r"|\s*\n\s*"
    r"|(?:[^\W\d]|[$\\])(?:[\w$]|\\u)*|\#(?:[^\W\d]|\$)[\w$]*"
    r"|(?:0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)(?![\w$])"
    r"|'(?:\\(?:\r\n|[\s\S])|[^'\\\n])*'|\"(?:\\(?:\r\n|[\s\S])|[^\"\\\n])*\""
    rf"|{_TEMPLATE}"
    rf"|/\*|{_OPERATOR}|[\s\S]"
)
_HOLE = re.compile(rf"\\[\s\S]|\$\{{({_SIMPLE})\}}")
_BRACKET = re.compile(r"([(){}\[\]])")
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_FIXED = {"=": "=", "=>": "=>", "...": "...", "?.": "?.", "++": "++", "--": "++", "+": "-", "-": "-", "~": "!", "!": "!", "*": "*", "/": "/", "<": "<", ">": ">", "|": "|", "&": "&", ".": ".", ":": ":", ";": ";", ",": ",", "?": "?", "@": "@", "(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}"}
_EMPTY, _BAD = "", "\0"

ARGS, EXPR, PARAMS, FOR, BINDING, TYPE = 1, 2, 4, 8, 16, 32  # readings of ( )
ARRAY, INDEX, PATTERN, TUPLE, TYPE_INDEX, SIGNATURE = 1, 2, 4, 8, 16, 32  # of [ ]
BLOCK, OBJECT, FIELDS, CLASS, MEMBERS, SWITCH, NAMES, ENUM, RETURNS, AWAITS, BREAKS, CONTINUES = 1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048  # of { }


class Bad(Exception):
    """The line can't be read this way."""


class _Classes(dict):
    """Token -> class; keeps words and operators, not texts."""

    def __init__(self, typed: bool):
        super().__init__(_FIXED)
        self.typed = typed

    def __missing__(self, token: str) -> str:
        c = token[0]
        if not token.strip(" \t\f\v\n\r\u00a0\ufeff") or token.isspace():
            out = "\n" if "\n" in token else _EMPTY
        elif token.startswith("//"):
            return _EMPTY
        elif token.startswith("/*"):
            return _BAD if len(token) < 4 else "\n" if "\n" in token else _EMPTY
        elif c.isalpha() or c in "_$\\":
            m = re.match(r"([a-z]+)\s*/.*/[a-z]*$", token, re.S)
            if m:
                return f"{m[1]} r"
            out = token if token in _WORDS else "i"
        elif c in "'\"":
            return "s" if len(token) > 1 else _BAD
        elif c == "`":
            if len(token) == 1:
                return _BAD
            holes = [m[1] for m in _HOLE.finditer(token) if m[1] is not None]
            return "t" if all(_is_expression(h, self.typed) for h in holes) else _BAD
        elif c.isdigit() or c == "." and len(token) > 1 and token[1].isdigit():
            out = "0" if len(token) > 1 or c.isdigit() else _BAD
            if len(token) > 1 and token[0] == "0" and token[1:].isdigit() and self.typed:
                out = _BAD
        elif c == "#":
            out = "h" if len(token) > 1 else _BAD
        elif (m := re.match(rf"({_OPERATOR})\s*/[^/*]", token)) and len(token) > 2 and re.match(rf"{_BEFORE_REGEX}\s*{_REGEX}$", token):
            return f"{self[m[1]]} r"
        elif re.fullmatch(_OPERATOR, token):
            out = "A" if token[-1] == "=" and token not in ("==", "!=", "===", "!==", "<=") else "o"
        else:
            return _BAD
        if len(self) < 300_000:
            self[token] = out
        return out


_classes = {False: _Classes(False), True: _Classes(True)}


@lru_cache(2)
def _tokens(text: str) -> list[str]:
    """A file is read twice in a row, with types and without."""
    return _TOKEN.findall(text)


_DIFFERENT = re.compile(r"`|(?<![\w.])0\d")


@lru_cache(2)
def _plain_line(text: str) -> str:
    return _line(text, False)


def _line(text: str, typed: bool) -> str:
    """Token classes with a space between; an odd character or an open text is \\0."""
    tokens = _tokens(text)
    get = _classes[typed]
    return " ".join([c for c in map(get.__getitem__, tokens) if c])


@lru_cache(65536)
def _is_expression(text: str, typed: bool) -> bool:
    top = _reduce(_line(text, typed), typed)
    return top is not None and bool(_reads(top.replace("\n", ""), typed, "expr"))


def _reduce(line: str, typed: bool) -> str | None:
    """All brackets replaced by their symbols, or None if they don't match. One pass with a stack."""
    if _BAD in line:
        return None
    opened: list[str] = []
    parts: list[list[str]] = [[]]
    for i, piece in enumerate(_BRACKET.split(line)):
        if i % 2 == 0:
            parts[-1].append(piece)
        elif piece in _CLOSE:
            opened.append(piece)
            parts.append([])
        elif not opened or _CLOSE[opened[-1]] != piece:
            return None
        else:
            content = "".join(parts.pop())
            symbol = _symbol(opened.pop(), content, typed)
            if not typed and symbol[1:] == "0":  # what can't be read in any way can stand nowhere; types may be more than is read here
                return None
            parts[-1].append(symbol)
    return None if opened else "".join(parts[0])


_READINGS = {
    "(": (("args", ARGS), ("expr", EXPR), ("params", PARAMS), ("for_head", FOR), ("catch", BINDING), ("type_all", TYPE)),
    "[": (("array", ARRAY), ("expr", INDEX), ("pattern_list", PATTERN), ("tuple_type", TUPLE), ("type_index", TYPE_INDEX), ("signature", SIGNATURE)),
    "{": (("object", OBJECT), ("fields", FIELDS), ("names", NAMES), ("enum", ENUM)),
}
_TYPED_READINGS = {"type_all", "tuple_type", "type_index", "signature", "enum"}


@lru_cache(100_000)
def _symbol(opening: str, content: str, typed: bool) -> str:
    flat = _Parser(content.replace("\n", ""), typed)
    bits = sum(bit for name, bit in _READINGS[opening] if (typed or name not in _TYPED_READINGS) and flat.reads(name))
    if opening == "{":
        block = statements(content, typed, False)
        if block is not None:
            bits |= BLOCK | _flags(block)
        lines = _Parser(content, typed) if "\n" in content else flat
        bits |= CLASS * bool(lines.reads("class_body")) | MEMBERS * (typed and bool(lines.reads("members")))
        cases = lines.reads("switch_body") if lines.t[0] in ("case", "default", "") else None
        if cases:
            bits |= SWITCH | _flags(cases)
    return f"{'PQR'['([{'.index(opening)]}{bits}"


def _flags(found: tuple[bool, bool, bool, bool]) -> int:
    return sum(bit for bit, has in zip((RETURNS, AWAITS, BREAKS, CONTINUES), found) if has)


def _reads(content: str, typed: bool, rule: str) -> tuple[bool, bool, bool, bool] | None:
    """Whether the whole content can be read by the rule: (has a return, an await, a break and a continue of its own) or None."""
    return _Parser(content, typed).reads(rule)


_CONTINUES = {"else", "catch", "finally", "while", "instanceof", "in", "as", "satisfies", "of", "from", "extends"}


def statements(content: str, typed: bool, top: bool) -> tuple[bool, bool, bool, bool] | None:
    """A list of statements, judged piece by piece: a piece ends with a line that surely ends a statement."""
    flags = (False,) * 4
    piece: list[str] = []
    lines = [x for x in content.split("\n") if x and not x.isspace()]
    for k, line in enumerate(lines):
        piece.append(line)
        words = line.split()
        after = lines[k + 1].split(None, 1)[0] if k + 1 < len(lines) else ";"
        if k + 1 == len(lines) or ((words[-1] == ";" or words[-1][0] == "R") and (after in _NAME or after in ("@", ";")) and after not in _CONTINUES):
            found = _piece("\n".join(piece), typed, top)
            if found is None:
                if k + 1 == len(lines):
                    return None
                continue  # perhaps it goes on
            flags = tuple(a or b for a, b in zip(flags, found))
            piece = []
    return flags


@lru_cache(100_000)
def _piece(content: str, typed: bool, top: bool) -> tuple[bool, bool, bool, bool] | None:
    return _reads(content, typed, "module" if top else "block")


# -- the slower reader
_DELICATE = re.compile(r"\b(?:if|while|for|with)\s*\([^\n]*\)\s*/(?![/*])|\}\s*/(?![/*])|<!--|^\s*-->", re.M)
_PLAIN = re.compile(
    r"[ \t\f\v\u00a0\ufeff]+|//[^\n]*|/\*(?:.|\n)*?\*/|<!--[^\n]*"
    r"|\s*\n\s*"
    r"|(?:[^\W\d]|[$\\])(?:[\w$]|\\u)*|\#(?:[^\W\d]|\$)[\w$]*"
    r"|(?:0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)(?![\w$])"
    r"|'(?:\\(?:\r\n|[\s\S])|[^'\\\n])*'|\"(?:\\(?:\r\n|[\s\S])|[^\"\\\n])*\""
    rf"|/\*|{_OPERATOR}|[\s\S]"
)
_PATTERN = re.compile(_REGEX)
_TEMPLATE_TEXT = re.compile(r"(?:\\[\s\S]|[^`\\$]|\$(?!\{))*")
_ELEMENT = re.compile(r"<(?:>|([A-Za-z_$][\w$.:-]*)(?=[\s/>])(?!\s+extends\b))")
_END_OF_ELEMENT = re.compile(r"</\s*([\w$.:-]*)\s*>")
_ATTRIBUTE = re.compile(r"\s+|[A-Za-z_$][\w$:.-]*|=|\"[^\"]*\"|'[^']*'")
_VALUE_FOLLOWS = {"return", "typeof", "case", "in", "of", "instanceof", "new", "delete", "void", "throw", "do", "else", "await", "yield"}


class _Frame:
    """What the reader is in: code (of the file or of a hole), a template, a tag or the children of an element."""

    def __init__(self, kind: str, name: str = ""):
        self.kind, self.name = kind, name
        self.out: list[str] = []
        self.opened: list[bool] = []  # per open bracket: may a regular expression follow its end
        self.ready = True  # a value may begin here
        self.last = ""


def _careful_line(text: str, typed: bool, markup: bool) -> str:
    """Like _line, for any nesting of templates and elements."""
    get, frames, pos = _classes[typed].__getitem__, [_Frame("code")], 0

    def value(symbol: str) -> None:
        f = frames[-1]
        if f.kind == "code":
            f.out.append(symbol)
            f.ready, f.last = False, symbol

    while pos < len(text):
        f = frames[-1]
        c = text[pos]
        if f.kind == "template":
            pos = _TEMPLATE_TEXT.match(text, pos).end()
            if text.startswith("`", pos):
                frames.pop()
                value("t")
                pos += 1
            elif text.startswith("${", pos):
                frames.append(_Frame("code", "template"))
                pos += 2
            else:
                return _BAD
        elif f.kind == "tag" and text.startswith("/>", pos):
            frames.pop()
            value("r")
            pos += 2
        elif f.kind == "tag" and c == ">":
            f.kind = "children"
            pos += 1
        elif f.kind in ("tag", "children") and c == "{":
            frames.append(_Frame("code", "element"))
            pos += 1
        elif f.kind == "children" and (m := _END_OF_ELEMENT.match(text, pos)):
            if m[1] != f.name:
                return _BAD
            frames.pop()
            value("r")
            pos = m.end()
        elif c == "<" and (f.kind != "code" or markup and f.ready) and (m := _ELEMENT.match(text, pos)):
            frames.append(_Frame("tag" if m[1] else "children", m[1] or ""))
            pos = m.end()
        elif f.kind == "tag":
            m = _ATTRIBUTE.match(text, pos)
            if not m:
                return _BAD
            pos = m.end()
        elif f.kind == "children":
            if c in "<>}":
                return _BAD
            pos += 1
        elif c == "`":
            frames.append(_Frame("template"))
            pos += 1
        elif c == "/" and f.ready and text[pos + 1 : pos + 2] not in ("/", "*"):
            m = _PATTERN.match(text, pos)
            if not m:
                return _BAD
            value("r")
            pos = m.end()
        elif text.startswith("-->", pos) and (not f.last or f.out[-1] == "\n"):
            pos = (text.find("\n", pos) + 1 or len(text) + 1) - 1
        elif c == "}" and not f.opened and len(frames) > 1:  # the end of a hole
            line = " ".join([x for x in f.out if x])
            if f.name == "element":
                line = line.removeprefix("...")
            top = _reduce(line, typed)
            if top is None or not (_reads(top.replace("\n", ""), typed, "expr") or f.name == "element" and not top.strip()):
                return _BAD
            frames.pop()
            pos += 1
        else:
            token = _PLAIN.match(text, pos)[0]
            pos += len(token)
            symbol = _EMPTY if token.startswith("<!--") else get(token)
            f.out.append(symbol)
            if c in "([{":
                head = f.last in ("if", "while", "for", "with") if c == "(" else c == "{" and (not f.ready or f.last in ("", ";", "{", "}", "else", "do", "=>"))
                f.opened.append(head)
                f.ready = True
            elif c in ")]}":
                if not f.opened:
                    return _BAD
                f.ready = f.opened.pop()
            elif symbol in ("++", "\n", _EMPTY) or token == "--":
                if symbol != "++":
                    continue
            elif symbol in _NAME or symbol in _LITERAL or symbol == "h":
                f.ready = symbol in _VALUE_FOLLOWS and f.last not in (".", "?.")
            else:
                f.ready = True
            f.last = symbol
    return " ".join([x for x in frames[0].out if x]) if len(frames) == 1 else _BAD


def _accepts(line: str, typed: bool) -> bool:
    top = _reduce(line, typed)
    found = None if top is None else statements(top, typed, True)
    return found is not None and not (found[0] or found[2] or found[3])


def parses(text: str, typed: bool, markup: bool = False) -> bool | None:
    """Whether the text is a JavaScript (or, if typed, TypeScript) script or module; None if it is nested too deeply to say.

    markup: elements may stand where a value may (files named .jsx or .tsx).
    """
    text = text.removeprefix("\ufeff")
    if text.startswith("#!"):
        text = "//" + text[2:]
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\u2028", "\n").replace("\u2029", "\n")
    try:
        line = _line(text, typed) if _DIFFERENT.search(text) else _plain_line(text)
        if _accepts(line, typed):
            return True
        delicate = markup or _BAD in line and "`" in text or _DELICATE.search(text)
        return bool(delicate) and _accepts(_careful_line(text, typed, markup), typed)
    except (RecursionError, MemoryError):
        return None


class _Parser:
    """Reads one line of classes without open brackets. Methods consume tokens or raise Bad."""

    def __init__(self, content: str, typed: bool):
        self.t: list[str] = []
        self.fresh: set[int] = set()  # tokens that begin a line
        for k, line in enumerate(content.split("\n")):
            words = line.split()
            if k and words:
                self.fresh.add(len(self.t))
            self.t += words
        self.fresh.add(len(self.t))
        self.t.append("")
        self.typed = typed

    def reads(self, rule: str) -> tuple[bool, bool, bool, bool] | None:
        """Whether the whole line can be read by the rule: (has a return, an await, a break and a continue of its own) or None."""
        self.at = 0
        self.returns = self.awaits = self.breaks = self.continues = False
        self.unconditional = False  # in what a conditional type extends
        try:
            getattr(self, rule)()
        except Bad:
            return None
        return (self.returns, self.awaits, self.breaks, self.continues) if self.at == len(self.t) - 1 else None

    # -- small steps
    @property
    def now(self) -> str:
        return self.t[self.at]

    def peek(self, n: int = 1) -> str:
        return self.t[min(self.at + n, len(self.t) - 1)]

    def take(self, *tokens: str) -> bool:
        if self.t[self.at] in tokens:
            self.at += 1
            return True
        return False

    def need(self, *tokens: str) -> None:
        if not self.take(*tokens):
            raise Bad

    def word(self, words: set[str]) -> None:
        if self.now not in words:
            raise Bad
        self.at += 1

    def group(self, kind: str, bit: int, at: int | None = None) -> int:
        """The group's readings if the token is a group of this kind and has the reading, else 0."""
        token = self.t[self.at if at is None else min(at, len(self.t) - 1)]
        bits = int(token[1:]) if token and token[0] == kind and token[1:].isdigit() else 0
        return bits if bits & bit else 0

    def take_group(self, kind: str, bit: int) -> int:
        bits = self.group(kind, bit)
        if not bits:
            raise Bad
        self.at += 1
        return bits

    def may_group(self, kind: str, bit: int) -> int:
        bits = self.group(kind, bit)
        self.at += bool(bits)
        return bits

    def attempt(self, step) -> bool:
        back = self.at, self.returns, self.awaits, self.breaks, self.continues, self.unconditional
        try:
            step()
            return True
        except Bad:
            self.at, self.returns, self.awaits, self.breaks, self.continues, self.unconditional = back
            return False

    def end(self) -> bool:
        return self.at == len(self.t) - 1

    def semicolon(self) -> None:
        if not (self.take(";") or self.end() or self.at in self.fresh):
            raise Bad

    def listed(self, step, separators: tuple[str, ...] = (",",), to_end: bool = True) -> None:
        """step, separated; a last separator may stand; up to the end of the line."""
        while not self.end():
            step()
            if not self.take(*separators):
                break
        if to_end and not self.end():
            raise Bad

    # -- expressions
    def expr(self) -> None:
        self.assign()
        while self.take(","):
            self.assign()

    def assign(self) -> None:
        while True:  # what follows `=`, `:` or `yield` is read by the next round
            t = self.now
            if t == "yield" and self.peek() not in ("=", ".", "A", "=>", "?.", ")", ";"):
                self.at += 1
                self.take("*")
                if self.end() or self.now in (",", ":", ";") or self.at in self.fresh:
                    return
                continue
            if (t in ("async", "<") or t in _IDENTIFIER or t[:1] == "P") and self.attempt(self.arrow):
                return
            target = self.binary()
            if self.now == "?":
                self.at += 1
                self.assign()
                self.need(":")
            elif self.now in ("=", "A"):
                if not (target == 1 or (target == 2 and self.now == "=")):
                    raise Bad
                self.at += 1
            else:
                return

    def arrow(self) -> None:
        is_async = self.now == "async" and self.peek() != "=>" and self.take("async")
        if self.now == "<" and self.typed:
            self.type_params()
        if self.now in _IDENTIFIER:
            self.at += 1
        else:
            self.take_group("P", PARAMS)
            if self.typed and self.take(":"):
                self.type(True)
        self.need("=>")
        if self.now[:1] == "R":
            bits = self.take_group("R", BLOCK)
            if bits & AWAITS and not is_async or bits & (BREAKS | CONTINUES):
                raise Bad
        else:
            before = self.awaits
            self.awaits = False
            self.assign()
            if self.awaits and not is_async:
                raise Bad
            self.awaits = before

    def binary(self) -> int:
        target = self.unary()
        while True:
            t = self.now
            if t in _BINARY:
                self.at += 1
                if t == ">":
                    while self.take(">"):
                        pass
                    self.take("=")
                self.unary()
            elif self.typed and t in ("as", "satisfies") and self.at not in self.fresh:
                self.at += 1
                if not (self.now == "const" and self.take("const")):
                    self.type()
                continue
            else:
                return target
            target = 0

    def unary(self) -> int:
        t = self.now
        if t in ("!", "-", "typeof", "void", "delete"):
            self.at += 1
            self.unary()
            return 0
        if t == "await" and self.peek() not in ("=", ".", "A", "=>", "?.", "", ",", ";", ":"):
            self.at += 1
            self.awaits = True
            self.unary()
            return 0
        if t == "++":
            self.at += 1
            if self.unary() != 1:
                raise Bad
            return 0
        if t == "<" and self.typed:
            self.at += 1
            self.type()
            self.need(">")
            self.unary()
            return 0
        if t == "h" and self.peek() == "in":
            self.at += 1
            return 0
        return self.postfix()

    def type_args(self) -> None:
        self.need("<")
        self.type()
        while self.take(","):
            self.type()
        self.need(">")

    def call_with_types(self) -> None:
        self.type_args()
        if not (self.group("P", ARGS) or self.now == "t"):
            raise Bad

    def postfix(self) -> int:
        target = self.primary()
        while True:
            t = self.now
            if t == ".":
                self.at += 1
                if not self.take("h"):
                    self.word(_NAME)
                target = 1
            elif t == "?.":
                self.at += 1
                if not (self.may_group("P", ARGS) or self.may_group("Q", INDEX) or self.take("h")):
                    self.word(_NAME)
                target = 0
            elif t[:1] == "P":
                self.take_group("P", ARGS)
                target = 0
            elif t[:1] == "Q":
                self.take_group("Q", INDEX)
                target = 1
            elif t == "t":
                self.at += 1
                target = 0
            elif self.typed and t == "!" and self.at not in self.fresh and self.peek() not in ("=",):
                self.at += 1
            elif self.typed and t == "<" and self.attempt(self.call_with_types):
                target = 0
            elif t == "++" and self.at not in self.fresh:
                if target != 1:
                    raise Bad
                self.at += 1
                return 0
            else:
                return target

    def primary(self) -> int:
        """1: can be assigned to; 2: can be a pattern; 0: neither."""
        t = self.now
        if t == "async" and self.peek() == "function" and self.at + 1 not in self.fresh:
            self.at += 1
            self.function(True)
        elif t in _IDENTIFIER:
            self.at += 1
            return 1
        elif t in _LITERAL:
            self.at += 1
        elif t[:1] == "P":
            self.take_group("P", EXPR)
        elif t[:1] == "Q":
            bits = self.take_group("Q", ARRAY | PATTERN)
            if not bits & ARRAY and self.now != "=":
                raise Bad
            return 2 if bits & PATTERN else 0
        elif t[:1] == "R":
            bits = self.take_group("R", OBJECT | FIELDS)
            if not bits & OBJECT and self.now != "=":
                raise Bad
            return 2 if bits & FIELDS else 0
        elif t == "function":
            self.function(False)
        elif t in ("class", "@"):
            self.decorators()
            self.klass()
        elif t == "new":
            self.at += 1
            if self.take("."):
                self.word(_NAME)
                return 0
            if self.now == "new":
                self.primary()
            else:
                self.primary()
                while True:
                    if self.take("."):
                        if not self.take("h"):
                            self.word(_NAME)
                    elif not self.may_group("Q", INDEX):
                        break
            if self.typed and self.now == "<":
                self.attempt(self.type_args)
            self.may_group("P", ARGS)
        elif t == "import":
            self.at += 1
            if self.take("."):
                self.word(_NAME)
            else:
                self.take_group("P", ARGS)
        else:
            raise Bad
        return 0

    def function(self, is_async: bool, named: bool = False, bodiless: bool = False) -> None:
        self.need("function")
        self.take("*")
        if self.now in _IDENTIFIER:
            self.at += 1
        elif named:
            raise Bad
        self.method_rest(is_async, bodiless)

    def method_rest(self, is_async: bool, bodiless: bool) -> None:
        if self.typed and self.now == "<":
            self.type_params()
        self.take_group("P", PARAMS)
        if self.typed and self.take(":"):
            self.type(True)
        bits = self.may_group("R", BLOCK)
        if bits:
            if bits & AWAITS and not is_async or bits & (BREAKS | CONTINUES):
                raise Bad
        elif bodiless and self.typed:
            self.semicolon()
        else:
            raise Bad

    def decorators(self) -> None:
        while self.take("@"):
            if not self.may_group("P", EXPR):
                self.word(_NAME)
                while self.take("."):
                    self.word(_NAME)
                if self.typed and self.now == "<":
                    self.attempt(self.type_args)
                self.may_group("P", ARGS)

    def klass(self) -> None:
        self.need("class")
        if self.now in _IDENTIFIER and self.now != "implements":
            self.at += 1
        if self.typed and self.now == "<":
            self.type_params()
        if self.take("extends"):
            self.postfix()
            if self.typed and self.now == "<":
                self.type_args()
        if self.typed and self.now == "i" and self.peek() in _NAME:  # implements
            self.at += 1
            self.type()
            while self.take(","):
                self.type()
        self.take_group("R", CLASS)

    # -- contents of brackets
    def args(self) -> None:
        self.listed(lambda: (self.take("..."), self.assign()))

    def array(self) -> None:
        while not self.end():
            if self.take(","):
                continue
            self.take("...")
            self.assign()
            if not self.take(","):
                break

    def name(self) -> str:
        t = self.now
        if t[:1] == "Q" and t[1:].isdigit():
            self.take_group("Q", INDEX)
            return "Q"
        if t not in _NAME and t not in ("s", "0", "h"):
            raise Bad
        self.at += 1
        return t

    def entry(self) -> None:
        if self.take("..."):
            self.assign()
            return
        is_async = False
        ends = (",", ":", "", "=")
        while self.now in ("async", "get", "set", "*") and not (self.peek() in ends or self.peek()[:1] == "P" or self.peek() == "<"):
            is_async = is_async or self.now == "async"
            self.at += 1
        own = self.name()
        if self.take(":"):
            self.assign()
        elif self.now[:1] == "P" or self.now == "<":
            self.method_rest(is_async, False)
        elif own not in _IDENTIFIER:
            raise Bad

    def object(self) -> None:
        self.listed(self.entry)

    def target(self) -> None:
        if not (self.may_group("Q", PATTERN) or self.may_group("R", FIELDS)) and self.postfix() != 1:
            raise Bad
        if self.now == "." or self.now[:1] == "Q":
            raise Bad

    def field(self) -> None:
        if self.take("..."):
            self.target()
            return
        own = self.name()
        if self.take(":"):
            self.target()
        elif own not in _IDENTIFIER:
            raise Bad
        if self.take("="):
            self.assign()

    def fields(self) -> None:
        self.listed(self.field)

    def element(self) -> None:
        self.take("...")
        self.target()
        if self.take("="):
            self.assign()

    def pattern_list(self) -> None:
        while not self.end():
            if self.take(","):
                continue
            self.element()
            if not self.take(","):
                break

    def param(self) -> None:
        if self.typed:
            self.decorators()
            while self.now in ("public", "private", "protected", "readonly", "override") and (self.peek() in _IDENTIFIER or self.peek()[:1] in ("Q", "R")):
                self.at += 1
        self.take("...")
        if self.typed and self.take("this"):
            pass
        elif not (self.may_group("Q", PATTERN) or self.may_group("R", FIELDS)):
            self.word(_IDENTIFIER)
        if self.typed:
            self.take("?")
            if self.take(":"):
                self.type()
        if self.take("="):
            self.assign()

    def params(self) -> None:
        self.listed(self.param)

    def catch(self) -> None:
        self.declared()

    def declared(self) -> None:
        if not (self.may_group("Q", PATTERN) or self.may_group("R", FIELDS)):
            self.word(_IDENTIFIER)
        if self.typed:
            self.take("!")
            if self.take(":"):
                self.type()

    def declarations(self, constant: bool) -> None:
        while True:
            destructured = self.now[:1] in ("Q", "R")
            self.declared()
            if self.take("="):
                self.assign()
            elif constant or destructured:
                raise Bad
            if not self.take(","):
                break

    def for_head(self) -> None:
        if not self.attempt(self.for_each):
            if not self.take(";"):
                if self.now in ("var", "const") or self.now == "let" and (self.peek() in _IDENTIFIER or self.peek()[:1] in ("Q", "R")):
                    self.at += 1
                    self.declarations(self.t[self.at - 1] == "const")
                else:
                    self.expr()
                self.need(";")
            if self.now != ";":
                self.expr()
            self.need(";")
            if not self.end():
                self.expr()

    def for_each(self) -> None:
        if self.now in ("var", "const", "let", "using") and self.peek() not in ("in", "of") or self.now == "await" and self.peek() == "using":
            self.at += 2 if self.now == "await" else 1
            self.declared()
        else:
            self.target()
        if self.take("of"):
            self.assign()
        else:
            self.need("in")
            self.expr()
        if not self.end():
            raise Bad

    def named(self) -> None:
        if self.now == "type" and self.typed and (self.peek() in _NAME or self.peek() == "s") and self.peek() != "as":
            self.at += 1
        if not self.take("s"):
            self.word(_NAME)
        if self.take("as") and not self.take("s"):
            self.word(_NAME)

    def names(self) -> None:
        self.listed(self.named)

    def enumerated(self) -> None:
        self.name()
        if self.take("="):
            self.assign()

    def enum(self) -> None:
        self.listed(self.enumerated)

    def member_of_class(self) -> None:
        if self.take(";"):
            return
        self.decorators()
        if self.now == "static" and (bits := self.group("R", BLOCK, self.at + 1)):
            if bits & (RETURNS | BREAKS | CONTINUES):
                raise Bad
            self.at += 2
            return
        modifiers = {"static", "async", "get", "set", "*", "accessor"} | ({"public", "private", "protected", "readonly", "abstract", "override", "declare"} if self.typed else set())
        seen = set()
        while self.now in modifiers and not (self.peek() in ("=", ";", ":", "?", "!", "", "<") or self.peek()[:1] == "P" or (self.at + 1 in self.fresh and self.now != "*")):
            seen.add(self.now)
            self.at += 1
        if self.typed and self.group("Q", SIGNATURE) and self.peek() == ":":
            self.at += 2
            self.type()
            self.semicolon()
            return
        self.name()
        if self.typed:
            self.take("?", "!")
        if self.now[:1] == "P" or self.now == "<":
            self.method_rest("async" in seen, True)
            return
        if self.typed and self.take(":"):
            self.type()
        if self.take("="):
            self.assign()
        self.semicolon()

    def class_body(self) -> None:
        while not self.end():
            self.member_of_class()

    # -- types
    def type_all(self) -> None:
        self.type()

    def type(self, result: bool = False) -> None:
        if result and self.now in (*_IDENTIFIER, "this") and self.peek() == "is":
            self.at += 2
        elif result and self.now == "asserts" and self.peek() in (*_IDENTIFIER, "this"):
            self.at += 2
            if not self.take("is"):
                return
        self.take("|", "&")
        self.type_part()
        while self.take("|", "&"):
            self.type_part()
        if self.now == "extends" and self.at not in self.fresh and not self.unconditional and self.attempt(self.condition):
            return

    def condition(self) -> None:
        self.need("extends")
        self.unconditional = True
        self.type()
        self.unconditional = False
        self.need("?")
        self.type()
        self.need(":")
        self.type()

    def type_part(self) -> None:
        while self.now in ("keyof", "readonly", "unique", "infer") and (self.peek() in _NAME or self.peek()[:1] in ("P", "Q", "R")):
            self.at += 1
            if self.t[self.at - 1] == "infer" and self.now in _IDENTIFIER and self.peek() == "extends" and self.attempt(self.inferred):
                return
        t = self.now
        if t == "<":
            self.type_params()
            self.take_group("P", PARAMS)
            self.need("=>")
            self.type(True)
        elif t == "abstract" and self.peek() == "new":
            self.at += 1
            self.type_part()
        elif t == "new":
            self.at += 1
            if self.now == "<":
                self.type_params()
            self.take_group("P", PARAMS)
            self.need("=>")
            self.type()
        elif t[:1] == "P":
            if self.peek() == "=>" and self.group("P", PARAMS):
                self.at += 2
                self.type(True)
            else:
                self.take_group("P", TYPE)
        elif t[:1] == "Q":
            self.take_group("Q", TUPLE)
        elif t[:1] == "R":
            self.take_group("R", MEMBERS)
        elif t in ("s", "0", "t", "null", "true", "false", "void", "this"):
            self.at += 1
        elif t == "-":
            self.at += 1
            self.need("0")
        else:
            self.take("typeof")
            if self.take("import"):
                self.take_group("P", ARGS)
            else:
                self.word(_IDENTIFIER | {"this"})
            while self.take("."):
                self.word(_NAME)
            if self.now == "<" and self.at not in self.fresh:
                self.type_args()
        while self.at not in self.fresh and self.may_group("Q", TYPE_INDEX):
            pass

    def inferred(self) -> None:
        """A name with a constraint; before a question mark only where no condition can stand."""
        self.at += 2
        held, self.unconditional = self.unconditional, True
        self.type()
        self.unconditional = held
        if self.now == "?" and not held:
            raise Bad

    def type_params(self) -> None:
        self.need("<")
        while self.now != ">":
            while self.now in ("const", "in", "out") and self.peek() in _IDENTIFIER:
                self.at += 1
            self.word(_IDENTIFIER)
            if self.take("extends"):
                self.type()
            if self.take("="):
                self.type()
            if not self.take(","):
                break
        self.need(">")

    def tuple_part(self) -> None:
        self.take("...")
        if self.now in _NAME and (self.peek() == ":" or self.peek() == "?" and self.peek(2) == ":"):
            self.at += 1
            self.take("?")
            self.need(":")
        self.type()
        self.take("?")

    def tuple_type(self) -> None:
        self.listed(self.tuple_part)

    def type_index(self) -> None:
        if not self.end():
            self.type()

    def signature(self) -> None:
        self.word(_IDENTIFIER)
        if self.take(":"):
            self.type()
        else:
            self.need("in")
            self.type()
            if self.take("as"):
                self.type()

    def member(self) -> None:
        while self.now in ("readonly", "-", "get", "set") and (self.peek() in _NAME or self.peek() in ("s", "0", "readonly") or self.peek()[:1] == "Q"):
            self.at += 1
        if self.now == "new" and (self.peek()[:1] == "P" or self.peek() == "<"):
            self.at += 1
        if self.now[:1] == "P" or self.now == "<":
            pass
        elif self.group("Q", SIGNATURE):
            self.at += 1
        else:
            self.name()
        self.take("-")
        self.take("?")
        if self.now == "<":
            self.type_params()
        self.may_group("P", PARAMS)
        if self.take(":"):
            self.type(True)
        if not (self.take(";", ",") or self.end() or self.at in self.fresh):
            raise Bad

    def members(self) -> None:
        while not self.end():
            self.member()

    # -- statements
    def block(self) -> None:
        while not self.end():
            self.statement()

    def module(self) -> None:
        while not self.end():
            if self.now == "import" and self.peek()[:1] != "P" and self.peek() != ".":
                self.imported()
            elif self.now == "export" or self.now == "@":
                self.decorators()
                if self.now == "export":
                    self.exported()
                else:
                    self.statement()
            else:
                self.statement()

    def source(self) -> None:
        self.need("from")
        self.need("s")
        if self.take("with", "assert"):
            self.take_group("R", OBJECT)
        self.semicolon()

    def imported(self) -> None:
        self.need("import")
        if self.take("s"):
            if self.take("with", "assert"):
                self.take_group("R", OBJECT)
            self.semicolon()
            return
        if self.typed and self.now == "type" and self.peek() not in ("from", ",", "="):
            self.at += 1
        if self.now in _IDENTIFIER:
            self.at += 1
            if self.typed and self.take("="):
                self.expr()
                self.semicolon()
                return
            if not self.take(","):
                self.source()
                return
        if self.take("*"):
            self.need("as")
            self.word(_IDENTIFIER)
        else:
            self.take_group("R", NAMES)
        self.source()

    def exported(self) -> None:
        self.need("export")
        if self.take("default"):
            if self.now == "function" or self.now == "async" and self.peek() == "function":
                self.function(self.take("async"), bodiless=True)
            elif self.now in ("class", "@") or self.now == "abstract" and self.peek() == "class":
                self.take("abstract")
                self.decorators()
                self.klass()
            elif self.typed and self.now == "interface":
                self.statement()
            else:
                self.assign()
                self.semicolon()
        elif self.take("*"):
            if self.take("as") and not self.take("s"):
                self.word(_NAME)
            self.source()
        elif self.typed and self.take("="):
            self.expr()
            self.semicolon()
        elif self.typed and self.now == "as" and self.peek() == "namespace":
            self.at += 2
            self.word(_IDENTIFIER)
            self.semicolon()
        elif self.group("R", NAMES) or self.typed and self.now == "type" and self.peek()[:1] in ("R", "*"):
            self.take("type")
            if not self.take("*"):
                self.take_group("R", NAMES)
            if self.now == "from":
                self.source()
            else:
                self.semicolon()
        elif self.now in ("var", "let", "const", "function", "class", "async", "@") or self.typed and self.now in ("type", "interface", "enum", "abstract", "declare", "namespace", "module", "import"):
            self.statement()
        else:
            raise Bad

    def braces(self) -> None:
        bits = self.take_group("R", BLOCK)
        self.returns |= bool(bits & RETURNS)
        self.awaits |= bool(bits & AWAITS)
        self.breaks |= bool(bits & BREAKS)
        self.continues |= bool(bits & CONTINUES)

    def body(self) -> None:
        """A statement in a loop."""
        held = self.breaks, self.continues
        self.statement()
        self.breaks, self.continues = held

    def typed_statement(self) -> bool:
        """Declarations that only TypeScript has."""
        t, n = self.now, self.peek()
        if t == "interface" and n in _IDENTIFIER:
            self.at += 2
            if self.now == "<":
                self.type_params()
            if self.take("extends"):
                self.type()
                while self.take(","):
                    self.type()
            self.take_group("R", MEMBERS)
        elif t == "type" and n in _IDENTIFIER and self.at + 1 not in self.fresh:
            self.at += 2
            if self.now == "<":
                self.type_params()
            self.need("=")
            self.type()
            self.semicolon()
        elif t == "enum" or t == "const" and n == "enum":
            self.take("const")
            self.at += 1
            self.word(_IDENTIFIER)
            self.take_group("R", ENUM)
        elif t in ("namespace", "module", "global") and (n in _IDENTIFIER or n == "s" or t == "global" and n[:1] == "R") and self.at + 1 not in self.fresh:
            self.at += 1
            if self.now[:1] != "R":
                self.at += 1
                while self.take("."):
                    self.word(_IDENTIFIER)
            if self.now[:1] == "R":
                self.at += 1
            else:
                self.semicolon()
        elif t == "declare" and (n in _NAME) and self.at + 1 not in self.fresh:
            self.at += 1
            if self.now in ("var", "let", "const") and self.peek() != "enum":
                self.at += 1
                self.declared()
                self.semicolon()
            elif self.now == "function":
                self.function(False, True, True)
            else:
                self.statement()
        elif t == "abstract" and n == "class":
            self.at += 1
            self.klass()
        else:
            return False
        return True

    def statement(self) -> None:
        t, n = self.now, self.peek()
        if self.typed and t in ("interface", "type", "enum", "const", "namespace", "module", "global", "declare", "abstract") and self.typed_statement():
            return
        if t == ";":
            self.at += 1
        elif t[:1] == "R" and t[1:].isdigit():
            self.braces()
        elif t in ("var", "const") or t == "let" and (n in _IDENTIFIER or n[:1] in ("Q", "R")):
            self.at += 1
            self.declarations(t == "const")
            self.semicolon()
        elif t == "using" and n in _IDENTIFIER and self.at + 1 not in self.fresh and n not in ("in", "of"):
            self.at += 1
            self.declarations(True)
            self.semicolon()
        elif t == "await" and n == "using" and self.peek(2) in _IDENTIFIER and self.at + 2 not in self.fresh:
            self.at += 2
            self.awaits = True
            self.declarations(True)
            self.semicolon()
        elif t == "if":
            while self.take("if"):
                self.take_group("P", EXPR)
                self.statement()
                if not self.take("else"):
                    return
            self.statement()
        elif t == "for":
            self.at += 1
            self.awaits |= self.take("await")
            self.take_group("P", FOR)
            self.body()
        elif t == "while":
            self.at += 1
            self.take_group("P", EXPR)
            self.body()
        elif t == "with":
            self.at += 1
            self.take_group("P", EXPR)
            self.statement()
        elif t == "do":
            self.at += 1
            self.body()
            self.need("while")
            self.take_group("P", EXPR)
            self.take(";")
        elif t == "return":
            self.at += 1
            self.returns = True
            if not (self.end() or self.at in self.fresh or self.now == ";"):
                self.expr()
            self.semicolon()
        elif t in ("break", "continue"):
            self.at += 1
            if self.now in _IDENTIFIER and self.at not in self.fresh:
                self.at += 1
            elif t == "break":
                self.breaks = True
            else:
                self.continues = True
            self.semicolon()
        elif t == "throw":
            self.at += 1
            if self.at in self.fresh:
                raise Bad
            self.expr()
            self.semicolon()
        elif t == "try":
            self.at += 1
            self.braces()
            caught = self.take("catch")
            if caught:
                self.may_group("P", BINDING)
                self.braces()
            if self.take("finally"):
                self.braces()
            elif not caught:
                raise Bad
        elif t == "switch":
            self.at += 1
            self.take_group("P", EXPR)
            bits = self.take_group("R", SWITCH)
            self.returns |= bool(bits & RETURNS)
            self.awaits |= bool(bits & AWAITS)
            self.continues |= bool(bits & CONTINUES)
        elif t == "debugger":
            self.at += 1
            self.semicolon()
        elif t == "function":
            self.function(False, True, True)
        elif t == "async" and n == "function" and self.at + 1 not in self.fresh:
            self.at += 1
            self.function(True, True, True)
        elif t in ("class", "@"):
            self.decorators()
            if self.now == "abstract" and self.typed:
                self.at += 1
            self.klass()
        elif t in _IDENTIFIER and n == ":":
            self.at += 2
            self.statement()
        else:
            self.expr()
            self.semicolon()

    def switch_body(self) -> None:
        while not self.end():
            if self.take("case"):
                self.expr()
            else:
                self.need("default")
            self.need(":")
            while not self.end() and self.now not in ("case", "default"):
                self.statement()
