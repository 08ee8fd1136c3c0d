"""Finding the symbols of a source text.

Python is parsed by the standard library, and where a text has errors, statement
by statement, so that only what doesn't parse is lost. Languages with braces are scanned:
comments, strings and regular expressions are blanked out by the rules of each
language, and declarations are recognised where statements begin, at the top,
within classes and modules, and in the blocks and callbacks of other statements.
Lua's blocks end with words and have a scan of their own.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from dataclasses import dataclass, field


@dataclass
class Symbol:
    kind: str
    name: str
    first: int
    last: int
    parent: str = ""
    container: bool = False
    members: list = field(default_factory=list)


def symbols_of(text: str, grammar: str) -> list[Symbol] | None:
    """The symbols of a text, or None if its grammar isn't known or the text can't be parsed."""
    if grammar == "python":
        try:
            return _python(ast.parse(text).body, "")
        except (SyntaxError, ValueError):
            return _python_with_errors(text.split("\n"), "")
        except RecursionError:
            return None
    if grammar == "lua":
        return _lua(text)
    rules = _RULES.get(grammar)
    if not rules:
        return None
    try:
        return _Scan(text, grammar, rules).symbols(0, len(text), "", False)
    except RecursionError:  # thousands of blocks in each other
        return None


def _python(body: list, parent: str) -> list[Symbol]:
    out: list[Symbol] = []
    for node in body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            plain_class = isinstance(node, ast.ClassDef) and not node.decorator_list
            symbol = Symbol("class" if plain_class else "function", node.name, first, node.end_lineno, parent, plain_class)
            if plain_class:
                symbol.members = _python(node.body, node.name)
            out.append(symbol)
        elif isinstance(node, ast.Import):
            out.append(Symbol("import", "", node.lineno, node.end_lineno, parent))
        else:  # if, for, try, with, match: what they hold stands for itself
            for name in ("body", "orelse", "finalbody"):
                out += _python([x for x in getattr(node, name, ()) or () if isinstance(x, ast.stmt)] if isinstance(getattr(node, name, None), list) else [], parent)
            for part in (*getattr(node, "handlers", ()), *getattr(node, "cases", ())):
                out += _python(part.body, parent)
    return out


#: Lines that go on with a statement that began before, though they aren't indented.
_GOES_ON = re.compile(r"[)\]}#'\"]|(?:else|elif|except|finally|case)\b")
_DEFINES = re.compile(r"(?P<kind>(?:async\s+)?def|class)\s+(?P<name>\w+)")
#: Statements, as their indentation tells them, that are put together to find one that parses.
TRIES = 12


def _shifted(symbols: list[Symbol], lines: int) -> list[Symbol]:
    for s in symbols:
        s.first, s.last = s.first + lines, s.last + lines
        _shifted(s.members, lines)
    return symbols


def _python_with_errors(lines: list[str], parent: str, before: int = 0) -> list[Symbol]:
    """The symbols of lines that don't parse as a whole; ``before`` lines of the file come first.

    A statement begins at a line that isn't indented. Statements are parsed one by one; a string over several
    lines may look like more than one, so one that fails is tried with those after it. What doesn't parse then is
    a definition all the same if its head does, and the members of such a class are found in the same way.
    """
    begin = [i for i, line in enumerate(lines) if line.strip() and not line[0].isspace() and not _GOES_ON.match(line)]
    # A decorator belongs to what it decorates.
    begin = [b for k, b in enumerate(begin) if not (k and lines[begin[k - 1]].startswith("@"))] if begin else []
    out: list[Symbol] = []
    k = 0
    while k < len(begin):
        for j in range(k + 1, min(k + TRIES, len(begin)) + 1):
            until = begin[j] if j < len(begin) else len(lines)
            try:
                body = ast.parse("\n".join(lines[begin[k] : until])).body
            except (SyntaxError, ValueError, RecursionError):
                continue
            out += _shifted(_python(body, parent), before + begin[k])
            k = j
            break
        else:
            found, head = _broken(lines[begin[k] :], parent, before + begin[k], [b - begin[k] for b in begin[k + 1 :]])
            out += found
            k = bisect_left(begin, begin[k] + max(1, head))
    return out


def _broken(lines: list[str], parent: str, before: int, begin: list[int]) -> tuple[list[Symbol], int]:
    """The definition that lines begin with though it doesn't parse, if its head does, and how many lines the head has; other statements begin at ``begin``."""
    at = next((i for i, line in enumerate(lines) if not line.startswith("@")), len(lines))
    defined = _DEFINES.match(lines[at]) if at < len(lines) else None
    if not defined:
        return [], 0
    for to in range(at + 1, min(at + 20, len(lines)) + 1):
        try:
            ast.parse("\n".join(lines[at:to]) + " pass")
        except (SyntaxError, ValueError, RecursionError):
            continue
        break
    else:
        return [], 0
    end = next((b for b in begin if b >= to), len(lines))
    last = max(i for i, line in enumerate(lines[:end]) if line.strip())
    plain_class = defined["kind"] == "class" and not at
    symbol = Symbol("class" if plain_class else "function", defined["name"], before + 1, before + last + 1, parent, plain_class)
    if plain_class:
        inner = next((line[: len(line) - len(line.lstrip())] for line in lines[to:end] if line.strip()), "")
        symbol.members = _python_with_errors([line.removeprefix(inner) for line in lines[to:end]], symbol.name, before + to) if inner else []
    return [symbol], to


@dataclass
class _Rule:
    """A declaration: its kind, its pattern with the group name, and how it ends."""

    kind: str
    pattern: str
    block: bool = True
    container: bool = False
    member: bool | None = None  # only within (True) or only outside (False) containers
    value: bool = False  # may end with a value after = instead of a block, or without either
    see_through: bool = False  # is no symbol, but what it holds is


_NAME = r"(?P<name>[A-Za-z_$][\w$]*)"
_JS = [
    _Rule("import", r"import\b(?!\s*\()", block=False, member=False),
    _Rule("function", rf"(?:async\s+)?function\s+{_NAME}", member=False),
    _Rule("class", rf"class\s+{_NAME}", container=True),
    _Rule("interface", rf"interface\s+{_NAME}", member=False),
    _Rule("type", rf"type\s+{_NAME}\s*(?:<[^=]*>)?\s*=", block=False, member=False),
    _Rule("enum", rf"(?:const\s+)?enum\s+{_NAME}", member=False),
    _Rule("variable", rf"(?:const|let|var)\s+(?:{_NAME}|[\[{{])", block=False, member=False),
    _Rule("method", rf"(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*[*#]?\s*(?!(?:if|for|while|switch|catch|return|new)\b){_NAME}\s*(?:<[^()]*>)?\(", member=True),
]
_PUB = r"(?:pub(?:\s*\([^)]*\))?\s+)?"
_RUST = [
    _Rule("function", rf"{_PUB}(?:(?:const|async|unsafe|default)\s+|extern\s+\S+\s+)*fn\s+{_NAME}"),
    _Rule("class", r"(?:unsafe\s+)?impl\b", container=True, member=False),
    _Rule("type", rf"{_PUB}struct\s+{_NAME}", member=False),
    _Rule("enum", rf"{_PUB}enum\s+{_NAME}", member=False),
    _Rule("interface", rf"{_PUB}(?:unsafe\s+)?trait\s+{_NAME}", member=False),
    _Rule("module", rf"{_PUB}mod\s+{_NAME}", container=True),
]
_GO = [
    _Rule("method", rf"func\s*\([^)]*\)\s*{_NAME}"),
    _Rule("function", rf"func\s+{_NAME}"),
    _Rule("type", r"type\b", block=False),
]
_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|async|virtual|override|synchronized|native|default|readonly|unsafe|new|extern)\s+)*"
_JAVA = [
    _Rule("class", rf"{_MODIFIERS}class\s+{_NAME}", container=True),
    _Rule("interface", rf"{_MODIFIERS}interface\s+{_NAME}"),
    _Rule("enum", rf"{_MODIFIERS}enum\s+{_NAME}"),
    _Rule("record", rf"{_MODIFIERS}record\s+(?:class\s+|struct\s+)?{_NAME}\s*(?=[(<{{])", see_through=True),
    _Rule("method", rf"{_MODIFIERS}(?:<[^()]*>\s*)?(?:[\w.$?]+(?:<[^()=;{{]*>)?(?:\[\])*\s+)?(?!(?:if|for|while|switch|catch|return|new|lock|using)\b){_NAME}\s*\(", member=True),
]
_KOTLIN_WORDS = r"(?:(?:public|private|protected|internal|open|abstract|final|override|suspend|inline|operator|infix|tailrec|external|data|sealed|inner|annotation|value|enum|actual|expect)\s+)*"
_KOTLIN = [
    _Rule("import", r"import\b", block=False, member=False),
    _Rule("function", rf"{_KOTLIN_WORDS}fun\s+(?:<[^()]*>\s*)?(?:[\w<>?,. ]+\.)?{_NAME}\s*\(", value=True),
    _Rule("class", rf"{_KOTLIN_WORDS}(?:class|(?:fun\s+)?interface)\s+{_NAME}", container=True, value=True),
]
_SWIFT_WORDS = r"(?:(?:public|private|fileprivate|internal|open|final|static|class|override|mutating|nonmutating|indirect|convenience|async)\s+)*"
_SWIFT = [
    _Rule("function", rf"{_SWIFT_WORDS}func\s+{_NAME}"),
    _Rule("class", rf"{_SWIFT_WORDS}(?:class|struct|enum|extension|actor)\s+(?!func\b|var\b|let\b){_NAME}", container=True),
]
_SCALA_WORDS = r"(?:(?:private|protected|final|override|implicit|inline|lazy|sealed|abstract|case)(?:\[\w+\])?\s+)*"
_SCALA = [
    _Rule("function", rf"{_SCALA_WORDS}def\s+{_NAME}", value=True),
    _Rule("class", rf"{_SCALA_WORDS}class\s+{_NAME}", container=True, value=True),
    _Rule("enum", rf"{_SCALA_WORDS}enum\s+{_NAME}"),
]
_PHP_WORDS = r"(?:(?:abstract|final|readonly|public|private|protected|static)\s+)*"
_PHP = [
    _Rule("class", rf"{_PHP_WORDS}class\s+{_NAME}", container=True),
    _Rule("interface", rf"interface\s+{_NAME}"),
    _Rule("enum", rf"enum\s+{_NAME}"),
    _Rule("method", rf"{_PHP_WORDS}function\s+&?\s*{_NAME}\s*\(", member=True),
    _Rule("function", rf"function\s+&?\s*{_NAME}\s*\(", member=False),
]
_BASH = [_Rule("function", r"function\s+(?P<name>[\w:.-]+)\s*(?:\(\s*\))?(?=\s*\{)"), _Rule("function", r"(?P<name>[\w:.-]+)\s*\(\s*\)(?=\s*\{)")]
_RULES = {
    "javascript": _JS, "typescript": _JS, "tsx": _JS, "rust": _RUST, "go": _GO, "java": _JAVA, "c_sharp": _JAVA,
    "c": [_Rule("function", "")], "cpp": [_Rule("function", "")], "kotlin": _KOTLIN, "swift": _SWIFT, "scala": _SCALA, "php": _PHP, "bash": _BASH,
}
#: What may stand before a declaration and isn't part of it.
_BEFORE = re.compile(r"(?:export\s+(?:default\s+)?(?!=)|declare\s+|namespace\s+[\w.]+\s*\{|package\s+[\w.]+\s*;|template\s*<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>|(?:public|private|protected)\s*:(?!:)|<\?php\b|\?>)")
_OPEN, _CLOSE = "([{", ")]}"
_JS_LIKE = frozenset(("javascript", "typescript", "tsx"))
#: Words after which a slash begins a regular expression.
_VALUE_FOLLOWS = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())


def _js_template(text: str, at: int) -> int:
    """Where the template literal that begins at ``at`` ends; what it holds may be templates too."""
    i, n = at + 1, len(text)
    while i < n:
        if text[i] == "\\":
            i += 2
        elif text[i] == "`":
            return i + 1
        elif text.startswith("${", i):
            depth, i = 1, i + 2
            while i < n and depth:
                if text[i] == "`":
                    i = _js_template(text, i)
                    continue
                depth += (text[i] == "{") - (text[i] == "}")
                i += 1
        else:
            i += 1
    return n


def _js_regex(text: str, at: int) -> int:
    """Where the regular expression that begins at ``at`` ends; ``at`` if its line has no end of one."""
    i, set_ = at + 1, False
    while i < len(text) and text[i] != "\n":
        c = text[i]
        if c == "\\":
            i += 1
        elif c == "/" and not set_:
            return i + 1
        elif c in "[]":
            set_ = c == "["
        i += 1
    return at


def _until(text: str, mark: str, at: int) -> int:
    found = text.find(mark, at)
    return len(text) if found < 0 else found + len(mark)


_PLAIN = {q: re.compile(rf"{q}(?:\\.|[^{q}\\\n])*{q}?", re.S) for q in "\"'"}
_MANY_LINES = {q: re.compile(rf"{q}(?:\\.|[^{q}\\])*{q}?", re.S) for q in "\"'"}
_CHARACTER = re.compile(r"'(?:\\(?:u\{[^}\n]*\}|x[0-9a-fA-F]+|.)|[^'\\\n])'")
_DIRECTIVE = re.compile(r"^[ \t]*#(?:\\\n|[^\n])*", re.M)
_HEREDOC = re.compile(r"<<<[ \t]*(['\"]?)(\w+)\1\n.*?\n[ \t]*\2\b", re.S)
_MARK = re.compile(r"""["'`/#]|<<<""")


def _blanked(text: str, grammar: str) -> str:
    """text with comments as spaces, and strings and regular expressions as underscores; line ends stay."""
    if grammar in ("c", "cpp"):
        text = _DIRECTIVE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    out, at = [], 0
    while True:
        mark = _MARK.search(text, at)
        if not mark:
            out.append(text[at:])
            return "".join(out)
        i, end, fill = mark.start(), mark.start(), "_"
        c = text[i]
        if text.startswith("//", i) and grammar != "bash":
            end, fill = text.find("\n", i), " "
            end = len(text) if end < 0 else end
        elif text.startswith("/*", i) and grammar != "bash":
            end, fill = _until(text, "*/", i + 2), " "
            if grammar in ("rust", "swift", "kotlin", "scala"):  # these lie in each other
                while text.count("/*", i, end) > text.count("*/", i, end) and end < len(text):
                    end = _until(text, "*/", end)
        elif c == "#":
            if grammar in ("php", "bash") and not text.startswith("#[", i) and (i == 0 or text[i - 1].isspace() or text[i - 1] in ";{}"):
                end, fill = text.find("\n", i), " "
                end = len(text) if end < 0 else end
        elif c == "<":
            heredoc = _HEREDOC.match(text, i) if grammar == "php" else None
            end = heredoc.end() if heredoc else i
        elif c == "`":
            end = _js_template(text, i) if grammar in _JS_LIKE else _until(text, "`", i + 1) if grammar in ("go", "bash") else i
        elif c == "/":
            if grammar in _JS_LIKE:
                before = re.search(r"(\w+|\S)\s*\Z", "".join(out[-3:])[-200:] + text[at:i])
                word = before.group(1) if before else ""
                if not word or word in _VALUE_FOLLOWS or not (word[-1].isalnum() or word[-1] in "_$)]"):
                    end = _js_regex(text, i)
        elif text.startswith('"""', i) and grammar in ("java", "kotlin", "swift", "scala", "c_sharp"):
            end = _until(text, '"""', i + 3)
        elif c == '"':
            raw = re.search(r"r(#*)\Z", text[max(0, i - 40) : i]) if grammar == "rust" else None
            if raw:
                end = _until(text, '"' + raw.group(1), i + 1)
            elif grammar == "cpp" and text[max(0, i - 1) : i] == "R" and (mark2 := re.compile(r'"([^()\\\s]{0,16})\(').match(text, i)):
                end = _until(text, f'){mark2.group(1)}"', mark2.end())
            elif grammar == "c_sharp" and re.search(r"@\$?\Z", text[max(0, i - 2) : i]):
                end = re.compile(r'"(?:""|[^"])*"?').match(text, i).end()
            else:
                end = (_MANY_LINES if grammar in ("rust", "php", "bash") else _PLAIN)[c].match(text, i).end()
        elif grammar in ("rust", "kotlin", "scala", "swift", "java", "go", "c", "cpp", "c_sharp"):  # else a lifetime, a symbol or a digit's mark
            found = _CHARACTER.match(text, i)
            end = found.end() if found else i
        else:
            end = (_MANY_LINES if grammar in ("php", "bash") else _PLAIN)[c].match(text, i).end()
        if end <= i:
            out.append(text[at : i + len(mark.group())])
            at = i + len(mark.group())
            continue
        out += [text[at:i], re.sub(r"[^\n]", fill, text[i:end])]
        at = end


_LUA_TOKEN = re.compile(r"--\[(=*)\[.*?\]\1\]|--[^\n]*|\[(=*)\[.*?\]\2\]|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|\b(?:function|if|do|repeat|end|until)\b", re.S)


def _lua(text: str) -> list[Symbol]:
    """Functions outside of functions: named ones by their name, others without."""
    out: list[Symbol] = []
    line = lambda at: text.count("\n", 0, at) + 1
    depth, started = 0, None
    for token in _LUA_TOKEN.finditer(text):
        word = token.group()
        if word in ("function", "if", "do", "repeat"):
            if word == "function" and started is None:
                name = re.compile(r"\s*([\w.:]+)").match(text, token.end())
                local = re.search(r"\blocal\s+\Z", text[: token.start()][-40:])
                begin = token.start() - (len(local.group()) if local and name else 0)
                started = (depth, name.group(1) if name else "", begin)
            depth += 1
        elif word in ("end", "until"):
            depth = max(0, depth - 1)
            if started is not None and depth == started[0]:
                out.append(Symbol("function", started[1], line(started[2]), line(token.start())))
                started = None
    return out


#: A function's declarator: pointers, a name with its scopes, and what opens the parameters.
_DECLARATOR = re.compile(r"(?:[*&]+\s*(?:const\s+)?)*(?:[A-Za-z_]\w*(?:<[^<>;{}()]*>)?\s*::\s*)*(?:operator\s*(?:\(\s*\)|[^\s(\w]+|[\w ]+)|~?\s*[A-Za-z_]\w*)\s*\(")
_NO_FUNCTION = re.compile(r"(?:if|for|while|switch|return|else|do|case|default|goto|struct|class|union|enum|namespace|using|typedef|extern\s+_+|try|catch|asm)\b")


class _Scan:
    def __init__(self, text: str, grammar: str, rules: list[_Rule]) -> None:
        self.text, self.grammar = _blanked(text, grammar), grammar
        self.rules = [(r, re.compile(r.pattern)) for r in rules if r.pattern]
        self.breaks = [i for i, c in enumerate(text) if c == "\n"]

    def line(self, at: int) -> int:
        return bisect_left(self.breaks, at) + 1

    def _closing(self, at: int, end: int) -> int:
        """Where the bracket at ``at`` closes, or the end."""
        depth = 0
        for i in range(at, end):
            c = self.text[i]
            if c in _OPEN:
                depth += 1
            elif c in _CLOSE:
                depth -= 1
                if not depth:
                    return i
        return end - 1

    def _statement_end(self, at: int, end: int, block: bool) -> tuple[int, int | None]:
        """(last character, opening brace if any): up to a semicolon, a closed block, or a line that doesn't go on."""
        i = at
        while i < end:
            c = self.text[i]
            if c == ";":
                return i, None
            if c == "{" and block:
                return self._closing(i, end), i
            if c in _OPEN:
                i = self._closing(i, end)
            elif c == "\n" and not block and not re.match(r"\s*[.?:+*/&|=,)\]}<>-]", self.text[i + 1 : i + 80]) and not re.search(r"[=,+*/&|?:(<>-]\s*$", self.text[max(at, i - 80) : i]):
                return i - 1, None
            i += 1
        return end - 1, None

    def _value_end(self, at: int, end: int) -> tuple[int, int | None]:
        """As _statement_end, of a declaration whose body is a block, a value after =, or missing."""
        i = at
        while i < end:
            c = self.text[i]
            if c == "{":
                return self._closing(i, end), i
            if c == "=" and self.text[i + 1 : i + 2] != ">":
                body = re.compile(r"=\s*\{").match(self.text, i, end)
                return (self._closing(body.end() - 1, end), body.end() - 1) if body else self._statement_end(i, end, False)
            if c == "\n" and not re.match(r"\s*[{:=,.?(-]|\s*(?:where|extends|with|throws)\b", self.text[i + 1 : i + 200]) and not re.search(r"[:,=(-]\s*$", self.text[max(at, i - 80) : i]):
                return i - 1, None
            if c in "([":
                i = self._closing(i, end)
            i += 1
        return end - 1, None

    def _function(self, at: int, end: int) -> tuple[int, str, int] | None:
        """(where it opens, declarator, last character) of a C or C++ function definition that begins here."""
        if _NO_FUNCTION.match(self.text, at, end):
            return None
        i, opened = at, None
        while i < end:
            c = self.text[i]
            if c in ";}" or c == "=" and opened is None and not re.search(r"operator\s*[=!<>+*/%&|^-]*$", self.text[max(at, i - 20) : i]):
                return None
            if c == "(":
                if opened is None:
                    opened = i
                i = self._closing(i, end)
            elif c == "{":
                break
            i += 1
        else:
            return None
        if opened is None:
            return None
        found = None
        for match in _DECLARATOR.finditer(self.text, at, opened + 1):
            if match.end() == opened + 1:
                found = match
        if not found:
            return None
        tail = re.compile(r"(?:\s*(?:const|volatile|noexcept|override|final|&&?)\b)*").match(self.text, self._closing(opened, end) + 1, end).end()
        return i, re.sub(r"\s+", " ", self.text[found.start() : tail]).strip(), self._closing(i, end)

    def _nested(self, at: int, end: int, parent: str) -> list[Symbol]:
        """The symbols in the blocks of a statement that is none itself; in JavaScript also its arrow functions."""
        out: list[Symbol] = []
        i = at
        while i < end:
            c = self.text[i]
            if c == "{":
                last = self._closing(i, end)
                out += self.symbols(i + 1, last, parent, False)
                i = last
            elif c == "=" and self.text.startswith("=>", i) and self.grammar in _JS_LIKE:
                head = re.search(r"(?:async\s+)?(?:[\w$]+|(?P<list>\)))\s*(?::[^()=;{}]*)?\Z", self.text[at:i])
                begin = at + head.start() if head else i
                if head and head.group("list"):
                    depth, begin = 0, at + head.start("list")
                    while begin > at:
                        depth += (self.text[begin] in _CLOSE) - (self.text[begin] in _OPEN)
                        if not depth:
                            break
                        begin -= 1
                    word = re.search(r"async\s*\Z", self.text[at:begin])
                    begin -= len(word.group()) if word else 0
                last = i + 2
                while last < end and self.text[last].isspace():
                    last += 1
                if self.text[last : last + 1] == "{":
                    last = self._closing(last, end)
                else:
                    while last < end and self.text[last] not in ",;)]}":
                        last = self._closing(last, end) + 1 if self.text[last] in _OPEN else last + 1
                    last = min(last, end) - 1
                out.append(Symbol("function", "", self.line(begin), self.line(last), parent))
                i = last
            i += 1
        return out

    def symbols(self, at: int, end: int, parent: str, inside: bool) -> list[Symbol]:
        out: list[Symbol] = []
        while at < end:
            c = self.text[at]
            if c.isspace() or c in ";}":
                at += 1
                continue
            before = _BEFORE.match(self.text, at, end)
            if before:
                at = before.end()
                continue
            defined = self._function(at, end) if self.grammar in ("c", "cpp") else None
            if defined:
                _, name, last = defined
                out.append(Symbol("function", name, self.line(at), self.line(last), parent))
                at = last + 1
                continue
            for rule, pattern in self.rules:
                match = pattern.match(self.text, at, end) if rule.member is None or rule.member == inside else None
                if match:
                    name = match.groupdict().get("name") or ""
                    start = self._closing(match.end() - 1, end) + 1 if self.text[match.end() - 1] == "(" else match.end() if rule.value else match.start()
                    last, brace = self._value_end(start, end) if rule.value else self._statement_end(start, end, rule.block)
                    if rule.kind == "method" and brace is None:
                        continue  # a call, a field or a signature
                    if rule.see_through:
                        out += self.symbols(brace + 1, last, parent, True) if brace is not None else []
                        at = last + 1
                        break
                    symbol = Symbol(rule.kind, name, self.line(at), self.line(last), parent, rule.container)
                    if rule.container and brace is not None:
                        symbol.members = self.symbols(brace + 1, last, name, True)
                    out.append(symbol)
                    at = last + 1
                    break
            else:
                # Another statement: on to its end, and what its blocks declare. A decorator or attribute ends with its line.
                last, _ = self._statement_end(at, end, False)
                last = max(at, last)
                out += self._nested(at, last + 1, parent)
                at = last + 1
        return out
