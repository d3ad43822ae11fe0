"""Definitions and references in languages of braces, over tokens: there is no grammar, so places decide.

Comments and literals go, brackets are paired, and one walk over the tokens tells definitions by the words
before and the brackets after a name. A file whose brackets do not pair gives None and is read by patterns.
Types are told by place or by a capital letter, so references to types are near those of a grammar, not equal.
"""

from __future__ import annotations

import re
from collections import Counter

from tessera.schema import IDENTS_PER_FILE, SIGNATURE, STOPWORDS

_ECMA = {"class": "class", "function": "function"}
_TYPED = _ECMA | {"interface": "type", "enum": "type", "type": "type"}
#: By language: words that a definition's name follows, and its kind.
INTRODUCES = {
    "javascript": _ECMA, "typescript": _TYPED, "tsx": _TYPED,
    "go": {"type": "type", "func": "function"},
    "rust": {"fn": "function", "struct": "type", "enum": "type", "trait": "type", "mod": "type"},
    "java": {"class": "class", "interface": "class", "enum": "class"},
    "c": {"struct": "type", "enum": "type"},
    "cpp": {"class": "class", "struct": "type", "enum": "type"},
    "csharp": {"class": "class", "interface": "class", "struct": "type", "enum": "type"},
    "php": {"function": "function", "class": "class", "interface": "type"},
}
SCRIPT = {"javascript", "typescript", "tsx"}
#: Where any name of a type is a reference, and those of them where its declaration is one too.
TYPES = {"typescript", "tsx", "go", "rust", "java", "c", "cpp"}
DECLARED = TYPES - {"java"}
#: Without a rule for references: these come from the lexical count.
LEXICAL = {"php"}

WORDS = set("""
if for while switch catch return throw new else do case in of as is typeof sizeof lock using await yield delete import export extends
implements public private protected internal static final abstract const let var override virtual readonly async sealed partial extern
unsafe volatile synchronized native transient default void operator goto foreach when where throws match loop move ref out params
function class interface struct enum func fn type package namespace typedef template impl trait mod use pub
""".split())  # fmt: skip
BEFORE_NAME = WORDS - {"void"}

_TAIL = r"|(?P<name>[^\W\d]\w*)|\d[\w.]*|(?P<sign>=>|===?|!==?|<=|>=|->|::|[^\s\w])"
_DOUBLE, _COMMENT = r'"(?:\\.|[^"\\\n])*"', r"//[^\n]*|/\*[\s\S]*?\*/"
_SINGLE, _CHAR = r"'(?:\\.|[^'\\\n])*'", r"'(?:\\[^\n']+|[^\\'\n])'"
LITERALS = {
    "rust": rf'{_COMMENT}|#!?\[[^\]]*\]|r(#*)"[\s\S]*?"\1|b?"(?:\\[\s\S]|[^"\\])*"|{_CHAR}',
    "go": rf"{_COMMENT}|`[^`]*`|{_DOUBLE}|{_CHAR}",
    "java": rf'{_COMMENT}|"""[\s\S]*?"""|{_DOUBLE}|{_CHAR}',
    "csharp": rf'{_COMMENT}|^[ \t]*#[^\n]*|\$?@\$?"(?:""|[^"])*"|\$?{_DOUBLE}|{_CHAR}',
    "php": rf'{_COMMENT}|#(?!\[)[^\n]*|"(?:\\[\s\S]|[^"\\])*"|\'(?:\\[\s\S]|[^\'\\])*\'',
} | dict.fromkeys(SCRIPT, rf"{_COMMENT}|`(?:\\[\s\S]|[^`\\])*`|{_DOUBLE}|{_SINGLE}") | dict.fromkeys(("c", "cpp"), rf"{_COMMENT}|^[ \t]*#(?:\\\n|[^\n])*|{_DOUBLE}|{_CHAR}")
LEXERS = {lang: re.compile(p + _TAIL, re.M) for lang, p in LITERALS.items()}
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
CLOSES = {")": "(", "]": "[", "}": "{"}


class Source:
    """Tokens of a text with their lines and the partner of every bracket."""

    def __init__(self, lang: str, text: str):
        self.lang, self.text, self.line, self.pair = lang, [], [], {}
        self.names, open_, place, line, counted = set(), [], 0, 1, 0
        if lang == "php":  # what is outside of code keeps only its lines
            text = re.sub(r"(\A|\?>)[\s\S]*?(?:<\?(?:php|=)?|\Z)", lambda m: "\n" * m[0].count("\n"), text)
        while m := LEXERS[lang].search(text, place):
            place = m.end()
            own = m["sign"] or m["name"]
            if own is None:
                continue
            if own == "/" and lang in SCRIPT and (not self.text or self.text[-1] in WORDS or self.text[-1] not in ")]}" and len(self.text) - 1 not in self.names):
                if literal := REGEX.match(text, m.start()):
                    place = literal.end()
                    continue
            line += text.count("\n", counted, m.start())
            counted = m.start()
            i = len(self.text)
            if m["name"]:
                self.names.add(i)
            elif own in "([{":
                open_.append(i)
            elif own in CLOSES:
                if not open_ or self.text[open_[-1]] != CLOSES[own]:
                    raise ValueError("brackets do not pair")
                self.pair[i] = open_.pop()
                self.pair[self.pair[i]] = i
            self.text.append(own)
            self.line.append(line)
        if open_:
            raise ValueError("brackets do not pair")

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def plain(self, i: int) -> bool:
        return i in self.names and self.text[i] not in WORDS

    def body(self, i: int, one_line: bool = False) -> int | None:
        """The brace that opens the body of a definition whose name stands before i."""
        line = self.line[i - 1]
        while i < len(self.text) and not (one_line and self.line[i] != line):
            if self.text[i] == "{" and not (not one_line and self.lang == "go" and self.text[i - 1] in ("interface", "struct")):
                return i
            if self.text[i] in (";", "}"):
                return None
            i = self.pair[i] + 1 if self.text[i] in "([{" else i + 1
        return None

    def past_angles(self, i: int) -> int:
        """The place after <...>, if one starts at i."""
        depth, k = 0, i
        while self.at(k) in ("<", ">") or depth and self.at(k) not in ("", ";", "{", "}"):
            depth += {"<": 1, ">": -1}.get(self.text[k], 0)
            k += 1
            if not depth:
                return k
        return i

    def start(self, i: int) -> int:
        """The line on which the declaration of the name at i starts, with its attributes."""
        while i > 0 and self.text[i - 1] not in ("{", "}", ";"):
            i = self.pair[i - 1] if self.text[i - 1] in (")", "]") else i - 1
        return self.line[i]


def _function_value(s: Source, i: int) -> int | None:
    """The last token of the function that a variable named at i holds, if it holds one."""
    k = i + 1
    while s.at(k) not in ("=", "", ";", "{", "}", ",", "of", "in"):
        k = s.pair[k] + 1 if s.text[k] in "([" else k + 1
    if s.at(k) != "=":
        return None
    k += 2 if s.at(k + 1) == "async" else 1
    if s.at(k) == "function":
        return s.pair.get(s.body(k + 1))
    k = s.past_angles(k)
    k = s.pair[k] + 1 if s.at(k) == "(" else k + 1
    if s.at(k) == ":":
        while s.at(k) not in ("=>", "", ";", "{", "}"):
            k = s.pair[k] + 1 if s.text[k] in "([" else k + 1
    return s.pair.get(k + 1, min(k + 1, len(s.text) - 1)) if s.at(k) == "=>" else None


def _method(s: Source, i: int, owner: str) -> bool:
    """Whether the name at i, straight in the body of a class, is declared there."""
    before, k = s.at(i - 1), s.past_angles(i + 1)
    typed = i - 1 in s.names and before not in BEFORE_NAME or before in (">", "]", "?")
    if s.lang in SCRIPT:
        if s.at(k) != "(" or before in (".", "new", "=", "@"):
            return False
        k = s.pair[k] + 1
        return s.at(k) == "{" or s.at(k) == ":" and s.lang != "javascript" and s.body(k) is not None
    if s.lang == "csharp" and typed and s.at(k) in ("{", "=>"):
        return True
    if s.at(k) != "(" or not (typed or s.lang == "csharp" and s.text[i] == owner and before not in ("new", "~", ".")):
        return False
    return s.at(s.pair[k] + 1) in ("{", ";", "=>", ":", "throws", "where")


def definitions(s: Source) -> tuple[dict[int, tuple], set[int], set[int]]:
    """Place of the name -> (kind, first line, last line); the places of base types; the braces that open a type's body."""
    lang, known = s.lang, INTRODUCES[s.lang]
    found, bases, bodies, blocks, stack = {}, set(), set(), {}, []

    def define(i: int, kind: str, body: int | None, inside: str = "", line: int | None = None, last: int | None = None) -> None:
        if body is not None:
            blocks[body] = (inside, s.text[i])
            if kind == "type":
                bodies.add(body)
        last = s.pair[body] if body is not None else i if last is None else last
        first = s.start(i) if lang in ("java", "csharp") else line or s.line[i]
        found[i] = (kind, first, max(first, s.line[last]))

    for i, word in enumerate(s.text):
        while stack and stack[-1][0] < i:
            stack.pop()
        _, inside, owner = stack[-1] if stack else (0, "", "")
        if word == "{":
            stack.append((s.pair[i], *blocks.get(i, ("", ""))))
        if i not in s.names or s.at(i - 1) == ".":
            continue
        kind, k = known.get(word), i + 1
        if kind and lang == "go" and word == "func" and s.at(k) == "(":
            kind, k = "method", s.pair[k] + 1
            if s.at(k + 1) not in ("(", "["):
                continue
        elif kind and lang == "go" and word == "type" and s.at(k) == "(":
            j = k + 1
            while j < s.pair[k]:
                if s.plain(j) and s.line[j] != s.line[j - 1] and j not in found:
                    define(j, "type", s.body(j + 1, True))
                j = s.pair[j] + 1 if s.text[j] in "([{" else j + 1
            continue
        elif kind == "function" and s.at(k) in ("*", "&"):
            k += 1
        elif kind and word == "enum" and s.at(k) in ("class", "struct"):
            k += 1
        if kind and k in s.names and s.text[k] not in INTRODUCES[lang]:
            after = s.past_angles(k + 1)
            if kind == "function":
                if lang == "rust" and s.body(after) is None:
                    continue
                define(k, "method" if lang == "php" and inside == "class" else kind, s.body(after), "def")
            elif kind == "method":
                define(k, kind, s.body(after), "def")
            elif lang in SCRIPT and word == "type":
                if s.at(after) == "=":
                    define(k, kind, after + 1 if s.at(after + 1) == "{" else None)
            elif lang in ("c", "cpp") and s.at(after) not in ("{", ":", "final"):
                pass
            elif k not in found:
                body = s.body(after, lang == "go")
                define(k, kind, body, "class")
                if lang == "csharp" and body is not None and s.at(after) == ":":
                    bases.update(j for j in range(after + 1, body) if s.plain(j) and s.at(j - 1) in (":", ",", "."))
        elif lang in ("c", "cpp") and word == "typedef":
            while s.at(k) not in (";", ""):
                k = s.pair[k] + 1 if s.text[k] in "([{" else k + 1
            name = next((j for j in range(k - 1, i, -1) if s.plain(j)), None)
            if name and s.at(k):
                define(name, "type", None, line=s.line[i], last=k)
        elif i in found or not s.plain(i):
            continue
        elif lang in SCRIPT and s.at(i - 1) in ("const", "let", "var"):
            last = _function_value(s, i)
            if last is not None:
                define(i, "function", None, last=last)
        elif inside == "class" and lang in (*SCRIPT, "java", "csharp"):
            if _method(s, i, owner):
                k = s.past_angles(i + 1)
                define(i, "method", s.body(k if s.at(k) != "=>" else len(s.text)), "def")
        elif lang == "javascript" and inside != "def" and s.at(k) == "(" and s.at(s.pair[k] + 1) == "{" and s.at(i - 1) in ("{", ",", "get", "set", "async"):
            define(i, "method", s.pair[k] + 1, "def")
        elif lang in ("c", "cpp") and inside not in ("def", "class") and s.at(k) == "(" and (s.at(i - 1) in ("*", "&", "::", ">") or i - 1 in s.names and s.text[i - 1] not in BEFORE_NAME):
            after = s.pair[k] + 1
            while s.at(after) in ("const", "noexcept", "override", "final"):
                after += 1
            if s.at(after) == "{" or lang == "cpp" and s.at(after) == ":" and s.body(after) is not None:
                define(i, "method" if s.at(i - 1) == "::" else "function", s.body(after), "def")
    return found, bases, bodies


def references(s: Source, found: dict[int, tuple], bases: set[int], bodies: set[int]) -> Counter:
    """Names of calls, of created objects, of bases and of types, as far as the language has them."""
    lang, refs = s.lang, Counter()
    types = {s.text[i] for i, (kind, *_) in found.items() if kind in ("type", "class")}
    imports, signatures = set(), set()
    if lang in ("go", "typescript", "tsx"):  # what an interface declares is no call
        for b in bodies:
            i = b + 1
            while i < s.pair[b]:
                signatures.add(i)
                i = s.pair[i] + 1 if s.text[i] in "([{" else i + 1
    for i in s.names:
        if s.text[i] == "import" and lang in SCRIPT:
            k = i + 1
            while s.at(k) in (",", "type") or s.plain(k):
                k += 1
            if s.at(k) == "{":
                imports.update(j for j in range(k + 1, s.pair[k]) if s.plain(j) and s.at(j - 1) in ("{", ",", "type"))
    for i in sorted(s.names):
        name, before, after = s.text[i], s.at(i - 1), s.at(i + 1)
        if name in WORDS:
            continue
        if i in found:
            hit = lang in DECLARED and found[i][0] in ("type", "class") and before != "mod"
        elif after == "(" and (i in signatures or lang in ("c", "cpp", "java", "csharp") and (s.plain(i - 1) or before == "void") or lang == "java" and name in types and before != "new" or lang == "rust" and before == "fn"):
            hit = False  # declared here
        elif after == "(" or i in imports or i in bases:
            hit = True
        elif before in ("new", "extends") and after not in (".", "::"):
            hit = True
        elif lang == "rust" and after == "!" and s.at(i + 2) in ("(", "[", "{"):
            hit = True
        elif lang == "csharp":
            k = i + 1
            while s.at(k) == "?" or s.at(k) == "[" and s.at(k + 1) == "]":
                k += 1 if s.at(k) == "?" else 2
            attribute = before in ("[", ",") and after in ("]", ",") and not (s.plain(i - 2) or s.at(i - 2) in (")", "]")) and before == "["
            hit = attribute or after == "<" and name[0].isupper() or s.plain(k) and s.at(k + 1) in (";", "=", ",", ")", "in")
        elif lang in ("c", "cpp"):
            hit = name in types or s.plain(i + 1) or after in ("*", "&") and s.plain(i + 2) and (before in ("", "{", "}", ";", "(", ",") or before in WORDS) and s.at(i + 3) in (";", ",", ")", "=", "(", "[")
        elif lang in TYPES:
            hit = (name in types or name[0].isupper() and (not name.isupper() or s.plain(i + 1))) and not (lang in (*SCRIPT, "java") and (before == "." or after == "."))
        else:
            hit = False
        if hit and 3 <= len(name) <= 64 and name.lower() not in STOPWORDS:
            refs[name] += 1
    return Counter(dict(refs.most_common(IDENTS_PER_FILE)))


def parse(lang: str, text: str) -> tuple[list[tuple], Counter | None] | None:
    """(symbols, references) of a file; references are None where they are counted lexically; None if its brackets do not pair."""
    try:
        s = Source(lang, text)
    except ValueError:
        return None
    found, bases, bodies = definitions(s)
    lines, symbols = text.split("\n"), {}
    for i, (kind, line, last) in sorted(found.items()):
        own = lines[line - 1].strip()
        own = own if len(own) <= SIGNATURE else own[: SIGNATURE - 1] + "…"
        symbols.setdefault((s.text[i], line), (s.text[i], kind, line, last, own))
    return sorted(symbols.values(), key=lambda x: x[2]), None if lang in LEXICAL else references(s, found, bases, bodies)
