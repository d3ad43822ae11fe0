"""Definitions and references of Ruby, whose blocks close with a word, over tokens."""

from __future__ import annotations

import re
from collections import Counter

from tessera.schema import IDENTS_PER_FILE, SIGNATURE, STOPWORDS

TOKEN = re.compile(
    r"^=begin\b[\s\S]*?^=end\b[^\n]*|^__END__[\s\S]*|#[^\n]*"
    r"|<<[~-]?(?P<quote>['\"]?)(?P<here>[A-Z_]+)(?P=quote)(?P<rest>[^\n]*)\n[\s\S]*?^[ \t]*(?P=here)$"
    r"|\"(?:\\[\s\S]|[^\"\\])*\"|'(?:\\[\s\S]|[^'\\])*'|`(?:\\.|[^`\\])*`|%[wWiIqQ]?(?:\([^)]*\)|\[[^\]]*\]|\{[^}]*\})"
    r"|(?<![:\w]):(?:[^\W\d]\w*[?!=]?)|(?P<name>[@$]*[^\W\d]\w*[?!]?)|\d[\w.]*|(?P<sign>&\.|::|=>|<<|[=!<>]=+|\n|[^\s\w])",
    re.M,
)
OPENS = {"def", "class", "module", "begin", "case", "do"}
#: These open a block only where a statement or a value starts; elsewhere they follow a statement.
MAY_OPEN = {"if", "unless", "while", "until", "for"}
WORDS = OPENS | MAY_OPEN | set("end else elsif when in then rescue ensure return and or not yield self super nil true false alias undef next break redo retry defined?".split())
STARTS = {"", "\n", ";", "=", "(", "[", "{", ",", "=>", "then", "do", "else", "begin", "and", "or", "not", "&", "|"}


def parse(text: str) -> tuple[list[tuple], Counter] | None:
    """(symbols, references) of a file; None if blocks do not pair.

    References are names that are called (after a dot or before a parenthesis) and constants, other than keywords.
    """
    tokens, place, line, counted = [], 0, 1, 0
    while m := TOKEN.search(text, place):
        place = m.end()
        line += text.count("\n", counted, m.start())
        counted = m.start()
        if m["here"]:  # what follows the mark on its line is code
            tokens += [(t["name"] or t["sign"], line) for t in TOKEN.finditer(m["rest"]) if t["name"] or t["sign"]]
        elif own := m["name"] or m["sign"]:
            tokens.append((own, line))
    word = [t for t, _ in tokens] + ["", ""]
    found, refs, stack, loop, defined = [], Counter(), [], False, set()
    for i, (own, at) in enumerate(tokens):
        before, after = word[i - 1] if i else "", word[i + 1]
        member = before in (".", "&.")
        if own == "\n":
            loop = False
        if not (own[0].isalpha() or own[0] == "_"):
            continue
        if own in WORDS and not member and before != "def" and not (after == ":" and word[i + 2] != ":"):
            if own == "end":
                if not stack:
                    return None
                if (mark := stack.pop()) is not None:
                    found[mark][3] = at
            elif own == "do" and loop:
                loop = False  # of the loop that is open already
            elif own in OPENS or own in MAY_OPEN and before in STARTS:
                loop = own in ("while", "until", "for")
                k = i + 1
                while word[k] == "self" and word[k + 1] == "." or word[k + 1] == "::":
                    k += 2
                named = own in ("def", "class", "module") and k < len(tokens) and (word[k][0].isalpha() or word[k][0] == "_")
                if named:
                    found.append([word[k], "method" if own == "def" else "class", at, at])
                    defined.add(k)
                    depth, j = 0, k + 1  # `def name(...) = value` has no end
                    if own == "def":
                        while j < len(tokens) and (word[j] == "(" or depth):
                            depth += {"(": 1, ")": -1}.get(word[j], 0)
                            j += 1
                        if word[j] == "=" and word[j - 1] != "\n" and word[j + 1] != "(":
                            continue
                stack.append(len(found) - 1 if named else None)
            continue
        if (own[0].isupper() or member or after == "(") and not (i in defined and not own[0].isupper()) and 3 <= len(own) <= 64 and own.lower() not in STOPWORDS:
            refs[own] += 1
    if stack:
        return None
    lines, symbols = text.split("\n"), {}
    for name, kind, first, last in found:
        own = lines[first - 1].strip()
        own = own if len(own) <= SIGNATURE else own[: SIGNATURE - 1] + "…"
        symbols.setdefault((name, first), (name, kind, first, last, own))
    return list(symbols.values()), Counter(dict(refs.most_common(IDENTS_PER_FILE)))
