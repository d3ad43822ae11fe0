"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one pass: at-signs, plus signs, digits,
URL schemes, identifier cues and the first characters of known credentials. At each anchor a
deterministic local parser expands to the left or right and validates: no parser of a kind looks at a
character twice, so a text takes time in proportion to its length. Spans count code points, end
exclusive.

Base kinds are exactly the leftmost non-overlapping matches of their patterns, those that fail
validation dropped without another try:

* email  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip     four groups of digits joined by dots, each at most 255
* card   ``[0-9]([\\x20-]?[0-9])+``, 13 to 19 digits that pass the Luhn check
* phone  ``\\+[0-9][\\x20().0-9-]+[0-9]``, 9 to 15 digits

The method adds three kinds:

* account  an IBAN of its country's length whose check digits hold, whatever follows it, or 8 or more
           digits behind a cue such as "account no"
* url      an address that carries credentials before an at-sign
* secret   the value assigned (``=``, ``:``, ``=>``) to a name with a cue such as "token", "api_key" or
           "passwort", or to any name if quoted, where the value is as mixed as random characters are;
           keys and tokens of known forms; private keys between their armour lines

A name that speaks of a digest (sha, hash, commit ...) has no secret: such values are public.

Defined cases: a null text is empty; an empty text has no span; equal rows give equal rows; a span of
any length is found whole; other columns of the documents, whatever their names, stay as they are in
:func:`mask` and are not read in :func:`find`; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.batches import map_slices, texts
from tessera.storage import table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "url", "secret")
#: Words before an account number and forms in which they are written.
CUES = ("account", "acct", "iban", "konto", "cuenta", "compte")
#: Parts of names to which secrets are assigned.
SECRETS = (
    "token", "secret", "key", "password", "passwd", "passphrase", "pwd", "pin", "auth", "credential", "bearer",
    "passwort", "kennwort", "geheimnis", "schlüssel", "mot de passe", "jeton", "clé", "contraseña", "clave", "secreto", "llave",
)
#: Parts of names whose values are public.
DIGESTS = ("sha", "md5", "hash", "checksum", "digest", "integrity", "commit", "revision", "etag", "fingerprint", "uuid")
#: Operators and quotes between any name and a quoted value.
ASSIGNED = tuple(f"{op}{space}{quote}" for op in ("=", ":", ">") for space in ("", " ") for quote in "\"'")
#: Forms of keys and tokens by their first characters.
FORMS = {
    "AKIA": r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])", "ASIA": r"ASIA[0-9A-Z]{16}(?![0-9A-Za-z])", "AIza": r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z])",
    "ghp_": r"ghp_[0-9A-Za-z]{36,}+", "gho_": r"gho_[0-9A-Za-z]{36,}+", "ghs_": r"ghs_[0-9A-Za-z]{36,}+", "glpat-": r"glpat-[0-9A-Za-z_-]{20,}+",
    "xoxb-": r"xoxb-[0-9A-Za-z-]{20,}+", "xoxp-": r"xoxp-[0-9A-Za-z-]{20,}+", "sk-": r"sk-[0-9A-Za-z_-]{20,}+", "eyJ": r"eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+",
}
#: Characters of an IBAN by country: fixed values of the registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27,
    "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_DIGITS = re.compile(r"[0-9]++")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]++")
_IBAN = {n: re.compile(r"[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){%d}(?![A-Za-z0-9])" % (n - 4)) for n in set(IBAN_LENGTHS.values())}
_NUMBER = re.compile(r"(?: ?(?:no|nr|number|num|n°|id)\b\.?)?[ :=#-]{1,4}([A-Z]{0,2}[0-9](?:[ -]?[0-9]){7,29}+)(?![A-Za-z0-9])", re.IGNORECASE)
_CREDENTIALS = re.compile(r"//[^\s/@:]++(?::[^\s/@]*+)?@[A-Za-z0-9.-]++(?::[0-9]++)?")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*$")
_NAME_END = re.compile(r"[\w-]{0,40}+[\"'\])]{0,2}+\s{0,4}+(?::=|=>|=|:)\s{0,4}+|(?<=[rR])\s{1,2}+")
_QUOTED = re.compile(r"[\"']([^\"'\s]++)[\"']")
_BARE = re.compile(r"[\w+/=.~!@#$%^&*-]++")
_KNOWN = {k: re.compile(v) for k, v in FORMS.items()}
_LONG, _RUN = ("sk-", "eyJ", "xoxb-", "xoxp-", "glpat-"), re.compile(r"[0-9A-Za-z_.-]++")
_NAME = re.compile(r"([\w.-]{1,40})[\"'\])]{0,2}\s{0,4}(?::=|=>|=|:)\s{0,4}[\"']?$")
_DIGEST = re.compile(r"(?<![a-z])(?:" + "|".join(DIGESTS) + r")(?![a-z])")
_BEGIN, _END = (re.compile(f"-----{x} (?:[A-Z]+ ){{0,3}}PRIVATE KEY(?: BLOCK)?-----") for x in ("BEGIN", "END"))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def iban_holds(text: str) -> bool:
    s = text.replace(" ", "").replace("-", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def looks_random(value: str, least: int = 8) -> bool:
    """Letters and digits mixed as random characters are: at least three bits a character, or short and of three classes."""
    n = len(value)
    classes = (any("0" <= c <= "9" for c in value), any(c.islower() for c in value), any(c.isupper() for c in value), not value.isalnum())
    if n < least or not classes[0] or not (classes[1] or classes[2]):
        return False
    if n < 16:
        return sum(classes) >= 3
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    return entropy >= 3.0


class Finder:
    def __init__(self):
        import ahocorasick

        self.anchors = ahocorasick.Automaton()
        for c in "0123456789":
            self.anchors.add_word(c, "digit")
        self.anchors.add_word("@", "at")
        self.anchors.add_word("+", "plus")
        self.anchors.add_word("://", "scheme")
        for what, cues in (("cue", CUES), ("name", SECRETS)):
            for cue in cues:
                for form in {cue, cue.capitalize(), cue.upper()}:
                    self.anchors.add_word(form, what)
        for mark in ASSIGNED:
            self.anchors.add_word(mark, "assigned")
        for mark in FORMS:
            self.anchors.add_word(mark, mark)
        self.anchors.add_word("-----BEGIN ", "armour")
        self.anchors.make_automaton()

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) of all spans, by kind as listed, then start."""
        out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        done = dict.fromkeys((*KINDS, "armour", "run", "tried"), 0)
        run_end = 0
        for at, what in self.anchors.iter(text):
            if what == "digit":
                if at < run_end:
                    continue
                run_end = _DIGITS.match(text, at).end()
                if at >= done["ip"] and text[run_end : run_end + 1] == "." and (m := _IP.match(text, at)):
                    done["ip"] = m.end()
                    if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                        out["ip"].append(m.span())
                if at >= done["card"] and (m := _CARD.match(text, at)):
                    done["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(m.span())
                start = at - 2
                if start >= done["account"] and text[start:at].isalpha() and text[start:at].isascii() and not text[start - 1 : start].isalnum():
                    self._iban(text, start, out, done)
            elif what == "at":
                start = at
                while start > done["email"] and text[start - 1] in LEFT:
                    start -= 1
                if start < at and (m := _HOST.match(text, at + 1)):
                    out["email"].append((start, m.end()))
                    done["email"] = m.end()
            elif what == "plus":
                if at >= done["phone"] and (m := _PHONE.match(text, at)):
                    end = m.end()
                    while text[end - 1] not in "0123456789":
                        end -= 1
                    if end - at >= 4:  # a sign, a digit, one more character at least, a digit
                        done["phone"] = end
                        if 9 <= sum(c in "0123456789" for c in text[at:end]) <= 15:
                            out["phone"].append((at, end))
            elif what == "cue":
                if at >= done["account"] and (m := _NUMBER.match(text, at + 1)):
                    done["account"] = m.end()
                    out["account"].append(m.span(1))
            elif what == "scheme":
                if m := _CREDENTIALS.match(text, at - 1):
                    before = _SCHEME.search(text, max(0, at - 22), at - 2)
                    if before and before.start() >= done["url"]:
                        done["url"] = m.end()
                        out["url"].append((before.start(), m.end()))
            elif at >= done["secret"]:
                self._secret(text, at, what, out, done)
        return [(k, *span) for k in KINDS for span in sorted(out[k])]

    def _iban(self, text, start, out, done) -> None:
        length = IBAN_LENGTHS.get(text[start : start + 2])
        if length and (m := _IBAN[length].match(text, start)) and iban_holds(m[0]):
            done["account"] = m.end()
            out["account"].append(m.span())

    def _secret(self, text, at, what, out, done) -> None:
        """at: the anchor's last character. A run of characters is tried from its first anchor only."""
        start = end = 0
        if what == "armour":
            if done["armour"] >= 0 and (m := _BEGIN.match(text, at - 10)):
                if close := _END.search(text, m.end()):
                    start, end = m.start(), close.end()
                else:
                    done["armour"] = -1  # nor will there be an end for those to come
        elif what in _KNOWN:
            begin = at + 1 - len(what)
            if begin >= done["run"] and not (begin and text[begin - 1].isalnum()):
                done["run"] = _RUN.match(text, begin).end() if what in _LONG else 0
                if (m := _KNOWN[what].match(text, begin)) and (what != "sk-" or looks_random(m[0])):
                    start, end = m.span()
        elif what == "assigned":
            if (m := _QUOTED.match(text, at)) and len(m[1]) >= 20:
                start, end = self._value(text, *m.span(1))
        elif (m := _NAME_END.match(text, at + 1)) and m.end() >= done["tried"]:
            if value := _QUOTED.match(text, m.end()):
                start, end = self._value(text, *value.span(1))
            elif value := _BARE.match(text, m.end()):
                a, b = value.span()
                done["tried"] = b
                while b > a and text[b - 1] in ".!*":
                    b -= 1
                start, end = self._value(text, a, b)
        if end > start:
            out["secret"].append((start, end))
            done["secret"] = end

    def _value(self, text, start, end) -> tuple[int, int]:
        """The span if it can be a secret and its name does not speak of a digest."""
        name = _NAME.search(text[max(0, start - 64) : start])
        return (start, end) if looks_random(text[start:end]) and not (name and _DIGEST.search(name[1].lower())) else (0, 0)


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first span (then longest), in angle brackets."""
    out, at, last = [], 0, -1
    for a, _, k, b in sorted((a, -b, k, b) for k, a, b in spans):
        if a >= last:
            out += [text[at:a], f"<{k}>"]
        at = last = max(b, last)
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of all kinds, base_sha256 and spans of every document."""

    def run(parts) -> Iterator[dict]:
        finder = Finder()
        for part in parts:
            found = [finder(t) for t in texts(part)]
            base = [[s for s in spans if s[0] in BASE] for spans in found]
            yield {
                "doc_id": part["doc_id"],
                **{f"n_{k}": [sum(s[0] == k for s in spans) for spans in found] for k in KINDS},
                "n_spans": [len(spans) for spans in found],
                "base_sha256": [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base],
                "spans": [joined(spans) for spans in found],
            }

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, base_sha256 string, spans string, n_spans long, " + ", ".join(f"n_{k} long" for k in KINDS))


def mask(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked in ``text`` and ``n_chars`` (if there) counted anew; a null text stays null."""
    names = docs.columns

    def run(parts) -> Iterator[dict]:
        finder = Finder()
        for part in parts:
            raw = part["text"].to_pylist()
            new = [t if t is None or not (spans := finder(t)) else masked(t, spans) for t in raw]
            columns = {n: part[i] for i, n in enumerate(names)} | {"text": new}
            if "n_chars" in columns:
                columns["n_chars"] = [n if t is None or t == o else len(t) for t, o, n in zip(new, raw, part["n_chars"].to_pylist(), strict=True)]
            yield columns

    return map_slices(docs, run, docs.schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
