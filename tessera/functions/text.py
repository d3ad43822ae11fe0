"""Scalar functions on text and identifiers as columns: no Python runs for any row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.schema import IDENT, LANG_BY_EXT, SIGNATURE, SKIP_DIRS, STOPWORDS, SUBTOKEN


def literals(values) -> Column:
    return F.array(*map(F.lit, values))


def stopword(word: Column) -> Column:
    return word.isin(*STOPWORDS)


def token_estimate(text: Column) -> Column:
    """About four code points a token, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IDENT), F.lit(0))


def split_ident(name: Column) -> Column:
    """Lower-case parts of camelCase and snake_case names."""
    return F.transform(F.regexp_extract_all(name, F.lit(SUBTOKEN), F.lit(0)), F.lower)


def tokenize(text: Column) -> Column:
    """Identifiers in lower case without stopwords, each followed by its parts if it has several."""

    def own(ident: Column) -> Column:
        parts = split_ident(ident)
        kept = F.filter(parts, lambda p: (F.length(p) > 1) & ~stopword(p))
        rest = F.substr(ident, F.lit(2))
        plain = (rest == F.lower(rest)) & (F.instr(ident, "_") == 0)  # one part, without a look at it: most words
        return F.when(plain, F.array(F.lower(ident))).otherwise(F.concat(F.array(F.lower(ident)), F.when(F.size(parts) > 1, kept).otherwise(F.array().cast("array<string>"))))

    return F.flatten(F.transform(F.filter(identifiers(text), lambda i: ~stopword(F.lower(i))), own))


def is_test_path(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    base = F.element_at(parts, -1)
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), literals(("tests", "test", "__tests__", "spec"))) | base.startswith("test_") | base.endswith("_test.py")


def is_well_named(name: Column) -> Column:
    mixed = (name != F.lower(name)) & (name != F.upper(name))
    return (F.length(name) >= 8) & ((F.instr(name, "_") > 0) | mixed)


def ident_multiplier(name: Column, mentions=()) -> Column:
    out = F.when(is_well_named(name), 2.0).otherwise(1.0) * F.when(name.startswith("_"), 0.1).otherwise(1.0)
    return out * F.when(name.isin(*mentions), 10.0).otherwise(1.0) if mentions else out


def signature(line: Column) -> Column:
    own = F.trim(line)
    return F.when(F.length(own) > SIGNATURE, F.concat(F.substring(own, 1, SIGNATURE - 1), F.lit("…"))).otherwise(own)


def symbol_doc(name: Column, kind: Column, sig: Column, path: Column) -> Column:
    """The words under which a symbol is found, with repeats."""
    return F.concat(F.array(F.lower(name), kind), split_ident(name), tokenize(sig), tokenize(F.translate(path, "/.", "  ")))


def sha16(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in LANG_BY_EXT.items() for x in kv)), ext)


def in_skipped_dir(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), literals(SKIP_DIRS))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
