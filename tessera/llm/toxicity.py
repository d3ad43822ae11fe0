"""Toxicity by a logistic model with a counterfactual penalty.

Indicators of words, of their first four and six bytes, and of pairs of words are weighed by a logistic
model. The loss also holds the square of the score change between counterfactual pairs, so that what a
group is called moves no score and neutral mentions are not marked. Pairs come from labelled sentences:

* a learning text that names a group, and its copy in which every group term is swapped for the next of its
  cycle in ``IDENTITY`` or ``FORMS`` (the last for a neutral word);
* of up to ``SLOTS`` learning texts, those first by hash of doc_id, a sentence in which one word gives its
  place to a term, and the same sentence with another term of the cycle there. So the penalty acts also
  where no labelled text names a group.

The loss is minimised by Adam over all rows at once, on features that at least ``SEEN`` rows have and
whose counts in the two classes differ by more than chance (a G statistic of ``TELLING`` or more); features
of group terms are always among them. A fifth of the rows, by hash of doc_id, turns margins into scores as
in ``quality``. See ``learning`` for the rows learnt from and for defined cases: equal texts get equal
scores, and columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import learning
from tessera.llm.batches import map_slices, texts
from tessera.llm.learning import BITS
from tessera.llm.textkit import LETTER, Block, U, indicators, mix, ngrams
from tessera.storage import table, written

#: Score from which a document is toxic; weights of the squares of the coefficients and of the score changes; steps; least rows and G of a feature; power of a text's number of features by which sums are divided.
TOXIC, RIDGE, FAIR, STEPS, SEEN, TELLING, POWER = 0.7, 2e-4, 1.0, 150, 3, 10.0, 0.25

#: Learning texts of which a sentence gets group terms.
SLOTS = 2_000

#: Neutral names of groups; a term is swapped for the next in its list, the last for the word for people.
IDENTITY = {
    "en": ("women", "men", "muslims", "christians", "jews", "hindus", "immigrants", "refugees", "africans", "asians", "gays", "lesbians"),
    "de": ("frauen", "männer", "muslime", "christen", "juden", "migranten", "flüchtlinge", "schwule"),
    "fr": ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "réfugiés", "homosexuels"),
    "es": ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "refugiados", "homosexuales"),
}
#: Singulars and adjectives in cycles of their own, so that the form stays; a word that languages share is in one cycle only.
FORMS = (
    ("woman", "man"), ("muslim", "christian", "jew", "hindu"), ("jewish", "islamic", "catholic", "protestant", "buddhist"), ("immigrant", "refugee"),
    ("african", "asian", "european"), ("black", "white"), ("gay", "lesbian", "bisexual", "trans", "transgender", "queer"), ("homosexual", "heterosexual"),
    ("frau", "mann"), ("muslimin", "christin", "jüdin"), ("moslem", "christ", "jude"), ("muslimisch", "christlich", "jüdisch"), ("migrant", "flüchtling"), ("schwul", "lesbisch"),
    ("femme", "homme"), ("musulman", "chrétien", "juif"), ("musulmane", "chrétienne", "juive"), ("immigré", "réfugié"), ("noir", "blanc"), ("noire", "blanche"), ("homosexuel", "hétérosexuel"), ("lesbienne", "homosexuelle"),
    ("mujer", "hombre"), ("musulmán", "cristiano", "judío"), ("musulmana", "cristiana", "judía"), ("inmigrante", "refugiado"), ("lesbiana", "transexual"),
)
NEUTRAL = {"en": "people", "de": "leute", "fr": "gens", "es": "personas"}
CYCLES = (*((*terms, NEUTRAL[lang]) for lang, terms in IDENTITY.items()), *FORMS)
SWAP = {a: b for terms in CYCLES for a, b in zip(terms, (*terms[1:], terms[0]), strict=True) if a not in NEUTRAL.values()}
_GROUP = re.compile(r"\b(?:" + "|".join(sorted(SWAP, key=len, reverse=True)) + r")\b", re.IGNORECASE)
_SENTENCE, _WORD = re.compile(r"[^.!?\n]+"), re.compile(r"[^\W\d_]+")


def features(own: list[str]) -> tuple[np.ndarray, np.ndarray]:
    block = Block([t.lower().encode("utf-8", "surrogatepass") for t in own])
    block.prepare()
    starts, ends = block.runs(LETTER)
    words, of = block.hashes(starts, ends), block.owner(starts)
    parts = [(words, of), ngrams(words, of, 2)]
    for k in (4, 6):
        longer = ends - starts > k
        at = starts[longer]
        parts.append((mix(block.hashes(at, at + k) + U(k)), of[longer]))
    return indicators(parts, block.n, BITS)


def telling(y: np.ndarray, found: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The features that the model uses."""
    of = np.repeat(y, np.diff(starts))
    inside = [np.bincount(found[of == k], minlength=1 << BITS).astype(float) for k in (0, 1)]
    size, g = [float((y == k).sum()) for k in (0, 1)], np.zeros(1 << BITS)
    for own, n in zip(inside, size, strict=True):
        share = (inside[0] + inside[1]) / len(y)
        for seen, expected in ((own, n * share), (n - own, n * (1 - share))):
            g += np.where(seen > 0, 2 * seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)
    return np.flatnonzero((inside[0] + inside[1] >= min(SEEN, len(y))) & (g >= TELLING))


def swapped(text: str) -> str | None:
    """The text with its group terms swapped, None if it names no group."""
    new, n = _GROUP.subn(lambda m: SWAP[m[0].lower()], text)
    return new if n else None


def slotted(text: str, doc_id: int) -> tuple[str, str] | None:
    """A sentence of the text with one word replaced by a group term, and by another of its cycle; which, depends on doc_id. None without words."""
    random = int(mix(np.array([doc_id], np.int64).view(U))[0])
    sentences = [m.span() for m in _SENTENCE.finditer(text)]
    if not sentences:
        return None
    own = text[slice(*sentences[random % len(sentences)])]
    words = [m.span() for m in _WORD.finditer(own)]
    if not words:
        return None
    a, b = words[random // 7 % len(words)]
    terms = CYCLES[random // 11 % len(CYCLES)]
    first = random // 13 % len(terms)
    second = (first + 1 + random // 17 % (len(terms) - 1)) % len(terms)
    return own[:a] + terms[first] + own[b:], own[:a] + terms[second] + own[b:]


def gradient(w: np.ndarray, bias: float, y: np.ndarray, x: tuple, pairs: tuple | None, fair: float = FAIR) -> tuple[float, np.ndarray]:
    """Mean logistic loss (both classes weigh the same) + ridge + fair * mean squared score change, and its gradient in (w, bias). x: features, starts, factors."""
    found, starts, factor = x
    size = len(w)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    f = learning.sums_by(w[found], starts) * factor + bias
    loss = (weight * np.logaddexp(0.0, np.where(y == 1, -f, f))).sum() + RIDGE / 2 * (w @ w)
    pull = weight * (learning.sigmoid(f) - y)
    grad = np.bincount(found, weights=np.repeat(pull * factor, np.diff(starts)), minlength=size) + RIDGE * w
    if pairs is not None:
        (fa, sa, na), (fb, sb, nb) = pairs
        change = learning.sums_by(w[fa], sa) * na - learning.sums_by(w[fb], sb) * nb
        loss += fair * (change @ change) / len(change)
        change *= 2 * fair / len(change)
        grad += np.bincount(fa, weights=np.repeat(change * na, np.diff(sa)), minlength=size) - np.bincount(fb, weights=np.repeat(change * nb, np.diff(sb)), minlength=size)
    return loss, np.append(grad, pull.sum())


def descend(y: np.ndarray, x: tuple, pairs: tuple | None, size: int, steps: int = STEPS, fair: float = FAIR) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam."""
    w = np.zeros(size + 1)
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        _, g = gradient(w[:-1], w[-1], y, x, pairs, fair)
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        w = w - 0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    return w[:-1], w[-1]


def _pairs(rows: DataFrame, n: int) -> tuple[tuple, tuple] | None:
    """Features of both texts of every counterfactual pair. n: number of rows, about."""
    below = min(1 << 32, (SLOTS << 32) // max(1, n))

    def run(parts) -> Iterator[dict]:
        for part in parts:
            pairs = []
            for i, t in zip(part["doc_id"].to_pylist(), texts(part), strict=True):
                if (s := swapped(t)) is not None:
                    pairs.append((i, t, s))
                if int(mix(np.array([i], np.int64).view(U) ^ U(0x51075))[0]) >> 32 < below and (both := slotted(t, i)):
                    pairs.append((i, *both))
            columns = {"doc_id": [i for i, _, _ in pairs]}
            for name, own in (("a", [t for _, t, _ in pairs]), ("b", [s for _, _, s in pairs])):
                found, starts = features(own)
                columns[name] = [found[p:q].tobytes() for p, q in zip(starts[:-1], starts[1:], strict=True)]
            yield columns

    got = sorted(map_slices(rows.select("doc_id", "text"), run, "doc_id long, a binary, b binary", most=learning.FEATURED).toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["a"], r["b"]))
    if not got:
        return None
    out = []
    for name in "ab":
        own = [np.frombuffer(r[name], np.int32) for r in got]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        out.append((np.concatenate(own), starts, learning.norms(starts, POWER)))
    return tuple(out)


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", most: int = learning.SAMPLE) -> dict:
    """The model, with its number of counterfactual pairs and their mean change of score (gap)."""
    rows = written(learning.sampled(docs, labels, column, most), "toxicity-sample")
    ids, y, found, starts = learning.gathered(rows, features)
    if (all_same := learning.constant(y)) is not None:
        return {"constant": all_same}
    pairs = _pairs(rows, len(y))
    terms, _ = features([t for own in CYCLES for t in own])
    columns = np.union1d(telling(y, found, starts), terms)
    place = np.full(1 << BITS, len(columns), np.int64)  # the last one stands for all rare features and keeps weight 0
    place[columns] = np.arange(len(columns))
    size = len(columns) + 1
    factor = learning.norms(starts, POWER)

    def dense(f, s, n):
        keep = place[f] < len(columns)
        return place[f][keep], np.concatenate([[0], np.cumsum(keep)])[s], n

    pairs = pairs and (dense(*pairs[0]), dense(*pairs[1]))
    check = mix(ids.astype(U)) % U(5) == 0
    scale, shift = 2.0, 0.0
    if all(len(set(y[m].tolist())) == 2 for m in (check, ~check)):
        w, b = descend(y[~check], dense(*learning.rows_of(~check, found, starts), factor[~check]), pairs, size)
        f, s, n = dense(*learning.rows_of(check, found, starts), factor[check])
        scale, shift = learning.platt(learning.sums_by(w[f], s) * n + b, y[check])
    w, b = descend(y, dense(found, starts, factor), pairs, size)
    weights = np.zeros(1 << BITS, np.float32)
    weights[columns] = w[:-1]
    model = {"constant": None, "weights": weights, "bias": b, "power": POWER, "scale": scale, "shift": shift, "pairs": 0, "gap": 0.0}
    if pairs:
        score = [learning.sigmoid(scale * (learning.sums_by(w[f], s) * n + b) + shift) for f, s, n in pairs]
        model |= {"pairs": len(score[0]), "gap": float(np.abs(score[0] - score[1]).mean())}
    return model


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return learning.scored(docs, features, fit(docs, table(spark, sf_dir, "labels")), TOXIC)
