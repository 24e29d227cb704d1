"""Problem 4: the language of each page and of each line of prose in another language.

Every letter has a random vector of +1 and -1. A trigram is the product of its letters'
vectors, permuted by their place; a text is the sum (bundle) of its trigrams' vectors, and
so is a language's prototype. The cosine of a text and a prototype is a sum over the
text's trigrams of one number for each trigram and language; these numbers are worked out
once, so that scoring a line is a sum of table rows. Confidence is the share of the best
language among the exponentials of all scores, on a scale fitted to the sample's lines. A
text that scores much less for each trigram than the best language's own pages, or that is
mostly in another script, is in none of the languages (``und``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodequery.functions.urls import canonical_host
from lodequery.llm.boilerplate import Judged, SiteLines

DIMENSION = 2048
SEED = 7
#: Labelled pages fitted for each language: a bounded sample, those of least hash of the id.
SAMPLE_PAGES = 400
#: Words of main content below which a page's own label isn't judged.
LEAST_WORDS = 20
#: What a text scores for each trigram, as a share of what the language's own pages score, below which it is in none of
#: the languages; and trigrams it must have for that.
LEAST_SHARE, LEAST_TRIGRAMS = 0.55, 150
#: Share of a text's trigrams in letters of other scripts from which it is in none of the languages.
OTHER_SCRIPT = 0.5
#: The code for no or another language (ISO 639-2).
UNKNOWN = "und"
#: Scales tried for turning scores into probabilities; the one under which the sample's lines are likeliest is taken.
SCALES = (0.1, 0.2, 0.4, 0.8, 1.6, 3.2, 6.4, 12.8)

# The languages told apart, their letters, and ways to name them.
LANGUAGES = ("en", "de", "fr", "es", "pt", "ru")
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäçèéêëìíîïñòóôõöùúûüœæ" + "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
NAMES = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french français",
    "es": "es spa spanish español", "pt": "pt por portuguese português", "ru": "ru rus russian русский",
}
# A few words of each language, which stand in where no page is labelled with it.
STARTER = {
    "en": "the and of to in is that it was for with as his they at be this have from or one had by word but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se le ce il sont la mais comme ou si leur y dont nous avec tout elle cette aux ses même ces être fait entre où sans sous peut aussi deux très bien après chez",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles",
    "ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой что весь от так о для ты же все год человек сказать один такой тот или если только его мочь вы какой наш говорить день во время рука раз новый",
}

_SPACE = 0
_OTHER = 127
_SIZE = 128
FOUND_SCHEMA = "doc_id bigint, line_no int, lang string, confidence double, words int, named string"
_COLUMNS = FOUND_SCHEMA.replace(",", "").split()[::2]


def _letter_table() -> np.ndarray:
    table = np.zeros(65536, np.int64)
    for k, ch in enumerate(LETTERS, 1):
        table[ord(ch)] = k
    for code in range(128, 65536):
        if not table[code] and chr(code).isalpha():
            table[code] = _OTHER
    return table


_TABLE = _letter_table()


def trigrams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All trigrams of letter numbers of all lines, and where each line's begin (with the end)."""
    joined = ("\n".join(lines) + "\n").lower() if lines else ""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _TABLE[np.minimum(codes, 65535)]
    breaks = np.flatnonzero(codes == 10)
    first = np.r_[0, breaks + 1]
    keep = (letter != _SPACE) | (np.r_[1, letter[:-1]] != _SPACE) | (codes == 10)  # one space between words
    at = np.cumsum(keep) - keep
    starts = np.r_[at, keep.sum()][np.minimum(first, len(codes))]
    letter = letter[keep]
    if len(letter) < 3:
        return np.zeros(0, np.int64), np.zeros(len(lines) + 1, np.int64)
    grams = letter[:-2] * _SIZE * _SIZE + letter[1:-1] * _SIZE + letter[2:]
    return grams, np.minimum(starts, len(grams))


def letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), size=(_SIZE, DIMENSION))


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bound vectors of trigrams: the letters' vectors permuted by place, multiplied."""
    letters = letter_vectors()
    a, b, c = grams // (_SIZE * _SIZE), grams // _SIZE % _SIZE, grams % _SIZE
    return np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]


class Prototypes:
    """Centred language prototypes, as one score for each trigram seen in training and language."""

    def __init__(self, texts: dict[str, list[str]]):
        counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for lang in LANGUAGES:
            grams, _ = trigrams([*texts.get(lang, []), STARTER[lang]])
            counts[lang] = np.unique(grams, return_counts=True)
        self.grams = np.unique(np.concatenate([g for g, _ in counts.values()]))
        vectors = gram_vectors(self.grams)
        bundles = []
        for lang in LANGUAGES:
            weight = np.zeros(len(self.grams), np.float32)
            g, n = counts[lang]
            weight[np.searchsorted(self.grams, g)] = np.sqrt(n)
            bundle = weight @ vectors
            bundles.append(bundle / np.linalg.norm(bundle))
        centred = np.array(bundles) - np.mean(bundles, axis=0)
        centred /= np.linalg.norm(centred, axis=1, keepdims=True)
        self.values = (vectors @ centred.T.astype(np.float32)) / np.float32(np.sqrt(DIMENSION))

    def table(self) -> np.ndarray:
        full = np.zeros((_SIZE**3, len(LANGUAGES)), np.float32)
        full[self.grams] = self.values
        return full


def score_lines(lines: list[str], table: np.ndarray, count_other: bool = False) -> tuple[np.ndarray, ...]:
    """Trigrams of each line and, for each language, the dot product of bundle and prototype.

    With ``count_other`` also the trigrams whose middle letter is of another script.
    """
    sizes, scores, other = [np.zeros(0, np.int64)], [np.zeros((0, table.shape[1]))], [np.zeros(0, np.int64)]
    cuts, total = [0], 0
    for k, line in enumerate(lines):  # bounds the memory, not the lines
        total += len(line)
        if total > 1_000_000:
            cuts.append(k + 1)
            total = 0
    cuts.append(len(lines))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if lo == hi:
            continue
        grams, starts = trigrams(lines[lo:hi])
        sums = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(table[grams], axis=0, dtype=np.float64)])
        scores.append(sums[starts[1:]] - sums[starts[:-1]])
        sizes.append(np.diff(starts))
        if count_other:
            strange = np.r_[0, np.cumsum(grams // _SIZE % _SIZE == _OTHER)]
            other.append(strange[starts[1:]] - strange[starts[:-1]])
    found = (np.concatenate(sizes), np.concatenate(scores))
    return (*found, np.concatenate(other)) if count_other else found


def named_language(label: str | None) -> str | None:
    """The two-letter code that a label stands for; None if it names none of the languages told apart."""
    head = (label or "").strip().lower().replace("_", "-").split("-")[0]
    return next((lang for lang, names in NAMES.items() if head in names.split()), None)


def named_column(label: Column) -> Column:
    """``named_language`` as a column; an unknown label is null."""
    head = F.element_at(F.split(F.regexp_replace(F.lower(F.trim(label)), "_", "-"), "-"), 1)
    out = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        out = F.when(head.isin(names.split()), lang).otherwise(out)
    return out


@dataclass
class Model:
    """What scoring needs: numbers of each trigram and language, the scale of confidence, usual scores of a trigram."""

    grams: np.ndarray
    values: np.ndarray
    scale: float
    usual: np.ndarray

    def table(self) -> np.ndarray:
        full = np.zeros((_SIZE**3, len(LANGUAGES)), np.float32)
        full[self.grams] = self.values
        return full


def probabilities(scores: np.ndarray, scale: float) -> np.ndarray:
    x = scores * scale
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def calibrated(prototypes: Prototypes, texts: dict[str, list[str]]) -> Model:
    """The scale under which the sample's lines are likeliest, and each language's mean score of a trigram on its own pages."""
    table, usual, all_scores, truth = prototypes.table(), np.zeros(len(LANGUAGES)), [], []
    for k, lang in enumerate(LANGUAGES):
        lines = [x for t in texts.get(lang, []) for x in t.split("\n") if len(x) > 40] or [STARTER[lang]]
        sizes, scores = score_lines(lines, table)
        usual[k] = scores[:, k].sum() / max(1, sizes.sum())
        all_scores.append(scores)
        truth.append(np.full(len(lines), k))
    scores, right = np.concatenate(all_scores), np.concatenate(truth)
    likely = [np.log(np.maximum(probabilities(scores, s)[np.arange(len(right)), right], 1e-6)).sum() for s in SCALES]
    return Model(prototypes.grams, prototypes.values, SCALES[int(np.argmax(likely))], usual)


def fit(docs: DataFrame, pages: int = SAMPLE_PAGES) -> Model:
    """The model of at most ``pages`` labelled pages a language; pages that look like another one are dropped after a first pass."""
    labelled = docs.select("doc_id", named_column(F.col("lang")).alias("known")).where("known IS NOT NULL AND doc_id IS NOT NULL")
    order = Window.partitionBy("known").orderBy(F.xxhash64("doc_id"), "doc_id")  # every task keeps ``pages`` rows of a language
    best = labelled.withColumn("k", F.row_number().over(order)).where(F.col("k") <= pages).select("doc_id", "known")
    sample = docs.select("doc_id", "content_text").join(F.broadcast(best), "doc_id").distinct()  # len(LANGUAGES) * pages rows
    texts: dict[str, list[str]] = {lang: [] for lang in LANGUAGES}
    for r in sorted(sample.collect(), key=lambda r: r.doc_id):
        texts[r.known].append(r.content_text or "")
    first = Prototypes(texts).table()
    agreed = {}
    for k, (lang, some) in enumerate(texts.items()):
        _, scores = score_lines([t.replace("\n", " ") for t in some], first)
        agreed[lang] = [t for t, s in zip(some, scores, strict=True) if s.argmax() == k]
    return calibrated(Prototypes(agreed), agreed)


def verdicts(sizes: np.ndarray, scores: np.ndarray, foreign: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """``(language numbers, confidence)`` of texts; -1 for none of the languages. ``foreign``: trigrams of other scripts."""
    best = scores.argmax(axis=1)
    at = np.arange(len(best))
    share = scores[at, best] / np.maximum(sizes, 1) / np.maximum(model.usual[best], 1e-9)
    none = (scores[at, best] <= 0) | (foreign > OTHER_SCRIPT * sizes) | ((sizes >= LEAST_TRIGRAMS) & (share < LEAST_SHARE))
    sure = probabilities(scores, model.scale)[at, best]
    return np.where(none, -1, best), np.where(none, 1 - np.clip(share, 0, 1) * sure, sure)


def _page_rows(model):
    made: list[np.ndarray] = []
    codes = np.array([*LANGUAGES, UNKNOWN], dtype=object)

    def run(j: Judged, batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(model.value.table())
        some = np.flatnonzero(~j.boiler)
        sizes, scores, foreign = score_lines([j.text[i] for i in some], made[0], count_other=True)
        row, prose = j.row[some], j.prose[some]
        weight = np.where(prose, 1.0, 0.001)  # headings and code count only on pages without prose
        n = batch.num_rows

        def summed(x):
            return np.bincount(row, x * weight, minlength=n)

        page = np.stack([summed(scores[:, k]) for k in range(len(LANGUAGES))], axis=1) if len(some) else np.zeros((n, len(LANGUAGES)))
        page_size, words = summed(sizes), np.bincount(row, j.words[some], minlength=n)
        main, main_sure = verdicts(page_size * np.where(page_size < 1, 1000, 1), page * np.where(page_size < 1, 1000, 1)[:, None], summed(foreign), model.value)
        line, line_sure = verdicts(sizes, scores, foreign, model.value)
        other = np.flatnonzero(prose & (line != main[row]))
        pages = np.flatnonzero(page_size > 0)
        at = np.r_[pages, row[other]]
        number = np.r_[np.full(len(pages), -1), j.number[some][other]]
        take = pa.array(at)
        columns = [
            batch.column("doc_id").take(take), pa.array(number.astype(np.int32)), pa.array(codes[np.r_[main[pages], line[other]]], pa.string()),
            pa.array(np.r_[main_sure[pages], line_sure[other]]), pa.array(words[at].astype(np.int32)), batch.column("named").take(take),
        ]
        return pa.RecordBatch.from_arrays(columns, _COLUMNS)

    return run


def page_languages(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, lang, confidence, words, named``: each page's main language and its lines of prose in another.

    ``line_no`` is -1 for the page, whose score is the sum over its lines of main content,
    prose first: headings and code count only on pages without prose. Pages without
    letters in the main content, or with a null text, have no row. ``words`` is the number
    of words of the page's main content, ``named`` the language that its label names.
    ``lang`` is ``und`` where a text is in none of the languages told apart.
    """
    site = SiteLines(docs)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    pages = docs.where("doc_id IS NOT NULL").select(
        "doc_id", canonical_host(F.col("url")).alias("host"), "title", F.coalesce("content_text", F.lit("")).alias("content_text"),
        named_column(F.col("lang")).alias("named"),
    )
    return site.run(pages, _page_rows(model), FOUND_SCHEMA)


def wrong_labels(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, lang``: pages whose label is missing or wrong, and lines of prose in another language.

    Only verdicts for one of the languages told apart contradict a label or a page's language.
    """
    found = page_languages(docs).where(F.col("lang") != UNKNOWN)
    wrong = F.col("named").isNull() | (F.col("named") != F.col("lang"))
    keep = (F.col("line_no") >= 0) | (wrong & (F.col("words") >= LEAST_WORDS))
    return found.where(keep).select("doc_id", "line_no", "lang")
