"""Language proportions of documents: a mixture of n-gram models fitted by expectation-maximisation."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fitting reads about this many labelled documents of each language, chosen by a hash of
#: the id; prediction and everything else cover all rows and whole texts.
FIT_DOCS = 1500
BITS = 15
ROUNDS = 12
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
NO_WORD = re.compile(r"[\W\d_]+")


def grams(text: str) -> np.ndarray | None:
    """Counts of the text's hashed letter trigrams, None without letters.

    Words are runs of letters in lower case with a space on either side."""
    if not LETTER.search(text):
        return None
    text = " " + NO_WORD.sub(" ", text.lower()).strip() + " "
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    mixed = c[:-2] * np.uint32(0x9E3779B1)
    mixed += c[1:-1] * np.uint32(0x85EBCA6B)
    mixed += c[2:] * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return np.bincount(mixed >> np.uint32(32 - BITS), minlength=1 << BITS)


@dataclass(frozen=True)
class Model:
    """``probs[i]``: probability of each hashed trigram in ``langs[i]``."""

    langs: list[str]
    probs: np.ndarray


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sparse trigram counts per language of one partition."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            n = grams(text)
            if n is not None:
                sums[lang] = sums[lang] + n if lang in sums else n
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pd.DataFrame({"lang": lang, "gram": at.astype("int32"), "n": n[at].astype("int64")})


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS) -> Model:
    """Trigram models of the languages in ``lang_col`` from rows where ``usable`` holds.

    Rows without text or language teach nothing. Of each language a hash of the id picks about
    ``fit_docs`` documents. The driver gets languages times 2**BITS counts."""
    rows = docs.where(usable & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    share = rows.groupBy(F.col(lang_col).alias("lang")).agg(
        F.least(F.lit(1.0), F.lit(float(fit_docs)) / F.count(F.lit(1))).alias("share")
    ).collect()
    if not share:
        return Model([], np.zeros((0, 1 << BITS)))
    rates = F.create_map(*[x for r in share for x in (F.lit(r.lang), F.lit(r.share))])
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(1_000_003)) / 1_000_003.0
    chosen = rows.where(draw < F.element_at(rates, F.col(lang_col)))
    counted = chosen.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInPandas(
        _count, "lang string, gram int, n bigint"
    )
    table = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(r.lang for r in share)
    counts = np.zeros((len(langs), 1 << BITS))
    index = {x: i for i, x in enumerate(langs)}
    counts[table["lang"].map(index).to_numpy(dtype=int), table["gram"].to_numpy()] = table["n"]
    # a language's model leans on all languages' counts where it has few of its own
    overall = counts.sum(axis=0) + 0.5
    overall /= overall.sum()
    weight = 1.0 + 0.01 * counts.sum(axis=1, keepdims=True)
    probs = (counts + weight * overall) / (counts.sum(axis=1, keepdims=True) + weight)
    return Model(langs, probs)


def _em(p: np.ndarray, n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Mixture weights and log-likelihood of counts ``n`` under the rows of ``p``."""
    w, total = start, n.sum()
    for _ in range(ROUNDS):
        new = w * (p @ (n / (w @ p))) / total
        done = np.abs(new - w).max() < 1e-3
        w = new
        if done:
            break
    return w, float(n @ np.log(w @ p))


def proportions(model: Model, n: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(languages, proportions) of one document by its trigram counts.

    Starts from the single most likely language and adds the language that gains most
    likelihood as long as the gain exceeds half the logarithm of the document's length for
    each added proportion (the Bayesian information criterion). As the likelihood is concave
    in the proportions, a language whose slope is not positive cannot gain and is not tried."""
    at = np.flatnonzero(n)
    n, p = n[at].astype(float), model.probs[:, at]
    single = np.log(p) @ n
    chosen = [int(single.argmax())]
    w, best, total = np.ones(1), float(single.max()), n.sum()
    penalty = 0.5 * np.log(total) + 1.0
    while len(chosen) < len(model.langs):
        slope = p @ (n / (w @ p[chosen])) / total - 1
        slope[chosen] = -1
        tried = []
        for i in np.flatnonzero(slope > 1e-3):
            start = np.append(w * 0.8, 0.2)
            new, got = _em(p[[*chosen, i]], n, start)
            tried.append((got, int(i), new))
        if not tried:
            break
        got, i, new = max(tried, key=lambda x: (x[0], -x[1]))
        if got - best <= penalty:
            break
        chosen, w, best = [*chosen, i], new, got
    return chosen, w


def predicted(model: Model) -> Callable[[Column], Column]:
    """A function of a text column, giving struct(lang_pred, score, mixture)."""

    @F.pandas_udf("lang_pred string, score double, mixture map<string,double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([answer(model, t) for t in texts], columns=["lang_pred", "score", "mixture"])

    return predict


def answer(model: Model, text: str | None) -> tuple[str, float, dict[str, float]]:
    n = grams(text) if isinstance(text, str) and model.langs else None
    if n is None:
        return UNKNOWN, 0.0, {}
    chosen, w = proportions(model, n)
    w = w / w.sum()
    top = min(range(len(chosen)), key=lambda i: (-w[i], chosen[i]))
    return model.langs[chosen[top]], float(min(1.0, w[top])), {model.langs[c]: float(x) for c, x in zip(chosen, w)}


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, mixture): the language with the largest proportion, that
    proportion, and all selected languages with theirs, one row per row of ``docs``.

    ``und`` with score 0 where the text is null or has no letters, or no language was learned.
    Ties go to the first language in order. Only the text decides. Other columns are not
    read. An empty table gives an empty result."""
    found = docs.select(F.col(id_col), predicted(model)(F.col(text_col)).alias("__found"))
    return found.select(id_col, "__found.*")


def held_out(id_col: str) -> Column:
    """A quarter of all ids, never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
