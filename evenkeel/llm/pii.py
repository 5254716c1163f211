"""Personal data in documents: patterns, and a sequence tagger that learned from them."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.tagger import KINDS, STRIDE, WINDOW, Tagger, spans_of, symbols, tag_row

#: Training reads about this many documents, and takes so many of their windows.
FIT_DOCS = 20_000
FIT_WINDOWS = 900
# Patterns. Possessive runs and looks behind only save searching again inside a
# run that has failed; they match the same.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NAME = re.compile(r"[A-Za-z0-9._%+-]*\Z")
NOT_NAME = re.compile(r"[^A-Za-z0-9._%+-]")
MARK = re.compile(r"[0-9@]")
#: What every span that plausible() accepts has.
SIGN = re.compile(r"[0-9@]|\bat\b")
DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(DIGITS.findall(text))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: a name may start anywhere in the run before an @, so the run's start
    counts. Looking back from each @ avoids trying every start of long runs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done:
            block = text[max(done, start - 256) : start]
            cut = len(block) - len(NAME.search(block)[0])
            start -= len(block) - cut
            if cut:
                break
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all patterns, in order; matches that fail their test are dropped."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(digits_of(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def starts(text: str) -> list[int]:
    """Starts of the overlapping windows that hold a digit, an @ or the word "at". A span without
    any is not plausible, so the other windows cannot give one."""
    out, last = [], max(0, -(-(len(text) - WINDOW) // STRIDE))
    for m in SIGN.finditer(text):
        high = min(m.start() // STRIDE, last)
        low = max(0, -(-(m.start() - WINDOW + 1) // STRIDE))
        if out and high <= out[-1]:
            continue
        out.extend(range(max(low, out[-1] + 1 if out else 0), high + 1))
    return [i * STRIDE for i in out]


def padded(text: str, width: int = WINDOW) -> np.ndarray:
    out = np.zeros(width, dtype=np.int64)
    found = symbols(text[:width])
    out[: len(found)] = found
    return out


def plausible(kind: int, text: str) -> bool:
    """Tests of spans that the tagger adds."""
    digits = digits_of(text)
    if kind == 0:
        return bool(re.search(r"@|\bat\b", text)) and bool(re.search(r"\.|\bdot\b", text))
    if kind == 1:
        parts = DIGITS.findall(text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and len(text) <= 27
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 and not re.search(r"[A-Za-z]", text) and len(digits) < len(text)


def altered(kind: int, value: str, draw: int) -> str:
    """Other ways to write a value, by which the tagger learns more than the patterns."""
    if kind == 0:
        name, _, domain = value.partition("@")
        if draw // 8 % 2:  # without digits
            bare = lambda part: re.sub("[._-]?[0-9]+", "", part) or part
            name, domain = bare(name), bare(domain)
        at, dot = ((" at ", "."), (" [at] ", " dot "), ("(at)", "."), (" @ ", "."), (" at ", " dot "), (" [at] ", "."), ("(at)", "(dot)"), (" [at] ", " [dot] "))[draw % 8]
        return name + at + domain.replace(".", dot)
    if kind == 1:
        return value.replace(".", (" . ", "[.]", ",", ". ")[draw % 4])
    if kind == 2:
        return (value.replace("-", "").replace(" ", ".") if draw % 2 else value.replace("-", "/").replace(" ", "_"))
    bare = re.sub(r"^\+[0-9]+[\x20.-]?", "", value)
    return (bare, bare.replace(") ", "-").replace("(", ""), bare.replace("-", "."), "00" + value[1:])[draw % 4]


def training_windows(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_windows: int = FIT_WINDOWS) -> pd.DataFrame:
    """(text, spans) of up to ``fit_windows`` windows, from about ``fit_docs`` documents (id,
    text) that a hash of the id picks: half around a labelled span, half with digits, @ or "at" but
    without one. The labels are those of the patterns."""
    total = docs.count()
    share = min(1.0, fit_docs / max(1, total))
    draw = F.pmod(F.xxhash64("id", F.lit("pii")), F.lit(1_000_003)) / 1_000_003.0

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                spans = base_spans(text)
                for i, (a, k, b) in enumerate(spans):
                    at = max(0, a - 8 - (a * 31 + i) % 40)
                    inside = [(s - at, kk, min(e - at, WINDOW)) for s, kk, e in spans if at <= s and e <= at + WINDOW]
                    rows.append((text[at : at + WINDOW], [f"{s}:{kk}:{e}" for s, kk, e in inside], True))
                taken = [s for s in starts(text) if not any(a < s + WINDOW and s < b for a, _, b in spans)]
                rows.extend((text[s : s + WINDOW], [], False) for s in taken[:4])
                if len(text) > WINDOW:
                    rows.append((text[len(text) // 2 :][:WINDOW], [], False) if not spans else rows[-1])
            yield pd.DataFrame(rows, columns=["window", "spans", "labelled"])

    chosen = docs.where((draw < share) & F.col("text").isNotNull() & (F.length("text") > 0)).select("text")
    found = chosen.mapInPandas(cut, "window string, spans array<string>, labelled boolean")
    order = [F.xxhash64("window"), F.col("window")]
    half = fit_windows // 2
    parts = [found.where(F.col("labelled") == x).dropDuplicates(["window"]).orderBy(*order).limit(half).toPandas() for x in (True, False)]
    return pd.concat(parts, ignore_index=True)


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_windows: int = FIT_WINDOWS, epochs: int = 10) -> Tagger | None:
    """A tagger trained on the corpus's own labelled spans; None where there is none.

    Each labelled window is also shown with its spans rewritten (see :func:`altered`)."""
    rows = training_windows(docs, fit_docs, fit_windows)
    if not len(rows) or not rows["labelled"].any():
        return None
    x, y = [], []
    for i, (text, spans) in enumerate(zip(rows["window"], rows["spans"])):
        spans = sorted(tuple(int(v) for v in s.split(":")) for s in spans)
        apart = [s for j, s in enumerate(spans) if not j or s[0] >= spans[j - 1][2]]
        x.append(padded(text))
        y.append(tag_row(WINDOW, apart))
        if apart:
            out, new, at = "", [], 0
            for j, (a, k, b) in enumerate(apart):
                value = altered(k, text[a:b], i + j)
                out += text[at:a]
                new.append((len(out), k, len(out) + len(value)))
                out, at = out + value, b
            out += text[at:]
            x.append(padded(out))
            y.append(tag_row(WINDOW, [s for s in new if s[2] <= WINDOW]))
    model = Tagger()
    model.fit(np.array(x), np.array(y), epochs)
    model.p = {k: v.astype(np.float32) for k, v in model.p.items()}
    return model


def reconcile(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """The non-overlapping spans (start, kind, end, score) of greatest total score, over the
    proposals of all windows of one text."""
    found = sorted(set(found), key=lambda s: (s[2], s[0], s[1]))
    ends, best = [s[2] for s in found], [(0.0, ())]
    for i, s in enumerate(found):
        before = best[bisect.bisect_right(ends, s[0], 0, i)]
        taken = (before[0] + s[3], (i, before[1]))
        best.append(max(best[-1], taken, key=lambda b: b[0]))
    out, link = [], best[-1][1]
    while link:
        out.append(found[link[0]])
        link = link[1]
    return out[::-1]


def decoded(texts: list[str], jobs: list[tuple], model: Tagger) -> Iterator[tuple[tuple, int, int, int, float]]:
    """(job, start, kind, end, score) of each span in the windows ``jobs`` (text's place, start,
    end, ..)."""
    by_width: dict[int, list] = {}
    for job in jobs:
        by_width.setdefault(max(WINDOW, -(-(job[2] - job[1]) // STRIDE) * STRIDE), []).append(job)
    for width, same in by_width.items():
        step = max(1, 512 * WINDOW // width)
        for begin in range(0, len(same), step):
            part = same[begin : begin + step]
            tags, gain = model.decode(np.array([padded(texts[i][s:e], width) for i, s, e, *_ in part]))
            for row in np.flatnonzero(tags.any(axis=1)):
                for a, k, b in spans_of(tags[row]):
                    yield part[row], part[row][1] + a, k, part[row][1] + b, float(gain[row, a:b].sum())


def tagged(texts: list[str], model: Tagger | None) -> list[list[tuple[int, int, int, float]]]:
    """Reconciled spans of the tagger for each text.

    Windows overlap by half and each is decoded. A span that touches a window's edge inside the
    text is left to the neighbour that holds it whole; where none does, it is decoded again in
    wider and wider windows around it. The proposals of all windows of a text are reconciled."""
    found: list[list] = [[] for _ in texts]
    # (text, start, end, target): of windows made for a target only what overlaps it counts
    jobs = [(i, s, min(s + WINDOW, len(t)), None) for i, t in enumerate(texts) for s in starts(t)] if model else []
    while jobs:
        cut = []
        for (i, s, e, target), a, k, b, score in decoded(texts, jobs, model):
            if b > e or target and not (a < target[1] and target[0] < b):
                continue
            if (a == s and s > 0) or (b == e and e < len(texts[i])):
                cut.append((i, s, e, a, b))
            elif score > 0 and SIGN.search(texts[i], a, b):
                found[i].append((a, k, b, round(score, 3)))
        wider = set()
        for i, s, e, a, b in cut:
            if not any(x <= a and b <= y for x, _, y, _ in found[i]):
                pad = (e - s) // 2
                wider.add((i, max(0, a - pad), min(len(texts[i]), b + pad), (a, b)))
        jobs = sorted(wider)
    return [reconcile(f) if f else f for f in found]


def scan_personal(docs: DataFrame, model: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans), one row per row of ``docs``; spans is an array of (start, k, end, base,
    score) by start and kind, k being the place in KINDS, positions in code points.

    All pattern matches stay (base, score null). The tagger adds spans that overlap none of
    them and pass a test of their kind. A null or empty text has no spans. Repeated rows each
    have a result. An empty table gives an empty result. Other columns are not read."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 500):
                part = batch.iloc[begin : begin + 500]
                texts = [t if isinstance(t, str) else "" for t in part["text"]]
                out = []
                for text, more in zip(texts, tagged(texts, model)):
                    base = base_spans(text) if MARK.search(text) else []
                    spans = [(a, k, b, True, None) for a, k, b in base]
                    for a, k, b, score in more:
                        apart = not any(s < b and a < e for s, _, e in base)
                        if apart and plausible(k, text[a:b]):
                            spans.append((a, k, b, False, score))
                    spans.sort(key=lambda s: s[:3])
                    out.append([dict(zip(("start", "k", "end", "base", "score"), s)) for s in spans])
                yield pd.DataFrame({"id": part["id"].to_numpy(), "spans": out})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    spans = "array<struct<start:bigint,k:int,end:bigint,base:boolean,score:double>>"
    found = rows.mapInPandas(scan, f"id string, spans {spans}")
    return found.select(F.col("id").cast(kind).alias(id_col), "spans")
