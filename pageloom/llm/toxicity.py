"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts and lexicon are folded alike: lower case, homoglyphs, full-width forms and accented
letters to plain Latin letters, digits and signs that stand in for letters to those
letters; marks and code points that show nothing are left out, wherever they stand. The automaton holds the lexicon and the exception phrases. An entry is a
word, or a stem marked by a final ``*``; a hit counts if it is a whole word of the
folded text (a stem: begins one) and lies in no exception phrase, the strongest
entry at each place. The weight of the hits, as it is and per 100 words, gives the
score by a logistic curve.

Lexicon, weights and curve come from labelled rows outside
the held-out fold, at most ``PER_CLASS`` of either label, taken by the hash of
their id. Defined cases: null and empty texts have no hit; without labelled
rows of both labels the lexicon given as parameter is used with equal weights.
Columns named as the results are replaced, others stay.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from itertools import accumulate, chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import crc_of_id, labelled_ids

PER_CLASS = 4000
#: An entry is at least this many times likelier in toxic rows, in this many of them, and rows times log odds reach this.
MIN_RATIO, MIN_ROWS, MIN_EVIDENCE = 6.0, 5, 35.0
#: Lengths of the stems that are tried besides whole words.
STEMS = (5, 6, 7)
PREDICTED_FROM = 0.3

#: Used when no labels can be had. Fixed values.
DEFAULT_LEXICON = ("idiot", "moron", "stupid", "loser", "scum", "worthless", "pathetic", "trash", "clown")
#: Phrases in which a lexicon word does no harm. Fixed values.
DEFAULT_EXCEPTIONS = ("stupid easy", "trash can", "trash bin", "class clown", "clown fish", "pond scum")

#: Letters of other scripts that look like Latin ones. Fixed values.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѕ": "s", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
#: Digits and signs written for letters. Fixed values.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}

#: Blocks of code points that show nothing, besides those of categories Cf, Mn and Me. Fixed values.
UNSEEN = ((0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF))
#: Planes in which letters, marks and signs of formatting lie.
PLANES = (range(0x20000), range(0xE0000, 0xE1000))


def _folding() -> dict[int, str]:
    """Code points whose folded form differs: letters by what they decompose to, without marks; unseen ones to nothing."""
    table = {**HOMOGLYPHS, **LOOKALIKES}
    found = {ord(c): t for c, t in table.items()}
    for code in chain(*PLANES):
        c = chr(code)
        if unicodedata.category(c) in ("Cf", "Mn", "Me") or any(a <= code <= b for a, b in UNSEEN):
            found[code] = ""
        elif code > 0x7F and code not in found:
            base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
            folded = "".join(table.get(x, x) for x in base)
            if base.isalpha() and folded.isascii() and folded != c:
                found[code] = folded
    return found


FOLDING = _folding()
#: Characters that fold to nothing, and those that fold to nothing or to several.
HIDDEN = frozenset(chr(code) for code, folded in FOLDING.items() if not folded)
RESIZED = frozenset(chr(code) for code, folded in FOLDING.items() if len(folded) != 1)
_WITHOUT_HIDDEN = dict.fromkeys(map(ord, HIDDEN))


def fold(text: str) -> str:
    """Lower case with homoglyphs, accented and full-width letters and stand-in digits as plain letters, and nothing unseen."""
    return text.lower().translate(FOLDING)


def aligned(text: str) -> tuple[str, str]:
    """The folded text and, for each of its characters, the original one it came from."""
    if text.isascii() or (len(text.lower()) == len(text) and RESIZED.isdisjoint(set(text))):
        return fold(text), text
    parts = [(fold(c), c) for c in text]
    return "".join(f for f, _ in parts), "".join(c * len(f) for f, c in parts)


class Scorer:
    """Automaton and curve; built on the driver, sent with the task's function."""

    def __init__(self, lexicon: dict[str, float], exceptions: list[str], curve: np.ndarray) -> None:
        self.lexicon, self.exceptions, self.curve, self._automaton = lexicon, sorted(set(exceptions)), curve, None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def _machine(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            entries: dict[str, list] = {}
            for word, weight in self.lexicon.items():
                entries.setdefault(fold(word.rstrip("*")), []).append((word.endswith("*"), float(weight)))
            for phrase in self.exceptions:
                entries.setdefault(fold(phrase), []).append((False, None))
            for key, kinds in entries.items():
                self._automaton.add_word(key, (len(key), kinds))
            if len(self._automaton):
                self._automaton.make_automaton()
        return self._automaton

    def hits(self, text: str) -> list[float]:
        """Weights of the whole-word hits outside exception phrases."""
        machine = self._machine()
        if not text or not len(machine):
            return []
        folded, raw = aligned(text)
        found: dict[int, tuple[int, float]] = {}
        spared = []
        for end, (size, kinds) in machine.iter(folded):
            first = end + 1 - size
            if first and raw[first - 1].isalpha():
                continue
            inner = end + 1 < len(raw) and raw[end + 1].isalpha()
            for stem, weight in kinds:
                if inner and not stem:
                    continue
                if weight is None:
                    spared.append((first, end))
                elif first not in found or weight > found[first][1]:
                    found[first] = (end, weight)
        if spared:
            # the phrase that reaches farthest of those that begin at or before a hit tells whether one covers it
            spared.sort()
            starts, reach = [x for x, _ in spared], list(accumulate((y for _, y in spared), max))
            covered = lambda a, b: (k := bisect_right(starts, a)) and b <= reach[k - 1]
            found = {a: (b, w) for a, (b, w) in found.items() if not covered(a, b)}
        return [w for _, w in found.values()]

    def inputs(self, text: str | None) -> list[float]:
        """What the curve takes: a constant, total weight, weight per 100 words, hits, strongest hit, log words."""
        weights = self.hits(text or "")
        words = len((text or "").split())
        total = sum(weights)
        return [1.0, math.log1p(total), math.log1p(100.0 * total / max(words, 20)), float(min(len(weights), 3)), float(len(weights) >= 2), math.log1p(words) / 10.0]

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(rows @ self.curve, -30, 30)))


#: Runs of letters, digits and the signs that stand in for letters inside a word: a mark at the end of a word is no part of it.
WORD = re.compile(r"[^\W_](?:[^\W_]|[@$!](?=[^\W_]))*")


def words_in(text: str) -> set[str]:
    """Folded words of a text, cut on its original characters; numbers are no words."""
    if not text.isascii() and not HIDDEN.isdisjoint(set(text)):
        text = text.translate(_WITHOUT_HIDDEN)
    return {w for w in (fold(m) for m in WORD.findall(text) if any(c.isalpha() for c in m)) if 3 <= len(w) <= 30}


def _log_odds(n_toxic: int, n_clean: int, of_toxic: int, of_clean: int) -> float:
    a, b = (n_toxic + 0.5) / (of_toxic + 1.0), (n_clean + 0.5) / (of_clean + 1.0)
    return math.log(a / b)


def logistic(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    beta = np.zeros(rows.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(rows @ beta, -30, 30)))
        slope = rows.T @ (weights * (p - labels)) + ridge * beta
        curve = (rows * (weights * p * (1 - p))[:, None]).T @ rows + ridge * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, exceptions: tuple[str, ...] = DEFAULT_EXCEPTIONS) -> Scorer:
    """Lexicon, exceptions and curve from the bounded labelled sample."""
    held_out = crc_of_id() % 4 == 2
    chosen = labelled_ids(labels, "toxic", held_out, per_class)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")

    def words_of(batches):
        import pandas as pd

        for pdf in batches:
            out = Counter()
            for label, text in zip(pdf["label"], pdf["text"], strict=True):
                words = words_in(text or "")
                stems = {w[:k] + "*" for w in words for k in STEMS if len(w) > k}
                for entry in words | stems:
                    out[entry, int(label)] += 1
            yield pd.DataFrame([(w, n * k, n * (1 - k)) for (w, k), n in out.items()], columns=["word", "toxic", "clean"])

    sizes = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    base = Scorer(dict.fromkeys(DEFAULT_LEXICON, 2.0), list(exceptions), np.array([-3.0, 1.5, 1.0, 0.5, 0.5, 0.0]))
    if not sizes.get(0) or not sizes.get(1):
        return base
    counts = (
        sample.mapInPandas(words_of, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter((F.col("toxic") >= MIN_ROWS) & (F.col("toxic") / sizes[1] > F.lit(MIN_RATIO) * (F.col("clean") + 1) / sizes[0]))
        .orderBy("word")
    )  # bounded by the sample: each entry is in MIN_ROWS of its rows
    lexicon = {}
    for r in counts.collect():
        odds = _log_odds(r["toxic"], r["clean"], sizes[1], sizes[0])
        if odds * r["toxic"] >= MIN_EVIDENCE:
            lexicon[r["word"]] = odds
    if not lexicon:
        return base
    scorer = Scorer(lexicon, list(exceptions), base.curve)

    def inputs(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"label": pdf["label"], "row": [np.array(scorer.inputs(t)).tolist() for t in pdf["text"]]})

    got = sample.mapInPandas(inputs, "label int, row array<double>").collect()
    truth = {r[0]: r[1] for r in labels.filter(~held_out).groupBy(F.col("toxic").cast("int").alias("t")).count().collect()}
    got = sorted((r["label"], list(r["row"])) for r in got)
    y = np.array([g[0] for g in got], float)
    stands_for = np.where(y == 1, truth.get(1, 1) / sizes[1], truth.get(0, 1) / sizes[0])
    scorer.curve = logistic(np.array([g[1] for g in got]), y, stands_for * len(y) / stands_for.sum())
    return scorer


def score_documents(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` with held_out, score and predicted; one pass, no shuffle of texts."""
    docs = docs.drop("held_out", "score", "predicted")
    scorer = learn(docs, labels, per_class)
    names, at = docs.columns, docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(at)
            rows = np.array([scorer.inputs(texts[k].as_py()) for k in range(len(texts))]).reshape(len(texts), len(scorer.curve))
            yield pa.record_batch([*batch.columns, pa.array(scorer.score(rows), pa.float64())], names=[*names, "score"])

    scored = docs.mapInArrow(score, f"{schema}, score double")
    return scored.withColumns({"held_out": crc_of_id() % 4 == 2, "predicted": (F.col("score") >= PREDICTED_FROM).cast("int")})
