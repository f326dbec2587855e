"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes look-alike letters and digits, so that ``1d1oт`` and ``idiot`` are one word. The lexicon is
learned from labelled documents: words that are surely likelier in toxic ones, and beginnings that many such words share or that are
such words themselves. A text's score is the weight it collects outside exception phrases, normalised by length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Scratch, bound_batches, map_rows

#: Labelled documents that the lexicon is fitted on, at most: those with the smallest hashes of their ids.
TRAIN_ROWS = 12_000
#: A term must be so many times likelier in toxic documents, with the confidence of so many standard deviations.
LIKELIER, SIGMAS = 3.0, 3.0
#: A term must occur in so many toxic documents, and in this share of them: together with TRAIN_ROWS that bounds the lexicon.
MIN_SUPPORT, MIN_SHARE = 3, 0.02
PREFIX_MIN, PREFIX_MAX = 4, 12
#: A beginning counts for words that were never seen if so many words share it, none of them with more than this share of its
#: occurrences, and no longer beginning has nearly all of them; or if it is a term by itself, of so many letters.
WORDS_MIN, WORD_SHARE, NEARLY_ALL, STEM_MIN = 3, 0.5, 0.9, 5
HELD_OUT_FOLDS = 5

#: Look-alikes of Latin letters, and phrases in which a term means nothing bad.
CYRILLIC_GREEK = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "m", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "|": "i"}
INSIDE_WORDS = {"@": "a", "$": "s", "!": "i"}
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "class clown", "worthless currency", "stupid question")

_INSIDE = re.compile(r"(?<=\w)[@$!](?=\w)")


class _Folds(dict):
    """Folded form of a code point: a look-alike's letter, an accented letter's base, a space for what is no letter."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        if c in CYRILLIC_GREEK:
            c = CYRILLIC_GREEK[c]
        elif c in DIGITS:
            c = DIGITS[c]
        elif unicodedata.category(c) == "Cf":  # invisible
            c = ""
        else:
            c = unicodedata.normalize("NFKD", c)[0] if ord(c) < 0x250 or 0xFF00 <= ord(c) < 0xFF5F else c
            c = c.lower() if c.isalpha() else DIGITS.get(c, "" if unicodedata.combining(c) else " ")
        self[point] = c = "i" if c == "l" else c
        return c


_FOLDS = _Folds()


def fold(text: str) -> str:
    """Words of folded letters between single or several spaces, with one at either end. l and i are one letter."""
    text = text.lower()
    if "@" in text or "$" in text or "!" in text:
        text = _INSIDE.sub(lambda m: INSIDE_WORDS[m[0]], text)
    return f" {text.translate(_FOLDS)} "


@dataclass(frozen=True)
class Lexicon:
    """Weights of folded terms; one that ends in a space is a whole word, any other the beginning of one."""

    weights: dict[str, float]
    threshold: float = 1.0
    exceptions: tuple[str, ...] = field(default=EXCEPTIONS)

    @cached_property
    def _automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(f" {term}", (len(term) + 1, weight))
        for phrase in self.exceptions:
            folded = " ".join(fold(phrase).split())
            found.add_word(f" {folded} ", (len(folded) + 2, None))
        found.make_automaton()
        return found

    def raw(self, text: str | None) -> float:
        """Weight of the text's hits, divided by the square root of its length in words. Null and empty texts have 0."""
        if not text or not len(self.weights) + len(self.exceptions):
            return 0.0
        folded = fold(text)
        hits: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for last, (width, weight) in self._automaton.iter(folded):
            start = last - width + 1
            if weight is None:
                free.append((start, last))
            elif weight > hits.get(start, 0.0):  # terms that begin one word count once, by the heaviest
                hits[start] = weight
        if not hits:
            return 0.0
        total = 0.0
        end, k = -1, 0  # how far the exception phrases that began so far reach
        free.sort()
        for at in sorted(hits):
            while k < len(free) and free[k][0] <= at:
                end, k = max(end, free[k][1]), k + 1
            total += hits[at] if at >= end else 0.0
        return total / math.sqrt(10 + folded.count(" "))

    def score(self, text: str | None) -> float:
        """0 to 1; 0.5 at the threshold."""
        raw = self.raw(text)
        return raw / (raw + self.threshold) if raw else 0.0


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves no remainder modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_FOLDS == 0


def _features(rows: dict) -> list:
    """Distinct folded words of each text, and three minimum hashes of its word triples."""
    words, minima = [], ([], [], [])
    for text in rows["text"]:
        sequence = fold(text).split()
        words.append(list(dict.fromkeys(sequence)))
        triples = np.array([xxh64_intdigest(" ".join(x)) for x in zip(sequence, sequence[1:], sequence[2:])] or [xxh64_intdigest(" ".join(sequence))], dtype=np.uint64)
        for column, odd in zip(minima, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
            mixed = triples * np.uint64(odd)
            column.append(int(((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(2)).min()))
    return [rows["doc_id"], rows["toxic"], words, *minima]


def learn_lexicon(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Lexicon:
    """Fit the lexicon on labelled documents outside the held-out fold.

    Copies must not vote: of documents that share a text or one of three minimum hashes of word triples, the smallest
    id counts alone. A term must surely be likelier in toxic documents and occur in a share of them. Labels that are null, or whose document
    is missing, teach nothing; without toxic ones the lexicon is empty and every score 0.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))
    )
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = min(1.0, 2.0 * train_rows / max(1, usable.count()))  # about twice as many as are kept, so that no task sorts all labels
    train = usable.where(place < int(share * (1 << 30))).orderBy(place, "doc_id").limit(train_rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scratch = Scratch(documents.sparkSession, "toxicity")
    joined = scratch.keep(texts.join(F.broadcast(train), "doc_id").select("doc_id", "toxic", "text"))  # the one pass over all texts; train has at most train_rows rows of two numbers
    seen = scratch.keep(_labelled_features(joined))
    kept = seen.select("doc_id")
    for k in range(3):
        kept = kept.join(seen.groupBy(f"h{k}").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "doc_id", "left_semi")
    voting = scratch.keep(seen.join(kept, "doc_id", "left_semi"))
    n_bad, n_good = voting.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(F.lit(1) - F.col("toxic")), F.lit(0))).first()
    if not n_bad or not n_good:
        scratch.clear()
        return Lexicon({})
    odds = n_bad / n_good
    own = voting.select("toxic", F.explode("words").alias("word"))
    sums = [F.sum("toxic").alias("bad"), F.sum(F.lit(1) - F.col("toxic")).alias("good")]
    words = scratch.keep(own.groupBy("word").agg(*sums))
    lengths = F.sequence(F.lit(PREFIX_MIN), F.least(F.length("word"), F.lit(PREFIX_MAX)))
    beginnings = words.where(F.length("word") >= PREFIX_MIN).select(F.explode(F.transform(lengths, lambda n: F.substring("word", F.lit(1), n))).alias("term"), "bad", "good")
    terms = beginnings.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count_if(F.col("bad") > 0).alias("words"), F.max("bad").alias("most"))
    terms = terms.unionByName(words.select(F.concat("word", F.lit(" ")).alias("term"), "bad", "good", F.lit(1).cast("long").alias("words"), F.col("bad").alias("most")))
    n, share = F.col("bad") + F.col("good"), F.col("bad") / (F.col("bad") + F.col("good"))
    z = SIGMAS * SIGMAS
    surely = (share + z / (2 * n) - SIGMAS * F.sqrt(share * (1 - share) / n + z / (4 * n * n))) / (1 + z / n)
    supported = F.col("bad") >= max(MIN_SUPPORT, MIN_SHARE * n_bad)
    rows = terms.where(supported & (surely > LIKELIER * odds / (1 + LIKELIER * odds))).collect()  # few: each is in a share of the training rows
    weights = _weights({r["term"]: (r["bad"], r["good"], r["words"], r["most"]) for r in rows}, odds)
    lexicon = Lexicon(weights, _threshold(Lexicon(weights), joined.join(F.broadcast(kept), "doc_id", "left_semi")))
    scratch.clear()
    return lexicon


def _weights(strong: dict[str, tuple[int, int, int, int]], odds: float) -> dict[str, float]:
    """Of strong terms, with their toxic and other documents, words and the most documents of a word, those that are kept, with their weights."""
    longer: dict[str, int] = {}
    for term, (bad, *_) in strong.items():
        if not term.endswith(" "):
            longer[term[:-1]] = max(longer.get(term[:-1], 0), bad)
    weights: dict[str, float] = {}
    for term in sorted(strong, key=lambda t: (len(t), t)):
        bad, good, words, most = strong[term]
        if not term.endswith(" "):
            shared = words >= WORDS_MIN and most <= WORD_SHARE * bad and longer.get(term, 0) <= NEARLY_ALL * bad
            if not shared and not (len(term) >= STEM_MIN and f"{term} " in strong):
                continue
        weight = math.log((bad + 0.5) / (good + 0.5) / odds)
        shorter = [weights[term[:k]] for k in range(PREFIX_MIN, len(term)) if term[:k] in weights]
        if not shorter or weight > max(shorter) + 1.0:  # else its beginning says as much
            weights[term] = weight
    return weights


def _labelled_features(joined: DataFrame) -> DataFrame:
    """Features of labelled texts: ``doc_id, toxic, words, h0, h1, h2``."""
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("words", pa.list_(pa.string())), *((f"h{k}", pa.int64()) for k in range(3))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = _features({n: part.column(k).to_pylist() for k, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    return joined.mapInArrow(run, "doc_id long, toxic int, words array<string>, h0 long, h1 long, h2 long")


def _threshold(lexicon: Lexicon, train: DataFrame) -> float:
    """The raw score that tells the training documents' labels best: midway between two neighbours."""

    def run(rows: dict) -> list:
        return [[lexicon.raw(t) for t in rows["text"]], rows["toxic"]]

    pairs = sorted((r["raw"], r["toxic"]) for r in map_rows(train.select("text", "toxic"), "raw double, toxic int", run).collect())  # train_rows at most
    right = best = sum(t for _, t in pairs)  # all are called toxic
    at = min((raw for raw, _ in pairs if raw > 0), default=2.0) / 2
    for k, (raw, toxic) in enumerate(pairs):
        right += -1 if toxic else 1  # this one and those before are not called toxic
        following = pairs[k + 1][0] if k + 1 < len(pairs) else raw + 1.0
        if following > raw and right > best:
            best, at = right, (raw + following) / 2
    return max(at, 1e-6)


def score_documents(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text; null and empty texts score 0.

    One pass without a shuffle: the lexicon, bounded by the training rows, is sent to the workers. Labels, language
    and source are never read. Repeated rows are scored each; a null id is never held out.
    """
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)

    def run(rows: dict) -> list:
        scores = [shared.value.score(t) for t in rows["text"]]
        return [rows["doc_id"], rows["held_out"], scores, [int(s >= 0.5) for s in scores]]

    doc_id = F.col("doc_id").cast("long")
    source = documents.select(doc_id.alias("doc_id"), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return map_rows(source, "doc_id long, held_out boolean, score double, predicted int", run)


def drop_toxic(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The documents that the lexicon does not reject, with all their columns.

    Null and empty texts score 0 and stay, repeated rows stay or go together, and an empty table gives none.
    """
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)
    bound_batches(documents.sparkSession)

    def clean(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(at, 256).to_pylist() for at in range(0, len(texts), 256))
        return pa.array([shared.value.score(t) < 0.5 for part in parts for t in part], pa.bool_())

    return documents.where(F.arrow_udf(clean, "boolean")(F.coalesce("text", F.lit(""))))
