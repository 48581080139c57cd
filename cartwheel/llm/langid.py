"""Language identification of mixed-language text.

Model: for every learned language, log-probabilities of letter trigrams and
bigrams (hashed to CELLS cells) and the scripts it uses. Texts are taken apart
into words (maximal runs of letters). For a word

1. the script range of its first letter leaves only the languages that use that
   script (all are equal where no learned language does);
2. each language gets the sum of its letters' log-probabilities;

and Viterbi over the words, with a penalty for every change of language, labels
the text's words; neighbouring words of one label make a span. The text's
language is the one with the most letters, its score their share of all letters.

Everything is numpy over a group of texts: letters, hashes and word scores as
flat arrays, Viterbi in lockstep over texts of similar length. Texts stay where
they are read; the model (2 x CELLS x languages floats) is bounded and broadcast.

``train`` counts letters of a bounded sample: about ``TRAIN_DOCS`` labelled rows,
shared evenly by the languages (one with fewer rows than its share gives all of
them, and every language has ``TRAIN_LEAST`` if it can), chosen by a hash of their
id among all rows given.

Defined cases: null text or a text without a letter is ``und`` with score 0;
rows without id or label are not learned from; without any labelled row
everything is ``und``; an empty table gives an empty result; repeated rows are
repeated; ties go to the language first by code point; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.llm.common import mix, released, slices
from cartwheel.llm.mixing import water_fill

TRAIN_DOCS = 20_000
TRAIN_LEAST = 100            # rows of each language, however many languages there are
CELLS = 1 << 16
SWITCH_PENALTY = 12.0
GROUP_LETTERS = 1 << 18      # code points handled together
MIN_SCRIPT_SHARE = 0.01      # a language uses a script with this share of its letters

# Code point ranges of scripts, [first, after last).
SCRIPTS = {
    "latin": [(0x41, 0x5B), (0x61, 0x7B), (0xAA, 0xAB), (0xBA, 0xBB), (0xC0, 0x250), (0x1E00, 0x1F00)],
    "greek": [(0x370, 0x400), (0x1F00, 0x2000)],
    "cyrillic": [(0x400, 0x530)],
    "armenian": [(0x530, 0x590)],
    "hebrew": [(0x590, 0x600)],
    "arabic": [(0x600, 0x700), (0x750, 0x780), (0x8A0, 0x900)],
    "devanagari": [(0x900, 0x980)],
    "bengali": [(0x980, 0xA00)],
    "tamil": [(0xB80, 0xC00)],
    "thai": [(0xE00, 0xE80)],
    "georgian": [(0x10A0, 0x1100)],
    "hangul": [(0x1100, 0x1200), (0x3130, 0x3190), (0xAC00, 0xD7B0)],
    "kana": [(0x3040, 0x3100)],
    "han": [(0x3400, 0x4DC0), (0x4E00, 0xA000), (0x20000, 0x30000)],
}
N_SCRIPTS = len(SCRIPTS) + 1     # 0: any other

_TABLES: dict[str, np.ndarray] = {}


def letter_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: is it a letter; its lower case (where that is one code
    point); its script."""
    if not _TABLES:
        n = 0x110000
        letter = np.zeros(n, dtype=bool)
        lower = np.arange(n, dtype=np.uint32)
        for c in range(0x32000):
            s = chr(c)
            if s.isalpha():
                letter[c] = True
                low = s.lower()
                if len(low) == 1:
                    lower[c] = ord(low)
        script = np.zeros(n, dtype=np.int8)
        for i, ranges in enumerate(SCRIPTS.values(), 1):
            for a, b in ranges:
                script[a:b] = i
        _TABLES.update(letter=letter, lower=lower, script=script)
    return _TABLES["letter"], _TABLES["lower"], _TABLES["script"]


@dataclass
class Words:
    """Words of a group of texts: letters' feature cells and word bounds."""
    tri: np.ndarray          # cell of each letter's trigram
    bi: np.ndarray
    first: np.ndarray        # index of each word's first letter
    size: np.ndarray         # letters in each word
    script: np.ndarray       # of each word's first letter
    text: np.ndarray         # number of the text each word is in
    begin: np.ndarray        # code point offset of the word in its text


def words_of(texts: list[str]) -> Words:
    letter, lower, script = letter_tables()
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    joined = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letter[joined]
    at = np.flatnonzero(is_letter)
    code = np.where(is_letter, lower[joined], 0).astype(np.uint64)
    padded = np.concatenate((np.zeros(1, dtype=np.uint64), code, np.zeros(1, dtype=np.uint64)))
    here, before, after = padded[at + 1], padded[at], padded[at + 2]
    bi = (mix(before * np.uint64(1 << 21) + here) >> np.uint64(48)).astype(np.int64)
    tri = (mix((before * np.uint64(1 << 21) + here) * np.uint64(1 << 21) + after + np.uint64(1 << 62)) >> np.uint64(48)).astype(np.int64)
    starts_word = np.ones(len(at), dtype=bool)
    starts_word[1:] = np.diff(at) > 1
    first = np.flatnonzero(starts_word)
    begin = at[first]
    text_start = np.concatenate(([0], np.cumsum(lengths)))
    text = np.searchsorted(text_start, begin, side="right") - 1
    return Words(tri, bi, first, np.diff(np.append(first, len(at))), script[joined[begin]], text,
                 begin - text_start[text] if len(begin) else begin)


@dataclass
class Model:
    languages: list[str]
    tri: np.ndarray          # CELLS x languages, log-probabilities
    bi: np.ndarray
    uses: np.ndarray         # scripts x languages

    def scores(self, w: Words) -> np.ndarray:
        """Words x languages."""
        if not len(w.first):
            return np.zeros((0, len(self.languages)))
        total = np.add.reduceat(self.tri[w.tri] + self.bi[w.bi], w.first, axis=0).astype(np.float64)
        candidates = self.uses[w.script]
        total[~candidates.any(axis=1)] = 0.0
        return np.where(candidates | ~candidates.any(axis=1)[:, None], total, -1e9)


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best label of every word. ``scores`` holds the texts' words one text
    after the other, ``counts`` the words of each text."""
    labels = np.zeros(len(scores), dtype=np.int16)
    order = np.argsort(-counts, kind="stable")
    counts_down = counts[order]
    start = (np.concatenate(([0], np.cumsum(counts)))[:-1])[order]
    longest = int(counts_down[0]) if len(counts_down) else 0
    active = np.searchsorted(-counts_down, -np.arange(longest), side="left")     # texts with more than t words
    back = np.zeros(scores.shape, dtype=np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    value = scores[start[:active[0]]].copy() if longest else None
    final = np.zeros(len(counts), dtype=np.int64)
    for t in range(1, longest):
        n = active[t]
        if n < len(value):
            final[n:len(value)] = value[n:].argmax(axis=1)
            value = value[:n]
        best = value.argmax(axis=1)
        jump = value[np.arange(n), best] - penalty
        stay = value >= jump[:, None]
        at = start[:n] + t
        back[at] = np.where(stay, own, best[:, None])
        value = np.where(stay, value, jump[:, None]) + scores[at]
    if longest:
        final[:len(value)] = value.argmax(axis=1)
    label = final.copy()
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = start[:n] + t
        labels[at] = label[:n]
        label[:n] = back[at, label[:n]]
    return labels


def _sample(labelled: DataFrame, rows: int) -> DataFrame:
    counts = [(r["lang"], r["n"]) for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]   # one row a language
    if sum(n for _, n in counts) <= rows:
        return labelled
    wanted = water_fill([n for _, n in counts], [1.0] * len(counts), rows, 1)
    rates = labelled.sparkSession.createDataFrame(
        [(lang, max(w, min(n, TRAIN_LEAST)) / n) for (lang, n), w in zip(counts, wanted)], "lang string, rate double")
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)).cast("double") / float(1 << 30)
    return labelled.join(F.broadcast(rates), "lang").where(share < F.col("rate")).select(*labelled.columns)


def train(labelled: DataFrame, rows: int = TRAIN_DOCS) -> Model:
    """``labelled``: doc_id, text, lang. Counts letters in tasks, adds them up in
    Spark and collects 2 x CELLS + scripts counts per language (bounded)."""
    good = labelled.where("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist())
            texts = batch.column("text").to_pylist()
            for lang in dict.fromkeys(langs.tolist()):
                if lang not in counts:
                    counts[lang] = np.zeros(2 * CELLS + N_SCRIPTS, dtype=np.int64)
                for group in _groups([t for t, x in zip(texts, langs) if x == lang]):
                    w = words_of([t for t, _ in group])
                    counts[lang][:CELLS] += np.bincount(w.tri, minlength=CELLS)
                    counts[lang][CELLS:2 * CELLS] += np.bincount(w.bi, minlength=CELLS)
                    counts[lang][2 * CELLS:] += np.bincount(w.script, weights=w.size, minlength=N_SCRIPTS).astype(np.int64)
        for lang, c in counts.items():
            cells = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells.astype(np.int32)),
                                              pa.array(c[cells])], ["lang", "cell", "n"])

    found = _sample(good, rows).mapInArrow(run, "lang string, cell int, n long") \
        .groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique(), key=lambda x: x.encode())
    counts = np.zeros((2 * CELLS + N_SCRIPTS, len(languages)))
    counts[found["cell"].to_numpy(), found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
           if len(found) else np.empty(0, dtype=int)] = found["n"].to_numpy()

    def log_share(c: np.ndarray) -> np.ndarray:
        return np.log((c + 0.5) / (c.sum(axis=0) + 0.5 * len(c))).astype(np.float32)

    scripts = counts[2 * CELLS:]
    return Model(languages, log_share(counts[:CELLS]), log_share(counts[CELLS:2 * CELLS]),
                 scripts >= MIN_SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0)))


def _groups(texts: list[str]) -> Iterator[list[tuple[str, int]]]:
    """(text, number) in groups of similar length, GROUP_LETTERS code points or
    one text each."""
    group, held = [], 0
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        if group and held + len(texts[i]) > GROUP_LETTERS:
            yield group
            group, held = [], 0
        group.append((texts[i], i))
        held += len(texts[i]) + 1
    if group:
        yield group


_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def identify_texts(model: Model, texts: list[str | None], spans: bool = True):
    """(languages, scores, spans) of every text."""
    n = len(texts)
    langs, scores, found = ["und"] * n, [0.0] * n, [[] for _ in range(n)]
    if not model.languages:
        return langs, scores, found
    k = len(model.languages)
    for group in _groups([t or "" for t in texts]):
        w = words_of([t for t, _ in group])
        counts = np.bincount(w.text, minlength=len(group)).astype(np.int64)
        labels = viterbi(model.scores(w), counts).astype(np.int64)
        letters = np.bincount(w.text * k + labels, weights=w.size, minlength=len(group) * k).reshape(len(group), k)
        total = letters.sum(axis=1)
        best = letters.argmax(axis=1)
        for j in np.flatnonzero(total):
            i = group[j][1]
            langs[i], scores[i] = model.languages[best[j]], float(letters[j, best[j]] / total[j])
        if spans and len(labels):
            new = np.flatnonzero(np.concatenate(([True], (np.diff(labels) != 0) | (np.diff(w.text) != 0))))
            last = np.append(new[1:], len(labels)) - 1
            for a, b in zip(new.tolist(), last.tolist()):
                found[group[w.text[a]][1]].append({"begin": int(w.begin[a]), "end": int(w.begin[b] + w.size[b]),
                                                   "lang": model.languages[labels[a]]})
    return langs, scores, found


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, spans (code point offsets and language)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)      # 2 x CELLS x languages floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, scores, spans = identify_texts(shared.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, _SPANS)],
                ["doc_id", "lang_pred", "score", "spans"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double, "
                                "spans array<struct<begin:int,end:int,lang:string>>")


def keep_identified(docs: DataFrame, model: Model, min_share: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, in which one language has ``min_share`` of
    the letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, scores, _ = identify_texts(shared.value, batch.column(at).to_pylist(), spans=False)
            yield batch.filter(pa.array([x != "und" and s >= min_share for x, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(lambda batches: released(run(batches)), docs.schema)


def held_out(id_column):
    """The rows never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 == 1, F.lit(False))
