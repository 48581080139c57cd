"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Training looks at a bounded sample of the labelled documents (``TRAIN_DOCS``, by a
hash of the id, both classes at the same rate):

1. Lexicon. Every word counts through its first 4, 5 and 6 letters and as a whole,
   each hashed to one of CELLS cells. Tasks count the documents of either class per
   cell and fold, Spark adds them up. Cells that many toxic and few other documents
   use are the lexicon; no word list is given.
2. Features, a dozen per document (``FEATURES``): densities of the lexicon in two
   tiers, mean and largest log odds, second persons and their distance to lexicon
   words, capitals, punctuation, obfuscation (digits and signs for letters, letters
   repeated, spelled-out words), length. A training document's lexicon is learned
   from the other folds, so its own words don't vouch for it.
3. Trees on second-order gradients over binned features, one fit per fold for
   scores out of fold and one on all rows; isotonic regression of the labels on the
   scores out of fold (pool adjacent violators) makes probabilities of them.

Steps 2 and 3 run on the driver over FEATURES numbers per sampled row. Scoring is
one pass over whole texts; a long text is cut into pieces of ``PIECE`` code points
between words, whose sums are added up, so memory doesn't grow with its length.

Defined cases: null and empty texts have all features 0 and the score these get;
without labels, or with labels of one class only, every score is the share of toxic
labels (0 without any); several labels of one id count as the largest; rows of one
id are scored one by one; null ids are never learned from; other columns are not
looked at. A run of more than PIECE letters is cut into words of that length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.llm.common import mix, persisted
from cartwheel.llm.langid import held_out, letter_tables

TRAIN_DOCS = 20_000
FOLDS = 4
CELLS = 1 << 20
PREFIXES = (4, 5, 6)
LONGEST = 12                 # letters of a word that its hash looks at
PIECE = 1 << 18
NEAR = 5                     # words between a second person and a lexicon word
THRESHOLD = 0.7
ROUNDS, DEPTH, RATE, BINS, L2, LEAST = 80, 3, 0.15, 32, 1.0, 2.0

# Second persons of the languages most texts are in.
SECOND_PERSONS = ("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer "
                  "tu toi te ton ta tes vous votre vos tú ti usted ustedes vosotros").split()
# Signs that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e"}
FEATURES = ("strong_rate", "strong_log", "weak_rate", "mean_odds", "max_odds", "second_rate", "near_rate", "capitals",
            "shouted", "marks", "exclaims", "signs", "repeats", "spelled", "log_words")
SUMS = ("words", "letters", "chars", "strong", "weak", "odds", "second", "near", "capitals", "shouted", "marks", "exclaims",
        "signs", "repeats", "spelled")


# ---- words -------------------------------------------------------------------

_SIGN_TABLE: dict[str, np.ndarray] = {}


def _signs() -> np.ndarray:
    if not _SIGN_TABLE:
        table = np.zeros(0x110000, dtype=np.uint32)
        for sign, letter in SIGNS.items():
            table[ord(sign)] = ord(letter)
        _SIGN_TABLE["signs"] = table
    return _SIGN_TABLE["signs"]


@dataclass
class Words:
    """Words of some pieces of text, with per-character facts by piece."""
    piece: np.ndarray            # piece of each word
    size: np.ndarray
    cells: np.ndarray            # (words, 4): hashed prefixes and whole word, -1 where too short
    facts: dict[str, np.ndarray]


def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + code + np.uint64(1))


def words_of(pieces: list[str]) -> Words:
    letter, lower, _ = letter_tables()
    n = len(pieces)
    lengths = np.array([len(p) + 1 for p in pieces], dtype=np.int64)
    code = np.frombuffer("\n".join([*pieces, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    of = np.repeat(np.arange(n), lengths)
    is_letter = letter[code]
    sign = _signs()[code]
    inner = np.zeros(len(code), dtype=bool)                     # a sign between two letters is read as one
    if len(code) > 2:
        inner[1:-1] = (sign[1:-1] > 0) & is_letter[:-2] & is_letter[2:]
    in_word = is_letter | inner
    low = np.where(is_letter, lower[code], np.where(inner, sign, 0)).astype(np.uint64)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], in_word, [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    size = end - start
    h = np.zeros(len(start), dtype=np.uint64)
    cells = np.full((len(start), len(PREFIXES) + 1), -1, dtype=np.int64)
    active = np.arange(len(start))
    for k in range(1, LONGEST + 1):
        active = active[size[active] >= k]
        if not len(active):
            break
        h[active] = _step(h[active], low[start[active] + k - 1])
        if k in PREFIXES:
            cells[active, PREFIXES.index(k)] = (mix(h[active] + np.uint64(k)) % np.uint64(CELLS)).astype(np.int64)
    long = size >= 2
    cells[long, -1] = (mix(h[long] ^ (np.minimum(size[long], LONGEST + 1).astype(np.uint64) << np.uint64(32))) % np.uint64(CELLS)).astype(np.int64)

    upper = is_letter & (lower[code] != code)
    space = (code == 32) | ((code >= 9) & (code <= 13))
    same = np.zeros(len(code), dtype=bool)
    if len(code) > 2:
        same[2:] = is_letter[2:] & (low[2:] == low[1:-1]) & (low[2:] == low[:-2])
    piece = of[start]
    ups = np.concatenate(([0], np.cumsum(upper)))
    single = size == 1
    run = np.zeros(len(start), dtype=bool)                      # three one-letter words in a row
    if len(start) > 2:
        run[2:] = single[2:] & single[1:-1] & single[:-2] & (piece[2:] == piece[:-2])

    def by_char(mask: np.ndarray) -> np.ndarray:
        return np.bincount(of[mask], minlength=n).astype(np.float64)

    def by_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(piece[mask], minlength=n).astype(np.float64)

    facts = {
        "words": np.bincount(piece, minlength=n).astype(np.float64), "letters": by_char(is_letter), "chars": lengths - 1.0,
        "capitals": by_char(upper), "shouted": by_word(long & (ups[end] - ups[start] == size)),
        "marks": by_char(~in_word & ~space), "exclaims": by_char((code == 33) | (code == 63)),
        "signs": by_char(inner), "repeats": by_char(same), "spelled": by_word(run)}
    return Words(piece, size, cells, facts)


def _word_cell(word: str) -> int:
    return int(words_of([word]).cells[0, -1])


def pieces_of(texts: list[str | None]) -> Iterator[tuple[list[str], list[int]]]:
    """Groups of (pieces, numbers of their texts) of about PIECE code points."""
    group, numbers, held = [], [], 0
    for i, text in enumerate(texts):
        at, text = 0, text or ""
        while at < len(text):
            end = min(len(text), at + PIECE)
            if end < len(text):
                cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
                end = cut + 1 if cut > at else end
            if held and held + end - at > PIECE:
                yield group, numbers
                group, numbers, held = [], [], 0
            group.append(text[at:end])
            numbers.append(i)
            held += end - at
            at = end
    if group:
        yield group, numbers


# ---- lexicon -----------------------------------------------------------------

@dataclass
class Lexicon:
    """Log odds and tier (0 none, 1 weak, 2 strong) of every cell."""
    odds: np.ndarray
    tier: np.ndarray
    second: np.ndarray = field(default_factory=lambda: np.unique([_word_cell(w) for w in SECOND_PERSONS if len(w) > 1]))

    @staticmethod
    def of(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> "Lexicon":
        """From the documents of either class that use a cell."""
        odds = np.log((toxic + 0.5) / (n_toxic + 1.0)) - np.log((other + 0.5) / (n_other + 1.0))
        known = toxic + other >= 2
        odds = np.where(known, odds, 0.0).astype(np.float32)
        weak = known & (toxic >= max(2, 0.005 * n_toxic)) & (odds >= 2.0)
        strong = weak & (toxic >= 0.02 * n_toxic) & (odds >= 3.0)
        return Lexicon(odds, weak.astype(np.int8) + strong)


def features(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    """(texts, FEATURES)."""
    sums = {s: np.zeros(len(texts)) for s in SUMS}
    top = np.zeros(len(texts))
    for pieces, numbers in pieces_of(texts):
        w, at = words_of(pieces), np.array(numbers)
        used = w.cells >= 0
        odds = np.where(used, lexicon.odds[w.cells], -np.inf).max(axis=1, initial=-np.inf)
        odds = np.where(np.isfinite(odds), odds, 0.0)
        tier = np.where(used, lexicon.tier[w.cells], 0).max(axis=1, initial=0)
        second = np.isin(w.cells[:, -1], lexicon.second)
        n = len(pieces)
        by = {"strong": tier == 2, "weak": tier == 1, "second": second}
        place = np.flatnonzero(second)
        hits = np.flatnonzero(tier == 2)
        near = np.zeros(len(w.piece), dtype=bool)
        if len(place) and len(hits):
            after = np.searchsorted(place, hits)
            for j in (np.maximum(after - 1, 0), np.minimum(after, len(place) - 1)):
                near[hits] |= (np.abs(place[j] - hits) <= NEAR) & (w.piece[place[j]] == w.piece[hits])
        by["near"] = near
        for name, mask in by.items():
            np.add.at(sums[name], at, np.bincount(w.piece[mask], minlength=n).astype(np.float64))
        np.add.at(sums["odds"], at, np.bincount(w.piece, weights=np.clip(odds, -2.0, 2.0), minlength=n))
        np.maximum.at(top, at[w.piece], np.where(tier > 0, odds, 0.0))
        for name, values in w.facts.items():
            np.add.at(sums[name], at, values)
    words, letters, chars = (np.maximum(sums[s], 1.0) for s in ("words", "letters", "chars"))
    return np.stack([
        100 * sums["strong"] / words, np.log1p(sums["strong"]), 100 * sums["weak"] / words, sums["odds"] / words, top,
        100 * sums["second"] / words, 100 * sums["near"] / words, sums["capitals"] / letters, sums["shouted"] / words,
        sums["marks"] / chars, 100 * sums["exclaims"] / chars, 100 * sums["signs"] / words, 100 * sums["repeats"] / letters,
        sums["spelled"] / words, np.log1p(sums["words"])], axis=1)


# ---- trees and calibration -----------------------------------------------------

@dataclass
class Trees:
    """Complete trees as flat arrays: node i's children are 2 i + 1 (at most the
    threshold) and 2 i + 2."""
    base: float
    feature: np.ndarray          # (trees, 2^DEPTH - 1)
    threshold: np.ndarray
    leaf: np.ndarray             # (trees, 2^DEPTH)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (2 ** DEPTH - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the log loss: every split takes the largest gain in
    G^2 / (H + L2) over BINS quantile bins per feature."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    inner = 2 ** DEPTH - 1
    edges = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(1) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1) if len(x) else np.zeros((0, x.shape[1]), int)
    trees = Trees(float(np.log(share / (1 - share))), np.zeros((ROUNDS, inner), dtype=np.int64),
                  np.full((ROUNDS, inner), np.inf), np.zeros((ROUNDS, inner + 1)))
    raw = np.full(len(y), trees.base)
    for t in range(ROUNDS):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for depth in range(DEPTH):
            first, width = 2 ** depth - 1, 2 ** depth
            best = np.full(width, 1e-6)
            for f in range(x.shape[1]):
                cell = (node - first) * BINS + binned[:, f]
                gs = np.bincount(cell, weights=g, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1)
                hs = np.bincount(cell, weights=h, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1)
                all_g, all_h = gs[:, -1:], hs[:, -1:]
                gain = gs ** 2 / (hs + L2) + (all_g - gs) ** 2 / (all_h - hs + L2) - all_g ** 2 / (all_h + L2)
                gain[:, len(edges[f]):] = -1                        # no edge there
                gain[(hs < LEAST / 20) | (all_h - hs < LEAST / 20)] = -1
                at = gain.argmax(axis=1)
                value = gain[np.arange(width), at]
                for i in np.flatnonzero(value > best):
                    best[i] = value[i]
                    trees.feature[t, first + i], trees.threshold[t, first + i] = f, edges[f][at[i]]
            node = 2 * node + 1 + (x[np.arange(len(x)), trees.feature[t][node]] > trees.threshold[t][node])
        leaf = node - inner
        gs, hs = (np.bincount(leaf, weights=v, minlength=inner + 1) for v in (g, h))
        trees.leaf[t] = RATE * gs / (hs + L2)
        raw += trees.leaf[t][leaf]
    return trees


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the ascending least-squares fit: neighbours
    out of order are pooled."""
    distinct, at = np.unique(score, return_inverse=True)            # equal scores are one point
    blocks: list[list[float]] = []                                  # sum, weight, lowest, highest score
    for s, total, weight in zip(distinct.tolist(), np.bincount(at, weights=y).tolist(), np.bincount(at).tolist()):
        blocks.append([total, weight, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, weight, _, high = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += weight
            blocks[-1][3] = high
    knots = [(edge, b[0] / b[1]) for b in blocks for edge in dict.fromkeys((b[2], b[3]))]
    return np.array([k for k, _ in knots]), np.array([p for _, p in knots])


# ---- model -------------------------------------------------------------------

@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    share: float                 # of toxic rows in the sample

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        raw = self.trees.raw(features(texts, self.lexicon))
        return np.clip(np.interp(raw, *self.knots), 0.0, 1.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_DOCS) -> DataFrame:
    """text, toxic, fold of about ``rows`` labelled rows at most, never held out.
    Labels are drawn before texts are read; the drawn ids are broadcast."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30)).cast("double") / float(1 << 30)
    drawn = known.where(share < rows / max(1, known.count())) \
        .withColumn("fold", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fold")), F.lit(FOLDS)).cast("int"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return persisted(texts.join(F.broadcast(drawn), "doc_id").select("text", "toxic", "fold"), "toxicity-sample")   # rows ids, about


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per (fold, class, cell)."""
    counts = np.zeros((FOLDS, 2, CELLS), dtype=np.int32)
    for batch in batches:
        folds, toxic = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("fold", "toxic"))
        cells: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        for pieces, numbers in pieces_of(batch.column("text").to_pylist()):
            w = words_of(pieces)
            key = (np.array(numbers)[w.piece][:, None] * CELLS + w.cells)[w.cells >= 0]
            key = np.unique(key)
            cells.append(key % CELLS)
            owners.append(key // CELLS)
        if cells:
            key = np.unique(np.concatenate(owners) * CELLS + np.concatenate(cells))
            text, cell = key // CELLS, key % CELLS
            np.add.at(counts, (folds[text], (toxic[text] > 0).astype(int), cell), 1)
    flat = counts.reshape(-1, CELLS)
    used = np.flatnonzero(flat.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(r[used].astype(np.int64)) for r in flat]],
                                     ["cell", *_COUNTS])


_COUNTS = [f"{kind}{fold}" for fold in range(FOLDS) for kind in ("other", "toxic")]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_DOCS) -> Model:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic."""
    sample = labelled_sample(docs, labels, rows)
    sizes = {(r["fold"], r["toxic"] > 0): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = (sum(n for (_, t), n in sizes.items() if t == kind) for kind in (True, False))
    share = n_toxic / max(1, n_toxic + n_other)
    if not n_toxic or not n_other:
        nothing = np.zeros(CELLS, dtype=np.float32)
        return Model(Lexicon(nothing, nothing.astype(np.int8)), None, None, share)
    schema = "cell long, " + ", ".join(f"{c} long" for c in _COUNTS)
    found = sample.mapInArrow(_count_cells, schema).groupBy("cell").agg(*[F.sum(c).cast("int").alias(c) for c in _COUNTS]) \
        .where(" + ".join(_COUNTS) + " > 1").toPandas()                              # CELLS rows at most
    counts = np.zeros((FOLDS, 2, CELLS), dtype=np.int32)
    for fold in range(FOLDS):
        for kind, name in enumerate(("other", "toxic")):
            counts[fold, kind, found["cell"].to_numpy()] = found[f"{name}{fold}"].to_numpy()
    whole = counts.sum(axis=0)
    lexicons = [Lexicon.of(*(whole - counts[f])[::-1], n_toxic - sizes.get((f, True), 0), n_other - sizes.get((f, False), 0))
                for f in range(FOLDS)]
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)                       # FOLDS x CELLS x 5 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            texts, x = batch.column("text").to_pylist(), np.zeros((batch.num_rows, len(FEATURES)))
            for f in range(FOLDS):
                at = np.flatnonzero(folds == f)
                if len(at):
                    x[at] = features([texts[i] for i in at], shared.value[f])
            yield pa.RecordBatch.from_arrays([batch.column("fold"), batch.column("toxic"), *[pa.array(c) for c in x.T]],
                                             ["fold", "toxic", *FEATURES])

    seen = sample.mapInArrow(run, "fold int, toxic int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas() \
        .sort_values([*FEATURES, "toxic", "fold"], kind="stable")                     # reruns agree
    x, y, fold = seen[list(FEATURES)].to_numpy(), (seen["toxic"].to_numpy() > 0).astype(float), seen["fold"].to_numpy()
    out = np.zeros(len(y))
    for f in range(FOLDS):
        out[fold == f] = fit_trees(x[fold != f], y[fold != f]).raw(x[fold == f])
    return Model(Lexicon.of(whole[1], whole[0], n_toxic, n_other), fit_trees(x, y), isotonic(out, y), share)


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)                          # CELLS x 5 bytes and the trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(batch.column("text").to_pylist()))],
                                             ["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
