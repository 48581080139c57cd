"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut into chunks of whole words where a rolling hash over the last
``ROLL`` words ends in zeros, so equal passages in different documents are cut
at the same places. A chunk is encoded once and kept in the task's bounded
cache; every document that contains it takes the ids from there. The cut is at
white space, but that alone proves nothing about a tokenizer: each join of two
chunks is re-encoded with a few words from both sides, and the two chunks'
ids must agree with that; if they don't, the context is doubled, and when it
reaches the whole of both chunks these are merged and encoded as one.

Documents stay where they are read: one narrow stage, no shuffle. Memory is one
batch of texts plus the cache (``CACHE_BYTES``). Chunks are shared by the
documents of one task; shipping every distinct chunk through a
shuffle to encode it once in the whole cluster would move more bytes than the
texts have.

Defined cases: null text is empty (no tokens, digests of nothing); an empty
table gives an empty result; repeated rows are repeated; a text without white
space is one chunk; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.llm.common import released, text_bytes, window_hashes, word_bounds, word_hashes

ROLL = 4                     # words under the rolling hash
CHUNK_BITS = 8               # a cut every 2^8 words on average
CHUNK_CACHE_BYTES = 32 << 20
WORD_CACHE_WORDS = 400_000
CONTEXT_WORDS = 1            # words on each side of a join at first


def cut_words(words: np.ndarray, bits: int = CHUNK_BITS, roll: int = ROLL) -> np.ndarray:
    """Numbers of the words that begin a chunk (word 0 not included)."""
    if len(words) <= roll:
        return np.empty(0, dtype=np.int64)
    rolling = window_hashes(words, roll)
    ends = np.flatnonzero((rolling >> np.uint64(64 - bits)) == 0) + roll
    return ends[ends < len(words)]


#: A chunk's or word's ids (little-endian unsigned 32-bit) and decoded text (UTF-8).
Encoded = tuple[bytes, bytes]


def _parts(step: dict | None, inside: str) -> list[dict]:
    """The steps of a normaliser or pre-tokeniser, one after the other."""
    if step is None:
        return []
    return [p for s in step[inside] for p in _parts(s, inside)] if step["type"] == "Sequence" else [step]


def _drops_white_space(step: dict) -> bool:
    if step["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer"):
        return True
    if step["type"] != "Split" or step["behavior"] != "Removed" or not step["invert"] or "Regex" not in step["pattern"]:
        return False
    # what matches is kept: nothing in white space, no match across it
    kept = [m for text in (" \t\n\v\f\r", "a b", "1 2", ". .", "a 's", "' s", "é\té") for m in regex.findall(step["pattern"]["Regex"], text)]
    return not any(set(m) & set(" \t\n\v\f\r") for m in kept if isinstance(m, str))


def words_stand_alone(vocabulary: dict) -> bool:
    """Can a text's ids be put together from those of its words? So it is where the
    normaliser works on single characters, on NFC (which never crosses a space) or
    on runs of white space, the pre-tokeniser drops white space first and adds
    nothing for the place of a word in the text, no added token has white space in it,
    and nothing follows (no post-processor; no decoder: tokens joined by a space)."""
    def harmless(step: dict) -> bool:
        return step["type"] in ("NFC", "Lowercase") or step["type"] == "Replace" and step["pattern"].get("Regex") == r"\s+" and step["content"] == " "

    normal, split = _parts(vocabulary.get("normalizer"), "normalizers"), _parts(vocabulary.get("pre_tokenizer"), "pretokenizers")
    later = all(s["type"] in ("Punctuation", "Digits") or s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in split[1:])
    added = all(not set(t["content"]) & set(" \t\n\v\f\r") and not t["lstrip"] and not t["rstrip"] for t in vocabulary.get("added_tokens") or [])
    return bool(split) and _drops_white_space(split[0]) and later and all(map(harmless, normal)) and added \
        and vocabulary.get("post_processor") is None and vocabulary.get("decoder") is None


class ChunkEncoder:
    """Encodes texts with one ``tokenizers`` tokenizer through a chunk cache.

    ``by_word``: a chunk that isn't known is put together from its words, each
    encoded once, where ``words_stand_alone`` finds in the vocabulary that words
    don't influence each other; else it is encoded as it is."""

    def __init__(self, tokenizer, by_word: bool = True):
        self.tokenizer, self.by_word = tokenizer, by_word and words_stand_alone(json.loads(tokenizer.to_str()))
        self.chunks: dict[bytes, Encoded] = {}
        self.word_ids: dict[bytes, bytes] = {}
        self.word_texts: dict[bytes, bytes] = {}
        self.silent: set[bytes] = set()      # words without tokens
        self.held = self.encoded = self.reused = self.merged = 0
        self.joins_by_space = tokenizer.decoder is None

    def forget(self) -> None:
        """Empty the caches (a worker outlives its tasks)."""
        self.chunks, self.held = {}, 0
        self.word_ids, self.word_texts, self.silent = {}, {}, set()

    def library(self, texts: list[bytes]) -> list[Encoded]:
        """(ids, decoded) of each text straight from the library."""
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        decode = self.tokenizer.decode
        return [(np.array(e.ids, dtype="<u4").tobytes(), decode(e.ids, skip_special_tokens=False).encode()) for e in found]

    def _chunks(self, new: list[bytes]) -> list[Encoded]:
        if not (self.by_word and self.joins_by_space):
            return self.library(new)
        if len(self.word_ids) > WORD_CACHE_WORDS:
            self.word_ids, self.word_texts, self.silent = {}, {}, set()
        split = [c.split() for c in new]
        fresh = list(set().union(*split).difference(self.word_ids))
        for w, (ids, decoded) in zip(fresh, self.library(fresh)):
            self.word_ids[w], self.word_texts[w] = ids, decoded
            if not ids:
                self.silent.add(w)
        out = []
        for ws in split:
            if self.silent:
                ws = [w for w in ws if w not in self.silent]
            out.append((b"".join(map(self.word_ids.__getitem__, ws)), b" ".join(map(self.word_texts.__getitem__, ws))))
        return out

    def encode(self, texts: list[bytes]) -> list[Encoded]:
        """(ids, decoded) of every text; equal to the library's."""
        pieces, wanted = [], {}
        for text in texts:
            data = np.frombuffer(text, dtype=np.uint8)
            start, end = word_bounds(data)
            cuts = start[cut_words(word_hashes(data, start, end))]
            edges = [0, *cuts.tolist(), len(text)]
            chunks = [text[a:b] for a, b in zip(edges, edges[1:]) if b > a]
            pieces.append(chunks)
            for c in chunks:
                if c in wanted:
                    self.reused += 1
                else:
                    wanted[c] = self.chunks.get(c)
                    self.reused += wanted[c] is not None
        new = [c for c, hit in wanted.items() if hit is None]
        self.encoded += len(new)
        for c, value in zip(new, self._chunks(new)):
            wanted[c] = value
            self.chunks[c] = value
            self.held += 200 + len(c) + len(value[0]) + len(value[1])
        if self.held > CHUNK_CACHE_BYTES:
            self.chunks, self.held = {}, 0
        agreed = self._agreed({(a, b) for chunks in pieces for a, b in zip(chunks, chunks[1:])}, wanted)
        return [self._joined(chunks, agreed, wanted) for chunks in pieces]

    def _agreed(self, joins: set[tuple[bytes, bytes]], wanted: dict[bytes, Encoded]) -> set[tuple[bytes, bytes]]:
        """The joins at which the two chunks' ids agree with a re-encoding."""
        good, words, todo = set(), CONTEXT_WORDS, list(joins)
        while todo:
            contexts = [(_last_words(a, words), _first_words(b, words)) for a, b in todo]
            distinct = list({x + y for x, y in contexts})
            ids = dict(zip(distinct, (e[0] for e in self.library(distinct))))
            again = []
            for (a, b), (left, right) in zip(todo, contexts):
                if _agrees(wanted[a][0], wanted[b][0], ids[left + right], left == a, right == b):
                    good.add((a, b))
                elif left != a or right != b:
                    again.append((a, b))
            todo, words = again, words * 2
        return good

    def _joined(self, chunks: list[bytes], agreed: set, wanted: dict[bytes, Encoded]) -> Encoded:
        """Chunks put together; those whose join never agreed are encoded as one."""
        parts, run = [], []
        for i, c in enumerate(chunks):
            run.append(c)
            if i + 1 == len(chunks) or (c, chunks[i + 1]) in agreed:
                self.merged += len(run) > 1
                parts.append(wanted[c] if len(run) == 1 else self.library([b"".join(run)])[0])
                run = []
        ids = b"".join([p[0] for p in parts])
        if self.joins_by_space:      # no decoder: tokens joined by a space
            return ids, b" ".join([p[1] for p in parts if p[0]])
        decoded = self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        return ids, decoded.encode()


def _last_words(chunk: bytes, n: int) -> bytes:
    words = chunk.rsplit(None, n)
    if len(words) <= n:
        return chunk
    return chunk[len(words[0]):]


def _first_words(chunk: bytes, n: int) -> bytes:
    words = chunk.split(None, n)
    if len(words) <= n:
        return chunk
    return chunk[:len(chunk) - len(words[-1])]


def _agrees(left: bytes, right: bytes, joined: bytes, whole_left: bool, whole_right: bool) -> bool:
    """Is ``joined`` an end of ``left`` followed by a beginning of ``right``
    (all of it where the context is the whole chunk)? Four bytes an id."""
    n = len(joined)
    for k in range(0, n + 4, 4):
        if whole_left and k != len(left) or whole_right and n - k != len(right):
            continue
        if left.endswith(joined[:k]) and right.startswith(joined[k:]):
            return True
    return False


_WORKER: dict[str, ChunkEncoder] = {}


def worker_encoder(vocabulary: str) -> ChunkEncoder:
    """One encoder per Python worker and vocabulary file."""
    if vocabulary not in _WORKER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _WORKER[vocabulary] = ChunkEncoder(tokenizer)
    return _WORKER[vocabulary]


GROUP_BYTES = 1 << 20        # texts encoded together


def _groups(column: pa.Array) -> Iterator[list[bytes]]:
    group, held = [], 0
    for i in range(len(column)):
        text = text_bytes(column, i)
        group.append(text)
        held += len(text)
        if held >= GROUP_BYTES:
            yield group
            group, held = [], 0
    if group:
        yield group


#: What can be returned of a text: Arrow type, Spark type, value from (ids, decoded).
OUTPUTS = {
    "n_tokens": (pa.int64(), "long", lambda ids, decoded: len(ids) // 4),
    "ids": (pa.binary(), "binary", lambda ids, decoded: ids),
    "ids_sha256": (pa.string(), "string", lambda ids, decoded: hashlib.sha256(ids).hexdigest()),
    "decoded": (pa.string(), "string", lambda ids, decoded: decoded.decode()),
    "decoded_sha256": (pa.string(), "string", lambda ids, decoded: hashlib.sha256(decoded).hexdigest()),
}


def encode_documents(docs: DataFrame, vocabulary: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``outputs`` (OUTPUTS) of every row. ``ids`` are little-endian
    unsigned 32-bit integers; digests are taken in the task, so neither ids nor
    texts need to leave it."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    made = [OUTPUTS[o] for o in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for batch in batches:
            at = 0
            for group in _groups(batch.column("text")):
                encoded = encoder.encode(group)
                arrays = [pa.array([value(*e) for e in encoded], type=kind) for kind, _, value in made]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(group)), *arrays], ["doc_id", *outputs])
                at += len(group)
        encoder.forget()

    return rows.mapInArrow(lambda batches: released(run(batches)), ", ".join([f"doc_id {id_type}", *(f"{o} {m[1]}" for o, m in zip(outputs, made))]))
