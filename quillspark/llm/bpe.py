"""Byte-level BPE by prefix-sharing tries, and its inverse."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

# The pattern that splits text before merging, with Unicode white space spelt out.
_WS = r"\t-\r \x85\xa0  -     　"
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _WS + r"\p{L}\p{N}]+|["
         + _WS + r"]+(?![^" + _WS + r"])|[" + _WS + r"]+")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Steps(dict):
    """What one more byte does to a text whose longest suffix that begins a token is known.

    By that suffix and the byte: the length of the new longest suffix, and (length, rank) of the tokens
    that end there, longest first. Filled as texts ask for it, so that no text looks up what is no token twice.
    """

    def __init__(self, rank_of: dict[bytes, int]):
        super().__init__()
        self.rank_of = rank_of
        self.prefixes = {t[:k] for t in rank_of for k in range(1, len(t) + 1)}

    def __missing__(self, key: bytes) -> tuple[int, tuple[tuple[int, int], ...]]:
        span = len(key)
        while span > 1 and key[-span:] not in self.prefixes:
            span -= 1
        ends = ((size, self.rank_of.get(key[-size:])) for size in range(span, 0, -1))
        self[key] = step = (span, tuple(e for e in ends if e[1] is not None))
        return step


class Borders(dict):
    """Answers of ``Vocabulary.adjoin`` by pair of tokens, worked out as texts ask for them."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, pair: tuple[int, int]) -> bool:
        return self.vocab.adjoin(*pair)


class Vocabulary:
    """Tokens by rank: single bytes come before merged tokens, these in order of their merge."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id_of_rank = [spec["model"]["vocab"][t] for t in raw if len(raw[t]) == 1]
        self.rank_of = {raw[t]: r for r, t in enumerate(t for t in raw if len(raw[t]) == 1)}
        self.halves: list[tuple[int, int] | None] = [None] * len(self.id_of_rank)
        self.merged: dict[tuple[int, int], int] = {}
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, joined = self.rank_of[raw[a]], self.rank_of[raw[b]], raw[a] + raw[b]
            rank = self.rank_of.setdefault(joined, len(self.halves))
            self.merged.setdefault((left, right), rank)
            if rank == len(self.halves):
                self.halves.append((left, right))
                self.id_of_rank.append(spec["model"]["vocab"][a + b])
        self.steps = Steps(self.rank_of)
        self.fits = Borders(self)

    def adjoin(self, left: int, right: int) -> bool:
        """Whether merging leaves ``left`` and ``right`` side by side, as tokens of their own.

        They would not stay apart if, on the way, the tokens at the border merged before one
        of the later merges that build ``left`` or ``right``: undo these merges from the last to
        the first and look at the border each time.
        """
        known = self.fits.get((left, right))
        if known is None:
            a, b, limit, known = left, right, len(self.halves), True
            while True:
                if self.merged.get((a, b), limit) < limit:
                    known = False
                    break
                ha, hb = self.halves[a], self.halves[b]
                if ha is None and hb is None:
                    break
                # The later merge is undone; of equal tokens the left one was merged first.
                if hb is None or (ha is not None and a > b):
                    limit, a = a, ha[1]
                else:
                    limit, b = b + 1, hb[0]
            if len(self.fits) > 250_000:
                self.fits.clear()
            self.fits[(left, right)] = known
        return known


@lru_cache(maxsize=2)
def token_bytes(file: str) -> list[bytes]:
    """Bytes of each token by id; empty for ids that are not in the file."""
    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    known = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items()}
    known |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [known.get(i, b"") for i in range(max(known) + 1)]


@lru_cache(maxsize=2)
def vocabulary(file: str) -> Vocabulary:
    return Vocabulary(file)


class Trie:
    """Distinct words, walked by prefix; a node keeps the last token of its prefix's encoding.

    The encoding of a prefix is that of a shorter prefix plus one token, so a node needs only its
    last token and the node of that shorter prefix; any word's encoding is read off backwards.
    Sorted words visit the trie depth first: the path from the root to the last word is kept,
    a new word starts where it leaves that path, and a prefix that many words of a call share
    is encoded once. So the trie takes memory for one path only. Finished words are remembered,
    ``limit`` of them at most.
    """

    def __init__(self, vocab: Vocabulary, limit: int = 120_000):
        self.vocab, self.limit = vocab, limit
        self.ids: dict[str, bytes] = {}

    def encode(self, words: set[str]) -> dict[str, bytes]:
        """Ids of each word, by word, as 32-bit numbers in one piece of memory."""
        if not self.ids or len(self.ids) > self.limit:
            self.ids = {s: array("i", [i]).tobytes() for s, i in self.vocab.special.items()}
        ids, before, vocab = self.ids, b"", self.vocab
        new = sorted((w.encode(), w) for w in words if w not in ids)
        steps, fits, id_of = vocab.steps, vocab.fits, vocab.id_of_rank
        if len(steps) > 150_000:
            steps.clear()
        # By depth: last token, depth of the prefix before it, longest suffix that begins a token.
        last, back, reach = [-1], [0], [0]
        for raw, word in new:
            depth, most = 0, min(len(raw), len(before))
            while depth < most and raw[depth] == before[depth]:
                depth += 1
            del last[depth + 1:], back[depth + 1:], reach[depth + 1:]
            span = reach[depth]
            for at in range(depth + 1, len(raw) + 1):
                span, ends = steps[raw[at - span - 1:at]]
                reach.append(span)
                for size, rank in ends:
                    if at == size:
                        break
                    if fits[last[at - size], rank]:
                        break
                last.append(rank)
                back.append(at - size)
            at, out = len(raw), []
            while at:
                out.append(id_of[last[at]])
                at = back[at]
            out.reverse()
            ids[word], before = array("i", out).tobytes(), raw
        return ids


class Encoder:
    def __init__(self, file: str):
        self.vocab = vocabulary(file)
        self.trie = Trie(self.vocab)
        self.split = regex.compile(SPLIT).findall
        special = sorted(self.vocab.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self._parts(t) for t in texts]
        ids = self.trie.encode(set().union(*parts))
        return [np.frombuffer(b"".join(map(ids.__getitem__, p)), np.int32) for p in parts]

    def _parts(self, text: str) -> list[str]:
        """Words and special tokens; no word has the text of a special token."""
        if self.special is None or not any(s in text for s in self.vocab.special):
            return self.split(text)
        out: list[str] = []
        for piece in self.special.split(text):
            out.extend([piece] if piece in self.vocab.special else self.split(piece))
        return out


@lru_cache(maxsize=2)
def encoder(file: str) -> Encoder:
    """One encoder per Python worker, so that frequent words stay known from task to task."""
    return Encoder(file)


def encode(docs: DataFrame, vocab_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): token ids of every whole text, one row per input row.

    A null or empty text has no ids. Repeated rows are encoded each; null ids stay null; further
    columns are not read. Each task keeps one trie, bounded in nodes, for the words it meets;
    a text of any length is one row. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_by = encoder(vocab_file)
        for batch in pieces(batches, max_bytes=6 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = found_by.batch(texts)
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), ids], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, vocab_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text): the text of each list of ids; unknown ids give nothing, null ids null.

    Bytes that are not UTF-8 become the replacement character.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(vocab_file)
        known = len(table)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                lists = batch.column("ids")
                flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                texts = []
                for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), lists.is_valid().to_pylist()):
                    own = flat[a:b]
                    own = own[(own >= 0) & (own < known)]
                    texts.append(b"".join(map(table.__getitem__, own.tolist())).decode("utf-8", "replace") if ok else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), lists, pa.array(texts, pa.string())], ["id", "ids", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, text string").withColumnsRenamed(
        {"id": id_col, "ids": ids_col})
