"""Alignment of two tokenizers over the same bytes: groups of tokens between the places at which tokens of both end.

A text, after one space, is encoded by a byte-level vocabulary (A, the tokenizers library) and, without the space, by a
sentencepiece model (B, which puts one before it); special tokens' strings are plain text. The bytes at which tokens end
make two ascending arrays. ``grouped`` follows them by diagonals: at the current index shift between the arrays it
compares slices of doubling length, so a stretch in which tokens agree one to one is jumped in a logarithmic number of
comparisons; where they part, the two next ends are advanced in turns until they meet, which is one irregular group and
sets the new shift.

``groups`` gives ids and group ends of each row; ``align`` the counts of links (A and B tokens of one group) within each
row, measured against the number of rows of the whole table that hold the same pair of ids linked.

Texts are cut for encoding, at spaces that follow something else than white space: no merge of either kind crosses
these (checked of the model when it is loaded; a model that has such pieces encodes texts whole), so a piece is encoded
once a task and looked up after that. Alignment runs over whole texts.

For the corpus-wide counts, a task's texts are held as chunks: each chunk's distinct pairs with the number of its rows
that hold them are a row of the stored table, next to each text's pairs as places in that list. Counts are summed by
pair, the pairs of each chunk fetch theirs, and each chunk's texts are added up. So a pair is shuffled once for each
chunk, not once for each text, and no table of pairs is broadcast or collected.

Edge cases: a null or empty text, or one whose tokens don't give back its bytes (it holds U+2581, or the model has no
token for it), has no tokens: zeros, and an empty ``groups_sha256``; equal rows count each; null doc_ids stay null; an
empty table gives an empty one; further columns are ignored. A group of very many tokens is counted by distinct ids. A
text is held whole by its task (some 100 bytes a token).
"""

from __future__ import annotations

import functools
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, stored, tidied

VOCAB_A, VOCAB_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of a chunk (a longer text is a chunk of its own), pieces that a worker remembers, and that it encodes as one text.
CHUNK, KNOWN, JOINED = 2_000_000, 600_000, 5000
#: Links of one group that are written out; above, its distinct ids are multiplied.
WRITTEN = 4096
_CUT = re.compile(r"(?<=\S)(?= )")
_ODD_GAP = re.compile(r"\s ")
MARK = "▁"


class Tokenizers:
    """Both vocabularies, and the pieces of text that they have encoded so far."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_a = np.zeros(self.a.get_vocab_size(), dtype=np.int64)
        for token, i in self.a.get_vocab().items():
            self.size_a[i] = len(token)  # one character a byte
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size_b = np.array([len(p) for p in self.bytes_b], dtype=np.int64)
        self.cut = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.forget()
        n = max(len(self.size_a), len(self.size_b))
        self.width = len(str(n - 1)) + 1
        self.marks = self._written(n)

    def _written(self, n: int) -> np.ndarray:
        """Row 4 i + k: the digits of i and the k-th of comma, bar, semicolon, nothing; zero bytes at the end."""
        out = np.zeros((n, 4, self.width), dtype=np.uint8)
        digits = np.array([str(i).encode() for i in range(n)], dtype=f"S{self.width}").view(np.uint8).reshape(n, self.width)
        out[:] = digits[:, None, :]
        size = (digits > 0).sum(axis=1)
        for k, c in enumerate(b",|;"):
            out[np.arange(n), k, size] = c
        return out.reshape(4 * n, self.width)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = [np.zeros(0, dtype=np.int64)] * 2
        self.ends = [np.zeros(1, dtype=np.int64)] * 2
        self.whole = np.zeros(0, dtype=bool)

    def pieces(self, text: str) -> list[str]:
        """Pieces of a space and the text, each without its first space."""
        if not self.cut:
            return [text]
        if "  " in text or text[0] == " " or _ODD_GAP.search(text):
            return [p[1:] for p in _CUT.split(" " + text)]
        return text.split(" ")

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece; new ones are encoded. Most are joined again for that, ``JOINED`` at a time, and the ids
        cut by bytes, which is what encoding each one gives."""
        if len(self.known) > KNOWN:
            self.forget()
        known = self.known
        new = [p for p in dict.fromkeys(pieces) if p not in known]
        joined = [p for p in new if p and not p[-1].isspace()] if self.cut else []
        for i in range(0, len(joined), JOINED):
            part = joined[i : i + JOINED]
            text = " ".join(part)
            ids = [np.array(x, dtype=np.int64) for x in (self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text))]
            if b"".join([self.bytes_b[i] for i in ids[1].tolist()]) == b" " + text.encode():
                until = np.cumsum([len(p.encode()) + 1 for p in part])
                self._learn(part, ids, [np.searchsorted(np.cumsum(size[x]), until) + 1 for size, x in zip((self.size_a, self.size_b), ids, strict=True)], np.ones(len(part), dtype=bool))
        single = [p for p in new if p not in known]
        if single:
            ids_a = [e.ids for e in self.a.encode_batch([" " + p for p in single], add_special_tokens=False)]
            ids_b = [x if p else [self.b.piece_to_id(MARK)] for p, x in zip(single, self.b.encode(single, num_threads=1), strict=True)]  # an empty piece is a lone space
            whole = [b"".join([self.bytes_b[i] for i in x]) == b" " + p.encode() for p, x in zip(single, ids_b, strict=True)]
            self._learn(single, [np.array([i for x in ids for i in x], dtype=np.int64) for ids in (ids_a, ids_b)], [np.cumsum([len(x) for x in ids]) for ids in (ids_a, ids_b)], np.array(whole))
        return np.fromiter(map(known.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def _learn(self, pieces: list[str], ids: list[np.ndarray], ends: list[np.ndarray], whole: np.ndarray) -> None:
        n = len(self.known)
        self.known.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.whole = np.concatenate([self.whole, whole])
        for side in (0, 1):
            self.ends[side] = np.concatenate([self.ends[side], len(self.ids[side]) + ends[side]])
            self.ids[side] = np.concatenate([self.ids[side], ids[side]])

    def gathered(self, numbers: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces in turn, and how many each has."""
        first = self.ends[side][numbers]
        sizes = self.ends[side][numbers + 1] - first
        return self.ids[side][np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))], sizes


@functools.lru_cache(maxsize=1)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def grouped(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each side in each group, from two ascending arrays of ends with the same last one."""
    bytes_a, bytes_b = ends_a.astype("<i8").tobytes(), ends_b.astype("<i8").tobytes()
    list_a, list_b = ends_a.tolist(), ends_b.tolist()
    stretches, parts_a, parts_b = [], [], []
    i = j = 0
    n = len(list_a)
    while i < n:
        start, wide = i, 1
        shift = 8 * (j - i)
        # slices of doubling length while they agree, then of halving length; a slice past either end has another length
        while bytes_a[8 * i : 8 * (i + wide)] == bytes_b[8 * i + shift : 8 * (i + wide) + shift]:
            i += wide
            wide *= 2
            if i >= n:
                i = n
                break
        else:
            wide //= 2
            while wide:
                if bytes_a[8 * i : 8 * (i + wide)] == bytes_b[8 * i + shift : 8 * (i + wide) + shift]:
                    i += wide
                wide //= 2
        stretches.append(i - start)
        j += i - start
        if i >= n:
            break
        first_a, first_b, a, b = i, j, list_a[i], list_b[j]
        while a != b:
            if a < b:
                i += 1
                a = list_a[i]
            else:
                j += 1
                b = list_b[j]
        i += 1
        j += 1
        parts_a.append(i - first_a)
        parts_b.append(j - first_b)
    at = np.cumsum(stretches[: len(parts_a)], dtype=np.int64) + np.arange(len(parts_a))
    sizes_a, sizes_b = (np.ones(sum(stretches) + len(parts_a), dtype=np.int64) for _ in range(2))
    sizes_a[at], sizes_b[at] = parts_a, parts_b
    return sizes_a, sizes_b


class Chunk:
    """Texts encoded and aligned as one sequence; n_a, n_b, n_groups by text."""

    def __init__(self, texts: list[str | None], both: Tokenizers):
        pieces, held = [], np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            if t:
                p = both.pieces(t)
                held[i] = len(p)
                pieces += p
        numbers, text = both.numbers(pieces), np.repeat(np.arange(len(texts)), held)
        broken = np.zeros(len(texts), dtype=bool)
        broken[text[~both.whole[numbers]]] = True
        good = ~broken[text]
        numbers, text = numbers[good], text[good]
        (self.a, sizes_a), (self.b, sizes_b) = both.gathered(numbers, 0), both.gathered(numbers, 1)
        self.n_a, self.n_b = (np.bincount(text, s, minlength=len(texts)).astype(np.int64) for s in (sizes_a, sizes_b))
        self.sizes_a, self.sizes_b = grouped(np.cumsum(both.size_a[self.a]), np.cumsum(both.size_b[self.b]))
        ends = np.cumsum(self.n_a)
        self.group_text = np.searchsorted(ends, np.cumsum(self.sizes_a) - 1, side="right")
        self.n_groups = np.bincount(self.group_text, minlength=len(texts))
        self.both = both

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups as a1,a2|b1;a3|b2,b3, or the empty string."""
        groups = len(self.sizes_a)
        ends_a, ends_b = np.cumsum(self.sizes_a), np.cumsum(self.sizes_b)
        codes = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        kind = np.zeros(len(self.a), dtype=np.int64)
        kind[ends_a - 1] = 1
        codes[np.arange(len(self.a)) + np.repeat(ends_b - self.sizes_b, self.sizes_a)] = 4 * self.a + kind
        kind = np.zeros(len(self.b), dtype=np.int64)
        kind[ends_b - 1] = 2
        last = np.cumsum(self.n_groups)[self.n_groups > 0] - 1
        kind[ends_b[last] - 1] = 3
        codes[np.arange(len(self.b)) + np.repeat(ends_a, self.sizes_b)] = 4 * self.b + kind
        written = self.both.marks[codes]
        used = np.concatenate([[0], np.cumsum((written > 0).sum(axis=1))])
        flat = written.ravel()
        flat = memoryview(flat[flat > 0])
        tokens = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        at = used[tokens].tolist() if groups else [0] * len(tokens)
        return [hashlib.sha256(flat[x:y]).hexdigest() if y > x else "" for x, y in zip(at[:-1], at[1:], strict=True)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, pair (A id times the size of B's vocabulary, and B id) and number of the links of each text and pair."""
        wide = len(self.both.size_b)
        span = len(self.both.size_a) * wide
        first_a, first_b = np.cumsum(self.sizes_a) - self.sizes_a, np.cumsum(self.sizes_b) - self.sizes_b
        many = self.sizes_a * self.sizes_b
        few = np.flatnonzero(many <= WRITTEN)
        count = many[few]
        group = np.repeat(few, count)
        k = np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)
        over = self.sizes_b[group]
        keys = self.group_text[group] * span + self.a[first_a[group] + k // over] * wide + self.b[first_b[group] + k % over]
        keys, times = np.unique(keys, return_counts=True)
        if len(few) < len(many):
            more_keys, more_times = [keys], [times]
            for g in np.flatnonzero(many > WRITTEN).tolist():
                x, m = np.unique(self.a[first_a[g] : first_a[g] + self.sizes_a[g]], return_counts=True)
                y, n = np.unique(self.b[first_b[g] : first_b[g] + self.sizes_b[g]], return_counts=True)
                more_keys.append((self.group_text[g] * span + x[:, None] * wide + y[None, :]).ravel())
                more_times.append((m[:, None] * n[None, :]).ravel())
            keys, where = np.unique(np.concatenate(more_keys), return_inverse=True)
            summed = np.zeros(len(keys), dtype=np.int64)
            np.add.at(summed, where, np.concatenate(more_times))
            times = summed
        return keys // span, keys % span, times


def _chunks(batches, chars: int = CHUNK):
    """doc_ids and texts, about so many characters at a time."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if held and held + len(t) > chars:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(t)
            held += len(t) + 16
    if ids:
        yield ids, texts


def groups(df: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, a, b (ids) and groups (tokens of A and of B in each) of each row."""

    def run(batches):
        for ids, texts in _chunks(batches):
            c = Chunk(texts, tokenizers(path_a, path_b))
            cut = lambda values, sizes: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)
            pairs = pa.StructArray.from_arrays([pa.array(c.sizes_a.astype(np.int32)), pa.array(c.sizes_b.astype(np.int32))], names=["a", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), cut(pa.array(c.a.astype(np.int32)), c.n_a), cut(pa.array(c.b.astype(np.int32)), c.n_b), cut(pairs, c.n_groups)], names=["doc_id", "a", "b", "groups"])

    return id_and_text(df).mapInArrow(run, "doc_id long, a array<int>, b array<int>, groups array<struct<a:int,b:int>>")


def _small(values: np.ndarray) -> bytes:
    """Integers in the fewest of 1, 2, 4 or 8 bytes each."""
    most = int(values.max(initial=0))
    return values.astype(next(f"<u{w}" for w in (1, 2, 4, 8) if most < 1 << (8 * w))).tobytes()


def _large(held: bytes, n: int) -> np.ndarray:
    return np.frombuffer(held, dtype=f"<u{len(held) // n}").astype(np.int64) if n else np.zeros(0, dtype=np.int64)


def align(df: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is held by most rows of all pairs of its A id),
    count_sum (rows that hold the pair, summed over the links) and groups_sha256 of each row."""
    spark = df.sparkSession

    def first(batches):
        part = TaskContext.get().partitionId() << 32
        for n, (ids, texts) in enumerate(_chunks(batches)):
            both = tokenizers(path_a, path_b)
            c = Chunk(texts, both)
            text, pair, times = c.links()
            pairs, place, rows = np.unique(pair, return_inverse=True, return_counts=True)
            links = np.zeros(len(texts), dtype=np.int64)
            np.add.at(links, text, times)
            whole = [ids, c.n_a, c.n_b, c.n_groups, links, np.bincount(text, minlength=len(texts))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part + n], pa.int64()), *(pa.array([x], pa.list_(pa.int64())) for x in whole), pa.array([c.digests()], pa.list_(pa.string())), pa.array([pairs], pa.list_(pa.int64())), pa.array([rows], pa.list_(pa.int64())), pa.array([_small(place)], pa.binary()), pa.array([_small(times)], pa.binary())],
                names=["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "held", "digest", "pairs", "rows", "place", "times"],
            )

    def last(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n = len(r["pairs"])
                count, best = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
                if n:
                    at = np.array(r["at"], dtype=np.int64)
                    count[at], best[at] = r["count"], r["best"]
                held = np.array(r["held"], dtype=np.int64)
                total = int(held.sum())
                place, times = _large(r["place"], total), _large(r["times"], total)
                text = np.repeat(np.arange(len(held)), held)
                out = []
                for value in (best, count):
                    summed = np.zeros(len(held), dtype=np.int64)
                    np.add.at(summed, text, times * value[place])
                    out.append(pa.array(summed))
                yield pa.RecordBatch.from_arrays([*(pa.array(r[c], pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *out, pa.array(r["digest"], pa.string())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    def build() -> DataFrame:
        chunks = stored(id_and_text(df).mapInArrow(first, "chunk long, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, held array<bigint>, digest array<string>, pairs array<bigint>, rows array<bigint>, place binary, times binary"), "chunks")
        listed = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "rows")).alias("at", "x")).select("chunk", "at", "x.pairs", "x.rows")
        counts = listed.groupBy("pairs").agg(F.sum("rows").alias("count"))
        wide = len(tokenizers(path_a, path_b).size_b)
        top = F.max("count").over(Window.partitionBy(F.floor(F.col("pairs") / wide)))  # at most B's vocabulary a partition
        counts = counts.withColumn("best", (F.col("count") == top).cast("long"))
        found = listed.join(counts, "pairs").groupBy("chunk").agg(*[F.collect_list(c).alias(c) for c in ("at", "count", "best")])  # a chunk's pairs
        return chunks.drop("rows").join(found, "chunk", "left").mapInArrow(last, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

    return tidied(spark, "alignment", build)
