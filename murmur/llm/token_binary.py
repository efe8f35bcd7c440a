"""Token ids on disk: frequency-ranked, in byte-aligned variable-length coding with separate control bytes.

``encode`` tokenizes with the tokenizers library; ``write`` counts every id of the corpus, ranks ids by falling count
and writes blocks of documents in ascending doc_id order; ``read`` decodes the blocks by numpy table lookup.

File format: a folder with ``vocab`` (rank, id, count) and ``blocks``. Each row of ``blocks`` is one block: ``shard``
(position of its file in doc_id order), ``block`` (position in the shard), ``doc_ids`` and ``lengths`` of its
documents, ``control`` (two bits an id, four ids a byte, lowest bits first: the byte length of the rank less one) and
``data`` (the ranks' little-endian bytes). Blocks hold about ``BLOCK`` ids; a longer document has a block of its own.

Edge cases: a null or empty text is one document of the end id alone; null doc_ids sort first; repeated rows and equal
doc_ids are kept, equal ones in the order of a hash of their ids; an empty table gives an empty store; further columns are
ignored.
"""

from __future__ import annotations

import functools
import json
import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.sources.storage import new_path

from .common import discard, id_and_text, sliced, stored

VOCAB = "word_bpe_49k.json"
END = 1
BLOCK = 1 << 18
#: Words whose ids a worker remembers; the older half goes first.
REMEMBERED = 800_000

BLOCKS = "shard int, block int, doc_ids array<bigint>, lengths array<bigint>, control binary, data binary"


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Remembered(dict):
    """Ids of words; a word not met before gets an empty place, to be filled before its text is joined."""

    def __init__(self):
        self.places: dict[bytes, bytearray] = {}

    def __missing__(self, word: bytes) -> bytearray:
        return self.places.setdefault(word, bytearray())


_remembered = _Remembered()
#: A full stop or comma that ends an ASCII word: a token of its own, whatever the word.
_END_MARK = re.compile(rb"(?<=[a-z])([.,])(?=[ \n]|$)")


#: Stands between words that are encoded together: one id, which no word without this character has.
_MARK = "\x01"


#: Words of the lower-case letters a to z and ß to ÿ but ÷: one pre-token each, and nothing in them is normalised.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Byte-level characters of the bytes of those words that don't stand for themselves.
_SHIFTED = (("\x9f", "\u0141"), ("\xa0", "\u0142"), ("\xad", "\u0143"))


@functools.lru_cache(maxsize=2)
def _plain_tokenizer(tok):
    """A vocabulary's tokenizer for plain words that are in byte-level characters already, split at spaces only, and which
    ids end a word; none if its ids don't show where words end, or an added token may lie in such words."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    suffix = isinstance(tok.model, models.BPE) and tok.model.end_of_word_suffix
    added = [t.content.replace(" ", "").encode() for t in tok.get_added_tokens_decoder().values()]
    if not suffix or any(not t or _PLAIN.fullmatch(t) for t in added):
        return None
    ids = tok.get_vocab()
    ends = np.zeros(max(ids.values()) + 1, dtype=bool)
    ends[[i for token, i in ids.items() if token.endswith(suffix)]] = True
    encoder = Tokenizer(tok.model)  # the model is shared, not copied
    encoder.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return encoder, ends


def _learn_plain(tok, words: list[bytes], kind: str) -> list[bytes]:
    """Ids of plain words, without the vocabulary's normaliser and pre-tokenizer; returns the words left to ``_learn``."""
    got = _plain_tokenizer(tok)
    if got is None:
        return words
    rest, plain = [], []
    for w in words:
        (plain if _PLAIN.fullmatch(w) else rest).append(w)
    encoder, is_end = got
    for first in range(0, len(plain), 20_000):
        part = plain[first : first + 20_000]
        joined = b" ".join(part).decode("latin-1")
        for byte, char in _SHIFTED:
            joined = joined.replace(byte, char)
        ids = np.array(encoder.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=kind)
        ends = np.flatnonzero(is_end[ids]) + 1
        if len(ends) == len(part):
            _remember(part, ids, ends, ends)
        else:  # the vocabulary lacks a letter
            rest += part
    return rest


def _remember(words: list[bytes], ids: np.ndarray, ends: np.ndarray, nexts: np.ndarray) -> None:
    """Keeps the ids of words that follow one another: where each one's end, and where the next one's begin."""
    data, size, at = ids.tobytes(), ids.itemsize, 0
    for w, end, after in zip(words, (ends * size).tolist(), (nexts * size).tolist(), strict=True):
        _remembered[w] = data[at:end]
        at = after


def _learn(tok, words: list[bytes], kind: str) -> None:
    """Ids of words not met before, encoded many in one call."""
    words = _learn_plain(tok, words, kind)
    between = tok.encode(_MARK, add_special_tokens=False).ids
    odd = [w for w in words if b"\x01" in w] if len(between) == 1 else words
    for w in odd:
        _remembered[w] = np.array(tok.encode(w.decode(), add_special_tokens=False).ids, dtype=kind).tobytes()
    words = [w for w in words if b"\x01" not in w] if len(between) == 1 else []
    for first in range(0, len(words), 20_000):
        part = words[first : first + 20_000]
        joined = (b" \x01 ".join(part) + b" \x01").decode()
        ids = np.array(tok.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=kind)
        ends = np.flatnonzero(ids == between[0])
        _remember(part, ids, ends, ends + 1)


#: Classes of bytes: letters and digits, marks that end words, white space, others.
_CLASS = bytes(0x61 if b < 128 and chr(b).isalnum() else 0x2E if b in b".," else 0x20 if b in b" \t\n\r\x0b\x0c" else 0x78 for b in range(256))


def _words(text: bytes) -> list[bytes]:
    """Parts of a text whose ids follow one another: this vocabulary drops white space and lower-cases, and no merge,
    normal form or special token spans ASCII white space. A text with the mark of special tokens keeps its case."""
    if b"<|" in text:
        return text.split()
    text = text.lower()
    classes = text.translate(_CLASS)
    if b"x." in classes or b".." in classes:  # next to other signs a full stop may belong with them
        return _END_MARK.sub(rb" \1", text).split()
    return text.replace(b". ", b" . ").replace(b", ", b" , ").replace(b".\n", b" .\n").replace(b",\n", b" ,\n").split()


#: What the normaliser and the pre-tokenizer of a vocabulary must be for words to be encoded one by one.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


@functools.lru_cache(maxsize=2)
def by_words(tok) -> bool:
    """Whether a tokenizer drops white space and lower-cases as ``_words`` takes for granted."""
    held = json.loads(tok.to_str())
    return all(held[part] == wanted for part, wanted in BY_WORDS.items())


def encode_texts(tok, texts: list[bytes], kind: str = "<u4") -> list[bytes]:
    """Ids of each UTF-8 text, as bytes of the numpy type ``kind``: word by word where the vocabulary allows it, else whole."""
    global _holder
    if not by_words(tok):
        return [np.array(e.ids, dtype=kind).tobytes() for a, b in sliced(texts) for e in tok.encode_batch_fast([t.decode() for t in texts[a:b]], add_special_tokens=False)]
    if _holder != (id(tok), kind):  # the words of another vocabulary or type
        _remembered.clear()
        _holder = (id(tok), kind)
    out = []
    for a, b in sliced(texts):
        split = [_words(t) for t in texts[a:b]]
        if len(_remembered) > REMEMBERED:
            for w in list(islice(_remembered, REMEMBERED // 2)):
                del _remembered[w]
        _remembered.places = places = {}
        parts = [list(map(_remembered.__getitem__, words)) for words in split]
        if places:
            _learn(tok, sorted(places), kind)
            for w, place in places.items():
                place += _remembered[w]
        out += map(b"".join, parts)
    return out


_holder: tuple = ()


def narrow(path: str) -> str:
    """The least unsigned type that holds every id of a vocabulary."""
    return "<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


def encode(df: DataFrame, path: str, end: int | None = END, kind: str = "<u4") -> DataFrame:
    """doc_id, ids (bytes of the numpy type ``kind``, the end id last) of every row."""
    tail = b"" if end is None else np.array([end], dtype=kind).tobytes()

    def run(batches):
        tok = tokenizer(path)
        for batch in batches:
            ids = [x + tail for x in encode_texts(tok, batch.column("text").cast(pa.binary()).to_pylist(), kind)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return id_and_text(df).mapInArrow(run, "doc_id long, ids binary")


def id_counts(encoded: DataFrame, kind: str = "<u4") -> DataFrame:
    """id, count over the whole corpus: each task adds up its own batches first."""

    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            got = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype=kind), minlength=len(total))
            got[: len(total)] += total
            total = got
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["id", "count"])

    return encoded.select("ids").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


#: For each control byte: the lengths of its four values, and where each begins.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.int64)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    if len(ranks) and ranks.max() <= 0xFFFF:  # two bytes at most: half the work
        v = ranks.astype("<u2")
        long = v > 0xFF
        codes = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
        codes[: len(v)] = long
        used = np.ones((len(v), 2), dtype=bool)
        used[:, 1] = long
        control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], dtype=np.uint8)
        return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 2)[used].tobytes()
    v = ranks.astype("<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    codes[: len(v)] = size - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], dtype=np.uint8)
    used = np.arange(4, dtype=np.uint8) < size[:, None]
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values: their lengths come from the table, row by row of control bytes."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), dtype=np.uint8)
    out[np.arange(4) < size[:, None]] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(-1).view("<u4")


def write(encoded: DataFrame, path: str, kind: str = "<u4") -> None:
    """Writes the store. encoded is read twice, so pass a stored table."""
    spark, size = encoded.sparkSession, np.dtype(kind).itemsize
    id_counts(encoded, kind).orderBy(F.desc("count"), "id").coalesce(1).write.parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    # one row for each id of the vocabulary at most, whatever the corpus
    ids = np.array([r.id for r in counts.orderBy(F.desc("count"), "id").select("id").collect()], dtype=np.int64)
    rank_of = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype="<u4")
    rank_of[ids] = np.arange(len(ids))
    shared = spark.sparkContext.broadcast(rank_of)
    spark.createDataFrame([(ids.tolist(),)], "ids array<bigint>").write.parquet(f"{path}/vocab")

    def run(batches):
        from pyspark import TaskContext

        shard, block, docs, lengths, parts, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def full():
            control, data = pack(shared.value[np.frombuffer(b"".join(parts), dtype=kind)])
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "doc_ids": docs, "lengths": lengths, "control": control, "data": data}], schema=schema)

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                docs.append(doc)
                lengths.append(len(ids) // size)
                parts.append(ids)
                held += lengths[-1]
                if held >= BLOCK:
                    yield full()
                    block, docs, lengths, parts, held = block + 1, [], [], [], 0
        if docs:
            yield full()

    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a doc_id that many rows share, or none have, is cut by the hash of the ids, and equal rows by their place
    order = (F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("place"))
    placed = encoded.withColumn("hash", F.xxhash64("ids")).withColumn("place", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    ordered.mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), ids of every document of the store."""
    row = spark.read.parquet(f"{path}/vocab").head()
    id_of = spark.sparkContext.broadcast(np.array(row.ids if row else [], dtype="<u4"))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = np.array(row["lengths"], dtype=np.int64)
                ids = id_of.value[unpack(row["control"], row["data"], int(n.sum()))]
                ends = np.cumsum(n)
                parts = [ids[a:b].tobytes() for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                before = row["before"] + ends - n
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(before), pa.array(parts, pa.binary())], names=["doc_id", "start", "ids"])

    # offsets: blocks add up within their shard, shards (one for each file) before one another
    sized = blocks.select("shard", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shards = sized.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before"))
    return blocks.join(offsets, ["shard", "block"]).select("doc_ids", "lengths", "control", "data", "before").mapInArrow(run, "doc_id long, start long, ids binary")


def store(df: DataFrame, vocab_path: str) -> str:
    """Encodes a table of documents into a new store in the shared folder; returns its path."""
    kind = narrow(vocab_path)
    encoded = stored(encode(df, vocab_path, kind=kind), "token-ids")
    path = new_path(df.sparkSession, "token-store")
    write(encoded, path, kind)
    discard(encoded)
    return path
