"""Token-ID output: documents as token ids in checksummed blocks, in ascending document order.

Documents are range-partitioned by id. Each task tokenizes its range in order and writes chunks of whole documents; a
chunk is a row of a Parquet table with the documents' ids and lengths and the blocks of ``coder``. The table is the file
format: any chunk can be read alone, and Spark's commit protocol keeps it whole if executors are lost. Ids of documents
stay in Arrow arrays of their own type throughout.

With ``pieces``, a text is cut at ASCII white space, a piece also before the punctuation at its end, and each distinct
piece of a chunk is tokenized once: many pieces of letters in one call, and those without the steps of the tokenizer that
leave them as they are. That gives the ids of the whole text, as this tokenizer lower-cases, and neither its normaliser
nor its pre-tokenizer looks across those places; ``pieces=False`` hands whole texts to the tokenizer instead, as other
tokenizers need.

Null and empty texts have the end id alone. A text of any length is whole in its chunk, which then is as large as the text
needs, in blocks of ``coder.BLOCK`` ids. Repeated rows are written each; equal ids go by text. Null ids come first. An
empty table gives an empty one. Extra columns aren't read, so their names don't matter.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import materialise
from . import coder
from .common import give_back, narrow, small_batches, table

#: Bytes of text of a chunk, about; pieces in one string for the tokenizer, and strings in one call.
CHUNK, JOINED, CALL = 1 << 23, 256, 64
#: Pieces of letters that Unicode normalisation leaves alone, without and with those of Latin-1; what punctuation is cut from.
ASCII, LATIN, BEFORE = r"^[a-z]+$", r"^[a-zA-Z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+$", r"[a-zA-Z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]$"
#: How special tokens begin. They are matched as they are written, and whole.
SPECIAL = "<|"


@dataclass(frozen=True)
class Tokenizer:
    """file: a tokenizers JSON file, found on each executor. end: the id appended to each document. pieces: see above."""

    file: str
    end: int
    vocabulary: int
    pieces: bool = True


def _spread(flat: np.ndarray, start: np.ndarray, at: np.ndarray, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """flat[start[i] : start[i + 1]] for each i of at, one after the other, and where each begins and the last ends."""
    sizes = np.diff(start)[at]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(ends[-1]), flat.dtype)
    for lo in range(0, len(at), step):  # bounds what stands beside the result
        n, first = sizes[lo : lo + step], ends[lo]
        last = ends[min(lo + step, len(at))]
        out[first:last] = flat[np.repeat(start[at[lo : lo + step]] - ends[lo : lo + step][: len(n)], n) + np.arange(first, last)]
    return out, ends


def _tails(words: pa.Array, keep: np.ndarray) -> pa.Array:
    """What is left of each word after its first keep bytes."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    sizes = np.diff(offsets) - keep
    ends = np.concatenate([[0], np.cumsum(sizes)])
    got = data[np.repeat(offsets[:-1] + keep - ends[:-1], sizes) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(got)])


class _Worker:
    """The tokenizer of a Python worker."""

    _made: dict[Tokenizer, _Worker] = {}

    @classmethod
    def of(cls, t: Tokenizer) -> _Worker:
        if t not in cls._made:
            cls._made[t] = cls(t)
        return cls._made[t]

    def __init__(self, t: Tokenizer) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library
        from tokenizers import pre_tokenizers

        self.library, self.spec = Library.from_file(t.file), t
        if t.pieces:
            # the same model without normaliser; words apart at the space, and bytes as it knows them where they aren't ASCII
            apart = pre_tokenizers.CharDelimiterSplit(" ")
            self.ascii, self.latin = Library(self.library.model), Library(self.library.model)
            self.ascii.pre_tokenizer = apart
            self.latin.pre_tokenizer = pre_tokenizers.Sequence([apart, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            suffix = self.library.model.end_of_word_suffix
            names = self.library.get_vocab(with_added_tokens=True)
            self.final = np.zeros(max(names.values()) + 1, bool)
            self.final[[i for name, i in names.items() if name.endswith(suffix)]] = True

    def _encode(self, texts: list[str], with_: object = None) -> list[np.ndarray]:
        """In slices: the library's results take many times the room of the ids."""
        use, out = with_ or self.library, []
        for lo in range(0, len(texts), CALL if with_ else 4096):
            found = use.encode_batch_fast(texts[lo : lo + (CALL if with_ else 4096)], add_special_tokens=False)
            out += [np.array(e.ids, np.int32) for e in found]
        return out

    def _letters(self, words: pa.Array, use: object) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words that are one piece for the model each, and their numbers; None if they turn out otherwise."""
        joined = pa.ListArray.from_arrays(np.minimum(np.arange(0, len(words) + JOINED, JOINED), len(words)).astype(np.int32), words)
        ids = np.concatenate([np.zeros(0, np.int32), *self._encode(pc.binary_join(joined, " ").to_pylist(), use)])
        ends = np.flatnonzero(self.final[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) else None

    def _each(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words: all ids, and where each word's begin and the last's end."""
        latin, plain = (pc.match_substring_regex(words, p).to_numpy(zero_copy_only=False) for p in (LATIN, ASCII))
        parts, sizes, order = [], [], []
        for mask, use in ((plain, self.ascii), (latin & ~plain, self.latin), (~latin, None)):
            own = words.filter(pa.array(mask))
            found = self._letters(pc.utf8_lower(own), use) if use else None
            if found is None:
                ids = self._encode(own.to_pylist())
                found = np.concatenate([np.zeros(0, np.int32), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))
            parts.append(found[0])
            sizes.append(found[1])
            order.append(np.flatnonzero(mask))
        flat, start = np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return _spread(flat, start, np.argsort(np.concatenate(order)))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same, with the punctuation at words' ends tokenized apart: fewer are distinct then."""
        stem = pc.ascii_rtrim(words, characters=string.punctuation)
        cut = pc.and_(pc.match_substring_regex(stem, BEFORE), pc.invert(pc.match_substring(words, SPECIAL)))
        heads = pc.if_else(cut, stem, words)
        pieces = pa.concat_arrays([heads, _tails(words, pc.binary_length(heads).to_numpy())]).dictionary_encode()
        flat, start = self._each(pieces.dictionary)
        out, ends = _spread(flat, start, pieces.indices.to_numpy().reshape(2, -1).T.ravel())
        return out, ends[::2]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id; the number of each text's."""
        if not self.spec.pieces:
            each = self._encode(texts.to_pylist())
            return np.concatenate([x for ids in each for x in (ids, [self.spec.end])] or [np.zeros(0)]).astype(np.int32), np.fromiter(map(len, each), np.int64, len(each)) + 1
        folded = pc.if_else(pc.match_substring(texts, SPECIAL), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(folded))
        coded, borders = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        del folded, split
        body, ends = _spread(*self._words(coded.dictionary), coded.indices.to_numpy())
        upto = ends[borders - borders[0]]
        return np.insert(body, upto[1:], self.spec.end), np.diff(upto) + 1


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Whole rows of (key, text), about size bytes of text at once."""
    held, some = 0, []
    for b in batches:
        ends = np.cumsum(pc.binary_length(b["text"]).to_numpy())
        at = 0
        while at < len(b):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size - held, "right")))
            some.append(b.slice(at, to - at))
            held, at = held + int(ends[to - 1] - (ends[at - 1] if at else 0)), to
            if held >= size or at < len(b):
                yield pa.Table.from_batches(some)
                held, some = 0, []
    if some:
        yield pa.Table.from_batches(some)


def write(docs: DataFrame, tokenizer: Tokenizer, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """The written table: part, first (ids of the part before this chunk), keys, sizes, n, blocks."""
    rows = small_batches(docs).select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    by = [F.col("key").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, part, first = _Worker.of(tokenizer), TaskContext.get().partitionId(), 0
        for rows in _chunks(batches, CHUNK):
            ids, sizes = worker.ids(rows["text"].combine_chunks())
            keys = rows["key"].combine_chunks()
            del rows
            give_back()  # the room of words and pieces, before that of coding
            blocks = coder.encode(ids, tokenizer.vocabulary)
            whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            columns = {"part": pa.array([part], pa.int32()), "first": pa.array([first]), "keys": whole(keys), "sizes": whole(pa.array(sizes)), "n": pa.array([len(ids)]), "blocks": whole(pa.array(blocks, pa.binary()))}
            yield pa.RecordBatch.from_pydict(columns)
            first += len(ids)
            del ids, sizes, keys, blocks, columns
            give_back()

    schema = f"part int, first long, keys array<{docs.schema[key].dataType.simpleString()}>, sizes array<long>, n long, blocks array<binary>"
    return materialise(dealt.sortWithinPartitions(*by, "text").mapInArrow(encode, schema), "tokens")


def read(written: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """key, start, n_tokens, ids_crc32 of each document, from the blocks."""
    parts = written.groupBy("part").agg(F.sum("n").alias("n"))
    # part numbers, as many as tasks wrote: a running sum over them is small
    offsets = parts.select("part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias("offset"))
    chunks = written.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("first")).alias("start"), "keys", "sizes", "blocks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 1) for b in batches for i in range(len(b))):
            ids = coder.decode(b["blocks"][0].as_py(), tokenizer.vocabulary).astype("<u4", copy=False)
            sizes = b["sizes"].flatten().to_numpy()
            ends = np.cumsum(sizes)
            view = memoryview(ids).cast("B")
            crc = np.fromiter((zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)), np.int64, len(ends))
            yield pa.RecordBatch.from_pydict({"key": b["keys"].flatten(), "start": pa.array(b["start"][0].as_py() + ends - sizes), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(crc)})
        give_back()

    kind = written.schema["keys"].dataType.elementType.simpleString()
    return chunks.mapInArrow(decode, f"key {kind}, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> Tokenizer:
    """The public word BPE; the file's place is a parameter of Tokenizer."""
    import public_tokenizers

    return Tokenizer(public_tokenizers.path("word_bpe_49k.json"), end=1, vocabulary=49408)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = default_tokenizer()
    done = read(write(narrow(table(spark, sf_dir, "documents"), "doc_id", "text"), tokenizer), tokenizer)
    return done.withColumnRenamed("key", "doc_id")
