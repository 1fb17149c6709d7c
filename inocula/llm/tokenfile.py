"""Token ids in Arrow files of fixed-size-list batches.

A data set is a folder of file pairs.  File k of a data set holds the ids of
a range of documents in ascending order:

``<name>.ids.arrow``   Arrow IPC file.  Columns ``ids`` (fixed-size list of
        uint16, or uint32 where the vocabulary needs it) and ``mask``
        (fixed-size list of bool), both of ``length`` elements a row; the
        stream of ids runs on from row to row, and the last row of a file is
        filled with id 0 under mask false.  All batches but the last have
        ``rows_per_batch`` rows.  Buffers are not compressed, so a mapped
        file gives any sequence without a copy: row r is in batch
        r // rows_per_batch.
``<name>.docs.arrow``  Arrow IPC file: doc_id, start (in this file), n_tokens.

The writer sorts the documents by range partitioning, so each task writes one
file pair from a stream of batches.  A file name is new for each attempt, and
the manifest (Parquet, written by Spark, hence only of tasks that succeeded)
names the files that count: a task that is run again after an executor was
lost leaves no half of a data set.

Defined results: null text counts as empty; every document ends with
``end_id``, so none has no ids; documents with equal doc_id stand next to
each other in order of their text; null doc_ids come first; an empty table
gives an empty data set.
"""

from __future__ import annotations

import array
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import SPACE
from .common import held, shared_path, stored, utf8, values

LENGTH = 2048
ROWS_PER_BATCH = 64
CACHE = 3 << 18

# str.split() takes these for white space, the tokenizer does not
_NO_SPACE = "\x1c\x1d\x1e\x1f"
_WORDS = re.compile(f"[^{SPACE}]+")


class WordIds(dict):
    """White-space separated word -> its ids, as little-endian uint32 bytes.

    The tokenizer drops white space and never joins over it, so a text's ids
    are its words' ids in order.  Two shortcuts halve the distinct words that
    the tokenizer sees: a first letter A-Z before an ASCII character is lowered
    (the normaliser lowers all, after composing), and a last '.' or ',' after an ASCII letter is a word of its own.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters: dict[str, str] = {}  # letter -> its bytes as the vocabulary writes them
        self.lowers, self.splits = self._learn()

    def _learn(self) -> tuple[bool, bool]:
        """Whether the shortcuts hold for this tokenizer."""
        lowers = all(self._ids(a) == self._ids(a.lower()) for a in ("The", "Zebra", "X", "État", "A1"))
        splits = all(
            self._ids(a + c) == self._ids(a) + self._ids(c) for a in ("the", "x", "nation", "été", "it's") for c in ".,"
        )
        return lowers, splits

    def _ids(self, word: str) -> bytes:
        return array.array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if "<|" in word:
            return self._ids(word)
        if self.splits and word[-1] in ".," and word[-2:-1].isascii() and word[-2:-1].isalpha():
            ids = self[word[:-1]] + self[word[-1]]
        elif self.lowers and "A" <= word[0] <= "Z" and len(word) > 1 and word[1].isascii():
            ids = self[word[0].lower() + word[1:]]
        else:
            ids = self._word(word)
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """Words of lower-case Latin letters go to the model straight away.

        The normaliser and the pre-tokenizer leave those as they are.
        """
        if not (word.isalpha() and word.islower() and max(word) < "\u0180"):
            return self._ids(word)
        if not word.isascii():
            for c in set(word) - self.letters.keys():
                self.letters[c] = self.shown(c)[0][0]
            word = "".join(map(self.letters.__getitem__, word))
        return array.array("I", [k.id for k in self.model.tokenize(word)]).tobytes()


def word_ids(path: str) -> WordIds:
    """One per Python worker: kept over the tasks it runs."""
    return held(("word ids", path), lambda: WordIds(path))


def split_words(text: str) -> list[str]:
    """The words between the tokenizer's own white space (``SPACE``)."""
    return _WORDS.findall(text) if any(c in text for c in _NO_SPACE) else text.split()


def encode_text(text: str, ids: WordIds) -> bytes:
    return b"".join(map(ids.__getitem__, split_words(text)))


def _filesystem(uri: str):
    """(pyarrow file system, path) of a folder that all executors share."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class SequenceWriter:
    """Writes one file of fixed-length rows from a stream of ids."""

    def __init__(self, stream, dtype, length: int, rows_per_batch: int):
        self.length, self.block = length, length * rows_per_batch
        self.dtype, self.pending, self.n = dtype, [], 0
        value = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer, self.held = pa.ipc.new_file(stream, self.schema), 0

    def add(self, ids: np.ndarray) -> None:
        self.pending.append(ids)
        self.held += len(ids)
        self.n += len(ids)
        while self.held >= self.block:
            flat = np.concatenate(self.pending)
            self._batch(flat[: self.block], self.block)
            self.pending, self.held = [flat[self.block :]], self.held - self.block

    def _batch(self, ids: np.ndarray, size: int) -> None:
        flat = np.zeros(size, self.dtype)
        flat[: len(ids)] = ids
        lists = [pa.array(flat), pa.array(np.arange(size) < len(ids))]
        columns = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in lists]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            flat = np.concatenate(self.pending)
            self._batch(flat, -(-len(flat) // self.length) * self.length)
        self.writer.close()


MANIFEST = "part long, file string, n_docs long, n_tokens long"
FILE_BYTES = 128 << 20  # of text


def _files(docs: DataFrame, text_col: str) -> int:
    """Files to write: ``FILE_BYTES`` of text each, and no fewer than the cluster's cores."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // FILE_BYTES))


def write_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    folder: str,
    vocabulary: int,
    text_col: str = "text",
    id_col: str = "doc_id",
    length: int = LENGTH,
    rows_per_batch: int = ROWS_PER_BATCH,
    partitions: int | None = None,
) -> DataFrame:
    """Write the data set into ``folder`` (shared by all executors).

    Returns the manifest with ``base``, the ids of all files before each.
    """
    spark = docs.sparkSession
    dtype = np.uint16 if vocabulary <= 1 << 16 else np.uint32
    n = partitions or _files(docs, text_col)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, store, root, out = None, None, None, None
        part, name = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}"
        doc_ids, starts, sizes = [], [], []
        for batch in batches:
            for doc_id, text in zip(values(batch.column(0)), values(batch.column(1)), strict=True):
                if out is None:
                    ids = word_ids(tokenizer_path)
                    store, root = _filesystem(folder)
                    store.create_dir(root, recursive=True)
                    stream = store.open_output_stream(f"{root}/{part:06d}-{name}.ids.arrow")
                    out = SequenceWriter(stream, dtype, length, rows_per_batch)
                tokens = np.frombuffer(encode_text(text.decode("utf-8", "replace"), ids), np.uint32).astype(dtype)
                doc_ids.append(doc_id)
                starts.append(out.n)
                sizes.append(len(tokens) + 1)
                out.add(tokens)
                out.add(np.array([end_id], dtype))
        if out is None:
            return
        out.close()
        stream.close()
        index = pa.table({"doc_id": pa.array(doc_ids, batch.column(0).type), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())})
        with store.open_output_stream(f"{root}/{part:06d}-{name}.docs.arrow") as f, pa.ipc.new_file(f, index.schema) as w:
            w.write_table(index, max_chunksize=8192)
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "file": [f"{part:06d}-{name}"], "n_docs": [len(doc_ids)], "n_tokens": [out.n]},
            schema=pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
        )

    ordered = (
        docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("t"))
        .repartitionByRange(n, F.col("id").asc_nulls_first(), F.xxhash64("t"))
        .sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("t"))
    )
    manifest = stored(ordered.mapInArrow(write, MANIFEST), "token-manifest")
    # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class TokenFile:
    """Random access to one mapped file pair."""

    def __init__(self, folder: str, file: str):
        store, root = _filesystem(folder)
        self.reader = pa.ipc.open_file(store.open_input_file(f"{root}/{file}.ids.arrow") if not _local(store) else pa.memory_map(f"{root}/{file}.ids.arrow"))
        with store.open_input_file(f"{root}/{file}.docs.arrow") as f:
            self.docs = pa.ipc.open_file(f).read_all()
        self.at, self.held = -1, None  # the batch read last
        self.length = self.reader.schema.field("ids").type.list_size
        self.rows_per_batch = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0

    def batch(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of a batch, flat; the ids are a view of the file."""
        if self.at != b:
            got = self.reader.get_batch(b)
            ids, mask = got.column(0), got.column(1)
            self.at, self.held = b, (ids.flatten().to_numpy(), mask.flatten().to_numpy(zero_copy_only=False))
        return self.held

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        b, r = divmod(row, self.rows_per_batch)
        ids, mask = self.batch(b)
        cut = slice(r * self.length, (r + 1) * self.length)
        return ids[cut], mask[cut]

    def tokens(self, start: int, n: int) -> np.ndarray:
        """``n`` ids of the stream from ``start``."""
        size = self.length * self.rows_per_batch
        parts = []
        while n > 0:
            ids, mask = self.batch(start // size)
            part = ids[start % size :][:n]
            if not mask[start % size : start % size + len(part)].all() or not len(part):
                raise ValueError("the stream ends before the document does")
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def _local(store) -> bool:
    from pyarrow import fs

    return isinstance(store, fs.LocalFileSystem)


def read_documents(spark: SparkSession, folder: str, manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the files.

    ``start`` counts the ids of all documents before it; ``ids`` is binary:
    little-endian unsigned 32-bit integers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, base in zip(values(b.column("file")), values(b.column("base")), strict=True):
                data = TokenFile(folder, file)
                for piece in data.docs.to_batches(max_chunksize=1024):
                    starts, sizes = piece.column("start").to_pylist(), piece.column("n_tokens").to_pylist()
                    ids = [data.tokens(s, k).astype("<u4").tobytes() for s, k in zip(starts, sizes, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("doc_id"), pa.array([base + s for s in starts], pa.int64()), piece.column("n_tokens"), pa.array(ids, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    files = manifest.select("file", "base")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(n, "file").mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids binary")


def new_folder(spark: SparkSession) -> str:
    return shared_path(spark, "tokens")
