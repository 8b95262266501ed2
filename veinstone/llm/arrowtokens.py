"""Token ids as Arrow IPC files of fixed-size lists.

A file holds record batches of ``tokens`` and ``mask``, fixed-size lists of ``LENGTH`` items.
Documents follow one another without gaps, each closed by the end id; only the last sequence of a
file is padded, which its mask tells.  Every batch but the last has ``ROWS`` sequences, so
sequence i is row ``i % ROWS`` of batch ``i // ROWS``, and its ids are a slice of the mapped file:
nothing is decoded or copied.  Ids have 16 bits where the vocabulary allows, else 32.  A second
Arrow file beside it has the place of every document.

Files are written in ascending order of ids by the tasks of a range partitioning, straight into the
shared folder.  A task names its files afresh and returns the names, so what a lost or repeated
task has left behind is never read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir, written

LENGTH, ROWS = 2048, 256
MAX_KEPT_WORDS = 600_000
#: Characters of a text that order rows with equal ids.
TIE_CHARS = 32
#: Marks that may close a word of letters.
CLOSING = frozenset(",.;:!?")
#: Letters that the normaliser turns into one letter; after others a mark may stand, which joins the closing one.
_STAYS_LETTER = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]").fullmatch


# The normaliser and the pre-tokenizer of files whose words may be read apart.
APART = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}


#: The characters that stand for the bytes of a piece: printable ones themselves, the others in order from 256 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_STANDS_FOR = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: Lower-case words that are one piece and that the normaliser leaves as they are.
_ONE_PIECE = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+").fullmatch


def reads_words_apart(tokenizer) -> bool:
    """Whether the file's rules are those that ``WordEncoder`` rests on."""
    rules = json.loads(tokenizer.to_str())
    return all(rules[k] == v for k, v in APART.items()) and all("<" in t["content"] and not re.search(r"\s", t["content"]) and not t["lstrip"] and not t["rstrip"] for t in rules["added_tokens"]) and rules["model"]["type"] == "BPE" and not rules["model"]["dropout"]


class WholeEncoder:
    """Ids of whole texts from the tokenizers library, for any other file."""

    def __init__(self, tokenizer, dtype: str):
        self.tokenizer, self.dtype = tokenizer, dtype

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


class WordEncoder(dict):
    """Ids of a text from the tokenizers library, through a memory of words.

    By the rules of ``APART`` words are read apart: white space is dropped, and neither normaliser
    nor merges look across a space, tab or line end.  Letters are also read apart from the mark that
    closes a word, where the last letter stays one letter when it is normalised.  The memory has two generations: when the younger is full it becomes
    the older one, and what is used again moves back.
    """

    def __init__(self, tokenizer, dtype: str):
        super().__init__()
        self.tokenizer, self.model, self.dtype = tokenizer, tokenizer.model, dtype
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if word.isascii() and not word.islower() and "<" not in word:
                ids = self[word.lower()] if word.lower() != word else self._ids(word)
            elif word[-1:] in CLOSING and _STAYS_LETTER(word[-2:-1]) and word[:-1].isalpha():
                ids = self[word[:-1]] + self[word[-1]]
            else:
                ids = self._ids(word)
        if len(word) <= 64:
            if len(self) >= MAX_KEPT_WORDS:
                self.older = self.copy()
                self.clear()
            self[word] = ids
        return ids

    def _ids(self, word: str) -> bytes:
        if _ONE_PIECE(word):  # the file's merges, without the steps that would leave it as it is
            piece = word if word.isascii() else word.encode().decode("latin-1").translate(_STANDS_FOR)
            return np.array([t.id for t in self.model.tokenize(piece)], self.dtype).tobytes()
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        kept = self.__getitem__
        return [b"".join(map(kept, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) for t in texts]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder | WholeEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    encoder = WordEncoder if reads_words_apart(tokenizer) else WholeEncoder
    return encoder(tokenizer, "<u2" if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Packs documents into sequences and writes full batches."""

    def __init__(self, uri: str, dtype: str):
        fs, path = _open(uri)
        fs.create_dir(os.path.dirname(path), recursive=True)
        kind = pa.from_numpy_dtype(np.dtype(dtype))
        self.dtype = np.dtype(dtype)
        self.schema = pa.schema([("tokens", pa.list_(kind, LENGTH)), ("mask", pa.list_(pa.bool_(), LENGTH))])
        self.sink = fs.open_output_stream(path)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.parts: list[bytes] = []
        self.held = self.n_tokens = 0

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        self.n_tokens += len(ids) // self.dtype.itemsize
        full = LENGTH * ROWS * self.dtype.itemsize
        if self.held >= full:
            data = b"".join(self.parts)
            at = 0
            while len(data) - at >= full:
                self._write(np.frombuffer(data, self.dtype, LENGTH * ROWS, at), LENGTH * ROWS)
                at += full
            self.parts, self.held = [data[at:]], len(data) - at

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), LENGTH) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        rest = np.frombuffer(b"".join(self.parts), self.dtype)
        if len(rest):
            self._write(np.concatenate([rest, np.zeros(-len(rest) % LENGTH, self.dtype)]), len(rest))
        self.out.close()
        self.sink.close()


def write_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents in ascending order of ids; the manifest ``part, path, n_docs, n_tokens``.

    Null and empty texts are the end id alone; rows with equal ids follow by the first ``TIE_CHARS``
    characters of their texts, nulls first, then by a hash.  Rows of one id may be dealt over many tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, index, docs_index, path, n_docs = word_encoder(tokenizer_path), None, None, None, "", 0
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                writer = SequenceWriter(f"{path}.arrow", encoder.dtype)
                index_schema = pa.schema([("id", batch.schema.field(0).type), ("start", pa.int64()), ("n", pa.int64())])
                fs, place = _open(f"{path}.index.arrow")
                index = fs.open_output_stream(place)
                docs_index = pa.ipc.new_file(index, index_schema)
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                starts, counts = [], []
                for ids in encoder.encode([t or "" for t in part.column(1).to_pylist()]):
                    starts.append(writer.n_tokens)
                    writer.add(ids + end)
                    counts.append(writer.n_tokens - starts[-1])
                docs_index.write_batch(pa.RecordBatch.from_arrays([part.column(0), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=index_schema))
            n_docs += batch.num_rows
        if writer is not None:
            writer.close()
            docs_index.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "path": [path], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([writer.n_tokens], pa.int64())})

    ties = [F.left(F.col(text_col), F.lit(TIE_CHARS)).alias("head"), F.xxhash64(text_col).alias("h")]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *ties, F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange("id", "head", "h", "row").sortWithinPartitions("id", "head", "h")
    return ordered.select("id", "text").mapInArrow(run, "part long, path string, n_docs long, n_tokens long")


class SequenceFile:
    """Random access to one file: a local one is mapped, others are read by batch."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        source = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(source)

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and mask of each batch; the ids are views of the file."""
        for i in range(self.reader.num_record_batches):
            b = self.reader.get_batch(i)
            yield b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False)

    def sequence(self, i: int) -> np.ndarray:
        """Sequence ``i``, without a copy."""
        return self.reader.get_batch(i // ROWS).column(0)[i % ROWS].values.to_numpy()

    def documents(self, counts: Iterator[int]) -> Iterator[Iterator[np.ndarray]]:
        """For each document, by its number of ids, the slices that hold them."""
        source = self.batches()
        ids, at = np.empty(0, "u2"), 0
        for n in counts:
            parts = []
            while n:
                if at == len(ids):
                    ids, mask = next(source)
                    ids, at = ids[: int(mask.sum())], 0
                took = ids[at : at + n]
                parts.append(took)
                at += len(took)
                n -= len(took)
            yield iter(parts)


def read_files(manifest: DataFrame, id_type: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start, n_tokens, ids_crc32`` of every document from the files themselves.

    A window over the manifest, one row for each file, gives where every file starts.
    """
    placed = manifest.withColumn("base", F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, place = _open(f"{path}.index.arrow")
                index = pa.ipc.open_file(fs.open_input_file(place))
                parts = (index.get_batch(i) for i in range(index.num_record_batches))
                documents, file = None, SequenceFile(f"{path}.arrow")
                queue: list[int] = []
                documents = file.documents(iter(lambda: queue.pop(0), None))
                for part in parts:
                    crcs = []
                    for n in part.column(2).to_pylist():
                        queue.append(n)
                        crc = 0
                        for ids in next(documents):
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                    start = pa.array(part.column(1).to_numpy() + (base or 0), pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0), start, part.column(2), pa.array(crcs, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())
    return placed.select("path", "base").repartition(files).mapInArrow(run, f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long")


def tokens_to_arrow(docs: DataFrame, tokenizer_path: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files into the shared folder and read every document's place and digest back.

    Null and empty texts have the end id alone; a very long text spans sequences and batches.  No
    other column is read; an empty table has no file.  Null ids come first; for equal ids see ``write_files``.
    """
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    manifest = written(write_files(docs, tokenizer_path, end_id, folder, id_col=id_col, text_col=text_col), "manifest")
    return read_files(manifest, docs.schema[id_col].dataType.simpleString(), id_col)
