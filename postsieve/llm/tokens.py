"""Token ids in length-delimited binary records, with an offset index (operator 10).

File format, all numbers little-endian, as in the widespread record files for training: per record
``uint64 length | uint32 masked checksum of these 8 bytes | payload | uint32 masked checksum of the payload``.
The checksum is CRC-32, rotated right by 15 bits plus a constant so that checksums of data that hold checksums stay
apart. The payload is ``uint8 bytes per token id | uint8 has_id | int64 id | token ids...``. The offset index is a table of its own
(id, file, offset, length, start, n_tokens), so a shuffled read opens a file and reads one record by position.

Documents are dealt out by ranges of their id, so files follow each other in id order and no task sees more than its
range. A file's name is new for every attempt of a task and only files of attempts that succeeded reach the index.

Cases: a null text is empty and gives the end id alone; rows without an id come first; rows that repeat an id are
records of their own, ordered by text; an empty table gives an empty index; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import filterfalse, islice
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postsieve.llm.common import filesystem, new_folder, pieces, unique_name
from postsieve.plans.durable import written

MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
TAIL = struct.Struct("<I")
IDENT = struct.Struct("<BBq")
#: Bytes of words and their ids remembered by one Python worker, in each of two generations, and what an entry takes
#: besides its word and ids.
REMEMBERED = 40_000_000
ENTRY = 60
#: Texts of about so many characters are split into words at a time; a word takes about ten times its characters.
SPLIT_CHARS = 1_000_000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


class WordEncoder:
    """Ids of whole texts by way of their words, each encoded by the tokenizer and remembered.

    A worker lives on after its task, so what it remembers has a bound in bytes: when a generation of words is full a
    new one begins, to which the words of the one before move as they recur; the others are forgotten.

    For byte-level tokenizers that fold case and whose pre-tokens never hold white space. Splitting at single spaces
    and line ends then changes nothing; neither does folding the case of a Latin-1 text first, nor encoding a run of
    Latin-1 letters and the ASCII marks after it one by one, by the tokenizer's merges alone.
    """

    #: Letters whose composed and folded forms are one character each, then marks without apostrophe, digits and "<".
    _simple = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)")

    def __init__(self, path: str):
        self._whole = Tokenizer.from_file(path)
        #: Bytes of an id: two where every id fits.
        self.width = 2 if self._whole.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self._code = "H" if self.width == 2 else "I"
        self._merges = self._whole.model
        stand_in = _byte_letters()
        self._letters = {c: "".join(stand_in[x] for x in chr(c).encode()) for c in range(128, 256)}
        self._words: dict[str, bytes] = {"": b""}
        self._old: dict[str, bytes] = {}
        self._held = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed in little-endian numbers of ``width`` bytes."""
        split = [_folded(text).replace("\n", " ").split(" ") for text in texts]
        if self._held > REMEMBERED:
            self._words, self._old, self._held = {"": b""}, self._words, 0
        words, old = self._words, self._old
        before = len(words)
        missing = list(filterfalse(words.__contains__, set().union(*split)))
        words.update((word, old[word]) for word in missing if word in old)
        self._learn(list(filterfalse(words.__contains__, missing)))
        new = islice(reversed(words.items()), len(words) - before)
        self._held += sum(getsizeof(word) + getsizeof(ids) + ENTRY for word, ids in new)
        known = words.__getitem__
        return [b"".join(map(known, line)) for line in split]

    def _learn(self, missing: list[str]) -> None:
        simple, words, other = self._simple.fullmatch, self._words, []
        for word in missing:
            if found := simple(word):
                run, marks = found.groups()
                if (ids := words.get(run)) is None:
                    ids = words[run] = self._merged(run)
                if marks:
                    # words hold no space, so what marks alone give is kept apart from them by one
                    if (tail := words.get(f" {marks}")) is None:
                        tail = words[f" {marks}"] = self._merged(marks)
                    words[word] = ids + tail
            else:
                other.append(word)
        for word, found in zip(other, self._whole.encode_batch_fast(other, add_special_tokens=False), strict=True):
            words[word] = array(self._code, found.ids).tobytes()

    def _merged(self, part: str) -> bytes:
        letters = part if part.isascii() else part.translate(self._letters)
        return array(self._code, [token.id for token in self._merges.tokenize(letters)]).tobytes()


def _folded(text: str) -> str:
    """The text in lower case if it is Latin-1 and can hold no special token."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else text.lower()


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next one from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = [b for b in range(256) if b not in keep]
    return [chr(b) if b in keep else chr(256 + moved.index(b)) for b in range(256)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and vocabulary."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


LOCAL = pa.schema([("doc_id", pa.int64()), ("file", pa.string()), ("first", pa.int64()), ("offset", pa.int64()),
                   ("length", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _write(batches: Iterable[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """One file for the rows of a task, and the file's part of the index."""
    words, out, at, start = encoder(tokenizer), None, 0, 0
    end = struct.pack("<H" if words.width == 2 else "<I", end_id)
    name = f"{folder}/{unique_name('tokens', TaskContext.get().partitionId())}.bin"
    for piece in pieces(batches, chars=SPLIT_CHARS):
        if out is None:
            system, path = filesystem(name)
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            out, first = system.open_output_stream(path, compression=None), piece.column("doc_id")[0].as_py()
        rows, records = [], []
        texts = [text or "" for text in piece.column("text").to_pylist()]
        for doc_id, ids in zip(piece.column("doc_id").to_pylist(), words.encode(texts), strict=True):
            ids += end
            payload = IDENT.pack(words.width, doc_id is not None, doc_id or 0) + ids
            size = struct.pack("<Q", len(payload))
            record = b"".join((HEAD.pack(len(payload), masked(size)), payload, TAIL.pack(masked(payload))))
            records.append(record)
            rows.append((doc_id, name, first, at, len(record), start, len(ids) // words.width))
            at, start = at + len(record), start + len(ids) // words.width
        out.write(b"".join(records))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), LOCAL, strict=True)], schema=LOCAL)
    if out is not None:
        out.close()


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, files: int | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the record files below ``folder`` and return the offset index, in a table beside them."""
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(
        files, "doc_id").sortWithinPartitions("doc_id", "text")
    local = written(ranges.mapInArrow(
        lambda batches: _write(batches, folder, tokenizer, end_id), "doc_id bigint, file string, first bigint, offset bigint, length bigint, start bigint, n_tokens bigint"))
    # one row per file; files are disjoint ranges of ids
    order = Window.orderBy(F.col("first").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    base = local.groupBy("file").agg(F.min("first").alias("first"), F.sum("n_tokens").alias("held")).select(
        "file", F.coalesce(F.sum("held").over(order), F.lit(0)).alias("base"))
    return written(local.join(base, "file").select(
        "doc_id", "file", "offset", "length", (F.col("base") + F.col("start")).alias("start"), "n_tokens"))


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, source = None, None
    for batch in batches:
        done: list[tuple] = []
        held = 0
        for file, offset, length, start in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "start")), strict=True):
            if file != name:
                if source is not None:
                    source.close()
                system, path = filesystem(file)
                name, source = file, system.open_input_file(path)
            doc_id, ids = parse(source.read_at(length, offset))
            done.append((doc_id, start, ids))
            held += len(ids)
            if held > 8_000_000:
                yield _read_batch(done)
                done, held = [], 0
        if done:
            yield _read_batch(done)
    if source is not None:
        source.close()


def read_records(index: DataFrame) -> DataFrame:
    """Read the records an index names, in whatever part of it: (doc_id, start, ids as bytes). A record whose
    lengths or checksums disagree fails the job."""

    placed = index.select("file", "offset", "length", "start").repartition("file").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(_read, "doc_id bigint, start bigint, ids binary")


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, start, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())],
                                      names=["doc_id", "start", "ids"])


def parse(record: bytes) -> tuple[int | None, bytes]:
    """Id and token ids, packed as uint32, of one record."""
    length, check = HEAD.unpack_from(record)
    if masked(record[:8]) != check or len(record) != HEAD.size + length + TAIL.size:
        raise ValueError("record length does not fit its checksum")
    payload = record[HEAD.size:-TAIL.size]
    if TAIL.unpack(record[-TAIL.size:])[0] != masked(payload):
        raise ValueError("record does not fit its checksum")
    width, has_id, doc_id = IDENT.unpack_from(payload)
    ids = payload[IDENT.size:]
    return doc_id if has_id else None, ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def summaries(index: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and the CRC-32 of its ids."""
    return read_records(index).select(
        "doc_id", "start", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the documents as token records into a new shared folder and summarise them from there."""
    return summaries(write_records(docs, new_folder(docs.sparkSession, "tokens"), tokenizer, end_id))


__all__ = ["WordEncoder", "masked", "parse", "read_records", "summaries", "token_records", "write_records"]
