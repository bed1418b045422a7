"""Token-ID files: independent zstandard frames with a trailing seek table and a checksum for each frame.

One file per range of documents, in the public zstd seekable layout: data frames, then a skippable frame
(magic 0x184D2A5E) with 12 bytes for each frame (compressed size, content size, low 32 bits of the content's XXH64)
and a footer (number of frames, descriptor byte 0x80, magic 0x8F92EAB1), all little-endian. The last data frame is the
document index; the others hold whole documents' ids. A reader takes the footer, the seek table, the index and then
only the frames of the documents it wants, and every frame it reads is held against its checksum.

Documents are dealt by ranges of (``doc_id``, hash of the text, place in the input) and sorted, so files in order hold ids in ascending order. A task
writes a file of its own name in the shared folder and the manifest names the files that count, so a repeated or
lost attempt leaves nothing wrong.

Nulls: a null text is an empty one (only the end id); null ids come first. Rows that share an id are documents
of their own, ordered by a hash of their text. Only ``doc_id`` and ``text`` are read. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_slices, distinct_words, gather, map_arrow, map_batches, materialize, new_folder, open_fs, shuffle_partitions, table

# The zstd seekable format.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80

INDEX_ROW = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("first", "<u4"), ("n", "<u4")])
#: Ids in a frame, at which it is closed after the document.
FRAME_IDS = 65_536


class TokenWriter:
    """Writes documents' ids to a binary stream in the format above."""

    def __init__(self, stream, dtype: str = "<u2", level: int = 3):
        self.stream, self.dtype = stream, np.dtype(dtype)
        self.packer = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.n_bytes = self.n_tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) > np.iinfo(self.dtype).max:
            raise ValueError(f"id {ids.max()} does not fit {self.dtype}")
        self.index.append((doc_id or 0, doc_id is None, len(self.frames), self.n_held, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        if self.n_held >= FRAME_IDS:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self._frame(np.concatenate(self.held).astype(self.dtype).tobytes())
            self.held, self.n_held = [], 0

    def _frame(self, content: bytes) -> None:
        packed = self.packer.compress(content)
        self.stream.write(packed)
        self.n_bytes += len(packed)
        self.frames.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def close(self) -> None:
        self._flush()
        self._frame(bytes([self.dtype.itemsize]) + np.array(self.index, INDEX_ROW).tobytes())
        table_ = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table_)) + table_)
        self.n_bytes += 8 + len(table_)


class TokenReader:
    """Random access to a file of ``TokenWriter``; ``stream`` can seek."""

    def __init__(self, stream, size: int):
        self.stream = stream
        n, descriptor, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE or descriptor != CHECKSUMS:
            raise ValueError("not a seekable token file")
        entries = np.frombuffer(self._read(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.sizes, self.contents, self.sums = entries.T.tolist()
        self.starts = np.concatenate([[0], np.cumsum(entries[:, 0], dtype=np.int64)]).tolist()
        content = self._content(n - 1)
        self.dtype = np.dtype(f"<u{content[0]}")
        self.index = np.frombuffer(content, INDEX_ROW, offset=1)
        self.at, self.ids = -1, np.zeros(0, self.dtype)

    def _read(self, start: int, n: int) -> bytes:
        self.stream.seek(start)
        return self.stream.read(n)

    def _content(self, frame: int) -> bytes:
        packed = self._read(self.starts[frame], self.sizes[frame])
        content = zstandard.ZstdDecompressor().decompress(packed, max_output_size=self.contents[frame])
        if len(content) != self.contents[frame] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.sums[frame]:
            raise ValueError(f"frame {frame} does not match its checksum")
        return content

    def document(self, row: int) -> tuple[int | None, np.ndarray]:
        doc_id, null, frame, first, n = self.index[row].tolist()
        if frame != self.at:
            self.at, self.ids = frame, np.frombuffer(self._content(frame), self.dtype)
        return (None if null else doc_id), self.ids[first : first + n]


# How a word-end tokenizer file splits a text; what it says of a text is then what it says of the text's words in a row.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

#: Letters of ASCII and Latin-1: a word of these is one pre-token, whatever stands around it.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Marks that never join a letter or digit before them; none of them begins a special token.
_AFTER = ".,;:!?|*%$&#"
# Byte-level alphabet: printable bytes stand for themselves, the others for 256 and up, in order.
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _KEPT} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_KEPT))}
_BYTE_TABLE = {k: v for k, v in _BYTE_CHARS.items() if ord(v) != k}


def id_dtype(tokenizer_path: str, end_id: int) -> str:
    """The narrowest width that holds every id of the file and the end id."""
    from tokenizers import Tokenizer

    largest = max([end_id, *Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True).values()])
    if end_id < 0 or largest >= 1 << 32:
        raise ValueError("ids are 0 to 2**32 - 1")
    return "<u2" if largest < 1 << 16 else "<u4"


class Encoder:
    """Encodes batches of texts with a tokenizer file of the tokenizers library.

    Where the file drops white space and splits words as ``WORD_NORMALIZER`` and ``WORD_SPLITTER`` say, each distinct word of a batch is
    encoded once, without the marks that end it, and its ids are kept (at most ``kept`` words); any other file encodes whole texts.
    """

    def __init__(self, path: str, kept: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.kept, self.known, self.parted = Tokenizer.from_file(path), kept, {}, {}
        told = json.loads(Path(path).read_text(encoding="utf-8"))
        special = [t for t in told.get("added_tokens", []) if any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) or re.search(rf"\s|^[{re.escape(_AFTER)}]|[{re.escape(_AFTER)}]$", t["content"])]
        whole_model = told["model"]["type"] == "BPE" and not told["model"].get("dropout")
        self.by_word = told.get("normalizer") == WORD_NORMALIZER and told.get("pre_tokenizer") == WORD_SPLITTER and told.get("post_processor") is None and whole_model and not special

    def _word(self, word: str) -> bytes:
        plain = word.isascii() and word.isalpha()
        if plain or _PLAIN.fullmatch(word):
            small = word.lower() if plain else unicodedata.normalize("NFC", word).lower().encode().decode("latin-1").translate(_BYTE_TABLE)
            ids = [t.id for t in self.tokenizer.model.tokenize(small)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words in a row, with each word's first and number."""
        if len(self.known) > self.kept:
            self.known.clear()
        known = self.known
        for word in words:
            if word not in known:
                known[word] = self._word(word)
        found = list(map(known.__getitem__, words))
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), np.uint32), np.cumsum(lengths) - lengths, lengths

    def _parts(self, last: str) -> bool:
        """Whether marks after this character are a pre-token of their own: the file's own splitter tells, on its normal form."""
        if last not in self.parted:
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(last + ".")) if last else []
            self.parted[last] = len(pieces) > 1 and pieces[-1][0] == "."
        return self.parted[last]

    def _ends_before_marks(self, bare: pa.Array, words: pa.Array) -> pa.Array:
        """Whether a word's trailing marks may be cut off; not where they are one pre-token with what stands before them."""
        last = pc.utf8_slice_codeunits(pc.if_else(pc.equal(bare, words), "", bare), -1).dictionary_encode()
        fine = pa.array([self._parts(c) for c in last.dictionary.to_pylist()], pa.bool_())
        return fine.take(last.indices)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text; a null text has none."""
        if not self.by_word:
            return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        words, codes, offsets = distinct_words(texts)
        bare = pc.utf8_rtrim(words, characters=_AFTER)
        bare = pc.if_else(self._ends_before_marks(bare, words), bare, words)
        stems, ends = bare.dictionary_encode(), _tails(words, bare).dictionary_encode()
        named = pa.concat_arrays([stems.dictionary, ends.dictionary]).to_numpy(zero_copy_only=False).tolist()
        flat, starts, lengths = self._pieces(named)
        pairs = np.stack([stems.indices.to_numpy(zero_copy_only=False), ends.indices.to_numpy(zero_copy_only=False) + len(stems.dictionary)], axis=1)
        ids, until = gather(flat, starts, lengths, pairs[codes].ravel())
        until = np.concatenate([[0], until])[2 * offsets]
        return [ids[a:b] for a, b in zip(until[:-1].tolist(), until[1:].tolist(), strict=True)]


def _tails(words: pa.Array, heads: pa.Array) -> pa.Array:
    """What follows the head of each word."""
    data, starts = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    first = starts[:-1] + pc.binary_length(heads).to_numpy(zero_copy_only=False)
    tails, ends = gather(data, first, starts[1:] - first, np.arange(len(words)))
    return pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(tails.tobytes())])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, so that what it has kept serves the tasks to come."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1) -> DataFrame:
    """Write the files; returns the manifest (part, file, n_docs, n_tokens, n_bytes), written too."""
    dtype = id_dtype(tokenizer_path, end_id)

    def run(batches):
        from pyspark import TaskContext

        part, writer, out = TaskContext.get().partitionId(), None, None
        fs, root = open_fs(folder)
        name, n_docs, end = f"part-{part:06d}-{uuid.uuid4().hex}.tok.zst", 0, np.array([end_id], "<u4")
        encode = encoder(tokenizer_path).encode
        for batch in arrow_slices(batches, size=4_000_000):
            if writer is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
                writer = TokenWriter(out, dtype)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
                writer.add(doc_id, np.concatenate([ids, end]))
            n_docs += len(batch)
        if writer is not None:
            writer.close()
            out.close()
            yield {"part": [part], "file": [name], "n_docs": [n_docs], "n_tokens": [writer.n_tokens], "n_bytes": [writer.n_bytes]}

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("tie"))
    # rows of one id, even equal ones, may stand in several ranges
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("tie")]
    ranged = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order).drop("hash", "tie")
    return materialize(map_batches(ranged, run, "part int, file string, n_docs long, n_tokens long, n_bytes long"), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches):
        fs, root = open_fs(folder)
        for batch in batches:
            for name, start in zip(batch["file"], batch["first"], strict=True):
                with fs.open_input_file(f"{root}/{name}") as stream:
                    reader = TokenReader(stream, stream.size())
                    out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                    for row in range(len(reader.index)):
                        doc_id, ids = reader.document(row)
                        for key, value in zip(out, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            out[key].append(value)
                        start += len(ids)
                    yield out

    spread = files.select("part", "file", "first").repartition(shuffle_partitions(manifest.sparkSession))
    return map_arrow(spread, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and return what the files hold."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = str(public_tokenizers.path("word_bpe_49k.json"))
    folder = new_folder(docs.sparkSession, "token-files", keep=True)
    return read_token_files(write_token_files(docs, tokenizer_path, folder), folder)


def op5_token_output(spark, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
