"""Token ids as flat unsigned integer files with 64-bit document offsets."""

from __future__ import annotations

import functools
import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import new_path, stored, text_batches

#: Words that a worker remembers at most, and pieces of words that are no word themselves.
_KEPT, _KEPT_PIECES = 500_000, 50_000


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable Latin-1, else the next from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Ids of words as they are asked for; at most _KEPT are remembered."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        got = self.make(word)
        if len(self) < _KEPT:
            self[word] = got
        return got


class WordEncoder:
    """Ids of whole texts from a byte-level BPE of the tokenizers library, which is asked once for each piece.

    The library's splitter never joins what lies before a space that follows a non-space with what lies after
    it, so a text's ids are those of its first word and of each further word with its space. Words (500,000 at
    most) are remembered; a new one is cut into the splitter's pieces, and the library's model merges those that are new
    too. Words with other characters than plain letters, digits, signs and white space are encoded by the library as
    they are; so is, whole, a text where a lone space follows white space or that holds a special string, and every text
    if the tokenizer is of another make.
    """

    def __init__(self, path: str, dtype: np.dtype):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library, self.dtype = Tokenizer.from_file(path), dtype
        self.known = _Words(self._after_space)
        self.inner: dict[str, bytes] = {}
        config = json.loads(self.library.to_str())
        special = [t["content"] for t in config["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        pre = config["pre_tokenizer"] or {}
        self.by_word = bool(pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not config["normalizer"] and not config["post_processor"])
        self.pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")
        self.letters = _byte_letters()
        self.codes = [i.to_bytes(dtype.itemsize, "little") for i in range(self.library.get_vocab_size())]

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _merged(self, piece: str) -> bytes:
        codes = self.codes
        return b"".join([codes[t.id] for t in self.library.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))])

    def _piece(self, piece: str) -> bytes:
        if piece[0] == " " and len(piece) > 1:
            got = self.known.get(piece[1:])
            if got is None:
                got = self._merged(piece)
                if len(self.known) < _KEPT:
                    self.known[piece[1:]] = got
            return got
        got = self.inner.get(piece)
        if got is None:
            got = self._merged(piece)
            if len(self.inner) < _KEPT_PIECES:
                self.inner[piece] = got
        return got

    def _after_space(self, word: str) -> bytes:
        """A word that isn't remembered, with its space; plain letters are one piece."""
        return self._merged(" " + word) if word.isascii() and word.isalpha() else self._word(" " + word)

    def _word(self, word: str) -> bytes:
        pieces = self.pieces.findall(word)
        if sum(map(len, pieces)) != len(word):
            return self._whole(word)
        return b"".join(map(self._piece, pieces))

    def encode(self, text: str) -> bytes:
        lone = ("  " in text or text[-1:] == " ") and re.search(r"\s (?: |\Z)", text)
        if not self.by_word or lone or (self.special and self.special.search(text)):
            return self._whole(text)
        first, space, rest = text.partition(" ")
        return b"".join([self._word(first), *map(self.known.__getitem__, rest.split(" "))]) if space else self._word(first)


@functools.cache
def encoder(path: str, kind: str) -> WordEncoder:
    """One for each Python worker: what it remembers serves all its tasks."""
    return WordEncoder(path, np.dtype(kind))


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+://", path) else (pafs.LocalFileSystem(), path)


def _put(path: str, blobs: Iterator[bytes]) -> None:
    """Write under a name of this attempt, then move: a repeated or doubled task leaves one whole file."""
    store, at = _open(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    own = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        for b in blobs:
            f.write(b)
    store.move(own, at)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, end_id: int | None, vocab: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and write them under path in ascending id order; return the manifest.

    Each shard is ``tokens-NNNNN.bin``, little-endian unsigned ids one after another (16 bits if vocab is at most
    65,536, else 32), and ``tokens-NNNNN.idx``, little-endian 64-bit words: the number of documents n, their ids,
    then n + 1 offsets into the shard counted in token ids. The manifest (shard, n_docs, n_tokens, base_docs,
    base_tokens) holds the prefix sums that turn them into offsets in the whole. Shards are ranges of the id, each
    written by one task as it encodes; path must be in a folder that all executors share.

    Null texts are empty; rows with a null id come first, as id -2**63; repeated ids are kept in the order of their
    texts; an empty table gives an empty manifest. Other columns are not read.
    """
    text_batches(docs.sparkSession)
    dtype = np.dtype("<u2") if vocab <= 65_536 else np.dtype("<u4")
    end = b"" if end_id is None else np.array([end_id], dtype).tobytes()
    two = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = two.repartitionByRange(F.col("id")).sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        names: list[int] = []
        offsets = [0]

        def ids() -> Iterator[bytes]:
            for b in batches:
                names.extend(b.column(0).to_pylist())
                for text in b.column(1):
                    got = encoder(tokenizer, dtype.str).encode(text.as_py()) + end
                    offsets.append(offsets[-1] + len(got) // dtype.itemsize)
                    yield got

        first = next(flow := ids(), None)
        if first is None:
            return
        _put(f"{path}/tokens-{shard:05d}.bin", (x for part in ([first], flow) for x in part))
        _put(f"{path}/tokens-{shard:05d}.idx", iter([np.array([len(names), *names, *offsets], "<i8").tobytes()]))
        row = {"shard": shard, "n_docs": len(names), "n_tokens": offsets[-1], "bytes": dtype.itemsize}
        yield pa.RecordBatch.from_pylist([row], pa.schema([(k, pa.int64()) for k in row]))

    shards = stored(dealt.mapInArrow(run, "shard long, n_docs long, n_tokens long, bytes long"), "token-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"base_{c[2:]}") for c in ("n_docs", "n_tokens")]
    manifest = shards.select("*", *base)
    manifest.coalesce(1).write.parquet(f"{path}/manifest.parquet")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{path}/manifest.parquet")


class TokenShard:
    """One shard, memory-mapped where its store is a local or shared folder, else read."""

    def __init__(self, path: str, shard: int, itemsize: int):
        self.ids, self.index = (self._map(f"{path}/tokens-{shard:05d}.{end}", kind) for end, kind in (("bin", f"<u{itemsize}"), ("idx", "<i8")))
        self.n = int(self.index[0])
        self.names, self.offsets = self.index[1 : self.n + 1], self.index[self.n + 1 :]

    @staticmethod
    def _map(path: str, kind: str) -> np.ndarray:
        store, at = _open(path)
        if not isinstance(store, pafs.LocalFileSystem):
            with store.open_input_file(at) as f:
                return np.frombuffer(f.read(), kind)
        return np.memmap(at, kind, "r") if os.path.getsize(at) else np.empty(0, kind)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.ids[self.offsets[k] : self.offsets[k + 1]]


def read_token_files(spark: SparkSession, path: str, *, texts: bool = False) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked, ids.

    A task maps one shard at a time; start adds the shard's base to the document's offset. ids_crc32 is the CRC-32 of
    the ids as little-endian unsigned 32-bit integers.
    """
    manifest = spark.read.parquet(f"{path}/manifest.parquet")
    n = max(1, min(manifest.count(), 4096))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                s = TokenShard(path, row["shard"], row["bytes"])
                for at in range(0, s.n, 4096):
                    docs = range(at, min(s.n, at + 4096))
                    cols = [pa.array(s.names[at : docs.stop].astype("i8")), pa.array(s.offsets[at : docs.stop] + row["base_tokens"]), pa.array(np.diff(s.offsets[at : docs.stop + 1])), pa.array([zlib.crc32(s[k].astype("<u4").tobytes()) for k in docs], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if texts:
                        cols, names = [*cols, pa.array([s[k].astype("i8") for k in docs], pa.list_(pa.int64()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(cols, names)

    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * texts
    return manifest.repartition(n, "shard").mapInArrow(run, out)


def token_files(docs: DataFrame, tokenizer: str, *, end_id: int | None = 2, vocab: int = 50_257, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as token files under path (a new folder in the shared one by default) and read them back."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-files")
    write_token_files(docs, path, tokenizer, end_id=end_id, vocab=vocab, id_col=id_col, text_col=text_col)
    return read_token_files(spark, path)
