"""Token ids in a binary format: frequency-ranked, byte-aligned variable-length codes with separate control bytes.

The ids of a document become ranks (0 is the commonest id of the corpus). A rank takes 1 to 4 bytes, little-endian; a
control byte holds the lengths of four of them, two bits each, the first lowest. Control and data bytes lie apart, so
a decoder looks lengths up for a whole document at once.

The format's folder: ranks/ (rank, token_id) and blocks/shard=N/ (doc_id, start, n_tokens, control, data); shards and
the rows in them stand in ascending order of doc_id.
"""

from __future__ import annotations

import array
import bisect
import functools
import json
import math
import operator
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import materialise, read, small_batches, workspace

TOKENIZER = "byte_bpe_50k.json"
#: The id that ends each document.
END = 0
#: Documents in a shard, on average; at most MOST_SHARDS shards.
DOCS_PER_SHARD, MOST_SHARDS = 4000, 10_000
#: Letters after a blank whose ids a worker remembers, in Arrow arrays (some 30 bytes each), and strings of any other kind,
#: in dictionaries (some 200 bytes each) twice over: those of late, and those of before that are still in use.
SPACED, OTHERS = 200_000, 15_000
#: The steps before the merges for which SPLIT stands. Texts for any other tokenizer go through the library whole.
STEPS = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "truncation": None, "padding": None}
MERGES = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
#: The splits that the tokenizer makes before its merges, for the characters of PLAIN alone.
SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Their Latin-1 bytes: ASCII that shows, white space, letters of the upper half.
PLAIN = bytes([9, 10, 11, 12, 13, *range(0x20, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
#: White space of more than one character, or other than blanks and line ends: cut by SPLIT alone.
ODD_SPACE = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c")

ID = operator.attrgetter("id")
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8) + 1


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it shows, else the next from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


class Remembered(dict):
    """make(key) for each key, remembered; what isn't asked for again is forgotten after a while."""

    def __init__(self, make, most: int = OTHERS):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        found = self.before.get(key)
        self[key] = found = self.make(key) if found is None else found
        return found


class Words:
    """Ids of distinct words, looked up many at once and remembered in Arrow arrays; what was looked up longest ago is forgotten."""

    def __init__(self, make, kind: np.dtype, most: int = SPACED):
        self.make, self.kind, self.most, self.turn = make, kind, most, 0
        self.words, self.ids, self.used = pa.array([], pa.string()), _lists([], kind), np.empty(0, np.int64)

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each word's ids stand in self.ids until the next call."""
        self.turn += 1
        if len(self.words) > self.most:
            late = np.sort(np.argsort(self.used, kind="stable")[-(self.most // 2) :])
            self.words, self.ids, self.used = self.words.take(pa.array(late)), self.ids.take(pa.array(late)), self.used[late]
        found = pc.index_in(words, value_set=self.words)
        if found.null_count:
            new, n = words.filter(found.is_null()), len(self.words)
            at = found.fill_null(-1).to_numpy().astype(np.int64)
            at[at < 0] = np.arange(n, n + len(new))
            self.ids = pa.concat_arrays([self.ids, _lists([self.make(x) for x in _listed(new)], self.kind)])
            self.words = pa.concat_arrays([self.words, new])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        else:
            at = found.to_numpy().astype(np.int64)
        self.used[at] = self.turn
        return at


class Encoder:
    """Ids of texts by the tokenizers library.

    The library cuts a text into pieces and merges each by itself. Where the file's steps are STEPS and MERGES, plain
    texts are cut here by the same rule, and the library's model merges the pieces, each of them once; all other texts,
    and all texts of other tokenizers, go through the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        said = json.loads(self.library.to_str())
        self.known_steps = all(said.get(k) == v for k, v in STEPS.items()) and all(said["model"].get(k) == v for k, v in MERGES.items())
        self.size = self.library.get_vocab_size()
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.type = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.alphabet, self.merge = byte_alphabet(), self.library.model.tokenize
        self.pieces = Remembered(self._piece)
        self.spaced = Remembered(self._letters)
        self.words = Words(self._letters, self.type)
        self.first = Remembered(self._piece)
        self.space, self.code = self.alphabet[0x20], "H" if self.type.itemsize == 2 else "I"

    def _piece(self, x: str) -> bytes:
        return self._ids(x.replace(" ", self.space) if x.isascii() and x.isprintable() else x.encode().decode("latin-1").translate(self.alphabet))

    def _letters(self, x: str) -> bytes:
        """Ids of letters after a blank."""
        return self._ids(self.space + x) if x.isascii() else self._piece(" " + x)

    def _ids(self, shown: str) -> bytes:
        """Ids of a piece in the vocabulary's alphabet."""
        return array.array(self.code, map(ID, self.merge(shown))).tobytes()

    def _word(self, before: str, word: str) -> bytes:
        """Ids of a word after `before`; letters and the signs that follow them are two pieces, and letters alone are remembered."""
        known = self.spaced if before else self.first
        if word.isalpha():
            return known[word]
        if "\n" in word:
            own, *lines = word.split("\n")
            return b"".join([self._word(before, own), *[self.pieces["\n"] + self._word("", x) for x in lines]])
        letters = word.rstrip(string.punctuation)
        return known[letters] + self.pieces[word[len(letters) :]] if letters.isalpha() else self._cut(before + word)

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, SPLIT.findall(text)))

    def _spaced(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts whose white space is single blanks and line ends: each different word of them is looked up once."""
        words = pc.split_pattern(pa.array(texts, pa.string()), " ")
        starts, each = words.offsets.to_numpy(), words.flatten()
        unlike = each.dictionary_encode()
        own, at = unlike.dictionary, unlike.indices.to_numpy()
        letters = pc.utf8_rtrim(own, characters=string.punctuation)
        plain = pc.utf8_is_alpha(letters)
        # ids: those of letters after a blank, then of the signs behind them, of other words, and of the texts' first words.
        alone, signs = letters.filter(plain).dictionary_encode(), _ends(own.filter(plain), letters.filter(plain)).dictionary_encode()
        places = self.words.places(alone.dictionary)
        rest = [self.pieces[x] if x else b"" for x in _listed(signs.dictionary)]
        rest += [self._word(" ", x) for x in _listed(own.filter(pc.invert(plain)))]
        # The first word of a text has no blank before it.
        rest += [self._word("", x) for x in _listed(each.take(pa.array(starts[:-1])))]
        ids = pa.concat_arrays([self.words.ids, _lists(rest, self.type)])
        # A word's place among ids, and that of the signs behind it.
        n, told = len(self.words.ids), plain.to_numpy(zero_copy_only=False)
        head, tail = np.empty(len(own), np.int64), np.full(len(own), -1)
        head[told] = places[alone.indices.to_numpy()]
        head[~told] = n + len(signs.dictionary) + np.arange((~told).sum())
        signed = pc.not_equal(signs.dictionary, "").to_numpy(zero_copy_only=False)[signs.indices.to_numpy()]
        tail[told] = np.where(signed, n + signs.indices.to_numpy(), -1)
        head, tail = head[at], tail[at]
        head[starts[:-1]], tail[starts[:-1]] = len(ids) - len(texts) + np.arange(len(texts)), -1
        behind = np.flatnonzero(tail >= 0)
        after = np.cumsum(np.where(tail >= 0, 2, 1))
        pairs = np.empty(after[-1], np.int64)
        pairs[after - np.where(tail >= 0, 2, 1)] = head
        pairs[after[behind] - 1] = tail[behind]
        all_ids = ids.take(pa.array(pairs))
        # starts is of words, ends of what stands for them, cuts of ids.
        ends = np.concatenate([[0], after])[starts]
        cuts = all_ids.offsets.to_numpy()[ends].tolist()
        flat = all_ids.values.to_numpy()
        return [flat[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]

    @staticmethod
    def _is_plain(text: str) -> bool:
        try:
            return not text.encode("latin-1").translate(None, PLAIN)
        except UnicodeEncodeError:
            return False

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, little-endian in self.type; a null text is empty."""
        out, spaced = [b""] * len(texts), []
        for k, text in enumerate(texts):
            if not text:
                continue
            if not self.known_steps or not self._is_plain(text) or any(x in text for x in self.special):
                out[k] = np.array(self.library.encode(text, add_special_tokens=False).ids, self.type).tobytes()
            elif any(x in text for x in ODD_SPACE):
                out[k] = self._cut(text)
            else:
                spaced.append(k)
        for k, ids in zip(spaced, self._spaced([texts[k] for k in spaced]) if spaced else (), strict=True):
            out[k] = ids
        return out


def _listed(values: pa.Array) -> list:
    """values, which hold no null, as Python objects; several times as fast as to_pylist."""
    return values.to_numpy(zero_copy_only=False).tolist()


def _lists(ids: list[bytes], kind: np.dtype) -> pa.LargeListArray:
    """A list of ids for each of the bytes."""
    n = np.fromiter(map(len, ids), np.int64, len(ids)) // kind.itemsize
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int64()), pa.array(np.frombuffer(b"".join(ids), kind)))


def _ends(words: pa.Array, heads: pa.Array) -> pa.Array:
    """What of each word stands behind its head."""
    if not len(words):
        return words
    stop = np.frombuffer(words.buffers()[1], np.int32)[words.offset + 1 :][: len(words)].astype(np.int64)
    n = pc.binary_length(words).to_numpy().astype(np.int64) - pc.binary_length(heads).to_numpy()
    ends = np.cumsum(n)
    at = np.arange(n.sum()) + np.repeat(stop - ends, n)
    held = np.frombuffer(words.buffers()[2], np.uint8)[at]
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(held))


def _cuts(n: np.ndarray) -> list[int]:
    return [0, *np.cumsum(n).tolist()]


def encode(ranks: np.ndarray, n: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of each document; n: the documents' numbers of ranks (below 2 to the power 32)."""
    ranks = ranks.astype("<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    # Each document starts a control byte of its own.
    fours = -(-n // 4)
    padded = np.zeros(int(fours.sum()) * 4, np.uint8)
    padded[np.arange(len(code)) + np.repeat(np.cumsum(fours * 4 - n) - (fours * 4 - n), n)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes()
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= code[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(code, dtype=np.int64) + np.arange(1, len(code) + 1)])
    at, to = _cuts(fours), ends[_cuts(n)].tolist()
    return [control[i:j] for i, j in zip(at, at[1:], strict=False)], [data[i:j] for i, j in zip(to, to[1:], strict=False)]


def decode(control: list[bytes], data: list[bytes], n: np.ndarray) -> np.ndarray:
    """The ranks of all documents, one after the other: lengths by table lookup, then each byte at its place."""
    fours = -(-n // 4)
    place = np.arange(int(n.sum())) + np.repeat(np.cumsum(fours * 4 - n) - (fours * 4 - n), n)
    lengths = LENGTHS[np.frombuffer(b"".join(control), np.uint8)].ravel()[place]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    padded = np.frombuffer(b"".join(data) + bytes(3), np.uint8)
    out = padded[at].astype(np.uint32)
    for k in range(1, 4):
        if len(more := np.flatnonzero(lengths > k)):
            out[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each worker process, so what it remembers serves its later tasks."""
    return Encoder(path)


def _stage(path: str, bounds: list) -> object:
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's ids; at the end of a partition, one row (shard -1) with the counts of its ids."""
        own, zip_, counts = encoder(path), zstandard.ZstdCompressor(level=1), None
        end = own.type.type(END).tobytes()
        for part in _parts(batches, 1024):  # a batch of 2 MB as a rule, so that a word is looked up once in it
            blobs = [ids + end for ids in own(part.column("text").to_pylist())]
            counts = (0 if counts is None else counts) + np.bincount(np.frombuffer(b"".join(blobs), own.type), minlength=own.size)
            docs = part.column("doc_id").to_pylist()
            shards = [0 if d is None else bisect.bisect_left(bounds, d) for d in docs]
            n = [len(x) // own.type.itemsize for x in blobs]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(docs, pa.int64()), pa.array([zlib.crc32(x) for x in blobs], pa.int64()), pa.array(n, pa.int64()), pa.array([zip_.compress(x) for x in blobs], pa.binary())], schema=schema)
        if counts is not None:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([zip_.compress(counts.astype("<i8").tobytes())], pa.binary())], schema=schema)

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("ids").to_pylist():
            counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i8")
            ids = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts[ids], pa.int64())], names=["token_id", "n"])


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, docs_per_shard: int = DOCS_PER_SHARD) -> None:
    """Encode docs (doc_id, text) into the format's folder; path: the tokenizer's file, on every machine.

    A null text counts as empty; an empty one has the end id alone. Null ids come first; rows that share an id follow
    each other in the order of a checksum of their ids. An empty table makes a folder without documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or tokenizer_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    shards = min(MOST_SHARDS, max(1, math.ceil(docs.count() / docs_per_shard)))
    bounds = docs.agg(F.percentile_approx("doc_id", [k / shards for k in range(1, shards)], 100_000)).first()[0] if shards > 1 else []
    staged = materialise(docs.mapInArrow(_stage(path, sorted(set(bounds or []))), "shard int, doc_id long, tie long, n_tokens long, ids binary"), "token-ids")
    counts = staged.where("shard = -1").select("ids").mapInArrow(_counts, "token_id long, n long").groupBy("token_id").agg(F.sum("n").alias("n"))
    # One row an id of the vocabulary: bounded by the tokenizer, whatever the corpus.
    order = [i for i, _ in sorted(((r.token_id, r.n) for r in counts.collect()), key=lambda x: (-x[1], x[0]))]
    spark.createDataFrame(list(enumerate(order)), "rank long, token_id long").coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(max(order, default=0) + 1, np.uint32)
    rank[order] = np.arange(len(order))
    held = spark.sparkContext.broadcast(rank)
    wide = encoder(path).type.str

    def to_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, rank = zstandard.ZstdDecompressor(), held.value
        for part in _parts(batches):
            ids = np.frombuffer(b"".join(map(unzip.decompress, part.column("ids").to_pylist())), wide)
            control, data = encode(rank[ids], part.column("n_tokens").to_numpy())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("shard", "doc_id", "tie", "n_tokens")), pa.array(control, pa.binary()), pa.array(data, pa.binary())], names=["shard", "doc_id", "tie", "n_tokens", "control", "data"])

    rows = staged.where("shard >= 0")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard, MOST_SHARDS at most
    offsets = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    coded = rows.mapInArrow(to_codes, "shard int, doc_id long, tie long, n_tokens long, control binary, data binary")
    coded = coded.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    out = coded.join(F.broadcast(offsets), "shard").select("shard", "doc_id", (F.col("offset") + F.col("within")).alias("start"), "n_tokens", "control", "data")
    out.sortWithinPartitions("shard", "start").write.partitionBy("shard").option("compression", "zstd").parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str, checksums: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary: little-endian unsigned 32-bit, end id included) of each document.

    checksums: ids_crc32 (the unsigned crc32 of those bytes) instead of ids.
    """
    small_batches(spark)
    order = [r.token_id for r in spark.read.schema("rank long, token_id long").parquet(f"{folder}/ranks").orderBy("rank").collect()]
    held = spark.sparkContext.broadcast(np.array(order, "<u4"))
    name, kind = ("ids_crc32", pa.int64()) if checksums else ("ids", pa.binary())

    def to_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            n = part.column("n_tokens").to_numpy()
            ids = memoryview(held.value[decode(part.column("control").to_pylist(), part.column("data").to_pylist(), n)].tobytes())
            at = _cuts(4 * n)
            own = [zlib.crc32(ids[i:j]) if checksums else bytes(ids[i:j]) for i, j in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(own, kind)], names=["doc_id", "start", "n_tokens", name])

    blocks = spark.read.schema("doc_id long, start long, n_tokens long, control binary, data binary").parquet(f"{folder}/blocks")
    return blocks.select("doc_id", "start", "n_tokens", "control", "data").mapInArrow(to_ids, f"doc_id long, start long, n_tokens long, {name} {'long' if checksums else 'binary'}")


def token_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write docs as tokens, read the files back: doc_id, start, n_tokens, ids_crc32 of each document."""
    folder = workspace(docs.sparkSession, "tokens")
    write_tokens(docs, folder, path)
    return read_tokens(docs.sparkSession, folder, checksums=True)


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(read(spark, sf_dir, "documents").select("doc_id", "text"))
