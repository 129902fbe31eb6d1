"""Token ids in binary shards: one zstandard frame a document, a shared dictionary, an offset index.

A store is a folder: ``dictionary`` (the zstandard dictionary, trained on serialised id
arrays), ``manifest.json`` (shards in order of their documents, ids before each) and
``shard-NNNNN.tok``. A shard is

    b"TOKSHARD", u16 version, u16 bytes per id, 32 bytes sha256 of the dictionary
    frames: the ids of each document, little-endian, compressed apart
    index: i64 id[n], u8 has_id[n], u64 frame offset[n + 1], u64 ids before in shard[n + 1]
    u64 n, u64 index offset, b"TOKINDEX"

Documents are in ascending id order over all shards, null ids first. Any document is read
with its shard's index and its own frame. Shards are written to a name of their own and
then renamed, so a repeated task leaves one whole file; a store appears with its manifest.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
from array import array

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storytrack.llm.common import KEPT, fit_in_task, ship, table
from storytrack.session import checkpoint_dir

HEAD, TAIL, VERSION = b"TOKSHARD", b"TOKINDEX", 1
LEVEL = 3
# Bounds of what the dictionary is trained on, and its size.
TRAIN_DOCS, TRAIN_BYTES, DICTIONARY_BYTES = 2_000, 1 << 14, 1 << 16
CACHE_UNITS = 600_000  # spans in a generation of the cache
DOCS_AT_ONCE = 256
END_ID = 2

# White space as Unicode lists it: what the tokenizer's pattern takes for white space.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Spans that the tokenizer's pre-tokenizer never joins: a word with the space before it, white space.
_UNITS = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]")
_OTHER_WHITE = re.compile("[\\t\\x0b-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def _even(text: str) -> bool:
    """Whether the white space is single spaces and single line ends between words."""
    return not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n"
                or text[-1] in " \n" or _OTHER_WHITE.search(text))


# A last letter and what stands behind it without letters, digits, white space and apostrophes.
_TAIL = re.compile("(.*[^\\W\\d_])([^\\w\\s']+)", re.DOTALL)


def _byte_marks() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: visible ones for
    themselves, the others by the characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + n) for n, b in enumerate(others)}


class _Marks(dict):
    """The characters that stand for the bytes of a character in a byte-level vocabulary."""

    def __missing__(self, c: str) -> str:
        seen = self[c] = c.encode().decode("latin-1").translate(_BYTE_MARKS)
        return seen


_BYTE_MARKS = _byte_marks()
_MARKS = _Marks()
_SPACE_MARK = _MARKS[" "]


class _Cache(dict):
    """Serialised ids of spans, found by ``find``, a function of a span.

    The cache is bounded and has two generations: a full one becomes the old one, from which
    spans that are met again are taken over.
    """

    def __init__(self, find):
        super().__init__()
        self.find, self.old = find, {}

    def __missing__(self, span: str) -> bytes:
        ids = self.old.get(span)
        if ids is None:
            ids = self.find(span)
        if len(span) <= 64:
            if len(self) >= CACHE_UNITS:
                self.old = dict(self)
                self.clear()
            self[span] = ids
        return ids

    @property
    def known(self) -> dict[str, bytes]:
        """The younger generation."""
        return self


class Encoder:
    """A tokenizers file, applied to spans that its pre-tokenizer never joins."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind, self.code = f"<u{self.width}", {2: "H", 4: "I"}[self.width]
        self.tokenize = self.tokenizer.model.tokenize
        self.byte_level = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bare = _Cache(self._bare)
        self.spaced = _Cache(self._spaced)

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, before: str, word: str) -> bytes:
        """Ids of a word of letters, the model's own input; ``before`` stands for a space or none."""
        seen = word if word.isascii() else "".join(map(_MARKS.__getitem__, word))
        return array(self.code, [t.id for t in self.tokenize(before + seen)]).tobytes()

    def _bare(self, span: str) -> bytes:
        """Ids of a span."""
        if self.byte_level:
            if span.isalpha():
                return self._letters("", span)
            if span[0] == " " and span[1:].isalpha():
                return self._letters(_SPACE_MARK, span[1:])
            if parts := _TAIL.fullmatch(span):
                return self.bare[parts[1]] + self.bare[parts[2]]
        return self._whole(span)

    def _spaced(self, span: str) -> bytes:
        """Ids of a span with the space before it, or of one that begins with its line end."""
        if self.byte_level:
            if span.isalpha():
                return self._letters(_SPACE_MARK, span)
            if span[0] == "\n" and len(span) > 1:  # white space before a word is never joined with it
                return self.bare["\n"] + self.bare[span[1:]]
            if parts := _TAIL.fullmatch(span):  # letters and what is no letter are never in one token
                return self.spaced[parts[1]] + self.bare[parts[2]]
        return self._whole(span if span[0] == "\n" else " " + span)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The texts' ids, serialised; null counts as empty."""
        out, bare, spaced = [], self.bare.__getitem__, self.spaced.__getitem__
        for t in texts:
            if not t:
                out.append(b"")
            elif any(a in t for a in self.added):
                out.append(self._whole(t))  # what stands beside an added token is split otherwise
            elif _even(t):
                first, *rest = t.replace("\n", " \n").split(" ")
                out.append(bare(first) + b"".join(map(spaced, rest)))
            else:
                out.append(b"".join(map(bare, _UNITS.findall(t))))
        return out


_ENCODERS: dict[str, Encoder] = {}
KEPT.append(_ENCODERS)


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _files(path: str):
    """File system and path of a folder name with or without a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _put(path: str, data: bytes) -> None:
    """A whole file, under its name only once it is complete."""
    files, name = _files(path)
    own = f"{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        out.write(data)
    files.move(own, name)


def _get(path: str) -> bytes:
    files, name = _files(path)
    with files.open_input_stream(name) as f:
        return f.read()


def _dictionary(data: bytes):
    return zstandard.ZstdCompressionDict(data) if data else None


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int | None) -> bytes:
    """Dictionary trained on the first ``TRAIN_BYTES`` of the ids of ``TRAIN_DOCS`` documents.

    Chosen are those with the smallest id hashes. Too few or too short documents give b'',
    which means frames without a dictionary.
    """
    chosen = (docs.select("doc_id", F.xxhash64("doc_id").alias("_place")).filter("doc_id is not null")
              .orderBy("_place", "doc_id").limit(TRAIN_DOCS))
    sample = docs.filter(F.length("text") > 0).join(F.broadcast(chosen), "doc_id")

    def train(frames) -> bytes:
        enc, samples = encoder(tokenizer), []
        for pdf in frames:
            # a byte of text makes an id at most
            samples += [s[:TRAIN_BYTES] for s in enc.encode([t[:TRAIN_BYTES] for t in pdf["text"]])]
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            return b""

    return fit_in_task(sample, train, ["_place", "text"])


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = END_ID,
                id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the store at ``path`` (a folder that all machines share).

    ``end_id`` is appended to every document. Null and empty texts have no other ids; rows
    with equal or null ids are documents apart (in text order). Other columns are ignored;
    an empty table makes a store without shards.
    """
    tokenizer = tokenizer or default_tokenizer()
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = train_dictionary(texts, tokenizer, end_id)
    sha = hashlib.sha256(shared).digest()
    files, folder = _files(path)
    files.create_dir(folder, recursive=True)
    _put(f"{path}/dictionary", shared)

    def write(frames):
        enc = encoder(tokenizer)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared)).compress
        end = b"" if end_id is None else np.array([end_id], enc.kind).tobytes()
        files, folder = _files(path)
        shard, out, own = TaskContext.get().partitionId(), None, f"{folder}/.{uuid.uuid4().hex}"
        ids, offsets, counts = [], [0], [0]
        for pdf in frames:
            for at in range(0, len(pdf), DOCS_AT_ONCE):
                part = pdf.iloc[at:at + DOCS_AT_ONCE]
                if out is None:
                    out = files.open_output_stream(own)
                    out.write(HEAD + struct.pack("<HH", VERSION, enc.width) + sha)
                ids += [None if pd.isna(i) else int(i) for i in part["doc_id"]]
                for data in enc.encode(part["text"].tolist()):
                    frame = compress(data + end)
                    out.write(frame)
                    offsets.append(offsets[-1] + len(frame))
                    counts.append(counts[-1] + len(data + end) // enc.width)
        if out is None:
            return
        index = (np.array([i or 0 for i in ids], "<i8").tobytes() + bytes(i is not None for i in ids)
                 + np.array(offsets, "<u8").tobytes() + np.array(counts, "<u8").tobytes())
        head = len(HEAD) + 4 + len(sha)
        out.write(index + struct.pack("<QQ", len(ids), head + offsets[-1]) + TAIL)
        out.close()
        files.move(own, f"{folder}/shard-{shard:05d}.tok")
        real = [i for i in ids if i is not None]
        yield pd.DataFrame({"shard": [shard], "docs": [len(ids)], "ids": [counts[-1]],
                            "first": [min(real, default=None)], "last": [max(real, default=None)]},
                           ).astype({"first": "Int64", "last": "Int64"})

    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = sorted(ordered.mapInPandas(write, "shard int, docs long, ids long, first long, last long").collect())
    shards, before = [], 0
    for r in made:  # one row a shard
        shards.append({"file": f"shard-{r.shard:05d}.tok", "start": before, "docs": r.docs, "ids": r.ids,
                       "first": r.first, "last": r.last})
        before += r.ids
    manifest = {"version": VERSION, "dictionary_sha256": sha.hex(), "tokenizer": os.path.basename(tokenizer),
                "end_id": end_id, "ids": before, "shards": shards}
    _put(f"{path}/manifest.json", json.dumps(manifest).encode())


class Shard:
    """An open shard: its index, and single documents or runs of them by place."""

    def __init__(self, path: str, dictionary: bytes):
        files, name = _files(path)
        self.file = files.open_input_file(name)
        size = self.file.size()
        tail = self.file.read_at(16 + len(TAIL), size - 16 - len(TAIL))
        head = self.file.read_at(len(HEAD) + 36, 0)
        if tail[16:] != TAIL or head[:len(HEAD)] != HEAD:
            raise ValueError(f"not a whole shard: {path}")
        version, width = struct.unpack_from("<HH", head, len(HEAD))
        if version != VERSION or head[-32:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"another version or dictionary: {path}")
        n, at = struct.unpack("<QQ", tail[:16])
        index = self.file.read_at(size - 16 - len(TAIL) - at, at)
        self.base, self.kind, self.n = len(head), f"<u{width}", n
        self.ids = np.frombuffer(index, "<i8", n)
        self.has_id = np.frombuffer(index, np.uint8, n, 8 * n)
        self.offsets = np.frombuffer(index, "<u8", n + 1, 9 * n).astype(np.int64)
        self.counts = np.frombuffer(index, "<u8", n + 1, 9 * n + 8 * (n + 1)).astype(np.int64)
        self.expand = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress

    def documents(self, first: int, last: int) -> list[np.ndarray]:
        data = self.file.read_at(int(self.offsets[last] - self.offsets[first]), self.base + int(self.offsets[first]))
        cuts = self.offsets[first:last + 1] - self.offsets[first]
        return [np.frombuffer(self.expand(data[a:b]), self.kind) for a, b in zip(cuts, cuts[1:], strict=False)]


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents; ids as little-endian unsigned 32-bit bytes."""
    ship(spark)
    manifest = json.loads(_get(f"{path}/manifest.json"))
    shared = _get(f"{path}/dictionary")
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("start", T.LongType())])
    shards = spark.createDataFrame([(s["file"], s["start"]) for s in manifest["shards"]], schema)
    if len(manifest["shards"]) > 1:
        shards = shards.repartition(len(manifest["shards"]))

    def read(frames):
        for pdf in frames:
            for name, before in zip(pdf["file"], pdf["start"], strict=True):
                shard = Shard(f"{path}/{name}", shared)
                for at in range(0, shard.n, DOCS_AT_ONCE):
                    end = min(shard.n, at + DOCS_AT_ONCE)
                    ids = pd.Series(shard.ids[at:end], dtype="Int64").mask(shard.has_id[at:end] == 0)
                    yield pd.DataFrame({"doc_id": ids, "start": before + shard.counts[at:end],
                                        "n_tokens": np.diff(shard.counts[at:end + 1]),
                                        "ids": [d.astype("<u4").tobytes() for d in shard.documents(at, end)]})

    return shards.mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def read_document(path: str, doc_id: int) -> np.ndarray | None:
    """One document's ids, by its shard's index and its own frame; None if the store has no such id."""
    shared = _get(f"{path}/dictionary")
    for s in json.loads(_get(f"{path}/manifest.json"))["shards"]:
        if s["first"] is not None and s["first"] <= doc_id <= s["last"]:
            shard = Shard(f"{path}/{s['file']}", shared)
            nulls = int((shard.has_id == 0).sum())  # they come first
            at = nulls + int(np.searchsorted(shard.ids[nulls:], doc_id))
            if at < shard.n and shard.ids[at] == doc_id:
                return shard.documents(at, at + 1)[0]
    return None


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_store(table(spark, sf_dir, "documents"), path)
    return read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
