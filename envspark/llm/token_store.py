"""Token ids in blocks of shuffled bit or byte planes, compressed, with an index."""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import map_rows, shared_folder, staged

BLOCK_IDS = 65_536
END_ID = 2
MAGIC = b"PLN1"
#: About so many distinct words a worker keeps the ids of, those met since it last had so many, and as many before.
CACHED_WORDS = 250_000
_HEAD = struct.Struct("<4sBBHI")


def encode_block(ids: np.ndarray, planes: str = "byte", level: int = 3) -> bytes:
    """One block: header, compressed length of each plane, planes.

    Ids are little-endian words of two bytes, or four if any id needs them. A
    plane holds the same byte (or bit) of all ids, least significant first.
    """
    ids = np.ascontiguousarray(ids, np.uint32)
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    raw = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    if planes == "bit":
        raw = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little").T
    elif planes != "byte":
        raise ValueError("planes are 'bit' or 'byte'")
    press = zstandard.ZstdCompressor(level=level)
    parts = [press.compress(np.ascontiguousarray(p).tobytes()) for p in raw.T]
    lengths = struct.pack(f"<{len(parts)}I", *map(len, parts))
    return _HEAD.pack(MAGIC, width, planes == "bit", len(parts), len(ids)) + lengths + b"".join(parts)


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block as unsigned 32-bit integers."""
    magic, width, bits, n_planes, n = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    lengths = struct.unpack_from(f"<{n_planes}I", block, _HEAD.size)
    at, rows, unpress = _HEAD.size + 4 * n_planes, [], zstandard.ZstdDecompressor()
    for length in lengths:
        rows.append(np.frombuffer(unpress.decompress(block[at : at + length]), np.uint8))
        at += length
    if bits:
        raw = np.packbits(np.unpackbits(np.stack(rows), axis=1, bitorder="little")[:, :n].T, axis=1, bitorder="little")
    else:
        raw = np.stack(rows, axis=1)
    return np.ascontiguousarray(raw).view(f"<u{width}").ravel().astype(np.uint32)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class WordEncoder:
    """Token ids of whole texts, each distinct word encoded once.

    Where the file normalises and splits as ``_KNOWN`` says, texts of ASCII and
    Latin-1 letters are lower-cased and split here, and only the parts of new
    words go to the library's model; other texts go to the library by pieces
    between white space, which such files never join. With any other file the
    library gets whole texts.
    """

    # The file's own steps, and what its pattern comes to for the characters of ``_PLAIN``.
    _KNOWN = {
        "normalizer": {
            "type": "Sequence",
            "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
        },
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {
                    "type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                    "behavior": "Removed", "invert": True,
                },
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
        "truncation": None, "padding": None,
    }
    _PLAIN = re.compile(r"[ \t\n\r\x0b\x0c!-~À-ÖØ-öø-ÿ]*")
    _PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        from tokenizers import Tokenizer

        self.tokenizer, self.cached = Tokenizer.from_file(path), cached
        self.model = self.tokenizer.model
        shape = json.loads(self.tokenizer.to_str())
        special = shape["added_tokens"]
        # Special tokens are met as they are written, before the text is normalised.
        self.short_way = all(shape[k] == v for k, v in self._KNOWN.items()) and not any(
            t["normalized"] or t["lstrip"] or t["rstrip"] or len(t["content"].split()) != 1 for t in special
        )
        self.special = tuple(t["content"] for t in special)
        self.letters = {i: c for i, c in enumerate(_byte_letters())}
        self.known = _Known(self, {})

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a lower-case word between white space, or of a piece of any other text with a space before it."""
        if word[0] == " ":
            return self.library(word[1:])
        parts = self._PARTS.findall(word)
        if parts != [word]:
            return b"".join(map(self.known.__getitem__, parts))
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])

    def __call__(self, text: bytes | None) -> np.ndarray:
        shown = text.decode() if text else ""
        if not self.short_way:
            return np.frombuffer(self.library(shown), np.uint32)
        if self._PLAIN.fullmatch(shown) and not any(s in shown for s in self.special):
            words = shown.lower().split()
        else:
            words = [" " + w.decode() for w in text.split()]
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.uint32)
        if len(self.known) > self.cached:
            self.known.before = {}
            self.known = _Known(self, self.known)
        return ids


class _Known(dict):
    """Ids of words as bytes, encoded when first met; what ``before`` knows is taken from there."""

    def __init__(self, encoder: WordEncoder, before: dict[str, bytes]):
        self.encoder, self.before = encoder, before

    def __missing__(self, word: str) -> bytes:
        ids = self.before.pop(word, None)
        ids = self[word] = self.encoder.word(word) if ids is None else ids
        return ids


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker, which keeps what it knows from task to task."""
    return WordEncoder(path)


_BLOCKS = (
    "shard int, block int, n_ids long, row array<long>, doc_id array<long>, start array<long>, "
    "at array<int>, length array<int>, payload binary"
)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, planes: str = "byte"
) -> None:
    """Write the ids of ``docs`` (``doc_id, text``) to ``path``, in ascending ``doc_id`` order.

    One shard per range partition of the ids; nulls first, rows of equal id in
    order of their text's hash. A shard is a row of blocks of ``block_ids`` ids,
    only its last one shorter, and each block's row also indexes the pieces of
    documents in it: row number and start in the shard, place and length in the
    block. A null text is empty and has the end id alone. Parquet is the
    container, so any store that Spark writes to will do.
    """
    spark = docs.sparkSession
    asked = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("h"),
    )
    keys = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    ordered = asked.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        shard, encode = TaskContext.get().partitionId(), encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        held: list[np.ndarray] = []
        index = {k: [] for k in ("row", "doc_id", "start", "at", "length")}
        block = row = start = filled = 0

        def block_row() -> dict:
            payload = encode_block(np.concatenate(held), planes)
            return {"shard": [shard], "block": [block], "n_ids": [filled], "payload": [payload], **{k: [v] for k, v in index.items()}}

        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ids, done = np.concatenate([encode(text), end]), 0
                while done < len(ids):
                    piece = ids[done : done + block_ids - filled]
                    for k, v in (("row", row), ("doc_id", doc_id), ("start", start), ("at", filled), ("length", len(piece))):
                        index[k].append(v)
                    held.append(piece)
                    filled, done = filled + len(piece), done + len(piece)
                    if filled == block_ids:
                        yield block_row()
                        block, filled, held, index = block + 1, 0, [], {k: [] for k in index}
                row, start = row + 1, start + len(ids)
        if filled:
            yield block_row()

    map_rows(ordered, rows, _BLOCKS).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` read back from files, a row for each row written.

    ``start`` counts the ids of all rows before. ``ids`` are little-endian
    unsigned 32-bit integers; the pieces of a document that lies in several
    blocks are put together.
    """
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    pieces = _pieces(blocks, keep_ids=True)
    joined = pieces.groupBy("shard", "row").agg(
        F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("block", "ids"))).alias("parts"),
    )
    whole = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")
    return _global_start(joined.select("shard", "doc_id", "start", "n_tokens", whole), blocks)


def _pieces(blocks: DataFrame, keep_ids: bool) -> DataFrame:
    """Every piece of a document in every block, decoded; ids are kept of all, or only of documents in several blocks."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for i, payload in enumerate(b["payload"]):
                ids, n = decode_block(payload).astype("<u4"), len(b["row"][i])
                out = {"shard": [b["shard"][i]] * n, "block": [b["block"][i]] * n, "row": b["row"][i], "doc_id": b["doc_id"][i]}
                out |= {"start": b["start"][i], "n": b["length"][i]}
                cut = [ids[a : a + k].tobytes() for a, k in zip(b["at"][i], b["length"][i])]
                # Whole inside the block, unless it is first and began earlier or touches the end of a full block.
                whole = [0 < a and a + k < len(ids) for a, k in zip(b["at"][i], b["length"][i])]
                out["crc"] = [zlib.crc32(c) if w else None for c, w in zip(cut, whole)]
                out["ids"] = cut if keep_ids else [None if w else c for c, w in zip(cut, whole)]
                yield out

    return map_rows(blocks, rows, "shard int, block int, row long, doc_id long, start long, n long, crc long, ids binary")


def _global_start(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Starts within the shard become starts within all shards, and the shard goes."""
    # One row per shard, so the window without partitions is small.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids_in"))
    before = shards.select("shard", F.coalesce(F.sum("ids_in").over(earlier), F.lit(0)).alias("before"))
    return rows.join(before, "shard").withColumn("start", F.col("start") + F.col("before")).drop("shard", "before")


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files; only documents cut by a block's edge are shuffled."""
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    pieces = staged(_pieces(blocks, keep_ids=False), "pieces")

    @F.pandas_udf("long")
    def crc_of(parts: pd.Series) -> pd.Series:
        def one(p) -> int:
            crc = 0
            for x in sorted(p, key=lambda x: x["block"]):
                crc = zlib.crc32(x["ids"], crc)
            return crc

        return parts.map(one)

    whole = pieces.where("crc IS NOT NULL").select("shard", "doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    cut = pieces.where("crc IS NULL").groupBy("shard", "row").agg(
        F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.sum("n").alias("n_tokens"),
        F.collect_list(F.struct("block", "ids")).alias("parts"),
    )
    cut = cut.select("shard", "doc_id", "start", "n_tokens", crc_of("parts").alias("ids_crc32"))
    return _global_start(whole.unionByName(cut), blocks)


def encode_and_digest(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and digest what is read back."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, **options)
    return token_digest(spark, path)
