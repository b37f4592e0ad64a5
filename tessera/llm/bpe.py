"""BPE encoding and decoding with a distinct-word table.

Texts are split into words in Spark tasks. A task keeps a dictionary of its run of texts, a chunk: texts become arrays of
places in the dictionary, and the dictionary goes, by hash of the word, to the buckets of one distinct-word table. There
each distinct word of all texts is encoded once. Every chunk gets the ids of its words back, joined by chunk, and lays
them out by position. Decoding joins ids with the table of id and piece and strings the pieces together by position.

What is shuffled is thus the distinct words of each chunk and compressed places, not a row for each word of each text.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import give_back
from .common import bucketed

#: Bytes of text that share one dictionary, at most (one text may be longer).
CHUNK_BYTES = 48 << 20
#: Words whose places are packed in one row, about; level of compression.
ROW_WORDS, LEVEL = 1 << 18, 6
#: Buckets of the distinct-word table for each shuffle partition.
BUCKETS = 3
#: Characters with Unicode's White_Space property.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of other characters with one space before it, or white space up to that. A byte-level pre-tokenizer's words
#: never span two of these, so its result for a text is that for its words on end.
WORD = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks have all cores; threads of their own hold memory
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(2)
def added_tokens(path: str) -> re.Pattern | None:
    """Matches the strings of added tokens, which stand outside words; longer ones first."""
    names = sorted((x.content for x in _tokenizer(path).get_added_tokens_decoder().values()), key=lambda x: (-len(x), x))
    return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None


def split_words(text: str, added: re.Pattern | None) -> list[str]:
    """The words of a text, which on end give the text; strings of added tokens are words of their own."""
    if added is None or not added.search(text):
        return WORD.findall(text)
    return [w for k, part in enumerate(added.split(text)) for w in ([part] if k % 2 else WORD.findall(part))]


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length as compressed byte planes."""
    raw = b"".join(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays)
    return zstandard.compress(raw, LEVEL)


def _unpack(data: bytes, arrays: int = 1) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(arrays, 4, -1)
    return [np.ascontiguousarray(p.T).view("<u4").ravel() for p in planes]


def _words(text: bytes, sizes: bytes) -> list[str]:
    ends = np.cumsum(_unpack(sizes)[0], dtype=np.int64).tolist()
    whole = zstandard.decompress(text).decode("utf-8", "surrogatepass")
    return [whole[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def _chunks(path: str, buckets: int, schema: pa.Schema):
    """Of texts: rows that each hold the places in the dictionary of some texts' words, and for each chunk and bucket a
    row with words and places. Places go by falling frequency in the chunk, so that most are small numbers."""

    added = added_tokens(path)  # splitting needs no more of the tokenizer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, size, book, keys, texts = 0, 0, {}, [], []

        def finish() -> Iterator[pa.RecordBatch]:
            chunk, count = part << 32 | number, np.array([len(t) for t in texts], np.int64)
            codes = np.concatenate(texts) if texts else np.zeros(0, np.int32)
            order = np.argsort(-np.bincount(codes, minlength=len(book)), kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            codes, words, rows = place[codes], list(book), []
            ends = np.cumsum(count)
            group = (ends - count) // ROW_WORDS
            for i in np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(count) else ():
                j = int(np.searchsorted(group, group[i], "right"))
                rows.append((keys[i:j], chunk, None, _pack(codes[ends[i] - count[i] : ends[j - 1]]), _pack(count[i:j]), None))
            of: dict[int, list[int]] = {}
            for k, at in enumerate(order):
                of.setdefault(zlib.crc32(words[at].encode("utf-8", "surrogatepass")) % buckets, []).append(k)
            for b, own in sorted(of.items()):
                mine = [words[order[k]] for k in own]
                rows.append((None, chunk, b, _pack(np.diff(own, prepend=0)), _pack(np.array([len(w) for w in mine])), zstandard.compress("".join(mine).encode("utf-8", "surrogatepass"), LEVEL)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                words = split_words(text.as_py() or "", added)
                texts.append(np.fromiter((book.setdefault(w, len(book)) for w in words), np.int32, len(words)))
                keys.append(key.as_py())
                size += sum(map(len, words))
                if size >= CHUNK_BYTES:
                    yield from finish()
                    number, size, book, keys, texts = number + 1, 0, {}, [], []
        yield from finish()
        book, texts = {}, []
        give_back()

    return run


def _encoded(path: str):
    """Of one bucket's rows: for each chunk its places with the lengths and ids of their words, each word encoded once."""

    def run(table: pa.Table) -> pa.Table:
        rows, known = [], {}
        for sizes, text in zip(table.column("sizes"), table.column("words"), strict=True):
            rows.append(_words(text.as_py(), sizes.as_py()))
            for w in rows[-1]:
                known.setdefault(w, len(known))
        words, flat, size = list(known), array("I"), array("I")
        for k in range(0, len(words), 1024):  # encodings are large objects
            for e in _tokenizer(path).encode_batch(words[k : k + 1024], add_special_tokens=False):
                flat.extend(e.ids)
                size.append(len(e.ids))
        ids, size = np.frombuffer(flat, np.uint32), np.frombuffer(size, np.uint32).astype(np.int64)
        start, packed = np.cumsum(size) - size, []
        for ws in rows:
            at = np.fromiter((known[w] for w in ws), np.int64, len(ws))
            packed += [_pack(size[at]), _pack(ids[_spread(start[at], size[at])])]
        del words, known, rows, flat, ids
        give_back()
        return pa.table({"chunk": table.column("chunk"), "codes": table.column("codes"), "counts": pa.array(packed[::2], pa.binary()), "ids": pa.array(packed[1::2], pa.binary())})

    return run


def piece_table(path: str) -> dict[int, bytes]:
    """Bytes of every id: a byte-level token's characters stand for bytes; an added token's string is its bytes."""
    t = _tokenizer(path)
    # Fixed rule: printable Latin-1 characters stand for their own bytes, and the rest follow from U+0100 on.
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
    out = {i: bytes(map(byte_of.__getitem__, name)) if all(c in byte_of for c in name) else name.encode() for name, i in t.get_vocab(with_added_tokens=True).items()}
    return out


def _texts(schema: pa.Schema, pieces):
    """Of one chunk's texts and dictionary: ids by position, and the decoded text."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        for cached in (added_tokens, _tokenizer):  # earlier stages' work; this worker goes on to other operators
            cached.cache_clear()
        edges, blob = pieces.value
        parts = [(np.cumsum(_unpack(a.as_py())[0], dtype=np.int64), _unpack(b.as_py())[0], _unpack(c.as_py())[0]) for a, b, c in zip(words.column("codes"), words.column("counts"), words.column("ids"), strict=True)]
        total = max((int(a.max()) + 1 for a, _, _ in parts if len(a)), default=0)
        count, start = np.zeros(total, np.int64), np.zeros(total, np.int64)
        ids = np.concatenate([c for _, _, c in parts]) if parts else np.zeros(0, np.uint32)
        at = 0
        for a, n, c in parts:
            count[a] = n
            start[a] = at + np.cumsum(n, dtype=np.int64) - n
            at += len(c)
        keys, made = [], []
        for own, sizes, codes in zip(docs.column("keys"), docs.column("sizes"), docs.column("codes"), strict=True):
            keys += own.as_py()
            all_places, ends = _unpack(codes.as_py())[0], np.cumsum(_unpack(sizes.as_py())[0], dtype=np.int64)
            for places in np.split(all_places, ends[:-1]):
                mine = ids[_spread(start[places], count[places])]
                begin = np.where(mine > 0, edges[mine - 1], 0) if len(mine) else np.zeros(0, np.int64)
                text = blob[_spread(begin, edges[mine] - begin)].tobytes()
                made.append((len(mine), mine.astype("<u4").tobytes(), text.decode("utf-8", "replace")))
        n, i, t = zip(*made, strict=True) if made else ((), (), ())
        out = pa.table([pa.array(c, k) for c, k in zip((keys, n, i, t), schema.types, strict=True)], schema=schema)
        parts = count = start = ids = keys = made = n = i = t = None
        give_back()
        return out

    return run


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), then from start[1] and so on."""
    total = int(count.sum())
    out = np.ones(total, np.int64)
    some = count > 0
    start, count = np.asarray(start[some], np.int64), np.asarray(count[some], np.int64)
    if total:
        heads = np.cumsum(count) - count
        out[heads] = start
        out[heads[1:]] -= start[:-1] + count[:-1] - 1
    return np.cumsum(out)


def encode_decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids, decoded) for each row of df.

    ids are those of the ``tokenizers`` library for the whole text with the byte-level BPE file at ``tokenizer`` and
    add_special_tokens=False (strings of added tokens in a text become those tokens), as little-endian unsigned 32-bit
    integers; decoded is the text of the ids' pieces, with special tokens. Pieces come from a join of each id with the
    table of id and piece, whose size the vocabulary bounds and which is therefore broadcast.

    Null and empty texts have no tokens and decode to ''. Repeated rows and null ids each give a row. An empty df gives
    an empty result. Other columns of df are ignored, whatever their names. A task holds one chunk's dictionary, one
    bucket's distinct words (BUCKETS times spark.sql.shuffle.partitions of them), or one chunk's packed texts.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("__key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = docs.schema["__key"].dataType
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    made = f"keys array<{key.simpleString()}>, chunk long, bucket int, codes binary, sizes binary, words binary"
    kinds = to_arrow_schema(spark.createDataFrame([], made).schema)
    # Bucketed by chunk, so that the packed texts are read where their chunk is put together, without a shuffle.
    split = bucketed(docs.mapInArrow(_chunks(tokenizer, BUCKETS * buckets, kinds), made), "chunk", buckets, "chunks")
    words = split.where("bucket is not null").select("chunk", "bucket", "codes", "sizes", "words")
    words = words.groupBy("bucket").applyInArrow(_encoded(tokenizer), "chunk long, codes binary, counts binary, ids binary")
    table = piece_table(tokenizer)
    blob = [table.get(i, b"") for i in range(max(table, default=-1) + 1)]
    pieces = spark.sparkContext.broadcast((np.cumsum([len(b) for b in blob], dtype=np.int64), np.frombuffer(b"".join(blob), np.uint8)))
    result = f"__key {key.simpleString()}, n_tokens long, ids binary, decoded string"
    out_schema = to_arrow_schema(spark.createDataFrame([], result).schema)
    texts = split.where("bucket is null").select("keys", "chunk", "codes", "sizes")
    out = texts.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(_texts(out_schema, pieces), result)
    return out.withColumnRenamed("__key", id_col)


def default_tokenizer() -> str:
    """Path of the byte-level BPE file that is used where none is given."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_bpe_words(spark, sf_dir: str) -> DataFrame:
    return digests(encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer()))
