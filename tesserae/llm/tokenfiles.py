"""Token files: frequency-ranked ids in byte-aligned variable-length code, control bytes apart from data bytes.

The commonest id gets rank 0. A rank takes one to four bytes; two bits tell how many, and one control byte holds those
of four ranks. A file is a run of blocks, each with its header, its table of documents, control bytes and data bytes,
so that a reader needs one block in memory. Decoding looks the control bytes up in a table of lengths and fills all
ranks at once by numpy. ``ranks.npy`` beside the files maps ranks to ids.

Every attempt of a task writes a file of its own name. The manifest, which Spark commits, lists those of the attempts
that count, so a repeated or lost task leaves no trace in the result; each file's ids lie apart from all others'.

Edge cases: null and empty texts hold the end id alone. Documents of equal doc_id follow each other in the order of
their ids' bytes; null ids come first. An empty table makes no files and an empty result. Extra columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .pieces import Memo
from .scratch import Scratch
from .words import batches, tidy

MAGIC = b"TKVB\1\0\0\0"
BLOCK_IDS = 1 << 20
FILE_IDS = 8 << 20
NO_ID = -(1 << 63)  # in files, for a null doc_id

_LENGTHS = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], axis=1).astype(np.uint8)
_MASK = np.arange(4) < np.arange(1, 5)[:, None]


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of the ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    code = (ranks >> 8 > 0).astype(np.uint8) + (ranks >> 16 > 0) + (ranks >> 24 > 0)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = code
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[_MASK[code]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of these bytes."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[_MASK[lengths - 1]] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")


def write_block(out, doc_ids: list[int], counts: list[int], ranks: np.ndarray) -> None:
    control, data = pack(ranks)
    out.write(MAGIC + struct.pack("<qqqq", len(doc_ids), len(ranks), len(control), len(data)))
    for part in (np.asarray(doc_ids, "<i8").tobytes(), np.asarray(counts, "<i8").tobytes(), control, data):
        out.write(part)


def read_blocks(stream):
    """doc_ids, counts and ranks of each block."""
    while head := stream.read(40):
        if head[:8] != MAGIC:
            raise ValueError("not a token file")
        docs, n, c, d = struct.unpack("<qqqq", head[8:])
        ids, counts = (np.frombuffer(stream.read(8 * docs), "<i8") for _ in range(2))
        yield ids, counts, unpack(stream.read(c), stream.read(d), n)


def library_encoder(path: str):
    """Pieces' ids by the tokenizers library. Pieces without inner white space go to it many at a time, a line feed
    between them: it is a match and a token of its own there, and its id tells where a piece ends."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    one = lambda x: np.asarray(t.encode_batch_fast([x], add_special_tokens=False)[0].ids, np.uint32)
    mark = one("\n")

    def encode(pieces: list[str], plain: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        found: list = [None] * len(pieces)
        joint = [k for k, x in enumerate(plain) if x] if len(mark) == 1 else []
        for begin in range(0, len(joint), 4096):
            part = joint[begin : begin + 4096]
            ids = one("\n".join([pieces[k] for k in part]))
            at = np.flatnonzero(ids == mark[0])
            if len(at) == len(part) - 1:
                for k, x, y in zip(part, [-1, *at.tolist()], [*at.tolist(), len(ids)], strict=True):
                    found[k] = ids[x + 1 : y]
        found = [one(pieces[k]) if x is None else x for k, x in enumerate(found)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.concatenate(found) if found else np.zeros(0, np.uint32), counts

    return encode


_memos: dict[str, Memo] = {}


def _memo(path: str) -> Memo:
    """One for each worker process, kept between tasks."""
    if path not in _memos:
        _memos[path] = Memo(library_encoder(path))
    return _memos[path]


def added_tokens(path: str) -> list[str]:
    """Strings that the library finds in a text before anything else, wherever they stand."""
    from tokenizers import Tokenizer

    return [x.content for x in Tokenizer.from_file(path).get_added_tokens_decoder().values()]


def whole_or_pieces(memo: Memo, added: list[str], texts: list) -> list[np.ndarray]:
    """Ids of each text: from its pieces, or as a whole where it has an added token, which pieces would tear."""
    whole = [x is not None and any(a in x for a in added) for x in texts]
    ids, at = memo.texts([None if w else x for x, w in zip(texts, whole, strict=True)])
    return [memo.encode([x], [False])[0] if w else ids[b:e] for x, w, b, e in zip(texts, whole, at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encode_texts(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """doc_id, n_tokens and the compressed ids of each text with the end id behind."""
    ship(docs.sparkSession)

    def run(tables):
        memo, added, squeeze = _memo(tokenizer), added_tokens(tokenizer), zstandard.ZstdCompressor(level=1)
        for t in tables:
            for texts, doc_ids in batches(t, ["text", "doc_id"]):
                made = [np.append(ids, np.uint32(end_id)) for ids in whole_or_pieces(memo, added, texts)]
                # Bytes of equal weight side by side compress better.
                packed = [squeeze.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()) for x in made]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array([len(x) for x in made], pa.int64()), pa.array(packed, pa.binary())],
                    ["doc_id", "n_tokens", "ids"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids binary")


def _ids(packed: bytes, expand) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(expand.decompress(packed), np.uint8).reshape(4, -1).T).reshape(-1).view("<u4")


def frequencies(tokens: DataFrame) -> DataFrame:
    """token and n, of all documents; each task sums its own."""

    def run(tables):
        counts, expand = np.zeros(0, np.int64), zstandard.ZstdDecompressor()
        for t in tables:
            for x in t.column(t.schema.get_field_index("ids")):
                c = np.bincount(_ids(x.as_py(), expand))
                if len(c) > len(counts):
                    counts = np.pad(counts, (0, len(c) - len(counts)))
                counts[: len(c)] += c
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["token", "n"])

    return tokens.select("ids").mapInArrow(tidy(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def arrow_uri(folder: str) -> str:
    """A URI as Spark writes it in the form that Arrow knows: Hadoop's names of S3 are mapped."""
    scheme, _, rest = folder.partition("://")
    return f"s3://{rest}" if scheme in ("s3a", "s3n") else folder


def filesystem(folder: str):
    return pyarrow.fs.FileSystem.from_uri(arrow_uri(folder))


def write_files(tokens: DataFrame, folder: str, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes token files in ascending doc_id order under ``folder`` (a URI that executors reach) and returns first_id, file,
    n_docs and n_tokens of each. The table of ranks is as long as the vocabulary at most, whatever the corpus."""
    total, = tokens.agg(F.sum("n_tokens")).first()
    counts = frequencies(tokens).orderBy(F.desc("n"), "token").select("token").toPandas()["token"].to_numpy()
    ranks = np.zeros(int(counts.max(initial=0)) + 1, np.uint32)
    ranks[counts] = np.arange(len(counts), dtype=np.uint32)
    fs, top = filesystem(folder)
    fs.create_dir(top, recursive=True)
    with fs.open_output_stream(f"{top}/ranks.npy") as out:
        np.save(out, counts.astype(np.uint32))
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)

    def run(tables):
        fs, top = filesystem(folder)
        expand, name, first = zstandard.ZstdDecompressor(), f"{uuid.uuid4().hex}.tkv", None
        docs, counts, held, size, n_docs, n_ids, out = [], [], [], 0, 0, 0, None
        for t in tables:
            for d, x in zip(t.column(0).to_pylist(), t.column(1), strict=True):
                ids = _ids(x.as_py(), expand)
                docs.append(NO_ID if d is None else d)
                first = docs[0] if first is None else first
                counts.append(len(ids))
                held.append(shared.value[ids])
                size += len(ids)
                if size >= BLOCK_IDS:
                    out = out or fs.open_output_stream(f"{top}/{name}")
                    write_block(out, docs, counts, np.concatenate(held))
                    n_docs, n_ids = n_docs + len(docs), n_ids + size
                    docs, counts, held, size = [], [], [], 0
        if docs:
            out = out or fs.open_output_stream(f"{top}/{name}")
            write_block(out, docs, counts, np.concatenate(held))
            n_docs, n_ids = n_docs + len(docs), n_ids + size
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (first, name, n_docs, n_ids)], ["first_id", "file", "n_docs", "n_tokens"])

    files = max(1, -(-(total or 0) // file_ids))
    dealt = tokens.select("doc_id", "ids").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "ids")
    return dealt.mapInArrow(tidy(run), "first_id long, file string, n_docs long, n_tokens long")


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files; ``start`` counts the ids before it."""
    before = Window.orderBy("first_id").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = manifest.select("first_id", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))

    def run(tables):
        fs, top = filesystem(folder)
        with fs.open_input_file(f"{top}/ranks.npy") as f:
            vocabulary = np.load(f).astype("<u4")
        for t in tables:
            for file, start in zip(t.column(1).to_pylist(), t.column(2).to_pylist(), strict=True):
                with fs.open_input_stream(f"{top}/{file}") as stream:
                    for docs, counts, ranks in read_blocks(stream):
                        ids, ends = vocabulary[ranks], np.cumsum(counts)
                        crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == NO_ID), pa.array(start + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += int(ends[-1])

    n = max(1, manifest.count())
    return placed.repartitionByRange(n, "first_id").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Encodes all documents, writes token files, and returns doc_id, start, n_tokens and ids_crc32 as read from them."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    scratch = Scratch(spark, "op2")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens = scratch.save(encode_texts(docs, tokenizer), "tokens")
    folder = f"{scratch.path}/files"
    return read_files(scratch.save(write_files(tokens, folder), "manifest"), folder)
