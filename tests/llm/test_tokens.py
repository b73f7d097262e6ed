"""BPE and token files against the public libraries, and round trips."""

import functools
import hashlib
import io
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import bpe, tokenfiles
from tesserae.llm.pieces import Memo

public_tokenizers = pytest.importorskip("public_tokenizers")

TEXTS = [
    "", " ", "  ", "a", "Hello world's  end.\n\n  next \t line", "x \n y", "été où ça", "日本語テキスト 漢字", "1234 56 7", "don't we'll  'tis",
    "a b  c", "\x1c \x1d a \x85 b", "tail   ", "<|endoftext|> is text", "🙂🙂 🙃", "aaaaaaaaaaaaaaaaaaaaaaaa" * 5, "the " * 300,
]


def reference():
    import tiktoken

    path, pattern = bpe.vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


CODEC = bpe.Codec(*bpe.vocabulary())


def ids_of(text):
    return np.frombuffer(CODEC.encode([text])[0], "<u4").tolist()


def test_codec_equals_library():
    ref = reference()
    for t in TEXTS:
        assert ids_of(t) == ref.encode_ordinary(t), t
        assert CODEC.decode(CODEC.encode([t])[0]) == t.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'st re\n\t é  日1.,-\x85\x1c🙂"), max_size=40))
def test_codec_equals_library_on_odd_spacing(text):
    assert ids_of(text) == reference().encode_ordinary(text)
    ids, at = library().texts([text, None, text + "!", "", text])
    one = tokenizer().encode(text, add_special_tokens=False).ids
    assert ids[: at[1]].tolist() == one == ids[at[4] :].tolist() and at[1] == at[2] and at[3] == at[4]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@functools.cache
def library():
    return Memo(tokenfiles.library_encoder(public_tokenizers.path("byte_bpe_50k.json")), most=40)


def test_memo_forgets_and_stays_right():
    memo = Memo(tokenfiles.library_encoder(public_tokenizers.path("byte_bpe_50k.json")), most=30)
    for _ in range(3):
        ids, at = memo.texts(TEXTS)
        for k, t in enumerate(TEXTS):
            assert ids[at[k] : at[k + 1]].tolist() == tokenizer().encode(t, add_special_tokens=False).ids, t


def test_perfect_hash_is_minimal_and_exact():
    values = {f"k{i}".encode() * (i % 5 + 1): i for i in range(3000)}
    h = bpe.PerfectHash(values)
    assert sorted(h.keys) == sorted(values)
    assert h.find(list(values)) == list(values.values())
    assert h.find([b"", b"absent", b"k1k"]) == [-1, -1, -1]
    assert bpe.PerfectHash({}).find([b"x"]) == [-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_codes_round_trip(ranks):
    a = np.asarray(ranks, np.uint32)
    control, data = tokenfiles.pack(a)
    assert tokenfiles.unpack(control, data, len(a)).tolist() == ranks
    assert len(control) == -(-len(a) // 4)
    out = io.BytesIO()
    tokenfiles.write_block(out, [5], [len(a)], a)
    out.seek(0)
    (ids, counts, back), = tokenfiles.read_blocks(out)
    assert (ids.tolist(), counts.tolist(), back.tolist()) == ([5], [len(a)], ranks)


def test_token_files_query(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    got = tokenfiles.op2_token_files(spark, sf_dir).toPandas().sort_values("doc_id")
    start, want = 0, []
    for d, e in zip(docs.doc_id, t.encode_batch(list(docs.text), add_special_tokens=False), strict=True):
        ids = np.asarray([*e.ids, 0], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert list(got[["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False, name=None)) == want


@pytest.fixture
def odd(spark):
    rows = [(i, t, "clash") for i, t in enumerate([*TEXTS, None, TEXTS[4], "long " * 60000])]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_token_files_of_odd_texts_and_none(spark, odd, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for docs, n in ((odd, len(TEXTS) + 3), (odd.limit(0), 0)):
        tokens = tokenfiles.encode_texts(docs, path).cache()
        folder = f"file://{tmp_path}/{n}"
        manifest = tokenfiles.write_files(tokens, folder, file_ids=1000).coalesce(2).cache()  # several files from one task
        rows = tokenfiles.read_files(manifest, folder).orderBy("start").collect()
        assert [r.doc_id for r in rows] == list(range(n))
        assert all(r.n_tokens == 1 and r.ids_crc32 == zlib.crc32(bytes(4)) for r in rows if r.doc_id in (0, len(TEXTS)))
        assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:], strict=False))


def test_added_tokens_are_the_library_s(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|><|endoftext|>\n\n c", "no <|endoftext| token", "x" * 5000 + "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {k: [*t.encode(x, add_special_tokens=False).ids, 0] for k, x in enumerate(texts)}
    expand = zstandard.ZstdDecompressor()
    assert {r.doc_id: tokenfiles._ids(bytes(r.ids), expand).tolist() for r in tokenfiles.encode_texts(df, path).collect()} == want
    assert want[0] == [50256, 0]


def test_bpe_query_of_odd_texts_and_none(spark, odd):
    ref = reference()
    path, pattern = bpe.vocabulary()
    rows = bpe.encode_documents(odd, path, pattern).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.asarray(ref.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids, r.ids_sha256) == (len(ids) // 4, ids, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.encode_documents(odd.limit(0), path, pattern).count() == 0


def test_bpe_query(spark, sf_dir):
    ref = reference()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in bpe.op10_byte_bpe(spark, sf_dir).collect():
        assert r.n_tokens == len(ref.encode_ordinary(docs[r.doc_id]))
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_uris_of_shared_folders():
    assert tokenfiles.arrow_uri("s3a://bucket/some/place") == "s3://bucket/some/place"
    assert tokenfiles.arrow_uri("hdfs://host:1/place") == "hdfs://host:1/place"
    assert tokenfiles.filesystem("file:///tmp/place")[1] == "/tmp/place"
