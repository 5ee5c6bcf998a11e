"""Token counts, token files and SentencePiece against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import pytest

from bytebasin.llm import common, sentencepieces, token_counts, token_output
from bytebasin.llm.elias_fano import EliasFano
from bytebasin.llm.queries import tokenizer_file
from bytebasin.llm.word_bpe import WordEncoder

TEXTS = [None, "", "   ", "Hello <|endoftext|>World", "naïve Café's it's 'S 'll", "日本語 text Σ ΑΣ", "a\x1cb.\x1c.", "x́ é", "½ ² 12345 İstanbul", "don't'S''t", "a​b", " ſ ŉ ª", "a.,. b.\n.c, d_, e", "a\x85b\xa0c", "▁a ▁ b▁▁", "a  b   c", "</s>[INST]", "nul\x00l", "😀 emoji 𝔘", "z" * 5000, "same", "same"]


def rows(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, ids int")


def corpus(spark, sf):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))


def test_word_encoder_is_the_library(spark, sf, library):
    texts = [t or "" for t in TEXTS] + corpus(spark, sf)
    for size in (400_000, 300):
        encoder = WordEncoder(tokenizer_file("word_bpe_49k.json"), cache_size=size)
        got = [np.frombuffer(b"".join(p), encoder.dtype).tolist() for p in encoder.pieces(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_latin_character_before_a_mark_is_the_library(library):
    ends = (". ", ", ", ".\n", "! ", "., ")
    texts = [f"{before}{chr(c)}{end}2 b" for c in range(0x180) for before in ("6 ", "a") for end in ends]
    encoder = WordEncoder(tokenizer_file("word_bpe_49k.json"))
    got = [np.frombuffer(b"".join(p), encoder.dtype).tolist() for p in encoder.pieces(texts)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [t for t, g, w in zip(texts, got, want) if g != w] == []


def test_counts(spark, sf, library):
    texts = TEXTS + corpus(spark, sf)
    got = {r.doc_id: r for r in token_counts.with_token_counts(rows(spark, texts), tokenizer_file("word_bpe_49k.json"), limit=5).collect()}
    assert len(got) == len(texts) and got[0].ids == 1
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 5)


def test_counts_of_an_empty_table(spark):
    assert token_counts.with_token_counts(rows(spark, []), tokenizer_file("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("values", [[], [0], [7], [0, 0, 0], [1, 1, 5, 900, 901, 70000], list(range(0, 30000, 7)), [3] * 1000 + [10**9]])
def test_elias_fano(values):
    form = EliasFano.from_bytes(EliasFano.of(np.array(values, "i8")).to_bytes())
    assert [form.select(i) for i in range(len(values))] == values
    if len(values) > 1000:
        assert len(form.to_bytes()) * 8 <= len(values) * (3 + np.log2(values[-1] / len(values))) + 400


def test_token_files(spark, sf, library):
    texts = TEXTS + corpus(spark, sf)
    docs = rows(spark, texts).repartition(5)
    folder = common.shared_folder(spark, "test")
    manifest = token_output.write_token_shards(docs, folder, tokenizer_file("word_bpe_49k.json"), shards=3)
    assert len(manifest) == 3
    got = {r.doc_id: r for r in token_output.read_token_shards(spark, folder, manifest).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    shard = token_output.TokenShard(f"{folder}/{manifest[1]['file']}")
    at = [shard.span(i) for i in range(manifest[1]["n_docs"])]
    assert at[0][0] == 0 and all(a[1] == b[0] for a, b in zip(at, at[1:])) and at[-1][1] == manifest[1]["n_tokens"]
    assert [shard.doc_id(i) for i in range(shard.n_docs)] == sorted(i for i in got if manifest[1]["start"] <= got[i].start < manifest[2]["start"])


def test_token_files_with_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "b"), (3, "b"), (3, "a"), (3, "a"), (2**60 + 1, None), (-(2**62), "c")], "doc_id long, text string")
    folder = common.shared_folder(spark, "test")
    manifest = token_output.write_token_shards(docs, folder, tokenizer_file("word_bpe_49k.json"))
    got = [tuple(r)[:3] for r in token_output.read_token_shards(spark, folder, manifest).orderBy("start").collect()]
    assert got == [(-(2**62), 0, 2), (3, 2, 2), (3, 4, 2), (3, 6, 2), (2**60 + 1, 8, 1), (None, 9, 2)]
    nothing = token_output.write_token_shards(docs.limit(0), folder, tokenizer_file("word_bpe_49k.json"))
    assert nothing == [] and token_output.read_token_shards(spark, folder, nothing).count() == 0


def test_pieces(spark, sf):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    texts = TEXTS + corpus(spark, sf)
    path = tokenizer_file("piece_bpe_32k.model")
    got = {r.doc_id: r for r in sentencepieces.with_piece_digests(rows(spark, texts), path).collect()}
    full = {r.doc_id: r.pieces for r in sentencepieces.with_pieces(rows(spark, TEXTS), path).collect()}
    for i, t in enumerate(texts):
        ids = [1, *sp.encode(t or ""), 2]
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
        assert got[i].covered_bytes == len((t or "").encode())
        if i in full:
            assert full[i].ids == ids and len(full[i].starts) == len(full[i].ends) == len(ids)
    one = full[TEXTS.index("a  b   c")]
    assert [b"a  b   c"[s:e] for s, e in zip(one.starts, one.ends)][1:-1] == [b"a", b"  ", b"b", b"   ", b"c"] or one.starts[1] == 0


def test_spans_agree_with_the_library(spark, sf):
    path = tokenizer_file("piece_bpe_32k.model")
    encoder = sentencepieces.PieceEncoder(path)
    for t in corpus(spark, sf)[:40] + [t for t in TEXTS if t and "\x00" not in t]:
        ids = encoder.processor.encode(t)
        start, end = encoder.spans(t, np.array(ids, int))
        proto = encoder.processor.encode(t, return_type="proto")
        for p, s, e in zip(proto.pieces, start.tolist(), end.tolist()):
            if not encoder.processor.is_byte(p.id):
                assert (s, e) == (p.begin, p.end), (t, p)


def test_compiled_character_map():
    """The library's own normalisation maps, read by us, give its results; alignments point to the replaced characters."""
    from sentencepiece import SentencePieceNormalizer

    texts = ["ｆｕｌｌ　ｗｉｄｔｈ ﬁn ½ ①", "x́ é", "Ａ  ｂ\t", "ﷺ", "plain", " a ", "", "한국어 ㍿"]
    for rule in ("nfkc", "nmt_nfkc", "nfkc_cf"):
        theirs = SentencePieceNormalizer(rule_name=rule)
        model = theirs.serialized_model_proto() if hasattr(theirs, "serialized_model_proto") else None
        if model is None:
            pytest.skip("the library does not give its map")
        ours = sentencepieces.Normalizer(model)
        for t in texts:
            text, start, end = ours(t.encode())
            assert text.decode() == theirs.normalize(t), (rule, t)
            assert len(start) == len(end) == len(text) and (np.diff(start) >= 0).all() and (start <= end).all()
    assert [int(x) for x in ours("ﬁn".encode())[2]][-1] == 4


def test_elias_fano_over_many_chunks():
    import numpy as np

    from bytebasin.llm import elias_fano

    rng = np.random.default_rng(9)
    for n in (elias_fano.CHUNK - 1, elias_fano.CHUNK, 2 * elias_fano.CHUNK + 3):
        values = np.cumsum(rng.integers(0, 3000, n))
        found = elias_fano.EliasFano.from_bytes(elias_fano.EliasFano.of(values).to_bytes())
        at = [0, n - 1, elias_fano.CHUNK - 2, *rng.integers(0, n, 300).tolist()]
        assert [found.select(i) for i in at] == [int(values[i]) for i in at]


def test_repeated_rows_fare_alike_and_stay(spark):
    """Rows alike in every column are there as often as before, each with the same answer."""
    texts = ["same text, twice", "same text, twice", None, None, "", ""]
    docs = spark.createDataFrame([(1, t, "x", 1) for t in texts], "doc_id long, text string, pieces string, n_bytes int")
    counted = [tuple(r) for r in token_counts.with_token_counts(docs, tokenizer_file("word_bpe_49k.json")).collect()]
    pieces = [(r.text, tuple(r.pieces.ids), r.pieces.decoded) for r in sentencepieces.with_pieces(docs, tokenizer_file("piece_bpe_32k.model")).collect()]
    for got in (counted, pieces):
        assert len(got) == 6 and len(set(got)) == 3
    assert {(t, d) for t, _, d in pieces} == {("same text, twice", "same text, twice"), (None, ""), ("", "")}


def test_pieces_of_an_empty_table(spark):
    docs = rows(spark).limit(0)
    for decoded in (True, False):
        found = sentencepieces.with_pieces(docs, tokenizer_file("piece_bpe_32k.model"), decoded=decoded)
        assert found.columns == [*docs.columns, "pieces"] and found.collect() == []
