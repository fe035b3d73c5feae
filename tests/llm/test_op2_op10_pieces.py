import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from seqloom.llm import pieces, sentencepieces, tokencount

MODEL = pieces.model_bytes()
FIXED = ["", "a", " ", "  ", "   a    b ", "hello world", "\n\n x", "▁a ▁", "日本語のテキスト", "émoji 😀😀", "<s> </s> <unk> <0x0A>", "a" * 300, " " * 40 + "x", "tab\t\tx", "\0a\0", "don't  stop   now", "ﬁ ligature ​ zero"]


def samples(seed, own):
    r = random.Random(seed)
    out = list(FIXED)
    for _ in range(200):
        out.append("".join(r.choice("abcdefgh tion the  .,éü日本\n😀XYZ019  ") for _ in range(r.randint(1, 60))))
        out.append("".join(r.choice(own.strings[259:]).replace("▁", " ") for _ in range(r.randint(1, 12))))
    return out


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_bpe_is_the_librarys(library):
    own = pieces.load(MODEL)
    texts = samples(1, own)
    ids = library.encode(texts)
    assert own.encode(texts) == ids
    assert own.decode(ids) == library.decode(ids)


def test_unigram_is_the_librarys():
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(MODEL)
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:  # scores that float32 sums keep apart
        p.score = max(p.score, -40000.0) / 4096
    raw = proto.SerializeToString()
    library, own = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.Pieces(raw)

    def total(ids):
        return sum(proto.pieces[i].score for i in ids)

    texts = samples(2, own)
    for mine, theirs in zip(own.encode(texts), library.encode(texts)):
        assert mine == theirs or abs(total(mine) - total(theirs)) < 1e-2


def test_every_prefix(library):
    own = pieces.load(MODEL)
    for text in samples(3, own)[:60]:
        expected = [len(x) for x in library.encode([text[:k] for k in range(len(text) + 1)])]
        counts = tokencount.Counts(own, text)
        assert counts.at.tolist() == expected
        for budget in (0, 1, 3, 7):
            fit = counts.fit(budget)
            assert len(library.encode(fit)) <= budget
            assert all(n > budget for n in expected[len(fit) + 1 :])


def test_counts_of_rows(spark, library):
    long = "tion the of 日本 " * 2000
    rows = [(1, "hello", 5), (2, None, 6), (3, "", 7), (4, long, None), (None, "hello", 9)]
    found = {r.doc_id: r for r in tokencount.count_tokens(spark.createDataFrame(rows, "doc_id int, text string, n_tokens int"), MODEL).collect()}
    assert found[4].n_tokens == len(library.encode(long)) and found[4].over_limit
    fit = found[4].fit_chars
    assert len(library.encode(long[:fit])) <= 4096 < len(library.encode(long[: fit + 1]))
    assert found[2].n_tokens == found[3].n_tokens == 0 and not found[2].over_limit
    assert found[1].n_tokens == found[None].n_tokens and found[1].fit_chars == 5
    assert tokencount.count_tokens(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def test_encoded_rows(spark, library):
    rows = [(1, "a b  c\n"), (2, None), (3, ""), (4, "▁x"), (5, "é" * 5000), (5, "é" * 5000)]
    df = sentencepieces.encode_texts(spark.createDataFrame(rows, "doc_id long, text string"), MODEL)
    found = {r.doc_id: r for r in sentencepieces.decode_ids(df, MODEL).collect()}
    assert df.count() == 6
    assert found[1].ids == library.encode("a b  c\n") and found[1].round_trip and found[1].decoded == "a b  c\n"
    assert found[2].ids == [] and found[3].n_pieces == 0
    assert not found[4].round_trip and found[5].round_trip


def test_one_very_long_chunk(library):
    """A text without a space is one chunk: its lattice is solved whole."""
    own = pieces.load(MODEL)
    r = random.Random(11)
    for text in ("a" * 300_000, "".join(r.choice("abcdefghijklmnopqrstuvwxyzé日") for _ in range(100_000)), "=" * 30_000 + "x"):
        ids = library.encode(text)
        assert own.encode([text]) == [ids]
        assert own.prefix_counts(text)[-1] == len(ids)
        assert own.decode([ids]) == [text]


@pytest.mark.parametrize("kind", [pieces.BPE, pieces.UNIGRAM])
def test_a_chunk_alone_is_solved_like_many(kind):
    own = pieces.Pieces(MODEL, kind)
    r = random.Random(12)
    for _ in range(60):
        text = "".join(r.choice("abcdeé日😀 ion the=\x01") for _ in range(r.randint(1, 80))).replace(" ", pieces.SPACE)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        assert own._alone(points) == own._lattice(points[:, None])[0]


def test_empty_tables_and_clashing_names(spark, library):
    schema = "doc_id long, text string, ids string, n_pieces string, round_trip string, n_bytes string"
    assert sentencepieces.encode_texts(spark.createDataFrame([], schema), MODEL).count() == 0
    assert tokencount.count_tokens(spark.createDataFrame([], schema), MODEL).count() == 0
    df = spark.createDataFrame([(1, "some text", "i", "n", "r", "b"), (None, None, None, None, None, None), (1, "some text", "i", "n", "r", "b")], schema)
    rows = sentencepieces.encode_texts(df, MODEL).collect()
    assert sorted(str(x.doc_id) for x in rows) == ["1", "1", "None"] and all(x.round_trip for x in rows)
    assert [x.ids for x in rows if x.doc_id] == [library.encode("some text")] * 2
    assert sorted(x.n_bytes for x in tokencount.count_tokens(df, MODEL).collect()) == [0, 9, 9]
