import random
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from helpers import awkward, table
from quarry.llm.piece_codec import PieceCodec, encode_decode
from quarry.llm.token_counts import ByteBpe, TokenCounter, count_tokens, read_vocabulary

BPE, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def odd_texts(n, seed):
    r = random.Random(seed)
    letters = "ab 's\n\t é\x1c   Яд中文1२٣!?<|endoftext|>\U0001F600՘Ɤ're'LL▁the<s>�\x00"
    out = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(n)]
    out += ["".join(chr(r.choice([r.randint(1, 0x24F), r.randint(0x250, 0xD7FF), r.randint(0x10000, 0x1FFFF)])) for _ in range(20))
            for _ in range(n)]
    return out + ["ab" * 3000 + "  " * 40, "x" * 5000, "a<|endoftext|><|endoftext|>b", " ", "  ", "\n\n a", "▁▁ a"]


@pytest.fixture(scope="module")
def counter():
    parts = read_vocabulary(BPE)
    whole = ByteBpe(parts["merges"], parts["ids"]).prove_whole(list(parts["ids"]))
    return TokenCounter(parts, whole, 100)          # a tiny memo: generations turn over


def test_counts_equal_the_library(counter):
    t = Tokenizer.from_file(BPE)
    texts = odd_texts(400, 1)
    assert counter.counts(texts) == [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


def test_whole_set_is_proved(counter):
    t = Tokenizer.from_file(BPE)
    some = sorted(counter.whole)[::97]
    assert all(len(t.model.tokenize("".join(counter.bpe.letters[b] for b in w.encode()))) == 1 for w in some)


def test_count_query_cases(spark):
    t = Tokenizer.from_file(BPE)
    docs = awkward(spark)
    rows = count_tokens(docs, BPE).collect()
    assert len(rows) == docs.count()
    expect = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), len(t.encode(r["text"] or "", add_special_tokens=False).ids))
                    for r in docs.collect())
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in rows) == expect
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in rows)
    assert count_tokens(docs.limit(0), BPE).count() == 0


def test_agenda_equals_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    with open(PIECES, "rb") as f:
        codec = PieceCodec(f.read(), cap=50)
    texts = odd_texts(400, 2)
    ids = codec.encode(texts)
    assert ids == sp.encode(texts)
    assert [codec.decode(x) for x in ids] == sp.decode(ids)
    assert codec.differs == 0
    r = random.Random(3)
    for _ in range(500):
        some = [r.choice([r.randint(3, 258), r.randint(0, 31999), r.randint(195, 230)]) for _ in range(r.randint(0, 9))]
        assert codec.decode(some) == sp.decode(some)


def test_codec_query_cases(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = awkward(spark)
    got = {(r["doc_id"], tuple(r["ids"]), r["decoded"], r["n_differs"]) for r in encode_decode(docs, PIECES).collect()}
    want = {(r["doc_id"], tuple(sp.encode(r["text"] or "")), sp.decode(sp.encode(r["text"] or "")), 0) for r in docs.collect()}
    assert got == want
    assert encode_decode(docs.limit(0), PIECES).count() == 0


def test_registered_digests(spark):
    import __spark_entry__ as entry
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in entry.queries()["op5_piece_codec"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = sp.encode(r["text"])
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == sha256(sp.decode(ids).encode()).hexdigest()
