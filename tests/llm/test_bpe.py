import hashlib
import random

import pyarrow.parquet as pq
import pytest

from pagewise.llm import bpe
from pagewise.llm.common import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def theirs():
    return tokenizers.Tokenizer.from_file(tokenizer_path(bpe.VOCABULARY))


def test_same_as_the_library_on_random_text(theirs):
    ours, rnd = bpe.Bpe(tokenizer_path(bpe.VOCABULARY)), random.Random(5)
    letters = ["a", "B", "'s", "'ll", " ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "​", "é", "é", "İ", "Σ", "ß", "١", "12", "²", "½", "한", "日本", "😀", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "don't", "_", "—", "\u0000", "�", "ǅ", "\U0001d400", "the", "ing"]
    for _ in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 25)))
        want = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == want, repr(text)
        assert ours.decode(want) == theirs.decode(want, skip_special_tokens=False)


def test_same_as_the_library_on_documents(theirs):
    ours = bpe.Bpe(tokenizer_path(bpe.VOCABULARY), remembered=500)
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist():
        assert ours.encode(text) == theirs.encode(text, add_special_tokens=False).ids


def test_rows(spark, odd_docs, no_docs, theirs):
    got = sorted((tuple(r) for r in bpe.digest(odd_docs).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in odd_docs.collect():
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    assert bpe.digest(no_docs).count() == 0


def test_decode_is_the_inverse_of_encode(spark, odd_docs):
    both = bpe.encode_texts(odd_docs).withColumnRenamed("decoded", "was")
    assert bpe.decode_ids(both).where("not (decoded <=> was)").count() == 0
    assert {"ids", "decoded", "key", "found"} <= set(bpe.encode_texts(odd_docs).columns)
