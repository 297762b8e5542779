import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from ledgerline.llm.tokens import Vocabulary, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_counts_equal_the_library(documents, library):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in token_counts(documents, PATH).collect():
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def test_random_and_endless_texts(library):
    vocabulary, rng = Vocabulary(open(PATH, "rb").read()), random.Random(3)
    letters = ["aaab ", "the in on er an re he  ", "\n\t \r▁é😀日本語", "<s></unk>0123456789 ", "abcdefghijklmnopqrstuvwxyzA.,'"]
    texts = ["".join(rng.choice(a) for _ in range(rng.choice([1, 5, 60, 300]))) for a in letters for _ in range(60)]
    texts += [" " * n for n in range(1, 70)] + [" " * 4000, "a" * 6000, "ab" * 3000, "= " * 500, "\u0000x"]
    for text in texts:
        assert sum(vocabulary.counts(vocabulary.pretokens(text))) == len(library.encode(text)), text[:50]


def test_odd_rows(odd, empty, library):
    found = token_counts(odd, PATH).collect()
    assert len(found) == odd.count()
    by = {r.doc_id: (r.n_bytes, r.n_tokens) for r in found if r.doc_id}
    assert by[1] == (0, 0) and by[2] == (0, 0) and by[8][1] == len(library.encode("日本語 😀 ünïcode \u0000 text"))
    assert next(r.over_limit for r in found if r.doc_id == 6)
    assert token_counts(empty, PATH).collect() == []
    twice = token_counts(odd.withColumn("doc_id", F.lit("name")), PATH).collect()
    assert {r.doc_id for r in twice} == {"name"}
