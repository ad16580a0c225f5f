import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from obsweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


def test_random_texts_get_the_ids_of_the_library(theirs):
    random.seed(5)
    letters = "aaab 's't \n\t  éß日本<|endoftext|>0123#! \x1c 🙂'll THEthe"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(5000)]
    texts += ["a" * 5000, " " * 300, "<|endoftext|>" * 3, "\n\n a  b   ", "don't   stop\n\n\nnow"]
    coder = bpe.load(PATH)
    for text in texts:
        want = theirs.encode(text, add_special_tokens=False).ids
        got = coder.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert coder.decode(got) == theirs.decode(want, skip_special_tokens=False) == text


def test_bytes_that_are_no_text_decode_to_replacements(theirs):
    ids = theirs.encode("日", add_special_tokens=False).ids[:1]
    assert bpe.load(PATH).decode(np.array(ids, dtype="<u4").tobytes()) == theirs.decode(ids, skip_special_tokens=False)


def test_odd_documents_come_back(odd_documents, no_documents, theirs):
    coded = bpe.decode(bpe.encode(odd_documents, PATH), PATH)
    got = coded.collect()
    assert len(got) == odd_documents.count() and coded.columns.count("ids") == 1
    for r in got:
        assert r["decoded"] == (r["text"] or "")
        assert np.frombuffer(r["ids"], "<u4").tolist() == theirs.encode(r["text"] or "", add_special_tokens=False).ids
    assert bpe.encode(no_documents, PATH).count() == 0
