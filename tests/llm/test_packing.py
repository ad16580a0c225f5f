import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from obsweave.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 40, 20_000])
def test_plan_places_every_part_once(n):
    random.seed(n)
    histogram = Counter(x for x in (int(random.lognormvariate(6.5, 1.2)) % 4096 for _ in range(n)) if x)
    at = packing.plan(histogram, 4096, 16)
    parts, used = defaultdict(list), defaultdict(list)
    for tail, lo, hi, start, length, sequence, offset in zip(*(at[c].tolist() for c in ("tail", "lo", "hi", "start", "length", "sequence", "offset"))):
        for k in range(hi - lo):
            parts[tail, lo + k].append((start, length))
            used[sequence + k].append((offset, length))
    assert len(parts) == sum(histogram.values())
    for pieces, most in [(p, tail) for (tail, _), p in parts.items()] + [(u, None) for u in used.values()]:
        end = 0
        for start, length in sorted(pieces):
            assert start == end
            end += length
        assert end == most if most else end <= 4096
    if n > 1000:
        padding = 4096 * at["sequences"] - sum(k * v for k, v in histogram.items())
        assert padding < 0.005 * 4096 * at["sequences"]


def test_word_ids_equal_those_of_whole_texts():
    random.seed(2)
    letters = "aaabA 's't \n\t  éßΣ日本é<|endoftext|>0123#! \x1c 🙂'll"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(3000)] + ["<|ENDOFTEXT|> A", ""]
    theirs = Tokenizer.from_file(PATH)
    for text, ids in zip(texts, packing.word_ids(PATH, texts)):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_documents_are_whole_and_sequences_gapless(odd_documents, no_documents):
    theirs = Tokenizer.from_file(PATH)
    pieces = packing.pack(odd_documents, PATH).collect()
    texts = odd_documents.select("doc_id", "text").collect()
    want = sorted((t["doc_id"] is None, t["doc_id"] or 0, theirs.encode(t["text"] or "", add_special_tokens=False).ids + [2]) for t in texts)
    by_sequence = defaultdict(list)
    joined = Counter()
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"]
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
        joined[p["doc_id"]] += p["length"]
        assert any(d == (p["doc_id"] or 0) and x[p["start"]:p["start"] + p["length"]] == ids and len(x) == p["doc_tokens"] for _, d, x in want)
    assert sum(joined.values()) == sum(len(x) for *_, x in want)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    assert packing.pack(no_documents, PATH).count() == 0
    assert zlib.crc32(b"") == 0


def test_words_of_letters_share_a_call():
    random.seed(5)
    theirs, sizes = Tokenizer.from_file(PATH), []

    class Counting:
        def encode(self, *args, **named):
            return theirs.encode(*args, **named)

        def encode_batch_fast(self, texts, **named):
            sizes.append(len(texts))
            return theirs.encode_batch_fast(texts, **named)

    words = sorted({"".join(random.choice("abcdefgéüßσ日") for _ in range(random.randint(1, 12))) for _ in range(2000)} | {"a1", "½a", "éa"})
    found = dict(packing._coded(Counting(), [w.encode() for w in words]))
    assert len(found) == len(words) and sum(sizes) < 100
    for w in words:
        assert np.frombuffer(found[w.encode()], "<u4").tolist() == theirs.encode(w, add_special_tokens=False).ids
