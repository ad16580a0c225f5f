import os

import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LONG = "word " * 30_000
TEXTS = [
    None, "", "   \n\t ", "one", "two words", LONG, "the same line of a text that is long enough\n" * 3,
    "Ein kurzer Satz über Äpfel, größer als 3.", "<|endoftext|> a b", "\x1c\x00 odd", "the same line of a text that is long enough\n" * 3,
]


@pytest.fixture
def odd_documents(rows):
    """Nulls, empty and long texts, repeated rows, a null id, and columns whose names operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, n int, ids string, language string, found string, sig string, component string, h long, label int"
    data = [(i, t, "en" if i % 3 else None, "src" if i % 2 else None, len(t or ""), i, "x", "y", "z", "s", "c", 1, 1) for i, t in enumerate(TEXTS)]
    return rows(schema, *data, data[3], data[6], (None, *data[4][1:]))


@pytest.fixture
def no_documents(odd_documents):
    return odd_documents.limit(0)
