import random

import pytest
from llm.helpers import corpus, empty, vocabulary, with_clashes

from labelpick.llm import token_counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def recorded(library, text):
    """The encoder of a text's chunks, and the spans it was asked for."""
    spans, encode = [], token_counts.chunk_encoder(library, text)

    def asked(more):
        spans.extend(more)
        return encode(more)
    return asked, spans


def test_counts_equal_the_library_for_any_chunk(spark, library):
    path, rows = vocabulary("word_bpe_49k.json"), corpus()
    want = sorted((i if i is not None else -1, len((t or "").encode()),
                   len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    for chunk, overlap in ((16_384, 256), (100, 7)):
        found = token_counts.count_tokens(with_clashes(spark, rows), path, limit=50, chunk_chars=chunk, overlap=overlap)
        got = found.collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 50) for r in got)
    assert token_counts.count_tokens(empty(spark), path).count() == 0


TEXTS = ["a" * 500, "ab " * 300, " " * 400, "x" * 150 + " y " + "z" * 300, "é\n" * 200, "", "é " * 90 + "́" * 40,
         "I'll 's don't <|endoftext|> 123 " * 40, "日本語 " * 100 + "日" * 200, "　a b" * 90, "A\x1cB\x85C \t\v" * 60]


@pytest.mark.parametrize("text", TEXTS)
def test_spliced_ids_are_those_of_the_whole_text(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    for chunk, overlap in ((64, 8), (50, 49), (300, 1), (10, 9)):
        parts = list(token_counts.spliced(text, token_counts.chunk_encoder(library, text), chunk, overlap))
        assert [i for part in parts for i in part] == want


def test_random_texts(library):
    rng = random.Random(7)
    letters = "ab eé'S1 \n\t.,́<|>"
    for _ in range(60):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 400)))
        chunk = rng.randint(4, 90)
        parts = token_counts.spliced(text, token_counts.chunk_encoder(library, text), chunk, rng.randint(1, chunk - 1))
        assert [i for part in parts for i in part] == library.encode(text, add_special_tokens=False).ids


def test_chunks_are_whole_and_without_the_splice_tokens_come_twice(library):
    text = " ".join(f"word{i}" for i in range(200))
    encode, spans = recorded(library, text)
    parts = list(token_counts.spliced(text, encode, 200, 40))
    assert len(parts) == len(spans) > 5 and all(e - s == 200 for s, e in spans[:-1])
    want = len(library.encode(text, add_special_tokens=False).ids)
    plain = sum(len(c.ids) for c in token_counts.chunk_encoder(library, text)(spans))
    assert sum(map(len, parts)) == want < plain


def test_overlap_is_widened_where_no_boundary_is_in_it(library, monkeypatch):
    text = "ab " * 30 + "abcdefg" * 60 + " cd" * 40
    encode, spans = recorded(library, text)
    got = [i for part in token_counts.spliced(text, encode, 64, 8) for i in part]
    assert got == library.encode(text, add_special_tokens=False).ids
    assert max(e - s for s, e in spans) > 64 + 8  # chunks that grew
    # a splice that takes any token start in the overlap, without proof, gives other ids
    monkeypatch.setattr(token_counts, "BLANK", frozenset("abcdefg ") - frozenset(" "))
    wrong = token_counts.splice_point
    monkeypatch.setattr(token_counts, "splice_point", lambda t, a, b: wrong(t, a, b) or max(b.start + 1, a.start + 1))
    try:
        loose = [i for part in token_counts.spliced(text, token_counts.chunk_encoder(library, text), 64, 8) for i in part]
    except Exception:
        loose = None
    assert loose != got


def test_differing_tokens_are_no_splice():
    text = "aa bb cc dd"
    left = token_counts.Chunk(0, 9, [1, 2, 3], [0, 3, 6])
    assert token_counts.splice_point(text, left, token_counts.Chunk(2, 11, [2, 3, 4], [3, 6, 9])) == 6
    assert token_counts.splice_point(text, left, token_counts.Chunk(2, 11, [9, 3, 4], [3, 6, 9])) is None
    assert token_counts.splice_point(text, left, token_counts.Chunk(7, 11, [4], [9])) is None


def test_bad_overlap_is_refused(spark):
    with pytest.raises(ValueError):
        token_counts.count_tokens(empty(spark), "x", chunk_chars=10, overlap=10)


def test_short_way_gives_the_same_tokens(library):
    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as file:
        both = token_counts.Tokenizers(file.read())
    rng = random.Random(5)
    letters = [chr(c) for c in range(1, 0x250) if chr(c).isprintable() or c < 33] + ["'s", "'LL", " ", " ", "12", "<|"]
    texts = [t or "" for _, t in corpus()] + TEXTS
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(300)]
    texts += ["a <|ENDOFTEXT|> b", "<|endoftext|>", "\u0130stanbul", "e\u0301 A\u030a", "ΟΔΟΣ", "É\x85È\xa0Ê"]
    light = 0
    for text in texts:
        tokenizer, given = both.of(text)
        want, got = library.encode(text, add_special_tokens=False), tokenizer.encode(given, add_special_tokens=False)
        assert got.ids == want.ids and got.offsets == want.offsets
        light += tokenizer is both.light
    assert light > 200
    assert all(both.of(t)[0] is both.whole for t in ("a <|ENDOFTEXT|>", "\u0130", "e\u0301", "Σ"))
