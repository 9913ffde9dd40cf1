import hashlib
import random

import numpy as np
from llm.helpers import corpus, empty, vocabulary, with_clashes

from labelpick.llm import bpe


def odd_texts():
    rng = random.Random(3)
    letters = "ab \xe9'\n\t 1,!\xa0 ж<|>\xd7s\x1c\x85 ​\xffĀ"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(300)]


def test_words_are_encoded_as_in_the_text():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for text in odd_texts() + ["<|endoftext|> a<|endoftext|>b", "it's 'tis we've!!'s", "ſ's", " ", "a\xa0\n b"]:
        words = bpe.split_words(text, ["<|endoftext|>"])
        assert "".join(words) == text
        ids = [i for w in words for i in library.encode(w, add_special_tokens=False).ids]
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_round_trip_equals_the_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = corpus() + [(4000 + i, t) for i, t in enumerate(odd_texts())]
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((-1 if i is None else i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    for block in (6 << 20, 5_000):
        monkeypatch.setattr(bpe, "BLOCK_BYTES", block)
        monkeypatch.setattr(bpe, "CHUNK_UNITS", block)
        got = bpe.round_trip(with_clashes(spark, rows), path).collect()
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == sorted(want)


def test_encode_and_decode_keep_other_columns(spark):
    path, rows = vocabulary("byte_bpe_50k.json"), corpus()
    docs = with_clashes(spark, rows)
    encoded = bpe.encode(docs, path)
    assert encoded.columns == [c for c in docs.columns if c != "text"] + ["ids"]
    back = {r.block: r.text for r in bpe.decode(encoded, path).collect()}
    assert back == {n: t or "" for n, (_, t) in enumerate(rows)}
    assert {r.lossless for r in bpe.tokenize(docs, path).collect()} == {True}
    assert bpe.encode(empty(spark), path).count() == 0 and bpe.round_trip(empty(spark), path).count() == 0


def test_no_shuffle_of_stored_blocks(spark):
    plan = bpe.round_trip(with_clashes(spark, corpus()), vocabulary("byte_bpe_50k.json"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2  # words to shards, answers to blocks
