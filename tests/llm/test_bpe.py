import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from roadsift.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def random_texts(ranks, count, seed):
    draw = random.Random(seed)
    tokens = list(ranks)
    for at in range(count):
        size = draw.randint(0, 12)
        if at % 3 == 0:
            yield "".join(draw.choice("abcdeét  \n'srs12é漢😀") for _ in range(3 * size))
        elif at % 3 == 1:
            yield b"".join(draw.choice(tokens) for _ in range(size)).decode("utf8", "replace")
        else:
            yield draw.choice("aAeéz漢") * draw.randint(1, 300) + draw.choice(["", "b", "aa b", "<|endoftext|>"])


def test_ids_equal_the_librarys(ranks, library):
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for text in random_texts(ranks, 3000, 1):
        assert encoder.encode(text) == packed(library.encode_ordinary(text)), text


def test_small_tables_give_equal_ids(ranks, library, monkeypatch):
    for name in ("MOST_STATES", "MOST_PAIRS", "MOST_PIECES"):
        monkeypatch.setattr(bpe, name, 20)
    monkeypatch.setattr(bpe, "GROUP", 3)
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for text in random_texts(ranks, 300, 2):
        assert encoder.encode(text) == packed(library.encode_ordinary(text))


def test_lookahead_is_bounded(ranks):
    transducer = bpe.Transducer(ranks)
    longest = max(map(len, ranks))
    state, unwritten = 0, 0
    for byte in b"antidisestablishmentarianismus" * 200:
        key = state << 8 | byte
        following = transducer.table[key] if key in transducer.table else transducer._step(state, byte)
        written = transducer.outputs[key] if following < 0 else ()
        state = ~following if following < 0 else following
        unwritten += 1 - sum(len(transducer.bytes_of[token]) for token in written)
        assert unwritten <= 4 * longest
    assert len(transducer.states) < 2000


def test_decoding_by_any_chunks(ranks):
    text = "aé漢😀\n" * 40
    data = text.encode()
    for size in (1, 2, 3, 5, 7, 64):
        stream = bpe.Utf8Stream()
        assert "".join(stream.feed(data[at : at + size]) for at in range(0, len(data), size)) == text
        stream.close()
    with pytest.raises(ValueError):
        broken = bpe.Utf8Stream()
        broken.feed(data[:2])
        broken.close()


def test_digests_of_odd_rows(odd_docs, no_docs, library):
    rows = bpe.digests(odd_docs, PATH).collect()
    want = []
    for row in odd_docs.collect():
        text = row["text"] or ""
        ids = packed(library.encode_ordinary(text))
        want.append((row["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert bpe.digests(no_docs, PATH).collect() == []


def test_rows_keep_their_other_columns(odd_docs):
    out = bpe.encoded(odd_docs, PATH)
    assert out.columns == [name for name in odd_docs.columns if name not in ("text", "token_ids")] + ["token_ids"]
    back = bpe.decoded(out, PATH).select("doc_id", "decoded").collect()
    want = [(row["doc_id"], row["text"] or "") for row in odd_docs.collect()]
    assert sorted(map(tuple, back), key=repr) == sorted(want, key=repr)
