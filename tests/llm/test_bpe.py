import base64
import random

import public_tokenizers as P
import tiktoken
from helpers import corpus, docs_of

from tallyforge.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_as_the_library_does_and_back(spark):
    rng = random.Random(3)
    texts = corpus() + ["<|endoftext|>", "it's  don't\n\n x", "数字 ½² 9٣", "\U0001f600" * 40, "ab" * 700, "".join(chr(rng.randrange(1, 0x3000)) for _ in range(4000)), "a\x00b"]
    enc = library()
    rows = bpe.decode(bpe.encode(docs_of(spark, texts), PATH, P.PATTERN, known_pieces=50), PATH).collect()
    key = lambda r: r.doc_id
    assert sorted(bpe.coded(docs_of(spark, texts), PATH, P.PATTERN, known_pieces=50).collect(), key=key) == sorted(rows, key=key)
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert r.n_tokens == len(ids)
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids)
        assert bytes(r.decoded) == t.encode()


def test_short_and_long_ways_agree():
    m = bpe.Merger(bpe.load_ranks(bpe.read_file(PATH)))
    rng = random.Random(5)
    for _ in range(300):
        p = bytes(rng.choice(b"aeinrst h\xc3\xa9") for _ in range(rng.randrange(2, 60)))
        if p not in m.ranks:
            assert m.encode([p])[0] == m._one(p)
