import base64

import pytest

from lotgrid.llm.tokens import count_tokens, encode, vocabulary

P = pytest.importorskip("public_tokenizers")
TEXTS = ["", "a", "a" * 3000, "it's we'll I'M", "  two  spaces \n\n tab\t", "日本語のテキスト" * 40, "<|endoftext|> x", "é😡👍🏽 naïve ½ ²", "-" * 1025, "\x1c\x85 b", "ab" * 2001, "don't!?... 3.14 § 22.51(b)"]


def test_equals_the_reference_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    flat, ends = vocabulary("byte_bpe_50k").encode([*TEXTS, None])
    got = [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]
    assert got == [x.ids for x in t.encode_batch(TEXTS, add_special_tokens=False)] + [[]]


def test_rank_files_merge_one_pair_at_a_time():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    v = vocabulary("byte_bpe_multi_50k")
    some = [x for x in TEXTS if len(x) < 1500]
    flat, ends = v.encode(some, keep=3)
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [t.encode_ordinary(x) for x in some]


def test_operator_edges(spark):
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "lot", "c"), (3, "lot", "c"), (None, "lot", None)], "doc_id long, text string, ids string")
    rows = encode(df).collect()
    assert [r.ids for r in rows if r.doc_id == 1] == [None] and [r.ids for r in rows if r.doc_id == 2] == [[]]
    assert len({tuple(r.ids) for r in rows if r.doc_id not in (1, 2)}) == 1 and len(rows) == 5
    assert encode(df.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in count_tokens(df).collect()}[1] == 0
