"""Merge rounds against the library itself."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.test_text_operators import EDGE, documents
from tracelake.llm import bpe_merges, queries
from tracelake.llm.textbytes import column_bytes

PATH = public_tokenizers.path("word_bpe_49k.json")
LETTERS = "abcABC é İßΣς'’.!  \t\n\x1c\x85\xa012٣日本語한́̇<|endoftext|>😀ﬁǅ"


def mixed_texts(n):
    draw = random.Random(5)
    texts = ["".join(draw.choice(LETTERS) for _ in range(draw.randint(0, 40))) for _ in range(n)]
    texts += ["a" * 5000 + "b", "日本" * 3000, "".join(draw.choice("abcdefgh") for _ in range(9000)), "<|endoftext|>", "x<|endoftext|>y <|startoftext|><|startoftext|>", "", "aaaa'saaa", "don't" * 100]
    return texts + ["".join(chr(c) for c in range(k, min(k + 500, 0x110000)) if not 0xD800 <= c < 0xE000) for k in range(0, 0x110000, 500)]


@pytest.mark.parametrize("in_order, most", [(True, 500_000), (False, 50)])
def test_ids_and_tokens_are_the_library_s(in_order, most):
    texts = mixed_texts(2000 if in_order else 200)
    own, library = bpe_merges.MergeEncoder(PATH), Tokenizer.from_file(PATH)
    assert own.merges.in_order and own.by_piece
    own.merges.in_order, own.table.most = in_order, most
    if not in_order:
        texts = [x for x in texts if len(x) < 400]
    want = library.encode_batch(texts, add_special_tokens=False)
    for _ in range(2):  # the second time from the table
        ids, counts = own.encode(*column_bytes(pa.array(texts)))
        assert ids.tolist() == [i for x in want for i in x.ids]
        assert counts.tolist() == [len(x.ids) for x in want]
    ends = np.cumsum(counts)
    for x, a, b in zip(want, ends - counts, ends, strict=True):
        assert own.decode(ids[a:b].astype(np.int64)).decode() == library.decode(x.ids, skip_special_tokens=False)


def test_long_words_are_merged_alike_by_ranks_and_in_rounds(monkeypatch):
    own = bpe_merges.MergeEncoder(PATH)
    draw = random.Random(3)
    words = [bytes(draw.choice(b"aaabethinrs") for _ in range(draw.randint(1, 300))) for _ in range(300)]
    counts = np.array([len(x) for x in words])
    symbols = own.inner[np.frombuffer(b"".join(words), np.uint8)]
    done = [x.tolist() for x in own.merges.merge(symbols.copy(), counts)]
    monkeypatch.setattr(bpe_merges, "LONG", 40)
    assert [x.tolist() for x in own.merges.merge(symbols.copy(), counts)] == done


def test_a_vocabulary_out_of_order_and_with_missing_symbols(tmp_path):
    """What a merge makes takes part in an earlier rule, two rules make one token, and some bytes have no symbol."""
    vocab = ["a", "b", "c", "a</w>", "b</w>", "c</w>", "ab", "bc", "abc", "ca", "abca", "bc</w>", "abc</w>"]
    made = json.loads(open(PATH).read())
    made["model"] |= {"vocab": {x: k for k, x in enumerate(vocab)}, "merges": [["abc", "a"], ["a", "bc"], ["ab", "c"], ["c", "a"], ["b", "c"], ["a", "b"], ["b", "c</w>"], ["ab", "c</w>"]]}
    made["added_tokens"] = []
    path = tmp_path / "odd.json"
    path.write_text(json.dumps(made))
    own, library = bpe_merges.MergeEncoder(str(path)), Tokenizer.from_file(str(path))
    assert not own.merges.in_order
    draw = random.Random(9)
    texts = ["".join(draw.choice("abcabcabcx ") for _ in range(60)) for _ in range(300)]
    ids, _ = own.encode(*column_bytes(pa.array(texts)))
    assert ids.tolist() == [i for x in library.encode_batch(texts, add_special_tokens=False) for i in x.ids]


def test_query_on_edges(spark, tmp_path):
    rows = EDGE + [(9, "x" * 5000), (10, "ab " * 900_000), (11, "İ. ’tis")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)))))
    got = queries.op12_bpe(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert bpe_merges.encode(documents(spark, []), PATH).count() == 0
