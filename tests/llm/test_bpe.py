import hashlib
import random

import pytest
from tokenizers import Tokenizer

from tablewright.llm import bpe


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.DEFAULT_FILE)
    t.no_truncation()
    t.no_padding()
    return t


def test_any_text_as_the_library(library):
    r = random.Random(5)
    letters = "ab c  \n\t'sé<|endoftext|>12.,中文  \u0085\x1c​😀ñß’ "
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 3000))) for _ in range(60)]
    words = ["".join(r.choice("etaoin") for _ in range(r.randint(1, 9))) for _ in range(300)]
    texts += [" ".join(r.choice(words) for _ in range(r.randint(0, 1500))) for _ in range(60)]
    texts += ["", "a" * 5000, " " * 5000, "<|endoftext|>" * 300, "x" * 3000 + " y " * 900]
    encoder = bpe.ChunkEncoder(bpe.DEFAULT_FILE)
    for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
        assert list(ids) == library.encode(text, add_special_tokens=False).ids
        assert encoder.tokenizer.decode(ids) == library.decode(list(ids), skip_special_tokens=False)


def test_every_narrow_character(library):
    fast = bpe.tokenizer_of(bpe.DEFAULT_FILE)
    for c in map(chr, range(0x250)):
        for text in (c, f"a{c}b", f" {c} ", c * 3 + " x", f"1{c}1", f"'{c}", f"\n{c}\n a", f"a {c} {c}"):
            assert fast.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_chunks_are_reused_across_documents():
    r = random.Random(2)
    passage = " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(1, 9))) for _ in range(4000))
    encoder = bpe.ChunkEncoder(bpe.DEFAULT_FILE)
    texts = [f"document {i} begins. " * (i + 1) + passage for i in range(5)]
    list(encoder.encode_all(texts))
    assert encoder.reused > 3 * encoder.encoded
    small = bpe.ChunkEncoder(bpe.DEFAULT_FILE, cache_bytes=10_000)
    assert list(map(list, small.encode_all(texts))) == list(map(list, encoder.encode_all(texts)))
    assert len(small.young) + len(small.old) < 40


def test_documents(spark, odd_docs, library):
    encoded = bpe.encode(odd_docs)
    assert encoded.columns == ["doc_id", "ids"] and encoded.count() == odd_docs.count()
    ids = sorted(str((r.doc_id, r.ids)) for r in encoded.collect())
    want = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids) for r in odd_docs.collect()]
    assert ids == sorted(map(str, want))
    back = bpe.decode(encoded)
    assert sorted(str((r.doc_id, r.text)) for r in back.collect()) == sorted(str((r.doc_id, r.text or "")) for r in odd_docs.collect())
    assert bpe.round_trip_digests(odd_docs.limit(0)).count() == 0


def test_digests(documents, library):
    want = {}
    for r in documents.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(documents).collect()}
    assert found == want


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        bpe.ByteTokenizer(public_tokenizers.path("word_bpe_49k.json"))
