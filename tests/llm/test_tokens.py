import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tickloom.llm import bpe_automaton as bpe
from tickloom.llm import token_blocks as blocks

TEXTS = ["", None, "a", " ", "  a  b\n\n c \t d  ", "<|endoftext|> x<|endoftext|>", "'s 't I'll  it's x y ", "\x1c a \x1d\x85b", "١٢٣ ²³ Ⅷ ½ 漢字かな 👩‍👩‍👧 é", "aaaaaaa" * 9, "hello" * 50, "x, y. Z!? end:", "word " * 3000, "word " * 3000]
SCHEMA = "doc_id bigint, text string, part string, ids string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i // 2 if i < 6 else i, t, "p", "z") for i, t in enumerate(TEXTS)] + [(None, "no id", None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8")) | st.sampled_from([" ", "  ", "the", "ing", "'re", "\n", "<|endoftext|>", "The cat", "1234"]), max_size=8).map("".join))
def test_both_encoders_equal_the_library(text):
    want = Tokenizer.from_file(bpe.VOCABULARY) if not hasattr(test_both_encoders_equal_the_library, "lib") else test_both_encoders_equal_the_library.lib
    test_both_encoders_equal_the_library.lib = want
    encoder, machine = bpe._worker(bpe.VOCABULARY)
    data = encoder.encode_all([text])[0]
    assert np.frombuffer(data, "<u4").tolist() == ids_of(want, text)
    assert bpe.decode(machine, data) == want.decode(ids_of(want, text), skip_special_tokens=False)
    assert blocks.library_encoder(bpe.VOCABULARY).encode_all([text])[0] == data


def test_words_of_letters_go_to_the_model_alone(library, monkeypatch):
    """The library's pre-split takes longer than its merges, so it gets only what may need splitting."""
    seen = []

    class Counting:
        def __getattr__(self, name):
            return getattr(library, name)

        def encode(self, text, **kw):
            seen.append(text)
            return library.encode(text, **kw)

    monkeypatch.setattr(Tokenizer, "from_file", lambda path: Counting())
    letters = ["Straße", "naïve", "Ægir", "λόγος", "слово", "ƀɏ", "thnderhe", "x", "ÿ", "ϵ", "ԧ"]
    others = ["a1", "x×y", "÷", "µ", "ª", "漢字", "don't", "a_b", "\u0482", "é̀", "϶", "Ա"]
    encoder = blocks.library_encoder.__wrapped__(bpe.VOCABULARY)
    seen.clear()
    text = "start " + " ".join(letters * 3)
    assert np.frombuffer(encoder.encode_all([text])[0], "<u4").tolist() == ids_of(library, text)
    assert seen == ["start"]
    text = " ".join([*others, *letters, *[a + b for a in letters for b in others]])
    assert np.frombuffer(encoder.encode_all([text])[0], "<u4").tolist() == ids_of(library, text)


def test_a_full_memory_keeps_what_is_used(library):
    encoder = blocks.library_encoder.__wrapped__(bpe.VOCABULARY)
    encoder.most, asked, encode = 3, [], encoder.encode_pieces
    encoder.encode_pieces = lambda texts: (asked.extend(texts), encode(texts))[1]
    for text in ("x one two three four", "x one two five", "x six"):
        assert np.frombuffer(encoder.encode_all([text])[0], "<u4").tolist() == ids_of(library, text)
    assert asked.count(" one") == 1 and set(encoder.known) == {"six"}


def test_automaton_on_a_small_merge_list():
    labels = [b"a", b"b", b"aa", b"ab", b"aab", b"aaaa"]
    machine = bpe.MergeAutomaton(labels, [(0, 0, 2), (0, 1, 3), (2, 1, 4), (2, 2, 5)])

    def merged(word):
        out = [labels.index(c.encode()) for c in word]
        for u, v, w in [(0, 0, 2), (0, 1, 3), (2, 1, 4), (2, 2, 5)]:
            i = 0
            while i + 1 < len(out):
                if (out[i], out[i + 1]) == (u, v):
                    out[i : i + 2] = [w]
                i += 1
        return out

    words = [format(i, f"0{n}b").replace("0", "a").replace("1", "b") for n in range(1, 10) for i in range(1 << n)]
    assert all(machine.encode(w) == merged(w) for w in words)
    with pytest.raises(ValueError):
        bpe.MergeAutomaton(labels, [(2, 0, 4)])


def test_digests(docs, library):
    rows, df = docs
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.token_digests(df).collect()}
    want = set()
    for doc_id, text, *_ in rows:
        ids = ids_of(library, text)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want.add((doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == want
    assert bpe.token_digests(df.limit(0)).count() == 0


def test_encode_documents(docs, library):
    rows, df = docs
    got = bpe.encode_documents(df).collect()
    assert sorted((r.doc_id or -1, r.decoded) for r in got) == sorted((d or -1, t or "") for d, t, *_ in rows)
    assert all(list(r.ids) == ids_of(library, r.decoded) for r in got)


def test_token_files(spark, docs, library, tmp_path):
    rows, df = docs
    folder = str(tmp_path / "tokens")
    blocks.write_token_files(df, folder)
    got = blocks.token_index(spark, folder).collect()
    lengths = {}
    want, texts = [], sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    for doc_id, text, *_ in texts:
        ids = [*ids_of(library, text), 0]
        want.append((doc_id, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        lengths[doc_id] = lengths.get(doc_id, 0) + len(ids)
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0] + [r.n_tokens for r in ordered])[:-1].tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids)
    full = {r.start: list(r.ids) for r in blocks.read_token_files(spark, folder).collect()}
    assert all(zlib.crc32(struct.pack(f"<{len(i)}I", *i)) == r.ids_crc32 for r in ordered for i in [full[r.start]])


def test_no_token_files(docs):
    assert blocks.token_files(docs[1].limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 60) | st.just(50256), max_size=700), st.integers(0, 700), st.integers(0, 700))
def test_block_round_trip(values, a, b):
    ids = np.array(values, np.uint32)
    data = blocks.encode_blocks(ids)
    assert blocks.decode_blocks(data).tolist() == values
    assert blocks.decode_blocks(data, a, b).tolist() == values[a:b]


def test_blocks_are_small():
    rng = np.random.default_rng(0)
    ids = np.where(rng.random(100_000) < 0.05, rng.integers(0, 50_000, 100_000), rng.integers(0, 250, 100_000)).astype(np.uint32)
    assert len(blocks.encode_blocks(ids)) < 1.7 * len(ids)
