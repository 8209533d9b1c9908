import hashlib
import struct
import zlib

import pytest
import sentencepiece as spm
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import piece_spans as spans

TEXTS = ["", None, "a", " ", "  a  b\n\n c \t d  ", "<s> x</s><unk><0x41>", "▁▁ a▁b ▁", "\x00\x1c a\x85b", "١٢٣ ²³ Ⅷ ½ 漢字かな 👩‍👩‍👧 é", "a" * 500, "x, y. Z!? e.g. end:... (a). \"b\".", "word " * 30000, "word " * 30000, "漢" * 50]
LIBRARY = spm.SentencePieceProcessor(model_file=spans.VOCABULARY)


def wanted(text):
    pieces = LIBRARY.encode(text, return_type="proto").pieces
    return [p.id for p in pieces], [p.begin for p in pieces], [p.end for p in pieces]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8")) | st.sampled_from([" ", "  ", "the", "ing.", "\n", "▁", "<s>", "The cat", "www.", "x²,", "...", "hello" * 20]), max_size=8).map("".join))
def test_ids_spans_and_text_equal_the_library(text):
    model = spans.load(spans.VOCABULARY)
    ids, starts, ends = model.encode(text)
    assert (ids, starts, ends) == wanted(text)
    assert model.decode(ids) == LIBRARY.decode(ids)
    assert spans.digest(model, spans.plain_runs(spans.VOCABULARY), text) == (",".join(map(str, ids)), LIBRARY.decode(ids), struct.pack(f"<{len(ends)}I", *ends))
    assert spans.PieceModel.merge_short(model, text[:60]) == heap_merge(model, text[:60])


def heap_merge(model, run):
    """The same merges with the pairs in a heap."""
    order, model.order = model.order, {}
    try:
        return model.merge(run)
    finally:
        model.order = order


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(0, 262), max_size=12))
def test_any_ids_decode_as_the_library_does(ids):
    assert spans.load(spans.VOCABULARY).decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("dummy,tidy,escape", [(False, False, False), (True, False, True), (True, True, True)])
def test_the_compiled_map_normalises_and_aligns_as_the_library_does(rule, dummy, tidy, escape):
    library = spm.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=dummy, remove_extra_whitespaces=tidy, escape_whitespaces=escape)
    proto = dict(f for f in spans.wire_fields(library.serialized_model_proto()) if f[0] == 3)
    model = spans.PieceModel.__new__(spans.PieceModel)
    model.map = spans.CharacterMap(dict(spans.wire_fields(proto[3])).get(2, b""))
    model.dummy, model.tidy, model.escape, model.suffix, model.at_own = dummy, tidy, escape, False, None
    for text in ["①②ﬁ ｱｲ ㌔ Ａ́ é é ​ x", "　　a  b ", "ÄÖ ß ﬃ", "ﾊﾟ か゛", " \t\n x \r", "a", "한글 각"]:
        want, offsets = library.normalize(text, with_offsets=True)
        data, origin = model.normalise(text)
        source = [len(text[:k].encode()) for k in range(len(text) + 1)]
        chars = data.decode()
        assert chars == want
        assert [origin[len(chars[:k].encode())] for k in range(len(chars) + 1)] == [source[o] for o in offsets]


def test_rows_of_all_kinds(spark):
    rows = [(i // 2, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, part string").repartition(3)
    got = sorted((tuple(r) for r in spans.piece_digests(docs).collect()), key=repr)
    want = []
    for doc_id, text, *_ in rows:
        ids, _, ends = wanted(text or "")
        decoded = LIBRARY.decode(ids) if ids else ""
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), len((text or "").encode()), zlib.crc32(struct.pack(f"<{len(ends)}I", *ends))))
    assert got == sorted(want, key=repr)
    whole = spans.encode_documents(docs.filter("doc_id = 2")).collect()
    assert {tuple(r.ids) for r in whole} == {tuple(wanted(t)[0]) for t in TEXTS[4:6]}
    assert spans.piece_digests(docs.limit(0)).count() == 0
