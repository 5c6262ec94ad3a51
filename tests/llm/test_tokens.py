import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumine.llm import simple8b
from vellumine.llm.tokens import Tokenizer


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer(simple8b.VOCABULARY, slots=1 << 12, most_ids=1 << 12)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("abz'stdmlre 019 \n\t 　éÄ中!.\"")), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_ids_equal_the_reference_tokenizer(texts):
    t = test_ids_equal_the_reference_tokenizer.tokenizer
    ids, bounds = t.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [t.bpe.encode_ordinary(x) for x in texts]


test_ids_equal_the_reference_tokenizer.tokenizer = Tokenizer(simple8b.VOCABULARY, slots=1 << 10, most_ids=1 << 10)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 70000), st.integers(-(2**63), 2**63 - 1)), max_size=400), max_size=5))
def test_round_trip(lists):
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    ids = np.array([v for x in lists for v in x], np.int64)
    words, wb, offsets, ob = simple8b.encode(ids, bounds)
    for k, x in enumerate(lists):
        assert simple8b.decode(words[wb[k] : wb[k + 1]], offsets[ob[k] : ob[k + 1]], len(x)).tolist() == x


def test_packing_is_dense():
    for value, per_word in ((0, 120), (1, 60), (7, 20), (255, 7), (60000, 3)):
        words, *_ = simple8b.encode(np.full(1280, value), np.array([0, 1280]))
        assert len(words) == 10 * -(-128 // per_word)


def test_documents(spark, documents, odd, nothing, tokenizer):
    for df in (documents, odd):
        texts = {r.doc_id: r.text for r in df.collect() if r.doc_id is not None}
        for r in simple8b.coded(df).where("doc_id is not null").collect():
            ids = simple8b.decode(np.frombuffer(r.words, "<u8"), np.array(r.offsets), r.n_tokens)
            assert ids.tolist() == tokenizer.bpe.encode_ordinary(texts[r.doc_id] or "")
    assert simple8b.coded(odd).count() == odd.count()
    assert simple8b.coded(nothing).count() == 0
