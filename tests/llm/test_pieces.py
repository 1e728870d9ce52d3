import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from chromaloom.llm import pieces

from ..conftest import SF
from .cases import ODD, as_docs, odd_docs

SP = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def whole(t):
    ids = SP.encode(t or "", add_eos=True)
    return ids, SP.decode(ids)


def test_model_is_bound_by_markers():
    assert pieces.marker_bound(pieces.model_path())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(" ▁ab\n\téß漢😀<s>/\x00"), max_size=30), min_size=1, max_size=4))
def test_like_the_library(texts):
    table = pieces.ChunkTable(pieces.model_path(), 5)
    for _ in range(2):
        ids, off, decoded = table.encode(texts)
        assert [(ids[off[i] : off[i + 1]].tolist(), decoded[i]) for i in range(len(texts))] == [whole(t) for t in texts]


def test_odd_rows(spark):
    got = sorted(((r.doc_id or -1, r.n_tokens, r.ids, r.decoded) for r in pieces.encode_documents(odd_docs(spark)).collect()), key=str)
    assert got == sorted(((i or -1, len(whole(t)[0]), *whole(t)) for i, t in ODD), key=str)
    assert pieces.encode_documents(as_docs(spark, []).limit(0)).count() == 0


def test_query(spark):
    import hashlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in pieces.op1_sentencepiece(spark, SF).collect():
        ids, text = whole(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
