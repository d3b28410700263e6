"""Ids that are repeated with different texts lose no text."""

from meridia.llm import minhash

A, B, C = "a b c d e f g h", "q r s t u v w x", " ".join(f"w{i}" for i in range(60))


def test_no_text_is_lost(docs_of):
    docs = docs_of([A, A, B, B, C, C + " y", C + " y", A], ids=[1, 5, 5, 7, 3, 3, 9, 5])
    kept = minhash.keep_one(docs)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) in ([(1, A), (3, C), (5, B)], [(1, A), (3, C + " y"), (5, B)])
    # the document 5 joins the classes of its texts
    assert {r.doc_id: r.class_id for r in minhash.op3_near_dedup(docs).collect()} == {1: 1, 5: 1, 7: 1, 3: 3, 9: 3}


def test_texts_of_one_id_keep_their_own_links(docs_of):
    """Both texts of id 2 are their class's smallest; each is verified with its own near copy."""
    other = " ".join(f"v{i}" for i in range(60))
    docs = docs_of([C, other, C + " y", other + " y"], ids=[2, 2, 6, 8])
    assert sorted((r.doc_id, r.text) for r in minhash.keep_one(docs).collect()) == sorted([(2, C), (2, other)])
    assert {r.doc_id: r.class_id for r in minhash.op3_near_dedup(docs).collect()} == {2: 2, 6: 2, 8: 2}
