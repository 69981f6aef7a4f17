"""SimHash proposes pairs in the pipeline's near-copy stage."""

from framelake.llm import near_copies


def test_fingerprints_propose_pairs(spark):
    words = [f"w{k}" for k in range(400)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(words[::-1])), (4, "a b c d e f g"), (5, "a b c d e f g a b c d e f g")], "doc_id long, text string")
    seen = near_copies.prints(docs)
    node = {r.doc_id: r.node for r in seen.collect()}
    pairs = {(r.a, r.b) for r in near_copies.printed(spark, seen).collect()}
    assert (min(node[1], node[2]), max(node[1], node[2])) in pairs and not any(node[3] in p for p in pairs)
