from llm.tables import join_labels


def shown(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_shuffled_for_labels(docs_of, labels_of):
    docs = docs_of([(i, f"text {i}") for i in range(400)]).select("doc_id", "text")
    labels = labels_of([(i, i % 2, None) for i in range(400)])
    for limit in (0, 40, 1_000_000):
        plan = shown(join_labels(docs, labels, "quality", "left", limit))
        assert "BroadcastHashJoin" in plan and "ShuffledHashJoin" not in plan and "SortMergeJoin" not in plan


def test_how_many_labels_teach(docs_of, labels_of):
    docs = docs_of([(i, f"text {i}") for i in range(2_000)]).select("doc_id", "text")
    labels = labels_of([(i, i % 2, None) for i in range(2_000)] + [(0, 1, None), (None, 1, None)])

    def taught(limit):
        return {r.doc_id: r.label for r in join_labels(docs, labels, "quality", "left", limit).where("label IS NOT NULL").collect()}

    every, some, more = taught(3_000), taught(500), taught(1_000)
    assert every == {**{i: i % 2 for i in range(2_000)}, 0: 1} and taught(0) == {}
    assert 400 < len(some) < 600 and some.items() <= more.items() <= every.items()
