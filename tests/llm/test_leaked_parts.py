"""Documents that hold an item's question or answer alone."""

from sarstack.llm import decontaminate


def test_question_or_answer_alone_is_a_leak(spark):
    question, answer = "Which of the nine old harbour towns did the grey ferry reach first?", "It came to the lowest of the northern quays before dawn that winter morning."
    items = [(1, f"{question} {answer}"), (2, f"{question.replace('ferry', 'barge')} No."), (3, f"What is it? {answer.replace('quays', 'piers')}"), (4, "Short one here? Yes."), (5, f"Who? {'alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega ' * 2}one. Under every one of these old stones lies a coin.")]
    texts = [f"{question} {answer}", f"so {question} Nobody knows.", f"they say: {answer}", "Short one here? No.", "Yes.", "which of the nine old towns", "Under every one of these old stones lies a coin."]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontaminate.matches(d, b).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert {(0, 1), (1, 1), (2, 1), (6, 5)} <= got and not {3, 4, 5} & {r.doc_id for r in rows}
    assert len(got) == len(rows) and all(0 < r.score < 1.000001 for r in rows)
    assert next(r.score for r in rows if (r.doc_id, r.item_id) == (6, 5)) < 0.5
    assert {r.doc_id for r in decontaminate.decontaminate(d, b).collect()} == {3, 4, 5}
