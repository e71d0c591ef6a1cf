"""The parameters that training tasks send follow the tokens, not the number of partitions."""

from cohortlake.llm import lm


def test_small_partitions_train_together(spark, monkeypatch):
    rows = [(k, " ".join(f"w{(k * 7 + j) % 50}" for j in range(40))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    sources, tokens = [], []

    def averaged(parts):
        sent = parts.collect()
        sources.append(len({r["source"] for r in sent}))
        tokens.append(sum(r["weight"] for r in sent if r["part"] == 0))

    monkeypatch.setattr(lm, "averaged", averaged)
    folded = lm.folded(docs, "text")
    words = lm.vocabulary(lm.count_words(folded))
    lm.train(folded, words)
    assert sources == [1] * lm.ROUNDS
    # every training token once
    assert sum(tokens) == words.tokens


def test_large_inputs_keep_their_tasks():
    words = lm.Vocabulary([], lm.np.zeros(0), 0, 100 * lm.ROUNDS * lm.TOKENS_PER_TASK, 0)
    assert lm.training_tasks(words) == 101
