import pytest
from pyspark.sql import functions as F

from propkit.functions.parse import cast_float
from propkit.operators.embed import (corpus, embed_sum, embed_sum_join, embed_then_pca, get_embedder,
                                     register_embedder, train_word2vec, word2vec_embedder)
from propkit.operators.model import predict_from_strings, train_and_evaluate, training_set
from propkit.operators.vectors import fit_pca_pipeline
from propkit.sources.readers import read_table
from propkit.sources.sinks import write_results


@pytest.fixture(scope="module")
def structs(spark):
    items = ["CCO", "c1ccccc1", "CC(=O)O", "ClCCl", "CCN", "not_a_molecule(", "CCCC", "OCCO"] * 5
    return spark.createDataFrame([(i, s, float(len(s))) for i, s in enumerate(items)],
                                 "row_id long, smiles string, y double")


def test_sentence_alternates_radii(spark):
    df = spark.createDataFrame([(0, "CCO"), (1, "")], "row_id long, smiles string")
    rows = {r["row_id"]: r["sentence"] for r in corpus(df, "smiles", radius=1).collect()}
    assert rows[0] == ["C", "1||C|C", "C", "1|C|C|O", "O", "1|C|O|"]  # token boundaries and ends are part of an identifier
    assert rows[1] == []


def test_join_path_equals_broadcast_path(spark, structs):
    c = corpus(structs, "smiles", 1)
    model = train_word2vec(c, vector_size=4, seed=1)
    a = {r["row_id"]: r["vector"] for r in embed_sum(model, c).collect()}
    from pyspark.ml.functions import vector_to_array
    vocab = model.getVectors().select("word", vector_to_array("vector").alias("vector"))
    b = {r["row_id"]: r["vector"] for r in embed_sum_join(vocab, c).collect()}
    for k, v in a.items():
        assert (v is None) == (b[k] is None)
        if v is not None:
            assert v == pytest.approx(b[k], rel=1e-5, abs=1e-6)


def test_registry_pca_and_prediction(spark, structs):
    model = train_word2vec(corpus(structs, "smiles", 1), vector_size=6, seed=3)
    register_embedder("w2v_test", word2vec_embedder(model, 1))
    emb = get_embedder("w2v_test")
    vecs = emb(structs, "smiles")
    assert vecs.where(~F.col("is_valid")).count() == 5  # the grammar rejects one string (×5)
    pipe = fit_pca_pipeline(vecs.where("is_valid"), "vector", 3)
    reduced = embed_then_pca(emb, pipe, structs, "smiles")
    assert reduced.select(F.size("vector")).distinct().collect()[0][0] == 3
    data = training_set(vecs.where("is_valid"), structs, "y")
    res = train_and_evaluate(data, "linear_regression", test_size=0.25, scaling="MinMaxScaler")
    pred, invalid = predict_from_strings(emb, res.model, res.prep, structs, "smiles")
    assert pred.count() == 35 and invalid.count() == 5
    with pytest.raises(ValueError):
        get_embedder("nope")


def test_cast_float_and_json_reader(spark, tmp_path):
    df = spark.createDataFrame([("1.5",), ("NaN",), (None,)], "v string")
    assert [r[0] for r in cast_float(df, "v").collect()] == [1.5, None, None]
    with pytest.raises(ValueError):
        cast_float(df, "missing")
    (tmp_path / "t.json").write_text('{"a": 1, "b": 2.5}\n{"a": 2, "b": null}\n')
    j = read_table(spark, str(tmp_path / "t.json"))
    assert j.count() == 2 and set(j.columns) == {"a", "b"}
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "t.xyz"))


def test_results_sink(spark, tmp_path, structs):
    from propkit.operators.evaluate import regression_metrics
    pred = structs.select(F.lit("test").alias("split"), "row_id", F.col("y").alias("y_true"),
                          (F.col("y") * 1.1).alias("y_pred"))
    write_results(pred, regression_metrics(pred, "y_true", "y_pred", by=["split"]), str(tmp_path / "res"))
    assert spark.read.parquet(str(tmp_path / "res/metrics")).first()["n"] == 40


def test_identifiers_never_coincide(spark):
    from pyspark.sql import functions as F
    from propkit.operators.embed import corpus
    got = {r.text: r.s for r in corpus(spark.createDataFrame([("in to",), ("into",), ("a b",), ("b a",), ("",)], "text string"), "text", 1, "text", "s").collect()}
    assert got["in to"] == ["in", "1||in|to", "to", "1|in|to|"] and got["into"] == ["into", "1||into|"]
    assert not set(got["in to"]) & set(got["into"]) and got[""] == []
    wide = corpus(spark.createDataFrame([("a b c",)], "text string"), "text", 2, "text", "s").select(F.explode("s")).collect()
    assert [r[0] for r in wide] == ["a", "1||a|b", "2|||a|b|c", "b", "1|a|b|c", "2||a|b|c|", "c", "1|b|c|", "2|a|b|c||"]


def test_bracket_hydrogens_are_read_whole(spark):
    from propkit.operators.profile import structure_profile
    got = {r.s: r.molecular_weight for r in structure_profile(spark.createDataFrame([("[CH12345]",), ("[CH4]",), ("[CH]",), ("[CH99999999999]",)], "s string"), "s").collect()}
    h = 1.00782503223
    assert abs(got["[CH12345]"] - (12 + 12345 * h)) < 0.1 and abs(got["[CH4]"] - (12 + 4 * h)) < 1e-6 and abs(got["[CH]"] - (12 + h)) < 1e-6
    assert got["[CH99999999999]"] > 1e11


def test_valid_rows_do_not_inline_the_grammar(spark):
    from propkit.operators.embed import corpus, train_word2vec, word2vec_embedder
    d = spark.createDataFrame([(1, "CCO"), (2, "c1ccccc1"), (3, "not_a_molecule("), (4, None)], "row_id long, smiles string")
    emb = word2vec_embedder(train_word2vec(corpus(d, "smiles", 1), vector_size=4, seed=1), 1)
    valid = emb(d, "smiles").where("is_valid")
    assert "regexp" not in valid._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["row_id"] for r in valid.collect()) == [1, 2]


def test_large_vocabulary_stays_a_table(spark, tmp_path, monkeypatch):
    import numpy as np
    from propkit.operators import embed, skipgram
    rng = np.random.default_rng(1)
    texts = [(i % 990, " ".join(f"t{i % 20}w{rng.integers(3)}" for _ in range(20)) + f" once{i}") for i in range(1000)]
    odd = [(None, "t1w1 t1w2"), (5, ""), (7, None), (8, "once once1x"), (8, "t1w1 T1W1")]  # ids repeat or are null
    d = spark.createDataFrame(texts + odd, "row_id long, text string").repartition(4)
    monkeypatch.setattr(embed, "DRIVER_VOCAB_BYTES", 0)
    monkeypatch.setattr(embed.Word2Vec, "fit", None)  # nothing is trained on the driver
    monkeypatch.setattr(skipgram, "MOST_TOKENS", 1 << 12)
    monkeypatch.setattr(skipgram, "LEAST_TOKENS", 1 << 12)  # some chunks, and texts cut between them
    model = train_word2vec(corpus(d, "text", 0, kind="text"), vector_size=16, min_count=2, seed=1, max_iter=8)
    vecs = {r["word"]: np.array(r["vector"]) for r in model.getVectors().collect()}
    assert set(vecs) == {f"t{g}w{i}" for g in range(20) for i in range(3)} and model.getVectorSize() == 16
    names = sorted(vecs)
    u = np.array([vecs[w] / np.linalg.norm(vecs[w]) for w in names])
    topic = np.array([w.split("w")[0] for w in names])
    nearest = (u @ u.T - 2 * np.eye(len(names))).argmax(1)
    assert (topic[nearest] == topic).mean() > 0.9  # words of a topic share contexts
    embed.save_word2vec(model, str(tmp_path / "m"))
    model = embed.load_word2vec(spark, str(tmp_path / "m"))
    got = word2vec_embedder(model, 0, "text")(d, "text").collect()
    assert sorted((r["row_id"] or -1, r["text"] or "") for r in got) == sorted((i or -1, t or "") for i, t in texts + odd)
    for r in got:
        known = [vecs[w] for w in (r["text"] or "").lower().split() if w in vecs]
        assert r["is_valid"] == bool(known) and (r["vector"] is None) == (not known)
        if known:
            assert r["vector"] == pytest.approx(np.sum(known, 0), rel=1e-5, abs=1e-6)
