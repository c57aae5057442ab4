"""The pipeline's stages against each other, and its registration."""

import collections
import re

import corpus_pipeline
from propkit.llm import toxicity
from propkit.llm._spark import documents, labels

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, sizes, rows = documents(spark, SF), [], {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        rows[name] = spark.read.parquet(str(tmp_path / name))
        docs = rows[name]
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    model = toxicity.fit(documents(spark, SF), labels(spark, SF))
    assert sizes[0] == toxicity.score(documents(spark, SF), model).where("predicted = 0").count()
    low = [r.text.lower() for r in rows["exact_dedup"].collect()]
    assert len(low) == len(set(low)) == len({r.text.lower() for r in rows["toxicity"].collect()})
    assert sizes[2] <= sizes[1] and rows["near_dedup"].select("doc_id").distinct().count() == sizes[2]
    mixed = collections.Counter(r.doc_id for r in rows["mixing"].collect())
    assert max(mixed.values()) <= 2
    packed = rows["packing"].collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == mixed
    assert max(r.offset + r.length for r in packed) <= 1024


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(got.columns)


def staged(spark, path, docs, labs):
    docs.write.parquet(f"{path}/documents.parquet")
    labs.write.parquet(f"{path}/labels.parquet")
    rows, now = {}, spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(path)).write.parquet(f"{path}/{name}")
        now = rows[name] = spark.read.parquet(f"{path}/{name}")
        if name != "packing":
            assert now.columns == docs.columns
    return rows


def test_odd_rows(spark, odd, odd_labels, tmp_path):
    """Nulls, empty and long texts, repeated rows, ties and clashing names through every stage."""
    rows = staged(spark, tmp_path, odd, odd_labels)
    left = [r.text for r in rows["toxicity"].collect()]
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    exact = rows["exact_dedup"].collect()
    assert sorted(low(r.text) for r in exact) == sorted({low(t) for t in left})
    # brute force: five-word shingles, similarity 0.8, one of each component
    def shingles(t):
        w = re.findall(r"[^ \t-\r]+", low(t))
        return {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = [shingles(r.text) for r in exact]
    groups = list(range(len(exact)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = groups[i], groups[j]
                groups = [new if g == old else g for g in groups]
    near = rows["near_dedup"].collect()
    assert len(near) == len(set(groups)) and {r.text for r in near} <= {r.text for r in exact}
    mixed = rows["mixing"].collect()
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in near} and all(re.search(r"[^ \t-\r]", r.text) for r in mixed)
    packed = rows["packing"].collect()
    assert sum(r.piece == 0 for r in packed) == len(mixed) and max(r.offset + r.length for r in packed) <= 1024


def test_empty_table(spark, none, odd_labels, tmp_path):
    assert all(r.count() == 0 for r in staged(spark, tmp_path, none, odd_labels).values())


def test_registered(spark):
    import __spark_entry__ as E
    names = set(E.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert set(E.oracle_sql()) <= names
