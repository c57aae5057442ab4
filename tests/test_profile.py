
from propkit.operators import profile as P
from propkit.sources.readers import read_smi


def _prof(spark, items):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(items)], "row_id long, smiles string")
    return P.structure_profile(df, "smiles")


def test_structure_edge_cases(spark):
    items = ["C", "CCO", "C#N", "c1ccccc1", "C1CCCCC1", "CC(=O)Oc1ccccc1C(=O)O", "[NH4+]", "ClCBr", "O",
             "not_a_molecule(", "", "nan", "C\u00a0CO"]
    rows = {r["row_id"]: r for r in _prof(spark, items).collect()}
    assert [rows[i]["is_valid"] for i in range(len(items))] == [True] * 9 + [False] * 3 + [True]
    assert rows[3]["is_aromatic"] and not rows[3]["is_non_cyclic"]
    assert rows[4]["is_cyclic_non_aromatic"]
    assert rows[5]["n_atoms"] == 13 and dict(rows[5]["elements"]) == {"C": 9, "O": 4}
    assert rows[6]["category"] == "Inorganic" and rows[6]["molecular_weight"] == P.G.MASSES["N"] + 4 * P.G.H_MASS
    # the reference rule puts Br (Z=35) and C (Z=6) under "Metal", Cl (Z=17) under "Non-metal"
    assert dict(rows[7]["element_categories"]) == {"Metal": 2, "Non-metal": 1}
    assert rows[12]["n_atoms"] == 3
    # each valid row is in exactly one structural class
    for r in rows.values():
        if r["is_valid"]:
            assert (r["is_aromatic"] + r["is_non_cyclic"] + r["is_cyclic_non_aromatic"]) == 1


def test_size_bins(spark):
    df = spark.createDataFrame([(i, n, True) for i, n in enumerate([1, 5, 10, 11, 20, 21])],
                               "row_id long, n_atoms int, is_valid boolean")
    got = [(r["bins"], r["count"]) for r in P.binned_size_distribution(df, 10).collect()]
    # right-closed edges: [1, 11] then (11, 21]
    assert got == [("1-11", 4), ("11-21", 2)]
    eq = spark.createDataFrame([(0, 4, True), (1, 4, True)], "row_id long, n_atoms int, is_valid boolean")
    assert [(r["bins"], r["count"]) for r in P.binned_size_distribution(eq, 10).collect()] == [("4-4", 2)]


def test_filter_unions_rare_and_listed_elements(spark):
    p = _prof(spark, ["CCO", "CCO", "CCN", "CCBr", "CCCl", "CC"])
    kept = P.filter_profile(p, elemental_count_threshold=1, filter_elements=["O"])
    assert sorted(r["smiles"] for r in kept.collect()) == ["CC"]
    kept0 = P.filter_profile(p, min_atoms=0, max_atoms=2)
    assert kept0.count() == 1


def test_json_roundtrip(spark):
    p = _prof(spark, ["CCO"])
    back = P.profile_from_json(P.profile_json(p)).first()
    assert dict(back["elements"]) == {"C": 2, "O": 1}


def test_smi_reader(spark, tmp_path):
    (tmp_path / "a.smi").write_text("SMILES\nCCO ethanol\n\nC#N\n")
    (tmp_path / "b.smi").write_text("c1ccccc1\nsmiles\n")
    got = sorted(r[0] for r in read_smi(spark, str(tmp_path)).collect())
    assert got == ["C#N", "CCO", "c1ccccc1", "smiles"]


def test_smi_is_one_scan(spark, tmp_path):
    """Headers of several files, a header word further on, blank first lines, a file of a header alone."""
    texts = {"a": "SMILES name\nC\nsmiles\nCO\n", "b": "CC\nSMILES\n", "c": "smiles\n", "d": "\nSmiles\nN\n", "e": "", "f": "SMILES\nSMILES\nO"}
    for name, text in texts.items():
        (tmp_path / f"{name}.smi").write_text(text)
    (tmp_path / "g.smi").write_text("SMILES\n" + "C#N x\n" * 3000)
    df = read_smi(spark, str(tmp_path))
    got = sorted(r[0] for r in df.collect())
    assert got == sorted(["C", "smiles", "CO", "CC", "SMILES", "Smiles", "N", "SMILES", "O"] + ["C#N"] * 3000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # the long file in several blocks
    try:
        again = read_smi(spark, str(tmp_path))
        assert sorted(r[0] for r in again.collect()) == got
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Broadcast" not in plan
