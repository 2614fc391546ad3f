import random

import pytest

from lodestone.functions import smiles as S
from lodestone.operators import chem

ASPIRIN, CAFFEINE = "CC(=O)Oc1ccccc1C(=O)O", "Cn1cnc2c1c(=O)n(C)c(=O)n2C"
MOLECULES = [ASPIRIN, CAFFEINE, "c1ccc2[nH]ccc2c1", "C1CC2CCC1C2", "[Na+].[Cl-]", "N#CC(C)(C)O", "O=C(O)C(N)Cc1ccccc1", "c1ccc(-c2ccccc2)cc1", "CC(C)(C)[N+](=O)[O-]", "C%10CCCC%10", "[13CH4]", "FC(F)(F)S(=O)(=O)N"]


def shuffled(mol, seed):
    order = list(range(len(mol.atoms)))
    random.Random(seed).shuffle(order)
    place = {k: i for i, k in enumerate(order)}
    return S.Molecule([S.Atom(a.element, a.aromatic, a.isotope, a.charge, a.hydrogens, a.chiral, {place[n]: o for n, o in a.near.items()}) for a in (mol.atoms[k] for k in order)])


@pytest.mark.parametrize("text", MOLECULES)
def test_canonical_whatever_the_order(text):
    want = S.write(S.parse(text))
    assert {S.write(shuffled(S.parse(text), k)) for k in range(12)} == {want}
    assert S.write(S.parse(want)) == want
    a, b = S.descriptors(S.parse(text)), S.descriptors(S.parse(want))
    assert a == pytest.approx(b)


@pytest.mark.parametrize("text", ["", "C(", "C1CC", "C=", "CC)", "[Xx]", "C==C", "F(C)C", "c1ccccc", "cC", "C11", "x", "[C", "(C)", "C%1"])
def test_what_is_no_molecule(text):
    with pytest.raises(S.SmilesError):
        S.parse(text)


def test_descriptors():
    d = S.descriptors(S.parse(ASPIRIN))
    assert (round(d["mol_weight"], 2), d["hbd"], d["hba"], d["rings"], d["tpsa"], d["rotatable_bonds"]) == (180.16, 1, 4, 1, 63.6, 3)
    c = S.descriptors(S.parse(CAFFEINE))
    assert (round(c["mol_weight"], 2), c["hbd"], c["rings"], c["rotatable_bonds"]) == (194.19, 0, 2, 0)


def test_scaffolds_and_fingerprints():
    assert S.scaffold(S.parse(ASPIRIN)) == "c1ccccc1" and S.scaffold(S.parse("CCO")) == ""
    assert S.scaffold(S.parse("Cc1ccccc1CCC2CCNCC2"), "generic") == S.write(S.parse("C1CCC(CCC2CCCCC2)CC1"))
    assert S.fingerprint(S.parse("OCC")) == S.fingerprint(S.parse("CCO")) != S.fingerprint(S.parse("CCN"))


@pytest.fixture(scope="module")
def table(spark):
    rows = [(0, ASPIRIN), (1, "[Na+].[O-]C(=O)c1ccccc1"), (2, "CCO.CC(=O)Oc1ccccc1C(=O)O"), (3, None), (4, "nope"), (5, ""), (6, "[Na+].[Cl-]"), (7, "N[C@@H](C)C(=O)O"), (8, "[13CH3]CO"), (9, "CC.CC")]
    return spark.createDataFrame(rows, "k long, `the smiles` string")


def test_cleaning(table):
    got = {r.k: r for r in chem.standardize(table, "the smiles").collect()}
    assert got[1].standardized_smiles == S.write(S.parse("OC(=O)c1ccccc1"))
    assert got[2].standardized_smiles == got[0].standardized_smiles
    assert [got[k].standardized_smiles for k in (3, 4, 5)] == [None] * 3 and got[4].standardization_comment.startswith("canonicalize: Failed")
    assert "@" not in got[7].standardized_smiles and got[8].standardized_smiles == S.write(S.parse("CCO")) and got[9].standardized_smiles == "CC"
    assert {r.k: r.smiles_after_salt_removal for r in chem.clean(table, "the smiles", "remove_salts").collect()}[6] == "[Na+]"
    assert chem.comments(chem.clean(table, "the smiles", "validate"), "validation_status").count() == 3


def test_tables(table):
    d = chem.describe(table, "the smiles", ["mol_weight", "tpsa"])
    assert d.where("mol_weight is null").count() == 3
    assert sorted(r.k for r in chem.filter_by_rule(table, "the smiles", "veber").collect()) == [0, 1, 2, 6, 7, 8, 9]
    assert sorted(r.k for r in chem.filter_by_scaffold(table, "the smiles", ["C1=CC=CC=C1", "c1ccccc1"]).collect()) == [0, 1, 2]
    f = chem.fingerprints(table, "the smiles", bits=256)
    assert f.where("features is null").count() == 3 and f.where("size(features) = 256").count() == 7
    assert chem.summarise(table, "the smiles") == {"n": 10, "n_valid": 7, "n_mixtures": 4, "n_charged": 0}
    with pytest.raises((NotImplementedError, ValueError)):
        chem.filter_by_rule(table, "the smiles", "qed")


def test_fixed_salts_and_solvents():
    assert chem.remove_salts("CCN.[Cl-]") == ("CCN", "Passed") and chem.remove_salts("[Cl-].CC.CCC.O") == ("CCC", "Passed") and chem.remove_salts("CC") == ("CC", "Passed")
    assert chem.remove_salts("CCO.[Fe+2]")[0] == "[Fe+2]" and chem.remove_salts("F.CC")[0] == "CC"  # iron is no salt's element; one hydrogen


def test_fixed_solvents_and_fragments(spark):
    def run(step, *texts):
        df = chem.clean(spark.createDataFrame(list(enumerate(texts)), "k long, s string"), "s", step)
        return [tuple(r)[2:] for r in df.orderBy("k").collect()]

    assert run("remove_solvents", "OS(=O)(=O)O.OC(=O)c1ccccc1", "CCCCCC.CCN", "CCO.O", "CCO", "OC(=O)[C@@H](O)[C@H](O)C(O)=O. CCN", None, "C(.C", "CCN.CC.OCC") == [
        ("OC(=O)c1ccccc1", "Pass, removed solvents"),
        ("CCCCCC.CCN", "SMILES string is fragmented, but found no common solvents"),
        ("CCO.O", "SMILES string is fragmented, but all fragments are common solvents. Kept original SMILES"),
        ("CCO", "Pass"),
        ("CCN", "Pass, removed solvents"),
        (None, "no SMILES"),
        (None, run("remove_solvents", "C(")[0][1]),
        ("CCN.CC", "Pass, removed solvents"),
    ]
    assert run("defragment", "CCO", "CC.CC", "C.CCC.CC", "CC.CN", "") == [("CCO", "Pass"), ("CC", "Pass, kept one instance of repeated fragments"), ("CCC", "Pass, defragmented to largest component"), ("CC", "Pass, defragmented to largest component"), (None, "no SMILES")]


@pytest.mark.parametrize("text", ["N[C@@H](C)C(=O)O", "C[C@H](N)C(=O)O", "F/C=C/Cl", "F/C=C\\Cl"])
def test_marked_molecules_are_refused_or_flattened(spark, text):
    with pytest.raises(S.SmilesError, match="stereo"):
        S.write(S.parse(text))
    df = spark.createDataFrame([(text,)], "s string")
    row = chem.clean(chem.clean(df, "s", "canonicalize"), "s", "flatten_stereo").first()
    assert row[1] is None and "stereo" in row[2] and row[3] == S.write(S.parse(text.translate({ord(c): None for c in "@/\\"})))
    assert chem.standardize(df, "s").first().standardization_comment == "Standardized"


def test_long_chains_are_written(spark):
    assert len(S.parse(S.write(S.parse("C" * 400))).atoms) == 400


def test_weights_of_isotopes():
    assert S.descriptors(S.parse("[13CH3]CO"))["mol_weight"] == pytest.approx(47.0614, abs=1e-4)
    assert S.descriptors(S.parse("[2H]O[2H]"))["mol_weight"] == pytest.approx(20.0272, abs=1e-4)


def test_each_text_of_a_batch_is_read_once(spark):
    def once(x, seen=set()):  # noqa: B006
        assert x not in seen
        seen.add(x)
        return (None if x is None else x + "!",)

    df = spark.createDataFrame([("C",), ("CC",), (None,)] * 20 + [("CCC",)], "s string").coalesce(1)
    got = [r.t for r in chem._mapped(df, "s", ["t"], "t string", once).collect()]
    assert got == ["C!", "CC!", None] * 20 + ["CCC!"]
