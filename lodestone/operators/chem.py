"""Cleaning, describing and filtering molecules given as SMILES.

Each step is an Arrow function that parses a batch once and returns a struct, so plans stay narrow. Steps follow one
convention: a value, or null with a comment. Tautomers, partition coefficients, drug-likeness scores and SMARTS
patterns need a chemistry toolkit; `require_toolkit` says so instead of giving approximations under those names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import smiles as S
from .relational import filter_ranges, need, quoted

PASSED = "Passed"
# The elements of single-atom salt fragments, solvents and acids that are stripped from mixtures, and the
# comments on them.
SALT_ELEMENTS = ("Cl", "Na", "Mg", "Ca", "K", "Br", "Zn", "Ag", "Al", "Li", "I", "O", "N", "H")
SOLVENTS = (
    "O", "O=[N+]([O-])O", "F[P-](F)(F)(F)(F)F", "O=C([O-])C(F)(F)F", "O=C(O)CC(O)(CC(=O)O)C(=O)O", "CCO", "CCN(CC)CC", "[O-][Cl+3]([O-])([O-])O", "O=P(O)(O)O", "O=C(O)/C=C/C(=O)O",
    "O=C(O)/C=C\\C(=O)O", "[O-][Cl+3]([O-])([O-])[O-]", "CS(=O)(=O)O", "O=C(O)C(=O)O", "F[B-](F)(F)F", "C", "Cc1ccc(S(=O)(=O)[O-])cc1", "C1CCC(NC2CCCCC2)CC1", "O=CO", "O=S(=O)([O-])O",
    "O=C(O)C(F)(F)F", "COS(=O)(=O)[O-]", "CN(C)C=O", "Cc1ccc(S(=O)(=O)O)cc1", "O=C(O)CCC(=O)O", "O=C(O)[C@H](O)[C@@H](O)C(=O)O", "CS(=O)(=O)[O-]", "c1ccncc1", "NCCO", "O=S(=O)([O-])C(F)(F)F",
    "CNC[C@H](O)[C@@H](O)[C@H](O)[C@H](O)CO", "O=C(O)C(O)C(O)C(=O)O", "CC(=O)O", "NC(CO)(CO)CO", "O=S(=O)(O)O",
)
SOLVENT_COMMENTS = ("Pass", "SMILES string is fragmented, but found no common solvents", "SMILES string is fragmented, but all fragments are common solvents. Kept original SMILES", "Pass, removed solvents")
FRAGMENT_COMMENTS = ("Pass", "Pass, kept one instance of repeated fragments", "Pass, defragmented to largest component")


def require_toolkit(what: str) -> None:
    try:
        import rdkit  # noqa: F401
    except ImportError as e:
        raise NotImplementedError(f"{what} needs a chemistry toolkit, which is not installed") from e


Step = Callable[[str], tuple[str | None, str]]


def _canonical(text: str, stereo: bool = True) -> str:
    return S.write(S.parse(text), stereo=stereo)


#: Without stereo marks: every stereoisomer of a solvent is taken for it.
_SOLVENTS = sorted({_canonical(x, stereo=False) for x in SOLVENTS})


def canonicalize(text: str) -> tuple[str | None, str]:
    return _canonical(text), PASSED


def _salt(part: str) -> bool:
    """One atom of a salt's element, in any charge, or one with a single hydrogen."""
    mol = S.parse(part)
    return len(mol.atoms) == 1 and (mol.atoms[0].element in SALT_ELEMENTS or mol.hydrogens(0) == 1)


def remove_salts(text: str) -> tuple[str | None, str]:
    """The longest fragment that is no salt (the first of equal ones); where all are salts, of all. A text of one
    fragment stays as it is."""
    parts = text.split(".")
    if len(parts) == 1:
        return text, PASSED
    return max([p for p in parts if not _salt(p)] or parts, key=len), PASSED


def neutralize(text: str) -> tuple[str | None, str]:
    mol = S.parse(text)
    charged = any(a.charge for a in mol.atoms)
    out = S.write(S.neutralised(mol))
    left = any(a.charge for a in S.parse(out).atoms)
    return out, PASSED if not charged else "charges left" if left else "neutralized"


def flatten_stereo(text: str) -> tuple[str | None, str]:
    return S.write(S.parse(text), stereo=False), PASSED


def remove_isotopes(text: str) -> tuple[str | None, str]:
    return S.write(S.parse(text), isotopes=False), PASSED


def validate(text: str) -> tuple[str | None, str]:
    S.parse(text)
    return text, PASSED


def _fragments(text: Column) -> Column:
    """The fragments of a SMILES, without blanks around."""
    return F.filter(F.transform(F.split(text, "\\."), lambda part: F.trim(part)), lambda part: part != "")


def _without_solvents(text: Column, canonical: Column) -> tuple[Column, Column]:
    """(value, comment): a SMILES without its solvents, told by the canonical form of each fragment; as it is where
    there is one fragment, or nothing else."""
    numbered = F.transform(_fragments(text), lambda part, k: F.struct(part.alias("part"), F.get(canonical, k).alias("form")))
    others = F.filter(numbered, lambda f: ~f["form"].isin(_SOLVENTS))
    none, all_ = F.size(others) == F.size(numbered), F.size(others) == 0
    says = F.when(~F.contains(text, F.lit(".")), SOLVENT_COMMENTS[0]).when(none, SOLVENT_COMMENTS[1]).when(all_, SOLVENT_COMMENTS[2]).otherwise(SOLVENT_COMMENTS[3])
    return F.when(says == SOLVENT_COMMENTS[3], F.array_join(F.transform(others, lambda f: f["part"]), ".")).otherwise(text), says


def _one_fragment(text: Column, canonical: Column) -> tuple[Column, Column]:
    """(value, comment): the first fragment, if any comes twice, else the longest text (the first of equal ones)."""
    parts = _fragments(text)
    twice = F.size(F.array_distinct(parts)) < F.size(parts)
    longest = F.array_max(F.transform(parts, lambda part, k: F.struct(F.length(part).alias("n"), (-k).alias("k"), part.alias("part"))))["part"]
    says = F.when(~F.contains(text, F.lit(".")), FRAGMENT_COMMENTS[0]).when(twice, FRAGMENT_COMMENTS[1]).otherwise(FRAGMENT_COMMENTS[2])
    return F.when(says == FRAGMENT_COMMENTS[0], text).when(twice, F.get(parts, F.lit(0))).otherwise(longest), says


#: Steps that are expressions over fragments, once each of these is read.
EXPRESSIONS: dict[str, Callable[[Column, Column], tuple[Column, Column]]] = {"remove_solvents": _without_solvents, "defragment": _one_fragment}


def _forms(text: str) -> tuple[list[str] | None, str]:
    return [_canonical(part.strip(), stereo=False) for part in text.split(".") if part.strip()], PASSED


STEPS: dict[str, tuple[Step | None, str, str]] = {
    "canonicalize": (canonicalize, "smiles_after_canonicalization", "comments_after_canonicalization"),
    "remove_salts": (remove_salts, "smiles_after_salt_removal", "comments_after_salt_removal"),
    "remove_solvents": (None, "smiles_after_solvent_removal", "comments_after_solvent_removal"),
    "defragment": (None, "smiles_after_defragmentation", "comments_after_defragmentation"),
    "neutralize": (neutralize, "smiles_after_neutralization", "comments_after_neutralization"),
    "flatten_stereo": (flatten_stereo, "smiles_after_stereo_standardization", "comments_after_stereo_standardization"),
    "remove_isotopes": (remove_isotopes, "smiles_after_isotope_removal", "comments_after_isotope_removal"),
    "validate": (validate, "validated_smiles", "validation_status"),
}
STANDARD = ("canonicalize", "remove_salts", "remove_solvents", "defragment", "neutralize", "remove_isotopes", "flatten_stereo", "validate")


def guarded(step: Step, text: str | None) -> tuple[str | None, str]:
    if not text or not text.strip():
        return None, "no SMILES"
    try:
        return step(text.strip())
    except (S.SmilesError, RecursionError) as e:
        return None, f"Failed: {e}"


def _mapped(df: DataFrame, column: str, names: Sequence[str], schema: str, row: Callable[[str | None], tuple]) -> DataFrame:
    """df with new columns computed from a text column, a batch at a time; each different text of a batch once."""
    need(df, [column])
    df = df.drop(*names)
    at, columns = df.columns.index(column), df.columns
    full = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields] + [schema])
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kinds = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).dictionary_encode("encode")
            found = list(zip(*[row(x) for x in texts.dictionary.to_pylist()], strict=True)) or [() for _ in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, t).take(texts.indices) for c, t in zip(found, kinds, strict=True)]], names=[*columns, *names])

    return df.mapInArrow(run, full)


def _by_expression(df: DataFrame, column: str, step: str, value: str, comment: str) -> DataFrame:
    read = _mapped(df, column, ["_forms", "_why"], "_forms array<string>, _why string", lambda x: guarded(_forms, x))
    text = F.trim(quoted(column))
    found, says = EXPRESSIONS[step](text, F.col("_forms"))
    there = F.col("_forms").isNotNull()
    return read.withColumns({value: F.when(there, found), comment: F.when(there, says).otherwise(F.col("_why"))}).drop("_forms", "_why")


def clean(df: DataFrame, column: str, step: str) -> DataFrame:
    """df with the result of one step and its comment."""
    f, value, comment = STEPS[step]
    if f is None:
        return _by_expression(df, column, step, value, comment)
    return _mapped(df, column, [value, comment], f"`{value}` string, `{comment}` string", lambda x: guarded(f, x))


def comments(df: DataFrame, column: str) -> DataFrame:
    """(comment, n)."""
    return df.groupBy(quoted(column).alias("comment")).agg(F.count("*").alias("n"))


def standardize(df: DataFrame, column: str, steps: Sequence[str] = STANDARD) -> DataFrame:
    """df with standardized_smiles and standardization_comment: all steps in turn; the first failure ends them and is the
    comment. If stereo marks are flattened in any step, they are from the first."""
    flat = "flatten_stereo" in steps
    value, says = "standardized_smiles", "standardization_comment"
    out = df.drop(value, says).withColumns({value: quoted(column), says: F.lit(None).cast("string")})
    for name in steps:
        f = STEPS[name][0]
        if f is None:
            out = _by_expression(out, value, name, "_value", "_says")
        else:
            own = (lambda x: (_canonical(x, stereo=False), PASSED)) if name == "canonicalize" and flat else f
            out = _mapped(out, value, ["_value", "_says"], "_value string, _says string", lambda x, own=own: guarded(own, x))
        failed = F.col("_value").isNull() & F.col(says).isNull()
        out = out.withColumns({says: F.when(failed, F.concat(F.lit(f"{name}: "), F.col("_says"))).otherwise(F.col(says)), value: F.col("_value")}).drop("_value", "_says")
    return out.withColumn(says, F.coalesce(says, F.lit("Standardized")))


DESCRIPTORS = ("mol_weight", "heavy_atoms", "hbd", "hba", "rotatable_bonds", "rings", "aromatic_atoms", "tpsa", "charge", "fraction_sp3")


def describe(df: DataFrame, column: str, names: Sequence[str] = DESCRIPTORS) -> DataFrame:
    """df with a column for each descriptor; null where the SMILES is no molecule."""
    unknown = [n for n in names if n not in DESCRIPTORS]
    if unknown:
        raise ValueError(f"unknown descriptors: {unknown}; there are {DESCRIPTORS}")

    def row(x: str | None) -> tuple:
        try:
            d = S.descriptors(S.parse(x.strip())) if x and x.strip() else None
        except S.SmilesError:
            d = None
        return tuple(None if d is None else float(d[n]) for n in names)

    return _mapped(df, column, names, ", ".join(f"{n} double" for n in names), row)


def scaffolds(df: DataFrame, column: str, kind: str = "bemis_murcko") -> DataFrame:
    """df with scaffold_<kind> (empty without rings) and scaffold_comments."""

    def row(x: str | None) -> tuple[str | None, str]:
        return guarded(lambda t: (S.scaffold(S.parse(flatten_stereo(t)[0]), kind), PASSED), x)

    return _mapped(df, column, [f"scaffold_{kind}", "scaffold_comments"], f"scaffold_{kind} string, scaffold_comments string", row)


def fingerprints(df: DataFrame, column: str, radius: int = 2, bits: int = 2048, name: str = "features") -> DataFrame:
    """df with a vector of 0 and 1, null where the SMILES is no molecule."""

    def row(x: str | None) -> tuple[list[float] | None]:
        try:
            on = S.fingerprint(S.parse(x.strip()), radius, bits) if x and x.strip() else None
        except S.SmilesError:
            on = None
        if on is None:
            return (None,)
        v = [0.0] * bits
        for k in on:
            v[k] = 1.0
        return (v,)

    return _mapped(df, column, [name], f"`{name}` array<double>", row)


# Ranges that a row must be in, from descriptors that the kernel has.
RULES: dict[str, dict[str, tuple[float | None, float | None]]] = {
    "veber": {"tpsa": (0, 140), "rotatable_bonds": (0, 10)},
    "lipinski_without_logp": {"mol_weight": (0, 500), "hbd": (0, 5), "hba": (0, 10)},
    "lead_like_without_logp": {"mol_weight": (200, 350), "rotatable_bonds": (None, 7), "rings": (1, None)},
    "rule_of_three_without_logp": {"mol_weight": (None, 300), "hbd": (None, 3), "hba": (None, 3), "rotatable_bonds": (None, 3), "tpsa": (None, 60)},
}


def filter_by_rule(df: DataFrame, column: str, rule: str) -> DataFrame:
    """Rows that keep a rule, with its descriptors; rows that are no molecules are out."""
    if rule not in RULES:
        require_toolkit(f"rule {rule}")
        raise ValueError(f"unknown rule {rule!r}; there are {list(RULES)}")
    return filter_ranges(describe(df, column, list(RULES[rule])), RULES[rule])


def filter_by_scaffold(df: DataFrame, column: str, wanted: Sequence[str], action: str = "keep") -> DataFrame:
    """Rows whose scaffold is one of those given (keep), or is not (drop; rows without a scaffold stay)."""
    canonical = {_canonical(w, stereo=False) if w else "" for w in wanted}
    found = scaffolds(df, column)
    inside = F.coalesce(F.col("scaffold_bemis_murcko").isin(list(canonical)), F.lit(False))
    return found.where(inside if action == "keep" else ~inside)


def summarise(df: DataFrame, column: str) -> dict[str, Any]:
    """Valid and invalid rows, rows of several fragments, and charged ones."""
    d = describe(df, column, ["charge"])
    fragments = F.size(F.split(quoted(column), "\\."))
    return d.agg(F.count("*").alias("n"), F.count("charge").alias("n_valid"), F.count_if(F.col("charge").isNotNull() & (fragments > 1)).alias("n_mixtures"), F.count_if(F.col("charge") != 0).alias("n_charged")).first().asDict()
