"""The structure stage: SMILES in, values out, one Arrow crossing. Everything after it is columns.

A stage carries the table's own columns through, so nothing is joined back, and repeated keys stay repeated. Rows are dealt out
evenly first, as a file of many structures may be small enough to be read in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from leadlight.functions.rules import col
from leadlight.kernel import chem, pure

FIELDS = (
    "Canonical_SMILES string, Scaffold_SMILES string, MolWt double, LogP double, MR double, TPSA double, HBD int, HBA int, RotBonds int, Rings int, "
    "AromaticRings int, HeavyAtoms int, FractionCSP3 double, Stereo_Status string, Stereo_Unassigned_Centers int, Stereo_Unassigned_DoubleBonds int, "
    "Patterns map<string,int>, fp array<bigint>"
)
DESCRIBED = ("MolWt", "TPSA", "HBD", "HBA", "RotBonds", "Rings", "AromaticRings", "HeavyAtoms", "FractionCSP3")
STEREO = ("Stereo_Status", "Stereo_Unassigned_Centers", "Stereo_Unassigned_DoubleBonds")
PREPARED = "Prepared_SMILES string, Prep_Cleanup_Changed boolean, Prep_Fragment_Changed boolean, Prep_Uncharge_Changed boolean, Stereo_Status string, Stereo_Unassigned_Centers int, Stereo_Unassigned_DoubleBonds int"
COMPLEXITY = "SpiroAtoms int, BridgeheadAtoms int, Stereocenters int, Heteroatoms int, AromaticFraction double, BalabanTopological double"
FEATURES = "Groups map<string,double>, Morgan_Counts map<bigint,int>, AtomPair_Counts map<bigint,int>, Torsion_Counts map<bigint,int>, Fragments array<string>"
GRAPH = "n_atoms int, n_edges int, atoms array<array<float>>, edges array<array<int>>, bonds array<array<float>>"

#: Tasks for each core, texts whose values a task remembers, and values held as Python objects at a time.
TASKS, KNOWN, HELD = 4, 2048, 512


def fingerprint_of(name: str) -> Callable[[pure.Mol], dict[int, int]]:
    if name not in chem.FINGERPRINTS:
        raise ValueError(f"unknown fingerprint {name!r}; one of {', '.join(chem.FINGERPRINTS)}")
    return chem.FINGERPRINTS[name]


def read(smiles: str | None) -> pure.Mol | None:
    """The molecule of a text; None if it can't be read."""
    try:
        return pure.parse(smiles or "")
    except (pure.ParseError, RecursionError):
        return None


def values(smiles: str | None, fingerprint: str = "morgan", n_bits: int = 2048, wanted: Iterable[str] | None = None) -> dict[str, object] | None:
    """FIELDS of one structure, or those that are made together with the ``wanted`` ones; None if it can't be read."""
    kind, mol = fingerprint_of(fingerprint), read(smiles)
    if mol is None:
        return None
    together = (
        (DESCRIBED, lambda: pure.descriptors(mol)),
        (("LogP", "MR"), lambda: chem.lipophilicity(mol)),
        (STEREO, lambda: dict(zip(STEREO, chem.stereo_summary(mol), strict=True))),
        (("Canonical_SMILES",), lambda: {"Canonical_SMILES": pure.write(mol)}),
        (("Scaffold_SMILES",), lambda: {"Scaffold_SMILES": pure.scaffold(mol)}),
        (("Patterns",), lambda: {"Patterns": list(pure.counts(mol, pure.PANEL).items())}),
        (("fp",), lambda: {"fp": pure.packed(kind(mol), n_bits)}),
    )
    return {k: v for names, make in together if wanted is None or not set(names).isdisjoint(wanted) for k, v in make().items()}


def through(df: DataFrame, smiles: str, fields: str, make: Callable[[str | None], dict[str, object] | None]) -> DataFrame:
    """The rows with ``fields``, nulls where ``make`` gives None; columns of these names that the table has are replaced.

    Equal texts of a batch are computed once, and those that a task still knows from batches before not again.
    """
    made = _parse_datatype_string(fields)
    types = {f.name: to_arrow_type(f.dataType) for f in made}
    kept = [c for c in df.columns if c not in types]
    renamed = df.select(*[col(c).alias(f"c{i}") for i, c in enumerate(kept)], col(smiles).cast("string").alias("s"))
    dealt = renamed.repartition(TASKS * df.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(KNOWN)(make)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(len(kept)).dictionary_encode(null_encoding="encode")
            held: dict[str, list[pa.Array]] = {n: [] for n in types}
            for start in range(0, len(texts.dictionary), HELD):
                found = [known(s) or {} for s in texts.dictionary[start : start + HELD].to_pylist()]
                for n, t in types.items():
                    held[n].append(pa.array([v.get(n) for v in found], t))
            arrays = [*batch.columns[: len(kept)], *[pa.concat_arrays(parts).take(texts.indices) for parts in held.values()]]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[: len(kept)], *[f"m{i}" for i in range(len(types))]])

    schema = renamed.drop("s").schema
    for i, f in enumerate(made):
        schema = schema.add(f"m{i}", f.dataType)
    return dealt.mapInArrow(run, schema).toDF(*kept, *types)


def of_fields(names: Iterable[str] | None) -> str:
    """The schema of the named FIELDS and of HeavyAtoms, which tells a structure that can't be read; of all without names."""
    if names is None:
        return FIELDS
    wanted = {*names, "HeavyAtoms"}
    known = {f.split(" ", 1)[0]: f for f in FIELDS.split(", ")}
    if unknown := sorted(wanted - set(known)):
        raise ValueError(f"no such field: {', '.join(unknown)}")
    return ", ".join(f for name, f in known.items() if name in wanted)


def structures(df: DataFrame, smiles: str = "SMILES", fingerprint: str = "morgan", n_bits: int = 2048, drop_invalid: bool = True, fields: Iterable[str] | None = None) -> DataFrame:
    """The rows with FIELDS; invalid structures go, or stay with nulls (row order is not kept).

    With ``fields`` only these and HeavyAtoms are made: a task can't know which columns are read after it.
    """
    fingerprint_of(fingerprint)
    wanted = None if fields is None else (*fields, "HeavyAtoms")
    made = through(df, smiles, of_fields(wanted), lambda s: values(s, fingerprint, n_bits, wanted))
    return made.where(F.col("HeavyAtoms").isNotNull()) if drop_invalid else made


def prepared(df: DataFrame, smiles: str = "SMILES") -> DataFrame:
    """The rows with PREPARED: the largest part, uncharged, what each step changed, and the stereo summary."""
    return through(df, smiles, PREPARED, _prepared)


def _prepared(smiles: str | None) -> dict[str, object] | None:
    try:
        return chem.prepare(smiles or "")
    except (pure.ParseError, RecursionError):
        return None


def prepared_structures(df: DataFrame, smiles: str = "SMILES", fingerprint: str = "morgan", n_bits: int = 2048, drop_invalid: bool = True, fields: Iterable[str] | None = None) -> DataFrame:
    """The rows with PREPARED and the fields of the prepared structure as ``structures`` gives them, in one crossing."""
    fingerprint_of(fingerprint)
    wanted = None if fields is None else (*fields, "HeavyAtoms")
    asked = of_fields(wanted).split(", ")

    def make(s: str | None) -> dict[str, object] | None:
        done = _prepared(s)
        return done and done | (values(str(done["Prepared_SMILES"]), fingerprint, n_bits, wanted) or {})

    made = through(df, smiles, ", ".join([*[f for f in PREPARED.split(", ") if f not in asked], *asked]), make)
    return made.where(F.col("HeavyAtoms").isNotNull()) if drop_invalid else made


def complexity(df: DataFrame, smiles: str = "SMILES") -> DataFrame:
    """The rows with COMPLEXITY; nulls for invalid structures."""
    return through(df, smiles, COMPLEXITY, lambda s: (mol := read(s)) and chem.complexity(mol))


def features(df: DataFrame, smiles: str = "SMILES", max_fragments: int = 128) -> DataFrame:
    """The rows with FEATURES: functional groups and environment, hashed counts of three kinds, fragments.

    An invalid structure has zero groups and empty counts and fragments.
    """

    def make(s: str | None) -> dict[str, object]:
        mol = read(s)
        counts = {k: list(chem.FINGERPRINTS[f](mol).items()) if mol else [] for k, f in (("Morgan_Counts", "morgan"), ("AtomPair_Counts", "atompair"), ("Torsion_Counts", "torsion"))}
        return {"Groups": list(chem.groups(mol).items()), "Fragments": chem.fragments(mol, max_fragments) if mol else []} | counts

    return through(df, smiles, FEATURES, make)


def graphs(df: DataFrame, smiles: str = "SMILES") -> DataFrame:
    """The rows with GRAPH; an invalid structure has an empty graph."""

    def make(s: str | None) -> dict[str, object]:
        mol = read(s)
        atoms, edges, bonds = pure.graph(mol) if mol else ([], [], [])
        return {"n_atoms": len(atoms), "n_edges": len(edges), "atoms": atoms, "edges": edges, "bonds": bonds}

    return through(df, smiles, GRAPH, make)


def outcome(df: DataFrame, structure: str = "HeavyAtoms") -> DataFrame:
    """(searched, valid, invalid) of a table that kept its invalid structures; one row."""
    return df.agg(F.count("*").alias("searched"), F.count(col(structure)).alias("valid"), F.count_if(col(structure).isNull()).alias("invalid"))
