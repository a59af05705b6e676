"""Column categories of a compound table: their columns, key column and prefix, and how a table's own are found."""

from __future__ import annotations

from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Category:
    key: str
    title: str
    columns: tuple[str, ...]
    key_column: str
    prefix: str | None = None


def _category(key: str, title: str, key_column: str, columns: str, prefix: str | None = None) -> Category:
    return Category(key, title, tuple(columns.split()), key_column, prefix)


# The interface of compound tables (names of categories and columns).
CATEGORIES: dict[str, Category] = {
    c.key: c
    for c in (
        _category("cns_mpo", "CNS MPO Analysis", "CNS_MPO", "CNS_MPO CNS_MPO_Class BBB_Likely MPO_MW MPO_LogP MPO_LogD MPO_TPSA MPO_HBD MPO_pKa cLogD_7.4 pKa_Basic pKa_Acidic MolWt LogP TPSA HBD"),
        _category("oral_bioavailability", "Oral Bioavailability Analysis", "Bioavail_Score", "Bioavail_Score Veber_Pass Egan_Pass Ghose_Pass Muegge_Pass RO5_Pass TPSA RotBonds MolWt LogP"),
        _category("rule_of_5", "Rule of 5 (Lipinski) Analysis", "RO5_Pass", "RO5_Pass RO5_Violations RO5_MW RO5_LogP RO5_HBD RO5_HBA MolWt LogP HBD HBA"),
        _category("rule_of_3", "Rule of 3 (Fragment) Analysis", "RO3_Pass", "RO3_Pass RO3_Violations RO3_MW RO3_LogP RO3_HBD RO3_HBA RO3_RotBonds RO3_TPSA"),
        _category("medchem_flags", "MedChem Flags (PAINS/BRENK/NIH/ZINC)", "MedChem_Alerts", "PAINS PAINS_Type BRENK NIH ZINC MedChem_Alerts"),
        _category("toxicity", "Toxicity Structural Alerts", "Tox_Risk", "Tox_Risk Tox_Total_Alerts", "Tox_"),
        _category("metabolism", "Metabolism and Soft Spots", "Met_Stability", "Met_Stability Met_Total_Sites Met_Glucuronidation Met_Sulfation Met_Acetylation Met_Methylation", "Met_"),
        _category("herg", "hERG Risk", "hERG_Risk", "hERG_Risk hERG_Alerts hERG_basic_nitrogen hERG_aromatic_ring hERG_hydrophobic_center hERG_tertiary_amine"),
        _category("cyp", "CYP Inhibition Risk", "CYP_Total_Inhibition", "CYP3A4_Inhibitor CYP2D6_Inhibitor CYP2C9_Inhibitor CYP_MBI_Risk CYP_Total_Inhibition"),
        _category("solubility", "Solubility", "Sol_Consensus_LogS", "Sol_ESOL_LogS Sol_ESOL_mg_L Sol_ESOL_Class Sol_Ali_LogS Sol_SilicosIT_LogS Sol_Consensus_LogS"),
        _category("permeability", "Permeability", "Perm_GI_Absorption", "Perm_GI_Absorption Perm_Caco2_LogPapp Perm_Caco2_Class Perm_PAMPA_LogPe Perm_PAMPA_Class Perm_Pgp_Likelihood Perm_Skin_LogKp"),
        _category("pk", "PK heuristics", "F_Class", "PPB_Est_% PPB_Class Vd_Est_L_kg Vd_Class CL_Risk CL_SoftSpots T_half_Est F_Class F_Est_%"),
        _category("lead", "Lead optimization metrics", "Lead_LLE", "Lead_LE Lead_LE_Quality Lead_LLE Lead_LLE_Quality Lead_LELP Lead_LELP_Quality Lead_BEI Lead_SEI Lead_FitQuality"),
        _category("qed", "QED", "QED", "QED QED_MW QED_ALOGP QED_HBA QED_HBD QED_PSA QED_ROTB QED_AROM QED_ALERTS"),
        _category("sa_complexity", "Synthetic accessibility + complexity", "SA_Score", "SA_Score SA_Class Complexity_BertzCT Complexity_BalabanJ Complexity_HallKierAlpha Complexity_NumSpiroAtoms Complexity_NumBridgeheadAtoms Complexity_NumStereoCenters Complexity_NumUnspecifiedStereoCenters Complexity_NumHeteroAtoms Complexity_AromaticAtomFrac", "Complexity_"),
        _category("scaffolds", "Murcko scaffolds", "Scaffold_Size", "Scaffold_ID Scaffold_SMILES Scaffold_Size", "Scaffold_"),
        _category("clustering", "Similarity clusters", "Cluster_Size", "Cluster_ID Cluster_Size Cluster_Representative_ID Cluster_MedoidMeanSim", "Cluster_"),
        _category("developability", "Developability indices", "Dev_Score", "Dev_Score Dev_Class Dev_Risk_Class Dev_Risk_Burden Dev_BasePoints Dev_GSK_4_400_Pass Dev_Pfizer_3_75_Pass Dev_GoldenTriangle_Pass Dev_Solubility_Risk Dev_Flags", "Dev_"),
        _category("shape3d", "3D shape descriptors", "3D_RadiusOfGyration", "3D_Mode 3D_NumConfs 3D_SelectedConfId 3D_Minimizer 3D_Converged 3D_BestEnergy 3D_Asphericity 3D_Eccentricity 3D_InertialShapeFactor 3D_NPR1 3D_NPR2 3D_PMI1 3D_PMI2 3D_PMI3 3D_RadiusOfGyration 3D_SpherocityIndex 3D_PBF", "3D_"),
    )
}

# Candidates for the id and the structure column, in order of preference.
ID_COLUMNS = ("Compound_ID", "compound_id", "Compound", "compound", "Name", "name", "ID", "id")
SMILES_COLUMNS = ("Calc_Canonical_SMILES", "Calc_Base_SMILES", "Canonical_SMILES", "Input_Canonical_SMILES", "SMILES")
#: The order that retrosynthesis targets use instead.
RETRO_SMILES_COLUMNS = ("Calc_Canonical_SMILES", "Canonical_SMILES", "SMILES", "Input_Canonical_SMILES")


def category_columns(columns: list[str], key: str) -> list[str]:
    """The table's columns of a category: the listed ones, then others with its prefix in the table's order."""
    if key not in CATEGORIES:
        return []
    category = CATEGORIES[key]
    listed = [c for c in category.columns if c in columns]
    return listed + [c for c in columns if category.prefix and c.startswith(category.prefix) and c not in listed]


def category_key(df: DataFrame, key: str) -> str | None:
    """The category's key column, or else its first numeric column, or else its first."""
    present = category_columns(df.columns, key)
    if CATEGORIES[key].key_column in df.columns:
        return CATEGORIES[key].key_column
    numeric = [c for c, kind in df.dtypes if c in present and kind in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    ordered = [c for c in present if c in numeric]
    return (ordered or present or [None])[0]


def id_column(columns: list[str]) -> str:
    return next((c for c in ID_COLUMNS if c in columns), columns[0])


def smiles_column(columns: list[str], candidates: tuple[str, ...] = SMILES_COLUMNS, preferred: str | None = None) -> str | None:
    """The structure column: the caller's, a known name, or the first whose name holds "smiles"; None without one."""
    if preferred in columns:
        return preferred
    known = next((c for c in candidates if c in columns), None)
    return known or next((c for c in columns if fnmatchcase(c.lower(), "*smiles*")), None)
