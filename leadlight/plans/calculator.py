"""From descriptors and pattern counts to the wide compound table, in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlight.functions import rules as R
from leadlight.functions.rules import col, finite

# Names of the pattern panels, as they appear in column names.
TOX = ("acyl_halide", "sulfonyl_halide", "acid_anhydride", "michael_acceptor", "epoxide", "aziridine", "isocyanate", "nitro_aromatic", "n_nitroso", "azide", "hydrazine", "thiourea", "quinone", "aniline", "catechol", "furan", "thiophene")
SOFT_SPOTS = ("benzylic_carbon", "allylic_carbon", "n_methyl", "n_ethyl", "aromatic_methoxy", "ester", "amide", "phenol", "carboxylic_acid")
#: pKa of each acidic and basic site.
ACIDS = {"carboxylic_acid": 4.5, "phenol": 10.0, "sulfonic_acid": -1.0}
BASES = {"primary_amine": 10.5, "secondary_amine": 10.0, "tertiary_amine_any": 9.0, "pyridine": 5.2}
# The first columns of an exported table, in order; the others follow by name.
EXPORT_ORDER = tuple(
    """
    Compound_ID SMILES Input_Canonical_SMILES Canonical_SMILES Prep_Changed Prep_SaltsStripped Prep_Uncharged
    Prep_Reionized Prep_TautomerChanged Prep_StereoStatus Prep_UnassignedChiral Prep_UnassignedStereoBonds Prep_Notes
    Ion_Mode Ion_pH Ion_State Ion_NetCharge_Est Ion_NetCharge_Round Ion_FracProtonatedBase Ion_FracDeprotonatedAcid
    Ion_LogD_pH_Est Tautomer_Mode Tautomer_Count Tautomer_Selected_SMILES Tautomer_TopK_SMILES Tautomer_Changed
    Stereo_Mode Stereo_IsomerCount Stereo_Selected_SMILES Stereo_TopK_SMILES Stereo_Changed Stereo_Notes
    Calc_Base_SMILES Protomer_Mode Protomer_pH_Min Protomer_pH_Max Protomer_Precision Protomer_MaxVariants
    Protomer_Count Protomer_Selected_SMILES Protomer_Selected_Charge Protomer_Target_Charge Protomer_TopK_SMILES
    Protomer_CalcOnProtomer Protomer_Notes Calc_Canonical_SMILES CNS_MPO CNS_MPO_Class BBB_Likely Bioavail_Score
    Veber_Pass Egan_Pass Ghose_Pass Muegge_Pass RO5_Pass RO5_Violations RO3_Pass RO3_Violations PAINS PAINS_Type BRENK
    NIH ZINC MedChem_Alerts Tox_Risk Tox_Total_Alerts Met_Stability Met_Total_Sites hERG_Risk CYP_Total_Inhibition
    Sol_ESOL_LogS Sol_ESOL_Class Perm_GI_Absorption Perm_Pgp_Likelihood PPB_Class CL_Risk T_half_Est F_Class MolWt LogP
    cLogD_7.4 TPSA HBD HBA RotBonds Rings AromaticRings FractionCSP3 SA_Score SA_Class Complexity_BertzCT
    Complexity_BalabanJ Complexity_HallKierAlpha Complexity_NumSpiroAtoms Complexity_NumBridgeheadAtoms
    Complexity_NumStereoCenters Complexity_NumUnspecifiedStereoCenters Complexity_NumHeteroAtoms
    Complexity_AromaticAtomFrac pKa_Basic pKa_Acidic QED Dev_Score Dev_Class Dev_Risk_Class Dev_Risk_Burden
    Dev_BasePoints Dev_GSK_4_400_Pass Dev_Pfizer_3_75_Pass Dev_GoldenTriangle_Pass Dev_Solubility_Risk Dev_Flags
    """.split()
)
DESCRIPTORS = ("MolWt", "LogP", "TPSA", "HBD", "HBA", "RotBonds", "Rings", "AromaticRings", "HeavyAtoms", "MR", "FractionCSP3")


def calculate(df: DataFrame, version: str = "v5", ph: float = 7.4, pic50: float | Column = 5.0, patterns: str | None = "Patterns") -> DataFrame:
    """The compound table of a descriptor table.

    Reads DESCRIPTORS, pKa_Basic, pKa_Acidic, QED, SA_Score and the catalogue flags PAINS, BRENK, NIH, ZINC as far as
    they are there, and pattern counts from the map column ``patterns``. Where there is no such column, counts that
    the table already has (Tox_Total_Alerts, Met_Total_Sites) are classed and what needs single patterns is left out.
    Other columns stay. "v4" leaves out solubility, permeability, kinetics and lead metrics.
    """
    if version not in ("v4", "v5"):
        raise ValueError(f"unknown version {version!r}")
    have = set(df.columns)
    number = lambda name: finite(col(name)) if name in have else F.lit(None).cast("double")
    d = {name: number(name) for name in DESCRIPTORS}
    mw, logp, tpsa, hbd, hba, rotb, rings, arom, heavy, mr, _ = d.values()
    out: R.Columns = {}
    if patterns in have:
        n = lambda name: F.coalesce(F.element_at(col(patterns), name), F.lit(0))
        out |= R.pka_summary(*[F.filter(F.array(*[F.when(n(k) > 0, F.lit(v)) for k, v in sites.items()]), lambda x: x.isNotNull()) for sites in (ACIDS, BASES)])
        basic, acidic = out["pKa_Basic"], out["pKa_Acidic"]
    else:
        basic, acidic = number("pKa_Basic"), number("pKa_Acidic")
        hits = lambda x: F.when(x.isNotNull(), F.array(x)).otherwise(F.array().cast("array<double>"))
        out |= R.pka_summary(hits(acidic), hits(basic))
    logd = R.log_d(logp, basic, acidic)
    out["cLogD_7.4"] = F.round(logd, 3)
    out |= R.ionization(logp, basic, acidic, ph)
    out |= R.cns_mpo(mw, logp, logd, tpsa, hbd, basic) | R.oral(mw, logp, tpsa, rotb, hba, hbd, heavy, mr, rings)
    out |= R.rule_of_5(mw, logp, hbd, hba) | R.rule_of_3(mw, logp, hbd, hba, rotb, tpsa)
    if flags := {k: col(k) for k in ("PAINS", "BRENK", "NIH", "ZINC") if k in have}:
        out |= R.medchem(flags)
    if patterns in have:
        out |= R.toxicity({k: n(k) for k in TOX})
        out |= R.metabolism({k: n(k) for k in SOFT_SPOTS}, n("phenol"), n("carboxylic_acid"), n("primary_amine"), logp)
        out |= R.herg(n("basic_n") > 0, n("tertiary_amine") > 0, n("aromatic_six") > 0, mw, logp)
        out |= R.cyp((n("imidazole") > 0) | (n("triazole") > 0), n("basic_n") > 0, n("aromatic_six") > 0, n("carboxylic_acid") > 0, (n("acetylene") > 0) | (n("furan") > 0) | (n("thiophene") > 0) | (n("methylenedioxy") > 0), logp)
    else:
        if "Tox_Total_Alerts" in have:
            out |= R.toxicity_class(col("Tox_Total_Alerts"))
        if "Met_Total_Sites" in have:
            out |= R.metabolism_class(col("Met_Total_Sites"), logp)
    if version == "v5":
        sites = out.get("Met_Total_Sites", F.lit(0))
        potency = pic50 if isinstance(pic50, Column) else F.lit(float(pic50))
        out |= R.solubility(mw, logp, rotb, arom) | R.permeability(mw, logp, tpsa, hbd, hba)
        out |= R.pharmacokinetics(mw, logp, tpsa, sites) | R.lead(potency, heavy, logp, mw, tpsa)
    if "SA_Score" in have:
        out |= R.synthetic_class(number("SA_Score"))
    rounded = {k: F.round(d[k], 3) for k in ("MolWt", "LogP", "TPSA", "FractionCSP3") if k in have}
    wide = df.withColumns(out | rounded)
    # the last rules read finished columns, as they are written
    return wide.withColumns(R.developability({c: col(c) for c in wide.columns}))


def export_order(columns: list[str]) -> list[str]:
    """Columns in export order: the known ones first, then the rest by name."""
    known = [c for c in EXPORT_ORDER if c in columns]
    return known + sorted(c for c in columns if c not in known)


def fill_missing(df: DataFrame, value: float) -> DataFrame:
    """Missing cells filled: numbers (NaN and infinities, too) with the value, text with its text, flags left null."""
    cells = {}
    for name, kind in df.dtypes:
        c = col(name)
        if kind in ("double", "float"):
            cells[name] = F.coalesce(finite(c), F.lit(float(value))).cast(kind)
        elif kind in ("int", "bigint", "smallint", "tinyint"):
            cells[name] = F.coalesce(c, F.lit(int(value)).cast(kind))
        elif kind == "string":
            cells[name] = F.coalesce(c, F.lit(f"{value:g}"))
    return df.withColumns(cells)
