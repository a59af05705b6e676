"""Compound tables made from the driver's tables, and the same in DuckDB SQL.

The values are plain arithmetic without chemical meaning; they exercise every rule and operator. Pattern counts,
descriptors and flags derive from ``part``; fingerprints from the signs of ``embeddings``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlight.functions.similarity import pack
from leadlight.plans.calculator import SOFT_SPOTS, TOX

PATTERNS = tuple(dict.fromkeys([*TOX, *SOFT_SPOTS, "sulfonic_acid", "primary_amine", "secondary_amine", "tertiary_amine_any", "pyridine", "basic_n", "tertiary_amine", "aromatic_six", "imidazole", "triazole", "acetylene", "methylenedioxy"]))
N_BITS = 62
#: Tasks for each core over the rows of ``part``.
TASKS = 4

#: Column: (Spark expression, DuckDB expression), where one text serves both unless they differ.
DESCRIPTORS = {
    "Compound_ID": ("concat('CMPD_', lpad(cast(p_partkey as string), 9, '0'))", "concat('CMPD_', lpad(cast(p_partkey as varchar), 9, '0'))"),
    "row": "p_partkey",
    "SMILES": "p_name",
    "Scaffold_SMILES": "case when p_partkey % 9 = 0 then '' else p_brand end",
    "Series": "p_type",
    "MolWt": "cast('120.0173' as double) + cast(p_partkey * 7919 % 4800 as double) / 10",
    "LogP": "cast('-2.00317' as double) + cast(p_partkey * 104729 % 850 as double) / 100",
    "TPSA": "cast('0.02771' as double) + cast(p_partkey * 1299709 % 1700 as double) / 10",
    "HBD": "cast(p_partkey * 31 % 8 as int)",
    "HBA": "cast(p_partkey * 17 % 14 as int)",
    "RotBonds": "cast(p_size % 16 as int)",
    "Rings": "cast(p_partkey * 13 % 7 as int)",
    "AromaticRings": ("cast((p_partkey * 13 % 7) div 2 as int)", "cast((p_partkey * 13 % 7) // 2 as int)"),
    "HeavyAtoms": "cast(8 + p_size as int)",
    "MR": "cast(30 as double) + cast(p_partkey * 53 % 1200 as double) / 10",
    "QED": "case when p_partkey % 11 = 0 then null else cast(p_partkey * 97 % 1000 as double) / 1000 end",
    "SA_Score": "cast(1 as double) + cast(p_partkey * 61 % 900 as double) / 100",
    "PAINS": "case when p_partkey % 29 = 0 then null else p_partkey % 13 = 0 end",
    "BRENK": "p_partkey % 5 = 0",
    "NIH": "p_partkey % 7 = 0",
    "ZINC": "p_partkey % 3 = 0",
}


def _count(i: int) -> str:
    """The count of the i-th pattern."""
    return f"cast(greatest(0, (p_partkey * {2 * i + 3}) % 7 - 4) as int)"


def compounds(spark: SparkSession, sf_dir: str, patterns: bool = True, deal: bool = False) -> DataFrame:
    """The descriptor table over ``part``; every cell is one expression of its row.

    With ``deal`` rows are dealt out first: a row becomes some hundred cells, and a file of many rows may be small enough to be read in one task.
    """
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    part = part.repartition(TASKS * spark.sparkContext.defaultParallelism) if deal else part
    cells = [F.expr(e if isinstance(e, str) else e[0]).alias(name) for name, e in DESCRIPTORS.items()]
    if patterns:
        cells.append(F.create_map(*[x for i, p in enumerate(PATTERNS) for x in (F.lit(p), F.expr(_count(i)))]).alias("Patterns"))
    return part.select(*cells)


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library (row, Compound_ID, SMILES, fp) from the signs of the first N_BITS components."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    ident = F.concat(F.lit("VEC_"), F.col("vec_id").cast("string"))
    return vectors.select(F.col("vec_id").alias("row"), ident.alias("Compound_ID"), F.concat(F.lit("S"), (F.col("vec_id") % 97).cast("string")).alias("SMILES"), pack([F.element_at("embedding", i + 1) > 0 for i in range(N_BITS)]).alias("fp"), "label")


# ---- the same in DuckDB ---------------------------------------------------------------------------

_cells = ",\n  ".join(f'{e if isinstance(e, str) else e[1]} as "{name}"' for name, e in DESCRIPTORS.items())
_counts = ",\n  ".join(f'{_count(i)} as "n_{p}"' for i, p in enumerate(PATTERNS))
_tox = " + ".join(f"cast(n_{k} > 0 as int)" for k in TOX)
_sites = " + ".join(f"n_{k}" for k in SOFT_SPOTS)
_desire = lambda x, lo, hi: f"case when {x} <= {lo} then 1.0::double when {x} >= {hi} then 0.0::double else 1.0 - ({x} - {lo}::double) / ({hi}::double - {lo}::double) end"

#: Common table expressions d (descriptors) and w (the wide table).
WIDE_SQL = f"""
d as (select
  {_cells},
  {_counts}
  from part),
p as (select *,
  greatest(case when n_primary_amine > 0 then 10.5::double end, case when n_secondary_amine > 0 then 10.0::double end, case when n_tertiary_amine_any > 0 then 9.0::double end, case when n_pyridine > 0 then 5.2::double end) as "pKa_Basic",
  least(case when n_carboxylic_acid > 0 then 4.5::double end, case when n_phenol > 0 then 10.0::double end, case when n_sulfonic_acid > 0 then -1.0::double end) as "pKa_Acidic"
  from d),
l as (select *,
  case when pKa_Basic > 7.4 then LogP - log10(1 + pow(10.0::double, pKa_Basic - 7.4::double)) when pKa_Acidic < 7.4 then LogP - log10(1 + pow(10.0::double, 7.4::double - pKa_Acidic)) else LogP end as logd,
  1.0::double / (1.0::double + pow(10.0::double, 7.4::double - pKa_Basic)) as fplus,
  1.0::double / (1.0::double + pow(10.0::double, pKa_Acidic - 7.4::double)) as fminus,
  coalesce(fplus, 0) - coalesce(fminus, 0) as charge,
  cast(MolWt > 500 as int) + cast(LogP > 5 as int) + cast(HBD > 5 as int) + cast(HBA > 10 as int) as "RO5_Violations",
  cast(MolWt > 300 as int) + cast(LogP > 3 as int) + cast(HBD > 3 as int) + cast(HBA > 3 as int) + cast(RotBonds > 3 as int) as "RO3_Violations",
  0.16::double - 0.63::double * LogP - 0.0062::double * MolWt + 0.066::double * RotBonds - 0.74::double * AromaticRings as logs,
  {_tox} as "Tox_Total_Alerts",
  {_sites} as "Met_Total_Sites",
  n_basic_n > 0 as bn, n_tertiary_amine > 0 as tn, n_aromatic_six > 0 as ar,
  coalesce(cast(PAINS as int), 0) + cast(BRENK as int) + cast(NIH as int) + cast(ZINC as int) as "MedChem_Alerts"
  from p),
w0 as (select *,
  {_desire('MolWt', 360, 500)} as mpo_a, {_desire('LogP', 3, 5)} as mpo_b, {_desire('logd', 2, 4)} as mpo_c,
  {_desire('TPSA', 40, 90)} as mpo_d, {_desire('HBD', 0.5, 3.5)} as mpo_e, {_desire('coalesce(pKa_Basic, 7.0::double)', 8, 10)} as mpo_f,
  mpo_a + mpo_b + mpo_c + mpo_d + mpo_e + mpo_f as total,
  TPSA <= 140 and RotBonds <= 10 as "Veber_Pass", TPSA <= 132 and LogP <= 5.88::double as "Egan_Pass",
  MolWt between 160 and 480 and LogP between -0.4::double and 5.6::double and MR between 40 and 130 and HeavyAtoms between 20 and 130 as "Ghose_Pass",
  MolWt between 200 and 600 and LogP between -2 and 5 and TPSA <= 150 and Rings <= 7 and HBA <= 10 and HBD <= 5 and RotBonds <= 15 as "Muegge_Pass",
  n_imidazole > 0 or n_triazole > 0 as "CYP3A4_Inhibitor", bn and ar and LogP > 2 as "CYP2D6_Inhibitor", n_carboxylic_acid > 0 as "CYP2C9_Inhibitor",
  n_acetylene > 0 or n_furan > 0 or n_thiophene > 0 or n_methylenedioxy > 0 as "CYP_MBI_Risk",
  least(greatest(85 + 3 * LogP, 0.0::double), 99.9::double) as bound, 0.5::double + 0.2::double * greatest(0.0::double, LogP) as vd,
  case when LogP > 3 then 2 when LogP > 2 then 1 else 0 end + case when Met_Total_Sites > 5 then 2 when Met_Total_Sites > 3 then 1 else 0 end + cast(MolWt > 500 as int) as clear,
  cast(MolWt <= 500 as int) + cast(TPSA <= 140 as int) + cast(LogP <= 5 as int) + cast(TPSA <= 90 as int) as "F_Score",
  cast(MolWt > 400 as int) + cast(HBD > 1 as int) + cast(LogP > 2 as int) + cast(HBA > 4 as int) as pumped,
  -5.47::double + 0.58::double * LogP - 0.01::double * TPSA - 0.1::double * HBD as caco2, -4.8::double + 0.45::double * LogP - 0.008::double * TPSA as pampa,
  5.0::double / greatest(HeavyAtoms, 1) as le, 5.0::double - LogP as lle, case when le > 0 then LogP / le end as lelp
  from l),
w1 as (select *,
  round(total, 2) as "CNS_MPO", case when total >= 5 then 'Excellent' when total >= 4 then 'Good' when total >= 3 then 'Moderate' else 'Poor' end as "CNS_MPO_Class",
  total >= 4 and TPSA < 90 and MolWt < 450 and HBD <= 3 as "BBB_Likely",
  round(mpo_a, 3) as "MPO_MW", round(mpo_b, 3) as "MPO_LogP", round(mpo_c, 3) as "MPO_LogD", round(mpo_d, 3) as "MPO_TPSA", round(mpo_e, 3) as "MPO_HBD", round(mpo_f, 3) as "MPO_pKa",
  round(logd, 3) as "cLogD_7.4",
  case when pKa_Basic is not null and pKa_Acidic is not null then 'zwitterion' when pKa_Basic is not null then 'basic' when pKa_Acidic is not null then 'acidic' else 'neutral' end as "pKa_Type",
  case when fplus > 0.5 and fminus > 0.5 then 'zwitterionic' when charge > 0.5 then 'cationic' when charge < -0.5 then 'anionic' else 'neutral' end as "Ion_State",
  round(charge, 3) as "Ion_NetCharge_Est", round(fplus, 3) as "Ion_FracProtonatedBase", round(fminus, 3) as "Ion_FracDeprotonatedAcid", cast(round_even(charge, 0) as int) as "Ion_NetCharge_Round",
  RO5_Violations <= 1 as "RO5_Pass", RO3_Violations = 0 as "RO3_Pass",
  cast(Veber_Pass as int) + cast(Egan_Pass as int) + cast(Ghose_Pass as int) + cast(Muegge_Pass as int) as "Bioavail_Score",
  case when Tox_Total_Alerts >= 3 then 'High' when Tox_Total_Alerts >= 1 then 'Medium' else 'Low' end as "Tox_Risk",
  case when Met_Total_Sites > 5 and LogP > 3 then 'Low' when Met_Total_Sites > 3 or LogP > 4 then 'Medium' else 'High' end as "Met_Stability",
  cast(bn as int) + cast(tn as int) + cast(ar as int) as "hERG_Alerts",
  case when bn and ar and LogP > 3.5 and MolWt > 350 then 'High' when bn and LogP > 3 then 'Medium' else 'Low' end as "hERG_Risk",
  cast(CYP3A4_Inhibitor as int) + cast(CYP2D6_Inhibitor as int) + cast(CYP2C9_Inhibitor as int) + cast(CYP_MBI_Risk as int) as "CYP_Total_Inhibition",
  round(logs, 3) as "Sol_ESOL_LogS", round(pow(10.0::double, logs) * MolWt * 1000, 2) as "Sol_ESOL_mg_L",
  case when logs >= 0 then 'Highly Soluble' when logs >= -2 then 'Soluble' when logs >= -4 then 'Moderately Soluble' when logs >= -6 then 'Poorly Soluble' else 'Insoluble' end as "Sol_ESOL_Class",
  round(caco2, 3) as "Perm_Caco2_LogPapp", case when caco2 > -5.15 then 'High' else 'Low' end as "Perm_Caco2_Class",
  round(pampa, 3) as "Perm_PAMPA_LogPe", case when pampa > -5.0 then 'High' else 'Low' end as "Perm_PAMPA_Class",
  case when TPSA <= 140 and LogP <= 5.5 then 'High' else 'Low' end as "Perm_GI_Absorption", round(-2.7::double + 0.71::double * LogP - 0.0061::double * MolWt, 3) + 0.0::double as "Perm_Skin_LogKp",
  case when pumped >= 3 then 'High' when pumped = 2 then 'Medium' else 'Low' end as "Perm_Pgp_Likelihood",
  round(bound, 1) as "PPB_Est_%", case when bound >= 95 then 'High' when bound >= 80 then 'Medium' else 'Low' end as "PPB_Class",
  round(vd, 2) as "Vd_Est_L_kg", case when vd < 0.7 then 'Low (plasma confined)' when vd < 2 then 'Medium' else 'High (tissue distributed)' end as "Vd_Class",
  case when clear >= 4 then 'High' when clear >= 2 then 'Medium' else 'Low' end as "CL_Risk",
  case when clear >= 4 then 'Short (<4h)' when clear >= 2 then 'Medium (4-12h)' else 'Long (>12h)' end as "T_half_Est",
  case when F_Score = 4 then 'High' when F_Score = 3 then 'Moderate' when F_Score = 2 then 'Low-Moderate' else 'Low' end as "F_Class",
  round(le, 3) as "Lead_LE", case when le >= 0.3 then 'Good' else 'Poor' end as "Lead_LE_Quality",
  round(lle, 3) as "Lead_LLE", case when lle >= 7 then 'Excellent' when lle >= 5 then 'Good' else 'Poor' end as "Lead_LLE_Quality",
  round(lelp, 3) as "Lead_LELP", case when lelp < 10 then 'Good' else 'Poor' end as "Lead_LELP_Quality",
  round(case when MolWt > 0 then 5.0::double / (MolWt / 1000) end, 3) as "Lead_BEI", round(case when TPSA > 0 then 5.0::double / (TPSA / 100) end, 3) as "Lead_SEI",
  case when SA_Score <= 3 then 'Easy' when SA_Score <= 6 then 'Moderate' else 'Hard' end as "SA_Class"
  from w0),
w2 as (select *,
  MolWt <= 400 and LogP <= 4 as "Dev_GSK_4_400_Pass", TPSA <= 75 and LogP <= 3 as "Dev_Pfizer_3_75_Pass",
  MolWt between 200 and 500 and "cLogD_7.4" between 1 and 3 as "Dev_GoldenTriangle_Pass",
  case when Sol_ESOL_LogS <= -5 then 'High' when Sol_ESOL_LogS <= -3 then 'Medium' else 'Low' end as "Dev_Solubility_Risk",
  case Tox_Risk when 'High' then 2 when 'Medium' then 1 else 0 end + case hERG_Risk when 'High' then 2 when 'Medium' then 1 else 0 end
    + case Dev_Solubility_Risk when 'High' then 2 when 'Medium' then 1 else 0 end + case CL_Risk when 'High' then 2 when 'Medium' then 1 else 0 end
    + case when CYP_Total_Inhibition >= 3 then 2 when CYP_Total_Inhibition = 2 then 1 else 0 end
    + case when RO5_Violations >= 2 then 2 when RO5_Violations = 1 then 1 else 0 end + case when MedChem_Alerts >= 2 then 2 when MedChem_Alerts = 1 then 1 else 0 end as "Dev_Risk_Burden",
  cast(Dev_GSK_4_400_Pass as int) + cast(Dev_Pfizer_3_75_Pass as int) + cast(Dev_GoldenTriangle_Pass as int) + coalesce(cast(QED >= 0.5 as int), 0) + cast(SA_Score <= 3.0 as int) + cast(Bioavail_Score >= 3 as int) as "Dev_BasePoints",
  greatest(0, Dev_BasePoints - Dev_Risk_Burden) as "Dev_Score",
  case when Dev_Risk_Burden >= 6 then 'High' when Dev_Risk_Burden >= 3 then 'Medium' else 'Low' end as "Dev_Risk_Class",
  case when Dev_Score >= 4 and Dev_Risk_Burden < 3 then 'High' when Dev_Score >= 2 and Dev_Risk_Burden < 6 then 'Medium' else 'Low' end as "Dev_Class",
  concat_ws(',', case when Tox_Risk = 'High' then 'tox_high' end, case when hERG_Risk = 'High' then 'herg_high' end, case when Dev_Solubility_Risk = 'High' then 'solubility_high_risk' end,
    case when CL_Risk = 'High' then 'clearance_high_risk' end, case when CYP_Total_Inhibition >= 3 then 'cyp_burden_high' end, case when CYP_Total_Inhibition = 2 then 'cyp_burden_medium' end,
    case when RO5_Violations >= 2 then 'ro5_2plus' end, case when MedChem_Alerts >= 2 then 'medchem_alerts_2plus' end) as "Dev_Flags"
  from w1),
w as (select * replace (round(MolWt, 3) as "MolWt", round(LogP, 3) as "LogP", round(TPSA, 3) as "TPSA") from w2)
"""

_bits = " | ".join(f"(case when embedding[{i + 1}] > 0 then {1 << i}::bigint else 0::bigint end)" for i in range(N_BITS))
#: Common table expression fp (row, Compound_ID, SMILES, f, label).
FP_SQL = f"""
fp as (select vec_id as "row", concat('VEC_', cast(vec_id as varchar)) as "Compound_ID", concat('S', cast(vec_id % 97 as varchar)) as "SMILES", {_bits} as f, label from embeddings)
"""
