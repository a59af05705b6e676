"""Property rules as column expressions: drug-likeness, absorption, safety, solubility, kinetics, developability.

Each function takes columns and returns ``{output name: Column}``; nothing here needs a Python UDF, so a whole
calculator is one projection inside code generation. Inputs may be null: a comparison with null counts as not met
where the definition is a flag, and a numeric result is null.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

Columns = dict[str, Column]


def col(name: str) -> Column:
    """A column by its whole name, dots and signs included."""
    return F.col(f"`{name}`")


def yes(condition: Column) -> Column:
    """A condition that is false, not null, where it can't be decided."""
    return F.coalesce(condition, F.lit(False))


def count_true(*conditions: Column) -> Column:
    return reduce(add, [yes(c).cast("int") for c in conditions])


def ladder(*steps: tuple[Column, object], otherwise: object) -> Column:
    """The value of the first step whose condition holds."""
    out = None
    for condition, value in steps:
        out = F.when(condition, F.lit(value)) if out is None else out.when(condition, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def finite(x: Column) -> Column:
    """A number as double; null where it can't be read or is not finite."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def desirability(x: Column, low: float, high: float) -> Column:
    """1 up to ``low``, 0 from ``high`` on, a line between."""
    return F.when(x <= low, F.lit(1.0)).when(x >= high, F.lit(0.0)).otherwise(1.0 - (x - low) / (high - low))


def pka_summary(acid_hits: Column, base_hits: Column) -> Columns:
    """From arrays of matched pKa values: the weakest-bound proton of each kind and the type."""
    acidic, basic = F.array_min(acid_hits), F.array_max(base_hits)
    kind = ladder((acidic.isNotNull() & basic.isNotNull(), "zwitterion"), (basic.isNotNull(), "basic"), (acidic.isNotNull(), "acidic"), otherwise="neutral")
    return {"pKa_Basic": basic, "pKa_Acidic": acidic, "pKa_Type": kind}


def log_d(logp: Column, basic: Column, acidic: Column, ph: float = 7.4) -> Column:
    """LogD at a pH from one basic and one acidic pKa; the base goes first."""
    shift = lambda d: logp - F.log10(1 + F.pow(F.lit(10.0), d))
    return F.when(basic > ph, shift(basic - ph)).when(acidic < ph, shift(F.lit(ph) - acidic)).otherwise(logp)


def cns_mpo(mw: Column, logp: Column, logd: Column, tpsa: Column, hbd: Column, basic: Column) -> Columns:
    """Six desirabilities and their sum. A missing basic pKa counts as 7."""
    parts = {
        "MPO_MW": desirability(mw, 360, 500),
        "MPO_LogP": desirability(logp, 3, 5),
        "MPO_LogD": desirability(logd, 2, 4),
        "MPO_TPSA": desirability(tpsa, 40, 90),
        "MPO_HBD": desirability(hbd, 0.5, 3.5),
        "MPO_pKa": desirability(F.coalesce(basic, F.lit(7.0)), 8, 10),
    }
    total = reduce(add, parts.values())
    return {
        "CNS_MPO": F.round(total, 2),
        "CNS_MPO_Class": F.when(total.isNotNull(), ladder((total >= 5, "Excellent"), (total >= 4, "Good"), (total >= 3, "Moderate"), otherwise="Poor")),
        "BBB_Likely": yes((total >= 4) & (tpsa < 90) & (mw < 450) & (hbd <= 3)),
    } | {k: F.round(v, 3) for k, v in parts.items()}


def rule_of_5(mw: Column, logp: Column, hbd: Column, hba: Column) -> Columns:
    over = [mw > 500, logp > 5, hbd > 5, hba > 10]
    n = count_true(*over)
    met = [mw <= 500, logp <= 5, hbd <= 5, hba <= 10]
    return dict(zip(("RO5_MW", "RO5_LogP", "RO5_HBD", "RO5_HBA"), map(yes, met), strict=True)) | {"RO5_Violations": n, "RO5_Pass": n <= 1}


def rule_of_3(mw: Column, logp: Column, hbd: Column, hba: Column, rotb: Column, tpsa: Column) -> Columns:
    """The surface is reported but is no violation."""
    limits = {"RO3_MW": (mw, 300), "RO3_LogP": (logp, 3), "RO3_HBD": (hbd, 3), "RO3_HBA": (hba, 3), "RO3_RotBonds": (rotb, 3)}
    n = count_true(*[x > most for x, most in limits.values()])
    return {k: yes(x <= most) for k, (x, most) in limits.items()} | {"RO3_TPSA": yes(tpsa <= 60), "RO3_Violations": n, "RO3_Pass": n == 0}


def oral(mw: Column, logp: Column, tpsa: Column, rotb: Column, hba: Column, hbd: Column, heavy: Column, mr: Column, rings: Column) -> Columns:
    out = {
        "Veber_Pass": yes((tpsa <= 140) & (rotb <= 10)),
        "Egan_Pass": yes((tpsa <= 132) & (logp <= 5.88)),
        "Ghose_Pass": yes(mw.between(160, 480) & logp.between(-0.4, 5.6) & mr.between(40, 130) & heavy.between(20, 130)),
        "Muegge_Pass": yes(mw.between(200, 600) & logp.between(-2, 5) & (tpsa <= 150) & (rings <= 7) & (hba <= 10) & (hbd <= 5) & (rotb <= 15)),
    }
    return out | {"Bioavail_Score": count_true(*out.values())}


def toxicity(alerts: dict[str, Column]) -> Columns:
    """From a count for each alert: how many kinds of alert are hit, and the risk."""
    return {f"Tox_{k}": v for k, v in alerts.items()} | toxicity_class(count_true(*[v > 0 for v in alerts.values()]))


def toxicity_class(kinds: Column) -> Columns:
    return {"Tox_Total_Alerts": kinds, "Tox_Risk": ladder((kinds >= 3, "High"), (kinds >= 1, "Medium"), otherwise="Low")}


def metabolism(spots: dict[str, Column], phenol: Column, acid: Column, amine: Column, logp: Column) -> Columns:
    """From a count for each soft spot: their sum, conjugation flags, stability."""
    sites = reduce(add, [F.coalesce(v, F.lit(0)) for v in spots.values()])
    return {f"Met_{k}": v for k, v in spots.items()} | {
        "Met_Glucuronidation": yes((phenol > 0) | (acid > 0)),
        "Met_Sulfation": yes(phenol > 0),
        "Met_Acetylation": yes(amine > 0),
        "Met_Methylation": yes(phenol > 0),
    } | metabolism_class(sites, logp)


def metabolism_class(sites: Column, logp: Column) -> Columns:
    return {"Met_Total_Sites": sites, "Met_Stability": ladder(((sites > 5) & (logp > 3), "Low"), ((sites > 3) | (logp > 4), "Medium"), otherwise="High")}


def herg(basic_n: Column, tertiary: Column, aromatic: Column, mw: Column, logp: Column) -> Columns:
    return {
        "hERG_basic_nitrogen": yes(basic_n),
        "hERG_tertiary_amine": yes(tertiary),
        "hERG_aromatic_ring": yes(aromatic),
        "hERG_Alerts": count_true(basic_n, tertiary, aromatic),
        "hERG_Risk": ladder((basic_n & aromatic & (logp > 3.5) & (mw > 350), "High"), (basic_n & (logp > 3), "Medium"), otherwise="Low"),
    }


def cyp(azole: Column, basic_n: Column, aromatic: Column, acid: Column, reactive: Column, logp: Column) -> Columns:
    """azole: imidazole or triazole; reactive: acetylene, furan, thiophene or methylenedioxy."""
    flags = {
        "CYP3A4_Inhibitor": yes(azole),
        "CYP2D6_Inhibitor": yes(basic_n & aromatic & (logp > 2)),
        "CYP2C9_Inhibitor": yes(acid),
        "CYP_MBI_Risk": yes(reactive),
    }
    return flags | {"CYP_Total_Inhibition": count_true(*flags.values())}


def medchem(flags: dict[str, Column]) -> Columns:
    """Alert catalogues: each flag (null where it was not decided) and how many are true."""
    return flags | {"MedChem_Alerts": count_true(*flags.values())}


def solubility(mw: Column, logp: Column, rotb: Column, aromatic_rings: Column) -> Columns:
    """ESOL: log of the molar solubility, milligrams a litre, class."""
    s = 0.16 - 0.63 * logp - 0.0062 * mw + 0.066 * rotb - 0.74 * aromatic_rings
    steps = ((s >= 0, "Highly Soluble"), (s >= -2, "Soluble"), (s >= -4, "Moderately Soluble"), (s >= -6, "Poorly Soluble"))
    return {
        "Sol_ESOL_LogS": F.round(s, 3),
        "Sol_ESOL_mg_L": F.round(F.pow(F.lit(10.0), s) * mw * 1000, 2),
        "Sol_ESOL_Class": F.when(s.isNotNull(), ladder(*steps, otherwise="Insoluble")),
    }


def permeability(mw: Column, logp: Column, tpsa: Column, hbd: Column, hba: Column) -> Columns:
    caco2 = -5.47 + 0.58 * logp - 0.01 * tpsa - 0.1 * hbd
    pampa = -4.8 + 0.45 * logp - 0.008 * tpsa
    pumped = count_true(mw > 400, hbd > 1, logp > 2, hba > 4)
    two = lambda condition: ladder((condition, "High"), otherwise="Low")
    return {
        "Perm_Caco2_LogPapp": F.round(caco2, 3),
        "Perm_Caco2_Class": two(caco2 > -5.15),
        "Perm_PAMPA_LogPe": F.round(pampa, 3),
        "Perm_PAMPA_Class": two(pampa > -5.0),
        "Perm_GI_Absorption": two((tpsa <= 140) & (logp <= 5.5)),
        "Perm_Pgp_Likelihood": ladder((pumped >= 3, "High"), (pumped == 2, "Medium"), otherwise="Low"),
        "Perm_Skin_LogKp": F.round(-2.7 + 0.71 * logp - 0.0061 * mw, 3),
    }


def pharmacokinetics(mw: Column, logp: Column, tpsa: Column, sites: Column) -> Columns:
    bound = F.least(F.greatest(85 + 3 * logp, F.lit(0.0)), F.lit(99.9))
    volume = 0.5 + 0.2 * F.greatest(F.lit(0.0), logp)
    graded = lambda *steps: ladder(*[(c, n) for c, n in steps], otherwise=0)
    clearance = graded((logp > 3, 2), (logp > 2, 1)) + graded((sites > 5, 2), (sites > 3, 1)) + graded((mw > 500, 1))
    risk = ladder((clearance >= 4, "High"), (clearance >= 2, "Medium"), otherwise="Low")
    points = count_true(mw <= 500, tpsa <= 140, logp <= 5, tpsa <= 90)
    return {
        "PPB_Est_%": F.round(bound, 1),
        "PPB_FreeEst_%": F.round(100 - bound, 1),
        "PPB_Class": ladder((bound >= 95, "High"), (bound >= 80, "Medium"), otherwise="Low"),
        "Vd_Est_L_kg": F.round(volume, 2),
        "Vd_Class": ladder((volume < 0.7, "Low (plasma confined)"), (volume < 2, "Medium"), otherwise="High (tissue distributed)"),
        "CL_SoftSpots": sites,
        "CL_Risk": risk,
        "T_half_Est": ladder((clearance >= 4, "Short (<4h)"), (clearance >= 2, "Medium (4-12h)"), otherwise="Long (>12h)"),
        "F_Score": points,
        "F_Est_%": ladder((points == 4, ">70"), (points == 3, "50-70"), (points == 2, "30-50"), otherwise="<30"),
        "F_Class": ladder((points == 4, "High"), (points == 3, "Moderate"), (points == 2, "Low-Moderate"), otherwise="Low"),
    }


def lead(pic50: Column, heavy: Column, logp: Column, mw: Column, tpsa: Column) -> Columns:
    le = pic50 / F.greatest(heavy, F.lit(1.0))
    lle = pic50 - logp
    lelp = F.when(le > 0, F.try_divide(logp, le))
    return {
        "Lead_LE": F.round(le, 3),
        "Lead_LE_Quality": ladder((le >= 0.3, "Good"), otherwise="Poor"),
        "Lead_LLE": F.round(lle, 3),
        "Lead_LLE_Quality": ladder((lle >= 7, "Excellent"), (lle >= 5, "Good"), otherwise="Poor"),
        "Lead_LELP": F.round(lelp, 3),
        "Lead_LELP_Quality": ladder((lelp < 10, "Good"), otherwise="Poor"),
        "Lead_BEI": F.round(F.when(mw > 0, F.try_divide(pic50, mw / 1000)), 3),
        "Lead_SEI": F.round(F.when(tpsa > 0, F.try_divide(pic50, tpsa / 100)), 3),
    }


def ionization(logp: Column, basic: Column, acidic: Column, ph: float = 7.4) -> Columns:
    """Charge state by one base and one acid. Fractions are null where the site is absent."""
    ten = lambda x: F.pow(F.lit(10.0), x)
    plus, minus = 1.0 / (1.0 + ten(F.lit(ph) - basic)), 1.0 / (1.0 + ten(acidic - F.lit(ph)))
    charge = F.coalesce(plus, F.lit(0.0)) - F.coalesce(minus, F.lit(0.0))
    return {
        "Ion_pH": F.lit(float(ph)),
        "Ion_State": ladder(((plus > 0.5) & (minus > 0.5), "zwitterionic"), (charge > 0.5, "cationic"), (charge < -0.5, "anionic"), otherwise="neutral"),
        "Ion_NetCharge_Est": F.round(charge, 3),
        "Ion_LogD_pH_Est": F.round(log_d(logp, basic, acidic, ph), 3),
        "Ion_FracProtonatedBase": F.round(plus, 3),
        "Ion_FracDeprotonatedAcid": F.round(minus, 3),
        "Ion_NetCharge_Round": F.bround(charge, 0).cast("int"),
    }


def synthetic_class(score: Column) -> Columns:
    return {"SA_Class": F.when(score.isNotNull(), ladder((score <= 3, "Easy"), (score <= 6, "Moderate"), otherwise="Hard"))}


def developability(p: Columns) -> Columns:
    """From finished output columns (rounded as they stand); a missing one counts as null.

    Takes MolWt, LogP, TPSA, cLogD_7.4, QED, SA_Score, Sol_ESOL_LogS, Tox_Risk, hERG_Risk, CL_Risk,
    CYP_Total_Inhibition, RO5_Violations, MedChem_Alerts, Bioavail_Score.
    """
    x = lambda name: p.get(name, F.lit(None))
    number = lambda name: finite(x(name))
    mw, logp, tpsa, logd, s = (number(n) for n in ("MolWt", "LogP", "TPSA", "cLogD_7.4", "Sol_ESOL_LogS"))
    gsk, pfizer, golden = yes((mw <= 400) & (logp <= 4)), yes((tpsa <= 75) & (logp <= 3)), yes(mw.between(200, 500) & logd.between(1, 3))
    sol = F.when(s <= -5, F.lit("High")).when(s <= -3, F.lit("Medium")).when(s.isNotNull(), F.lit("Low"))
    word = lambda c: F.lower(F.trim(c.cast("string")))
    by_class = lambda c: ladder((word(c) == "high", 2), (word(c) == "medium", 1), otherwise=0)
    cyp_n, ro5_n, alerts = number("CYP_Total_Inhibition"), number("RO5_Violations"), number("MedChem_Alerts")
    counted = lambda n, two, one: ladder((n >= two, 2), (n == one, 1), otherwise=0)
    burden = reduce(add, [*map(by_class, (x("Tox_Risk"), x("hERG_Risk"), sol, x("CL_Risk"))), counted(cyp_n, 3, 2), counted(ro5_n, 2, 1), counted(alerts, 2, 1)])
    base = count_true(gsk, pfizer, golden, number("QED") >= 0.5, number("SA_Score") <= 3.0, number("Bioavail_Score") >= 3)
    score = F.greatest(F.lit(0), base - burden)
    risk = ladder((burden >= 6, "High"), (burden >= 3, "Medium"), otherwise="Low")
    named = lambda condition, name: F.when(condition, F.lit(name))
    flags = F.concat_ws(
        ",",
        named(word(x("Tox_Risk")) == "high", "tox_high"),
        named(word(x("hERG_Risk")) == "high", "herg_high"),
        named(sol == "High", "solubility_high_risk"),
        named(word(x("CL_Risk")) == "high", "clearance_high_risk"),
        named(cyp_n >= 3, "cyp_burden_high"),
        named(cyp_n == 2, "cyp_burden_medium"),
        named(ro5_n >= 2, "ro5_2plus"),
        named(alerts >= 2, "medchem_alerts_2plus"),
    )
    return {
        "Dev_GSK_4_400_Pass": gsk,
        "Dev_Pfizer_3_75_Pass": pfizer,
        "Dev_GoldenTriangle_Pass": golden,
        "Dev_Solubility_Risk": sol,
        "Dev_BasePoints": base,
        "Dev_Risk_Burden": burden,
        "Dev_Risk_Class": risk,
        "Dev_Score": score,
        "Dev_Class": ladder(((score >= 4) & (burden < 3), "High"), ((score >= 2) & (burden < 6), "Medium"), otherwise="Low"),
        "Dev_Flags": flags,
    }
