"""The registered queries of the compound operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlight.functions.rules import col
from leadlight.functions import texts as T
from leadlight.functions.similarity import METRICS, count_similarity, on_bits, similarity, words
from leadlight.kernel.stage import complexity as structure_complexity
from leadlight.kernel.stage import features as structure_features
from leadlight.kernel.stage import DESCRIBED, STEREO, graphs, outcome, prepared_structures, structures
from leadlight.operators import analyze as A
from leadlight.operators import cluster as C
from leadlight.operators import export as E
from leadlight.operators import features as X
from leadlight.operators import picklists as P
from leadlight.operators import search as S
from leadlight.operators import validate as V
from leadlight.operators.synthetic import sa_scores
from leadlight.sources.smiles import parse_lines
from leadlight.sources.tables import flatten_routes, retro_targets
from leadlight.plans.adapters import FP_SQL, N_BITS, TASKS, WIDE_SQL, compounds, fingerprints
from leadlight.plans.calculator import TOX, calculate, fill_missing
from leadlight.plans.registry import QUERIES, SQL, Query, register  # noqa: F401
from leadlight.plans.reports import cluster_sizes, compare_columns, ragged_union
from leadlight.sources.storage import stored

def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calculate(compounds(spark, sf_dir, deal=True))


def over_wide(sql: str) -> str:
    return f"with {WIDE_SQL} {sql}"


def over_fp(sql: str) -> str:
    return f"with {FP_SQL} {sql}"


def quoted(names: tuple[str, ...]) -> str:
    return ", ".join(f'"{n}"' for n in names)


# ---- rules ----------------------------------------------------------------------------------------

RULES: dict[str, tuple[str, ...]] = {
    "rules_cns_mpo": ("CNS_MPO", "CNS_MPO_Class", "BBB_Likely", "MPO_MW", "MPO_LogP", "MPO_LogD", "MPO_TPSA", "MPO_HBD", "MPO_pKa", "cLogD_7.4"),
    "rules_pka_ionization": ("pKa_Basic", "pKa_Acidic", "pKa_Type", "Ion_State", "Ion_NetCharge_Est", "Ion_FracProtonatedBase", "Ion_FracDeprotonatedAcid", "Ion_NetCharge_Round"),
    "rules_ro5_ro3": ("RO5_Violations", "RO5_Pass", "RO3_Violations", "RO3_Pass"),
    "rules_oral": ("Veber_Pass", "Egan_Pass", "Ghose_Pass", "Muegge_Pass", "Bioavail_Score"),
    "rules_toxicity_metabolism": ("Tox_Total_Alerts", "Tox_Risk", "Met_Total_Sites", "Met_Stability"),
    "rules_herg_cyp": ("hERG_Alerts", "hERG_Risk", "CYP3A4_Inhibitor", "CYP2D6_Inhibitor", "CYP2C9_Inhibitor", "CYP_MBI_Risk", "CYP_Total_Inhibition"),
    "rules_medchem_sa": ("MedChem_Alerts", "SA_Class"),
    "rules_solubility": ("Sol_ESOL_LogS", "Sol_ESOL_mg_L", "Sol_ESOL_Class"),
    "rules_permeability": ("Perm_Caco2_LogPapp", "Perm_Caco2_Class", "Perm_PAMPA_LogPe", "Perm_PAMPA_Class", "Perm_GI_Absorption", "Perm_Skin_LogKp", "Perm_Pgp_Likelihood"),
    "rules_pk": ("PPB_Est_%", "PPB_Class", "Vd_Est_L_kg", "Vd_Class", "CL_Risk", "T_half_Est", "F_Score", "F_Class"),
    "rules_lead": ("Lead_LE", "Lead_LE_Quality", "Lead_LLE", "Lead_LLE_Quality", "Lead_LELP", "Lead_LELP_Quality", "Lead_BEI", "Lead_SEI"),
    "rules_developability": ("Dev_GSK_4_400_Pass", "Dev_Pfizer_3_75_Pass", "Dev_GoldenTriangle_Pass", "Dev_Solubility_Risk", "Dev_BasePoints", "Dev_Risk_Burden", "Dev_Risk_Class", "Dev_Score", "Dev_Class", "Dev_Flags"),
}


def _rule_query(names: tuple[str, ...]) -> Query:
    return lambda spark, sf_dir: wide(spark, sf_dir).select("Compound_ID", *[col(n) for n in names])


for _name, _columns in RULES.items():
    register(_name, over_wide(f"select Compound_ID, {quoted(_columns)} from w"))(_rule_query(_columns))

# ---- picklists ------------------------------------------------------------------------------------

SHOWN = ("Compound_ID", "CNS_MPO", "RO5_Pass", "Bioavail_Score", "CYP_Total_Inhibition", "Tox_Risk", "hERG_Risk", "MedChem_Alerts")


def _picklist_query(p: P.Picklist) -> Query:
    return lambda spark, sf_dir: P.run_picklist(wide(spark, sf_dir), p, tie="row").select(*SHOWN)


_BUILTIN_SQL = {
    "top_cns_followup": "where CNS_MPO >= 4.5 and RO5_Pass and Tox_Risk <> 'High' and hERG_Risk <> 'High' order by CNS_MPO desc, \"row\" limit 50",
    "oral_low_ddi_risk": "where Bioavail_Score >= 3 and RO5_Violations <= 1 and CYP_Total_Inhibition <= 1 and not CYP_MBI_Risk and Tox_Risk <> 'High' order by Bioavail_Score desc, CYP_Total_Inhibition, \"row\" limit 100",
    "high_risk_deprioritize": "where Tox_Risk = 'High' or hERG_Risk = 'High' or CYP_Total_Inhibition >= 3 or CYP_MBI_Risk or MedChem_Alerts >= 2 or RO5_Violations >= 2",
}
for _key, _where in _BUILTIN_SQL.items():
    register(f"picklist_{_key}", over_wide(f"select {quoted(SHOWN)} from w {_where}"))(_picklist_query(P.BUILTIN[_key]))

@register("picklist_run", over_wide(" union all ".join(f"(select '{k}' as picklist, row_number() over (order by {o}) as rank, {quoted(SHOWN)} from w where {c} qualify rank <= {n})" for k, c, o, n in (
    ("top_cns_followup", "CNS_MPO >= 4.5 and RO5_Pass and Tox_Risk <> 'High' and hERG_Risk <> 'High'", 'CNS_MPO desc, "row"', 50),
    ("oral_low_ddi_risk", "Bioavail_Score >= 3 and RO5_Violations <= 1 and CYP_Total_Inhibition <= 1 and not CYP_MBI_Risk and Tox_Risk <> 'High'", 'Bioavail_Score desc, CYP_Total_Inhibition, "row"', 100),
    ("soluble_by_class", "Sol_ESOL_LogS > -4", 'Sol_ESOL_Class desc nulls last, QED desc nulls last, "row"', 10**9),
))))
def picklist_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lists from one scan, one of them without a limit and sorted by a class and a number."""
    own = P.Picklist("soluble_by_class", "Soluble", "", "all", (P.Rule("Sol_ESOL_LogS", ">", -4),), (P.Order("Sol_ESOL_Class", False), P.Order("QED", False)), 0, (), ())
    lists = [P.BUILTIN["top_cns_followup"], P.BUILTIN["oral_low_ddi_risk"], own]
    used = {"row", *SHOWN, *(x.column for p in lists for x in (*p.filters, *p.sort))}
    return P.run_together(stored(wide(spark, sf_dir).select(*sorted(used)), "wide"), lists, "row").select("picklist", "rank", *SHOWN)


_RULE_CASES = {
    "eq": (P.Rule("PAINS", "==", True), "PAINS is true"),
    "ne": (P.Rule("PAINS", "!=", True), "PAINS is distinct from true"),
    "gt": (P.Rule("QED", ">", 0.5), "QED > 0.5"),
    "le": (P.Rule("QED", "<=", 0.25), "QED <= 0.25"),
    "in": (P.Rule("Sol_ESOL_Class", "in", ["Soluble", "Insoluble"]), "Sol_ESOL_Class in ('Soluble', 'Insoluble')"),
    "notin": (P.Rule("pKa_Basic", "notin", [9.0]), "pKa_Basic is distinct from 9.0"),
    "contains": (P.Rule("Dev_Flags", "contains", "HIGH"), "contains(lower(Dev_Flags), 'high')"),
    "notcontains": (P.Rule("Dev_Flags", "notcontains", "high"), "not contains(lower(Dev_Flags), 'high')"),
    "isnull": (P.Rule("QED", "isnull"), "QED is null"),
    "notnull": (P.Rule("pKa_Acidic", "notnull"), "pKa_Acidic is not null"),
    "between": (P.Rule("MolWt", "between", 250, 350), "MolWt between 250 and 350"),
    "missing": (P.Rule("Lead_FitQuality", ">", 1, missing="false"), "false"),
}


@register("picklist_operators", over_wide("select * from (" + " union all ".join(f"select '{k}' as op, count(*) as n from w where {where}" for k, (_, where) in _RULE_CASES.items()) + ") order by op"))
def picklist_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each filter operator keeps; one pass for all."""
    df = wide(spark, sf_dir)
    counts = df.agg(*[F.count_if(P.mask(df, rule)).alias(k) for k, (rule, _) in _RULE_CASES.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("op"), F.col(k).alias("n")) for k in _RULE_CASES])))


# ---- analyses -------------------------------------------------------------------------------------

SUMMARIZED = ("CNS_MPO", "QED", "SA_Score", "Sol_ESOL_LogS", "Lead_LLE", "Dev_Score", "Met_Total_Sites")


@register(
    "analyze_numeric_summary",
    over_wide(" union all ".join(f"select '{c}' as \"column\", count({c}) as n, round(avg({c}), 6) as mean, round(median({c}), 6) as median, cast(min({c}) as double) as \"min\", cast(max({c}) as double) as \"max\", round(stddev_samp({c}), 6) as std from w" for c in SUMMARIZED)),
)
def analyze_numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.numeric_summary(wide(spark, sf_dir), SUMMARIZED)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "std")})


COUNTED = ("CNS_MPO_Class", "RO5_Violations", "Tox_Risk", "Met_Stability", "hERG_Risk", "CYP_Total_Inhibition", "Sol_ESOL_Class", "Perm_GI_Absorption", "PPB_Class", "F_Class", "Lead_LLE_Quality", "SA_Class", "Dev_Class", "PAINS")


@register("analyze_value_counts", over_wide(" union all ".join(f"select '{c}' as \"column\", cast({c} as varchar) as value, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct from w group by {c}" for c in COUNTED)))
def analyze_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.value_counts_of(wide(spark, sf_dir), COUNTED).withColumn("pct", F.round("pct", 6))


FLAGS = ("BBB_Likely", "RO5_Pass", "RO3_Pass", "Veber_Pass", "Egan_Pass", "PAINS", "BRENK", "CYP_MBI_Risk", "Dev_GSK_4_400_Pass")


@register("analyze_rates", over_wide(" union all ".join(f"select '{c}' as name, count(*) filter ({c}) as hits, count(*) as n, round(count(*) filter ({c}) / count(*), 9) as rate from w" for c in FLAGS)))
def analyze_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rates(wide(spark, sf_dir), {c: col(c) for c in FLAGS}).withColumn("rate", F.round("rate", 9))


@register("analyze_prevalence", over_wide("select alert, n from (" + " union all ".join(f"select 'Tox_{k}' as alert, count(*) filter (n_{k} > 0) as n from w" for k in TOX) + ") where n > 0 order by n desc, alert limit 25"))
def analyze_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.analyze(wide(spark, sf_dir), "toxicity")["prevalence"]


_TOPS = {
    "cns_mpo": "CNS_MPO desc nulls last",
    "qed": "QED desc nulls last",
    "sa_complexity": "SA_Score desc nulls last",
    "solubility": "Sol_ESOL_LogS asc nulls last",
    "metabolism": "Met_Total_Sites asc nulls last",
    "lead": "Lead_LLE desc nulls last, Lead_LE desc nulls last",
    "developability": "Dev_Score desc nulls last, Dev_Risk_Burden asc nulls last",
}


@register("analyze_top", over_wide(" union all ".join(f"(select '{k}' as category, Compound_ID from w order by {order}, Compound_ID limit 20)" for k, order in _TOPS.items())))
def analyze_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, out = stored(wide(spark, sf_dir).drop("Patterns"), "wide"), None
    for k in _TOPS:
        part = A.analyze(df, k, summarized=False)["top"].select(F.lit(k).alias("category"), "Compound_ID")
        out = part if out is None else out.unionByName(part)
    return out


_SCREENS = {
    "medchem_flags": "coalesce(MedChem_Alerts, 0) = 0",
    "toxicity": "lower(Tox_Risk) = 'high'",
    "herg": "lower(hERG_Risk) = 'high'",
    "cyp": "coalesce(CYP_Total_Inhibition, 0) >= 2",
    "permeability": "lower(Perm_GI_Absorption) = 'high' and lower(Perm_Pgp_Likelihood) in ('low', 'medium')",
    "pk": "lower(CL_Risk) = 'low'",
    "qed": "QED < 0.4",
    "sa_complexity": "SA_Score >= 6",
}


@register("analyze_screens", over_wide(" union all ".join(f"select '{k}' as category, count(*) as n, min(Compound_ID) as first_id from w where {where}" for k, where in _SCREENS.items())))
def analyze_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, out = stored(wide(spark, sf_dir).drop("Patterns"), "wide"), None
    for k in _SCREENS:
        part = A.analyze(df, k, summarized=False)["screen"].agg(F.count("*").alias("n"), F.min("Compound_ID").alias("first_id")).select(F.lit(k).alias("category"), "n", "first_id")
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "report_histogram",
    over_wide("""
, e as (select min(CNS_MPO) as lo, max(CNS_MPO) as hi from w),
b as (select cast(least(floor((CNS_MPO - lo) / ((hi - lo) / 30)), 29) as int) as bin, count(*) as n from w, e group by 1)
select cast(g.bin as int) as bin, round(lo + g.bin * ((hi - lo) / 30), 6) as low, round(lo + (g.bin + 1) * ((hi - lo) / 30), 6) as high, coalesce(n, 0) as n
from e, (select unnest(range(30)) as bin) g left join b on b.bin = g.bin"""),
)
def report_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(wide(spark, sf_dir), "CNS_MPO").withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


_PROFILED = ("CNS_MPO", "QED", "SA_Score", "Sol_ESOL_LogS", "Lead_LLE", "Dev_Score", "Met_Total_Sites")


@register("report_histograms", over_wide(", " + ", ".join(f"e{i} as (select min({c})::double as lo, max({c})::double as hi from w), b{i} as (select cast(least(floor(({c} - lo) / ((hi - lo) / 30)), 29) as int) as bin, count(*) as n from w, e{i} where {c} is not null group by 1)" for i, c in enumerate(_PROFILED)) + " " + " union all ".join(
    f"select '{c}' as \"column\", cast(g.bin as int) as bin, round(lo + g.bin * (hi - lo) / 30, 6) as low, round(lo + (g.bin + 1) * (hi - lo) / 30, 6) as high, coalesce(n, 0) as n from e{i}, (select unnest(range(30)) as bin) g left join b{i} on b{i}.bin = g.bin" for i, c in enumerate(_PROFILED))))
def report_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histograms of all key columns together."""
    return A.profile(wide(spark, sf_dir), list(_PROFILED), [])[0].withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


_CLASSES = ("PAINS", "Sol_ESOL_Class", "Tox_Risk")


@register("report_first_rows", over_wide(" union all ".join(f"(select '{c}' as \"column\", cast(row_number() over (order by coalesce({c} <> (select {c} from w where {c} is not null group by 1 order by count(*) desc, cast({c} as varchar) limit 1), true), cast({c} as varchar) nulls last, Compound_ID) as int) as place, Compound_ID as id, cast({c} as varchar) as value from w qualify place <= 10)" for c in _CLASSES) + """ union all (select 'QED', cast(row_number() over (order by QED desc nulls last, Compound_ID) as int) as place, Compound_ID, cast(QED as varchar) from w qualify place <= 10)"""))
def report_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten rows by each of four columns, in one pass."""
    table = stored(wide(spark, sf_dir).select("Compound_ID", "QED", *_CLASSES), "wide")
    return A.top_rows(table, [*_CLASSES, "QED"], A.profile(table, [], list(_CLASSES))[1], "Compound_ID")


@register("report_bars", over_wide("select coalesce(cast(PAINS as varchar), '(missing)') as value, count(*) as n from w group by 1 order by n desc, value limit 12"))
def report_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.category_bars(wide(spark, sf_dir), "PAINS")


@register("report_top_table", over_wide("select Compound_ID, Sol_ESOL_Class from w order by Sol_ESOL_Class = (select Sol_ESOL_Class from w group by 1 order by count(*) desc, 1 limit 1) desc, Sol_ESOL_Class, Compound_ID limit 10"))
def report_top_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_table(wide(spark, sf_dir), "Sol_ESOL_Class", "Compound_ID").select("Compound_ID", "Sol_ESOL_Class")


# ---- similarity -----------------------------------------------------------------------------------

_A, _B, _X = "cast(bit_count(a.f) as double)", "cast(bit_count(b.f) as double)", "cast(bit_count(a.f & b.f) as double)"
_FORMULAS = {
    "tanimoto": f"{_X} / ({_A} + {_B} - {_X})",
    "dice": f"2 * {_X} / ({_A} + {_B})",
    "cosine": f"{_X} / sqrt({_A} * {_B})",
    "sokal": f"({_X} + (62 - {_A} - {_B} + {_X})) / 62",
    "russel": f"{_X} / 62",
    "kulczynski": f"({_X} / {_A} + {_X} / {_B}) / 2",
    "mcconnaughey": f"({_X} * {_X} - ({_A} - {_X}) * ({_B} - {_X})) / ({_A} * {_B})",
    "asymmetric": f"{_X} / {_A}",
    "braun_blanquet": f"{_X} / greatest({_A}, {_B})",
}


@register("similarity_metrics", over_fp("select b.Compound_ID as \"Compound_ID\", " + ", ".join(f"round({f}, 9) as {k}" for k, f in _FORMULAS.items()) + ' from fp a, fp b where a."row" = 0'))
def similarity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric of every row to the first one."""
    library = fingerprints(spark, sf_dir)
    query = [F.lit(w) for w in library.where("row = 0").first()["fp"]]
    return library.select("Compound_ID", *[F.round(similarity(k, query, words(F.col("fp"), N_BITS), N_BITS), 9).alias(k) for k in METRICS])


def _query(spark: SparkSession, sf_dir: str, row: int = 0) -> tuple[DataFrame, list[int], str]:
    library = fingerprints(spark, sf_dir)
    first = library.where(F.col("row") == row).first()
    return library, list(first["fp"]), first["SMILES"]


_RANKED = 'cast(row_number() over (order by s desc, "row") as int) as "Rank", Compound_ID, SMILES, round(s, 9) as "Similarity"'


@register("similarity_search", over_fp(f', q as (select b.*, {_FORMULAS["tanimoto"]} as s from fp a, fp b where a."row" = 0) select {_RANKED} from q where s >= 0.45'))
def similarity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    library, query, _ = _query(spark, sf_dir)
    return S.search(library, query, N_BITS, threshold=0.45).withColumn("Similarity", F.round("Similarity", 9))


@register("similarity_knn", over_fp(f', q as (select b.*, {_FORMULAS["dice"]} as s from fp a, fp b where a."row" = 7 and b.SMILES <> a.SMILES) select {_RANKED} from q order by s desc, "row" limit 10'))
def similarity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    library, query, text = _query(spark, sf_dir, 7)
    return S.neighbours(library, query, N_BITS, 10, "dice", query_smiles=text, include_query=False).withColumn("Similarity", F.round("Similarity", 9))


@register("similarity_batch", over_fp(f', q as (select a.Compound_ID as "Query_ID", a.SMILES as "Query_SMILES", b.Compound_ID as "Compound_ID", b.SMILES as "SMILES", {_FORMULAS["tanimoto"]} as s, a."row" as qr, b."row" as r from fp a, fp b where a."row" % 20 = 0) select Query_ID, Query_SMILES, cast(row_number() over (partition by qr order by s desc, r) as int) as "Rank", Compound_ID, SMILES, round(s, 9) as "Similarity" from q where s >= 0.3 qualify "Rank" <= 5'))
def similarity_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = fingerprints(spark, sf_dir)
    return S.batch_search(library.where("row % 20 = 0"), library, N_BITS, threshold=0.3, top=5).withColumn("Similarity", F.round("Similarity", 9))


@register("similarity_pairwise", over_fp(f'select a."row" as i, b."row" as j, case when a."row" = b."row" then 1.0::double else round({_FORMULAS["tanimoto"]}, 9) end as similarity from fp a, fp b'))
def similarity_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of the whole table."""
    return S.pairwise(fingerprints(spark, sf_dir), N_BITS, digits=9)


@register("similarity_threshold_join", over_fp(f'select a."row" as a_row, b."row" as b_row, round({_FORMULAS["tanimoto"]}, 9) as similarity from fp a join fp b on a."row" < b."row" where {_FORMULAS["tanimoto"]} >= 0.5'))
def similarity_threshold_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.similar_pairs(fingerprints(spark, sf_dir), N_BITS, 0.5).withColumn("similarity", F.round("similarity", 9))


@register("similarity_reference_columns", over_fp(f', s as (select a.Compound_ID as id, b.Compound_ID as ref, b."row" as r, {_FORMULAS["tanimoto"]} as s from fp a, fp b where b."row" < 5) select id as "Compound_ID", round(max(s), 9) as "Sim_Ref", arg_max(ref, s * 1000 - r / 1e6) as "Sim_Ref_BestRef" from s group by id'))
def similarity_reference_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = fingerprints(spark, sf_dir)
    return S.reference_columns(library, library.where("row < 5"), N_BITS).select("Compound_ID", F.round("Sim_Ref", 9).alias("Sim_Ref"), "Sim_Ref_BestRef")


@register("fingerprint_bits", over_fp('select Compound_ID, cast(bit_count(f) as int) as n_on, round(bit_count(f) / 62.0, 9) as density, cast(list_sum(list_filter(range(62), lambda i: (f >> i) & 1 = 1)) as bigint) as bit_sum from fp'))
def fingerprint_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = on_bits(F.col("fp"), N_BITS)
    return fingerprints(spark, sf_dir).select("Compound_ID", F.size(positions).alias("n_on"), F.round(F.size(positions) / 62.0, 9).alias("density"), F.aggregate(positions, F.lit(0).cast("long"), lambda s, x: s + x).alias("bit_sum"))


@register("maxmin_diverse", f"""with recursive {FP_SQL}, d as materialized (select a."row" as x, b."row" as y, 1 - {_FORMULAS["tanimoto"]} as far from fp a, fp b),
m(k, r, far, p) as (
  select 1, "row", case when "row" = 0 then -1.0::double else 'infinity'::double end, 0::bigint from fp
  union all select k + 1, r, far, first_value(r) over (order by far desc, r) from (select m.k, m.r, case when m.r = m.p then -1.0::double else least(m.far, d.far) end as far from m join d on d.x = m.p and d.y = m.r where m.k < 12)),
t as (select k, any_value(p) as p, case when k = 1 then 0.0::double else max(far) end as far from m group by k)
select Compound_ID, SMILES, cast(k as int) as "Pick_Order", far as "Min_Distance" from t join fp on fp."row" = t.p""")
def maxmin_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve picks from the first row on."""
    return S.diverse(fingerprints(spark, sf_dir), N_BITS, 12, seed=0)


_NEIGHBOURS = f"""{FP_SQL}, e as materialized (select a."row" as a, b."row" as b from fp a join fp b on a."row" < b."row" where {_FORMULAS["tanimoto"]} >= 0.5), sides as (select a, b from e union all select b, a from e)"""
#: The greedy rule over places 1, 2, ... in ``place``, one after another, in SQL.
_GREEDY = """near as materialized (select x.p as p, list(y.p) as before from sides join place x on x.r = sides.a join place y on y.r = sides.b where y.p < x.p group by x.p),
greedy(p, starts) as (
  select 0::bigint, []::bigint[]
  union all select g.p + 1, case when n.before is null or not list_has_any(n.before, g.starts) then list_append(g.starts, g.p + 1) else g.starts end
  from greedy g left join near n on n.p = g.p + 1 where g.p < (select count(*) from place)),
starts as (select starts from greedy order by p desc limit 1),
center as (select place.r, place.p, list_contains(starts, place.p) as leads, case when leads then place.p else list_min(list_filter(before, lambda q: list_contains(starts, q))) end as c from place left join near on near.p = place.p, starts)"""


@register("cluster_leader", f"""with recursive {_NEIGHBOURS}, place as materialized (select "row" as r, row_number() over (order by "row") as p from fp), {_GREEDY},
ids as (select p, cast(row_number() over (order by p) - 1 as int) as id from center where leads)
select "row", Compound_ID, SMILES, id as "Cluster_ID", leads as "Is_Centroid" from fp join center on center.r = "row" join ids on ids.p = center.c""")
def cluster_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.leader_clusters(fingerprints(spark, sf_dir), N_BITS, 0.5)


@register("cluster_butina", f"""with recursive {_NEIGHBOURS}, place as materialized (select "row" as r, row_number() over (order by coalesce(n, 0) desc, "row") as p from fp left join (select a, count(*) as n from sides group by a) on a = "row"), {_GREEDY},
sizes as (select c, count(*) as n, cast(row_number() over (order by count(*) desc, c) as int) as id from center group by c)
select "row", Compound_ID, SMILES, id as "Cluster_ID", n as "Cluster_Size" from fp join center on center.r = "row" join sizes on sizes.c = center.c""")
def cluster_butina(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.butina_clusters(fingerprints(spark, sf_dir), N_BITS, 0.5)


@register("cluster_medoids", over_fp(f', m as (select a.label as c, a."row" as r, a.Compound_ID as id, avg(case when a."row" <> b."row" then {_FORMULAS["tanimoto"]} end) as s from fp a join fp b on a.label = b.label group by all), t as (select *, row_number() over (partition by c order by s desc, r) as k from m) select cast(c as int) as "Cluster_ID", id as "Cluster_Representative_ID", round(s, 9) as "Cluster_MedoidMeanSim" from t where k = 1'))
def cluster_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medoids of the groups that ``label`` forms."""
    library = fingerprints(spark, sf_dir)
    groups = library.select("row", F.col("label").alias("Cluster_ID"))
    return C.medoids(groups, library, N_BITS).select("Cluster_ID", "Cluster_Representative_ID", F.round("Cluster_MedoidMeanSim", 9).alias("Cluster_MedoidMeanSim"))


# ---- scaffolds and series -------------------------------------------------------------------------


@register("scaffold_assignments", over_wide(", s as (select Scaffold_SMILES as k, count(*) as n from w group by 1), i as (select k, printf('SCAF_%04d', row_number() over (order by n desc, k)) as id from s where k <> '') select Compound_ID, w.Scaffold_SMILES as \"Scaffold_SMILES\", i.id as \"Scaffold_ID\", s.n as \"Scaffold_Size\" from w join s on s.k = w.Scaffold_SMILES left join i on i.k = w.Scaffold_SMILES"))
def scaffold_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.scaffold_assignments(compounds(spark, sf_dir, patterns=False, deal=True), "Scaffold_SMILES", "Compound_ID").select("Compound_ID", "Scaffold_SMILES", "Scaffold_ID", "Scaffold_Size")


@register("scaffold_summary", over_wide(", f as (select *, row_number() over (partition by Scaffold_SMILES order by \"row\") as k from w where Scaffold_SMILES <> '') select Scaffold_SMILES, count(*) as n, arg_min(SMILES, \"row\") as example_smiles, string_agg(Compound_ID, ', ' order by \"row\") filter (k <= 5) as example_ids, round(avg(CNS_MPO), 6) as \"CNS_MPO_mean\", round(median(CNS_MPO), 6) as \"CNS_MPO_median\", round(avg(QED), 6) as \"QED_mean\", round(median(QED), 6) as \"QED_median\" from f group by 1"))
def scaffold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.group_summary(wide(spark, sf_dir), "Scaffold_SMILES", "Compound_ID", "SMILES", "row", ("CNS_MPO", "QED"))
    return out.select("Scaffold_SMILES", "n", "example_smiles", "example_ids", *[F.round(c, 6).alias(c) for c in ("CNS_MPO_mean", "CNS_MPO_median", "QED_mean", "QED_median")])


@register(
    "scaffold_outliers",
    over_wide(
        ", u as (" + " union all ".join(f"select Scaffold_SMILES, '{m}' as metric, Compound_ID as id, \"row\" as r, {m} as v from w where Scaffold_SMILES <> ''" for m in ("CNS_MPO", "QED", "SA_Score"))
        + "), n as (select Scaffold_SMILES, metric, count(*) as n from u group by all), hi as (select * from u where v is not null qualify row_number() over (partition by Scaffold_SMILES, metric order by v desc, r) = 1), lo as (select * from u where v is not null qualify row_number() over (partition by Scaffold_SMILES, metric order by v, r) = 1) select n.Scaffold_SMILES as \"Scaffold_SMILES\", n.metric as metric, n.n as n, hi.id as best_id, hi.v as best, lo.id as worst_id, lo.v as worst from n join hi on hi.Scaffold_SMILES = n.Scaffold_SMILES and hi.metric = n.metric join lo on lo.Scaffold_SMILES = n.Scaffold_SMILES and lo.metric = n.metric where n.n >= 2"
    ),
)
def scaffold_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.outliers(wide(spark, sf_dir), "Scaffold_SMILES", "Compound_ID", "row")


@register("series_join", over_wide(", s as (select Scaffold_SMILES as k, count(*) as n from w group by 1), t as (select Series as k, count(*) as m from w group by 1) select w.Compound_ID, s.n as \"Scaffold_Size\", t.m as \"Series_Size\", CNS_MPO from w left join s on s.k = w.Scaffold_SMILES left join t on t.k = w.Series"))
def series_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table with two group tables joined by id."""
    df = stored(wide(spark, sf_dir).select("Compound_ID", "CNS_MPO", "Scaffold_SMILES", "Series"), "wide")
    size = lambda key, name: df.select("Compound_ID", key).join(df.groupBy(key).agg(F.count("*").alias(name)), key).select("Compound_ID", name)
    return C.series(df.select("Compound_ID", "CNS_MPO"), size("Scaffold_SMILES", "Scaffold_Size"), size("Series", "Series_Size"), "Compound_ID")


# ---- features -------------------------------------------------------------------------------------


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, fragments, counts): the words of part names as fragments, and a few hashed counts."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    counts = F.create_map(F.col("p_partkey") * 7, F.lit(2), F.col("p_partkey") * 7 + 4096, F.lit(1), F.col("p_partkey") % 97 + 100_000, F.lit(3))
    return part.select(F.col("p_partkey").alias("row"), F.split("p_name", " ").alias("fragments"), counts.alias("counts"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


_WORDS = "u as (select distinct p_partkey as \"row\", unnest(string_split(p_name, ' ')) as fragment from part), v as (select fragment, count(*) as n from u group by 1), k as (select fragment, cast(row_number() over (order by fragment) - 1 as int) as \"column\" from v where n >= 2)"


@register("feature_fragment_counts", f"with {_WORDS} select fragment, n from v")
def feature_fragment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.fragment_counts(fragments(spark, sf_dir))


@register("feature_vocabulary", f'with {_WORDS} select fragment, "column" from k')
def feature_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.vocabulary(fragments(spark, sf_dir), least=2)


@register("feature_unknown_fragments", f"with {_WORDS} select fragment, n from v where fragment not in (select fragment from k where \"column\" < 5)")
def feature_unknown_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fragments(spark, sf_dir)
    return X.unknown_fragments(rows, X.vocabulary(rows, least=2).where("column < 5"))


_CELLS = f"""with {_WORDS}, h as (select p_partkey as "row", unnest([struct_pack(key := p_partkey * 7, n := 2), struct_pack(key := p_partkey * 7 + 4096, n := 1), struct_pack(key := p_partkey % 97 + 100000, n := 3)]) as c from part),
c as (select "row", cast(c.key % 4096 as int) as col, cast(sum(c.n) as double) as v from h group by 1, 2
  union all select p_partkey, 8192, cast(p_size as double) from part where p_size <> 0
  union all select p_partkey, 8193, cast(cast(p_retailprice as float) as double) from part where p_retailprice <> 0
  union all select "row", cast("column" + 8194 as int), 1.0 from u join k on k.fragment = u.fragment)"""


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fragments(spark, sf_dir)
    known = X.vocabulary(rows, least=2)
    laid = X.blocks({"FG": 2, "Frag": known.count()})
    cells = X.hashed_cells(rows, "row", "counts", laid["FP_Morgan"]).unionByName(X.named_cells(rows, "row", {"size": "size", "price": "price"}, laid["FG"])).unionByName(X.presence_cells(rows, "row", known, laid["Frag"]))
    return X.sparse_rows(rows, "row", cells)


@register("feature_sparse_rows", _CELLS + ' select "row", count(*) as nnz, cast(sum(col) as bigint) as column_sum, round(sum(v), 3) as value_sum from c group by 1')
def feature_sparse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda c, zero: F.aggregate(c, zero, lambda s, x: s + x)
    return _sparse(spark, sf_dir).select("row", F.size("indices").cast("long").alias("nnz"), total("indices", F.lit(0).cast("long")).alias("column_sum"), F.round(total("values", F.lit(0.0)), 3).alias("value_sum"))


@register("feature_row_pointers", _CELLS + ', n as (select "row", count(*) as nnz from c group by 1) select "row", cast(sum(nnz) over (order by "row") - nnz as bigint) as start from n')
def feature_row_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.row_pointers(_sparse(spark, sf_dir)).select("row", "start")


@register("feature_graph_offsets", 'select p_partkey as "row", cast(sum(p_size) over (order by p_partkey) - p_size as bigint) as atom_start, cast(sum(2 * p_size) over (order by p_partkey) - 2 * p_size as bigint) as edge_start from part')
def feature_graph_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fragments(spark, sf_dir).select("row", F.col("size").alias("n_atoms"), (2 * F.col("size")).alias("n_edges"))
    return X.graph_offsets(rows).select("row", "atom_start", "edge_start")


@register("feature_dense_rows", over_wide("select \"row\", round(cast(cast(MolWt as float) as double), 4) as a, round(cast(cast(coalesce(QED, -1) as float) as double), 4) as b, cast(Dev_Score as int) as c from w"))
def feature_dense_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.dense_rows(wide(spark, sf_dir), "row", "MolWt, QED, Dev_Score")
    cell = lambda i: F.round(F.coalesce(F.element_at("features", i).cast("double"), F.lit(-1.0)), 4)
    return out.select("row", cell(1).alias("a"), cell(2).alias("b"), cell(3).cast("int").alias("c"))


_EXPORTED = """with u as (select distinct p_partkey as "row", unnest(string_split(p_name, ' ')) as fragment from part), t as (select distinct p_partkey as "row", unnest(string_split(p_type, ' ')) as fragment from part),
k as (select fragment, cast(row_number() over (order by fragment) - 1 as int) as i from (select fragment from u where "row" % 37 = 0 group by 1 having count(*) >= 2)),
l as (select fragment, cast(row_number() over (order by fragment) - 1 as int) as i from (select fragment from t where "row" % 37 = 0 group by 1 having count(*) >= 2)),
h as (select p_partkey as "row", unnest([struct_pack(key := p_partkey * 7, n := 2), struct_pack(key := p_partkey * 7 + 4096, n := 1), struct_pack(key := p_partkey % 97 + 100000, n := 3)]) as c from part),
m as (select "row", cast(c.key % 512 as int) as col, cast(sum(c.n) as double) as v from h group by 1, 2
  union all select p_partkey, 512, cast(p_size as double) from part where p_size <> 0
  union all select p_partkey, 513, cast(cast(p_retailprice as float) as double) from part where p_retailprice <> 0
  union all select "row", i + 514, 1.0 from u join k on k.fragment = u.fragment
  union all select "row", i + 514 + (select count(*) from k), 1.0 from t join l on l.fragment = t.fragment)"""


def _exported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.split("p_type", " ").alias("Type"))
    rows = fragments(spark, sf_dir).withColumnRenamed("fragments", "Frag").join(part, F.col("row") == F.col("p_partkey")).drop("p_partkey")
    spec = E.specify(rows.where("row % 37 = 0"), ["size", "price"], ["Frag", "Type"], least=2, hashed={"FP_Morgan": 512})
    return E.export(rows, "row", spec, {"FP_Morgan": "counts"})


@register("feature_export", _EXPORTED + ' select "row", count(*) as nnz, cast(sum(col) as bigint) as column_sum, round(sum(v), 3) as value_sum, cast(sum(count(*)) over (order by "row") - count(*) as bigint) as start from m group by 1')
def feature_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks by a specification frozen on a few of the rows, with the index pointers."""
    total = lambda c, zero: F.aggregate(c, zero, lambda s, x: s + x)
    return _exported(spark, sf_dir)[0].select("row", F.size("indices").cast("long").alias("nnz"), total("indices", F.lit(0).cast("long")).alias("column_sum"), F.round(total("values", F.lit(0.0)), 3).alias("value_sum"), "start")


@register("feature_export_dropped", _EXPORTED + " select 'Frag' as block, fragment as name, count(*) as n from u where fragment not in (select fragment from k) group by 2 union all select 'Type', fragment, count(*) from t where fragment not in (select fragment from l) group by 2")
def feature_export_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What that specification does not know."""
    return _exported(spark, sf_dir)[1]


# ---- validation, export, sources ------------------------------------------------------------------

_TYPED = {"CNS_MPO": "float", "QED": "int", "RO5_Violations": "int", "PAINS": "bool", "SMILES": "float", "Dev_Class": "bool", "HBD": "bool"}


@register(
    "validate_coercion",
    over_wide(" union all ".join(
        f"select '{c}' as \"column\", '{t}' as type, count({c}) as n, round(coalesce(count(*) filter ({good}) / nullif(count({c}), 0), 1.0), 9) as ratio from w"
        for (c, t), good in zip(_TYPED.items(), ("CNS_MPO is not null", "QED = round(QED)", "RO5_Violations is not null", "PAINS is not null", "try_cast(SMILES as double) is not null", "lower(Dev_Class) in ('true','t','1','yes','y','false','f','0','no','n')", "HBD in (0, 1)"), strict=True)
    )),
)
def validate_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.coercion_ratios(wide(spark, sf_dir), _TYPED).withColumn("ratio", F.round("ratio", 9))


@register("export_filled", over_wide('select Compound_ID, coalesce(QED, -1.0) as "QED", coalesce(pKa_Basic, -1.0) as "pKa_Basic", coalesce(Scaffold_SMILES, \'-1\') as "Scaffold_SMILES" from w'))
def export_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_missing(wide(spark, sf_dir).select("Compound_ID", "QED", "pKa_Basic", "Scaffold_SMILES"), -1.0)


@register("smiles_parse", """
with t as (select p_partkey as line, case p_partkey % 6 when 0 then '' when 1 then '# ' || p_name when 2 then 'C1CC=C1' when 3 then 'M' || p_partkey || chr(9) || 'CC=O' when 4 then 'N#C, M' || p_partkey else 'CCO ethanol' end as value from part)
select line as "row", case p % 6 when 2 then 'cmpd_' || line when 3 then b when 4 then b else 'CCO' end as "Compound_ID", case p % 6 when 2 then 'C1CC=C1' when 3 then 'CC=O' when 4 then 'N#C' else 'ethanol' end as "SMILES"
from t join (select p_partkey as p, 'M' || p_partkey as b from part) on p = line where p % 6 not in (0, 1)""")
def smiles_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every layout through the calculators' dialect; the last is read as (name, SMILES), having no mark."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k, tab, name = F.col("p_partkey") % 6, F.lit("\t"), F.concat(F.lit("M"), F.col("p_partkey").cast("string"))
    value = F.when(k == 0, F.lit("")).when(k == 1, F.concat(F.lit("# "), "p_name")).when(k == 2, F.lit("C1CC=C1")).when(k == 3, F.concat(name, tab, F.lit("CC=O"))).when(k == 4, F.concat(F.lit("N#C, "), name)).otherwise(F.lit("CCO ethanol"))
    return parse_lines(part.select(F.col("p_partkey").alias("line"), value.alias("value")))


@register("retro_routes", "select p_partkey as row_index, p_name as target, p_partkey % 4 = 0 as is_solved, cast(p_size as int) as number_of_routes, cast(case when p_partkey % 5 = 0 then 0 else least(p_size, 2) end as int) as n_routes_exported from part where p_name not in ('nan', 'none', '')")
def retro_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested route-search results flattened to one row for each target."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    targets = retro_targets(part.select(F.col("p_partkey").alias("row_index"), F.col("p_name").alias("SMILES")), "SMILES")
    trees = F.transform(F.sequence(F.lit(1), F.greatest(F.col("p_size"), F.lit(1))), lambda i: F.concat(F.lit("{"), i.cast("string"), F.lit("}")))
    results = part.select(F.col("p_partkey").alias("row_index"), F.col("p_name").alias("target"), (F.col("p_partkey") % 4 == 0).alias("is_solved"), F.col("p_size").alias("number_of_routes"), F.when(F.col("p_partkey") % 5 != 0, trees).alias("trees"))
    return flatten_routes(results, targets, n_routes=2).select("row_index", "target", "is_solved", "number_of_routes", "n_routes_exported")


#: A few public structures that the kernel queries run on, spread over the rows of ``part``.
STRUCTURES = ("CC(=O)Oc1ccccc1C(=O)O", "CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "CC(=O)Nc1ccc(O)cc1", "CC(C)Cc1ccc(cc1)C(C)C(=O)O", "CCO", "c1ccccc1[N+](=O)[O-]", "c1ccc2ccccc2c1", "not a structure")


def _structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("row"), F.element_at(F.array(*[F.lit(s) for s in STRUCTURES]), (F.col("p_partkey") % len(STRUCTURES) + 1).cast("int")).alias("SMILES"))


#: Values of STRUCTURES as published or countable by hand: weight, LogP and refractivity by Crippen's contributions, surface, donors,
#: acceptors, CNS MPO, stereo, heavy atoms, directed bonds, aromatic share of the heavy atoms, functional groups of five kinds.
_KNOWN = """k(i, s, "MolWt", "LogP", "MR", "TPSA", "HBD", "HBA", "CNS_MPO", "Stereo_Status", atoms, edges, aromatic, acid, amide, phenol, nitro, rings) as (values
  (0, 'CC(=O)Oc1ccccc1C(=O)O', 180.159, 1.310, 44.710, 63.60, 1, 3, 5.36, 'None', 13, 26, 6, 1, 0, 0, 0, 1),
  (1, 'CN1C=NC2=C1C(=O)N(C(=O)N2C)C', 194.194, -1.029, 51.196, 61.82, 0, 6, 5.56, 'None', 14, 30, 9, 0, 0, 0, 0, 1),
  (2, 'CC(=O)Nc1ccc(O)cc1', 151.165, 1.351, 42.410, 49.33, 2, 2, 5.31, 'None', 11, 22, 6, 0, 1, 1, 0, 1),
  (3, 'CC(C)Cc1ccc(cc1)C(C)C(=O)O', 206.285, 3.073, 61.035, 37.30, 1, 1, 5.80, 'Undefined', 15, 30, 6, 1, 0, 0, 0, 1),
  (4, 'CCO', 46.069, -0.001, 12.760, 20.23, 1, 1, 5.83, 'None', 3, 4, 0, 0, 0, 0, 0, 0),
  (5, 'c1ccccc1[N+](=O)[O-]', 123.111, 1.595, 33.096, 43.14, 0, 2, 5.44, 'None', 9, 18, 6, 0, 0, 0, 1, 1),
  (6, 'c1ccc2ccccc2c1', 128.174, 2.840, 43.948, 0.0, 0, 0, 5.58, 'None', 10, 22, 10, 0, 0, 0, 0, 2))"""
_KNOWN_ROWS = "part join k on k.i = p_partkey % 8"


#: What the calculator reads of a structure: all but its texts and its fingerprint.
CALCULATED = (*DESCRIBED, "LogP", "MR", *STEREO, "Patterns")


@register("kernel_structures", f'with {_KNOWN} select p_partkey as "row", cast("MolWt" as double) as "MolWt", cast("LogP" as double) as "LogP", cast("MR" as double) as "MR", cast("TPSA" as double) as "TPSA", "HBD", "HBA", cast("CNS_MPO" as double) as "CNS_MPO", "Stereo_Status", true as "RO5_Pass" from {_KNOWN_ROWS}')
def kernel_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From structures to rules: descriptors, lipophilicity, stereo and the CNS score."""
    out = calculate(structures(_structured(spark, sf_dir), drop_invalid=True, fields=CALCULATED))
    return out.select("row", "MolWt", "LogP", "MR", "TPSA", "HBD", "HBA", "CNS_MPO", "Stereo_Status", "RO5_Pass")


@register("kernel_outcome", "select count(*) as searched, count(*) filter (p_partkey % 8 <> 7) as valid, count(*) filter (p_partkey % 8 = 7) as invalid from part")
def kernel_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome(structures(_structured(spark, sf_dir), drop_invalid=False, fields=()))


@register("kernel_graphs", f'with {_KNOWN}, g as (select p_partkey as r, coalesce(atoms, 0) as a, coalesce(edges, 0) as e from part left join k on k.i = p_partkey % 8) select r as "row", cast(a as int) as n_atoms, cast(e as int) as n_edges, cast(sum(a) over (order by r) - a as bigint) as atom_start, cast(sum(e) over (order by r) - e as bigint) as edge_start from g')
def kernel_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs with their places in the joined tensors; an invalid structure is empty."""
    return X.graph_offsets(graphs(_structured(spark, sf_dir)).select("row", "n_atoms", "n_edges")).select("row", "n_atoms", "n_edges", "atom_start", "edge_start")


@register("kernel_groups", f'with {_KNOWN} select p_partkey as "row", coalesce(acid, 0)::double as acid, coalesce(amide, 0)::double as amide, coalesce(phenol, 0)::double as phenol, coalesce(nitro, 0)::double as nitro, coalesce(rings, 0)::double as rings, coalesce(atoms, 0)::double as atoms from part left join k on k.i = p_partkey % 8')
def kernel_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functional groups and environment; zeros for an invalid structure."""
    group = lambda name: F.element_at("Groups", name)
    names = {"acid": "FG_CarboxylicAcid", "amide": "FG_Amide", "phenol": "FG_Phenol", "nitro": "FG_Nitro", "rings": "FG_AromaticRing", "atoms": "Env_HeavyAtomCount"}
    return structure_features(_structured(spark, sf_dir)).select("row", *[group(v).alias(k) for k, v in names.items()])


@register("kernel_count_cells", f'with {_KNOWN} select p_partkey as "row", cast(atoms * (atoms - 1) / 2 as double) as pairs, atoms * 3.0::double as environments from {_KNOWN_ROWS}')
def kernel_count_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From structures to folded feature cells: every pair of atoms and every environment of three radii counts once."""
    pairs, circles = (X.blocks({})[b] for b in ("FP_AtomPair", "FP_Morgan"))
    cells = X.hashed_blocks(structure_features(_structured(spark, sf_dir)), "row", {"AtomPair_Counts": pairs, "Morgan_Counts": circles})
    of = lambda block: F.coalesce(F.sum(F.when(F.col("column").between(block.offset, block.offset + block.size - 1), F.col("value"))), F.lit(0.0))
    return cells.groupBy("row").agg(of(pairs).alias("pairs"), of(circles).alias("environments"))


@register("kernel_complexity", f'with {_KNOWN} select p_partkey as "row", cast(round(aromatic / atoms, 3) as double) as "AromaticFraction", case when i = 3 then 1 else 0 end as "Stereocenters", 0 as "SpiroAtoms", 0 as "BridgeheadAtoms" from {_KNOWN_ROWS}')
def kernel_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_complexity(_structured(spark, sf_dir)).where("AromaticFraction is not null").select("row", "AromaticFraction", "Stereocenters", "SpiroAtoms", "BridgeheadAtoms")


#: Salts and ions: text, what is left of it as (weight-giving) heavy atoms, and which steps change it.
SALTS = ("[Na+].CC(=O)[O-]", "C[NH3+].[Cl-]", "CCO", "C[N+](C)(C)C", "OC(=O)c1ccccc1.O")


@register("kernel_prepare", "select p_partkey as \"row\", p_partkey % 5 in (0, 1, 4) as fragment, p_partkey % 5 in (0, 1) as uncharge, cast([4, 2, 3, 5, 9][p_partkey % 5 + 1] as int) as atoms from part")
def kernel_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest part, uncharged: which steps changed a structure, and the heavy atoms left."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = part.select(F.col("p_partkey").alias("row"), F.element_at(F.array(*[F.lit(s) for s in SALTS]), (F.col("p_partkey") % len(SALTS) + 1).cast("int")).alias("SMILES"))
    out = prepared_structures(rows, fields=())
    return out.select("row", F.col("Prep_Fragment_Changed").alias("fragment"), F.col("Prep_Uncharge_Changed").alias("uncharge"), F.col("HeavyAtoms").alias("atoms"))


# ---- counts, lookups, lists -----------------------------------------------------------------------

_COUNT_SQL = """a as (select p_partkey as r, unnest([struct_pack(k := p_partkey % 7, n := p_size % 5 + 1), struct_pack(k := 10 + p_partkey % 3, n := p_size % 3 + 1), struct_pack(k := 20, n := 2)]) as c from part),
x as (select r, c.k as k, c.n::double as n from a), q(k, n) as (values (1, 2.0), (11, 1.0), (20, 4.0)),
j as (select p.r, coalesce(sum(least(x.n, coalesce(q.n, 0))), 0) as low, coalesce(sum(x.n * q.n), 0) as dot from (select distinct r from x) p left join x on x.r = p.r left join q on q.k = x.k group by 1),
t as (select r, sum(n) as s, sqrt(sum(n * n)) as z from x group by 1)"""


def _count_map() -> F.Column:
    size, key = F.col("p_size"), F.col("p_partkey")
    pairs = [key % 7, size % 5 + 1, 10 + key % 3, size % 3 + 1, F.lit(20), F.lit(2)]
    return F.create_map(*[p.cast("long") if i % 2 == 0 else p.cast("int") for i, p in enumerate(pairs)])


@register("similarity_counts", f'with {_COUNT_SQL} select t.r as "row", round(low / (s + 7 - low), 9) as tanimoto, round(2 * low / (s + 7), 9) as dice, round(dot / (z * sqrt(21)), 9) as cosine from t join j on j.r = t.r')
def similarity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count forms of three metrics, to one query."""
    query = F.create_map(*[F.lit(v).cast("long" if i % 2 == 0 else "int") for i, v in enumerate((1, 2, 11, 1, 20, 4))])
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("row"), *[F.round(count_similarity(k, _count_map(), query), 9).alias(k) for k in ("tanimoto", "dice", "cosine")])


_COUNT_JOIN = f"""with {_COUNT_SQL},
i as (select a.r as a, b.r as b, sum(least(a.n, b.n)) as low from x a join x b on a.k = b.k and a.r < b.r group by all)
select a as a_row, b as b_row, round({{form}}, 9) as similarity from i join t p on p.r = a join t q on q.r = b where {{form}} >= {{least}}"""


def _count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, counts), dealt out first: a file of many rows may be small enough to be read in one task."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    return part.repartition(TASKS * spark.sparkContext.defaultParallelism).select(F.col("p_partkey").alias("row"), _count_map().alias("counts"))


@register("similarity_counts_join", _COUNT_JOIN.format(form="low / (p.s + q.s - low)", least=0.8))
def similarity_counts_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of count maps with a tanimoto of 0.8 or more."""
    return S.similar_counts(_count_rows(spark, sf_dir), 0.8, digits=9)


@register("similarity_counts_join_dice", _COUNT_JOIN.format(form="2 * low / (p.s + q.s)", least=0.95))
def similarity_counts_join_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a dice of 0.95 or more."""
    return S.similar_counts(_count_rows(spark, sf_dir), 0.95, "dice", digits=9)


@register("sa_lookup", f"""with {_COUNT_SQL}, f(k, score) as (select range::bigint, (range * 37 % 11) / 4.0 - 1 from range(15)),
m as (select x.r, sum(coalesce(f.score, -4.0) * n) / sum(n) as mean, count(*) as kinds from x left join f on f.k = x.k group by 1),
v as (select p_partkey as r, mean - (pow(p_size, 1.005) - p_size) - log10(p_partkey % 4 + 1.0) + case when p_size > kinds then 0.5 * ln(p_size / kinds) else 0 end as raw from part join m on m.r = p_partkey),
w as (select r, 11 - (raw + 5) / 6.5 * 9 as s from v) select r as "row", round(least(greatest(case when s > 8 then 8 + ln(s - 8) else s end, 1), 10), 2) as "SA_Score" from w""")
def sa_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic accessibility by a lookup of fragment scores; unknown fragments count as the worst."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = part.select(F.col("p_partkey").alias("row"), _count_map().alias("Morgan_Counts"), F.col("p_size").alias("HeavyAtoms"), (F.col("p_partkey") % 4).alias("Stereocenters"))
    table = spark.range(15).select(F.col("id").alias("fragment"), ((F.col("id") * 37 % 11) / 4.0 - 1).alias("score"))
    return sa_scores(rows, table).select("row", "SA_Score")


@register("cluster_top_sizes", over_fp(' select cast(label as int) as "Cluster_ID", count(*) as "Cluster_Size" from fp where label is not null group by 1 order by 2 desc, 1 limit 10'))
def cluster_top_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_sizes(fingerprints(spark, sf_dir).select(F.col("label").cast("int").alias("Cluster_ID")))


@register("similarity_hit_counts", over_fp(f', q as (select a.Compound_ID as "Query_ID", a.SMILES as "Query_SMILES", a."row" as qr, {_FORMULAS["tanimoto"]} as s from fp a, fp b where a."row" % 20 = 0 and s >= 0.3) select Query_ID, Query_SMILES, least(count(*), 5) as hits from q group by all'))
def similarity_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = fingerprints(spark, sf_dir)
    return S.hit_counts(S.batch_search(library.where("row % 20 = 0"), library, N_BITS, threshold=0.3, top=5))


@register("text_functions", "select p_partkey as \"row\", trim(regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g'), '_') as file, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') as slug, replace(replace('<' || p_name || ' & co>', '&', '&amp;'), '<', '&lt;').replace('>', '&gt;') as html, list_aggregate(list_slice(string_split(p_name, ' '), 1, 2), 'string_agg', '|') as top from part")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("row"), T.file_name(F.col("p_name")).alias("file"), T.slug(F.col("p_brand")).alias("slug"), T.html(F.concat(F.lit("<"), "p_name", F.lit(" & co>"))).alias("html"), T.top_joined(F.split("p_name", " "), 2).alias("top"))


@register("text_structure_names", "with t as (select p_partkey as r, case p_partkey % 5 when 0 then '-' || p_name || '.' when 1 then ' ' || p_type || '/#' when 2 then '._-' when 3 then '' else repeat(p_name || '%', 9) end as t from part), c as (select r, trim(regexp_replace(case when trim(t) = '' then 'compound' else trim(t) end, '[^A-Za-z0-9._-]+', '_', 'g'), '._-') as t from t) select r as \"row\", left(case when t = '' then 'compound' else t end, 120) as name from c")
def text_structure_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of structures from texts with signs at their ends, empty and long ones."""
    part, k = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey") % 5
    text = F.when(k == 0, F.concat(F.lit("-"), "p_name", F.lit("."))).when(k == 1, F.concat(F.lit(" "), "p_type", F.lit("/#"))).when(k == 2, F.lit("._-")).when(k == 3, F.lit("")).otherwise(F.repeat(F.concat("p_name", F.lit("%")), F.lit(9)))
    return part.select(F.col("p_partkey").alias("row"), T.structure_name(text).alias("name"))


@register("ragged_union", 'select p_partkey as "row", p_name as name, p_size as size, null::double as price from part union all select p_partkey, p_name, null, p_retailprice::double from part')
def ragged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumnsRenamed({"p_partkey": "row", "p_name": "name"})
    return ragged_union([part.select("row", "name", F.col("p_size").alias("size")), part.select("row", "name", F.col("p_retailprice").cast("double").alias("price"))])


@register("compare_columns", over_wide('select Compound_ID, SMILES as input, SMILES as calc from w'))
def compare_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = wide(spark, sf_dir)
    found = compare_columns(df.columns)
    return df.select("Compound_ID", *[col(found[k]).alias(k) for k in ("input", "calc")])
