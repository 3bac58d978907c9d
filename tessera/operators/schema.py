"""Roles of columns: structures, activities, units, labels and features, found by name and by what they hold.

Names are compared by their letters and digits in lower case. Roles are resolved once,
from the schema and one aggregation, and operators get column names.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalars import normalize_unit, number, p_scale, parse_label

#: Names of structure columns, in the order of preference (fixed values).
STRUCTURES = ("smiles", "smi", "canonical_smiles", "canonical_smiles_standardized", "SMILES", "Smiles")
#: p-scale columns by plain name: score name and endpoint (fixed values).
P_SCALES = {"pchemblvalue": ("pchembl_value", "pChEMBL"), "pic50": ("pIC50", "IC50"), "pec50": ("pEC50", "EC50"), "pki": ("pKi", "Ki"), "pkd": ("pKd", "Kd"), "pmic": ("pMIC", "MIC")}
#: Columns that hold a final activity, by plain name (fixed values).
FINAL = {"activityfinal": "activity_final", "activityscoremedian": "activity_score_median"}
#: Potency columns by plain name, with their endpoint (fixed values).
POTENCIES = {"ic50": "IC50", "ec50": "EC50", "ki": "Ki", "kd": "Kd", "mic": "MIC", "standardvalue": None, "value": None, "potency": None}
#: Label columns by plain name, in the order in which they are looked for (fixed values).
LABELS = ("activity", "activitycomment", "label", "class")
#: Columns that tell the public source's format (fixed values).
SOURCE_COLUMNS = ("molecule_chembl_id", "assay_chembl_id", "target_chembl_id", "pchembl_value", "standard_type", "standard_value", "standard_units", "activity_comment")
#: Names by role, in the order of preference (fixed values).
ROLES = {
    "target_column": ("target_chembl_id", "target", "target_id", "protein"), "assay_column": ("assay_chembl_id", "assay_id", "assay", "source"),
    "molecule_id_column": ("molecule_chembl_id", "compound_id", "molecule_id", "id"), "relation_column": ("standard_relation", "relation", "operator", "activity_relation"),
}
CLIFF_PREFIX = "activity_cliff_"


@dataclass(frozen=True)
class Mapping:
    """The columns that make up a dataset's activity; None where there is none."""

    smiles_column: str | None = None
    activity_column: str | None = None
    activity_kind: str | None = None
    activity_semantics: str | None = None
    source_format: str = "user_dataset"
    endpoint: str | None = None
    endpoint_column: str | None = None
    units_column: str | None = None
    detected_units: str | None = None
    relation_column: str | None = None
    target_column: str | None = None
    assay_column: str | None = None
    molecule_id_column: str | None = None
    score_name: str | None = None

    def to_dict(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v is not None}


def plain(name: str) -> str:
    return re.sub("[^a-z0-9]+", "", name.lower())


def find(columns: list[str], names) -> str | None:
    """The first column that has one of the names, by order of the names."""
    by = {}
    for c in columns:
        by.setdefault(plain(c), c)
    return next((by[plain(n)] for n in names if plain(n) in by), None)


def structure_column(columns: list[str], exact=STRUCTURES) -> str | None:
    """An exact name by preference, else the first column with smiles in its name."""
    return next((n for n in exact if n in columns), next((c for c in columns if "smiles" in c.lower()), None))


def resolve_structure(columns: list[str], requested: str = "smiles") -> str:
    """The requested column, one of that name in any case, or the structure column; else an error that names the columns."""
    if requested in columns:
        return requested
    same = next((c for c in columns if c.lower() == requested.lower()), None)
    found = same or structure_column(columns)
    if found is None:
        raise ValueError(f"no structure column {requested!r} among {columns}")
    return found


def units_in_name(name: str) -> str | None:
    """A unit that stands by itself in a column's name, normalized."""
    m = re.search("(?:^|[^a-zA-Z])(pM|nM|uM|µM|μM|mM|M)(?:$|[^a-zA-Z])", name)
    return m[1].lower().replace("µ", "u").replace("μ", "u") if m else None


def endpoint_of(name: str) -> str | None:
    own = plain(name)
    if own in P_SCALES:
        return P_SCALES[own][1]
    return next((e for k, e in POTENCIES.items() if e and k in own), None)


def units_column(columns: list[str], activity: str) -> str | None:
    return find(columns, (f"{activity}_units", f"{activity}_unit", "standard_units", "units", "unit", "activity_units", "value_units"))


def constant_unit(df: DataFrame, column: str | None) -> str | None:
    """The one normalized unit of a column, 'mixed' for several, None for none."""
    if column is None or column not in df.columns:
        return None
    two = df.select(normalize_unit(F.col(column)).alias("u")).where("u is not null").distinct().limit(2).collect()
    return None if not two else two[0].u if len(two) == 1 else "mixed"


def target_unit(names: list[str]) -> str | None:
    """A unit known from the names of dataset and targets."""
    text = " ".join(names).lower()
    return "unitless_log_scale" if any(t in text for t in ("lipophilicity", "logp", "logd")) else None


def source_format(columns: list[str]) -> str:
    return "chembl" if set(SOURCE_COLUMNS) & set(columns) else "user_dataset"


def _facts(df: DataFrame, columns: list[str]) -> dict[str, tuple[bool, bool]]:
    """For each column whether it holds numbers and whether it holds labels: one aggregation."""
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    text = {c: F.col(f"`{c}`").cast("string") for c in columns}
    numeric = [F.max(number(text[c]).isNotNull()).alias(f"n{k}") for k, c in enumerate(columns)]
    label = [F.max(parse_label(text[c]).isNotNull()).alias(f"l{k}") for k, c in enumerate(columns)]
    r = df.agg(*numeric, *label).first()
    return {c: (bool(r[f"n{k}"]), bool(r[f"l{k}"])) for k, c in enumerate(columns)}


def potency_column(df: DataFrame) -> str | None:
    """A potency column that holds numbers: by its plain name, else one with an endpoint in its name."""
    by = {}
    for c in df.columns:
        by.setdefault(plain(c), c)
    named = [by[k] for k in POTENCIES if k in by] + [c for c in df.columns if endpoint_of(c)]
    facts = _facts(df, named)
    return next((c for c in named if facts[c][0]), None)


def label_column(df: DataFrame) -> str | None:
    """The first label column, in the order of LABELS, that holds a label."""
    named = [c for c in (find(df.columns, [n]) for n in LABELS) if c]
    facts = _facts(df, named)
    return next((c for c in named if facts[c][1]), None)


def infer(df: DataFrame, smiles: str | None = None, activity: str | None = None) -> Mapping:
    """The activity of a dataset: the column asked for, a final one, a p-scale, a potency with its units, or a label."""
    columns = df.columns
    base = {"smiles_column": smiles if smiles in columns else structure_column(columns), "source_format": source_format(columns)}
    base |= {role: find(columns, names) for role, names in ROLES.items()}
    if activity in columns:
        found = _explicit(df, activity, base)
        if found.activity_kind:
            return found
    finals, scales = ([c for c in (find(columns, [n]) for n in names) if c] for names in (FINAL, P_SCALES))
    facts = _facts(df, finals + scales)
    for c in finals:
        if facts[c][0]:
            has = lambda n: n if n in columns else None
            return Mapping(**base, activity_column=c, activity_kind="regression", activity_semantics="higher_is_better", endpoint_column=has("activity_endpoint"), units_column=has("activity_units"), score_name=c)
    for c in scales:
        if facts[c][0]:
            score, endpoint = P_SCALES[plain(c)]
            return Mapping(**base, activity_column=c, activity_kind="regression", activity_semantics="higher_is_better", endpoint=endpoint, score_name=score)
    c = potency_column(df)
    if c:
        units, endpoint = units_column(columns, c), endpoint_of(c)
        return Mapping(
            **base, activity_column=c, activity_kind="regression", activity_semantics="lower_is_better", endpoint=endpoint, endpoint_column="standard_type" if "standard_type" in columns else None,
            units_column=units, detected_units=units_in_name(c) or constant_unit(df, units), score_name=f"p{endpoint}" if endpoint else "activity_score",
        )
    c = label_column(df)
    if c:
        return Mapping(**base, activity_column=c, activity_kind="classification", activity_semantics="label", score_name="activity_label")
    return Mapping(**base)


def _explicit(df: DataFrame, c: str, base: dict) -> Mapping:
    numeric, labels = _facts(df, [c])[c]
    own = plain(c)
    if labels and (own in LABELS or not numeric):
        return Mapping(**base, activity_column=c, activity_kind="classification", activity_semantics="label", score_name="activity_label")
    if not numeric:
        return Mapping(**base, activity_column=c)
    if own in P_SCALES:
        (score, endpoint), how = P_SCALES[own], "higher_is_better"
    elif own in POTENCIES or endpoint_of(c):
        score, endpoint, how = "activity_score", endpoint_of(c), "lower_is_better"
    else:
        score, endpoint, how = "activity", None, "higher_is_better"
    units = units_column(df.columns, c)
    return Mapping(**base, activity_column=c, activity_kind="regression", activity_semantics=how, endpoint=endpoint, units_column=units, detected_units=units_in_name(c) or constant_unit(df, units), score_name=score)


def activity(mapping: Mapping) -> Column:
    """The normalized activity: labels, values where higher is better, or potencies on the p-scale by their units."""
    if not mapping.activity_column or not mapping.activity_kind:
        raise ValueError("no activity column: p-scale columns, potencies with units or active/inactive labels are expected")
    c = F.col(f"`{mapping.activity_column}`")
    if mapping.activity_kind == "classification":
        return parse_label(c)
    if mapping.activity_semantics == "higher_is_better":
        return number(c.cast("string"))
    if mapping.units_column:
        return p_scale(number(c.cast("string")), F.col(f"`{mapping.units_column}`"))
    if mapping.detected_units and mapping.detected_units != "mixed":
        return p_scale(number(c.cast("string")), F.lit(mapping.detected_units))
    return F.lit(None).cast("double")


def with_activity(df: DataFrame, mapping: Mapping | None = None, name: str = "activity") -> DataFrame:
    """df with the normalized activity; without an activity column as it is."""
    mapping = mapping or infer(df)
    return df.withColumn(name, activity(mapping)) if mapping.activity_kind else df


def payload(mapping: Mapping) -> Column:
    """What is known of a row's activity as JSON without empty fields."""
    if not mapping.activity_column or not mapping.activity_kind:
        return F.lit(None).cast("string")
    value, text = activity(mapping), lambda c: F.col(f"`{c}`").cast("string")
    parts = {"source_column": F.lit(mapping.activity_column), "kind": F.lit(mapping.activity_kind), "semantics": F.lit(mapping.activity_semantics), "source_format": F.lit(mapping.source_format)}
    endpoint = [text(mapping.endpoint_column)] if mapping.endpoint_column else []
    parts["endpoint"] = F.coalesce(*endpoint, F.lit(mapping.endpoint))
    parts["value"] = F.col(f"`{mapping.activity_column}`")
    parts["units"] = text(mapping.units_column) if mapping.units_column else F.lit(mapping.detected_units)
    for key, c in (("relation", mapping.relation_column), ("target", mapping.target_column), ("assay_id", mapping.assay_column)):
        if c:
            parts[key] = text(c)
    if mapping.activity_kind == "classification":
        parts["label"] = value
    else:
        parts |= {"score": value, "score_name": F.when(value.isNotNull(), F.lit(mapping.score_name))}
    return F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]))


def preview(df: DataFrame, mapping: Mapping | None = None, order: list[str] | None = None, limit: int = 50) -> DataFrame:
    """The best compounds: one row for each structure (its best), best first, with the payload; nulls last, ties by order.

    Structures are reduced before anything is sorted, and the report is limited.
    """
    mapping = mapping or infer(df)
    if not mapping.smiles_column:
        raise ValueError("no structure column")
    order = order or sorted(df.columns)
    best = F.lit(None).cast("double")
    if mapping.activity_kind == "classification":
        best = F.when(activity(mapping) == "active", 1.0).when(activity(mapping) == "inactive", 0.0)
    elif mapping.activity_kind:
        best = activity(mapping)
    rows = df.where(F.col(mapping.smiles_column).isNotNull()).select(
        F.col(mapping.smiles_column).alias("smiles"), (F.col(mapping.molecule_id_column) if mapping.molecule_id_column else F.lit(None)).cast("string").alias("molecule_id"),
        best.alias("best"), payload(mapping).alias("activity"), F.struct(*order).alias("_o"),
    )
    rank = F.struct(F.col("best").isNull().alias("n"), (-F.col("best")).alias("b"), "_o")
    one = rows.groupBy("smiles").agg(F.min_by(F.struct("molecule_id", "best", "activity", "_o"), rank).alias("r")).select("smiles", "r.*")
    return one.orderBy(F.desc_nulls_last("best"), "_o").limit(limit).drop("_o")


def feature_columns(df: DataFrame, targets: list[str], smiles: str | None = None, wanted: list[str] | None = None) -> list[str]:
    """Numeric columns but targets, structures and cliff annotations; wanted ones are checked for that instead."""
    out = {smiles, *targets}
    if wanted:
        bad = [c for c in wanted if c in out or c.startswith(CLIFF_PREFIX)]
        missing = [c for c in wanted if c not in df.columns]
        if bad or missing:
            raise ValueError(f"no features: {bad}; missing: {missing}")
        return list(wanted)
    found = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in out and not f.name.startswith(CLIFF_PREFIX)]
    if not found:
        raise ValueError("no numeric feature columns")
    return found


def strip_prefix(df: DataFrame, prefix: str = CLIFF_PREFIX) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


#: Structure columns of model datasets and columns that are never targets (fixed values).
MODEL_STRUCTURES, NO_TARGETS = ("smiles", "SMILES", "Drug", "smi", "structure"), ("Drug_ID", "compound_id", "id", "ID")


def model_columns(df: DataFrame, task: str, smiles: str | None = None, targets: list[str] | None = None) -> dict:
    """Structure and target columns for modelling: the first numeric one, or for classes the first with 2 classes and at most max(20, a fifth of the rows)."""
    structure = smiles if smiles in df.columns else next((c for c in MODEL_STRUCTURES if c in df.columns), None)
    found = [c for c in targets or [] if c in df.columns]
    rest = [c for c in df.columns if c != structure and c not in NO_TARGETS]
    if not found and task == "classification":
        counts = df.agg(F.count("*").alias("_rows"), *[F.count_distinct(F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))).alias(c) for c in rest]).first()
        found = [c for c in rest if 2 <= counts[c] <= max(20, int(counts["_rows"] * 0.2))][:1]
    elif not found:
        found = [f.name for f in df.schema if f.name in rest and isinstance(f.dataType, T.NumericType)][:1]
    return {"task_type": task, "smiles_column": structure, "target_columns": found, "all_columns": list(df.columns), "ready": bool(structure and found)}


#: Columns that describe how something was measured, by patterns in their names (fixed values).
CONTEXT = {
    "assay_columns": "(assay|protocol|experiment|screen)",
    "ph_columns": "(^|_)(ph|p_h)(_|$)",
    "temperature_columns": "(temp|temperature)",
    "replicate_columns": "(replicate|replicates|repeat|n_repl|nrep)",
    "fit_quality_columns": "(fit_quality|fitscore|fit_score|curve_quality|r2_fit|hill_fit|dose_response_quality)",
    "cytotoxicity_columns": "(cytotox|cytotoxicity|cell_viability|viability)",
    "interference_columns": "(interference|artifact|fluorescence|quench|signal)",
    "time_columns": "(time|incubation)",
}


def measurement_context(columns: list[str], patterns: dict[str, str] = CONTEXT) -> dict[str, list[str]]:
    """Columns by what they tell of a measurement."""
    groups = {k: [c for c in columns if re.search(p, c, re.I)] for k, p in patterns.items()}
    return {k: v for k, v in groups.items() if v}


def feature_kind(name: str) -> str:
    """The kind of a feature by its prefix."""
    prefixes = (("fp_", "morgan_binary"), ("cfp_", "morgan_count"), ("desc_", "rdkit_descriptor"), ("chemprop_", "chemprop_embedding"), ("embedding_", "chemprop_embedding"))
    return next((kind for p, kind in prefixes if name.startswith(p)), "continuous")


def schema_hash(names: list[str], kinds: list[str] | None = None) -> str:
    """sha256 of feature names and kinds."""
    body = {"feature_kinds": kinds or [feature_kind(n) for n in names], "feature_names": list(names)}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def class_columns(columns: list[str]) -> dict[str, str]:
    """The probability and density columns of two classes: the named ones, else the first two prefixes that have both."""
    named = {f"{n}_{k}": f"{n}_class_{k}" for n in ("first", "second") for k in ("prob", "density")}
    if set(named.values()) <= set(columns):
        return named
    own = [c for c in columns if c not in ("density", "filtered_density")]
    both = sorted({c[:-5] for c in own if c.endswith("_prob")} & {c[:-8] for c in own if c.endswith("_density")})
    if len(both) < 2:
        raise ValueError("two classes with _prob and _density columns are needed")
    return {f"{n}_{k}": f"{p}_{k}" for n, p in zip(("first", "second"), both, strict=False) for k in ("prob", "density")}


def with_source(df: DataFrame, default: str | None = None) -> DataFrame:
    """A source column: the one there is, else the assay, else the default."""
    if "source" in df.columns:
        return df
    return df.withColumn("source", F.col("assay_chembl_id") if "assay_chembl_id" in df.columns else F.lit(default or "unknown"))


def compact(df: DataFrame) -> DataFrame:
    """Columns without arrays, maps, structs and bytes."""
    heavy = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    return df.select(*[f.name for f in df.schema if not isinstance(f.dataType, heavy)])


def ordered_columns(df: DataFrame, first: list[str]) -> DataFrame:
    """The columns of `first` that there are, then the others."""
    return df.select(*[c for c in first if c in df.columns], *[c for c in df.columns if c not in first])


#: Names of structure, cluster and activity columns for analyses, in the order of preference (fixed values).
ANALYSIS = {
    "smiles": ("smiles", "SMILES", "canonical_smiles", "standardized_smiles", "Smiles", "smi"), "cluster_id": ("node_index", "cluster_id", "cluster", "group", "class", "label", "node"),
    "activity": ("activity", "pIC50", "pKi", "pEC50", "standard_value", "IC50_nM", "value", "potency"),
}


def for_analysis(df: DataFrame, smiles: str | None = None, cluster: str | None = None, value: str | None = None) -> DataFrame:
    """smiles, cluster_id and activity under these names, rows without a structure left out; a value column with ic50 in its name, but not pic50, is taken for nM and put on the p-scale."""
    asked = {"smiles": smiles, "cluster_id": cluster, "activity": value}
    found = {k: asked[k] or next((n for n in names if n in df.columns), None) for k, names in ANALYSIS.items()}
    if not found["smiles"]:
        raise ValueError(f"no structure column among {df.columns}")
    own = {k: F.col(f"`{c}`") for k, c in found.items() if c}
    if "activity" in own:
        x = number(own["activity"].cast("string"))
        name = found["activity"].lower()
        own["activity"] = p_scale(x, F.lit("nm")) if "ic50" in name and "pic50" not in name else x
    rest = [F.col(f"`{c}`") for c in df.columns if c not in found.values() and c not in own]
    out = df.select(*[v.alias(k) for k, v in own.items()], *rest)
    return out.where(F.col("smiles").isNotNull() & (F.trim("smiles") != ""))


def projected_points(df: DataFrame) -> DataFrame:
    """Points of a map with x and y as numbers (others are an error when read), the structure as smi, and a source."""
    missing = [c for c in ("x", "y") if c not in df.columns]
    if missing:
        raise ValueError(f"points lack {missing}")
    out = df.withColumns({c: F.col(c).cast("double") for c in ("x", "y")})
    structure = structure_column(out.columns)
    out = out.withColumnRenamed(structure, "smi") if structure and structure != "smi" else out
    return with_source(out, "projected_compounds")


def grid_size(*frames: DataFrame) -> int:
    """The number of nodes of a square map by the greatest coordinate of any frame."""
    most = 1
    for df in frames:
        r = df.agg(F.ceil(F.max("x")).alias("x"), F.ceil(F.max("y")).alias("y")).first()
        most = max(most, int(r.x or 0), int(r.y or 0))
    return most * most
