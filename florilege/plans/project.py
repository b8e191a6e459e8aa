"""A whole project from curated tables: evidence, features, summaries, pairs, audits, as named tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from florilege.operators import evidence as E
from florilege.operators import quality as Q
from florilege.operators import similarity as S
from florilege.session import table
from florilege.sources.tables import write_bundle


def plant_project(compounds: DataFrame, species_list: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """The tables of a project, all lazy; nothing runs until one is read or written."""
    graded = E.grade_evidence(compounds)
    membership = S.comparable_membership(compounds)
    return {
        "evidence_grades": graded,
        "evidence_summary": E.grade_summary(graded),
        "species_summary": E.species_summary(compounds),
        "species_metadata": E.species_metadata(graded, compounds, species_list),
        "features_scope": E.feature_long(compounds, "comparison_scope"),
        "features_group": E.feature_long(compounds, "comparison_group"),
        "membership": membership,
        "scope_pairs": S.comparable_pair_summary(pairs, membership, "comparison_scope"),
        "species_pairs": S.species_pair_summary(pairs),
        "table_issues": Q.table_issues(compounds, Q.OCCURRENCE_RULES),
        "table_quality": Q.table_quality(compounds, Q.OCCURRENCE_RULES),
    }


def run_project(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Read a data folder, write the bundle, return its manifest."""
    return write_bundle(plant_project(*(table(spark, folder, t) for t in ("plant_compounds", "plant_list", "plant_compound_pair_tanimoto"))), out)
