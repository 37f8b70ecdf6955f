"""Result tables as views, for work in SQL text.

A view is only a name for a table's plan: nothing is read or written before a statement uses it, and Spark prunes what
the statement doesn't need.
"""

from pyspark.sql import DataFrame

from corrobora.plans import evidence_queries as evidence
from corrobora.plans.registry import query, with_ctes


def register_views(tables: dict[str, DataFrame], prefix: str = "") -> list[str]:
    """Every table under ``prefix`` plus its name, replacing a view of that name; the names are returned."""
    names = []
    for name, table in tables.items():
        table.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names


def drop_views(spark, names) -> None:
    for name in names:
        spark.catalog.dropTempView(name)


#: Written once and run on both sides: over the views here, over common table expressions in the SQL.
FINDINGS_BY_PARTY = """
SELECT f.party_key, f.kind, count(*) AS n_findings, count(DISTINCT f.member_key) AS n_members,
       count(CASE WHEN a.doe IS NULL THEN 1 END) AS n_open, min(w.earliest) AS first_evidence
FROM {findings} f
LEFT JOIN {asserted} a ON a.member_key = f.member_key AND a.party_key = f.party_key
LEFT JOIN {windows} w ON w.member_key = f.member_key AND w.party_key = f.party_key
GROUP BY f.party_key, f.kind"""


@query("findings_in_sql", with_ctes(evidence.FND, evidence.WIN, evidence.ASR)
       + FINDINGS_BY_PARTY.format(findings="fnd", asserted="asr", windows="win"))
def findings_in_sql(spark, folder):
    observations, parties, asserted = evidence.settled_parties(spark, folder)
    names = register_views({
        "findings": evidence.findings_of(spark, folder, (observations, asserted), parties), "asserted": asserted,
        "windows": evidence.envelopes.party_windows(parties)}, "corrobora_")
    told = spark.sql(FINDINGS_BY_PARTY.format(
        findings="corrobora_findings", asserted="corrobora_asserted", windows="corrobora_windows"))
    drop_views(spark, names)
    return told
