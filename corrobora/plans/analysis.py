"""Documents of a whole population to findings, decisions and plans."""

from pyspark.sql import DataFrame, Window, functions as F

from corrobora import rules
from corrobora.contracts import CONTRACTS, require
from corrobora.operators import (
    corrections, detectors, envelopes, letters, linkage, money, orphans, people, planning, statements,
    verdicts,
)
from corrobora.session import cut_lineage
from corrobora.sources import corpus, passbooks, records
from corrobora.sources import statements as statement_source


def read_documents(documents: DataFrame) -> dict:
    """Every table the documents hold, before anything is concluded from them."""
    classified = corpus.classify_documents(documents)

    def of(kind):
        return classified.filter(F.col("kind") == kind).drop("kind")

    deductors, transactions = statement_source.statement_tables(of("26as"))
    heads, contributions = passbooks.passbook_tables(of("passbook"))
    heads = heads.withColumn("file_ord", F.col("doc_id"))
    # the text is read once per kind; what it says is small next to it and written once
    bank = cut_lineage(records.bank_table(of("bank")))
    history = cut_lineage(records.service_history_table(of("service_history")))
    names = cut_lineage(records.extract_names(classified))
    return {
        "documents": classified, "coverage": corpus.evidence_coverage(classified),
        "deductors": deductors, "transactions": transactions,
        "problems": statements.verify_statements(deductors, transactions),
        "merged_deductors": statements.merge_deductors(deductors),
        "passbook_heads": heads, "contributions": contributions,
        "passbooks": cut_lineage(statements.merge_passbooks(heads, contributions)),
        "related_ids": statements.related_ids(heads),
        "history": history,
        "bank_rows": bank, "credits": records.classify_credits(bank),
        "names": names, "name_check": cut_lineage(people.name_check(names)),
        "identity": cut_lineage(records.extract_identity(classified, heads)),
    }


def in_reading_order(history: DataFrame) -> DataFrame:
    """``ord`` numbers a member's record rows by document and line, without ties.

    Rows are numbered inside their document; only one row per document crosses the member.
    """
    inside = Window.partitionBy(*corpus.DOC).orderBy("line_no")
    earlier = Window.partitionBy("member_key").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = history.groupBy(*corpus.DOC).agg(F.count(F.lit(1)).alias("_rows")).select(
        *corpus.DOC, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    return (
        history.withColumn("_place", F.row_number().over(inside) - 1).join(offsets, corpus.DOC)
        .withColumn("ord", (F.col("_offset") + F.col("_place")).cast("bigint")).drop("_offset", "_place"))


def build_evidence(read: dict) -> dict:
    """Parties, observations and the asserted record, carried to common keys."""
    parties, links = linkage.resolve_parties(
        read["passbooks"].select("member_key", "account_id", "establishment"),
        read["merged_deductors"].select("member_key", "tan", "name"))

    def placed(source_no, *parts):
        """Reading order: tax rows, then contributions, then bank rows."""
        order = F.lit(source_no << 56)
        for width, part in parts:
            order = order + F.shiftleft(F.col(part).cast("bigint"), width)
        return order

    tax = statements.to_parties(
        statements.merged_transactions(read["deductors"], read["transactions"]), links, "tan"
    ).withColumn("ord", placed(0, (24, "block_no"), (0, "line_no")))
    months = statements.to_parties(
        read["contributions"].select("member_key", "account_id", "month").distinct(),
        links, "account_id").withColumn("ord", placed(1))
    credits = linkage.attribute_credits(
        read["credits"].filter("is_salary"), parties.withColumnRenamed("at", "ord")
    ).withColumn("ord", placed(2, (0, "line_no")))
    observations = statements.observations_of(tax, months, credits)
    asserted = statements.to_parties(in_reading_order(read["history"]), links, "account_id").select(
        "member_key", "party_key", "account_id", "doj", "doe", "ord")
    # read by every detector, so written once
    return {"parties": parties, "links": links,
            "observations": cut_lineage(observations), "asserted": cut_lineage(asserted)}


def reconcile(observations: DataFrame, asserted: DataFrame, as_of, history: DataFrame = None) -> dict:
    """Findings and everything that follows from evidence and record alone."""
    history = asserted if history is None else history
    days = cut_lineage(envelopes.evidence_days(observations))
    windows = envelopes.support_windows(days)
    found = detectors.all_findings(observations, asserted, as_of, days)
    found = cut_lineage(verdicts.suppress_without_history(found, history))
    return {
        "days": days, "windows": windows, "findings": found,
        "confidence": envelopes.evidence_confidence(windows),
        "corrected": detectors.corrected_timeline(asserted, windows, as_of),
        "reconstructed": envelopes.reconstruct(days, asserted, history),
        "timeline": envelopes.timeline_segments(days, asserted, as_of),
    }


def decide(read: dict, evidence: dict, outcome: dict, members: DataFrame, establishments: DataFrame,
           as_of, closed: DataFrame = None) -> dict:
    """Gates, plans and money, from what was read and found."""
    found, asserted = outcome["findings"], evidence["asserted"]
    lost = detectors.orphans(outcome["windows"], asserted).join(
        read["history"].select("member_key").distinct(), "member_key", "left_semi")
    candidates = orphans.orphan_candidates(evidence["observations"], lost).join(
        evidence["parties"].select("member_key", "party_key", "name"), envelopes.PARTY)
    register = linkage.resolve_establishments(candidates.select("name").distinct(), establishments)
    assessed = cut_lineage(orphans.assess_orphans(
        candidates.join(register, "name", "left"), as_of))

    totals = statements.member_totals(members, read["passbooks"], assessed)
    flags = verdicts.checked_flags(outcome["days"], read["history"], members)
    likely = assessed.filter(F.col("verdict") == "LIKELY").groupBy("member_key").agg(
        F.count(F.lit(1)).alias("likely_orphans"))
    status = verdicts.claim_status(found, members, read["history"])
    facts = (
        members.select("member_key")
        .join(read["identity"], "member_key", "left").join(totals, "member_key")
        .join(flags, "member_key").join(likely, "member_key", "left")
        .join(read["name_check"].select("member_key", "same_person", "n_spellings"), "member_key", "left")
        .fillna(0, ["likely_orphans", "n_spellings", "n_dobs"])
        .withColumn("name_status", F.when(F.col("same_person"), "pass").when(
            F.col("same_person").isNotNull(), "fail"))
        .withColumn("has_pan", F.col("pan").isNotNull())
    )
    kyc = money.kyc_items(facts)
    gate_rows = planning.gates(facts, found)
    summary = planning.gate_summary(gate_rows)
    steps = planning.plan_steps(found, closed)
    plans = planning.plan_summary(steps, members)
    exits = envelopes.self_exit_window(outcome["reconstructed"], as_of)
    settling = (
        facts.join(status, "member_key").join(money.kyc_summary(kyc), "member_key")
        .withColumn("kyc_risk", ~F.col("kyc_ready")).withColumn("checked", F.col("dates_checked"))
        .withColumn("amount", F.lit(None).cast("decimal(18,2)")))
    salary = F.lit(rules.PENSION_SALARY_CAP).cast("decimal(18,2)")
    return {
        "status": status, "flags": flags, "totals": totals,
        "timeline_only": verdicts.timeline_only(
            members, read["passbook_heads"], read["history"], read["deductors"]), "orphans": assessed,
        "recovery": orphans.recovery_steps(assessed),
        "accounts": statements.account_list(read["passbooks"], assessed),
        "gates": gate_rows, "gate_summary": summary, "plan_steps": steps, "plan_summary": plans,
        "next_step": planning.next_step(steps, flags, gate_rows), "self_exit": exits,
        "kyc": kyc, "settlement": money.settlement_verdicts(settling),
        "withdrawals": money.withdrawal_estimates(facts),
        "pensions": money.pension_estimates(facts.withColumn("pensionable_salary", salary)),
        "claim_forms": money.claim_form_status(summary.join(flags, "member_key")),
        "worklist": statements.worklist(read["deductors"], read["transactions"], read["history"]),
        "supporting_facts": letters.supporting_facts(
            found, asserted, evidence["observations"], outcome["corrected"],
            read["identity"].select("member_key", "uan")),
    }


def report(documents: DataFrame, read: dict, evidence: dict, outcome: dict, decided: dict, members: DataFrame,
           as_of, claims: DataFrame, letter_texts: DataFrame = None) -> dict:
    """What is shown beside the decisions: evidence of findings, summaries, past claims and checked letters."""
    found, asserted = outcome["findings"], evidence["asserted"]
    months = read["contributions"].groupBy(*corpus.DOC).agg(F.count_distinct("month").alias("months"))
    files = read["passbook_heads"].select(*corpus.DOC).join(months, corpus.DOC, "left").fillna(0, ["months"])
    bank = read["bank_rows"].join(
        read["credits"].select(*corpus.DOC, "line_no", "is_salary"), [*corpus.DOC, "line_no"], "left"
    ).fillna(False, ["is_salary"])
    tables = {
        "corpus_profile": corpus.corpus_profile(documents),
        "ingest_summary": statements.ingest_summary(
            members, read["deductors"], read["transactions"], read["problems"], files, read["history"],
            bank),
        "ordered_findings": verdicts.order_findings(found),
        "finding_evidence": detectors.finding_evidence(
            found, evidence["observations"], outcome["days"], asserted, outcome["windows"], as_of),
        "blocking_per_party": verdicts.blocking_per_party(
            found, evidence["parties"].select("member_key", "party_key")),
        "last_contributions": statements.last_contributions(read["contributions"]),
        "passbook_flags": statements.passbook_flags(read["passbooks"], asserted),
        "audit": verdicts.audit(found, decided["status"]),
        "withdrawal_portfolio": money.withdrawal_portfolio(decided["withdrawals"]),
        "rejections": corrections.diagnose_rejections(claims, found),
        "notifications": planning.notification_events(
            decided["gate_summary"], decided["plan_summary"], decided["self_exit"], claims, as_of),
    }
    if letter_texts is not None:
        tables["letter_problems"] = letters.lint_letters(
            require(letter_texts, "letters"), require(decided["supporting_facts"], "ledger"))
    return tables


def analyse(documents: DataFrame, as_of, establishments: DataFrame, closed: DataFrame = None,
            claims: DataFrame = None, letter_texts: DataFrame = None) -> dict:
    """documents(member_key, doc_id, text) to every result table, by name.

    ``claims`` are filed claims to be explained, ``letter_texts`` letters to be checked; both may be missing.
    """
    documents = require(documents, "documents")
    claims = (documents.sparkSession.createDataFrame([], CONTRACTS["claims"]) if claims is None
              else require(claims, "claims"))
    establishments = require(establishments, "establishments")
    read = read_documents(documents)
    evidence = build_evidence(read)
    outcome = reconcile(evidence["observations"], evidence["asserted"], as_of, read["history"])
    members = documents.select("member_key").distinct()
    decided = decide(read, evidence, outcome, members, establishments, as_of, closed)
    return {**read, **evidence, **outcome, **decided,
            **report(documents, read, evidence, outcome, decided, members, as_of, claims, letter_texts)}


def what_if(analysis: dict, proposals: DataFrame, as_of, establishments: DataFrame,
            closed: DataFrame = None) -> dict:
    """The same plan over the record with ready proposals in place, for the members they touch only."""
    checks = corrections.check_proposals(proposals, analysis["asserted"], analysis["days"])
    state = corrections.proposal_state(proposals, checks)
    ready = state.filter(F.col("state") == "ready")
    touched = cut_lineage(ready.select("member_key").distinct())
    # cut down before the detectors read anything
    before = {name: df.join(touched, "member_key", "left_semi") if "member_key" in df.columns else df
              for name, df in analysis.items()}
    asserted = cut_lineage(corrections.overlay(before["asserted"], ready))
    outcome = reconcile(before["observations"], asserted, as_of, before["history"])
    after = decide(before, {**before, "asserted": asserted}, outcome, touched, establishments, as_of, closed)
    return {
        "checks": checks, "state": state, "findings": outcome["findings"],
        "cleared": corrections.gates_cleared(before["gates"], after["gates"], ready)}
