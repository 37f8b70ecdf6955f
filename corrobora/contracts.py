"""Column contracts of the tables that operators exchange."""

from pyspark.sql import DataFrame, types as T

CONTRACTS = {
    "documents": "member_key string, doc_id string, text string",
    "observations": (
        "member_key string, party_key string, obs_date date, source string, "
        "amount decimal(18,2), note string, ord bigint"),
    "asserted": (
        "member_key string, party_key string, account_id string, doj date, doe date, ord bigint"),
    "deductors": (
        "member_key string, doc_id string, block_no bigint, name string, tan string, "
        "total_paid decimal(18,2), total_tds decimal(18,2)"),
    "transactions": (
        "member_key string, doc_id string, block_no bigint, line_no int, section string, "
        "txn_date date, amount_paid decimal(18,2), tax_deducted decimal(18,2)"),
    "contributions": (
        "member_key string, doc_id string, account_id string, month date, employee decimal(18,2), "
        "employer decimal(18,2), pension decimal(18,2), line_no int"),
    "bank_rows": (
        "member_key string, doc_id string, line_no int, txn_date date, narration string, "
        "amount decimal(18,2), direction string"),
    "claims": (
        "member_key string, tracking_id string, form string, filed date, status string"),
    "establishments": (
        "name string, code string, covered boolean, coverage_from date, ord bigint"),
    "letters": (
        "member_key string, doc_id string, scope string, body string, annexure array<string>"),
    "ledger": (
        "member_key string, kind string, value string, scope string, source string"),
}


def require(df: DataFrame, contract: str) -> DataFrame:
    """Bring a table to its contract; a missing column fails while planning."""
    return df.to(T.StructType.fromDDL(CONTRACTS[contract]))
