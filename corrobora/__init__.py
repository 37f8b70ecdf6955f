"""Record reconciliation on Spark: asserted intervals against dated evidence."""
