"""Secret scans with corpus-wide ownership frequency.

Three base kinds are found by pattern. Beside them, long unlabelled strings of mixed characters are candidates. All
candidates are hashed and aggregated over the corpus by the distinct repositories and owners that hold them: a string
that many owners share is an example that people copy (or no secret at all); one that stays with its owner looks live.
Base findings are always reported; the frequency gives each its class. An unlabelled candidate is reported (kind
``unlabelled``) only if it is owner-specific, or if it is the value that a labelled finding elsewhere in the corpus
gives away.

Everything is a column expression: ``split`` and ``regexp_extract_all`` with one pattern give gaps and matches in turn,
and the running sum of their lengths gives the offsets in code points.

Null and empty cases: a null text is empty and has no findings; a null owner or repository counts as one value of its
own; rows may repeat, and each is reported; an empty table gives an empty result. Other columns play no part.
"""

from pyspark.sql import Column, DataFrame, functions as F

from corrobora.llm.tables import packed, whole_text
from corrobora.session import cut_lineage

ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: A run of at least this many characters of keys, not inside a longer run.
LOOSE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "unlabelled")
LEAST_VALUE = 6    # characters of an assigned value
MOST_OWNERS = 2    # of a live-looking credential; more owners: an example that is copied
MOST_REPOSITORIES = 4


def located(text: Column, pattern: str, group=0) -> Column:
    """array<struct<start, end, value>> of the non-overlapping matches, offsets in code points."""
    gaps = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    steps = F.zip_with(
        F.slice(F.transform(gaps, F.length), 1, F.size(matches)), F.arrays_zip(matches.alias("m"), values.alias("v")),
        lambda gap, found: F.struct(gap.alias("gap"), found["m"].alias("m"), found["v"].alias("v")))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def add(done, step):
        at = F.when(F.size(done) > 0, F.element_at(done, -1)["end"]).otherwise(F.lit(0)) + step["gap"]
        return F.concat(done, F.array(F.struct(
            at.alias("start"), (at + F.length(step["m"])).alias("end"), step["v"].alias("value"))))
    return F.when(text.rlike(pattern), F.aggregate(steps, none, add)).otherwise(none)


def of_kind(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), x["value"].alias("value")))


def candidates(text: Column) -> Column:
    """All candidates of a text: array<struct<start, rank, end, value>>, by start, then kind."""
    assigned = F.when(text.rlike("[:=]"), F.filter(
        located(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= LEAST_VALUE)).otherwise(
        F.array().cast("array<struct<start:int,end:int,value:string>>"))
    loose = F.filter(
        located(text, LOOSE),
        lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]"))
    return F.array_sort(F.concat(
        of_kind(assigned, 0), of_kind(located(text, ACCESS), 1), of_kind(located(text, HEX), 2), of_kind(loose, 3)))


def listed(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(kinds, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scanned(docs: DataFrame, owner: Column, repository: Column, keep: Column) -> DataFrame:
    """Written once: (row, kept, owner, repository, found) with ``found`` the candidates and their value's hash."""
    text = docs.select(
        keep.alias("kept"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"),
        candidates(whole_text()).alias("found"))
    return cut_lineage(text.select(
        F.monotonically_increasing_id().alias("row"), "kept", "owner", "repository",
        F.transform("found", lambda x: F.struct(
            x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"),
            F.sha2(x["value"], 256).alias("hash"))).alias("found")))


def ownership(rows: DataFrame, most_owners=MOST_OWNERS, most_repositories=MOST_REPOSITORIES) -> DataFrame:
    """Per candidate hash: distinct owners and repositories, whether a base kind names it, and its class.

    Rows are summed per hash, owner and repository before anything moves, so a string in a third of all documents is
    one row per task; the distinct counts then work on one row per hash, owner and repository.
    """
    held = (
        rows.filter(F.size("found") > 0)
        .select("owner", "repository", F.explode("found").alias("x"))
        .groupBy(F.col("x.hash").alias("hash"), "owner", "repository")
        .agg(F.count(F.lit(1)).alias("n"), F.min("x.rank").alias("rank"))
    )
    some = lambda c: F.struct(F.col(c).isNull().alias("none"), F.coalesce(c, F.lit("")).alias("name"))
    per_owner = held.groupBy("hash", "owner").agg(
        F.sum("n").alias("n"), F.min("rank").alias("rank"), F.countDistinct(some("repository")).alias("own"))
    # a repository of two owners is two repositories
    return per_owner.groupBy("hash").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_owners"), F.sum("own").alias("n_repositories"),
        F.min("rank").alias("best")).withColumn(
        "live", (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories))


def judged(rows: DataFrame, most_owners=MOST_OWNERS, most_repositories=MOST_REPOSITORIES) -> DataFrame:
    """(row, kept, spans): each row's reported findings with their class, rows without any included.

    Only rows with candidates are taken apart; they meet the frequencies by hash (a frequent hash is split by adaptive
    execution) and come together again by row.
    """
    parts = rows.filter(F.size("found") > 0).select("row", F.explode("found").alias("x"))
    known = ownership(rows, most_owners, most_repositories).select("hash", "live", "best", "n_owners")
    told = (
        parts.select("row", "x", F.col("x.hash").alias("hash")).join(known, "hash")
        .filter((F.col("x.rank") < 3) | F.col("live") | (F.col("best") == 0))
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
            F.col("x.start").alias("start"), F.col("x.rank").alias("rank"), F.col("x.end").alias("end"),
            "live", "n_owners"))).alias("spans"))
    )
    none = F.array().cast(told.schema["spans"].dataType)
    # rows without candidates never move
    return (
        rows.filter(F.size("found") == 0).select("row", "kept", none.alias("spans"))
        .unionByName(rows.filter(F.size("found") > 0).join(told, "row", "left")
                     .select("row", "kept", F.coalesce("spans", none).alias("spans")))
    )


def named(column: str | Column) -> Column:
    return column if isinstance(column, Column) else F.col(column)


def secret_spans(docs: DataFrame, owner="source", repository=None, **limits) -> DataFrame:
    """One row per document: doc_id and spans, array<struct<start, rank, end, live, n_owners>>.

    ``owner`` and ``repository`` are names of columns or expressions.
    """
    rows = scanned(docs, named(owner), named(owner if repository is None else repository), F.col("doc_id"))
    return judged(rows, **limits).select(F.col("kept").alias("doc_id"), "spans")


def digest(found: DataFrame) -> DataFrame:
    """Counts and offsets per document from ``secret_spans``."""
    base = F.filter("spans", lambda x: x["rank"] < 3)
    n = lambda test: F.size(F.filter("spans", test)).cast("long")
    return found.select(
        "doc_id", n(lambda x: x["rank"] == 0).alias("n_assign"), n(lambda x: x["rank"] == 1).alias("n_access"),
        n(lambda x: x["rank"] == 2).alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), n(lambda x: x["live"]).alias("n_live"),
        n(lambda x: ~x["live"]).alias("n_copied"))


def redacted(docs: DataFrame, owner="source", repository=None, **limits) -> DataFrame:
    """The documents with every finding replaced by a mark, overlapping ones by one mark; n_chars follows.

    A live-looking credential becomes ``<SECRET>``, a widely copied one ``<EXAMPLE>``. Texts without findings stay.
    """
    rows = judged(scanned(docs, named(owner), named(owner if repository is None else repository), packed(docs)), **limits)
    text = F.col("kept.text")

    def paint(state, x):
        fresh = x["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], x["end"]).alias("at"),
            F.when(fresh, F.concat(
                state["out"], text.substr(state["at"] + 1, x["start"] - state["at"]),
                F.when(x["live"], F.lit("<SECRET>")).otherwise(F.lit("<EXAMPLE>")))).otherwise(state["out"]).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("spans", start, paint, lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text))))
    fresh = F.when(F.size("spans") > 0, clean).otherwise(text)
    columns = {"text": fresh}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.size("spans") > 0, F.length(fresh).cast(docs.schema["n_chars"].dataType)).otherwise(
            F.col("kept.n_chars"))
    return rows.select(*[columns.get(c, F.col(f"kept.`{c}`")).alias(c) for c in docs.columns])
