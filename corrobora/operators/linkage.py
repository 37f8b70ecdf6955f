"""Organisations linked across spellings.

All pairs that can reach the link threshold are found by equality joins:

* A pair whose leading tokens all agree is found by those tokens. When one name
  is that prefix itself, the join pairs it with the names it begins, and there
  is exactly one such token sequence per prefix.
* Any other pair has head agreement of at most 0.8 and so needs a Jaccard index
  of 0.4 or more. Two sets of sizes m and n then share at least
  ceil(2(m+n)/7) tokens, so among the rarest tokens of each (as many as its
  size leaves over that number, plus one) at least one is common. A frequent
  word therefore becomes a join key only for names made of little else.

Only distinct token sequences are joined, never rows.
"""

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from corrobora import rules
from corrobora.functions.names import employer_tokens
from corrobora.session import cut_lineage


@F.pandas_udf(T.DoubleType())
def first_token_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, once per distinct pair in the batch; null stays null."""
    known = {}

    def ratio(pair):
        if pair not in known:
            known[pair] = None if None in pair else SequenceMatcher(None, *pair).ratio()
        return known[pair]
    return pd.Series([ratio(p) for p in zip(left, right)], dtype="float64")


def _sequences(names: DataFrame, within) -> DataFrame:
    return names.select(*within, employer_tokens("name").alias("tokens")).filter(
        F.size("tokens") > 0).distinct()


def _head_keys(sequences, within, left):
    """Keys by leading tokens: E/P pair a whole short name with the names it begins."""
    size, tokens = F.size("tokens"), F.col("tokens")

    def key(tag, n, condition):
        return F.when(condition, F.concat_ws("\u0001", F.lit(tag), F.slice(tokens, 1, n)))

    whole, begins = ("E", "P") if left else ("P", "E")
    keys = F.array_compact(F.array(
        key(whole + "1", 1, size == 1), key(whole + "2", 2, size == 2),
        key(begins + "1", 1, size >= 1), key(begins + "2", 2, size >= 2),
        key("H3", 3, size >= 3)))
    return sequences.select(*within, "tokens", F.explode(keys).alias("key"))


def _rare_keys(sequences, frequency, within, left):
    """Keys by rare tokens and both set sizes."""
    exploded = sequences.select(*within, "tokens", F.explode(F.array_distinct("tokens")).alias("token"))
    ranked = (
        exploded.join(frequency, "token")
        .groupBy(*within, "tokens")
        .agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("rare"))
    )
    size = F.size("rare")
    partner = F.explode(F.sequence(F.ceil(size * 2 / 5).cast("int"), F.floor(size * 5 / 2).cast("int")))
    needed = F.floor((2 * (F.col("size") + F.col("partner")) + 6) / 7)
    sizes = ["size", "partner"] if left else ["partner", "size"]
    return (
        ranked.select(*within, "tokens", "rare", size.alias("size"), partner.alias("partner"))
        .select(*within, "tokens", *sizes, F.explode(F.slice(
            "rare", F.lit(1), F.greatest(F.col("size") - needed + 1, F.lit(0)).cast("int"))).alias("r"))
        .select(*within, "tokens",
                F.concat_ws("\u0001", F.lit("J"), *sizes, F.col("r.token")).alias("key"))
    )


def candidate_sequences(left: DataFrame, right: DataFrame, within=(), repeats=False) -> DataFrame:
    """Every pair of token sequences that may link, found without comparing all pairs.

    With ``repeats`` a pair may come once per key it shares, and no shuffle of pairs is needed.
    """
    return _candidates(_sequences(left, within), _sequences(right, within), list(within), repeats)


def _candidates(a: DataFrame, b: DataFrame, within, repeats) -> DataFrame:
    frequency = (
        a.select("tokens").unionByName(b.select("tokens")).select(F.explode(F.array_distinct("tokens")).alias("token"))
        .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    keys_a = _head_keys(a, within, True).unionByName(_rare_keys(a, frequency, within, True))
    keys_b = _head_keys(b, within, False).unionByName(_rare_keys(b, frequency, within, False))
    pairs = (
        keys_a.withColumnRenamed("tokens", "tokens_a")
        .join(keys_b.withColumnRenamed("tokens", "tokens_b"), [*within, "key"])
        .select(*within, "tokens_a", "tokens_b"))
    return pairs if repeats else pairs.distinct()


def score_sequences(pairs: DataFrame) -> DataFrame:
    """Score of token sequences tokens_a against tokens_b (both may be empty)."""
    a, b = F.col("tokens_a"), F.col("tokens_b")
    n = F.least(F.size(a), F.size(b), F.lit(rules.HEAD_TOKENS))
    hits = F.size(F.filter(
        F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y), lambda e: e))
    common, either = F.array_intersect(a, b), F.array_union(a, b)
    splitters = F.array([F.lit(w) for w in rules.DISCRIMINATORS])
    one_sided = F.array_sort(F.array_intersect(F.array_except(either, common), splitters))
    measured = (
        pairs.withColumn("n", n).withColumn("hits", hits)
        .withColumn("jaccard", F.coalesce(F.try_divide(F.size(common), F.size(either)), F.lit(0.0)))
        .withColumn("one_sided", one_sided)
        .withColumn("first", F.when(
            (F.col("hits") < F.col("n")),
            F.when(F.get(a, F.lit(0)) == F.get(b, F.lit(0)), F.lit(1.0))))
        .withColumn("fuzzy", first_token_similarity(
            F.when((F.col("hits") < F.col("n")) & F.col("first").isNull(), F.get(a, F.lit(0))),
            F.when((F.col("hits") < F.col("n")) & F.col("first").isNull(), F.get(b, F.lit(0)))))
    )
    head = (
        F.when(F.col("n") == 0, 0.0).when(F.col("hits") == F.col("n"), 1.0)
        .otherwise(F.greatest(
            F.col("hits") / F.col("n"),
            F.coalesce("first", "fuzzy", F.lit(0.0)) * rules.FIRST_TOKEN_WEIGHT)))
    raw = F.greatest(
        F.lit(0.0),
        F.lit(rules.JACCARD_WEIGHT) * F.col("jaccard") + F.lit(rules.HEAD_WEIGHT) * F.col("head")
        - F.lit(rules.DISCRIMINATOR_PENALTY) * F.size("one_sided"))
    linked = F.col("raw") >= rules.LINK_THRESHOLD
    return (
        measured.withColumn("head", head)
        .withColumn("raw", F.when(F.col("n") == 0, 0.0).otherwise(raw))
        .withColumn("linked", linked)
        .withColumn("score", F.round("raw", 3))
        .withColumn("reason", F.when(F.col("n") == 0, "empty").when(F.col("linked"), "linked")
                    .when(F.size("one_sided") > 0, "discriminator").otherwise("below threshold"))
        .drop("n", "hits", "first", "fuzzy", "raw")
    )


def score_pairs(pairs: DataFrame, a="a", b="b") -> DataFrame:
    """E2 for given name pairs; each distinct pair is scored once."""
    names = pairs.select(a, b).distinct().withColumn("tokens_a", employer_tokens(a)).withColumn(
        "tokens_b", employer_tokens(b))
    sequences = score_sequences(names.select("tokens_a", "tokens_b").distinct())
    return pairs.join(
        names.join(sequences, ["tokens_a", "tokens_b"]).drop("tokens_a", "tokens_b"), [a, b])


def employer_pairs(left: DataFrame, right: DataFrame, within=()) -> DataFrame:
    """Linked pairs of names from two lists, each with a ``name`` column."""
    within = list(within)

    def spelled(names, side):
        return names.select(*within, F.col("name").alias(f"name_{side}"),
                            employer_tokens("name").alias(f"tokens_{side}")).distinct()

    scored = score_sequences(candidate_sequences(left, right, within)).filter("linked")
    return (
        scored.join(spelled(left, "a"), [*within, "tokens_a"])
        .join(spelled(right, "b"), [*within, "tokens_b"])
        .drop("tokens_a", "tokens_b")
    )


# sizes of token sets for which equal sets and heads are the only way to a score that rounds to 1
FULL_SCORE_SIZES = (3, 800)


def best_links(names: DataFrame, register: DataFrame, payload, within=()) -> DataFrame:
    """Top-1 of J9: ``within``, name, score and ``payload`` of the best linked register row; names without a link are absent.

    ``names``: ``within``, name; ``register``: ``within``, name, ord, ``payload``. The higher score (3 decimals) wins,
    then the lower ord. A null name or one without identifying words links with nothing.

    Each token sequence of the register is reduced to its first row, and each distinct sequence of the names is searched
    once. A score of 1 can't be beaten: names with the token set and the three leading tokens of a register row are
    settled by one equality join, so names that share a head but are registered as they stand never meet each other.
    The others are scored in the task that joins them, and only each task's best goes on.
    """
    within = list(within)
    tokens = F.col("tokens")
    named = names.filter(F.col("name").isNotNull()).select(*within, "name").distinct().withColumn(
        "tokens", employer_tokens("name"))
    wanted = cut_lineage(named.filter(F.size("tokens") > 0))
    first_rows = cut_lineage(
        register.select(*within, employer_tokens("name").alias("tokens"), "ord", F.struct(*payload).alias("_row"))
        .filter(F.size("tokens") > 0).groupBy(*within, "tokens")
        .agg(F.min("ord").alias("ord"), F.min_by("_row", "ord").alias("_row")))

    def exact(df):
        return df.withColumn("_set", F.array_sort(F.array_distinct(tokens))).withColumn(
            "_head", F.slice(tokens, 1, rules.HEAD_TOKENS)).filter(F.size("_set").between(*FULL_SCORE_SIZES))

    same = [*within, "_head", "_set"]
    full = exact(first_rows).groupBy(*same).agg(F.min_by("_row", "ord").alias("_row"))
    sequences = wanted.select(*within, "tokens").distinct()
    settled = cut_lineage(exact(sequences).join(full, same).select(*within, "tokens", F.lit(1.0).alias("score"), "_row"))
    rest = cut_lineage(sequences.join(settled.select(*within, "tokens"), [*within, "tokens"], "left_anti"))
    pairs = _candidates(rest, first_rows, within, repeats=True)
    scored = score_sequences(pairs).filter("linked").join(
        first_rows.withColumnRenamed("tokens", "tokens_b"), [*within, "tokens_b"])
    found = scored.groupBy(*within, F.col("tokens_a").alias("tokens")).agg(
        F.min_by(F.struct("score", "_row"), F.struct(-F.col("score"), "ord")).alias("_best")).select(
        *within, "tokens", "_best.score", "_best._row")
    return wanted.join(settled.unionByName(found), [*within, "tokens"]).select(*within, "name", "score", "_row.*")


def resolve_establishments(names: DataFrame, establishments: DataFrame) -> DataFrame:
    """Best linked entry of the register per name; the earlier entry wins ties.

    ``names`` has a ``name`` column, ``establishments`` name, code, covered,
    coverage_from, ord. Names without a link are kept with nulls.
    """
    register = establishments.select("name", "ord", F.col("name").alias("est_name"), F.col("code").alias("est_code"),
                                     "covered", "coverage_from")
    best = best_links(names, register, ["est_name", "est_code", "covered", "coverage_from"])
    return names.select("name").distinct().join(best, "name", "left").select(
        "name", "est_name", "est_code", "covered", "coverage_from", "score")


def attribute_credits(credits: DataFrame, parties: DataFrame) -> DataFrame:
    """The party that paid a credit, by its hint, else by the whole narration, else dropped.

    ``parties``: member_key, party_key, name, ord (any orderable column; the first
    party wins ties).
    """
    def best(column):
        texts = credits.select("member_key", F.col(column).alias("name"))
        return best_links(texts, parties, ["party_key"], ["member_key"]).select(
            "member_key", F.col("name").alias(column), F.col("party_key").alias(f"by_{column}"))

    return (
        credits.join(best("hint"), ["member_key", "hint"], "left")
        .join(best("narration"), ["member_key", "narration"], "left")
        .withColumn("party_key", F.coalesce("by_hint", "by_narration"))
        .filter(F.col("party_key").isNotNull())
        .drop("by_hint", "by_narration")
    )


def components(nodes: DataFrame, edges: DataFrame, within, node="node") -> DataFrame:
    """Connected components: the smallest node of each component as its label.

    Labels spread to neighbours and then jump to their label's label, so the
    number of rounds grows with the logarithm of the longest chain. Each round
    is checkpointed, since plans of earlier rounds would pile up.
    """
    both = edges.select(*within, "src", "dst").union(edges.select(*within, "dst", "src")).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(nodes.select(*within, F.col(node).alias("node")).distinct()
                         .withColumn("label", F.col("node")))
    while True:
        nearest = (
            both.join(labels.withColumnRenamed("node", "dst"), [*within, "dst"])
            .groupBy(*within, F.col("src").alias("node")).agg(F.min("label").alias("near")))
        spread = labels.join(nearest, [*within, "node"], "left").select(
            *within, "node", F.col("label").alias("old"),
            F.least("label", "near").alias("label"))
        parents = spread.select(*within, F.col("node").alias("label"), F.col("label").alias("up"))
        moved = cut_lineage(spread.join(parents, [*within, "label"], "left").select(
            *within, "node", "old", F.least("label", "up").alias("label")))
        labels = moved.drop("old")
        if moved.filter(F.col("old") != F.col("label")).isEmpty():
            return labels.withColumnRenamed("node", node)


def resolve_parties(accounts: DataFrame, deductors: DataFrame):
    """One party per organisation of a member, whatever each document calls it.

    ``accounts``: member_key, account_id, establishment; ``deductors``:
    member_key, tan, name. Returns (parties, links): parties carry the longest
    rendering as name; links map account ids and TANs to party keys. A key that
    several parties of a member would claim is extended by the party's own name,
    so (member_key, party_key) is unique.
    """
    code = F.substring("account_id", 1, 15)
    mentions = (
        accounts.filter(F.col("account_id").isNotNull()).select(
            "member_key", F.coalesce("establishment", F.concat(F.lit("Establishment "), code)).alias("name"),
            F.col("account_id").alias("id"), F.lit(0).alias("rank"), code.alias("key"))
        .unionByName(deductors.select(
            "member_key", "name", F.col("tan").alias("id"), F.lit(1).alias("rank"),
            F.col("tan").alias("key")))
    )
    mentions = cut_lineage(mentions)
    names = mentions.select("member_key", "name").distinct()
    edges = (
        employer_pairs(names, names, ["member_key"])
        .filter(F.col("name_a") < F.col("name_b"))
        .select("member_key", F.col("name_a").alias("src"), F.col("name_b").alias("dst")))
    labelled = mentions.join(components(names, edges, ["member_key"], "name"), ["member_key", "name"])
    fallback = F.substring(F.regexp_replace(F.upper("name"), "[^A-Z0-9]", ""), 1, 12)
    parties = labelled.groupBy("member_key", "label").agg(
        F.min_by(F.coalesce("key", fallback), F.struct("rank", "id")).alias("party_key"),
        F.min_by("name", F.struct(-F.length("name"), "rank", "id")).alias("name"),
        F.min(F.struct("rank", "id")).alias("at"))
    shared = parties.groupBy("member_key", "party_key").agg((F.count(F.lit(1)) > 1).alias("shared"))
    parties = parties.join(shared, ["member_key", "party_key"]).withColumn(
        "party_key", F.when(F.col("shared"), F.concat_ws("/", "party_key", "label")).otherwise(F.col("party_key")))
    links = labelled.join(parties.select("member_key", "label", "party_key"), ["member_key", "label"]).select(
        "member_key", "id", "party_key").distinct()
    return parties.select("member_key", "party_key", "name", "at"), links


def linkage_quality(judged: DataFrame, predicted="linked", actual="should_link") -> DataFrame:
    """Counts, precision, recall and F1 (0 where undefined)."""
    p, t = F.col(predicted), F.col(actual)
    counts = judged.agg(
        F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"),
        F.count_if(~p & ~t).alias("tn"), F.count_if(~p & t).alias("fn"))

    def ratio(top, bottom):
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    return (
        counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
        .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"),
                                F.col("precision") + F.col("recall")))
    )


def cluster_quality(items: DataFrame, predicted="predicted", actual="actual") -> DataFrame:
    """A14 for components: pairwise and per-item precision, recall and F1, from sizes alone.

    Items that share a predicted and an actual group are one cell of a contingency table; pairs inside a
    group of n are n(n-1)/2, so no pair is formed and a group of any size is one summed row. Pair counts
    are decimals, since squares of large groups pass 64 bits. An item without a predicted or an actual
    group can't be judged: it is counted in ``n_unjudged`` and takes part in nothing else. Ratios
    without a base are 0.
    """
    known = F.col(predicted).isNotNull() & F.col(actual).isNotNull()
    cells = cut_lineage(
        items.select(F.when(known, F.struct(F.col(predicted).alias("p"), F.col(actual).alias("t"))).alias("cell"))
        .groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        .select("cell.p", "cell.t", "n", F.col("cell").isNotNull().alias("judged")))
    judged = cells.filter("judged").drop("judged")

    def sizes(side, name):
        return judged.groupBy(side).agg(F.sum("n").alias(name))

    def pairs(n):
        n = F.col(n).cast("decimal(18,0)")
        return F.coalesce(F.sum((n * (n - 1) / 2).cast("decimal(36,0)")), F.lit(0)).cast("decimal(38,0)")

    def share(of):
        return F.sum(F.col("n").cast("double") * F.col("n") / F.col(of))

    inside = judged.join(sizes("p", "n_p"), "p").join(sizes("t", "n_t"), "t").agg(
        pairs("n").alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"),
        share("n_p").alias("_precise"), share("n_t").alias("_recalled"))
    sums = inside
    for other in (sizes("p", "n_p").agg(pairs("n_p").alias("_predicted")),
                  sizes("t", "n_t").agg(pairs("n_t").alias("_actual")),
                  cells.agg(F.coalesce(F.sum(F.when(~F.col("judged"), F.col("n"))), F.lit(0)).alias("n_unjudged"))):
        sums = sums.unionByName(other, allowMissingColumns=True)
    told = sums.agg(*[F.max(c).alias(c) for c in sums.columns])  # four rows, a value of each column in one of them

    def ratio(top, bottom):
        return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))

    precision, recall = ratio(F.col("tp"), F.col("_predicted")), ratio(F.col("tp"), F.col("_actual"))
    exact, whole = ratio(F.col("_precise"), F.col("n_items")), ratio(F.col("_recalled"), F.col("n_items"))
    return told.select(
        "n_items", "n_unjudged", "tp", (F.col("_predicted") - F.col("tp")).alias("fp"),
        (F.col("_actual") - F.col("tp")).alias("fn"), precision.alias("precision"), recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"),
        exact.alias("item_precision"), whole.alias("item_recall"),
        ratio(2 * exact * whole, exact + whole).alias("item_f1"))
