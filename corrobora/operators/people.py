"""Person names compared across documents and scripts."""

from pyspark.sql import DataFrame, Window, functions as F

from corrobora.functions.names import name_signature, name_tokens
from corrobora.operators.linkage import components
from corrobora.session import cut_lineage


def _parts(side):
    tokens = F.col(f"t_{side}")
    return {
        f"w_{side}": F.filter(tokens, lambda t: F.length(t) != 1),
        f"i_{side}": F.filter(tokens, lambda t: F.length(t) == 1),
    }


def _middle(words):
    n = F.size(words)
    return F.when(n > 2, F.slice(words, F.lit(2), F.greatest(n - 2, F.lit(0)))).otherwise(
        F.array().cast("array<string>"))


def _initial(word):
    return F.substring(word, 1, 1)


def compare_names(pairs: DataFrame, a="a", b="b") -> DataFrame:
    """Are two spellings one person? First rule that decides, in this order.

    Vowels vary between spellings of one Indian name, consonants hardly do, so
    words are compared by signature. Not symmetric: keep document order.
    """
    distinct_pairs = pairs.select(a, b).distinct()
    named = distinct_pairs.withColumn("t_a", name_tokens(a)).withColumn("t_b", name_tokens(b))
    for side in "ab":
        for column, value in _parts(side).items():
            named = named.withColumn(column, value)
        named = named.withColumn(f"s_{side}", F.transform(f"w_{side}", name_signature))
        named = named.withColumn(f"m_{side}", _middle(F.col(f"w_{side}")))
        named = named.withColumn(f"ms_{side}", F.array_distinct(_middle(F.col(f"s_{side}"))))
    zero = F.lit(0)
    first = lambda x: F.get(F.col(x), zero)
    last = lambda x: F.try_element_at(F.col(x), F.lit(-1))

    given_differs = first("s_a") != first("s_b")
    expanded_initial = (
        F.coalesce(first("i_a") == _initial(first("w_b")), F.lit(False))
        | F.coalesce(first("i_b") == _initial(first("w_a")), F.lit(False)))
    elsewhere = F.array_contains("s_b", first("s_a"))
    surname_differs = (F.size("w_a") > 1) & (F.size("w_b") > 1) & (last("s_a") != last("s_b"))
    only_a, only_b = F.array_except("ms_a", "ms_b"), F.array_except("ms_b", "ms_a")
    dropped = F.when(F.size(only_a) > 0, only_a).otherwise(only_b)
    other_initials = F.when(F.size(only_a) > 0, F.col("i_b")).otherwise(F.col("i_a"))
    contradicted = (
        (F.size(dropped) > 0) & (F.size(other_initials) > 0)
        & ~F.array_contains(other_initials, _initial(F.array_min(dropped))))

    def clash(initials, middle):
        leading = F.transform(middle, _initial)
        return (F.size(middle) > 0) & (F.size(F.array_except(initials, leading)) > 0)

    initial_clash = clash("i_a", "m_b") | clash("i_b", "m_a")
    ladder = [
        ((F.size("t_a") == 0) | (F.size("t_b") == 0), 0.0, "empty"),
        ((F.size("w_a") == 0) | (F.size("w_b") == 0), 0.0, "initials only"),
        (given_differs & ~expanded_initial & ~elsewhere, 0.15, "given name differs"),
        (surname_differs, 0.10, "surname differs"),
        ((F.size(only_a) > 0) & (F.size(only_b) > 0), 0.20, "middle names conflict"),
        (contradicted, 0.35, "middle name against initial"),
        (initial_clash, 0.40, "initial clashes"),
        (F.col("t_a") == F.col("t_b"), 0.99, "exact"),
        (F.size(dropped) == 0, 0.85, "spelling varies"),
    ]
    confidence, reason = F.lit(0.75), F.lit("middle name dropped")
    for condition, value, label in reversed(ladder):
        confidence = F.when(condition, F.lit(value)).otherwise(confidence)
        reason = F.when(condition, F.lit(label)).otherwise(reason)
    judged = named.select(
        F.col(a), F.col(b), confidence.alias("confidence"), reason.alias("reason")
    ).withColumn("same_person", F.col("confidence") >= 0.75)
    return pairs.join(judged, [a, b])


def spellings(names: DataFrame) -> DataFrame:
    """Distinct spellings of each member with their first position and number of documents."""
    return names.groupBy("member_key", "name").agg(
        F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"),
        F.count(F.lit(1)).alias("n_docs"))


#: leading classes of a member that meet all its spellings before counts are asked
PROBES = 16


def _forms(names: DataFrame) -> DataFrame:
    """Spellings with their class: all that ``compare_names`` reads of a name but the order of its tokens."""
    tokens = F.col("tokens")
    spelt = spellings(names.filter(F.col("name").isNotNull())).withColumn("tokens", name_tokens("name")).withColumn(
        "w", F.filter(tokens, lambda t: F.length(t) != 1)).withColumn("i", F.filter(tokens, lambda t: F.length(t) == 1))
    return spelt.withColumn("s", F.transform("w", name_signature)).select(
        "member_key", "name", "first_ord", "last_ord", "n_docs", "tokens",
        F.struct("s", F.transform("w", _initial).alias("letters"), "i").alias("class"))


def _floor(forms: DataFrame) -> DataFrame:
    """A confidence that no two spellings of a member can fall below, from counts alone, and its number of classes.

    A step of the ladder is possible only if the member has what its rule asks for: a spelling without full words, two
    surnames under one given name (or something that excuses different given names), two given names, two middle
    names, initials beside middle names. What holds here is necessary, not sufficient.
    """
    s = F.col("class.s")
    given, surname = F.get(s, F.lit(0)), F.when(F.size(s) > 1, F.element_at(s, -1))
    middle = F.array_sort(F.array_distinct(_middle(s)))
    by_given = forms.select("member_key", given.alias("given"), surname.alias("surname"), "class", "tokens",
                            middle.alias("middle"), F.slice(s, 2, 1 << 20).alias("later"))
    per_given = by_given.groupBy("member_key", "given").agg(
        F.min("surname").alias("low"), F.max("surname").alias("high"))
    later = by_given.select("member_key", F.explode("later").alias("given")).distinct()
    elsewhere = per_given.join(later, ["member_key", "given"]).select("member_key").distinct().withColumn(
        "elsewhere", F.lit(True))
    surnames = per_given.groupBy("member_key").agg(
        F.bool_or(F.col("low") != F.col("high")).alias("split"), (F.min("low") != F.max("high")).alias("surnames"),
        (F.min("given") != F.max("given")).alias("givens"))
    named = F.when(F.size("middle") > 0, F.col("middle"))
    facts = by_given.groupBy("member_key").agg(
        F.bool_or(F.col("given").isNull()).alias("wordless"), F.bool_or(F.size("class.i") > 0).alias("initials"),
        (F.min("middle") != F.max("middle")).alias("middles"), (F.min(named) != F.max(named)).alias("named_middles"),
        F.max(named).isNotNull().alias("any_middle"), (F.min("tokens") != F.max("tokens")).alias("varies"),
        F.count_distinct("class").alias("n_classes"))
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    floor = (
        F.when(yes("wordless"), 0.0)
        .when(yes("surnames") & (yes("split") | yes("initials") | yes("elsewhere")), 0.10)
        .when(yes("givens"), 0.15).when(yes("named_middles"), 0.20)
        .when(yes("initials") & yes("any_middle"), 0.35).when(yes("middles"), 0.75)
        .when(yes("varies"), 0.85).otherwise(0.99))
    return facts.join(surnames, "member_key").join(elsewhere, "member_key", "left").select(
        "member_key", "n_classes", floor.alias("floor"))


def weakest_pair(names: DataFrame, probes=PROBES) -> DataFrame:
    """The two spellings of a member that agree least; the first such pair on ties.

    ``names``: member_key, name, ord (unique in a member); rows with a null name are left out. A pair is two documents
    in reading order, so a spelling that comes once is not paired with itself, and a member with one document has no row.

    Spellings of one class get the same answer against any other, so only the first spelling of a class has to stand
    on the left. The first ``probes`` classes meet all spellings of their member. That settles members with no more
    classes, and all others whose weakest pair so far is as weak as counts allow (``_floor``): later pairs can't be
    weaker, and come later. Only what is left open is compared class by class.
    """
    forms = cut_lineage(_forms(names))
    heads = forms.groupBy("member_key", "class").agg(
        F.min_by(F.struct("name", "n_docs"), F.struct("first_ord", "name")).alias("h"),
        F.min("first_ord").alias("ord_a"), F.max("last_ord").alias("last_b"))
    rank = F.row_number().over(Window.partitionBy("member_key").orderBy("ord_a", "h.name"))
    left = ["member_key", F.col("h.name").alias("a"), F.col("h.n_docs").alias("n_a"), "ord_a"]
    right = forms.select("member_key", F.col("name").alias("b"), F.col("last_ord").alias("last_b"),
                         F.col("first_ord").alias("ord_b"), "class")
    paired = (((F.col("a") != F.col("b")) & (F.col("ord_a") < F.col("last_b")))
              | ((F.col("a") == F.col("b")) & (F.col("n_a") > 1)))

    def weakest(pairs):
        return compare_names(pairs).groupBy("member_key").agg(
            F.min_by(F.struct("a", "b", "confidence", "same_person", "reason", "ord_a", "ord_b"),
                     F.struct("confidence", "ord_a", "ord_b", "a", "b")).alias("w")).select("member_key", "w.*")

    leading = heads.withColumn("rank", rank).filter(F.col("rank") <= probes).drop("rank")
    probed = cut_lineage(weakest(leading.select(*left).join(right.drop("class"), "member_key").filter(paired)))
    limits = _floor(forms).filter(F.col("n_classes") > probes)
    undecided = cut_lineage(probed.join(limits, "member_key").filter(F.col("confidence") > F.col("floor")).select(
        "member_key"))
    out = ["member_key", "a", "b", "confidence", "same_person", "reason"]
    if undecided.isEmpty():
        return probed.select(*out)

    open_heads = cut_lineage(heads.join(undecided, "member_key"))
    mine = open_heads.select(*left, "class")
    between = mine.join(
        open_heads.select("member_key", F.col("h.name").alias("b"), "last_b", F.col("ord_a").alias("ord_b"),
                          F.col("class").alias("class_b")), "member_key").filter(
        (F.col("class") != F.col("class_b")) & (F.col("ord_a") < F.col("last_b")))
    inside = mine.join(right, ["member_key", "class"]).filter(paired)
    columns = ["member_key", "a", "n_a", "ord_a", "b", "ord_b"]
    found = weakest(between.select(*columns).unionByName(inside.select(*columns)))
    # a class was met by its head: the partner itself is looked up among all spellings
    settled = weakest(found.select("member_key", "a", "ord_a").join(
        open_heads.select("member_key", F.col("h.name").alias("a"), F.col("h.n_docs").alias("n_a")), ["member_key", "a"])
        .join(right.drop("class"), "member_key").filter(paired))
    return probed.join(undecided, "member_key", "left_anti").select(*out).unionByName(settled.select(*out))


def canonical_name(names: DataFrame) -> DataFrame:
    """The longest Latin spelling (the first on ties), else the first of any script."""
    ascii_only = F.col("name").rlike(r"^[\x00-\x7F]*$")
    return names.groupBy("member_key").agg(
        F.coalesce(
            F.min_by("name", F.when(ascii_only, F.struct(-F.length("name"), "ord"))),
            F.min_by("name", "ord")).alias("canonical"),
        F.count(F.lit(1)).alias("n_documents"), F.count_distinct("name").alias("n_spellings"))


def name_check(names: DataFrame) -> DataFrame:
    """E9 and E10 per member; a single document has nothing to disagree with."""
    return canonical_name(names).join(weakest_pair(names), "member_key", "left").select(
        "member_key", "canonical", "n_documents", "n_spellings", "a", "b",
        F.coalesce("same_person", F.lit(True)).alias("same_person"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("reason", F.lit("single document")).alias("reason"))


def name_classes(names: DataFrame) -> DataFrame:
    """Spellings that ``compare_names`` cannot tell apart as one class: equal signatures and first letters of the full
    words, and equal initials. Per class: its smallest spelling, and how many members and spellings it has."""
    tokens = name_tokens("name")
    words, initials = F.filter(tokens, lambda t: F.length(t) != 1), F.filter(tokens, lambda t: F.length(t) == 1)
    # dealt by member first: a task holds its share of the rows, however few files they came in
    dealt = cut_lineage(names.filter(F.col("name").isNotNull()).select("member_key", "name").repartition("member_key").distinct())
    spelt = dealt.select("name").distinct().select("name", F.struct(
        F.transform(words, name_signature).alias("signatures"), F.transform(words, _initial).alias("letters"),
        F.array_sort(F.array_distinct(initials)).alias("initials")).alias("class"))
    # a class goes by its first spelling from here on
    classes = cut_lineage(spelt.groupBy("class").agg(F.min("name").alias("representative"), F.count(F.lit(1)).alias("n_spellings")))
    own = cut_lineage(spelt.join(classes, "class").select("name", "representative"))
    # the rows of a member are still together or dealt by name: counted per member first, then added up
    members = dealt.join(own, "name").select("member_key", "representative").distinct().groupBy("representative").agg(
        F.count(F.lit(1)).alias("n_members"))
    return classes.join(members, "representative").select("class.*", "representative", "n_members", "n_spellings")


def link_people(names: DataFrame) -> DataFrame:
    """One row per class of spellings over the whole population: representative, n_members, n_spellings, n_links
    (other classes that E8 takes for the same person) and person (the smallest representative reachable by links).

    ``names``: member_key, name; rows with a null name are left out. Classes meet only under the same given name and
    the same surname, by signature. A name with one full word stays by itself: an initial would fit everybody, so such
    names are compared inside a member only. Under one given name and surname, classes without a middle name are all
    linked with each other, and those without initials either with every class that has a middle name; these links are
    counted and joined through one class, never paired. Only classes that share a middle name, or an initial with a
    middle name, are compared one by one, and nearly all of them are links.
    """
    middle = F.array_distinct(_middle(F.col("signatures")))
    classes = cut_lineage(
        name_classes(names).withColumn("middle", middle).select(
            "representative", "n_members", "n_spellings", "middle", "initials",
            F.when(F.size("signatures") > 1, F.struct(
                F.element_at("signatures", 1).alias("given"), F.element_at("signatures", -1).alias("surname"))).alias("key")))
    named = classes.filter(F.col("key").isNotNull())
    plain, bare = F.size("middle") == 0, (F.size("middle") == 0) & (F.size("initials") == 0)
    hubs = cut_lineage(named.groupBy("key").agg(
        F.min(F.when(plain, F.col("representative"))).alias("plain_hub"), F.count_if(plain).alias("n_plain"),
        F.min(F.when(bare, F.col("representative"))).alias("bare_hub"), F.count_if(bare).alias("n_bare"),
        F.count_if(~plain).alias("n_middle")))
    placed = cut_lineage(named.join(hubs, "key"))
    own = F.when(plain, F.col("n_plain") - 1).otherwise(F.col("n_bare")) + F.when(bare, F.col("n_middle")).otherwise(0)
    counted = placed.select("representative", own.alias("n"))
    stars = placed.select(F.col("representative").alias("src"), F.when(plain, F.col("plain_hub")).otherwise(
        F.col("bare_hub")).alias("dst")).filter("src <> dst")

    middles = named.filter(~plain)
    by_middle = middles.select("key", "representative", F.explode("middle").alias("shared"))
    left, right = (by_middle.withColumnRenamed("representative", side) for side in "ab")
    both = left.join(right, ["key", "shared"]).filter("a < b").select("a", "b")
    lettered = named.filter(plain & ~bare).select("key", F.col("representative").alias("x"), F.explode("initials").alias("letter"))
    worded = middles.select("key", F.col("representative").alias("y"), _initial(F.array_min("middle")).alias("letter"))
    mixed = lettered.join(worded, ["key", "letter"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    linked = cut_lineage(compare_names(both.unionByName(mixed).distinct()).filter("same_person").select("a", "b"))

    ends = linked.select(F.col("a").alias("representative")).unionByName(linked.select(F.col("b").alias("representative")))
    links = counted.unionByName(ends.select("representative", F.lit(1).alias("n"))).groupBy("representative").agg(
        F.sum("n").alias("n_links"))
    edges = stars.unionByName(linked.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    persons = components(classes, edges, [], "representative")
    return classes.select("representative", "n_members", "n_spellings").join(persons, "representative").join(
        links, "representative", "left").select(
        "representative", "n_members", "n_spellings", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.col("label").alias("person"))
