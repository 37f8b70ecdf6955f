"""Organisation and person names: labelled pairs, and blocking against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from corrobora.operators import linkage, people
from corrobora.session import cut_lineage

# fixed values: labelled organisation names (a, b, same organisation)
ORGANISATIONS = [
    ("TATA CONSULTANCY SERVICES LIMITED", "TATA CONSULTANCY SERVICES LTD", True),
    ("TATA CONSULTANCY SERVICES LIMITED", "NEFT CR-HDFC0000060-TATA CONSULTANCY SER-SALARY", True),
    ("TATA CONSULTANCY SERVICES LIMITED", "TCS LIMITED", True),
    ("INFOSYS LIMITED", "INFOSYS LTD", True),
    ("WIPRO LIMITED", "SAL/WIPRO LIMITED/JUN24", True),
    ("LARSEN & TOUBRO LIMITED", "L&T LTD", True),
    ("HCL TECHNOLOGIES LIMITED", "HCL TECHNOLOGIES LTD", True),
    ("HCL TECHNOLOGIES LIMITED", "IMPS CR HCL TECH LTD SALARY", True),
    ("BOREAL SYSTEMS PRIVATE LIMITED", "BOREAL SYS PVT LTD", True),
    ("GRAMEEN TEXTILES MANUFACTURING CO", "GRAMEEN TEXTILES MFG", True),
    ("STARLIT RETAIL PRIVATE LIMITED", "ACH-STARLIT RETAIL PVT LTD-SAL", True),
    ("ACME TECHNOLOGIES PRIVATE LIMITED", "ACME TECHNO PVT LTD", True),
    ("INFOSYS LIMITED", "INFOSYS BPM LIMITED", False),
    ("WIPRO LIMITED", "WIPRO ENTERPRISES LIMITED", False),
    ("HCL TECHNOLOGIES LIMITED", "HCL INFOSYSTEMS LIMITED", False),
    ("TATA CONSULTANCY SERVICES LIMITED", "TATA CAPITAL LIMITED", False),
    ("RELIANCE INDUSTRIES LIMITED", "RELIANCE RETAIL LIMITED", False),
    ("ICICI BANK LIMITED", "ICICI SECURITIES LIMITED", False),
    ("BOREAL SYSTEMS PRIVATE LIMITED", "BOREAL LABS PRIVATE LIMITED", False),
    ("ACME TECHNOLOGIES PRIVATE LIMITED", "ACME LOGISTICS PRIVATE LIMITED", False),
    ("INFOSYS LIMITED", "TATA CONSULTANCY SERVICES LIMITED", False),
    ("GRAMEEN TEXTILES MANUFACTURING CO", "STARLIT RETAIL PRIVATE LIMITED", False),
]
# fixed values: labelled person names (a, b, same person)
PERSONS = [
    ("RAHUL KUMAR SINGH", "RAHUL KUMAR SINGH", True),
    ("RAHUL KUMAR SINGH", "RAHUL K SINGH", True),
    ("RAHUL KUMAR SINGH", "RAHUL SINGH", True),
    ("RAHUL SINGH", "RAHOOL SINGH", True),
    ("RAHUL SINGH", "RAAHUL SINGH", True),
    ("SHRI RAHUL KUMAR SINGH", "RAHUL KUMAR SINGH", True),
    ("राहुल कुमार सिंह", "RAHUL KUMAR SINGH", True),
    ("राहुल सिंह", "RAHUL SINGH", True),
    ("PRIYA SHARMA", "PRIYA SHARMAA", True),
    ("VENKATESH IYER", "WENKATESH IYER", True),
    ("JAYESH PATEL", "ZAYESH PATEL", True),
    ("RAHUL KUMAR SINGH", "RAHUL KUMAR SINHA", False),
    ("RAHUL KUMAR SINGH", "RAHUL KUMAR SHARMA", False),
    ("RAHUL KUMAR SINGH", "ROHIT KUMAR SINGH", False),
    ("PRIYA SHARMA", "PRIYA VERMA", False),
    ("RAHUL PRASAD SINGH", "RAHUL MOHAN SINGH", False),
    ("ANIL KUMAR", "SUNIL KUMAR", False),
    ("RAMESH IYER", "RAMESH IYENGAR", False),
    ("DEEPAK JOSHI", "DEEPAK JOSHUA", False),
]


def test_labelled_organisations(spark):
    pairs = spark.createDataFrame(ORGANISATIONS, "a string, b string, should_link boolean")
    scored = cut_lineage(linkage.score_pairs(pairs))
    quality = linkage.linkage_quality(scored).first()
    assert quality.fp == 0 and quality.precision >= 0.95 and quality.recall >= 0.80
    score = {(r.a, r.b): (r.score, r.reason) for r in scored.collect()}
    assert score["INFOSYS LIMITED", "INFOSYS LTD"] == (1.0, "linked")
    assert score["INFOSYS LIMITED", "INFOSYS BPM LIMITED"] == (0.325, "discriminator")


def test_labelled_persons(spark):
    pairs = spark.createDataFrame(PERSONS, "a string, b string, should_link boolean")
    judged = cut_lineage(people.compare_names(pairs))
    wrong = [(r.a, r.b, r.confidence, r.reason) for r in judged.filter("same_person != should_link").collect()]
    assert wrong == []


def test_confidence_ladder(spark):
    cases = [
        ("...", "RAHUL SINGH", 0.0), ("R K", "RAHUL SINGH", 0.0), ("ANIL KUMAR", "SUNIL KUMAR", 0.15),
        ("PRIYA SHARMA", "PRIYA VERMA", 0.10), ("RAHUL PRASAD SINGH", "RAHUL MOHAN SINGH", 0.20),
        ("RAHUL KUMAR SINGH", "RAHUL M SINGH", 0.35), ("RAHUL KUMAR SINGH", "RAHUL SINGH", 0.75),
        ("RAHUL SINGH", "RAHOOL SINGH", 0.85), ("RAHUL SINGH", "RAHUL SINGH", 0.99)]
    got = {(r.a, r.b): r.confidence for r in people.compare_names(
        spark.createDataFrame([c[:2] for c in cases], "a string, b string")).collect()}
    assert got == {c[:2]: c[2] for c in cases}


def test_blocking_loses_no_link(spark):
    """Every pair that scores as linked by brute force comes out of the joins, and nothing else."""
    rng = random.Random(7)
    words = ["acme", "acne", "boreal", "services", "tech", "retail", "systems", "global", "kadam", "sons", "x"]
    names = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(160)})
    left = [(n,) for n in names[::2]] + [(a,) for a, _, _ in ORGANISATIONS]
    right = [(n,) for n in names[1::2]] + [(b,) for _, b, _ in ORGANISATIONS]
    left, right = (spark.createDataFrame(x, "name string").distinct() for x in (left, right))
    found = {(r.name_a, r.name_b) for r in linkage.employer_pairs(left, right).collect()}
    every = left.withColumnRenamed("name", "a").crossJoin(right.withColumnRenamed("name", "b"))
    brute = {(r.a, r.b) for r in linkage.score_pairs(every).filter("linked").collect()}
    assert found == brute and len(brute) > 50


def test_components(spark):
    nodes = spark.createDataFrame([("m", f"n{i:02d}") for i in range(40)] + [("o", "n00")], "k string, node string")
    chain = [("m", f"n{i:02d}", f"n{i + 1:02d}") for i in range(29)] + [("m", "n35", "n31")]
    labels = {(r.k, r.node): r.label for r in linkage.components(
        nodes, spark.createDataFrame(chain, "k string, src string, dst string"), ["k"]).collect()}
    assert {labels["m", f"n{i:02d}"] for i in range(30)} == {"n00"}
    assert labels["m", "n35"] == "n31" and labels["m", "n39"] == "n39" and labels["o", "n00"] == "n00"


def test_party_keys_are_unique_per_member(spark):
    accounts = spark.createDataFrame(
        [("m", "ABCDE00123450000000001", "Northwind Textiles"), ("m", "ABCDE00123450000000002", "Zenith Foundry")],
        "member_key string, account_id string, establishment string")
    deductors = spark.createDataFrame([], "member_key string, tan string, name string")
    parties, links = linkage.resolve_parties(accounts, deductors)
    keys = [r.party_key for r in parties.collect()]
    assert len(keys) == 2 and len(set(keys)) == 2
    assert sorted(r.party_key for r in links.collect()) == sorted(keys)


def test_people_linked_as_by_all_pairs(spark):
    rng = random.Random(11)
    given, middle, last = ["RAVI", "RAVEE", "WASIM", "VASIM", "ASHA"], ["KUMAR", "KUMAAR", "MOHAN", "ZAVED", "JAVED", "K", "M", "R"], [
        "SINGH", "SINH", "RAO"]
    names = {" ".join([rng.choice(given), *rng.sample(middle, rng.choice([0, 0, 1, 1, 2, 3])), rng.choice(last)]) for _ in range(260)}
    names |= {"RAO", "R RAO", "", "MR RAVI SINGH", "K", "अशोक राव"}
    rows = [(f"m{k % 60}", n) for k, n in enumerate(sorted(names) * 2)] + [("m0", None)]
    told = people.link_people(spark.createDataFrame(rows, "member_key string, name string")).collect()
    classes = people.name_classes(spark.createDataFrame(rows, "member_key string, name string")).collect()
    kept = {c.representative: (c.signatures[0], c.signatures[-1]) if len(c.signatures) > 1 else None for c in classes}
    pairs = [(a, b) for a in kept for b in kept if a < b and kept[a] and kept[a] == kept[b]]
    judged = people.compare_names(spark.createDataFrame(pairs, "a string, b string")).filter("same_person").collect()
    links = {n: set() for n in kept}
    for r in judged:
        links[r.a].add(r.b)
        links[r.b].add(r.a)
    person = {n: n for n in kept}
    while (fresh := {n: min([person[n], *[person[x] for x in links[n]]]) for n in kept}) != person:
        person = fresh
    assert {r.representative: (r.n_links, r.person) for r in told} == {n: (len(links[n]), person[n]) for n in kept}
    assert sum(r.n_spellings for r in told) == len(names) and len(judged) > 200


def test_people_of_one_very_common_name(spark):
    """50,000 members of one name, and thousands of middle names under it, beside classes without one."""
    names = spark.range(50_000).selectExpr("cast(id as string) member_key", "'RAVI SINGH' name").unionByName(
        spark.range(4_000).selectExpr("cast(id as string) member_key", "concat('RAVI ', translate(cast(id + 1000 as string), "
                                      "'0123456789', 'BCDGHJKLMN'), 'A SINGH') name"))
    told = people.link_people(names).collect()
    hub = [r for r in told if r.representative == "RAVI SINGH"]
    assert len(told) == 4_001 and [(r.n_members, r.n_links) for r in hub] == [(50_000, 4_000)]
    assert len({r.person for r in told}) == 1


def test_quality_of_components_equals_counting_all_pairs(spark):
    rng = random.Random(4)
    items = [(rng.choice("abcdefg"), rng.choice([1, 2, 3, 4, 5])) for _ in range(300)] + [(None, 1), ("a", None)]
    told = linkage.cluster_quality(spark.createDataFrame(items, "predicted string, actual int")).first()
    judged = items[:300]
    tp = fp = fn = 0
    for (p, t), (q, u) in itertools.combinations(judged, 2):
        tp, fp, fn = tp + (p == q and t == u), fp + (p == q and t != u), fn + (p != q and t == u)
    assert (told.n_items, told.n_unjudged, int(told.tp), int(told.fp), int(told.fn)) == (300, 2, tp, fp, fn)
    assert told.precision == pytest.approx(tp / (tp + fp)) and told.recall == pytest.approx(tp / (tp + fn))
    share = [sum(x == y for y in judged) / sum(x[0] == y[0] for y in judged) for x in judged]
    assert told.item_precision == pytest.approx(sum(share) / 300)


def test_quality_of_huge_components_and_of_nothing(spark):
    one = spark.range(4_000_000).selectExpr("1 AS predicted", "id % 2 AS actual")
    told = linkage.cluster_quality(one).first()
    assert int(told.tp) == 2 * (2_000_000 * 1_999_999 // 2) and int(told.fp) == 2_000_000 ** 2 and told.item_precision == 0.5
    none = linkage.cluster_quality(spark.createDataFrame([], "predicted string, actual string")).first()
    assert (none.n_items, int(none.tp), none.precision, none.item_f1) == (0, 0, 0.0, 0.0)


def _all_pairs(names):
    """The weakest pair of each member by comparing every two spellings."""
    forms = people.spellings(names.filter("name is not null"))
    left = forms.selectExpr("member_key", "name a", "first_ord ord_a", "n_docs n_a")
    right = forms.selectExpr("member_key", "name b", "last_ord last_b", "first_ord ord_b")
    judged = people.compare_names(left.join(right, "member_key").filter("(a <> b and ord_a < last_b) or (a = b and n_a > 1)"))
    best = {}
    for r in judged.collect():
        key = (r.confidence, r.ord_a, r.ord_b)
        if r.member_key not in best or key < best[r.member_key][0]:
            best[r.member_key] = (key, (r.a, r.b, r.confidence, r.same_person, r.reason))
    return {m: told for m, (_, told) in best.items()}


@pytest.mark.parametrize("probes", [1, 3, 16])
def test_weakest_pair_equals_all_pairs(spark, probes):
    rng = random.Random(probes)
    given, middle = ["RAVI", "RAVEE", "SUNIL", "R", "KUMAR"], ["", "", "KUMAR", "K", "MOHAN", "M", "DEV"]
    surname = ["SINGH", "SINGH", "SINHG", "VERMA", "", "RAVI"]
    rows = []
    for m in range(60):
        # few words for some members, so that all steps of the ladder are the weakest somewhere
        g, k, s = (rng.sample(x, rng.randint(1, len(x))) for x in (given, middle, surname))
        for n in range(rng.randint(1, 14)):
            rows.append((str(m), " ".join(w for w in (rng.choice(g), rng.choice(k), rng.choice(s)) if w), n))
    rows += [("null", None, 0), ("null", "RAVI SINGH", 1), ("blank", "", 0), ("blank", "RAVI SINGH", 1), ("nulls", None, 0)]
    names = cut_lineage(spark.createDataFrame(rows, "member_key string, name string, ord bigint"))
    told = {r.member_key: (r.a, r.b, r.confidence, r.same_person, r.reason)
            for r in people.weakest_pair(names, probes).collect()}
    expected = _all_pairs(names)
    assert told == expected and len({e[2] for e in expected.values()}) >= 6
    assert "null" not in told and told["blank"][4] == "empty"


def test_weakest_pair_of_very_many_spellings(spark):
    """20,000 spellings of one member are settled without pairing them all."""
    code = "translate(cast(id + 100000 as string), '0123456789', 'BCDGHJKLMN')"
    names = spark.range(20_000).selectExpr(
        "'m' member_key", f"if(id = 0, 'RAVI SINGH', concat('RAVI ', {code}, 'A SINGH')) name", "id ord")
    told = people.weakest_pair(names).collect()
    assert [(r.a[:5], r.confidence, r.reason) for r in told] == [("RAVI ", 0.20, "middle names conflict")]


def test_weakest_pair_of_no_rows(spark):
    assert people.weakest_pair(spark.createDataFrame([], "member_key string, name string, ord bigint")).count() == 0


def test_best_links_equal_the_best_of_all_links(spark):
    rng = random.Random(11)
    words = ["acme", "acne", "boreal", "tech", "retail", "systems", "global", "kadam", "sons"]
    some = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(240)]
    names = spark.createDataFrame([(rng.choice("mn"), n) for n in some[:140] + some[:20]] + [("m", None), ("m", "")], "k string, name string")
    register = spark.createDataFrame(
        [(rng.choice("mn"), n, i, f"c{i}") for i, n in enumerate(some[100:] + some[150:180])] + [("m", None, 999, "none")],
        "k string, name string, ord int, code string")
    told = {(r.k, r.name): (r.score, r.code) for r in linkage.best_links(names, register, ["code"], ["k"]).collect()}
    every = names.distinct().withColumnRenamed("name", "a").join(register.withColumnRenamed("name", "b"), "k")
    best = {}
    for r in linkage.score_pairs(every).filter("linked").collect():
        best[r.k, r.a] = min(best.get((r.k, r.a), (0, 0, "")), (-r.score, r.ord, r.code))
    assert told == {key: (-score, code) for key, (score, _, code) in best.items()} and len(told) > 60
    assert len({score for score, _ in told.values()}) > 3


def test_best_links_of_a_hot_head(spark):
    """50,000 registered names with the same three leading words are found without pairing them."""
    names = spark.range(50_000).selectExpr(
        "concat('acme boreal systems ', translate(cast(id + 100000 as string), '0123456789', 'abcdefghij')) name", "id ord")
    told = linkage.best_links(names, names.withColumn("own", F.col("name")), ["own"])
    assert told.filter("name = own and score = 1").count() == 50_000
