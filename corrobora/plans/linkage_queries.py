"""Organisation and person names from the part table, linked across spellings, with their SQL.

The SQL compares all pairs by brute force. In most queries it leaves out the
similarity of first tokens that differ: between the words of these names it
never reaches what a link would need, so both sides must give the same links.
``first_word_scores`` and ``first_word_links`` are about that similarity.
"""

from pyspark.sql import functions as F

from corrobora.functions.names import employer_tokens, name_signature, name_tokens, romanise
from corrobora.operators import linkage, people
from corrobora.plans import adapters
from corrobora.plans.registry import query, with_ctes

# fixed values of the SQL side: the words that occur in these names
_NOISE = "['neft','cr','sal','salary','limited','ltd','pvt','private','']"


def registered(spark, folder):
    """Part names as registered names."""
    return adapters.table(spark, folder, "part").select(
        F.concat(F.col("p_name"), F.lit(" manufacturing limited")).alias("name")).distinct()


def narrated():
    """The same parts as a bank would narrate them; promotions trade as another entity."""
    return F.concat(
        F.lit("NEFT CR-HDFC0000060-"), F.upper("p_name"), F.lit(" "), F.col("p_type"),
        F.when(F.col("p_type") == "PROMO", " RETAIL").otherwise(""), F.lit(" MFG PVT LTD-SALARY"))


TOKENS = [
    ("reg", "SELECT DISTINCT p_name || ' manufacturing limited' AS name FROM part"),
    ("nar", """
  SELECT DISTINCT 'NEFT CR-HDFC0000060-' || upper(p_name) || ' ' || p_type ||
         CASE WHEN p_type = 'PROMO' THEN ' RETAIL' ELSE '' END || ' MFG PVT LTD-SALARY' AS name FROM part"""),
    ("tok", f"""
  SELECT name, list_transform(list_filter(
           regexp_split_to_array(regexp_replace(lower(name), '[^a-z0-9&\\s]', ' ', 'g'), '\\s+'),
           lambda w: NOT list_contains({_NOISE}, w) AND NOT regexp_matches(w, '^[a-z]{{4}}0[a-z0-9]{{6}}$')),
           lambda w: CASE WHEN w = 'mfg' THEN 'manufacturing' ELSE w END) AS t
  FROM (SELECT name FROM reg UNION SELECT name FROM nar)"""),
]


def _scored(left, right, on="true", extra=""):
    """Brute-force scores of two name lists, without the similarity of differing first tokens."""
    return f"""
  SELECT *, greatest(0, 0.45e0 * jaccard + 0.55e0 * head - 0.45e0 * penalties) AS raw FROM (
    SELECT {extra} a.name AS name_a, b.name AS name_b,
           len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE) AS jaccard,
           len(list_filter(list_distinct(list_concat(a.t, b.t)), lambda w: w = 'retail'
               AND NOT (list_contains(a.t, w) AND list_contains(b.t, w)))) AS penalties,
           CASE WHEN hits = n THEN 1.0e0 ELSE greatest(hits / CAST(n AS DOUBLE),
                CASE WHEN a.t[1] = b.t[1] THEN 0.8e0 ELSE 0 END) END AS head
    FROM {left} a JOIN {right} b ON {on},
         LATERAL (SELECT least(len(a.t), len(b.t), 3) AS n),
         LATERAL (SELECT len(list_filter(list_zip(a.t[1:n], b.t[1:n]), lambda z: z[1] = z[2])) AS hits))"""


PAIRS = TOKENS + [
    ("ta", "SELECT name, t FROM tok WHERE name IN (SELECT name FROM nar)"),
    ("tb", "SELECT name, t FROM tok WHERE name IN (SELECT name FROM reg)"),
    ("pairs", _scored("ta", "tb")),
]


@query("employer_tokens", with_ctes(TOKENS) + "SELECT name, array_to_string(t, '|') AS tokens FROM tok")
def tokens(spark, folder):
    names = registered(spark, folder).unionByName(
        adapters.table(spark, folder, "part").select(narrated().alias("name")).distinct()).distinct()
    return names.select("name", employer_tokens("name").alias("tokens"))


@query("employer_pairs", with_ctes(PAIRS) + """
SELECT name_a, name_b, jaccard, head, true AS linked, round(raw, 3) AS score, 'linked' AS reason,
       CASE WHEN penalties > 0 THEN 'retail' ELSE '' END AS one_sided
FROM pairs WHERE raw >= 0.62""")
def employer_pairs(spark, folder):
    narrations = adapters.table(spark, folder, "part").select(narrated().alias("name")).distinct()
    return linkage.employer_pairs(narrations, registered(spark, folder))


# first words with the last letter lost or the first one wrong: the similarity follows from their length alone
MISSPELT = [
    ("reg", "SELECT DISTINCT lower(p_type) AS w, p_name AS rest, lower(p_type) || ' ' || p_name AS name FROM part"),
    ("spelt", """
  SELECT w, rest, left(w, length(w) - 1) || ' ' || rest AS name, 2e0 * (length(w) - 1) / (2 * length(w) - 1) AS ratio FROM reg
  UNION ALL
  SELECT w, rest, 'z' || substr(w, 2) || ' ' || rest, (length(w) - 1e0) / length(w) FROM reg"""),
    ("pairs", """
  SELECT *, 0.45e0 * jaccard + 0.55e0 * head AS raw FROM (
    SELECT a.name AS name_a, b.name AS name_b, a.w = b.w AND a.rest = b.rest AS aligned,
           len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE) AS jaccard,
           greatest(len(list_filter(list_zip(a.t, b.t), lambda z: z[1] = z[2])) / 3e0,
                    0.8e0 * CASE WHEN a.w = b.w THEN ratio ELSE 0 END) AS head
    FROM (SELECT *, string_split(name, ' ') AS t FROM spelt) a, (SELECT *, string_split(name, ' ') AS t FROM reg) b)"""),
]


def _misspelt(spark, folder):
    """(registered, misspelt) names of type and part, of three words each; ``registered`` is kept beside a misspelt one."""
    word = F.lower("p_type")
    registered = adapters.table(spark, folder, "part").select(
        word.alias("w"), F.col("p_name").alias("rest"), F.concat_ws(" ", word, "p_name").alias("name")).distinct()
    wrong = F.array(F.expr("left(w, length(w) - 1)"), F.expr("concat('z', substr(w, 2))"))
    return registered.select("name"), registered.select(
        F.col("name").alias("registered"), F.explode(wrong).alias("wrong"), "rest").select(
        "registered", F.concat_ws(" ", "wrong", "rest").alias("name"))


@query("first_word_scores", with_ctes(MISSPELT) + """
SELECT name_a AS a, name_b AS b, jaccard, head, raw >= 0.62 AS linked, round(raw, 3) AS score,
       CASE WHEN raw >= 0.62 THEN 'linked' ELSE 'below threshold' END AS reason, '' AS one_sided
FROM pairs WHERE aligned""")
def first_word_scores(spark, folder):
    """Scores that depend on how similar two differing first words are."""
    _, misspelt = _misspelt(spark, folder)
    return linkage.score_pairs(misspelt.select(F.col("name").alias("a"), F.col("registered").alias("b")))


@query("first_word_links", with_ctes(MISSPELT) + """
SELECT name_a, name_b, jaccard, head, true AS linked, round(raw, 3) AS score, 'linked' AS reason, '' AS one_sided
FROM pairs WHERE raw >= 0.62""")
def first_word_links(spark, folder):
    """E3 through the joins of J9: long words with a lost letter link, short ones and wrong first letters don't."""
    registered, misspelt = _misspelt(spark, folder)
    return linkage.employer_pairs(misspelt.select("name"), registered)


@query("resolve_establishments", with_ctes(PAIRS) + """
, dir AS (SELECT p_name || ' manufacturing limited' AS name, min(p_partkey) AS ord, min(p_brand) AS code,
                 CAST('1996-01-01' AS DATE) + CAST(min(p_partkey) AS INTEGER) AS coverage_from,
                 max(p_retailprice) > 950 AS covered FROM part GROUP BY p_name)
, best AS (
  SELECT name_a, name_b, round(raw, 3) AS score,
         row_number() OVER (PARTITION BY name_a ORDER BY round(raw, 3) DESC, ord) AS rn
  FROM pairs JOIN dir ON dir.name = name_b WHERE raw >= 0.62)
SELECT n.name, b.name_b AS est_name, code AS est_code, covered, coverage_from, score
FROM nar n LEFT JOIN best b ON n.name = b.name_a AND rn = 1 LEFT JOIN dir ON dir.name = b.name_b""")
def resolve_establishments(spark, folder):
    part = adapters.table(spark, folder, "part")
    register = part.groupBy("p_name").agg(
        F.min("p_partkey").alias("ord"), F.min("p_brand").alias("code"),
        (F.max("p_retailprice") > 950).alias("covered")).select(
        F.concat(F.col("p_name"), F.lit(" manufacturing limited")).alias("name"), "code", "covered",
        F.date_add(F.lit("1996-01-01").cast("date"), F.col("ord").cast("int")).alias("coverage_from"), "ord")
    return linkage.resolve_establishments(part.select(narrated().alias("name")).distinct(), register)


# within a brand: every part is a credit, the registered names of the brand are its parties
CREDITS = TOKENS + [
    ("party", """
  SELECT p_brand AS member_key, p_name || ' manufacturing limited' AS name, min(p_partkey) AS ord
  FROM part GROUP BY p_brand, p_name"""),
    ("credit", """
  SELECT p_partkey, p_brand AS member_key, 'NEFT CR-HDFC0000060-' || upper(p_name) || ' ' || p_type ||
         CASE WHEN p_type = 'PROMO' THEN ' RETAIL' ELSE '' END || ' MFG PVT LTD-SALARY' AS name
  FROM part"""),
    ("ca", "SELECT DISTINCT c.member_key, name, t FROM credit c JOIN tok USING (name)"),
    ("cb", "SELECT member_key, ord, name, t FROM party JOIN tok USING (name)"),
    ("scored", _scored("ca", "cb", "a.member_key = b.member_key", "a.member_key, b.ord,")),
    ("best", """
  SELECT *, row_number() OVER (PARTITION BY member_key, name_a ORDER BY round(raw, 3) DESC, ord) AS rn
  FROM scored WHERE raw >= 0.62"""),
]


@query("attribute_credits", with_ctes(CREDITS) + """
SELECT p_partkey, c.member_key, c.name AS narration, CAST(NULL AS VARCHAR) AS hint, b.name_b AS party_key
FROM credit c JOIN best b ON b.member_key = c.member_key AND b.name_a = c.name AND rn = 1""")
def attribute_credits(spark, folder):
    part = adapters.table(spark, folder, "part")
    parties = part.groupBy(F.col("p_brand").alias("member_key"), "p_name").agg(
        F.min("p_partkey").alias("ord")).select(
        "member_key", "ord", F.concat(F.col("p_name"), F.lit(" manufacturing limited")).alias("name"))
    credits = part.select(
        "p_partkey", F.col("p_brand").alias("member_key"), narrated().alias("narration"),
        F.lit(None).cast("string").alias("hint"))
    return linkage.attribute_credits(credits, parties.withColumn("party_key", F.col("name")))


# within a brand: small parts are accounts, the others deductors
NODES = [
    ("mention", """
  SELECT p_brand AS member_key, p_name || ' manufacturing pvt ltd' AS name,
         'MHBAN' || lpad(CAST(p_partkey AS VARCHAR), 17, '0') AS id,
         0 AS rank, left('MHBAN' || lpad(CAST(p_partkey AS VARCHAR), 17, '0'), 15) AS key
  FROM part WHERE p_size <= 10
  UNION ALL
  SELECT p_brand, upper(p_name) || ' ' || p_type || ' MFG LIMITED', 'T' || p_partkey, 1, 'T' || p_partkey
  FROM part WHERE p_size > 10"""),
    ("tok", f"""
  SELECT member_key, name, list_transform(list_filter(
           regexp_split_to_array(regexp_replace(lower(name), '[^a-z0-9&\\s]', ' ', 'g'), '\\s+'),
           lambda w: NOT list_contains({_NOISE}, w)),
           lambda w: CASE WHEN w = 'mfg' THEN 'manufacturing' ELSE w END) AS t
  FROM (SELECT DISTINCT member_key, name FROM mention)"""),
    ("scored", _scored("tok", "tok", "a.member_key = b.member_key", "a.member_key,")),
    ("edge", "SELECT member_key, name_a, name_b FROM scored WHERE raw >= 0.62"),
]


REACHED = "WITH RECURSIVE " + with_ctes(NODES)[5:].rstrip() + """,
reach AS (
  SELECT member_key, name AS root, name AS node FROM tok
  UNION
  SELECT r.member_key, r.root, e.name_b FROM reach r JOIN edge e
  ON e.member_key = r.member_key AND e.name_a = r.node)
, label AS (SELECT member_key, root AS name, min(node) AS label FROM reach GROUP BY 1, 2)"""


@query("resolve_parties", REACHED + """
, party AS (
  SELECT member_key, label, arg_min(key, {'r': rank, 'i': id}) AS party_key
  FROM mention JOIN label USING (member_key, name) GROUP BY 1, 2)
, keyed AS (
  SELECT member_key, label, CASE WHEN count(*) OVER (PARTITION BY member_key, party_key) > 1
                                 THEN party_key || '/' || label ELSE party_key END AS party_key FROM party)
SELECT DISTINCT member_key, id, party_key
FROM mention JOIN label USING (member_key, name) JOIN keyed USING (member_key, label)""")
def resolve_parties(spark, folder):
    return linkage.resolve_parties(*_mentions(spark, folder))[1]


def _mentions(spark, folder):
    """Accounts and deductors of every brand."""
    part = adapters.table(spark, folder, "part")
    accounts = part.filter(F.col("p_size") <= 10).select(
        F.col("p_brand").alias("member_key"),
        F.concat(F.lit("MHBAN"), F.lpad(F.col("p_partkey").cast("string"), 17, "0")).alias("account_id"),
        F.concat(F.col("p_name"), F.lit(" manufacturing pvt ltd")).alias("establishment"))
    deductors = part.filter(F.col("p_size") > 10).select(
        F.col("p_brand").alias("member_key"),
        F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("tan"),
        F.concat(F.upper("p_name"), F.lit(" "), F.col("p_type"), F.lit(" MFG LIMITED")).alias("name"))
    return accounts, deductors


# every part stands for the organisation it is named after, within its brand; the SQL counts all pairs
@query("party_quality", REACHED + """
, item AS (
  SELECT m.member_key, id, label, p_name AS actual
  FROM mention m JOIN label USING (member_key, name)
  JOIN part ON p_brand = m.member_key AND id = CASE WHEN p_size <= 10 THEN 'MHBAN' || lpad(CAST(p_partkey AS VARCHAR), 17, '0')
                                                    ELSE 'T' || p_partkey END)
, met AS (
  SELECT a.member_key, a.id, a.id < b.id AS once, a.label = b.label AS p, a.actual = b.actual AS t
  FROM item a JOIN item b USING (member_key))
, pairs AS (
  SELECT count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp,
         count(*) FILTER (WHERE t AND NOT p) AS fn FROM met WHERE once)
, each AS (
  SELECT count(*) FILTER (WHERE p AND t) / count(*) FILTER (WHERE p) AS exact,
         count(*) FILTER (WHERE p AND t) / count(*) FILTER (WHERE t) AS whole FROM met GROUP BY member_key, id)
, items AS (SELECT count(*) AS n_items, avg(exact) AS e, avg(whole) AS w FROM each)
SELECT n_items, 0 AS n_unjudged, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn,
       round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1,
       round(e, 9) AS item_precision, round(w, 9) AS item_recall, round(2 * e * w / (e + w), 9) AS item_f1
FROM pairs, items""")
def party_quality(spark, folder):
    links = linkage.resolve_parties(*_mentions(spark, folder))[1]
    named = adapters.table(spark, folder, "part").select(
        F.col("p_brand").alias("member_key"), "p_name",
        F.when(F.col("p_size") <= 10, F.concat(F.lit("MHBAN"), F.lpad(F.col("p_partkey").cast("string"), 17, "0")))
        .otherwise(F.concat(F.lit("T"), F.col("p_partkey").cast("string"))).alias("id"))
    told = linkage.cluster_quality(named.join(links, ["member_key", "id"]).select(
        F.struct("member_key", "party_key").alias("predicted"), F.struct("member_key", "p_name").alias("actual")))
    rounded = {c: F.round(c, 9) for c in ("precision", "recall", "f1", "item_precision", "item_recall", "item_f1")}
    return told.withColumns(rounded)


# ---------------------------------------------------------------------- people

# a letter for every digit, so that each customer has a Devanagari name
_DIGITS, _LETTERS = "0123456789", "कखगचजतदनपम"
_SOUNDS = ["ka", "kha", "ga", "cha", "ja", "ta", "da", "na", "pa", "ma"]


def _sounded(text):
    for digit, sound in zip(_DIGITS, _SOUNDS):
        text = f"replace({text}, '{digit}', '{sound}')"
    return text


@query("romanised_names", f"""
SELECT c_custkey, regexp_replace({_sounded("right(c_name, 9)")}, 'a$', '') AS latin FROM customer""")
def romanised_names(spark, folder):
    return adapters.table(spark, folder, "customer").select(
        "c_custkey", romanise(F.translate(F.substring("c_name", -9, 9), _DIGITS, _LETTERS)).alias("latin"))


SIG = [("word", """
  SELECT DISTINCT unnest(string_split(upper(p_name || ' ' || p_type || ' ' || left(p_brand, 5)), ' ')) AS w
  FROM part"""),
       ("sig", """
  SELECT w, CASE WHEN regexp_replace(e, '[AEIOU]', '', 'g') = '' THEN e
                 ELSE regexp_replace(e, '[AEIOU]', '', 'g') END || '|' ||
         translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
           e, 'A+', 'A', 'g'), 'E+', 'E', 'g'), 'I+', 'I', 'g'), 'O+', 'O', 'g'), 'U+', 'U', 'g'),
           '[^AEIOU]', '', 'g'), 'EO', 'IU') AS s
  FROM (SELECT w, replace(replace(replace(replace(replace(w, 'W', 'V'), 'F', 'PH'), 'Z', 'J'), 'X', 'KS'),
               'Q', 'K') AS e FROM word)""")]


@query("name_signatures", with_ctes(SIG) + "SELECT w AS word, s AS signature FROM sig")
def name_signatures(spark, folder):
    words = adapters.table(spark, folder, "part").select(
        F.explode(name_tokens(F.concat_ws(" ", "p_name", "p_type", F.substring("p_brand", 1, 5)))).alias("word")
    ).distinct()
    return words.select("word", name_signature(F.col("word")).alias("signature"))


def _documents(spark, folder):
    """Three spellings per part: in full, with an initial, and one written by another hand."""
    first, last = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    other = F.when(F.col("p_size") <= 10, F.concat_ws(" ", first, last)).when(
        F.col("p_size") <= 25, F.concat_ws(" ", first, F.lit("Z"), last)).when(
        F.col("p_size") <= 40, F.concat_ws(" ", F.lit("MR"), first, F.col("p_type"), last)).otherwise(
        F.concat_ws(" ", first, F.col("p_brand").substr(1, 5), last))
    return adapters.table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("member_key"), F.posexplode(F.array(
            F.upper(F.concat_ws(" ", first, "p_type", last)),
            F.upper(F.concat_ws(" ", first, F.substring("p_type", 1, 1), last)),
            F.upper(other))).alias("ord", "name"))


PEOPLE = SIG + [
    ("spelt", """
  SELECT CAST(p_partkey AS VARCHAR) AS member_key, unnest([0, 1, 2]) AS ord, unnest([
         upper(f || ' ' || p_type || ' ' || l), upper(f || ' ' || left(p_type, 1) || ' ' || l),
         upper(CASE WHEN p_size <= 10 THEN f || ' ' || l WHEN p_size <= 25 THEN f || ' Z ' || l
                    WHEN p_size <= 40 THEN 'MR ' || f || ' ' || p_type || ' ' || l
                    ELSE f || ' ' || left(p_brand, 5) || ' ' || l END)]) AS name
  FROM (SELECT *, string_split(p_name, ' ')[1] AS f, string_split(p_name, ' ')[2] AS l FROM part)"""),
    ("form", """
  SELECT member_key, name, min(ord) AS lo, max(ord) AS hi, count(*) AS n,
         list_filter(string_split(name, ' '), lambda w: w <> 'MR') AS t
  FROM spelt GROUP BY member_key, name"""),
    # every name here has a given name and a surname around one middle word or initial; an initial
    # is held against the first letter of the dropped word's signature, so E. does not fit ECONOMY
    ("pair", """
  SELECT a.member_key, a.name AS a, b.name AS b, a.lo AS lo_a, b.lo AS lo_b, a.t AS ta, b.t AS tb,
         CASE WHEN len(a.t) > 2 AND length(a.t[2]) > 1 THEN a.t[2] END AS ma,
         CASE WHEN len(b.t) > 2 AND length(b.t[2]) > 1 THEN b.t[2] END AS mb,
         CASE WHEN len(a.t) > 2 AND length(a.t[2]) = 1 THEN a.t[2] END AS ia,
         CASE WHEN len(b.t) > 2 AND length(b.t[2]) = 1 THEN b.t[2] END AS ib
  FROM form a JOIN form b ON a.member_key = b.member_key
   AND ((a.name <> b.name AND a.lo < b.hi) OR (a.name = b.name AND a.n > 1))"""),
    ("judged", """
  SELECT member_key, a, b, lo_a, lo_b,
         CASE WHEN ma <> mb THEN 0.20
              WHEN ma IS NOT NULL AND mb IS NULL AND ib <> left(sa.s, 1) THEN 0.35
              WHEN mb IS NOT NULL AND ma IS NULL AND ia <> left(sb.s, 1) THEN 0.35
              WHEN ta = tb THEN 0.99 WHEN (ma IS NULL) = (mb IS NULL) THEN 0.85 ELSE 0.75 END AS confidence,
         CASE WHEN ma <> mb THEN 'middle names conflict'
              WHEN ma IS NOT NULL AND mb IS NULL AND ib <> left(sa.s, 1) THEN 'middle name against initial'
              WHEN mb IS NOT NULL AND ma IS NULL AND ia <> left(sb.s, 1) THEN 'middle name against initial'
              WHEN ta = tb THEN 'exact' WHEN (ma IS NULL) = (mb IS NULL) THEN 'spelling varies'
              ELSE 'middle name dropped' END AS reason
  FROM pair LEFT JOIN sig sa ON sa.w = ma LEFT JOIN sig sb ON sb.w = mb"""),
    ("weak", """
  SELECT *, confidence >= 0.75 AS same_person,
         row_number() OVER (PARTITION BY member_key ORDER BY confidence, lo_a, lo_b) AS rn FROM judged"""),
]


@query("compare_names", with_ctes(PEOPLE) + """
SELECT DISTINCT a, b, confidence, reason, confidence >= 0.75 AS same_person FROM judged""")
def compare_names(spark, folder):
    forms = people.spellings(_documents(spark, folder))
    left = forms.select("member_key", F.col("name").alias("a"), F.col("first_ord").alias("lo"), "n_docs")
    right = forms.select("member_key", F.col("name").alias("b"), F.col("last_ord").alias("hi"))
    pairs = left.join(right, "member_key").filter(
        ((F.col("a") != F.col("b")) & (F.col("lo") < F.col("hi")))
        | ((F.col("a") == F.col("b")) & (F.col("n_docs") > 1))).select("a", "b").distinct()
    return people.compare_names(pairs)


@query("weakest_pair", with_ctes(PEOPLE) + """
SELECT member_key, a, b, confidence, same_person, reason FROM weak WHERE rn = 1""")
def weakest_pair(spark, folder):
    return people.weakest_pair(_documents(spark, folder))


@query("name_check", with_ctes(PEOPLE) + """
, canon AS (
  SELECT member_key, arg_min(name, {'l': -length(name), 'o': ord}) AS canonical, count(*) AS n_documents,
         count(DISTINCT name) AS n_spellings FROM spelt GROUP BY member_key)
SELECT member_key, canonical, n_documents, n_spellings, a, b, same_person, confidence, reason
FROM canon JOIN weak USING (member_key) WHERE rn = 1""")
def name_check(spark, folder):
    return people.name_check(_documents(spark, folder))


@query("link_people", "WITH RECURSIVE " + with_ctes(PEOPLE)[5:].rstrip() + """
, named AS (
  SELECT member_key, name, list_filter(t, lambda x: length(x) > 1) AS w, list_filter(t, lambda x: length(x) = 1)[1] AS i
  FROM form)
, cls AS (
  SELECT min(name) AS rep, count(DISTINCT member_key) AS n_members, count(DISTINCT name) AS n_spellings, g, s, m, wm, i
  FROM (SELECT member_key, name, i, sg.s AS g, sl.s AS s, sm.s AS m, left(named.w[1], 1) || left(named.w[-1], 1) AS letters,
               CASE WHEN len(named.w) > 2 THEN left(named.w[2], 1) END AS wm
        FROM named JOIN sig sg ON sg.w = named.w[1] JOIN sig sl ON sl.w = named.w[-1]
        LEFT JOIN sig sm ON len(named.w) > 2 AND sm.w = named.w[2])
  GROUP BY g, s, m, letters, wm, i)
, link AS (
  SELECT a.rep AS a, b.rep AS b FROM cls a JOIN cls b ON a.g = b.g AND a.s = b.s AND a.rep <> b.rep
  WHERE NOT coalesce(a.m <> b.m, false) AND NOT coalesce(a.i <> b.wm, false) AND NOT coalesce(b.i <> a.wm, false)
    AND NOT coalesce(b.m IS NULL AND b.i <> left(a.m, 1), false)
    AND NOT coalesce(a.m IS NULL AND a.i <> left(b.m, 1), false))
, reach AS (
  SELECT rep AS root, rep AS node FROM cls UNION SELECT r.root, l.b FROM reach r JOIN link l ON l.a = r.node)
, person AS (SELECT root AS rep, min(node) AS person FROM reach GROUP BY root)
SELECT rep AS representative, n_members, n_spellings, (SELECT count(*) FROM link WHERE link.a = cls.rep) AS n_links, person
FROM cls JOIN person USING (rep)""")
def link_people(spark, folder):
    return people.link_people(_documents(spark, folder))
