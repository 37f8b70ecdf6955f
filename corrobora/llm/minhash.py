"""Near-duplicate documents by BagMinHash.

A text is the multiset of its five-word shingles. For each shingle the axis of its count is cut into the intervals
(0, 1], (1, 2], (2, 4], (4, 8] and so on; each interval has a Poisson process of its own with a rate of its length,
whose points get a time, a level inside the interval and a component of the signature. A document sees the points at
levels up to its count, and a component keeps the earliest point it sees. Two documents agree in a component with the
probability of their weighted Jaccard similarity. A process is followed only until its next point comes later than every
component's, so a signature costs about one point per shingle and a fixed number more.

Bands of the signature deal documents into buckets. In each bucket all meet one hub only, a different one per band. Pairs
whose signatures agree in fewer components than a similarity of ``threshold`` leaves credible are dropped, the others
are verified by the overlap of their whole multisets. Credible pairs also make clusters, wider than the components of
links. Where a bucket holds more than one cluster, those outside its largest meet all its rows in blocks, and each task
returns only credible pairs that join clusters; after that, every credible pair the bands bring together lies inside a
cluster. Where a cluster holds more than one component of links, those outside the largest meet all others in blocks,
and each task verifies what is credible by itself and returns only links that join components. So every link that the
bands bring together is found, or is implied by others, and no group is expanded into its pairs.

Words are what stands between ASCII white space, letter case and marks included. A text of one to four words is one
shingle. Null and empty cases: a null text counts as empty; identical texts are one class, empty ones too, and a text
without words is like no other text; rows may repeat, each is returned; a null id comes last when the smallest id of a
class is chosen; an empty table gives an empty result. Other columns play no part.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window, functions as F

from corrobora.llm.graph import components
from corrobora.llm.tables import in_batches, packed, unpacked
from corrobora.session import cut_lineage

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6
SIZE = BANDS * ROWS
HUBS = 4              # hubs of a row that are verified before anything else
MARGIN = 4.0          # standard deviations that an estimate may fall short of the threshold
BLOCK = 2048          # signatures of one side that meet in one task
SLICE = 1 << 18       # bytes of text hashed at once
BROADCAST_ROWS = 1_000_000  # ids (8 bytes each) up to which a list of candidates may go to every task

ONE = np.uint64(1)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x100000001B3)
BASE_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix((np.arange(256, dtype=np.uint64) + ONE) * GOLDEN)
PLACES = mix((np.arange(WORDS, dtype=np.uint64) + np.uint64(1000)) * GOLDEN) | ONE


def shingles(texts: list[str]) -> list[np.ndarray]:
    """The 64-bit hashes of each text's shingles, repeats included."""
    joined = "".join(x + " " for x in texts).encode()
    data = np.frombuffer(joined, dtype=np.uint8)
    lengths = [len(x.encode()) + 1 for x in texts]
    space = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    powers = np.cumprod(np.full(len(data) + 1, BASE, dtype=np.uint64))
    inverse = np.cumprod(np.full(len(data) + 1, BASE_INVERSE, dtype=np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_VALUES[data] * powers[:-1], dtype=np.uint64)])
    words = mix((sums[ends] - sums[starts]) * inverse[starts])
    edges = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    n = len(words)
    whole = np.zeros(max(0, n - WORDS + 1), dtype=np.uint64)
    for j in range(WORDS):
        whole += words[j:n - WORDS + 1 + j] * PLACES[j] if n >= WORDS else whole
    whole = mix(whole)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= WORDS:
            out.append(whole[a:b - WORDS + 1])
        elif b > a:
            out.append(mix(np.sum(words[a:b] * PLACES[:b - a], keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(whole[:0])
    return out


def signatures(bags: list[np.ndarray], size=SIZE) -> np.ndarray:
    """BagMinHash: per document and component the number of the earliest point (never 0); 0 where a bag is empty.

    Points are told apart by the random number they come from, not by their time, so rounding can't part them.
    """
    seeds, rates, lows, tops, docs = [], [], [], [], []
    for i, bag in enumerate(bags):
        values, counts = np.unique(bag, return_counts=True)
        seeds.append(values)
        rates.append(np.ones(len(values)))
        lows.append(np.zeros(len(values), dtype=np.int64))
        tops.append(np.ones(len(values), dtype=np.int64))
        docs.append(np.full(len(values), i))
        low = 1
        while (more := counts > low).any():
            values, counts = values[more], counts[more]
            seeds.append(mix(values + np.array([low], dtype=np.uint64) * GOLDEN))
            rates.append(np.full(len(values), float(low)))
            lows.append(np.full(len(values), low))
            tops.append(counts)
            docs.append(np.full(len(values), i))
            low *= 2
    first = np.full((len(bags), size), np.inf)
    names = np.zeros((len(bags), size), dtype=np.uint64)
    if not seeds:
        return names
    seed, rate, low, top, doc = (np.concatenate(x) for x in (seeds, rates, lows, tops, docs))
    time, drawn = np.zeros(len(seed)), 0
    flat = first.reshape(-1)
    while len(seed):
        k = max(1, min(64, 4096 // len(seed)))  # points drawn at once; the times don't depend on it
        numbers = np.arange(drawn, drawn + k, dtype=np.uint64)
        one = mix(seed[:, None] + (numbers + ONE)[None, :] * GOLDEN)
        steps = -np.log1p(-(one >> np.uint64(11)).astype(np.float64) * 2.0 ** -53) / rate[:, None]
        times = np.cumsum(np.concatenate([time[:, None], steps], axis=1), axis=1)[:, 1:]
        two = mix(one ^ GOLDEN)
        component = ((two >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        seen = times < first.max(axis=1)[doc][:, None]
        if (partial := top < 2 * low).any():
            width = np.maximum(low, 1).astype(np.uint64)
            level = low[:, None] + 1 + (((two & np.uint64(0xFFFFFFFF)) * width[:, None]) >> np.uint64(32)).astype(np.int64)
            seen &= ~partial[:, None] | (level <= top[:, None])
        cell = doc[:, None] * size + component.astype(np.int64)
        cell, times_seen, names_seen = cell[seen], times[seen], one[seen] | ONE
        np.minimum.at(flat, cell, times_seen)
        best = times_seen == flat[cell]
        names.reshape(-1)[cell[best]] = names_seen[best]
        time, drawn = times[:, -1], drawn + k
        alive = time < first.max(axis=1)[doc]
        seed, rate, low, top, doc, time = (x[alive] for x in (seed, rate, low, top, doc, time))
    return names


def in_slices(texts: list[str]):
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text) + 64
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def signed(docs: DataFrame, keep) -> DataFrame:
    """Written once: (row, doc, twin, signature, bands); ``doc`` has ``keep``, which includes the text.

    ``twin`` is the MD5 of the text; the signature has 16 bits per component, the bands come from all 64.
    """
    rows = docs.select(keep.alias("doc"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("twin"))

    def work(batch):
        texts = [x or "" for x in pa.compute.struct_field(batch.column("doc"), "text").to_pylist()]
        cells, bands = [], []
        for part in in_slices(texts):
            points = signatures(shingles(part))
            bits = mix(points)
            keys = np.zeros((len(part), BANDS), dtype=np.uint64)
            for j in range(ROWS):
                keys = mix(keys * BASE + bits[:, j::ROWS])
            some = points[:, 0] > 0
            cells += [x.tobytes() if ok else None for x, ok in zip((bits & np.uint64(0xFFFF)).astype("<u2"), some)]
            bands += [x.tolist() if ok else [] for x, ok in zip(keys.view(np.int64), some)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("twin"), pa.array(cells, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc", "twin", "signature", "bands"])
    kind = rows.schema["doc"].dataType.simpleString()
    told = in_batches(rows, work, f"doc {kind}, twin string, signature binary, bands array<bigint>")
    return cut_lineage(told.select(F.monotonically_increasing_id().alias("row"), "*"))


def least_agreeing(threshold: float) -> int:
    """Components in which a pair must agree to be credible."""
    return int(SIZE * threshold - MARGIN * (SIZE * threshold * (1 - threshold)) ** 0.5)


def credible(pairs: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose signatures agree often enough."""
    least = least_agreeing(threshold)
    joined = (
        pairs.join(cells.select(F.col("row").alias("a"), F.col("signature").alias("x")), "a")
        .join(cells.select(F.col("row").alias("b"), F.col("signature").alias("y")), "b")
    )

    def work(batch):
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, SIZE) for c in "xy")
        near = pa.array((x == y).sum(axis=1) >= least)
        return batch.select(["a", "b"]).filter(near)
    return in_batches(joined.select("a", "b", "x", "y"), work, "a long, b long")


def bags_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, bag): the sorted hashes of a text's shingles, each repeat under a hash of its own, for the rows wanted."""
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = rows.select("row", F.coalesce("doc.text", F.lit("")).alias("text")).join(
        F.broadcast(wanted) if few else wanted, "row", "left_semi")

    def work(batch):
        bags = []
        for part in in_slices(batch.column("text").to_pylist()):
            for bag in shingles(part):
                values, counts = np.unique(bag, return_counts=True)
                again = np.arange(counts.sum(), dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)
                bags.append(np.sort(mix(np.repeat(values, counts) + again.astype(np.uint64) * GOLDEN)).tobytes())
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(bags, pa.binary())], ["row", "bag"])
    return in_batches(texts, work, "row long, bag binary")


def verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap in ``threshold`` of their union or more."""
    joined = (
        pairs.join(bags.select(F.col("row").alias("b"), F.col("bag").alias("y")), "b")
        .join(bags.select(F.col("row").alias("a"), F.col("bag").alias("x")), "a")
    )

    def work(batch):
        near = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                near.append(False)
                continue
            both = np.sort(np.concatenate([x, y]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            near.append(common >= threshold * (len(both) - common))
        return batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))
    return in_batches(joined.select("a", "b", "x", "y"), work, "a long, b long")


def hub_pairs(buckets: DataFrame, most=HUBS) -> DataFrame:
    """Distinct pairs (row, hub) over all buckets (band, key, row); the hub's order differs from band to band.

    Of a row's hubs the ``most`` that share the most bands with it stay; what else shares a bucket with the row meets
    it in ``bridges`` or ``cluster_links``, so nothing is lost.
    """
    hubs = buckets.groupBy("band", "key").agg(
        F.min(F.struct(F.xxhash64("row", "band").alias("order"), F.col("row"))).alias("hub")).select(
        "band", "key", F.col("hub.row").alias("b"))
    met = buckets.join(hubs, ["band", "key"]).filter("row <> b").groupBy(F.col("row").alias("a"), "b").agg(
        F.count(F.lit(1)).alias("n"))
    nearest = Window.partitionBy("a").orderBy(F.desc("n"), F.xxhash64("b"), "b")
    return met.withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= most).select("a", "b")


def outsiders_with_all(placed: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Rows of groups with several components, dealt to block pairs (keys, i, j).

    The rows outside a group's largest component ask (block i), all rows are asked (block j).
    """
    parts = placed.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy(*keys).agg(
        F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts"))
    still = placed.join(largest.filter("parts > 1"), keys).withColumn("outside", F.col("component") != F.col("top.component"))
    n_out = F.ceil((F.col("all") - F.col("top.n")) / block).cast("int")
    n_in = F.ceil(F.col("all") / block).cast("int")
    place = F.pmod(F.xxhash64("row"), n_out).cast("int"), F.pmod(F.xxhash64("row"), n_in).cast("int")
    asking = still.filter("outside").select(
        *placed.columns, F.lit(True).alias("asks"), place[0].alias("i"), F.explode(F.sequence(F.lit(0), n_in - 1)).alias("j"))
    asked = still.select(
        *placed.columns, F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), n_out - 1)).alias("i"), place[1].alias("j"))
    return asking.unionByName(asked)


def with_components(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn(
        "component", F.coalesce("component", "row"))


def signature_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u2").reshape(-1, SIZE)


def cluster_links(clusters: DataFrame, labels: DataFrame, cells: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Links between the components inside each cluster (node, component) of credible pairs.

    The outsiders of a cluster's largest component meet all its rows in blocks; a task verifies the credible pairs of
    its blocks on the whole multisets and returns only links that join components it has not joined yet.
    """
    least = least_agreeing(threshold)
    placed = with_components(clusters.select(F.col("node").alias("row"), F.col("component").alias("cluster")), labels)
    dealt = outsiders_with_all(placed, ["cluster"], BLOCK // 4).join(cells, "row").join(bags, "row")

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["asks"]], rows[~rows["asks"]]
        there = signature_rows(right["signature"])
        ids, part = right["row"].to_numpy(), right["component"].to_numpy()
        bags_there = [np.frombuffer(x, dtype=np.uint64) for x in right["bag"]]
        sizes = np.array([len(x) for x in bags_there])
        joined: dict[int, int] = {}

        def top(x):
            while x in joined:
                x = joined[x]
            return x
        found = []
        for row, component, cell, bag in zip(left["row"], left["component"], signature_rows(left["signature"]), left["bag"]):
            bag = np.frombuffer(bag, dtype=np.uint64)
            fits = np.minimum(sizes, len(bag)) >= threshold * np.maximum(sizes, len(bag))
            near = np.flatnonzero(((there == cell).sum(axis=1) >= least) & fits)
            own = top(component)
            near = np.array([k for k in near.tolist() if top(part[k]) != own], dtype=np.int64)
            if not len(near):
                continue
            flat = np.concatenate([bags_there[k] for k in near])
            at = np.searchsorted(bag, flat)
            hit = bag[np.minimum(at, len(bag) - 1)] == flat
            edges = np.concatenate([[0], np.cumsum(sizes[near])[:-1]])
            common = np.add.reduceat(hit.astype(np.int64), edges)
            for k in near[common >= threshold * (sizes[near] + len(bag) - common)].tolist():
                mine, other = top(component), top(part[k])
                if mine != other:
                    joined[max(mine, other)] = min(mine, other)
                    found.append((row, ids[k]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")
    return dealt.groupBy("cluster", "i", "j").applyInPandas(meet, "a long, b long")


def bridges(buckets: DataFrame, clusters: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """Credible pairs that share a bucket and join clusters: a task returns none between clusters it has joined."""
    least = least_agreeing(threshold)
    placed = with_components(buckets, clusters)
    dealt = outsiders_with_all(placed, ["band", "key"], BLOCK).join(cells, "row")

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["asks"]], rows[~rows["asks"]]
        there, ids = signature_rows(right["signature"]), right["row"].to_numpy()
        _, top = np.unique(np.concatenate([left["component"], right["component"]]), return_inverse=True)
        asks, found = len(left), []
        for k, (row, cell) in enumerate(zip(left["row"], signature_rows(left["signature"]))):
            near = np.flatnonzero((there == cell).sum(axis=1) >= least)
            others, at = np.unique(top[asks + near], return_index=True)
            new = others != top[k]
            if new.any():
                found += [(row, b) for b in ids[near[at[new]]].tolist()]
                top[np.isin(top, others[new])] = top[k]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")
    return dealt.groupBy("band", "key", "i", "j").applyInPandas(meet, "a long, b long")


def classes(docs: DataFrame, threshold=THRESHOLD, keep=None) -> DataFrame:
    """(row, doc, class_row): every row with the row that stands for its class."""
    rows = signed(docs, F.struct("doc_id", "text") if keep is None else keep)
    first = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("doc_id"), F.col("row"))
    twins = cut_lineage(rows.groupBy("twin").agg(F.min(first).alias("first")).select(
        "twin", F.col("first.row").alias("node"), F.col("first.doc_id").alias("doc_id")))
    nodes = rows.select("row", "signature", "bands").join(twins.select(F.col("node").alias("row")), "row", "left_semi")
    nodes = cut_lineage(nodes.filter("signature is not null"))
    buckets = nodes.select("row", F.posexplode("bands").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    buckets = cut_lineage(buckets.join(shared, ["band", "key"], "left_semi"))
    cells = nodes.select("row", "signature")
    pairs = cut_lineage(credible(hub_pairs(buckets), cells, threshold))
    wanted = cut_lineage(buckets.select("row").distinct())
    bags = cut_lineage(bags_of(rows, wanted))
    links = cut_lineage(verified(pairs, bags, threshold))
    labels, clusters = components(links), components(pairs)
    joining = cut_lineage(bridges(buckets, clusters, cells, threshold))
    if not joining.isEmpty():
        clusters = components(pairs.union(joining))
    more = cut_lineage(cluster_links(clusters, labels, cells, bags, threshold))
    if not more.isEmpty():
        labels = components(links.union(more))
    named = twins.join(labels.select(F.col("node").alias("n"), "component"), F.col("node") == F.col("n"), "left")
    named = named.select("twin", "node", "doc_id", F.coalesce("component", "node").alias("component"))
    best = named.groupBy("component").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("node").alias("row"))).alias("best"))
    known = cut_lineage(named.select("twin", "component").join(best, "component").select(
        "twin", F.col("best.row").alias("class_row"), F.col("best.doc_id").alias("class_id")))
    return rows.select("row", "doc", "twin").join(known, "twin")


def near_duplicates(docs: DataFrame, threshold=THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its class), kept (whether it stands for the class)."""
    return classes(docs, threshold).select(
        F.col("doc.doc_id").alias("doc_id"), "class_id", (F.col("row") == F.col("class_row")).alias("kept"))


def without_near_duplicates(docs: DataFrame, threshold=THRESHOLD) -> DataFrame:
    """One document of each class, with its own columns only."""
    return unpacked(classes(docs, threshold, packed(docs)).filter("row = class_row").select("doc"))
