"""Near-duplicate documents: dart-throwing weighted MinHash, banded joins, and exact checks.

A document is the bag of its shingles of five words (a shorter one, of all its words); the weight of a shingle is how
often it occurs. Two documents are linked if their weighted Jaccard similarity (sum of smaller counts over sum of
larger) is at least the threshold; a class is a connected component of links, named by its smallest doc_id.

Signature: every (shingle, weight region) holds a Poisson stream of darts along a rank axis, made from hashes alone, so
that equal regions of two documents hold equal darts. Weight regions are [0, 1), [1, 2), [2, 4), ... and a dart has a
place inside its region, so weights need not be whole numbers. Only darts of low rank are thrown: about
t (ln t + 3) in all for a document of any length. Each dart falls on one of t coordinates; the earliest there is kept.

Join: equal bags are merged first. Band values name buckets. In large buckets members are compared to three centres. Then
all pairs of a bucket whose members are still in different components are compared: those in small buckets one by one,
with bounds on their weights and a sketch of the signature inside the join; members of a large component and those who
share a large bucket with it, and the rest of large buckets, in tiles of bounded size that pass on connecting links and
not pairs. All comparisons are exact, on whole texts or on all their features, and no step makes a row for each pair of a
large group. What chance can miss: a pair at exactly the threshold shares no bucket once in 140,000, and in a small bucket
its sketches differ too much once in a million; more similar pairs are missed less.

Defined cases: null, empty and wordless texts link with nothing; rows with a null doc_id link with nothing and have a
null class; rows that share a doc_id are put in one class, whatever their texts and order; of ties the smallest doc_id
names the class; an empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import SLICE_BYTES, at_most, checkpoint, fresh, release, slices
from tallyloom.llm.components import components
from tallyloom.llm.words import mix, shingle_bags, words_of

BANDS, ROWS = 30, 5
SHINGLE, THRESHOLD = 5, 0.8
#: Buckets of more members than this are first compared to centres.
SMALL_BUCKET = 6
CENTRE_ROUNDS = 3
#: A component of so many members is compared with others as a whole.
LARGE_COMPONENT = 64
#: A tile's documents, and the weight they have together.
TILE_ROWS, TILE_WEIGHT = 1024, 1 << 20
#: Buckets that hang together are compared as one group of up to so many tiles.
WHOLE_GROUP_TILES = 12
#: A semi-join's keys are broadcast up to this many longs (8 MB), and shuffled beyond.
BROADCAST_KEYS = 1 << 20
#: Bags with more copies than this meet their class by a broadcast; a table has at most its rows over this of them.
HOT_COPIES = 1000
_ID_BITS = np.uint64(48)


# Signatures -----------------------------------------------------------------------------------------------------------


def bags(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of all different shingles, by text; and two 64-bit sums that name each text's bag."""
    of, h = shingle_bags(words_of(texts), size)
    n = len(texts)
    names = np.zeros((n, 2), np.uint64)
    starts = np.searchsorted(of, np.arange(n))
    full = np.flatnonzero(np.diff(np.append(starts, len(of))))
    if len(full):
        names[full, 0] = np.add.reduceat(mix(h), starts[full])
        names[full, 1] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), starts[full])
    key = np.sort((of.astype(np.uint64) << _ID_BITS) | (h >> np.uint64(16)))
    new = np.ones(len(key), np.bool_)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> _ID_BITS).astype(np.int64), key & np.uint64((1 << 48) - 1), counts, names


def dart_signatures(of: np.ndarray, item: np.ndarray, weight: np.ndarray, n: int, t: int) -> np.ndarray:
    """t dart identities for each of n weighted sets; 0 everywhere for an empty set. of must not fall."""
    best = np.full(n * t, np.inf)
    out = np.zeros(n * t, np.uint64)
    weight = weight.astype(np.float64)
    total = np.bincount(of, weight, minlength=n)
    limit = np.zeros(n)
    np.divide(math.log(t) + 3, total, out=limit, where=total > 0)
    todo = total > 0
    low = np.zeros(n)  # ranks up to here have been thrown
    while todo.any():
        _throw(of, item, weight, low, np.where(todo, limit, 0), t, best, out)
        empty = np.isinf(best.reshape(n, t)).any(axis=1)
        low, todo = limit.copy(), (total > 0) & empty
        limit = np.where(todo, limit * 2, limit)
    return out.reshape(n, t)


def _throw(of, item, weight, low, limit, t, best, out) -> None:
    """Throw the darts with ranks in (low, limit] of each set and keep the earliest of each coordinate."""
    region, base, width = 0, 0.0, 1.0
    live = np.flatnonzero(limit[of] > 0)
    while len(live):
        alive = live
        seed = mix(item[alive] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(region))
        rank, step = np.zeros(len(alive)), 0
        while len(alive):
            u = mix(seed + np.uint64(step * 0xD1342543DE82EF95 % 2**64))
            rank = rank - np.log(((u >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / (t * width)
            keep = rank <= limit[of[alive]]
            alive, seed, rank, u = alive[keep], seed[keep], rank[keep], u[keep]
            v = mix(u)
            inside = (rank > low[of[alive]]) & (base + width * ((v >> np.uint64(40)).astype(np.float64) * 2.0**-24) < weight[alive])
            cell = of[alive[inside]] * t + (v[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64) % t
            r = rank[inside]
            np.minimum.at(best, cell, r)
            first = best[cell] == r
            out[cell[first]] = mix(v[inside][first] ^ u[inside][first])
            step += 1
        region, base, width = region + 1, base + width, base + width
        live = live[weight[live] > base]


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, name0, name1, weight, band array, three longs of sketch) of every row; weight 0 for wordless texts."""
    t = bands * rows
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES // 2):
                n = batch.num_rows
                of, item, count, names = bags(batch.column("text"), size)
                sig = dart_signatures(of, item, count, n, t)
                band = np.zeros((n, bands), np.uint64)
                for k in range(rows):
                    band = mix(band ^ sig[:, k::rows])
                band = mix(band ^ mix(np.arange(bands, dtype=np.uint64)))
                bits = np.zeros((n, 192), np.uint8)
                bits[:, : min(t, 192)] = ((sig >> np.uint64(7)) & np.uint64(1)).astype(np.uint8)[:, :192]
                sketch = np.packbits(bits, axis=1).view(">u8").astype(np.uint64).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * bands, pa.array(band.view(np.int64).reshape(-1)))
                weight = pa.array(np.bincount(of, count, minlength=n).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), *(pa.array(names[:, k].view(np.int64)) for k in (0, 1)), weight, lists, *(pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(3))],
                    ["id", "name0", "name1", "weight", "bands", "s0", "s1", "s2"],
                )

    return picked.mapInArrow(run, "id long, name0 long, name1 long, weight long, bands array<long>, s0 long, s1 long, s2 long")


# Verification ---------------------------------------------------------------------------------------------------------


def similarity(left: pa.Array, right: pa.Array, size: int) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle bags of each pair of texts."""
    n = len(left)
    sides = [bags(x, size)[:3] for x in (left, right)]
    smaller = np.zeros(n)
    (oa, ia, ca), (ob, ib, cb) = sides
    ka, kb = (oa.astype(np.uint64) << _ID_BITS) | ia, (ob.astype(np.uint64) << _ID_BITS) | ib
    at = np.searchsorted(kb, ka)
    at[at == len(kb)] = 0
    hit = kb[at] == ka if len(kb) else np.zeros(len(ka), np.bool_)
    np.add.at(smaller, oa[hit], np.minimum(ca[hit], cb[at[hit]]))
    total = np.bincount(oa, ca, minlength=n) + np.bincount(ob, cb, minlength=n)
    return np.divide(smaller, total - smaller, out=np.zeros(n), where=total > smaller)


def verified(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar enough."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text_a", SLICE_BYTES // 2):
                for part in slices(batch, "text_b", SLICE_BYTES // 2):
                    keep = pa.array(similarity(part.column("text_a"), part.column("text_b"), size) >= threshold)
                    yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], ["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


# Join -----------------------------------------------------------------------------------------------------------------


def semi(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """df's rows whose key is among keys; the keys are broadcast only if they are few."""
    keys = keys.select(on).distinct()
    return df.join(F.broadcast(keys) if at_most(keys, BROADCAST_KEYS) else keys, on, "left_semi")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(id, name0, name1) of every row, names being null for wordless texts; and (name0, name1, copies, class) of every bag.

    A node is the smallest id of a bag's rows. Ids with several texts have several bags; these are in one class anyhow, so
    that it does no harm if they share a node, as long as all texts of the node are compared."""
    sig = checkpoint(signatures(docs.where(F.col(id_col).isNotNull()), id_col, text_col, size))
    heads = sig.where("weight > 0").groupBy("name0", "name1").agg(F.min_by(F.struct("id", "weight", "s0", "s1", "s2", "bands"), "id").alias("head"), F.count("*").alias("copies"))
    heads = checkpoint(heads.select("name0", "name1", "copies", "head.*"))
    rows = heads.select("id", "weight", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = checkpoint(rows.join(buckets, "key"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = semi(texts, members, "id").withColumn("digest", F.xxhash64("text")).dropDuplicates(["id", "digest"]).drop("digest")
    texts = checkpoint(texts)
    w = threshold - 1e-9

    # Large buckets: every member is compared to up to CENTRE_ROUNDS others, which hold together what is alike all through.
    large = members.where(F.col("n") > SMALL_BUCKET).select("key", "id", "weight")
    turns = [F.struct(F.xxhash64("id", F.lit(k)).alias("turn"), F.col("id"), F.col("weight")) for k in range(max(CENTRE_ROUNDS, 1))]
    centres = large.groupBy("key").agg(F.array(*(F.min(t) for t in turns)).alias("centres"))
    met = large.join(centres, "key").select("id", "weight", F.posexplode("centres").alias("k", "c"))
    met = met.where((F.col("k") < CENTRE_ROUNDS) & (F.col("id") != F.col("c.id")) & (F.col("weight") >= w * F.col("c.weight")) & (F.col("c.weight") >= w * F.col("weight")))
    pairs = met.groupBy("id", "k").agg(F.min("c").alias("c")).select(F.col("id").alias("a"), F.col("c.id").alias("b"))
    edges = checkpoint(verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), texts, size, threshold))
    labels = components(edges)
    mixed = members.withColumn("crowded", F.col("n") > SMALL_BUCKET).drop("n").join(labels, F.col("id") == F.col("node"), "left")
    mixed = checkpoint(mixed.withColumn("component", F.coalesce("component", "id")).drop("node"))
    release(members)

    # Members of large components meet, in tiles, all others that share a bucket with their component.
    sizes = mixed.select("id", "component").distinct().groupBy("component").count().where(F.col("count") >= LARGE_COMPONENT)
    homes = checkpoint(sizes.select(F.col("component").alias("home")))
    in_bucket = mixed.join(homes, mixed["component"] == homes["home"]).select("key", "home").distinct()
    visits = mixed.join(in_bucket, "key").where(F.col("component") != F.col("home")).select("id", "component", "weight", "home").distinct()
    visits = visits.join(homes.select(F.col("home").alias("component"), F.lit(True).alias("also")), "component", "left").where(F.col("also").isNull() | (F.col("component") > F.col("home")))
    visits = checkpoint(visits.select("id", "weight", "home"))
    visited = visits.select("home").distinct()
    residents = mixed.join(visited, mixed["component"] == visited["home"]).select("id", "weight", "home").distinct()

    # The other pairs of a bucket: one by one where they are few, in tiles where they are not. Small buckets keep their
    # members of large components, as who shares no other bucket with those has not met them.
    rest = mixed.join(homes.select(F.col("home").alias("component"), F.lit(True).alias("met")), "component", "left")
    rest = rest.where(F.col("met").isNull() | ~F.col("crowded")).select("key", "id", "weight", "component")
    span = rest.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.sum("weight").alias("sum")).where("lo <> hi").select("key", "n", "sum")
    rest = checkpoint(rest.join(span, "key"))
    gathered, whole = _gathered(rest.where(F.col("n") > SMALL_BUCKET).select("key", "id", "component", "weight", "n", "sum"))
    tiled = checkpoint(residents.select("id").union(visits.select("id")).union(gathered.select("id")).distinct())
    features = checkpoint(features_of(semi(texts, tiled, "id"), size))
    found = checkpoint(_met(residents, visits, features, threshold).union(_crowded(gathered, features, threshold)))
    release(mixed, features, visits, tiled)

    few = rest.where(F.col("n") <= SMALL_BUCKET).join(whole, "id", "left")
    few = checkpoint(few.join(heads.select("id", "weight", "s0", "s1", "s2"), ["id", "weight"]))
    x, y = few.alias("x"), few.alias("y")
    differ = sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(3)), F.lit(0))
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component")) & (F.col("x.weight") >= w * F.col("y.weight")) & (F.col("y.weight") >= w * F.col("x.weight")) & (differ <= most_different(BANDS * ROWS, threshold))
    near = near & ~F.coalesce(F.col("x.hub") == F.col("y.hub"), F.lit(False))  # those of one group have been compared
    single = x.join(y, near).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    single = checkpoint(verified(single, texts, size, threshold))
    release(texts, few, rest)

    nodes = heads.select("name0", "name1", "copies", F.col("id").alias("rep"))
    several = sig.where("weight > 0").select("id", "name0", "name1").distinct()
    again = several.groupBy("id").count().where("count > 1").select("id")
    shared = several.join(again, "id", "left_semi").join(nodes, ["name0", "name1"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    labels = components(edges.union(found).union(single).union(shared))
    release(edges, found, single)
    bag_class = nodes.join(labels, nodes["rep"] == labels["node"], "left").select("name0", "name1", "copies", F.coalesce("component", "rep").alias("class"))
    named = [F.when(F.col("weight") > 0, F.col(c)).alias(c) for c in ("name0", "name1")]
    return sig.select("id", *named), checkpoint(bag_class)


def _placed(rows: DataFrame, bag_class: DataFrame) -> DataFrame:
    """(id, class) of rows that have a bag. Bags of very many copies are broadcast, if there are few enough of those."""
    names = ["name0", "name1"]
    rows = rows.where("name0 is not null")
    hot = bag_class.where(F.col("copies") > HOT_COPIES).select(*names, "class")
    if not at_most(hot, BROADCAST_KEYS):
        return rows.join(bag_class, names).select("id", "class")
    rows = rows.join(F.broadcast(hot), names, "left")
    cold = rows.where("class is null").drop("class").join(bag_class.where(F.col("copies") <= HOT_COPIES), names)
    return rows.where("class is not null").select("id", "class").union(cold.select("id", "class"))


# Tiles: many documents against many, without a row for each pair ------------------------------------------------------


def features_of(texts: DataFrame, size: int) -> DataFrame:
    """(id, features): a shingle that occurs n times gives n features, so that what sets share is the weight that bags share."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES // 2):
                of, item, count, _ = bags(batch.column("text"), size)
                of, item = np.repeat(of, count), np.repeat(item, count)
                turn = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                value = mix(mix(item) ^ turn.astype(np.uint64))
                ends = np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ends, pa.array(value.view(np.int64)))], ["id", "features"])

    return texts.mapInArrow(run, "id long, features array<long>")


def shared_weight(left: pa.Array, right: pa.Array) -> np.ndarray:
    """How many features each pair of sets has in common, by products of 0/1 matrices over a few thousand features a time."""
    sides = []
    for lists in (left, right):
        values = np.array(lists.flatten()).view(np.uint64)
        sides.append((np.repeat(np.arange(len(lists)), np.array(pa.compute.list_value_length(lists))), values))
    common = np.intersect1d(sides[0][1], sides[1][1])
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(common):
        return out
    places = []
    for row, value in sides:
        col = np.searchsorted(common, value)
        col[col == len(common)] = 0
        hit = common[col] == value
        row, col = row[hit], col[hit]
        order = np.argsort(col, kind="stable")
        places.append((row[order], col[order]))
    for at in range(0, len(common), 4096):
        parts = []
        for (row, col), n in zip(places, out.shape, strict=True):
            i, j = np.searchsorted(col, (at, at + 4096))
            part = np.zeros((n, min(4096, len(common) - at)), np.float32)
            part[row[i:j], col[i:j] - at] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _alike(left: pa.Table, right: pa.Table, threshold: float) -> np.ndarray:
    sizes = [np.array(pa.compute.list_value_length(t.column("features").combine_chunks())) for t in (left, right)]
    both = shared_weight(left.column("features").combine_chunks(), right.column("features").combine_chunks())
    return both >= threshold * (sizes[0][:, None] + sizes[1][None, :] - both) - 1e-6


def _tiles(n, weight):
    """How many tiles hold rows of that many documents and that weight, so that none is large."""
    return F.greatest(F.ceil(n / F.lit(TILE_ROWS)), F.ceil(weight / F.lit(TILE_WEIGHT)), F.lit(1)).cast("int")


def _met(residents: DataFrame, visits: DataFrame, features: DataFrame, threshold: float) -> DataFrame:
    """(a, b): for each visit to a home, a linked resident from each tile that has one."""
    tiles = lambda df, name: df.groupBy("home").agg(_tiles(F.count("*"), F.sum("weight")).alias(name))
    counts = tiles(residents, "i_n").join(tiles(visits, "j_n"), "home")
    tile = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = residents.join(counts, "home").select("home", "id", F.lit(0).alias("side"), tile("i_n").alias("i"), each("j_n").alias("j"))
    rows = rows.unionByName(visits.join(counts, "home").select("home", "id", F.lit(1).alias("side"), each("i_n").alias("i"), tile("j_n").alias("j")))

    def cell(t: pa.Table) -> pa.Table:
        here, there = (t.filter(pa.compute.equal(t.column("side"), s)) for s in (0, 1))
        alike = _alike(here, there, threshold)
        some = np.flatnonzero(alike.any(axis=0)) if len(alike) else np.zeros(0, np.int64)
        first = alike[:, some].argmax(axis=0) if len(some) else some
        return pa.table({"a": there.column("id").take(pa.array(some)), "b": here.column("id").take(pa.array(first))})

    return rows.join(features, "id").groupBy("home", "i", "j").applyInArrow(cell, "a long, b long")


def _gathered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of crowded buckets under the group of buckets that hang together, instead of under each bucket, where that
    group is small enough to be compared as a whole in a few tiles; a document then goes there once and not once a bucket.
    Also (id, hub) of the members of such groups."""
    hub = rows.groupBy("key").agg(F.min("id").alias("b"))
    groups = components(rows.join(hub, "key").select(F.col("id").alias("a"), "b"))
    placed = checkpoint(rows.join(groups.select("node", F.col("component").alias("hub")), F.col("id") == F.col("node")).drop("node"))
    once = placed.select("hub", "id", "component", "weight").distinct()
    sizes = once.groupBy("hub").agg(F.count("*").alias("n"), F.sum("weight").alias("sum")).where(_tiles(F.col("n"), F.col("sum")) <= WHOLE_GROUP_TILES)
    sizes = checkpoint(sizes)  # so that its size is known, and a hot group is not dealt by its hub where it is small
    whole = once.join(sizes, "hub").select(F.col("hub").alias("key"), "id", "component", "weight", "n", "sum", F.lit(0).alias("sort"))
    apart = placed.join(sizes.select("hub"), "hub", "left_anti").select("key", "id", "component", "weight", "n", "sum", F.lit(1).alias("sort"))
    return whole.unionByName(apart), once.join(sizes.select("hub"), "hub").select("id", "hub").distinct()


def _crowded(rows: DataFrame, features: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that connect what each bucket's members connect, at most one for each member of a pair of tiles."""
    rows = rows.withColumn("tiles", _tiles(F.col("n"), F.col("sum"))).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("sort", "key", "id", "component", "tile", F.least("tile", "k").alias("i"), F.greatest("tile", "k").alias("j"))

    def cell(t: pa.Table) -> pa.Table:
        tile, i, j = np.array(t.column("tile")), t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left, right = t.filter(pa.array(tile == i)), t.filter(pa.array(tile == j))
        a, b = np.array(left.column("id")), np.array(right.column("id"))
        out_a, out_b = [], []
        if len(a) and len(b):
            _, label = np.unique(np.concatenate([np.array(left.column("component")), np.array(right.column("component"))]), return_inverse=True)
            la, lb = label[: len(a)], label[len(a) :]
            if len(np.unique(label)) > 1:
                u, v = np.nonzero(_alike(left, right, threshold) & (la[:, None] != lb[None, :]))
                _, first = np.unique(la[u] * (label.max() + 1) + lb[v], return_index=True)  # one link for two components
                group = np.arange(label.max() + 1)
                for x, y in zip(u[first].tolist(), v[first].tolist(), strict=True):
                    p, q = group[la[x]], group[lb[y]]
                    if p != q:
                        group[group == q] = p
                        out_a.append(a[x])
                        out_b.append(b[y])
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return rows.join(features, "id").groupBy("sort", "key", "i", "j").applyInArrow(cell, "a long, b long")


def most_different(t: int, threshold: float) -> int:
    """Bits of t one-bit coordinates in which a pair at the threshold differs at most, but for one pair in a million."""
    p = (1 - threshold) / 2
    return math.ceil(t * p + 5 * math.sqrt(t * p * (1 - p)))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each different id: id_col, class_id (the smallest id of its class), kept (whether it is that one)."""
    rows, bag_class = links(docs, id_col, text_col, size, threshold)
    known = rows.select("id", F.col("id").alias("class")).union(_placed(rows, bag_class)).groupBy("id").agg(F.min("class").alias("class"))
    known = known.union(docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long"), F.lit(None).cast("long")).distinct())
    return known.select(F.col("id").alias(id_col), F.col("class").alias("class_id"), F.coalesce(F.col("class") == F.col("id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class, the one with the smallest id (of several texts with that id, the one with the
    smallest hash); rows with a null id stay."""
    gone = classes(docs, id_col, text_col, size, threshold).where("not kept").select(F.col(id_col).alias("gone"))
    kept = docs.join(gone, docs[id_col] == gone["gone"], "left_anti")
    hashed, again_id, least = fresh(docs, "hashed", "again_id", "least")
    again = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(again_id)).agg(F.count("*").alias("n"), F.min(F.xxhash64(text_col)).alias(least)).where("n > 1").drop("n")
    again = checkpoint(again)
    if again.isEmpty():
        return kept
    once = kept.withColumn(hashed, F.xxhash64(text_col)).join(again, (F.col(id_col) == F.col(again_id)) & (F.col(hashed) == F.col(least))).select(*docs.columns).dropDuplicates([id_col])
    return kept.join(again, F.col(id_col) == F.col(again_id), "left_anti").unionByName(once)
