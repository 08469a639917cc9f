"""N-gram Jaccard self-join by vertical partitioning of the global n-gram order.

The order puts n-grams that few documents hold first, by hash, and those that many hold
last, by document frequency. It is cut into fragments. Two sets of sizes m and n that link
share one of the first size - needed + 1 n-grams of each, so only those find candidates,
under the length and position bounds. For candidates the overlap is counted separately in
each fragment of the order and summed per pair.

Documents with the same set form one class, which goes through the join once. Within the
documents of one n-gram, candidates are made in rounds, none of which lists all pairs of a
large group of near copies. First each document meets one pivot, the one with most frequent
n-grams in its set, as what copies do not share is rare. The links found are merged to components,
and only documents of different components meet: in a group of at most SMALL documents directly, in
a larger one by what sets them apart from the pivot. Where x and y differ
from the pivot in the sets X and Y, they differ from each other in (X or Y, not both), so a link
asks for |X| + |Y| - 2 |X and Y| to be small. Of two documents far from the pivot, or of one far
and one near, X and Y must therefore share an n-gram among the first few of each, in an order
that puts what few members of the group have first. Random edits share none, nor do documents that
only share a common line with the pivot, however far from it they are.

Of these last candidates, each component tries its most promising one first, for ROUNDS rounds;
those that the links found so far have brought into one component need no try, and what is left
after the rounds is tried all at once. So no link between components is missed.

A candidate must also pass the bound that parity bitmaps give: sets whose bitmaps differ in d
bits differ in d shingles at least. That, too, rejects no pair that links.

Frequent n-grams (those that OFTEN documents or more have at their head, counted exactly, and the
FREQUENT most frequent of them if there are more) only change the order, which any two documents
share: they cost no link. OFTEN does not grow with the input, or the groups would.

Results for odd input. Null or empty texts and texts without words have no shingle and link
with nothing. A text of fewer words than a shingle is one shingle as a whole. Rows with a
null id link with nothing and have no component. Rows repeated with the same id are linked by
their own texts. Ties do not arise: a component is named by its least id. An empty table gives an
empty result. Other columns are ignored, and kept by `keep_one_of_each`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import wordhash
from .components import connected_components
from .scratch import BROADCAST_IDS, Bitmap, broadcast_if_small, discard, materialize, ship, table

FRAGMENTS = 8
#: Frequent n-grams at most, 16 bytes each, and from how many documents on.
FREQUENT, OFTEN = 1 << 19, 64
#: Documents of one n-gram that meet directly; in larger groups, they meet by their differences from the pivot.
SMALL = 256
#: Rounds in which components try their best candidate alone.
ROUNDS = 3
#: Shingles of all pivots together, 8 bytes each, up to which they are broadcast; beyond that Spark shuffles and splits skewed keys.
PIVOTS = 1 << 22
#: 64-bit words that the parity bitmap of a set has at most.
BITMAP = 1024


def shingle_set(found: np.ndarray, k: int) -> np.ndarray:
    """Sorted signed hashes of the distinct shingles."""
    return np.unique(wordhash.shingles(found, k).view(np.int64))


def class_of(items: np.ndarray) -> int:
    """A 64-bit name of the set."""
    with np.errstate(over="ignore"):
        both = np.array([wordhash.mix(items.view(np.uint64)).sum(dtype=np.uint64), len(items)], np.uint64)
    return int(wordhash.mix(both[:1] ^ wordhash.mix(both[1:]))[0].view(np.int64))


def parities(items: np.ndarray) -> np.ndarray:
    """For each bucket of hashes whether the set has an odd number of its shingles; about as many buckets as shingles, a power of two."""
    size = 64 * min(BITMAP, 1 << max(0, (len(items) - 1) // 64).bit_length())
    at = (items.view(np.uint64) >> np.uint64(17)) & np.uint64(size - 1)
    odd = (np.bincount(at.astype(np.int64), minlength=size) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _needed(n: int, percent: int) -> int:
    """Least overlap with which a set of n links to any other."""
    return -(-percent * n // 100)


def heads(k: int, percent: int, frequent=None, more: float = 1.0, bitmaps: bool = True):
    """A function for mapInArrow: (id, text) to (id, n, class, parity bitmap, frequent n-grams in 1000, the head of the set in the global order).

    The head comes in two columns, n-grams that are not frequent and those that are. So one pass can keep
    the second, which are few, and another can send the first on without a table of them.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank = frequent.value if frequent is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in found:
            ids = batch.column(0).to_pylist()
            for first, group in wordhash.batches(batch.column(1).to_pylist()):
                hashes, begins = wordhash.words_of(group)
                out = defaultdict(list)
                for j, (a, b) in enumerate(zip(begins[:-1], begins[1:], strict=True)):
                    items = shingle_set(hashes[a:b], k)
                    head = len(items) - _needed(len(items), percent) + 1 if len(items) else 0
                    head, common = min(len(items), int(head * more)), 0
                    if len(often) and len(items):
                        at = np.minimum(np.searchsorted(often, items), len(often) - 1)
                        last = often[at] == items
                        seldom, common = items[~last], 1000 * int(last.sum()) // len(items)
                        tail, order = items[last], np.argsort(rank[at[last]], kind="stable")
                        chosen, rest = seldom[:head], tail[order][: max(0, head - len(seldom))]
                    else:
                        chosen, rest = items[:head], items[:0]
                    out["id"].append(ids[first + j])
                    out["n"].append(len(items))
                    out["class"].append(class_of(items) if len(items) else None)
                    out["bitmap"].append(parities(items) if bitmaps else None)
                    out["common"].append(common)
                    out["seldom"].append(chosen)
                    out["often"].append(rest)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["id"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["class"], pa.int64()), pa.array(out["bitmap"], pa.list_(pa.int64())), pa.array(out["common"], pa.int32()), *(pa.array(out[x], pa.list_(pa.int64())) for x in ("seldom", "often"))],
                    names=["id", "n", "class", "bitmap", "common", "seldom", "often"],
                )

    return run


def fragments(k: int, frequent):
    """A function for mapInArrow: (id, text) to (class, fragment, the part of the set in that fragment).

    The fragments follow the global order: ranges of hashes of the n-grams that few documents hold, then all frequent ones.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, _ = frequent.value
        cuts = np.linspace(-(2.0**63), 2.0**63, FRAGMENTS)[1:-1].astype(np.int64)
        for batch in found:
            for _, group in wordhash.batches(batch.column(1).to_pylist()):
                hashes, begins = wordhash.words_of(group)
                out = defaultdict(list)
                for a, b in zip(begins[:-1], begins[1:], strict=True):
                    items = shingle_set(hashes[a:b], k)
                    if len(items):
                        last = np.isin(items, often, assume_unique=True) if len(often) else np.zeros(len(items), bool)
                        seldom, name = items[~last], class_of(items)
                        for f, part in enumerate([*np.split(seldom, np.searchsorted(seldom, cuts)), items[last]]):
                            out["class"].append(name)
                            out["fragment"].append(f)
                            out["part"].append(part)
                yield pa.RecordBatch.from_arrays([pa.array(out["class"], pa.int64()), pa.array(out["fragment"], pa.int32()), pa.array(out["part"], pa.list_(pa.int64()))], names=["class", "fragment", "part"])

    return run


def _may_link(percent: int, m: str, i: str, n: str, j: str) -> Column:
    """Bounds on sets of sizes m and n whose first common n-gram stands at i and j of the order, from 0."""
    m, i, n, j = (F.col(x) for x in (m, i, n, j))
    room = F.least(m - i, n - j)
    return (100 * F.least(m, n) >= percent * F.greatest(m, n)) & ((100 + percent) * room >= percent * (m + n))


def _folded(bitmap: Column, size: Column) -> Column:
    """The bitmap with `size` words: buckets that differ in the top bits only are joined."""
    xor = lambda s, k: s.bitwiseXOR(F.get(bitmap, k))
    folded = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(F.sequence(i, F.size(bitmap) - 1, size), F.lit(0).cast("long"), xor))
    return F.when(F.size(bitmap) == size, bitmap).otherwise(folded)


def _bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, m, b, n) with most_both, an upper bound of the overlap."""
    left, right = (classes.select(F.col("class").alias(x), F.col("bitmap").alias(f"of_{x}")) for x in "ab")
    size = F.least(F.size("of_a"), F.size("of_b"))
    differ = F.aggregate(F.zip_with(_folded(F.col("of_a"), size), _folded(F.col("of_b"), size), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.join(left, "a").join(right, "b").select(*pairs.columns, ((F.col("m") + F.col("n") - differ) / 2).alias("most_both"))


def _may_reach(percent: int) -> Column:
    return (100 + percent) * F.col("most_both") >= percent * (F.col("m") + F.col("n"))


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, m, b, n) that the bitmaps do not rule out."""
    return _bounded(pairs, classes).where(_may_reach(percent)).select("a", "m", "b", "n")


def _parts(pairs: DataFrame, classes: DataFrame, rows: DataFrame, k: int, frequent) -> tuple[DataFrame, list[DataFrame]]:
    """The fragments of the sets of all classes in `pairs`, one set a class, and the tables that this takes."""
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    wanted = materialize(wanted.join(classes.select("class", "least_id"), "class").select(F.col("least_id").alias("wanted_id")).distinct(), "wanted")
    texts = rows.join(broadcast_if_small(wanted), F.col("id") == F.col("wanted_id"), "left_semi")
    parts = materialize(texts.mapInArrow(fragments(k, frequent), "class long, fragment int, part array<long>"), "fragments")
    return parts, [wanted, parts]


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, k: int, percent: int, frequent) -> DataFrame:
    """Of the pairs (a, m, b, n) of classes those that link, as a table: overlaps counted by fragment, then summed."""
    parts, used = _parts(pairs, classes, rows, k, frequent)
    left = parts.select(F.col("class").alias("a"), "fragment", F.col("part").alias("of_a"))
    right = parts.select(F.col("class").alias("b"), "fragment", F.col("part").alias("of_b"))
    shared = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "m", "b", "n", "fragment", F.size(F.array_intersect("of_a", "of_b")).alias("both"))
    # a class comes twice where the input repeats a row, with the same overlaps
    shared = shared.groupBy("a", "m", "b", "n", "fragment").agg(F.max("both").alias("both"))
    total = shared.groupBy("a", "m", "b", "n").agg(F.sum("both").alias("both"))
    links = materialize(total.where(100 * F.col("both") >= percent * (F.col("m") + F.col("n") - F.col("both"))).select("a", "b"), "links")
    discard(*used)
    return links


def _perhaps_of(apart: DataFrame, held: DataFrame) -> DataFrame:
    """The rows of `apart` without most of the n-grams that `held` does not have; all of them where a bitmap of `held` would be too large."""
    known = Bitmap.of(held, "gram")
    if known is None:
        return apart.select("a", "b", "apart")
    sent = apart.sparkSession.sparkContext.broadcast(known)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            grams = batch.column(2)
            may = sent.value.may_hold(grams.flatten().to_numpy(zero_copy_only=False))
            ends = np.cumsum(np.concatenate([[0], grams.value_lengths().to_numpy(zero_copy_only=False)]))
            kept = np.concatenate([[0], np.cumsum(may)])[ends]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(kept, pa.int32()), grams.flatten().filter(pa.array(may)))], names=["a", "b", "apart"])

    return apart.select("a", "b", "apart").mapInArrow(run, "a long, b long, apart array<long>")


def _by_difference(spokes: DataFrame, classes: DataFrame, rows: DataFrame, k: int, percent: int, frequent) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) with the pivots, and pairs (a, m, b, n) of other classes that may link.

    `spokes` are distinct (a, m, b, n, label): a pivot a of size m, a member b of size n of its group, and b's component.
    The pairs carry the components la and lb of their classes.
    """
    parts, used = _parts(spokes, classes, rows, k, frequent)
    pivots = spokes.select(F.col("a").alias("class")).distinct()
    few = pivots.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    left = parts.join(F.broadcast(pivots) if few else pivots, "class", "left_semi").select(F.col("class").alias("a"), "fragment", F.col("part").alias("of_a"))
    left = left.dropDuplicates(["a", "fragment"])  # a class comes twice where the input repeats a row
    # a pivot of many members has few keys, so its parts are sent to the members where they are small
    left = F.broadcast(left) if few and (left.agg(F.sum(F.size("of_a"))).first()[0] or 0) <= PIVOTS else left
    right = parts.select(F.col("class").alias("b"), "fragment", F.col("part").alias("of_b"))
    # the sets stay where they are, and so do their differences: only sizes and n-grams are put together
    apart = right.join(broadcast_if_small(spokes.select("a", "b"), BROADCAST_IDS // 4), "b").join(left, ["a", "fragment"])
    apart = materialize(apart.select("a", "b", "fragment", F.concat(F.array_except("of_b", "of_a"), F.array_except("of_a", "of_b")).alias("apart")), "apart")
    sizes = apart.groupBy("a", "b", "fragment").agg(F.max(F.size("apart")).alias("d")).groupBy("a", "b").agg(F.sum("d").alias("d"))
    measured = materialize(spokes.join(sizes, ["a", "b"]), "measured")
    m, n, d = (F.col(c).cast("double") for c in "mnd")
    tau = (100 - percent) / (100 + percent)  # sets link when they differ in at most tau of the sum of their sizes
    near = (100 + percent) * F.col("d") <= (100 - percent) * (F.col("m") + F.col("n"))
    # least overlap of the differences of this member and of any that it may link to
    least = d - tau * n * (1 + 100 / percent)
    least = F.greatest(F.lit(1.0), F.when(near, F.greatest((d + tau * (m - n)) / 2, least)).otherwise(least))

    each = apart.select("a", "b", F.explode("apart").alias("gram"))
    held = materialize(each.groupBy("a", "gram").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1"), "held")
    # most n-grams have one holder, and do not move to learn that
    shared = _perhaps_of(apart, held).select("a", "b", F.explode("apart").alias("gram"))
    shared = shared.join(broadcast_if_small(held, BROADCAST_IDS // 8), ["a", "gram"])
    seldom_first = shared.groupBy("a", "b").agg(F.sort_array(F.collect_set(F.struct("holders", "gram"))).alias("shared"))
    # what only this member has comes first in the order and meets nothing
    heads_of = measured.join(seldom_first, ["a", "b"]).withColumns({"near": near, "last": d - least + 1e-6, "alone": F.col("d") - F.size("shared")})
    heads_of = heads_of.select("a", F.col("b").alias("x"), "n", "label", "d", "near", "last", "alone", F.posexplode("shared").alias("pos", "item"))
    heads_of = heads_of.withColumn("place", F.col("alone") + F.col("pos")).where("place <= last").select("a", "x", "n", "label", "d", "near", "place", F.col("item.gram").alias("gram"))
    heads_of = materialize(heads_of, "differences")
    one = heads_of.toDF("a", "x", "m", "la", "dx", "near_x", "i", "gram")
    other = heads_of.toDF("a", "y", "n", "lb", "dy", "near_y", "j", "gram")
    sizes = F.col("m") + F.col("n")
    met = (F.col("x") < F.col("y")) & (F.col("la") != F.col("lb")) & ~(F.col("near_x") & F.col("near_y")) & (100 * F.least("m", "n") >= percent * F.greatest("m", "n"))
    room = (100 + percent) * (F.col("dx") + F.col("dy")) - (100 - percent) * sizes <= 2 * (100 + percent) * F.least(F.col("dx") - F.col("i"), F.col("dy") - F.col("j"))
    pairs = one.join(other, ["a", "gram"]).where(met & room).select(F.col("x").alias("a"), "m", F.col("y").alias("b"), "n", "la", "lb").distinct()
    links, pairs = materialize(measured.where(near).select("a", "b"), "links"), materialize(pairs, "pairs")
    discard(*used, apart, measured, held, heads_of)
    return links, pairs


def _mixed(met: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of `met` of the groups that hold several components, with their own component and the group's largest, as a table."""
    known = label.select(F.col("node").alias("class"), "label")
    spread = materialize(met.join(known, "class", "left").withColumn("label", F.coalesce("label", "class")), "spread")
    shares = spread.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = shares.groupBy("gram").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1").drop("labels")
    mixed = materialize(spread.join(mixed, "gram"), "mixed")
    discard(spread)
    return mixed


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """The components `label` after further links."""
    return connected_components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links))


def _best_first(pairs: DataFrame, classes: DataFrame, rows: DataFrame, k: int, percent: int, frequent) -> list[DataFrame]:
    """Links among the pairs (a, m, b, n, la, lb, most_both), enough of them to join every two components that a link joins."""
    found = []
    for _ in range(ROUNDS):
        likely = F.struct((-F.col("most_both") / (F.col("m") + F.col("n"))).alias("unlike"), "a", "b", "m", "n", "la", "lb").alias("pair")
        sides = pairs.select(F.col("la").alias("of"), likely).unionByName(pairs.select(F.col("lb").alias("of"), likely))
        tried = materialize(sides.groupBy("of").agg(F.min("pair").alias("pair")).select("pair.*").distinct(), "tried")
        links = _verified(tried.select("a", "m", "b", "n"), classes, rows, k, percent, frequent)
        found.append(links)
        joined = connected_components(tried.join(links, ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b")))
        left = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        for side in ("la", "lb"):
            left = left.join(joined.select(F.col("node").alias(side), F.col("label").alias("new")), side, "left").withColumn(side, F.coalesce("new", side)).drop("new")
        pairs = materialize(left.where("la <> lb"), "pairs")
        discard(tried)
        if pairs.isEmpty():
            return found
    return [*found, _verified(pairs.select("a", "m", "b", "n"), classes, rows, k, percent, frequent)]


def frequent_grams(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that stand in at least OFTEN rows, sorted, and how often; the most frequent of them if they are over FREQUENT."""
    counted = materialize(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= OFTEN), "frequent")
    # how many n-grams have each count: from the highest down as many counts as fit
    least, kept = OFTEN, 0
    for rows, n in counted.groupBy("rows").agg(F.count(F.lit(1))).orderBy(F.desc("rows")).collect():
        kept += n
        if kept > FREQUENT:
            least = rows + 1
            break
    found = counted.where(F.col("rows") >= least).toArrow()
    discard(counted)
    items, counts = (found.column(c).to_numpy().astype(np.int64) for c in ("gram", "rows"))
    order = np.argsort(items)
    return items[order], counts[order]


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (null for a null id)."""
    spark = docs.sparkSession
    rows = ship(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n long, class long, bitmap array<long>, common int, seldom array<long>, often array<long>"
    # 1.3 times the head, as the heads get longer where frequent n-grams leave them
    grams = rows.mapInArrow(heads(k, percent, more=1.3, bitmaps=False), schema).select(F.explode("seldom").alias("gram"))
    often = frequent_grams(grams)
    sent = spark.sparkContext.broadcast(often)

    # n-grams that are not frequent are made again where they are shuffled, as a table of them would take as much disk beside that
    profile = rows.mapInArrow(heads(k, percent, sent), schema)
    profile = materialize(profile.withColumn("after", F.size("seldom")).drop("seldom"), "profile")
    linkable = profile.where("id is not null and class is not null")
    classes = materialize(linkable.groupBy("class", "n").agg(F.min("id").alias("least_id"), F.first("bitmap").alias("bitmap")), "classes")
    # one document stands for each class; the others are few, and told to the heads, which do not move for this
    others = linkable.select("class", "id").join(classes.select("class", "least_id"), "class").where("id <> least_id")
    others = materialize(others.select(F.col("class").alias("of_class"), F.col("id").alias("other_id")).distinct(), "others")
    told = broadcast_if_small(others, BROADCAST_IDS // 2)

    def held(found: DataFrame, head: str, after: Column) -> DataFrame:
        kept = found.where("id is not null and class is not null").join(told, (F.col("class") == F.col("of_class")) & (F.col("id") == F.col("other_id")), "left_anti")
        return kept.select("class", "n", "common", F.posexplode(head).alias("place", "gram"), after.alias("after")).select("class", "n", "common", (F.col("place") + F.col("after")).alias("place"), "gram")

    of_gram = W.partitionBy("gram")
    cleanest = F.struct((-F.col("common")).alias("rare"), "place", F.col("class").alias("a"), F.col("n").alias("m"))
    seldom_held = held(rows.mapInArrow(heads(k, percent, sent, bitmaps=False), schema), "seldom", F.lit(0))
    met = seldom_held.withColumn("docs", F.count(F.lit(1)).over(of_gram)).withColumn("pivot", F.min(cleanest).over(of_gram)).where("docs > 1")
    # of a frequent n-gram the pivot is found by an aggregate that combines early, and sent to its rows
    often_held = held(profile, "often", F.col("after"))
    pivots = often_held.groupBy("gram").agg(F.count(F.lit(1)).alias("docs"), F.min(cleanest).alias("pivot")).where("docs > 1")
    pivots = F.broadcast(pivots) if len(often[0]) <= BROADCAST_IDS // 8 else pivots
    met = materialize(met.unionByName(often_held.join(pivots, "gram")).drop("common"), "met")
    # the frequent n-grams and bitmaps are not read again
    wide, profile = profile, materialize(profile.select("id", "n", "class"), "sizes")
    discard(wide, others)

    near = met.select(F.col("pivot.a").alias("a"), F.col("pivot.m").alias("m"), F.col("pivot.place").alias("i"), F.col("class").alias("b"), "n", F.col("place").alias("j"))
    tried = near.where((F.col("a") != F.col("b")) & _may_link(percent, "m", "i", "n", "j")).select("a", "m", "b", "n").distinct()
    tried = materialize(_plausible(tried, classes, percent), "pairs")
    links = _verified(tried, classes, rows, k, percent, sent)
    label = connected_components(links)
    mixed = _mixed(met, label)
    discard(met)

    spokes = mixed.where((F.col("docs") > SMALL) & (F.col("class") != F.col("pivot.a"))).select(F.col("pivot.a").alias("a"), F.col("pivot.m").alias("m"), F.col("class").alias("b"), "n", "label").distinct()
    spokes = materialize(spokes, "spokes")
    to_pivots, by_difference = _by_difference(spokes, classes, rows, k, percent, sent)
    few = mixed.where(F.col("docs") <= SMALL)
    one = few.where("label <> main").select("gram", F.col("class").alias("a"), F.col("n").alias("m"), F.col("place").alias("i"), F.col("label").alias("la"))
    other = few.select(F.col("gram").alias("same_gram"), "main", F.col("class").alias("b"), "n", F.col("place").alias("j"), F.col("label").alias("lb"))
    across = (F.col("la") != F.col("lb")) & ((F.col("lb") == F.col("main")) | (F.col("a") < F.col("b"))) & _may_link(percent, "m", "i", "n", "j")
    rest = one.join(other, (F.col("gram") == F.col("same_gram")) & across).select("a", "m", "b", "n", "la", "lb").unionByName(by_difference)
    swapped = F.when(F.col("a") < F.col("b"), F.struct("a", "m", "la", "b", "n", "lb")).otherwise(F.struct(*(F.col(x).alias(y) for x, y in zip(["b", "n", "lb", "a", "m", "la"], ["a", "m", "la", "b", "n", "lb"], strict=True))))
    done = tried.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    rest = rest.select(swapped.alias("pair")).select("pair.*").distinct()
    rest = rest.join(done, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_anti")
    rest = materialize(_bounded(rest, classes).where(_may_reach(percent)), "pairs")
    discard(mixed, spokes, tried, by_difference)
    label = _merged(label, to_pivots)
    for more in _best_first(rest, classes, rows, k, percent, sent):
        label = _merged(label, more)

    named = classes.select("class", "least_id").join(label.select(F.col("node").alias("class"), "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    names = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    names = named.join(names, "label").select("class", "component_id")
    found = profile.where("class is not null and id is not null").join(names, "class").select("id", F.col("n").alias("n_shingles"), "component_id")
    alone = profile.where("class is null or id is null").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return found.unionByName(alone).withColumnRenamed("id", id_col)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that have the least id of their component, with the columns of `docs`."""
    found = link_components(docs, id_col, text_col, k, percent)
    dropped = materialize(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("dropped_id")).distinct(), "dropped")
    dropped = broadcast_if_small(dropped)
    return docs.join(dropped, docs[id_col] == dropped["dropped_id"], "left_anti")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))
