"""Exact n-gram Jaccard join in metric space, and the classes that its links connect.

The distance 1 - J of shingle sets is a metric. A region is a set of documents; its pivots are some of them, every document goes to
the Voronoi cell of its nearest pivot, and also to each cell whose pivot is at most twice the radius farther away: by the triangle
inequality both ends of any link then meet in a cell. Documents within the radius of a pivot are linked to it and so need no
comparison with each other; of them a cell keeps only those that the triangle inequality lets reach one of its other documents.
Cells are joined in the same way while that is clearly less work; other regions by inverted lists of their sets' rarest elements.
A region too large for a task that pivots do not part is dealt into blocks, and every two blocks meet in a task of their own.

Unrelated texts all lie at distance 1 from each other and from any pivot, so pivots chosen from all documents cannot part them. The
first regions therefore come from exact signatures. Each set is split by hash into so many classes that the sets of a link agree
wholly in more classes than either of them leaves out; sets that share a class are in one region, and only these are compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm import bitmap
from panelspark.llm import wordhash as wh
from panelspark.llm.graph import components
from panelspark.llm.rows import packed, plain, row_key, unpacked
from panelspark.session import cut_lineage

#: Elements of all sets of a region that one task joins.
REGION_ELEMENTS = 4_000_000
#: Elements of all sets of a region times its sets: what its pairs may take in one task.
REGION_WORK = 1e10
PIVOTS = 8
#: Regions of so few documents are not parted further.
PAIRS = 24
MEMBER = "region long, h1 long, h2 long, near long, elements binary"


@dataclass(frozen=True)
class Rule:
    """Sets of ``words``-word shingles link when 100 * intersection >= ``percent`` * union."""

    words: int = 5
    percent: int = 80

    @property
    def radius(self) -> float:
        return 1 - self.percent / 100

    def links(self, common, a, b):
        return 100 * common >= self.percent * (a + b - common)

    def differing(self, n: int) -> int:
        """The most elements by which a set of ``n`` differs from one it links with."""
        return (100 - self.percent) * n // self.percent


def _sets(column, k: int):
    """Index and sorted distinct shingle hashes of every text with a word; fewer than ``k`` words are one shingle."""
    for words in wh.groups(column, wh.BY_SPACE):
        grams, bounds = wh.grams(words.hash, k), words.bounds
        for t, n in enumerate(words.counts):
            lo = bounds[t]
            if n >= k:
                yield words.first + t, np.unique(grams[lo : lo + n - k + 1])
            elif n:
                yield words.first + t, wh.grams(words.hash[lo : lo + n], n)


def _name(elements: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set."""
    a = np.add.reduce(wh.scramble(elements ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)
    b = np.add.reduce(wh.scramble(elements + np.uint64(0x14057B7EF767814F)), dtype=np.uint64)
    n = np.uint64(len(elements))
    return tuple(int(x) for x in wh.scramble(np.array([a + n, b ^ n], np.uint64)).view(np.int64))


def _signatures(elements: np.ndarray, rule: Rule) -> list[np.ndarray]:
    """Signatures of which the sets of any link share at least one.

    Sets are split into m classes by hash. The sets of a link differ in at most d elements, so in at most d classes; each set gives
    its d + 1 first classes by an order that depends on a class's content alone (large classes first), so the first class that
    both share is given by both. m follows from the power of two below the set's size; a set that may link with sets beyond the
    next power gives signatures for both.
    """
    n = len(elements)
    d = rule.differing(n)
    out = []
    for level in {n.bit_length(), (100 * n // rule.percent).bit_length()}:
        m = max(1, -(-23 * (rule.differing((1 << level) - 1) + 1) // 20))
        kind = (elements % np.uint64(m)).astype(np.int64)
        order = np.argsort(kind, kind="stable")
        kind, values = kind[order], wh.scramble(elements[order] + np.uint64(level))
        at = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
        sums, count = np.zeros(m, np.uint64), np.zeros(m, np.int64)
        sums[kind[at]] = np.add.reduceat(values, at)
        count[kind[at]] = np.diff(np.append(at, n))
        sums = wh.scramble(sums + np.arange(m, dtype=np.uint64) * np.uint64(wh.STEP) + np.uint64(level))
        first = np.lexsort((sums, -count))[: d + 1]
        out.append(sums[first])
    return out


def _described(documents: DataFrame, rule: Rule) -> DataFrame:
    """k1, k2, doc_id, n_shingles and the set's name h1, h2 (null without words) of every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def described(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            names = [(None, None)] * batch.num_rows
            for i, elements in _sets(batch.column("text"), rule.words):
                n[i], names[i] = len(elements), _name(elements)
            h1, h2 = zip(*names) if names else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), batch.column("doc_id"), pa.array(n), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())],
                ["k1", "k2", "doc_id", "n_shingles", "h1", "h2"])

    return plain(documents, "doc_id", "text").select(*row_key(), "doc_id", "text").mapInArrow(described, f"k1 long, k2 long, doc_id {kind}, n_shingles long, h1 long, h2 long")


def _signed(documents: DataFrame, rule: Rule) -> DataFrame:
    """(signature, h1) rows of all sets."""

    def signed(batches):
        for batch in batches:
            names, signatures = [], []
            for _, elements in _sets(batch.column(0), rule.words):
                for s in _signatures(elements, rule):
                    names.append(np.full(len(s), _name(elements)[0], np.int64))
                    signatures.append(s.view(np.int64))
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(signatures)), pa.array(np.concatenate(names))], ["signature", "h1"])

    return plain(documents, "text").mapInArrow(signed, "signature long, h1 long")


def regions(documents: DataFrame, rule: Rule) -> DataFrame:
    """(h1, region): sets that share signatures, directly or through others, are in one region; sets alone are left out."""
    # signatures outweigh the texts' links by far, so they are made and shuffled once
    first = F.min("h1").over(Window.partitionBy("signature"))
    pairs = _signed(documents, rule).withColumn("first", first).where(F.col("h1") != F.col("first")).select(F.col("h1").alias("u"), F.col("first").alias("v"))
    roots = components(pairs.distinct())
    return roots.select(F.col("node").alias("h1"), F.col("root").alias("region")).unionByName(roots.select(F.col("root").alias("h1"), F.col("root").alias("region")).distinct())


def _members(documents: DataFrame, described: DataFrame, found: DataFrame, rule: Rule, bits: int) -> DataFrame:
    """One row per distinct set that has a region, with its elements."""
    wanted = described.join(found, "h1").groupBy("h1", "h2").agg(F.first("region").alias("region"), F.min(F.struct("k1", "k2")).alias("k")).select("region", "h1", "h2", "k.k1", "k.k2")
    wanted = cut_lineage(wanted)
    filters = bitmap.build(wanted, "k1", bits)

    def elements_of(batches):
        known = filters.value
        for batch in batches:
            batch = batch.filter(pa.array(bitmap.contains(known, batch.column("k1").to_numpy().view(np.uint64))))
            at, sets = [], []
            for i, elements in _sets(batch.column("text"), rule.words):
                at.append(i)
                sets.append(elements.tobytes())
            some = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column("k1"), some.column("k2"), pa.array(sets, pa.binary())], ["k1", "k2", "elements"])

    sets = plain(documents, "doc_id", "text").select(*row_key(), "text").mapInArrow(elements_of, "k1 long, k2 long, elements binary")
    # repeated rows give equal members; a small region drops the repetition itself
    return sets.join(wanted, ["k1", "k2"]).select("region", "h1", "h2", F.lit(None).cast("long").alias("near"), "elements")


class _Sets:
    """Sets of one region in a task; the classes that links make are kept as labels."""

    def __init__(self, sets: list[np.ndarray], near: list, rule: Rule):
        self.sets, self.rule = sets, rule
        self.size = np.array([len(s) for s in sets], np.int64)
        self.label = np.arange(len(sets))
        self.members = {i: [i] for i in range(len(sets))}
        self.compared = 0
        first: dict = {}
        for i, p in enumerate(near):  # sets that are known to be linked to the same pivot
            if p is not None:
                self.union(first.setdefault(p, i), i)

    def root(self, i: int) -> int:
        """The smallest set of the class of set i."""
        return self.members[self.label[i]][0]

    def union(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if a != b:
            if len(self.members[a]) < len(self.members[b]):
                a, b = b, a
            moved = self.members.pop(b)
            self.label[moved] = a
            low = min(self.members[a][0], moved[0])
            self.members[a] += moved
            if self.members[a][0] != low:
                at = self.members[a].index(low)
                self.members[a][0], self.members[a][at] = low, self.members[a][0]

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set i with others."""
        mine = self.sets[i]
        values = np.concatenate([self.sets[j] for j in others])
        at = np.minimum(np.searchsorted(mine, values), len(mine) - 1)
        starts = np.concatenate(([0], np.cumsum(self.size[others])[:-1]))
        self.compared += len(others)
        return np.add.reduceat((mine[at] == values).astype(np.int64), starts)

    def distance(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.common(i, others)
        union = self.size[i] + self.size[others] - both
        return 1 - both / union, self.rule.links(both, self.size[i], self.size[others])

    def settle(self, i: int, others: np.ndarray) -> None:
        """Link set i with those of ``others`` it must be compared with; sets of its own class need no comparison."""
        some = 4
        while len(others):
            others = others[self.label[others] != self.label[i]]
            now, others = others[:some], others[some:]
            if len(now):
                for j in now[self.rule.links(self.common(i, now), self.size[i], self.size[now])]:
                    self.union(i, j)
            some *= 2

    def by_prefix(self, ids: np.ndarray) -> None:
        """Join a region by an inverted list of prefixes.

        Elements are ordered by rarity in the region. Two linked sets share one of their rarest (100 - percent)% (and one more), so
        a set is compared only with sets listed under those, of fitting size and not yet of its class.
        """
        ids = ids[np.argsort(self.size[ids], kind="stable")]
        n = self.size[ids]
        place = np.repeat(np.arange(len(ids)), n)
        _, token, count = np.unique(np.concatenate([self.sets[i] for i in ids]), return_inverse=True, return_counts=True)
        order = np.lexsort((token, count[token], place))
        token = token[order]
        ends = np.cumsum(n)
        kept = n + (-self.rule.percent * n // 100) + 1  # n - ceil(percent n / 100) + 1
        inside = np.arange(len(token)) - np.repeat(ends - n, n) < np.repeat(kept, n)
        token, place = token[inside], place[inside]
        listed = np.lexsort((place, token))
        lists, begin = place[listed], np.searchsorted(token[listed], np.arange(len(count) + 1))
        at = np.empty(len(token), np.int64)
        at[listed] = np.arange(len(token))  # of every prefix token, its own place in the lists
        starts = np.searchsorted(place, np.arange(len(ids) + 1))
        small = -(-self.rule.percent * n // 100)  # a linked set has at least so many elements
        for k in range(1, len(ids)):
            mine = np.arange(starts[k], starts[k + 1])
            before = [lists[begin[token[x]] : at[x]] for x in mine if at[x] > begin[token[x]]]
            if before:
                found = np.unique(np.concatenate(before)) if len(before) > 1 else before[0]
                self.settle(ids[k], ids[found[n[found] >= small[k]]])

    def join(self, ids: np.ndarray) -> None:
        """Regions are joined by their cells where these are clearly less work, else by prefixes."""
        todo = [ids]
        while todo:
            ids = todo.pop()
            if len(ids) < 2 or (self.label[ids] == self.label[ids[0]]).all():
                continue
            if len(ids) > PAIRS:
                cells = list(self.cells(ids, ids[np.linspace(0, len(ids) - 1, PIVOTS).astype(np.int64)]))
                if sum(len(c) ** 2 for c in cells) <= 0.5 * len(ids) ** 2:
                    todo.extend(cells)
                    continue
            self.by_prefix(ids)

    def cells(self, ids: np.ndarray, pivots):
        """Links to the pivots are made at once; what is left to compare, by cell."""
        radius, slack = self.rule.radius, 1e-9
        found = [self.distance(p, ids) for p in pivots]
        far, linked = np.array([d for d, _ in found]), np.array([x for _, x in found])
        for p, x in zip(pivots, linked):
            for j in ids[x]:
                self.union(p, j)
        for far_q, linked_q in zip(far, linked):
            inside = far_q <= far.min(axis=0) + 2 * radius + slack
            others = inside & ~linked_q
            if others.any():
                reach = far_q >= far_q[others].min() - radius - slack
                yield ids[others | (inside & linked_q & reach)]


def _linked(members: DataFrame, rule: Rule) -> DataFrame:
    """Links (u, v) of (h1, h2) structs that connect each region's classes; a region is one run of sorted rows."""

    def one(region: list, out: list) -> None:
        region = list({(a, b): (a, b, near, e) for a, b, near, e in region}.values()) if all(r[2] is None for r in region) else region
        if len(region) < 2:
            return
        region.sort(key=lambda r: r[:2])
        sets = _Sets([np.frombuffer(r[3], np.uint64) for r in region], [r[2] for r in region], rule)
        sets.join(np.arange(len(region)))
        for i, r in enumerate(region):
            j = sets.root(i)
            if r[:2] != region[j][:2]:
                out.append((*r[:2], *region[j][:2]))

    def links(batches):
        current, held, out = None, [], []

        def written(out):
            cols = list(zip(*out)) if out else [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u1", "u2", "v1", "v2"])

        for batch in batches:
            for region, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if region != current:
                    one(held, out)
                    current, held = region, []
                held.append(tuple(rest))
            if len(out) > 10_000:
                yield written(out)
                out = []
        one(held, out)
        yield written(out)

    dealt = members.repartition("region").sortWithinPartitions("region")
    found = dealt.mapInArrow(links, "u1 long, u2 long, v1 long, v2 long")
    return found.select(F.struct(F.col("u1").alias("h1"), F.col("u2").alias("h2")).alias("u"), F.struct(F.col("v1").alias("h1"), F.col("v2").alias("h2")).alias("v"))


def _split(members: DataFrame, rule: Rule, turn: int, region_elements: int) -> tuple[DataFrame, DataFrame]:
    """Cells of regions that are too large for a task, and the links to their pivots.

    A region is dealt over as many tasks as it is too large; its few pivots go to each of them, ahead of the members.
    """
    # the member of smallest hash in each of PIVOTS buckets: at least one of every region, at most PIVOTS
    drawn = F.xxhash64("h1", "h2", F.lit(turn))
    chosen = members.groupBy("region", F.pmod(drawn, F.lit(PIVOTS))).agg(F.min(F.struct(drawn.alias("drawn"), "h1", "h2")).alias("m")).select("region", "m.h1", "m.h2")
    parts = members.groupBy("region").agg(F.greatest(F.lit(1), F.ceil(_elements() / region_elements)).cast("int").alias("parts"))
    whole = members.join(parts, "region")
    ahead = whole.join(chosen, ["region", "h1", "h2"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = (
        whole.withColumn("part", F.pmod(F.xxhash64("h2", "h1"), F.col("parts")).cast("int")).withColumn("member", F.lit(1))
        .unionByName(ahead.withColumn("member", F.lit(0))).select("region", "part", "member", "h1", "h2", "elements")
        .repartition("region", "part").sortWithinPartitions("region", "part", "member", "h1", "h2")
    )

    def cells(batches):
        current, pivots = None, []
        for batch in batches:
            out = []
            for region, part, member, h1, h2, elements in zip(*(c.to_pylist() for c in batch.columns)):
                if (region, part) != current:
                    current, pivots = (region, part), []
                if not member:
                    pivots.append((h1, h2, np.frombuffer(elements, np.uint64)))
                    continue
                sets = _Sets([np.frombuffer(elements, np.uint64), *(p[2] for p in pivots)], [], rule)
                far, linked = sets.distance(0, np.arange(1, len(pivots) + 1))
                for q in np.flatnonzero(far <= far.min() + 2 * rule.radius + 1e-9):
                    p1, p2, _ = pivots[q]
                    out.append((hash((region, p1, p2, turn)), h1, h2, p1 if linked[q] else None, elements, float(far[q]), p2, region))
            cols = list(zip(*out)) if out else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.binary(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["region", "h1", "h2", "near", "elements", "far", "p2", "parent"])

    dealt = cut_lineage(dealt.mapInArrow(cells, MEMBER + ", far double, p2 long, parent long"))
    near = dealt.where("near is not null")
    links = near.select(F.struct("h1", "h2").alias("u"), F.struct(F.col("near").alias("h1"), F.col("p2").alias("h2")).alias("v")).where("u <> v")
    others = dealt.where("near is null").groupBy("region").agg(F.min("far").alias("least"))
    left = dealt.join(others, "region").where(F.col("near").isNull() | (F.col("far") >= F.col("least") - rule.radius - 1e-9))
    return left.select("parent", "region", "h1", "h2", "near", "elements"), links


def _elements() -> Column:
    """Elements of all sets of a group."""
    return F.sum(F.octet_length("elements") / 8)


def _work() -> Column:
    """What comparing all pairs of a region would take at most, in elements."""
    return _elements() * F.count(F.lit(1))


def _blocks(members: DataFrame, region_elements: int, region_work: float) -> DataFrame:
    """Members dealt into blocks of about half of what a task joins; every two blocks of a region are a region of their own."""
    sizes = members.groupBy("region").agg(_elements().alias("n"), _work().alias("work"))
    blocks = F.greatest(F.ceil(2 * F.col("n") / region_elements), F.ceil(2 * F.sqrt(F.col("work") / region_work)))
    count = F.when((F.col("n") <= region_elements) & (F.col("work") <= region_work), F.lit(1)).otherwise(blocks).cast("long")
    mine, other = F.pmod(F.xxhash64("h2", "h1"), F.col("count")), F.col("other")
    dealt = members.join(sizes.select("region", count.alias("count")), "region").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    met = dealt.where((F.col("mine") != other) | (F.col("count") == 1))  # a block meets itself in any of its pairs
    return met.select(F.xxhash64("region", F.least("mine", "other"), F.greatest("mine", "other")).alias("region"), "h1", "h2", "near", "elements")


def _all_links(members: DataFrame, rule: Rule, region_elements: int, region_work: float, turns: int = 12) -> DataFrame:
    """Links of all regions; no task joins much more than ``region_elements`` or ``region_work``, a single larger set aside.

    Blocks of a region of n elements hold about 2 n^2 / region_elements in all. Cells replace a region only where the sum of their
    squares is smaller than its own, so each turn lowers what blocks would cost; every region is judged for itself.
    """
    links = []
    members = cut_lineage(members)
    for turn in range(turns + 1):
        sizes = members.groupBy("region").agg(_elements().alias("n"), _work().alias("work"))
        large = cut_lineage(sizes.where((F.col("n") > region_elements) | (F.col("work") > region_work)).select("region"))
        if not large.head(1):
            break
        links.append(_linked(members.join(large, "region", "left_anti"), rule))
        # repeated rows are one member, also where pivots are drawn
        whole = cut_lineage(members.join(large, "region", "left_semi").dropDuplicates(["region", "h1", "h2"]))
        if turn == turns:
            members = _blocks(whole, region_elements, region_work)
            break
        cells, found = _split(whole, rule, turn, region_elements)
        cells = cut_lineage(cells)
        links.append(found)
        after = cells.groupBy("parent", "region").agg(_elements().alias("n")).groupBy("parent").agg(F.sum(F.col("n") * F.col("n")).alias("after"))
        before = whole.groupBy(F.col("region").alias("parent")).agg(_elements().alias("n"))
        kept_whole = cut_lineage(before.join(after, "parent").where(F.col("after") > 0.9 * F.col("n") * F.col("n")).select("parent"))
        stay = whole.join(kept_whole.withColumnRenamed("parent", "region"), "region", "left_semi")
        links.append(_linked(_blocks(stay, region_elements, region_work), rule))
        members = cut_lineage(cells.join(kept_whole, "parent", "left_anti").drop("parent"))
    links.append(_linked(members, rule))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def classes(documents: DataFrame, *, rule: Rule = Rule(), region_elements: int = REGION_ELEMENTS, region_work: float = REGION_WORK, bits: int = bitmap.BITS) -> DataFrame:
    """One row per document: k1, k2, doc_id, n_shingles, root and component_id, the smallest doc_id it reaches by links, its own included.

    ``root`` names the class also where ids repeat; it is null without shingles.
    Texts are lower-cased (A-Z). Null and empty texts, and texts without words, have no shingles and link with nothing. Equal sets
    always link; only one of them is compared. Null ids are passed over in component_id unless a component has no other.
    """
    described = cut_lineage(_described(documents, rule))
    found = cut_lineage(regions(documents, rule))
    links = _all_links(_members(documents, described, found, rule, bits), rule, region_elements, region_work)
    roots = components(links)
    named = described.where("h1 is not null").groupBy(F.struct("h1", "h2").alias("node")).agg(F.min("doc_id").alias("least")).join(roots, "node", "left")
    named = named.select("node", F.coalesce("root", "node").alias("root"), "least")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select(F.col("node.h1").alias("h1"), F.col("node.h2").alias("h2"), "root", "component_id")
    return described.join(named, ["h1", "h2"], "left").select("k1", "k2", "doc_id", "n_shingles", "root", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(documents: DataFrame, **settings) -> DataFrame:
    """One document of each class, the one with the smallest doc_id (then key); columns unchanged.

    Texts without words stay all. Rows with the same id and text are one document, of which one stays. Bitmaps of the keys that stay
    and of those that a row may have without staying settle most rows where they are; only the others are shuffled.
    """
    found = cut_lineage(classes(documents, **settings).select("k1", "k2", "doc_id", "n_shingles", "root"))
    one = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")).alias("best")).select("best.k1", "best.k2")
    empty = found.where("n_shingles = 0").select("k1", "k2").distinct()
    one, bits = cut_lineage(one.distinct()), settings.get("bits", bitmap.BITS)
    copies = found.where("n_shingles > 0").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).join(one.withColumn("stays", F.lit(True)), ["k1", "k2"], "left")
    stay, doubt = bitmap.build(one.unionByName(empty), "k1", bits), bitmap.build(copies.where("stays is null or n > 1"), "k1", bits)

    @F.pandas_udf("int")
    def settled(k1: pd.Series) -> pd.Series:  # 0 goes, 1 stays, 2 is open
        k1 = k1.to_numpy(np.int64).view(np.uint64)
        return pd.Series(np.where(bitmap.contains(stay.value, k1), 1 + bitmap.contains(doubt.value, k1), 0))

    rows = packed(documents, *row_key()).withColumn("settled", settled("k1"))
    asked = rows.where("settled = 2")
    best = asked.join(one, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.any_value("row").alias("row"))
    parts = [rows.where("settled = 1").select("row"), best.select("row"), asked.join(empty, ["k1", "k2"], "left_semi").select("row")]
    return unpacked(parts[0].unionByName(parts[1]).unionByName(parts[2]), documents.columns)
