"""N-gram Jaccard join by partitioning the shingle universe.

Two sets with Jaccard >= t differ in at most H shingles, where H follows from the
size of the smaller one. A band of sizes shares one H and splits the universe of
hashed shingles into segments. By the pigeonhole principle a linked pair agrees on
some segment, or differs there by one shingle:

* `pairs` segments index their subset and its one-deletion neighbourhood and take up
  two differences each;
* `singles` segments index their subset alone and take up one;
* `spare` more singles than needed are laid out, and each set leaves out as many of
  its costliest ones: those with the fewest shingles, which many sets share. Since
  "fewest shingles, then key" orders subsets alike on both sides, a linked pair
  still agrees on one that both have kept (it agrees on spare + 1 of them).

The allocation of a band (`plan_band`) minimises the expected number of keys plus a
price for weak ones. Shingles that a large share of a sample of sets holds get no
segment at all; a set that consists mostly of these is indexed a second time by all
its shingles. Any such choice keeps the join exact.

Keys held by one set only go at once. The rest gives candidates in three rounds, and
links found in one are joined to components before the next: first each set against the
smallest of all sets that are the smallest one of some key of its own; then each key's
smallest set against the others that lie in different components; then the pairs of a
key that still do, sifted by size and by a parity bitmap of the sets (a lower bound of
their difference). Of these a key offers a spanning forest of its components at a time, and
again without the pairs that failed, of which it offers more each time, until none is left.
Candidates are verified on the texts' own shingles. So a class of copies of any number
gives about one link a set, not one for each pair of them.

That finds the classes without all links. Every link lies inside a class, so
`jaccard_links` counts them there: the sets of a class are dealt into cells of at most
about two blocks, every pair of a class meets in one cell only, and cells of sizes that
cannot be linked are not laid out. A cell returns a number for each set, not its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordina.llm.common import free_name, hashes_of, lowered_words, mix64, signed, slices, tidy, utf8, word_hashes
from ordina.llm.components import components
from ordina.session import written

WIDTH = 5
NUM, DEN = 4, 5  # links need DEN * intersection >= NUM * union
BITS = 2048
WEAK_PRICE = 6.0
SAMPLE_SETS = 8_000
COMMON_SHARE = 0.003
SIZE_STEP = 1.3  # over DEN / NUM, so that linked sets lie in neighbouring bands
BLOCK = 512  # sets in a block of a large class
TILE = 256
FEW = 8

_SPREAD = np.array(
    [0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64
)
_U = np.uint64


# --- sets --------------------------------------------------------------------


def shingle_hashes(words: list[bytes], table, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; all words as one if fewer."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes_of(words, table)
    if len(h) < width:
        total = (h * _SPREAD[: len(h)]).sum(dtype=np.uint64) + _U(len(h))
        return mix64(np.array([total], np.uint64))
    last = len(h) - width + 1
    mixed = h[:last] * _SPREAD[0]
    for i in range(1, width):
        mixed = mixed + h[i : last + i] * _SPREAD[i]
    return np.unique(mix64(mixed))


def shingle_set(words: list[bytes], width: int = WIDTH) -> set:
    """The same set, spelled out."""
    if not words:
        return set()
    if len(words) < width:
        return {b" ".join(words)}
    return set(map(b" ".join, zip(*(words[i:] for i in range(width)))))


# --- bands and their allocation ----------------------------------------------


@lru_cache(None)
def band_tops(longest: int) -> tuple[int, ...]:
    """Largest size of each band, up to the one that holds `longest`."""
    tops = [3]
    while tops[-1] < longest:
        tops.append(tops[-1] * 3 // 2 // 4 * 4 + 3)
    return tuple(tops)


def max_difference(top: int) -> int:
    """Most shingles in which linked sets differ if the smaller has at most `top`.

    union - intersection <= (DEN / NUM - 1) * intersection, and the intersection has at
    most `top` shingles.
    """
    return top * (DEN - NUM) // NUM


@lru_cache(None)
def plan_band(bottom: int, top: int) -> tuple[int, int, int]:
    """(pairs, singles, spare) of least expected cost: 2 * pairs + singles = H + 1 + spare."""
    need = max_difference(top) + 1
    size = (bottom + top) / 2
    best = None
    for pairs in sorted({0, 1, 2, need // 8, need // 4, need // 2} & set(range(need // 2 + 1))):
        for share in (0.0, 0.1, 0.2, 0.3, 0.45, 0.6):
            spare = round(share * need)
            singles = need + spare - 2 * pairs
            if singles <= spare and spare:
                continue
            load = size / (pairs + singles)
            empty, one = np.exp(-load), load * np.exp(-load)
            weak = max(0.0, singles * (empty + one) - spare)
            cost = (singles - spare) + pairs * (1 + load) + WEAK_PRICE * (weak + 2 * pairs * (empty + one + load * one))
            if best is None or cost < best[0]:
                best = (cost, pairs, singles, spare)
    return best[1:]


def bands_of(n: int) -> list[tuple[int, int, int]]:
    """(band, bottom, top) that a set of n shingles joins: its own, and lower ones of possible partners."""
    if n < 4:  # linked with equal sets only
        return []
    tops = band_tops(n)
    found = []
    for band in range(len(tops) - 1, 0, -1):
        if DEN * tops[band] < NUM * n:
            break
        found.append((band, tops[band - 1] + 1, tops[band]))
    return found


def keys_in_band(s: np.ndarray, band: int, bottom: int, top: int, salt: int, fill: bool) -> tuple[np.ndarray, bool]:
    """Keys of the sorted hashes `s` in one band, and whether they do without empty subsets.

    Sets whose spare does not cover their empty singles, or whose pair segments hold
    less than two shingles, index empty subsets too with `fill`; otherwise they are
    told apart, and the caller indexes them in another way among themselves.
    """
    pairs, singles, spare = plan_band(bottom, top)
    m = pairs + singles
    segment = ((s >> _U(32)) * _U(m)) >> _U(32)
    edge = np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))
    value = mix64(s + _U(salt))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    sums, counts = total[edge[1:]] - total[edge[:-1]], np.diff(edge)
    name = mix64(np.arange(m, dtype=np.uint64) + _U((band << 32) + (salt << 48)))
    keys = mix64(sums ^ name)
    single, held = keys[pairs:], counts[pairs:]
    order = np.lexsort((single, -held))[: singles - spare]
    enough = bool((held[order] > 0).all() and (counts[:pairs] > 1).all())
    kept = single[order] if fill else single[order][held[order] > 0]
    if not pairs:
        return kept, enough
    inside = slice(0, edge[pairs])
    where = segment[inside].astype(np.int64)
    whole = np.ones(pairs, bool) if fill else counts[:pairs] > 0
    some = np.ones(len(where), bool) if fill else counts[where] > 1
    deleted = mix64((sums[where] - value[inside]) ^ name[where])
    return np.concatenate((kept, keys[:pairs][whole], deleted[some])), enough


def keys_of(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """All keys of a set.

    Frequent shingles have no segment; without them two sets differ by no more than
    with them. A pair is missed there only if both sets lack the shingles for it, and
    such sets are indexed again by all shingles.
    """
    n, found = len(s), []
    rare = s
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        rare = s[common[at] != s]
    for band, bottom, top in bands_of(n):
        enough = False
        if len(common):
            keys, enough = keys_in_band(rare, band, bottom, top, 1, False)
            found.append(keys)
        if not enough:
            found.append(keys_in_band(s, band, bottom, top, 2, True)[0])
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def parity_bitmap(s: np.ndarray) -> bytes:
    """Parity of the shingles in each of BITS cells; two sets differ in at least as many shingles as cells."""
    cell = (mix64(s + _U(3)) & _U(BITS - 1)).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=BITS).astype(np.uint8) & 1).tobytes()


# --- passes over the texts ---------------------------------------------------


def _common_shingles(texts: DataFrame) -> np.ndarray:
    """Hashes of shingles that COMMON_SHARE of a sample of about SAMPLE_SETS texts hold."""
    rate = min(1.0, SAMPLE_SETS / max(1, texts.count()))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_hashes()
        for batch in batches:
            for text in utf8(batch.column(0)):
                s = shingle_hashes(lowered_words(text), table)
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(signed(s))], ["s"])

    chosen = texts.where(F.pmod(F.col("text_hash"), F.lit(1 << 40)) < int(rate * (1 << 40)))
    found = chosen.select("text").mapInArrow(tidy(shingles), "s long").groupBy("s").count()
    least = max(8, int(COMMON_SHARE * SAMPLE_SETS))
    rows = found.where(F.col("count") >= least).select("s").toPandas()
    return np.sort(rows["s"].to_numpy(np.int64).view(np.uint64))


def _sets(common: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = word_hashes(), set()
        for batch in slices(batches):
            sizes, nodes, maps, keys = [], [], [], []
            for text in utf8(batch.column("text")):
                s = shingle_hashes(lowered_words(text), table)
                sizes.append(len(s))
                if not len(s):
                    nodes.append(None), maps.append(None), keys.append(None)
                    continue
                node = int(signed(mix64(mix64(s).sum(dtype=np.uint64, keepdims=True) + _U(len(s))))[0])
                nodes.append(node)
                # Of copies that one task meets, one brings the keys.
                again = node in seen
                if len(seen) >= 500_000:
                    seen.clear()
                seen.add(node)
                maps.append(None if again else parity_bitmap(s))
                keys.append(None if again else signed(keys_of(s, common)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array(maps, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "text_hash", "n", "node", "bitmap", "keys"],
            )

    return run


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by key, cut between keys only."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if held and not cut and key[0] == held[-1].column("key")[-1].as_py():
            held.append(batch)
            continue
        held.append(batch.slice(0, cut))
        yield pa.Table.from_batches(held)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, node): those of keys that several nodes hold, with the key's first node."""
    for table in _whole_keys(batches):
        key, node = table.column("key").to_numpy(), table.column("node").to_numpy()
        if not len(key):
            continue
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
        key, node = key[new], node[new]
        starts = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.cumsum(starts) - 1
        keep = np.bincount(group)[group] > 1
        hub = node[np.flatnonzero(starts)[group]]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, node, hub)], ["key", "node", "hub"])


def _across_components(room: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows sorted by (key, component): pairs of a key that may link its components.

    Each row meets the rows after its own component's, one distance at a time, sifted by
    size, by bitmap and by `tried`, the smaller nodes that it is known not to be linked
    with. A pair is emitted if it joins two components that no pair of the key has joined
    yet, so a key has fewer pairs than rows, and `room` more for each of its rows. A key
    that has held a pair back is told once, in a row without nodes.
    """

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_keys(batches):
            key, node, comp, n = (table.column(c).to_numpy() for c in ("key", "node", "component", "n"))
            if not len(key):
                continue
            bits = np.frombuffer(b"".join(table.column("bitmap").to_pylist()), np.uint64).reshape(-1, BITS // 64)
            tried = [frozenset(t or ()) for t in table.column("tried").to_pylist()]
            of_key = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1
            left = np.bincount(of_key) * room
            held_back = np.zeros(len(left), bool)
            run = np.cumsum(np.concatenate(([True], (key[1:] != key[:-1]) | (comp[1:] != comp[:-1])))) - 1
            ends = np.append(np.flatnonzero(np.diff(run)) + 1, len(key))
            joined = np.arange(len(ends))  # runs by the smallest run that they are joined to
            at = np.arange(len(key))
            to = ends[run]
            while True:
                on = to < len(key)
                at, to = at[on], to[on]
                on = key[at] == key[to]
                at, to = at[on], to[on]
                if not len(at):
                    break
                small, large = np.minimum(n[at], n[to]), np.maximum(n[at], n[to])
                good = DEN * small >= NUM * large
                a, b = at[good], to[good]
                for i in range(0, len(a), 20_000):
                    x, y = a[i : i + 20_000], b[i : i + 20_000]
                    apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
                    close = (NUM + DEN) * apart <= (DEN - NUM) * (n[x] + n[y])
                    found = _joining(x[close], y[close], node, tried, run, joined, of_key, left, held_back)
                    if found:
                        both = np.array(found, np.int64)
                        yield _candidates(both[:, 0], both[:, 1], None)
                to = to + 1
            if held_back.any():
                yield _candidates(None, None, key[np.flatnonzero(np.append(True, key[1:] != key[:-1]))[held_back]])

    return across


def _candidates(a, b, key) -> pa.RecordBatch:
    n = len(a if key is None else key)
    columns = [pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in (a, b, key)]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "key"])


def _joining(x, y, node, tried, run, joined, of_key, left, held_back) -> list[tuple[int, int]]:
    """Of candidate rows (x, y), the nodes to emit; `joined`, `left` and `held_back` are kept up to date."""

    def root(r: int) -> int:
        while joined[r] != r:
            r = joined[r]
        return r

    found = []
    for i, j in zip(x.tolist(), y.tolist()):
        low, high = root(run[i]), root(run[j])
        a, b, last = (node[i], node[j], j) if node[i] < node[j] else (node[j], node[i], i)
        if a in tried[last]:
            continue
        if low == high and left[of_key[i]] <= 0:
            held_back[of_key[i]] = True
            continue
        found.append((a, b))
        if low == high:
            left[of_key[i]] -= 1
        else:
            joined[max(low, high)] = min(low, high)
    if found:
        while (joined[joined] != joined).any():
            joined[:] = joined[joined]
    return found


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose texts' shingles meet the threshold; rows come by a."""
    of, left = None, set()
    for batch in batches:
        good = []
        for a, x, y in zip(batch.column("a").to_pylist(), utf8(batch.column("text_a")), utf8(batch.column("text_b"))):
            if a != of:
                of, left = a, shingle_set(lowered_words(x))
            right = shingle_set(lowered_words(y))
            both = len(left & right)
            good.append(DEN * both >= NUM * (len(left) + len(right) - both))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return written(rows.mapInArrow(tidy(_verified), "a long, b long"), "links")


def _placed(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (a, b) with the components of both ends, `of_a` and `of_b`; a node without one is its own."""
    for end in ("a", "b"):
        of = groups.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        pairs = pairs.join(of, end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    return pairs


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    return _placed(pairs, groups).where("of_a <> of_b").select("a", "b")


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after `links` (a, b) have joined components of `groups`.

    Links between the same two components count once, so there are no more edges than
    pairs of components, and a component is still named by its smallest node.
    """
    ends = _placed(links, groups).where("of_a <> of_b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"))
    edges = written(ends.distinct(), "edges")
    above = components(edges).select(F.col("node").alias("component"), F.col("component").alias("named"))
    alone = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(groups.select("node"), "node", "left_anti")
    nodes = groups.select("node", "component").union(alone.select("node", F.col("node").alias("component")))
    merged = nodes.join(above, "component", "left").select("node", F.coalesce("named", "component").alias("component"))
    return written(merged, "groups")


def _open_pairs(shared: DataFrame, groups: DataFrame, chosen: DataFrame, failed: DataFrame, room: int) -> DataFrame:
    """What `_across_components` finds in the keys of `shared` that lie across components."""
    placed = shared.select("key", "node").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    across = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    tried = failed.groupBy(F.col("b").alias("node")).agg(F.collect_list("a").alias("tried"))
    facts = chosen.select("node", "n", "bitmap").join(tried, "node", "left")
    rows = placed.join(across.select("key"), "key").join(facts, "node")
    rows = rows.select("key", "node", "component", "n", "bitmap", "tried").repartition("key")
    rows = rows.sortWithinPartitions("key", "component", "node")
    return rows.mapInArrow(tidy(_across_components(room)), "a long, b long, key long").distinct()


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sets of all rows, (node, alone, component, component_id) of all nodes, (node, text) of those that share a key.

    `alone` says that the class has no other node; a node may have several equal rows of text.
    """
    texts = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    common = _common_shingles(texts)
    sets = written(
        texts.mapInArrow(
            tidy(_sets(common)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, n long,"
            " node long, bitmap binary, keys array<long>"
        ),
        "sets",
    )
    rows = sets.select("node", F.explode("keys").alias("key")).repartition("key")
    shared = written(rows.sortWithinPartitions("key", "node").mapInArrow(tidy(_shared_keys), "key long, node long, hub long"), "shared")

    # One text of each set that shares a key.
    some = F.min(F.struct("doc_id", "text_hash", "n", "bitmap")).alias("row")
    wanted = shared.select("node").distinct()
    chosen = sets.where("bitmap IS NOT NULL").join(wanted, "node").groupBy("node").agg(some)
    chosen = written(chosen.select("node", "row.*"), "chosen")
    ids = chosen.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "node")
    near = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
    near = written(near.select("node", "text"), "texts")

    first = shared.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    # Each node's first hub joins most of a class with one link a node; what then still
    # lies across components is tried before texts are fetched for it.
    nearest = written(first.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "nearest")
    groups = written(components(_links(nearest, near)), "groups")
    rest = _apart(first.join(nearest, ["a", "b"], "left_anti"), groups)
    groups = _merged(groups, _links(rest, near))
    # Round three: keys that lie across components, then those of them that hold pairs back.
    failed, room = _apart(first, groups), 0
    while True:
        failed = written(failed, "failed")
        found = written(_open_pairs(shared, groups, chosen, failed, room), "pairs")
        pairs = found.where("key IS NULL").select("a", "b")
        links = _links(pairs, near)
        groups = _merged(groups, links)
        again = found.where("key IS NOT NULL").select("key")
        if again.isEmpty():
            break
        shared = written(shared.join(again, "key"), "shared")
        failed = _apart(failed.union(pairs.join(links, ["a", "b"], "left_anti")), groups)
        room = max(1, 8 * room)
    placed = sets.select("node", "doc_id").where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    placed = placed.join(groups, "node", "left").withColumn("alone", F.col("component").isNull())
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = written(placed.join(least, "component").select("node", "alone", "component", "component_id"), "named")
    return sets, of_node, near


def _rows(sets: DataFrame, of_node: DataFrame) -> DataFrame:
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), "node").join(of_node, "node", "left")
    return out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs` (doc_id, text).

    Words lie between ASCII spaces, with A-Z lower-cased; a set holds the distinct
    5-word shingles, or all words as one shingle if there are fewer. Sets with
    Jaccard >= 0.8 are linked; component_id is the smallest doc_id reachable. Null,
    empty and blank texts have no shingle and are linked with nothing. Rows with equal
    ids stay single rows; a null id takes part in links and is named only if its whole
    component has no id. Other columns are ignored; an empty table gives no rows.
    """
    sets, of_node, _ = _classes(docs)
    return _rows(sets, of_node).select("doc_id", "n_shingles", "component_id")


def _cells(sets: DataFrame, of_node: DataFrame) -> DataFrame:
    """(key, side, node): the cells that each node of a class with other nodes stands in.

    A small class is one cell. A large one is cut by size, so that linked sets lie in
    the same band or in neighbouring ones, and a band into blocks: each block meets
    itself (side 2: all pairs), the other blocks and those of the next band (side 0
    against side 1). A node has a row for each block that it meets, not for each node.
    """
    sizes = sets.where("node IS NOT NULL").groupBy("node").agg(F.min("n").alias("n"))
    band = F.floor(F.log("n") / F.log(F.lit(SIZE_STEP))).cast("int")
    rows = written(of_node.where("NOT alone").join(sizes, "node").select("node", "component", band.alias("band")), "bands")
    # At most one class for BLOCK nodes is large.
    large = rows.groupBy("component").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > BLOCK).select("component")
    banded = rows.join(F.broadcast(large), "component")
    counts = banded.groupBy("component", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k"))
    blocks = counts.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("band", "k"))).alias("blocks"))
    rows = rows.join(F.broadcast(blocks), "component", "left")
    rows = rows.withColumn("own", F.coalesce(F.col("blocks")[F.col("band")], F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("own")).cast("int"))
    others = {step: F.coalesce(F.col("blocks")[F.col("band") + step], F.lit(0)) for step in (-1, 1)}

    def numbers(count):
        return F.filter(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda j: j < count)

    def cell(low, kind, i, j, side):
        return F.struct(low.alias("low"), F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))

    block, band = F.col("block"), F.col("band")
    inside = F.transform(
        numbers(F.col("own")),
        lambda j: cell(band, 0, F.least(block, j), F.greatest(block, j), F.when(block == j, 2).otherwise((block > j).cast("int"))),
    )
    above = F.transform(numbers(others[1]), lambda j: cell(band, 1, block, j, F.lit(0)))
    below = F.transform(numbers(others[-1]), lambda j: cell(band - 1, 1, j, block, F.lit(1)))
    whole = F.array(cell(F.lit(0), 2, F.lit(0), F.lit(0), F.lit(2)))
    spread = F.when(F.col("blocks").isNull(), whole).otherwise(F.concat(inside, above, below))
    rows = rows.select("node", "component", F.explode(spread).alias("c"))
    return rows.select(F.xxhash64("component", "c.low", "c.kind", "c.i", "c.j").alias("key"), F.col("c.side").alias("side"), "node")


def _tile_links(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Whether set i of `left` is linked with set j of `right`; sets are sorted distinct numbers."""
    n, m = (np.array([len(s) for s in side], np.int64) for side in (left, right))
    possible = DEN * np.minimum(n[:, None], m) >= NUM * np.maximum(n[:, None], m)
    if possible.any():
        maps = [
            np.stack([np.packbits(np.bincount(s & (BITS - 1), minlength=BITS).astype(np.uint8) & 1).view(np.uint64) for s in side])
            for side in (left, right)
        ]
        for i in np.flatnonzero(possible.any(axis=1)):
            apart = np.bitwise_count(maps[0][i] ^ maps[1]).sum(axis=1, dtype=np.int64)
            possible[i] &= (NUM + DEN) * apart <= (DEN - NUM) * (n[i] + m)
    at, to = np.nonzero(possible)
    if len(at) <= TILE:
        both = np.array([len(np.intersect1d(left[i], right[j], assume_unique=True)) for i, j in zip(at, to)], np.int64)
        possible[at, to] = DEN * both >= NUM * (n[at] + m[to] - both)
        return possible
    rows = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    shared = np.intersect1d(*flat)
    both = np.zeros((len(left), len(right)), np.float64)
    for start in range(0, len(shared), 4096):
        some = shared[start : start + 4096]
        held = []
        for side, row, of in zip((left, right), rows, flat):
            column = np.minimum(np.searchsorted(some, of), len(some) - 1)
            on = some[column] == of
            part = np.zeros((len(side), len(some)), np.float32)
            part[row[on], column[on]] = 1
            held.append(part)
        both += held[0] @ held[1].T  # whole numbers up to 4096 are exact
    return possible & (DEN * both >= NUM * (n[:, None] + m - both))


def _cell_links(texts: list[bytes], side: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each text of a cell, the weight of those that it is linked with there."""
    found = np.zeros(len(texts), np.int64)
    sets = [shingle_set(lowered_words(t)) for t in texts]
    pairs_within = side == 2
    if len(sets) <= FEW:
        for i in range(len(sets)):
            for j in range(i):
                small, large = sorted((len(sets[i]), len(sets[j])))
                if (side[i] == 2 or side[i] != side[j]) and DEN * small >= NUM * large:
                    both = len(sets[i] & sets[j])
                    if DEN * both >= NUM * (small + large - both):
                        found[i] += weight[j]
                        found[j] += weight[i]
        return found
    ids: dict[bytes, int] = {}
    for k, s in enumerate(sets):
        sets[k] = np.sort(np.fromiter((ids.setdefault(x, len(ids)) for x in s), np.int64, len(s)))
    del ids
    all_pairs = bool(pairs_within.any())
    left = np.flatnonzero(pairs_within if all_pairs else side == 0)
    right = left if all_pairs else np.flatnonzero(side == 1)
    for x in range(0, len(left), TILE):
        for y in range(x if all_pairs else 0, len(right), TILE):
            a, b = left[x : x + TILE], right[y : y + TILE]
            linked = _tile_links([sets[i] for i in a], [sets[i] for i in b])
            if all_pairs and x == y:
                np.fill_diagonal(linked, False)
                found[a] += linked @ weight[a]
                continue
            found[a] += linked @ weight[b]
            found[b] += linked.T @ weight[a]
    return found


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: (node, weight of its linked nodes) by cell."""
    for table in _whole_keys(slices(batches)):
        key, side, node, weight = (table.column(c).to_numpy() for c in ("key", "side", "node", "weight"))
        if not len(key):
            continue
        texts = list(utf8(table.column("text").combine_chunks()))
        edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        found = np.concatenate([_cell_links(texts[a:b], side[a:b], weight[a:b]) for a, b in zip(edges[:-1], edges[1:])])
        some = found > 0
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(found[some])], ["node", "linked"])


def jaccard_links(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of `docs` (doc_id, text).

    The first three are those of `jaccard_classes`. n_links is the number of other
    distinct texts whose sets have Jaccard >= 0.8 with the row's, every one of them
    checked on the shingles; copies of the row's own text do not count, other texts with
    equal sets do. Texts without shingle have no link.
    """
    sets, of_node, near = _classes(docs)
    weights = sets.where("node IS NOT NULL").select("node", "text_hash").distinct()
    weights = written(weights.groupBy("node").agg(F.count(F.lit(1)).alias("weight")), "weights")
    held = near.dropDuplicates(["node"]).join(weights, "node")
    cells = _cells(sets, of_node).join(held, "node")
    rows = cells.select("key", "side", "node", "weight", "text").repartition("key").sortWithinPartitions("key")
    linked = rows.mapInArrow(tidy(_linked), "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))
    n_links = weights.join(linked, "node", "left").select(
        "node", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    )
    of_node = written(of_node.join(n_links, "node"), "linked")
    return _rows(sets, of_node).select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose id is the smallest of their component, with all columns.

    Rows that repeat an id and text leave one. Rows without id stay only if nothing
    in their component has an id.
    """
    classes = jaccard_classes(docs)
    kept, text = free_name(docs, "_kept"), free_name(docs, "_hash")
    keep = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(kept)).distinct()
    rows = docs.join(keep, F.col("doc_id").eqNullSafe(F.col(kept)), "left_semi")
    return rows.withColumn(text, F.xxhash64("text")).dropDuplicates(["doc_id", text]).drop(text)
