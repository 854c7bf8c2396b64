"""N-gram Jaccard join by vertical partitioning.

Documents are sets of distinct five-word shingles; two link when their Jaccard similarity is at least 0.8. Sets are
cut along one global order of the shingles (rare ones first) into fragments, the fragments of the sets that can link
are counted one by one, and the partial overlaps of a pair are summed and compared with the exact bound.

1. Every document gives its set's size and fingerprint. Documents with one fingerprint are a class of copies; all
   that follows works on classes, so copies are never paired.
2. The global order is (frequency level, hash). Levels come from a count over all shingles of all documents: tasks
   send packed 32-bit remainders per fragment of the hash range, and fragments send back the levels of frequent
   cells. The table of levels has a fixed size (2**CELL_BITS bytes).
3. By the order, a pair that links shares one of the first n - ceil(0.8 n) + 1 shingles of each set. Classes meet
   in the buckets of these shingles: small buckets give the pairs whose lengths and positions allow a link, larger
   ones ties in which all pairs that could link are connected. No bucket gives all its pairs.
4. Connected candidates (a superset of linked ones) are the units of the exact count. A unit is worked in one task
   up to UNIT_TOKENS shingles; there, classes are counted against those not yet reached, fragment by fragment. A
   larger unit is spread over tasks and counted in rounds of hubs: fragments give partial overlaps, which are summed
   per pair.

Hot shingles (df of 2**HOT or more) are dealt over salted buckets that are tied by length bands, so no bucket is
gathered whole. Nothing is capped or dropped: where a shortcut doesn't hold, the pair is counted exactly.

Fingerprints and shingles are 64-bit hashes. A text of fewer than five words is one shingle of all; null and blank
texts are empty, link with nothing and are their own component. A component is named by its smallest doc_id; rows
with one id and text are copies; a null id is never the name of a component unless it has no other. An empty table
gives no rows. Other columns are not read. Ids are integers or texts (ordered by code point) and keep their type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.arrow_text import U64, mix64, shingle_sets, sliced
from sievework.llm.common import SHINGLE, cut, maybe_broadcast, table, written

#: 100 * intersection >= PERCENT * union links two sets.
PERCENT = 80
CELL_BITS = 24
#: Shingles in a fragment of the counting step, about; shingles of a unit that one task counts.
FRAGMENT_TOKENS, UNIT_TOKENS = 2_000_000, 4_000_000
#: df from which a shingle has a level; log2 of the df from which it is hot; buckets up to this size give pairs.
FREQUENT, HOT, PAIRS = 8, 12, 12
#: Fragments within a unit.
PARTS = 4


def least_overlap(n: np.ndarray | int):
    """The least overlap of a set of n with any set it links to."""
    return -(-PERCENT * n // 100)


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> U64(64 - CELL_BITS)).astype(np.int64)


def _class_of(tokens: np.ndarray) -> int:
    total = mix64(tokens ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64, keepdims=True)
    return int(mix64(total + U64(len(tokens))).astype(np.int64)[0])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        sets = [(len(s), _class_of(s) if len(s) else None) for s in shingle_sets(b.column("text"), SHINGLE)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array([n for n, _ in sets], pa.int64()), pa.array([c for _, c in sets], pa.int64())], names=["doc_id", "text_hash", "n_shingles", "class"])


def _fragments(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Where each fragment of sorted tokens begins, and the end."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << U64(64 - bits) if bits else np.zeros(0, U64)
    return np.concatenate(([0], np.searchsorted(tokens, edges), [len(tokens)]))


def _below(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits below the fragment's."""
    return (tokens >> U64(32 - bits)).astype(np.uint32)


def _count_map(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            every = np.concatenate([np.zeros(0, U64), *shingle_sets(b.column("text"), SHINGLE)])
            tokens, n = np.unique(every, return_counts=True)
            rows = []
            for f, (x, y) in enumerate(zip(_fragments(tokens, bits)[:-1], _fragments(tokens, bits)[1:], strict=True)):
                if x < y:
                    t, m = _below(tokens[x:y], bits), n[x:y]
                    rows.append((f, t[m == 1].tobytes(), t[m > 1].tobytes(), m[m > 1].astype(np.uint32).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["fragment", "once", "more", "counts"])

    return run


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def _count_reduce(bits: int):
    def run(group: pa.Table) -> pa.Table:
        once, more, counts = (_joined(group.column(c), np.uint32) for c in ("once", "more", "counts"))
        t, n = np.concatenate([once, more]), np.concatenate([np.ones(len(once), np.uint32), counts])
        order = np.argsort(t, kind="stable")
        t, n = t[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
        df = np.add.reduceat(n.astype(np.int64), first) if len(first) else first
        frequent = df >= FREQUENT
        rest = CELL_BITS - bits
        cell = np.int64(group.column("fragment")[0].as_py()) << rest | t[first][frequent].astype(np.int64) >> (32 - rest)
        level = np.log2(df[frequent]).astype(np.uint8)
        order = np.lexsort((level, cell))
        cell, level = cell[order], level[order]
        last = np.concatenate((cell[1:] != cell[:-1], [True])) if len(cell) else np.zeros(0, bool)
        return pa.table({"cells": pa.array([cell[last].astype(np.uint32).tobytes()], pa.binary()), "levels": pa.array([level[last].tobytes()], pa.binary())})

    return run


def frequency_levels(docs: DataFrame, bits: int) -> np.ndarray:
    """cell -> log2 of the largest df of its shingles; 0 below FREQUENT. A table of fixed size."""
    sent = docs.select("text").mapInArrow(_count_map(bits), "fragment int, once binary, more binary, counts binary")
    got = sent.groupBy("fragment").applyInArrow(_count_reduce(bits), "cells binary, levels binary")
    out = np.zeros(1 << CELL_BITS, np.uint8)
    for r in got.toLocalIterator():
        out[np.frombuffer(r.cells, np.uint32)] = np.frombuffer(r.levels, np.uint8)
    return out


_PREFIX = [("tokens", np.uint32), ("classes", np.int64), ("sizes", np.uint32), ("places", np.uint16)]


def _prefix_map(bits: int, shared, hot: int = HOT):
    """Packed prefix entries per fragment (and salt, for hot shingles) of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for b in sliced(batches):
            seen, parts = set(), []
            for s in shingle_sets(b.column("text"), SHINGLE):
                if not len(s) or (c := _class_of(s)) in seen:
                    continue
                seen.add(c)
                level = levels[_cell(s)]
                k = len(s) - least_overlap(len(s)) + 1
                order = np.argsort(level, kind="stable")[:k]
                parts.append((s[order], level[order], c, len(s)))
            if not parts:
                continue
            size = np.array([len(p[0]) for p in parts])
            t, level = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            c, n = np.repeat(np.array([p[2] for p in parts], np.int64), size), np.repeat(np.array([p[3] for p in parts], np.uint32), size)
            place = np.minimum(np.arange(len(t)) - np.repeat(np.cumsum(size) - size, size), 65535).astype(np.uint16)
            fragment = (t >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(t), np.int64)
            salt = np.where(level >= hot, 1 + (c & ((np.int64(1) << np.maximum(level.astype(np.int64) - hot + 1, 0)) - 1)), 0)
            order = np.lexsort((salt, fragment))
            cuts = np.flatnonzero(np.concatenate(([True], np.diff(fragment[order]) | np.diff(salt[order]) != 0, [True])))
            below, rows = _below(t, bits), []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                o = order[x:y]
                rows.append((int(fragment[o[0]]), int(salt[o[0]]), *(a[o].tobytes() for a in (below, c, n, place))))
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["fragment", "salt", *(x for x, _ in _PREFIX)])

    return run


def _largest_partner(n, p):
    """The largest set that one of n shingles, with the first common one at place p, can still link to."""
    return (100 + PERCENT) * (n - p) // PERCENT - n


def _similar(n1, n2):
    """Whether two sizes, the smaller one first, can link at all."""
    return 100 * n1 >= PERCENT * n2


def _band(n):
    return (np.log(np.maximum(n, 1)) / np.log(100 / PERCENT)).astype(np.int32)


def _edges(group: pa.Table) -> pa.Table:
    """Candidate edges of a fragment (kind 0). Of salted buckets also what ties them: the first leader of a length band
    (kind 1 + band), and the other members with the bands of leaders that they could link to (kind -1 - band)."""
    t, c, n, p = (_joined(group.column(name), kind) for name, kind in _PREFIX)
    n, p = n.astype(np.int64), p.astype(np.int64)
    order = np.lexsort((c, n, t))
    t, c, n, p = t[order], c[order], n[order], p[order]
    keep = np.concatenate(([True], (t[1:] != t[:-1]) | (c[1:] != c[:-1]))) if len(t) else np.zeros(0, bool)
    t, c, n, p = t[keep], c[keep], n[keep], p[keep]
    first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1], [True]))) if len(t) else np.zeros(1, np.int64)
    size = np.repeat(np.diff(first), np.diff(first))
    salted = bool(len(t)) and group.column("salt")[0].as_py() > 0
    top = _largest_partner(n, p)
    left, right = [], []
    # Small buckets: pairs at each distance along the length order.
    for d in range(1, PAIRS):
        i = np.flatnonzero((t[:-d] == t[d:]) & (size[:-d] <= PAIRS)) if len(t) > d else np.zeros(0, np.int64)
        j = i + d
        ok = _similar(n[i], n[j]) & (n[j] <= top[i]) & (n[i] <= top[j])
        left.append(c[i[ok]])
        right.append(c[j[ok]])
    # Larger and salted ones. Leaders can link to sets of their own size; neighbours among them are tied. The others
    # link only to smaller leaders, and are tied to the largest of these.
    many = (size > PAIRS) | salted
    lead, rest = np.flatnonzero(many & (top >= n)), np.flatnonzero(many & (top < n))
    a, b = lead[:-1], lead[1:]
    ok = (t[a] == t[b]) & _similar(n[a], n[b])
    left.append(c[a[ok]])
    right.append(c[b[ok]])
    place = lambda i, x: t[i].astype(np.int64) << 31 | np.maximum(x, 0)
    if len(lead):
        at = np.searchsorted(place(lead, n[lead]), place(rest, top[rest]), "right") - 1
        j = lead[np.maximum(at, 0)]
        ok = (at >= 0) & (t[j] == t[rest]) & _similar(n[j], n[rest])
        left.append(c[rest[ok]])
        right.append(c[j[ok]])
    left, right = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)], 1), axis=0)
    kind, key = np.zeros(len(pairs), np.int32), np.zeros(len(pairs), np.int64)
    if salted:
        band = _band(n[lead])
        one = np.concatenate(([True], (t[b] != t[a]) | (band[1:] != band[:-1]))) if len(lead) else np.zeros(0, bool)
        low, high = _band(-(-PERCENT * n[rest] // 100)), _band(top[rest])
        own = np.concatenate([lead[one], rest, rest])
        token = np.int64(group.column("fragment")[0].as_py()) << 32 | t[own].astype(np.int64)
        pairs = np.concatenate([pairs, np.stack([c[own], c[own]], 1)])
        kind, key = np.concatenate([kind, 1 + band[one], -1 - low, -1 - high]), np.concatenate([key, token])
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "kind": pa.array(kind, pa.int32()), "token": key})


def candidate_edges(docs: DataFrame, bits: int, levels: np.ndarray, hot: int = HOT) -> DataFrame:
    """Edges (a, b), a < b, between classes, that connect all classes that can link."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    sent = docs.select("text").mapInArrow(_prefix_map(bits, shared, hot), "fragment int, salt long, tokens binary, classes binary, sizes binary, places binary")
    made = cut(sent.groupBy("fragment", "salt").applyInArrow(_edges, "a long, b long, kind int, token long"))
    tied = made.filter("kind > 0").select("token", F.col("kind").alias("band"), "a")
    least = tied.groupBy("token", "band").agg(F.min("a").alias("b"))
    within = tied.join(least, ["token", "band"]).select("a", "b")
    across = least.alias("x").join(least.alias("y"), F.expr("x.token = y.token AND x.band + 1 = y.band")).select(F.col("x.b").alias("a"), F.col("y.b").alias("b"))
    others = made.filter("kind < 0").select("token", (-F.col("kind")).alias("band"), "a").join(least, ["token", "band"]).select("a", "b")
    every = made.filter("kind = 0").select("a", "b").unionByName(within).unionByName(across).unionByName(others).filter("a <> b")
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of the components of edges (a, b): alternating large and small stars. Root: the least node."""
    edges, seen = cut(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "m", "a")
        small = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = cut(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = state


class _Postings:
    """The sets that hold a token, by token, with the largest partner that each allows there."""

    def __init__(self, token: np.ndarray, owner: np.ndarray, top: np.ndarray, tokens: int):
        order = np.argsort(token, kind="stable")
        self.owner, self.top = owner[order], top[order]
        self.begin = np.searchsorted(token[order], np.arange(tokens + 1, dtype=token.dtype))

    def of(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the tokens' entries are, and the token (by its number among these) of each."""
        a, count = self.begin[tokens], self.begin[tokens + 1] - self.begin[tokens]
        return np.repeat(a - np.cumsum(count) + count, count) + np.arange(count.sum()), np.repeat(np.arange(len(tokens)), count)


def _unit_links(sets: list[np.ndarray]) -> np.ndarray:
    """The component of each set. A hub's candidates are the sets not yet reached that share a token of both prefixes,
    by the unit's own order of frequency, at places and with sizes that allow a link; their overlaps with the hub are
    counted per fragment of the order and summed. Tokens, places and owners are below 2**31: they are held in 32 bits."""
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), n)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    df = np.bincount(token)
    rank = np.empty(len(df), np.int32)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    token, df = rank[token], np.sort(df)
    token, begin = token[np.lexsort((token, owner))], np.cumsum(n) - n
    place = (np.arange(len(token)) - begin[owner]).astype(np.int32)
    top, length = np.minimum(_largest_partner(n[owner], place), (1 << 31) - 1).astype(np.int32), n - least_overlap(n) + 1
    prefix = place < length[owner]
    leads = prefix & (top >= n[owner])
    fragment = np.arange(len(df)) * PARTS // max(len(df), 1)
    held, number = np.zeros(len(df), bool), np.full(len(sets), -1)
    label, free = np.full(len(sets), -1), np.ones(len(sets), bool)

    def postings() -> list[_Postings]:
        """Of all prefixes, of leaders' prefixes, of whole sets; laid out anew whenever half of the sets were reached."""
        return [_Postings(token[own], owner[own], top[own], len(df)) for own in (prefix & free[owner], leads & free[owner], free[owner])]

    every, leaders, whole = postings()
    left = listed = len(sets)

    def candidates(hub: int) -> np.ndarray:
        t, mine = token[begin[hub] : begin[hub] + length[hub]], top[begin[hub] : begin[hub] + length[hub]]
        found = []
        for lists, own in ((every, mine >= n[hub]), (leaders, mine < n[hub])):
            at, which = lists.of(t[own])
            o = lists.owner[at]
            found.append(o[free[o] & (n[o] <= mine[own][which]) & (lists.top[at] >= n[hub])])
        found = np.unique(np.concatenate(found))
        return found[_similar(np.minimum(n[found], n[hub]), np.maximum(n[found], n[hub]))]

    def overlaps(hub: int, found: np.ndarray) -> np.ndarray:
        """Of all candidates at once: shared shingles by (candidate, fragment), summed over the fragments."""
        mine = token[begin[hub] : begin[hub] + n[hub]]
        if n[found].sum() < df[mine].sum():
            held[mine] = True
            which = np.repeat(np.arange(len(found)), n[found])
            t = token[np.arange(len(which)) + np.repeat(begin[found] - np.cumsum(n[found]) + n[found], n[found])]
            own = held[t]
            held[mine] = False
            which, t = which[own], t[own]
        else:
            at, part = whole.of(mine)
            o = whole.owner[at]
            number[found] = np.arange(len(found))
            which, t = number[o], mine[part]
            number[found] = -1
            which, t = which[which >= 0], t[which >= 0]
        return np.bincount(which * PARTS + fragment[t], minlength=len(found) * PARTS).reshape(-1, PARTS).sum(1)

    for seed in range(len(sets)):
        if not free[seed]:
            continue
        label[seed], free[seed], queue, left = seed, False, [seed], left - 1
        while queue and left:
            if 2 * left < listed:
                (every, leaders, whole), listed = postings(), left
            hub = queue.pop()
            found = candidates(hub)
            if len(found):
                total = overlaps(hub, found)
                found = found[100 * total >= PERCENT * (n[hub] + n[found] - total)]
                label[found], free[found], left = seed, False, left - len(found)
                queue.extend(found.tolist())
    return label


def _unit_task(group: pa.Table) -> pa.Table:
    root, cls, doc, sets = group.column("root").to_numpy(), group.column("class").to_numpy(), group.column("doc_id").to_pylist(), group.column("tokens")
    order = np.argsort(root, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(root[order]) != 0, [True])))
    classes, names = [], []
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[x:y]
        label = _unit_links([np.frombuffer(sets[int(i)].as_py(), U64) for i in own])
        least: dict = {}
        for i, k in zip(own, label, strict=True):
            known = [v for v in (least.get(k), doc[i]) if v is not None]
            least[k] = min(known) if known else None
        classes += cls[own].tolist()
        names += [least[k] for k in label]
    return pa.table({"class": pa.array(classes, pa.int64()), "component_id": pa.array(names, group.schema.field("doc_id").type)})


def _set_map(shared):
    """Shingles of the documents whose id is in a filter of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for whole in sliced(batches):
            ids = whole.column("id_hash").to_numpy()
            cell = _cell(mix64(ids.astype(U64)))
            b = whole.filter(pa.array((held[cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool)))
            sets = list(shingle_sets(b.column("text"), SHINGLE)) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([_class_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "class", "tokens"])

    return run


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bit per cell of doc_id hashes, packed; fixed size, false hits only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = np.unique(_cell(mix64(b.column("id_hash").to_numpy().astype(U64)))).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([cells.tobytes()], pa.binary())], names=["cells"])

    out = np.zeros(1 << CELL_BITS, bool)
    for r in ids.select("id_hash").mapInArrow(run, "cells binary").toLocalIterator():
        out[np.frombuffer(r.cells, np.uint32)] = True
    return np.packbits(out)


def _token_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        sets = [np.frombuffer(t.as_py(), np.int64) for t in b.column("tokens")]
        edges = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
        yield pa.RecordBatch.from_arrays([b.column("root"), b.column("class"), b.column("doc_id"), tokens], names=["root", "class", "doc_id", "tokens"])


def _large_units(sets: DataFrame, hubs: int = 8) -> DataFrame:
    """(class, component_id) of units too large for one task, in rounds over all of them at once.

    A round takes some classes of each unit as hubs, eight times as many as the one before, and compares them with all
    classes of other components: prefix tokens by the unit's order of frequency give the candidates, their overlaps
    are counted per fragment and summed. A hub is then done. A unit is done when its classes that are not lie in one
    component, so the largest needs no hubs; the rounds grow with the logarithm of the largest unit.
    """
    flat = written(sets.select("root", "class", "doc_id", "tokens").mapInArrow(_token_lists, f"root long, class long, doc_id {sets.schema['doc_id'].dataType.simpleString()}, tokens array<bigint>"), "unit-sets")
    each = flat.select("root", "class", F.explode("tokens").alias("token"))
    order = each.join(each.groupBy("root", "token").count(), ["root", "token"]).groupBy("root", "class").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("order"))
    size = F.size("order").cast("long")
    entries = order.select("root", "class", size.alias("n"), F.posexplode(F.slice("order", 1, (size - F.ceil(size * PERCENT / 100) + 1).cast("int"))).alias("p", "entry"))
    top = F.floor((F.col("n") - F.col("p")) * (100 + PERCENT) / PERCENT) - F.col("n")
    entries = written(entries.select("root", "class", "n", "entry.token", top.cast("long").alias("top")), "unit-prefixes")
    part = lambda k: F.filter("tokens", lambda t: F.pmod(t, F.lit(PARTS)) == k)
    pieces = flat.select("class", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), part(k).alias("tokens")) for k in range(PARTS)])).alias("piece")).select("class", "piece.*")
    pieces = written(pieces.filter(F.size("tokens") > 0), "unit-pieces")
    state = written(flat.select("root", "class", "doc_id", F.col("class").alias("comp"), F.lit(False).alias("done")), "unit-state")
    turn = 0
    while True:
        # What is left: classes that are not done, outside the component that has most of them.
        open_ = state.filter("NOT done").groupBy("root", "comp").agg(F.count("*").alias("m"))
        main = open_.groupBy("root").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.sum("m").alias("m"), F.max("m").alias("most"))
        main = written(main.filter("m > most").select("root", "main", (F.col("m") - F.col("most")).alias("left")), "unit-main")
        if main.isEmpty():
            break
        share = F.greatest(F.lit(1), F.floor(F.col("left") / (hubs * 8**turn))).cast("long")
        picked = state.filter("NOT done").join(main, "root").withColumn("hub", (F.col("comp") != F.col("main")) & (F.pmod(F.xxhash64("class", F.lit(turn)), share) == 0))
        picked = written(picked.select("root", "class", "comp", "hub"), "unit-picked")
        named = entries.join(picked, ["root", "class"])
        pairs = named.filter("hub").alias("h").join(named.alias("o"), F.expr(f"h.root = o.root AND h.token = o.token AND h.comp <> o.comp AND o.n <= h.top AND h.n <= o.top AND 100 * least(h.n, o.n) >= {PERCENT} * greatest(h.n, o.n)"))
        pairs = pairs.select(F.col("h.class").alias("hub"), F.col("o.class").alias("other"), F.col("h.n").alias("hub_n"), F.col("o.n").alias("other_n"), F.col("h.comp").alias("x"), F.col("o.comp").alias("y")).distinct()
        both = pairs.join(pieces.select(F.col("class").alias("hub"), "part", F.col("tokens").alias("hub_tokens")), "hub").join(pieces.withColumnRenamed("class", "other"), ["other", "part"])
        total = both.groupBy("hub", "other", "hub_n", "other_n", "x", "y").agg(F.sum(F.size(F.array_intersect("hub_tokens", "tokens"))).alias("overlap"))
        links = total.filter(f"100 * overlap >= {PERCENT} * (hub_n + other_n - overlap)")
        links = links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        merged = connected(links).select(F.col("node").alias("comp"), F.col("root").alias("into"))
        state = state.join(picked.filter("hub").select("class", "hub"), "class", "left").join(merged, "comp", "left")
        state = written(state.select("root", "class", "doc_id", F.coalesce("into", "comp").alias("comp"), (F.col("done") | F.col("hub").isNotNull()).alias("done")), "unit-state")
        turn += 1
    names = state.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return state.join(names, "comp").select("class", "component_id")


def join(docs: DataFrame, fragment_tokens: int = FRAGMENT_TOKENS, unit_tokens: int = UNIT_TOKENS, hot: int = HOT) -> DataFrame:
    """doc_id, text_hash, n_shingles, class (of equal sets) and component_id of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sized = cut(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_sizes, f"doc_id {kind}, text_hash long, n_shingles long, class long"))
    total = sized.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    bits = min(20, max(4, int(-(-total // fragment_tokens) - 1).bit_length()))
    edges = candidate_edges(docs, bits, frequency_levels(docs, bits), hot)
    nodes = connected(edges)
    classes = sized.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"))
    units = cut(nodes.withColumnRenamed("node", "class").join(classes, "class"))
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(units.select(F.xxhash64("first_id").alias("id_hash"))))
    sets = docs.withColumn("id_hash", F.xxhash64("doc_id")).mapInArrow(_set_map(shared), f"doc_id {kind}, class long, tokens binary").alias("s")
    sets = sets.join(units.alias("u"), F.expr("s.class = u.class AND s.doc_id <=> u.first_id")).select("u.root", "s.class", "s.doc_id", "s.tokens")
    large = cut(units.groupBy("root").agg(F.sum("n").alias("unit_n")).filter(F.col("unit_n") > unit_tokens))
    n_large = large.count()
    small = sets.join(maybe_broadcast(large, n_large), "root", "left_anti") if n_large else sets
    few = units.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bins = max(1, -(-4 * few // unit_tokens), docs.sparkSession.sparkContext.defaultParallelism)
    # Repeated rows of a class's first id are one set.
    named = small.withColumn("bin", F.pmod(F.xxhash64("root"), F.lit(bins))).groupBy("bin").applyInArrow(_unit_task, f"class long, component_id {kind}")
    if n_large:
        named = named.unionByName(_large_units(cut(sets.join(maybe_broadcast(large, n_large), "root", "left_semi").dropDuplicates(["class"]))))
    named = named.groupBy("class").agg(F.min("component_id").alias("component_id"))
    every = classes.join(named, "class", "left").select("class", F.coalesce("component_id", "first_id").alias("component_id"))
    out = sized.join(every, "class", "left")
    return out.select("doc_id", "text_hash", "n_shingles", "class", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the one with the smallest id. Another text under a copy's id stays; a
    copy without an id goes where its component has one with an id."""
    found = join(docs).filter("n_shingles > 0 AND NOT doc_id <=> component_id")
    found = cut(found.select(F.col("doc_id").alias("copy_id"), F.col("text_hash").alias("copy_hash")).distinct())
    return docs.join(maybe_broadcast(found, found.count()), F.expr("doc_id <=> copy_id AND xxhash64(text) = copy_hash"), "left_anti")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class")
