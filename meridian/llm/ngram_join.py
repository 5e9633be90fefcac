"""N-gram Jaccard join by prefix trees.

A document's set holds its distinct word n-grams as 64-bit hashes; documents with equal sets form a
class, and only classes are joined. All sets use one global order: rarest n-grams first, by the frequencies of their words in
a counting sketch over all documents, then by hash; for the prefixes, n-grams that a sketch of n-grams shows to be very common stand last, so that a
passage which many documents share is a key only of those that hold little else. Two sets that link share one of their first
``n - ceil(t * n) + 1`` members.

1. Each class sends those prefix members, packed by key range; keys of one class only end there. The
   classes that share a key form a list; equal lists are kept once. A key of many classes (by a second sketch before it is sent, by
   count where it arrives) is dealt: each of its classes goes to one of several lists of about ``CAP``, so no list grows with the data and no row is copied.
2. Lists lose the pairs that size or a histogram of the n-gram hashes excludes (both are upper bounds
   of the overlap, so no link is lost). Most lists end here.
3. Stars: in each list, the smallest candidate is paired with its neighbours, which connects groups of
   near copies in linear work. Pairs that a finer histogram leaves are joined by prefix trees: a centre's neighbours stand in a trie
   in the global order, the centre walks it, sets with a common beginning share partial overlaps, and a subtree is
   left when its overlap so far plus the shorter remainder can't reach the needed overlap.
4. In lists whose members are not all connected by then, spanning forests of the pairs of different components that the finer
   histogram leaves connect components to families. All members of such lists in a family's components stand in one trie that all of them
   walk, together; found links connect at once, and what is connected is not compared. Families of over ``FAMILY`` classes or ``FAMILY_GRAMS`` members
   are walked list by list, and lists of over ``FAMILY_GRAMS`` members pair by pair.
5. Pairs of a dealt key's classes that did not meet and are not connected yet meet now: the other classes of the key meet those of its largest component, block by
   block, and each other. A key whose classes are all connected by then, as those of near copies are, needs nothing; others cost what their open pairs cost.

Links are exact overlaps of hashed sets. Classes have 64-bit names: of n classes two share a name with a
chance of about n*n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from meridian.llm.components import components
from meridian.llm.frames import joined_by_few, scratch, settle_driver, small_batches, text_bytes, whole_groups, without, written
from meridian.llm.words import LOWER, SPACED, by_size, mix, rolling, scan, text_buffer

SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
CHUNK = 1 << 14
HASH = np.uint64((1 << 58) - 1)
CAP = 256
FEW = 100_000
FAMILY = 256
FAMILY_GRAMS = 8 << 20
LEVEL_BITS = 20  # weights are integers, so that a level does not depend on what stands before an n-gram
SCAN_BYTES = 1 << 20
BUCKET_BYTES = 16 << 20
COMPARED = 1 << 12  # pairs of histograms compared at a time


def gram_sets(texts: pa.Array, n: int, weights: np.ndarray | None = None, seen: np.ndarray | None = None, last: np.ndarray | None = None) -> list[np.ndarray]:
    """Each text's distinct n-grams, ascending; a text of fewer words has its word sequence as the only one.

    A member is a frequency level (six bits, from the summed ``weights`` of the words' sketch slots; zero without them) and 58 bits of hash. ``seen`` counts words.
    N-grams of the sketch slots marked in ``last`` have the highest level, whatever their words.
    """
    data, offsets = text_buffer(texts)
    words = scan(data, offsets, SPACED, LOWER)
    slots = (words.hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    if seen is not None:
        seen += np.bincount(slots, minlength=SLOTS)
    grams, out = rolling(words.hashes, n) >> np.uint64(6), []
    if weights is not None and len(grams):
        total = np.concatenate([[0], np.cumsum(weights[slots])])
        level = np.clip((total[n:] - total[:-n]) >> LEVEL_BITS, 0, 62)
        if last is not None:
            level[last[(grams >> np.uint64(58 - SLOT_BITS)).astype(np.int64)]] = 63
        grams |= level.astype(np.uint64) << np.uint64(58)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(mix(rolling(words.hashes[a:b], b - a) + np.uint64(b - a)) >> np.uint64(6))
        else:
            out.append(grams[:0])
    return out


def word_weights(counts: np.ndarray, n: int) -> np.ndarray:
    """Per slot, the part that a word adds to an n-gram's level: rare words nothing, the most frequent 63 / n."""
    low, high = np.log2(counts.mean() / 4 + 1), np.log2(counts.max() + 2)
    share = np.maximum(0.0, (np.log2(counts + 1.0) - low) / max(1e-9, high - low))
    return np.floor(share * (63 / n) * (1 << LEVEL_BITS)).astype(np.int64)


def class_name(grams: np.ndarray) -> int:
    """A signed 64-bit name of a set; levels don't count."""
    total = mix((grams & HASH) + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total + np.uint64(len(grams))).view(np.int64)[0])


def histogram(grams: np.ndarray, bits: int | None = None) -> bytes:
    """Members by hash range, a byte each: more ranges for larger sets; none where a count does not fit."""
    if bits is None:
        bits = 6 if len(grams) < 1500 else 8 if len(grams) < 6000 else 10
    counts = np.bincount(((grams & HASH) >> np.uint64(58 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if int(counts.max()) < 256 else b""


def fine_histogram(grams: np.ndarray) -> bytes:
    """A histogram of about as many ranges as half the members."""
    return histogram(grams, min(20, max(6, (len(grams) // 2).bit_length())))


def least_overlap(a: np.ndarray, b: np.ndarray | int, percent: int) -> np.ndarray:
    """The smallest overlap of sets of these sizes with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


class Trie:
    """Globally ordered sets as a prefix tree, walked by many probes at once."""

    STEP = 64  # codes of a path that are compared before the bound is tested again

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        codes, flat, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)  # keeps the global order
        starts = np.concatenate([[0], np.cumsum(self.sizes)])
        # a code of one set is in no overlap: the tree holds the others, the sizes count all
        shared = seen > 1
        rank = np.cumsum(shared) - 1
        parts = (flat[a:b] for a, b in zip(starts[:-1], starts[1:]))
        self.n_codes, self.codes = int(shared.sum()), [rank[p[shared[p]]] for p in parts]
        self.held = np.array([len(c) for c in self.codes], np.int64)
        #: (path, depth at its end, members that end there, members below, children)
        self.nodes: list[tuple[np.ndarray, int, np.ndarray, np.ndarray, list[int]]] = []
        todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(sets)), 0, -1)]
        while todo:
            members, depth, above = todo.pop()
            first, agree = self.codes[members[0]], int(self.held[members].min())
            for m in members[1:]:
                differ = np.flatnonzero(self.codes[m][depth:agree] != first[depth:agree])
                if len(differ):
                    agree = depth + int(differ[0])
            rest = members[self.held[members] > agree]
            self.nodes.append((first[depth:agree], agree, members[self.held[members] == agree], members, []))
            if above >= 0:
                self.nodes[above][4].append(len(self.nodes) - 1)
            heads = np.array([self.codes[m][agree] for m in rest], np.int64)
            todo.extend((rest[heads == h], agree, len(self.nodes) - 1) for h in np.unique(heads))

    def links(self, probes: np.ndarray, component: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """Pairs (probe, member) that link and were not connected before; a found link connects at once."""
        label, found = component.copy(), []
        for block in np.array_split(probes, len(probes) * self.n_codes // (8 << 20) + 1):
            inside = np.zeros((len(block), self.n_codes), bool)
            for r, p in enumerate(block):
                inside[r, self.codes[p]] = True
            passed, own, mine = np.cumsum(inside, axis=1, dtype=np.int32), self.sizes[block], self.held[block]
            stack = [(0, np.arange(len(block)), np.zeros(len(block), np.int64))]
            while stack:
                node, rows, overlap = stack.pop()
                path, depth, ends, members, children = self.nodes[node]
                if (label[members] == label[members[0]]).all():  # nothing new for probes of that component
                    on = label[block[rows]] != label[members[0]]
                    rows, overlap = rows[on], overlap[on]
                low, high, at = int(self.sizes[members].min()), int(self.held[members].max()), depth - len(path)
                for a in range(0, max(len(path), 1), self.STEP):
                    step, left = path[a : a + self.STEP], mine[rows]
                    if len(step):
                        overlap = overlap + inside[np.ix_(rows, step)].sum(1)
                        left = left - passed[rows, step[-1]]
                    # the shorter of what the probe has past this code and what the largest set below has
                    on = overlap + np.minimum(left, high - at - a - len(step)) >= least_overlap(own[rows], low, percent)
                    rows, overlap = rows[on], overlap[on]
                    if not len(rows):
                        break
                for member in ends:
                    for r in rows[overlap >= least_overlap(own[rows], int(self.sizes[member]), percent)]:
                        a, b = label[block[r]], label[member]
                        if a != b:
                            label[label == b] = a
                            found.append((int(block[r]), int(member)))
                if len(rows):
                    stack.extend((child, rows, overlap) for child in children)
        return found


def _survey(docs: DataFrame, id_col: str, text_col: str, n: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Every document's set size, class and histogram; how often each sketch slot has a word, and an n-gram."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    id_type = to_arrow_type(docs.schema[id_col].dataType)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(2 * SLOTS, np.int64)
        for batch in by_size(batches, "text", SCAN_BYTES):
            sets = gram_sets(batch.column("text"), n, seen=seen[:SLOTS])
            if any(map(len, sets)):
                seen[SLOTS:] += np.bincount((np.concatenate(sets) >> np.uint64(58 - SLOT_BITS)).astype(np.int64), minlength=SLOTS)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id").cast(id_type), "text_hash": batch.column("text_hash"), "n": pa.array([len(s) for s in sets], pa.int64()), "class": pa.array([class_name(s) if len(s) else None for s in sets], pa.int64()),
                "histogram": pa.array([histogram(s) if len(s) else None for s in sets], pa.binary()), "chunk": pa.nulls(len(sets), pa.int32()), "counts": pa.nulls(len(sets), pa.binary()),
            })
        k = 2 * SLOTS // CHUNK
        if seen.any():
            yield pa.RecordBatch.from_pydict({
                "id": pa.nulls(k, id_type), "text_hash": pa.nulls(k, pa.int64()), "n": pa.nulls(k, pa.int64()), "class": pa.nulls(k, pa.int64()), "histogram": pa.nulls(k, pa.binary()),
                "chunk": pa.array(range(k), pa.int32()), "counts": pa.array([seen[c * CHUNK : (c + 1) * CHUNK].tobytes() for c in range(k)], pa.binary()),
            })

    def add(part: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for x in part.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.int64)
        return pa.table({"chunk": part.column("chunk").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    found = written(rows.mapInArrow(describe, f"id {docs.schema[id_col].dataType.simpleString()}, text_hash long, n long, class long, histogram binary, chunk int, counts binary"), "gram-sets")
    parts = found.where("chunk IS NOT NULL").select("chunk", "counts", F.pmod(F.xxhash64("counts"), F.lit(16)).alias("deal"))
    parts = parts.groupBy("chunk", "deal").applyInArrow(add, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary")
    counts = np.zeros(2 * SLOTS, np.int64)
    for row in parts.collect():  # two sketches of SLOTS counters, whatever the input
        counts[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], np.int64)
    return found.where("chunk IS NULL").drop("chunk", "counts"), counts[:SLOTS], counts[SLOTS:]


def _dealt(key: np.ndarray, name: np.ndarray, parts: np.ndarray | int) -> np.ndarray:
    """The key of the list that a class (``name``) of a dealt key belongs to; each key deals classes in its own way."""
    part = mix(name.view(np.uint64) + key) % np.asarray(parts, np.uint64)
    return mix(key + mix(part + np.uint64(1)))


def _tiles(counts: np.ndarray) -> np.ndarray:
    """Per sketch slot, over how many lists a key of it is dealt: one for all but the slots of very common n-grams."""
    usual = float(counts.mean())
    return np.maximum(1, np.ceil((counts - usual - 6 * np.sqrt(usual)) / CAP)).astype(np.int64)


def _lists(docs: DataFrame, text_col: str, n: int, percent: int, weights: np.ndarray, tiles: np.ndarray) -> DataFrame:
    """Lists of classes that share a prefix member: ``list`` (a name), ``class``, one row per member. Classes of a dealt key have rows
    with the key in ``whole`` and no ``list`` besides."""
    last = tiles > 1
    n_buckets = max(1, -(-text_bytes(docs, text_col) // BUCKET_BYTES))
    edges = np.array([(b << 64) // n_buckets for b in range(1, n_buckets)], np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text", SCAN_BYTES):
            keys, names, wholes, seen = [], [], [], set()
            for grams in gram_sets(batch.column("text"), n, weights, last=last):
                name = class_name(grams) if len(grams) else None
                if name is None or name in seen:
                    continue
                seen.add(name)
                prefix = grams[: len(grams) - -(-percent * len(grams) // 100) + 1]
                wide = tiles[((prefix & HASH) >> np.uint64(58 - SLOT_BITS)).astype(np.int64)]
                key, same = mix(prefix), np.full(len(prefix), name, np.int64)
                keys.append(np.where(wide > 1, _dealt(key, same, wide), key))
                names.append(same)
                wholes.append(np.where(wide > 1, key, np.uint64(0)))
            if not keys:
                continue
            key, name, whole = np.concatenate(keys), np.concatenate(names), np.concatenate(wholes)
            for on in (whole == 0, whole != 0):
                if not on.any():
                    continue
                order = np.argsort(key[on], kind="stable")
                k, m, w = key[on][order], name[on][order], whole[on][order]
                cuts = np.concatenate([[0], np.searchsorted(k, edges, "left"), [len(k)]])
                full = np.flatnonzero(np.diff(cuts))
                raw = lambda x: pa.array([x[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "keys": raw(k), "names": raw(m), "wholes": raw(w) if w[0] else pa.nulls(len(full), pa.binary())})

    def group(bucket: pa.Table) -> pa.Table:
        key = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in bucket.column("keys")])
        name = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in bucket.column("names")])
        whole = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) if x.is_valid else np.zeros(len(k.as_buffer()) // 8, np.uint64) for x, k in zip(bucket.column("wholes"), bucket.column("keys"))])
        order = np.lexsort((name, key))
        key, name, whole = key[order], name[order], whole[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])])
        key, name, whole = key[new], name[new], whole[new]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(heads, len(key)))
        long = np.repeat(np.where(sizes > 2 * CAP, -(-sizes // CAP), 1), sizes)
        if (long > 1).any():  # deal these too
            on = long > 1
            whole[on] = np.where(whole[on] == 0, key[on], whole[on])
            key[on] = _dealt(key[on], name[on], long[on])
            order = np.lexsort((name, key))
            key, name, whole = key[order], name[order], whole[order]
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(heads, len(key)))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(name.view(np.uint64) + np.uint64(3)))])
        lists = mix(total[heads + sizes] - total[heads] + sizes.astype(np.uint64))
        several = np.flatnonzero(sizes > 1)
        _, first = np.unique(lists[several], return_index=True)
        several = several[first]
        at = np.repeat(heads[several] - np.concatenate([[0], np.cumsum(sizes[several])[:-1]]), sizes[several]) + np.arange(sizes[several].sum())
        dealt = np.flatnonzero(whole)
        return pa.table({
            "list": pa.concat_arrays([pa.array(np.repeat(lists[several].view(np.int64), sizes[several])), pa.nulls(len(dealt), pa.int64())]),
            "class": pa.array(np.concatenate([name[at], name[dealt]])), "whole": pa.concat_arrays([pa.nulls(len(at), pa.int64()), pa.array(whole[dealt].view(np.int64))]),
        })

    blocks = docs.select(F.col(text_col).alias("text")).mapInArrow(send, "bucket int, keys binary, names binary, wholes binary")
    return written(blocks.groupBy("bucket").applyInArrow(group, "list long, class long, whole long").distinct(), "lists")


def _cross_lists(dealt: DataFrame, roots: DataFrame) -> DataFrame:
    """Lists in which classes of a dealt key (``whole, class``) meet that are not connected yet: ``list, class, root``.

    Classes outside the key's largest component meet that component's blocks of about ``CAP`` classes, and each other.
    """
    members = written(dealt.join(roots, F.col("class") == F.col("node"), "left").select("whole", "class", F.coalesce("root", "class").alias("root")), "dealt")
    parts = members.groupBy("whole", "root").agg(F.count(F.lit(1)).alias("n"))
    keys = parts.groupBy("whole").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("top"), F.sum("n").alias("all"))
    keys = written(keys.where("all > top"), "dealt-keys")
    blocks = lambda n: F.ceil(n / F.lit(float(CAP))).cast("long")
    keys = keys.select("whole", "main", "all", blocks(F.col("top")).alias("mains"), blocks(F.col("all") - F.col("top")).alias("others"))
    open_keys = joined_by_few(members, keys, ["whole"], "all", members.count()).where("main IS NOT NULL")
    own = lambda n: F.pmod(F.xxhash64("class", "whole"), F.col(n))
    inside = F.col("root") == F.col("main")
    cross = open_keys.select("whole", "class", "root", F.explode(F.when(inside, F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.xxhash64("whole", F.lit(1), own("mains"), j))).otherwise(
        F.concat(F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda b: F.xxhash64("whole", F.lit(1), b.cast("long"), own("others"))),
            F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.xxhash64("whole", F.lit(2), F.least(j.cast("long"), own("others")), F.greatest(j.cast("long"), own("others"))))))).alias("list"))
    return cross.select("list", "class", "root").distinct()


def _ranges(raw: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The histograms of at least k ranges, folded to k, and each row's place among them (-1: none)."""
    lengths = np.array([len(x) for x in raw])
    have = np.flatnonzero(lengths >= k)
    place = np.full(len(raw), -1)
    place[have] = np.arange(len(have))
    out = np.zeros((len(have), k), np.uint16)  # a range of 64 holds at most 16 bytes' counts
    for length in np.unique(lengths[have]):
        at = np.flatnonzero(lengths == length)
        out[place[at]] = np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), k, -1).sum(2, dtype=np.uint16)
    return out, place


def _candidates(lists: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Members (``list, class, root``) that size and histogram leave a partner of another root in their list, each with the centre of its star."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "list"):
            lists, names, sizes, roots = (rows.column(c).to_numpy() for c in ("list", "class", "n", "root"))
            raw, n_rows = rows.column("histogram").to_pylist(), len(lists)
            heads = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
            counts = np.diff(np.append(heads, n_rows))
            after = np.repeat(heads + counts, counts)  # where each row's list ends
            levels = [_ranges(raw, k) for k in (64, 256, 1024)]
            centre, paired = np.full(n_rows, n_rows), np.zeros(n_rows, bool)
            row = np.arange(n_rows)
            for d in range(1, int(counts.max())):  # rows stand by size: partners lie d rows on
                row = row[row + d < after[row]]
                row = row[percent * sizes[row + d] <= 100 * sizes[row]]
                apart = row[roots[row] != roots[row + d]]
                for part in np.array_split(apart, len(apart) // COMPARED + 1):
                    other = part + d
                    need = least_overlap(sizes[part], sizes[other], percent)
                    for bars, place in levels:
                        both = (place[part] >= 0) & (place[other] >= 0)
                        top = need.copy()
                        top[both] = np.minimum(bars[place[part[both]]], bars[place[other[both]]]).sum(1, dtype=np.int64)
                        part, other, need = part[top >= need], other[top >= need], need[top >= need]
                        if not len(part) or not both.any():
                            break
                    paired[part] = paired[other] = True
                    np.minimum.at(centre, other, part)
            keep = np.flatnonzero(paired)
            if not len(keep):
                continue
            heads = np.flatnonzero(np.concatenate([[True], lists[keep][1:] != lists[keep][:-1]]))
            counts = np.diff(np.append(heads, len(keep)))
            label = mix(np.add.reduceat(mix(names[keep].view(np.uint64) + np.uint64(3)), heads) + counts.astype(np.uint64)).view(np.int64)
            middle = centre[keep]
            yield pa.RecordBatch.from_pydict({"list": pa.array(np.repeat(label, counts)), "class": pa.array(names[keep]), "centre": pa.array(names[np.minimum(middle, n_rows - 1)], mask=middle == n_rows)})

    described = lists.join(classes.select("class", "n", "histogram"), "class")
    sorted_lists = described.select("list", "class", "root", "n", "histogram").repartition("list").sortWithinPartitions("list", "n", "class")
    return sorted_lists.mapInArrow(judge, "list long, class long, centre long").distinct()


def _sequences(docs: DataFrame, id_col: str, text_col: str, n: int, wanted: DataFrame, weights: np.ndarray) -> DataFrame:
    """``class, n, fine, grams`` of the wanted classes (``class``, and ``id`` and ``text_hash`` of one document of each): the finer histogram and the ordered set."""

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text", SCAN_BYTES):
            asked = batch.column("class").to_pylist()
            sets = gram_sets(batch.column("text"), n, weights)
            keep = [k for k, s in enumerate(sets) if len(s) and class_name(s) == asked[k]]
            yield pa.RecordBatch.from_pydict({
                "class": pa.array([asked[k] for k in keep], pa.int64()), "n": pa.array([len(sets[k]) for k in keep], pa.int64()),
                "fine": pa.array([fine_histogram(sets[k]) for k in keep], pa.binary()), "grams": pa.array([sets[k].tobytes() for k in keep], pa.binary()),
            })

    wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("__hash"))
    rows = rows.join(wanted, rows["__id"].eqNullSafe(wanted["id"]) & (rows["__hash"] == wanted["text_hash"])).select("text", "class")
    found = rows.mapInArrow(order, "class long, n long, fine binary, grams binary")
    return found.groupBy("class").agg(F.first("n").alias("n"), F.first("fine").alias("fine"), F.first("grams").alias("grams"))


def _bound(a: bytes, b: bytes) -> int:
    """The largest overlap that two histograms allow; without one there is no bound."""
    if not a or not b:
        return np.iinfo(np.int64).max
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    k = min(len(x), len(y))
    return int(np.minimum(*(z if len(z) == k else z.reshape(k, -1).sum(1) for z in (x, y))).sum())


def _close(pairs: DataFrame, sequences: DataFrame, percent: int) -> DataFrame:
    """The pairs (``u, v``) whose finer histograms allow a link."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n, m = (batch.column(c).to_pylist() for c in ("x", "y", "n", "m"))
            keep = [_bound(p, q) >= least_overlap(i, j, percent) for p, q, i, j in zip(x, y, n, m)]
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(pa.array(keep)), batch.column("v").filter(pa.array(keep))], ["u", "v"])

    rows = pairs.join(sequences.select(F.col("class").alias("u"), F.col("n"), F.col("fine").alias("x")), "u")
    rows = rows.join(sequences.select(F.col("class").alias("v"), F.col("n").alias("m"), F.col("fine").alias("y")), "v")
    return rows.select("u", "v", "n", "m", "x", "y").mapInArrow(judge, "u long, v long")


def _open_pairs(members: DataFrame, sequences: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs of a list (``list, class, root``) in different components whose finer histograms allow a link.

    All of them, or with ``forest`` only as many as would connect the list if all of them linked.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "list"):
            lists, names, roots, sizes = (rows.column(c).to_numpy() for c in ("list", "class", "root", "n"))
            fine, u, v = rows.column("fine").to_pylist(), [], []
            heads = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
            for a, b in zip(heads, np.append(heads[1:], len(lists))):
                lengths = np.array([len(x) for x in fine[a:b]])  # they stand by size, so equal lengths stand together
                tables = {k: (int(np.searchsorted(lengths, k)), np.frombuffer(b"".join(x for x in fine[a:b] if len(x) == k), np.uint8).reshape(-1, k)) for k in np.unique(lengths).tolist() if k} if (np.diff(lengths) >= 0).all() else {}
                label = np.unique(roots[a:b], return_inverse=True)[1]
                for i in range(a, b - 1):
                    end = min(b, a + int(np.searchsorted(sizes[a:b], 100 * sizes[i] // percent, "right")))
                    others = np.arange(i + 1, end)
                    others = others[label[i + 1 - a : end - a] != label[i - a]]
                    if not len(others):
                        continue
                    k = len(fine[i])
                    need, top = least_overlap(sizes[others], int(sizes[i]), percent), np.full(len(others), -1, np.int64)
                    if k in tables:
                        same = lengths[others - a] == k
                        start, table = tables[k]
                        top[same] = np.minimum(table[i - a - start], table[others[same] - a - start]).sum(1)
                    for p in np.flatnonzero(top < 0):
                        top[p] = _bound(fine[i], fine[others[p]])
                    others = others[top >= need]
                    if forest and len(others):
                        joined, first = np.unique(label[others - a], return_index=True)
                        others = others[first]
                        label[np.isin(label, joined)] = label[i - a]
                    u.extend([names[i]] * len(others))
                    v.extend(names[others])
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    rows = members.join(sequences.select("class", "n", "fine"), "class").select("list", "class", "root", "n", "fine")
    return rows.repartition("list").sortWithinPartitions("list", "n", "class").mapInArrow(judge, "u long, v long").distinct()


def _links(pairs: DataFrame, sequences: DataFrame, percent: int) -> DataFrame:
    """The pairs (``u, v``) that link: the sets of all v of one u stand in a trie that u's set walks."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, list[int]] = {}
            for k, c in enumerate(batch.column("u").to_pylist()):
                by.setdefault(c, []).append(k)
            members, grams, middle = batch.column("v").to_pylist(), batch.column("grams"), batch.column("middle")
            links = []
            for c, ks in by.items():
                for a in range(0, len(ks), CAP):
                    some = ks[a : a + CAP]
                    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in (middle[some[0]], *(grams[k] for k in some))]
                    found = Trie(sets).links(np.array([0]), np.arange(len(sets)), percent)
                    links.extend((c, members[some[m - 1]]) for _, m in found if m)
            yield pa.RecordBatch.from_pydict({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})

    rows = pairs.join(sequences.select(F.col("class").alias("v"), "grams"), "v")
    rows = rows.join(sequences.select(F.col("class").alias("u"), F.col("grams").alias("middle")), "u")
    return rows.select("u", "v", "grams", "middle").mapInArrow(walk, "u long, v long")


def _family_links(families: DataFrame, sequences: DataFrame, percent: int) -> DataFrame:
    """Links that connect the components of each family (``family, class, root``): its sets stand in one trie that all of them walk."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "family"):
            families, names, roots = (rows.column(c).to_numpy() for c in ("family", "class", "root"))
            grams, links = rows.column("grams"), []
            heads = np.flatnonzero(np.concatenate([[True], families[1:] != families[:-1]]))
            for a, b in zip(heads, np.append(heads[1:], len(families))):
                sets = [np.frombuffer(grams[int(k)].as_buffer(), np.uint64) for k in range(a, b)]
                component = np.unique(roots[a:b], return_inverse=True)[1]
                links.extend((names[a + x], names[a + y]) for x, y in Trie(sets).links(np.arange(b - a), component, percent))
            yield pa.RecordBatch.from_pydict({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})

    rows = families.join(sequences.select("class", "grams"), "class").select("family", "class", "root", "grams")
    return rows.repartition("family").sortWithinPartitions("family", "class").mapInArrow(walk, "u long, v long")


def _rooted(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """``id, text_hash, n, root`` of every document: equal roots mean that links connect them; null without a set."""
    with small_batches(docs.sparkSession), scratch(docs.sparkSession, keep="rooted"):
        return written(_connected(docs, id_col, text_col, n, percent), "rooted")


def _settle(candidates: DataFrame, sequences: DataFrame, percent: int, links: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``links`` and ``roots`` with the links that connect different components in the candidates' lists."""
    members = candidates.select("list", "class").distinct().join(roots, F.col("class") == F.col("node"), "left").select("list", "class", F.coalesce("root", "class").alias("root"))
    several = members.groupBy("list").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("list")
    members = written(members.join(several, "list"), "open-lists")
    forest = written(_open_pairs(members, sequences, percent, forest=True), "forest")
    ends = forest.select(F.col("u").alias("class")).union(forest.select("v")).distinct()
    ends = written(ends.join(roots, F.col("class") == F.col("node"), "left").select("class", F.coalesce("root", "class").alias("root")), "forest-ends")
    # whatever may link across components is connected by the forests and the links so far; a forest leaves out pairs of what it
    # has joined, so not only its ends but every open member of a component that it reaches walks
    family = components(forest.union(ends.select("class", "root"))).select(F.col("node").alias("root"), F.col("root").alias("family"))
    family = members.select("class", "root").distinct().join(family, "root").join(sequences.select("class", "n"), "class")
    family = written(family.select("class", "root", "family", "n"), "families")
    settle_driver(family.sparkSession)
    over = lambda df, key, most: df.groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).where((F.col("k") > most) | (F.col("n") > FAMILY_GRAMS)).select(key)
    large = written(over(family, "family", FAMILY), "large-families")
    more = _family_links(family.join(large, "family", "left_anti"), sequences, percent)
    rest = members.join(family.join(large, "family", "left_semi").select("class", "n"), "class")
    long = written(over(rest, "list", 4 * CAP), "long-lists")
    more = more.union(_family_links(rest.join(long, "list", "left_anti").withColumnRenamed("list", "family"), sequences, percent))
    more = written(more.union(_links(_open_pairs(rest.join(long, "list", "left_semi").select("list", "class", "root"), sequences, percent, forest=False), sequences, percent)), "more-links")
    if more.isEmpty():
        return links, roots
    links = links.union(more)
    return links, components(links)


def _connected(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    described, word_counts, gram_counts = _survey(docs, id_col, text_col, n)
    weights = word_weights(word_counts, n)
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash"))
    classes = described.where("n > 0").groupBy("class").agg(F.first("n").alias("n"), F.first("histogram").alias("histogram"), one.alias("one"))
    classes = classes.select("class", "n", "histogram", "one.id", "one.text_hash")
    lists = _lists(docs, text_col, n, percent, weights, _tiles(gram_counts))
    settle_driver(docs.sparkSession)
    candidates = written(_candidates(lists.where("list IS NOT NULL").select("list", "class", F.col("class").alias("root")), classes, percent), "candidates")
    settle_driver(docs.sparkSession)
    wanted = written(candidates.select("class").distinct().join(classes.select("class", "id", "text_hash"), "class"), "wanted")
    sequences = written(_sequences(docs, id_col, text_col, n, wanted, weights), "sequences")
    settle_driver(docs.sparkSession)
    stars = candidates.where("centre IS NOT NULL").select(F.col("centre").alias("u"), F.col("class").alias("v")).distinct()
    links = written(_links(written(_close(stars, sequences, percent), "star-pairs"), sequences, percent), "star-links")
    links, roots = _settle(candidates, sequences, percent, links, components(links))
    settle_driver(docs.sparkSession)
    dealt = lists.where("whole IS NOT NULL").select("whole", "class").distinct()
    cross = written(_cross_lists(dealt, roots), "cross-lists") if not dealt.isEmpty() else dealt
    if not cross.isEmpty():
        candidates = written(_candidates(cross, classes, percent), "cross-candidates")
        settle_driver(docs.sparkSession)
        wanted = candidates.select("class").distinct().join(sequences, "class", "left_anti").join(classes.select("class", "id", "text_hash"), "class")
        more = written(_sequences(docs, id_col, text_col, n, written(wanted, "wanted"), weights), "sequences")
        links, roots = _settle(candidates, sequences.unionByName(more), percent, links, roots)
    named = described.select("id", "text_hash", "n", "class").join(roots, F.col("class") == F.col("node"), "left")
    return named.select("id", "text_hash", "n", F.coalesce("root", "class").alias("root"))


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``id_col``, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Documents link when the Jaccard similarity of their sets of ``n``-word shingles (words are runs of anything but
    ASCII white space, A-Z lower-cased) is at least ``percent`` per cent. A text of fewer words has its word sequence
    as the only shingle; null, empty and blank texts have no set, link with nothing and are their own component.
    Rows with tied or repeated ids stay apart as rows; a null id is never the smallest unless a component has no other.
    An empty table gives an empty result; other columns are ignored.
    """
    rooted = _rooted(docs, id_col, text_col, n, percent)
    smallest = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    out = joined_by_few(rooted, smallest, ["root"], "size", rooted.count())
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one of the smallest id (nulls last), then of the smallest text hash.

    Texts without words all stay. Of rows that agree in id and text one stays. All columns are kept.
    """
    with scratch(docs.sparkSession, keep="gone"):
        rooted = _rooted(docs, id_col, text_col, n, percent).where("root IS NOT NULL")
        order = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
        best = rooted.groupBy("root").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("size"))
        losers = joined_by_few(rooted, best, ["root"], "size", rooted.count()).where(~(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("text_hash") == F.col("best.text_hash"))))
        kept = without(docs, losers, id_col, text_col)
        if rooted.groupBy("id", "text_hash").count().where("count > 1").isEmpty():
            return kept
    worded = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    once = kept.where(worded).withColumn("__hash", F.xxhash64(text_col)).dropDuplicates([id_col, "__hash"]).drop("__hash")
    return once.unionByName(kept.where(~worded))


def op6(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over ``documents``: three-word shingles, similarity of 90 per cent or more."""
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90)
