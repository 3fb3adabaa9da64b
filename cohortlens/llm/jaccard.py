"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct five-word shingles; two documents link
when 100 |A and B| >= threshold |A or B|. Tokens are ordered rare classes first:
every shingle falls into one of ``CLASSES`` classes by its hash, all documents
are counted by class, and a class far above the median holds a frequent token.
That table has a fixed size and is the only thing that is broadcast.

* Rare tokens of the prefix (the first n - ceil(t n) + 1 tokens) are indexed one by one.
* If the prefix, extended by one token, reaches frequent classes, combinations
  of two of its frequent tokens are indexed: linked documents share a rare token
  there or two frequent ones. A document with more than ``COMBINED`` frequent
  tokens there (all but copies of popular text have none) is indexed by them one by
  one, and documents with combinations look these up too.

Documents with equal sets are one node, so copies are never expanded. Groups
that share a token are not expanded into pairs either while one comparison with
the best supported member of the token's group settles them: those links are verified
and joined to components first, and only members of different components meet. While groups that
still are open would make many pairs, each member is compared with one that its keys elect by lot, in
several turns; pairs are made of what these leave apart.
Such pairs must have sizes that can reach the threshold, and share as many tokens
of their prefixes as any linked pair of these sizes does, and parity bitmaps that do not differ
in more places than a linked pair has tokens apart; what remains is verified on the texts. Components of the links are found with alternating stars.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A text of fewer than five words
is one shingle of all of them. NULL, empty and blank texts have none and link to nothing.
A NULL doc_id counts as the smallest; rows with the same doc_id are one place. Extra
columns are carried along by ``keep_one``. Shingles are compared by 64-bit hashes; nodes are
named by 64 bits that are checked against 64 more, with another seed if two sets
should ever share a name.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.anchors import FIRST_ID, keyed
from cohortlens.llm.common import staged
from cohortlens.llm.components import components
from cohortlens.llm.tokens import LOWER, NOT_SPACE, U64, gram_hashes, mix, slices, text_buffer, word_hashes, words

# the functions below travel with the task, so executors need not have the package
register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
THRESHOLD = 80
CLASS_BITS = 19
CLASSES = 1 << CLASS_BITS
COMBINED = 12
RARE, PAIR, FEW, MANY = 0, 1, 2, 3
COMPLETE = 4
#: Times that groups of near copies are drawn together by one comparison a member, before pairs of what is left.
TURNS = 6
#: 64-bit words of the parity bitmap of a set
WORDS = 8
BITMAP = tuple(f"b{i}" for i in range(WORDS))


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and hash of every distinct shingle, sorted, and the offsets of documents in them."""
    data = LOWER[data]
    starts, ends, at = words(data, off, NOT_SPACE)
    hashes = word_hashes(data, starts, ends)
    count = np.diff(at)
    doc = np.repeat(np.arange(len(count)), count)
    grams = gram_hashes(hashes, size)
    inside = doc[: len(grams)] == doc[size - 1 :] if len(grams) else np.zeros(0, dtype=bool)
    owner, value = [doc[: len(grams)][inside]], [grams[inside]]
    for length in range(1, size):
        short = np.flatnonzero(count == length)
        if len(short):
            owner.append(short)
            value.append(gram_hashes(hashes, length)[at[short]])
    owner, value = np.concatenate(owner), np.concatenate(value)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[new], value[new]
    return owner, value, np.searchsorted(owner, np.arange(len(count) + 1))


def names_of(value: np.ndarray, at: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    out = []
    for k in (1, 2):
        total = np.concatenate([[U64(0)], np.cumsum(mix(value * U64(2 * seed + 1) + U64(k)), dtype=U64)])
        out.append(mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(U64)).view(np.int64))
    return out[0], out[1]


def bitmaps(value: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Of each set, which of 64 * WORDS places an odd number of its tokens fall on.

    Two bitmaps differ in at most as many places as the sets have tokens that are not common.
    """
    place = owner * (64 * WORDS) + (mix(value ^ U64(0x2545F4914F6CDD1D)) % U64(64 * WORDS)).astype(np.int64)
    place, count = np.unique(place, return_counts=True)
    place = place[count % 2 == 1]
    out = np.zeros(n * 8 * WORDS, dtype=np.uint8)
    np.bitwise_or.at(out, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))
    return out.view(np.int64).reshape(n, WORDS)


def least_prefix(n: np.ndarray, threshold: int) -> np.ndarray:
    return n - -(-threshold * n // 100) + 1


def _sets(docs: DataFrame, seed: int) -> DataFrame:
    """A row per document (doc, doc_id, n, node, check, bitmap), and packed class counts of each task (classes, counts)."""
    fields = [("doc", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("check", pa.int64())]
    fields += [(b, pa.int64()) for b in BITMAP]
    schema = pa.schema([*fields, ("classes", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, dtype=np.int64)
        for batch in incoming:
            data, off = text_buffer(batch.column("text"))
            for a, b in slices(off):
                owner, value, at = shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a])
                total += np.bincount((value >> U64(64 - CLASS_BITS)).astype(np.int64), minlength=CLASSES)
                node, check = names_of(value, at, seed)
                piece = batch.slice(a, b - a)
                columns = [piece.column("doc"), piece.column("doc_id"), pa.array(np.diff(at)), pa.array(node), pa.array(check)]
                columns += [pa.array(column) for column in bitmaps(value, owner, b - a).T.copy()]
                columns += [pa.nulls(b - a, schema.field(c).type) for c in ("classes", "counts")]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        filled = np.flatnonzero(total)
        for i in range(0, len(filled), 1 << 16):
            some = filled[i : i + (1 << 16)]
            columns = [pa.nulls(1, pa.int64())] * len(fields)
            columns += [pa.array([some.astype(np.int32)], pa.list_(pa.int32())), pa.array([total[some]], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    kinds = ", ".join(f"{name} long" for name, _ in fields)
    return staged(docs.mapInArrow(run, f"{kinds}, classes array<int>, counts array<bigint>"), "sets")


def frequent_classes(sets: DataFrame) -> np.ndarray:
    """Level of every class; only frequent classes, above the median by far, are gathered."""
    pairs = sets.where("classes IS NOT NULL").select(F.explode(F.arrays_zip("classes", "counts")).alias("p"))
    table = staged(pairs.groupBy(F.col("p.classes").alias("class")).agg(F.sum("p.counts").alias("n")), "classes")
    filled = table.count()
    empty, usual = CLASSES - filled, 0.0
    # the two middle ones of all classes, empty ones first
    middle = [i - empty for i in (CLASSES // 2 - 1, CLASSES // 2) if i >= empty]
    if middle:
        places = F.array(*(F.lit(min(1.0, i / max(1, filled - 1))) for i in middle))
        usual = sum(table.agg(F.percentile("n", places)).first()[0]) / 2
    high = table.where(F.col("n") > usual + excess_from(usual)).toArrow()
    level = np.zeros(CLASSES, dtype=np.uint8)
    level[high.column("class").to_numpy()] = levels(high.column("n").to_numpy(), usual)
    return level


def excess_from(usual: float) -> float:
    """How far above the usual count a frequent class begins."""
    return 8 * usual**0.5 + 50


def levels(counts: np.ndarray, usual: float) -> np.ndarray:
    """0 for rare classes, else the logarithm of how far a class is above the others, from 1 to 255."""
    excess = counts - (usual + excess_from(usual))
    return np.where(excess > 0, np.clip(1 + 8 * np.log2(np.maximum(excess, 1)), 1, 255), 0).astype(np.uint8)


def index_rows(value: np.ndarray, owner: np.ndarray, at: np.ndarray, level: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, key and flag of everything that documents are indexed by."""
    n = np.diff(at)
    of = level[(value >> U64(64 - CLASS_BITS)).astype(np.int64)].astype(np.int64)
    order = np.argsort(owner * 256 + of, kind="stable")  # hashes stay in order inside a level
    value, of = value[order], of[order]
    rank, prefix = np.arange(len(value)) - at[owner], least_prefix(n, threshold)[owner]
    first, more = rank < prefix, rank < prefix + 1
    common = of > 0
    f1 = np.bincount(owner[first & common], minlength=len(n))
    f2 = np.bincount(owner[more & common], minlength=len(n))
    # documents of which two may share tokens of their prefixes that do not meet in the index
    few = (f1 > 0) & (f2 <= COMBINED)
    rare = first & ~common
    docs, keys, flags = [owner[rare]], [value[rare]], [RARE + COMPLETE * ~few[owner[rare]]]
    single = first & common
    docs.append(owner[single])
    keys.append(mix(value[single] ^ U64(0x5851F42D4C957F2D)))
    flags.append(np.where(few[owner[single]], FEW, MANY + COMPLETE))
    for d in np.flatnonzero((f2 > 1) & (f2 <= COMBINED)).tolist():
        mine = value[at[d] : at[d + 1]][more[at[d] : at[d + 1]] & common[at[d] : at[d + 1]]]
        pairs = np.array(list(combinations(np.sort(mine).tolist(), 2)), dtype=U64)
        docs.append(np.full(len(pairs), d))
        keys.append(mix(mix(pairs[:, 0]) + pairs[:, 1]))
        flags.append(np.full(len(pairs), PAIR))
    return np.concatenate(docs), np.concatenate(keys), np.concatenate(flags)


def _index(docs: DataFrame, level: np.ndarray, threshold: int, seed: int) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("flag", pa.int32())])
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            data, off = text_buffer(batch.column("text"))
            seen: set[int] = set()
            for a, b in slices(off):
                owner, value, at = shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a])
                node, _ = names_of(value, at, seed)
                doc, key, flag = index_rows(value, owner, at, shared.value, threshold)
                # copies in one batch are indexed once
                new = np.zeros(b - a, dtype=bool)
                for i, x in enumerate(node.tolist()):
                    if x not in seen:
                        seen.add(x)
                        new[i] = True
                take = new[doc]
                doc, key, flag = doc[take], key[take], flag[take]
                columns = [pa.array(key.view(np.int64)), pa.array(node[doc]), pa.array(np.diff(at)[doc].astype(np.int32)), pa.array(flag.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("text").mapInArrow(run, "key long, node long, n int, flag int")


def _shared_keys(rows: DataFrame) -> DataFrame:
    """Index rows of the keys at which two nodes can meet, each once."""
    kind = F.col("flag").bitwiseAND(F.lit(3))
    keys = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min(kind).alias("least"), F.max(kind).alias("most"))
    keys = keys.where(f"low < high AND (least <= {PAIR} OR most = {MANY})").select("key")
    return rows.join(keys, "key", "left_semi").distinct()


def _fits(n: Column, m: Column, threshold: int) -> Column:
    return 100 * F.least(n, m).cast("long") >= threshold * F.greatest(n, m).cast("long")


def _enough(shared: Column, n: Column, m: Column, complete: Column, threshold: int) -> Column:
    """Whether two sizes with so many shared tokens in their prefixes can be linked.

    What is shared beyond the end of the prefix that ends first is at most what that set has
    beyond it. Only where all shared tokens of the prefixes have met: not for two documents
    that are both indexed by combinations.
    """
    n, m = n.cast("long"), m.cast("long")
    overlap = F.ceil((threshold * (n + m)) / (100 + threshold))
    beyond = F.greatest(*(F.ceil(threshold * x / 100) - 1 for x in (n, m)))
    return ~complete | (shared >= overlap - beyond)


def _near(n: Column, m: Column, maps: list[tuple[Column, Column]], threshold: int) -> Column:
    """Whether bitmaps allow a link: tokens that are not common are at least the places in which they differ."""
    apart = F.lit(0)
    for x, y in maps:
        apart = apart + F.bit_count(x.bitwiseXOR(y))
    both = (n + m).cast("long")
    return (both - apart) * (100 + threshold) >= both * (2 * threshold)


def _open(part: DataFrame) -> DataFrame:
    """Index rows of keys at which different components meet."""
    keys = part.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    return part.join(keys, "key", "left_semi")


def _one_each(part: DataFrame, turn: int, threshold: int) -> DataFrame:
    """For each node one of another component to be compared with: of the members that its keys elect in this
    turn the one with most of them. (a, b, part, other)."""
    names = ("node", "n", "kind", "complete", "part", *BITMAP)
    elected = part.groupBy("key").agg(F.max(F.struct(F.xxhash64("node", F.lit(turn)).alias("lot"), *names)).alias("e"))
    met = part.join(elected, "key").where("part <> e.part AND NOT (kind = 2 AND e.kind = 2)")
    met = met.where(_fits(F.col("n"), F.col("e.n"), threshold))
    met = met.where(_near(F.col("n"), F.col("e.n"), [(F.col(b), F.col(f"e.{b}")) for b in BITMAP], threshold))
    met = met.groupBy(F.col("node").alias("a"), F.col("e.node").alias("b")).agg(
        F.count(F.lit(1)).alias("shared"), F.first("part").alias("part"), F.first("e.part").alias("other")
    )
    best = met.groupBy("a").agg(F.max(F.struct("shared", "b", "part", "other")).alias("m"))
    return best.select("a", "m.b", "m.part", "m.other")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, threshold: int, seed: int) -> DataFrame:
    """The pairs (a, b) of nodes that are linked; sets are made anew from the text of one document of each node."""
    pairs = staged(pairs, "candidates")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    reps = nodes.join(wanted, "node").select("node", F.col("rep").alias("doc"))
    texts = staged(docs.select("doc", "text").join(reps, "doc").select("node", "text"), "candidate-texts")
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                sides = []
                for c in ("x", "y"):
                    _, value, edge = shingle_sets(*text_buffer(piece.column(c)))
                    sides.append((value, edge, names_of(value, edge, seed)[0]))
                (v, p, vn), (w, q, wn) = sides
                a, b = piece.column("a").to_numpy(), piece.column("b").to_numpy()
                good = np.zeros(len(a), dtype=bool)
                # a doc_id with several texts offers all of them; only that of the node counts
                for i in np.flatnonzero((vn == a) & (wn == b)).tolist():
                    x, y = v[p[i] : p[i + 1]], w[q[i] : q[i + 1]]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good[i] = 100 * common >= threshold * (len(x) + len(y) - common)
                yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], schema=schema)

    return both.mapInArrow(run, "a long, b long").distinct()


def links(docs: DataFrame, level: np.ndarray, nodes: DataFrame, threshold: int, seed: int) -> DataFrame:
    """Links between nodes that connect all linked nodes; (a, b)."""
    rows = staged(_shared_keys(_index(docs, level, threshold, seed)), "index")
    kind, whole = F.col("flag").bitwiseAND(F.lit(3)), F.col("flag") >= COMPLETE
    rows = rows.select("key", "node", "n", kind.alias("kind"), whole.alias("complete"))
    single = F.col("kind") != PAIR
    # the member that shares most keys stands for its keys: an original rather than an edit of it
    support = rows.groupBy("node").agg(F.count(F.lit(1)).alias("support"))
    ranked = rows.join(support, "node")
    best = ranked.groupBy("key").agg(F.max(F.struct("support", "node", "n", "kind", "complete")).alias("best"))
    star = rows.join(best, "key").where("node <> best.node AND NOT (kind = 2 AND best.kind = 2)")
    star = star.where(_fits(F.col("n"), F.col("best.n"), threshold))
    star = star.groupBy(F.col("node").alias("a"), F.col("best.node").alias("b")).agg(
        F.count_if(single).alias("shared"), F.first("n").alias("n"), F.first("best.n").alias("m"), F.first(F.col("complete") | F.col("best.complete")).alias("complete")
    )
    # keys may have another best member, so not all that the two share is counted: half of it will do
    star = star.where(_enough(2 * F.col("shared"), F.col("n"), F.col("m"), F.col("complete"), threshold))
    first = staged(_verified(star.select("a", "b"), docs, nodes, threshold, seed), "star-links")
    labels = components(first)
    part = rows.join(labels, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")
    part = _open(staged(part, "index-parts")).join(nodes.select("node", *BITMAP), "node")
    part = staged(part, "index-open")
    found, before = [first], float("inf")
    for turn in range(TURNS):
        size = part.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
        load = size.agg(F.sum("rows").alias("rows"), F.sum(F.expr("rows * (rows - 1) / 2")).alias("pairs")).first()
        if not load["rows"] or load["pairs"] <= 2 * load["rows"] or float(load["pairs"]) > 0.8 * before:
            break
        before = float(load["pairs"])
        pairs = staged(_one_each(part, turn, threshold), "turn-candidates")
        new = staged(_verified(pairs.select("a", "b"), docs, nodes, threshold, seed), "turn-links")
        found.append(new)
        merged = components(new.join(pairs, ["a", "b"]).select(F.col("part").alias("a"), F.col("other").alias("b")))
        merged = merged.select(F.col("node").alias("part"), "root")
        part = part.join(merged, "part", "left").withColumn("part", F.coalesce("root", "part")).drop("root")
        part = staged(_open(staged(part, "index-parts")), "index-open")
    other = part.select("key", *(F.col(c).alias(f"o_{c}") for c in ("node", "n", "kind", "complete", "part", *BITMAP)))
    pairs = part.join(other, "key").where("node < o_node AND part <> o_part AND NOT (kind = 2 AND o_kind = 2)")
    pairs = pairs.where(_fits(F.col("n"), F.col("o_n"), threshold))
    pairs = pairs.where(_near(F.col("n"), F.col("o_n"), [(F.col(b), F.col(f"o_{b}")) for b in BITMAP], threshold))
    pairs = pairs.groupBy(F.col("node").alias("a"), F.col("o_node").alias("b")).agg(
        F.count_if(single).alias("shared"), F.first("n").alias("n"), F.first("o_n").alias("m"), F.first(F.col("complete") | F.col("o_complete")).alias("complete")
    )
    pairs = pairs.where(_enough(F.col("shared"), F.col("n"), F.col("m"), F.col("complete"), threshold))
    for links_ in found:
        last = links_ if links_ is first else last.unionByName(links_)
    return last.unionByName(_verified(pairs.select("a", "b"), docs, nodes, threshold, seed))


def near_duplicates(documents: DataFrame, threshold: int = THRESHOLD, seed: int = 1) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id (smallest doc_id reachable by links)."""
    docs = keyed(documents)
    for attempt in range(8):
        sets = _sets(docs, seed + attempt)
        members = sets.where("classes IS NULL").drop("classes", "counts")
        nodes = members.where("n > 0").groupBy("node").agg(
            F.min("doc").alias("rep"), F.min("check").alias("c0"), F.max("check").alias("c1"), *(F.min(b).alias(b) for b in BITMAP)
        )
        nodes = staged(nodes, "nodes")
        if nodes.where("c0 <> c1").isEmpty():
            break
    found = links(docs, frequent_classes(sets), nodes, threshold, seed + attempt)
    labels = components(found)
    rooted = members.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.join(labels, "node", "left").groupBy(F.coalesce("root", "node").alias("of")).agg(F.min("rep").alias("component"))
    out = rooted.join(least, F.col("root") == F.col("of"), "left")
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(own != FIRST_ID, own).alias("component_id")
    )


def keep_one(documents: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``documents`` with one document of each component, that with the smallest doc_id; documents without shingles stay.

    Of several rows with that doc_id one with shingles stays (and all without).
    """
    found = near_duplicates(documents, threshold)
    stay = found.where("n_shingles = 0 OR doc_id <=> component_id").groupBy(F.col("doc_id").alias("stay_id")).agg(
        F.count(F.lit(1)).alias("stay_rows"), F.sum(F.when(F.col("n_shingles") > 0, 1).otherwise(0)).alias("stay_full")
    )
    stay = staged(stay, "stay")
    once = documents.join(stay, documents["doc_id"].cast("long").eqNullSafe(stay["stay_id"]), "inner")
    single = once.where("stay_full <= 1").select(*(documents[c] for c in documents.columns))
    if stay.where("stay_full > 1").isEmpty():
        return single
    several = once.where("stay_full > 1").select(*(documents[c] for c in documents.columns))
    blank = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    return single.unionByName(several.where(blank)).unionByName(several.where(~blank).dropDuplicates(["doc_id"]))
