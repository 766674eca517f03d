"""Near duplicates by SuperMinHash, with banding, verification on full sets, and union-find grouping.

1. A text's set is its distinct five-word shingles (64-bit hashes). Texts with equal sets are one class, so exact copies
   are never compared.
2. SuperMinHash walks one random permutation of the signature's slots per element, all elements of a text a step at a
   time: step ``j`` offers the value ``j`` plus a fraction to the element's ``j``-th slot. The walk stops as soon as no
   slot can become smaller; a long text needs one or two steps. Signatures have 128 slots of 16 bits, in 32 bands of
   four: two sets of similarity 0.75 miss each other with a probability of about 5 in a million.
3. Members of a bucket are compared with the bucket's smallest class on their full sets. What is linked is grouped.
   Buckets that still hold several groups are looked at again, by those members only that can have a partner in another
   group: of two sets that reach the similarity the smaller has six sevenths of its shingles in common with the larger, and
   that one three quarters. So the shingles of these members are counted by group; a member with less than three quarters
   of its set in more than one group is done, and a bucket without a member of six sevenths too. Texts made from one
   template, alike but below the similarity, end here, with work in proportion to their shingles. In the rest, in blocks of
   bounded size, signatures are compared inside the task, and groups with members that agree above ``AGREEMENT`` (over five
   standard deviations below 0.75) are put into one cluster, by at most one pair per member. Each cluster's members then
   meet once, in blocks, with their full sets: the pairs that agree enough are checked there, the likeliest first, and pairs
   whose groups have been joined meanwhile are left out. Only links that join groups leave the task. So every pair that
   shares a bucket is linked, grouped already, or refused, and the pairs of a large group are never listed.
4. Groups are connected components by alternating large and small stars, with a stored table per round.

Null or empty text, or one without words: empty set, linked with nothing. Fewer words than five: the sequence is the one
shingle. Rows with equal ids are versions of one document and always in one group. A null id cannot name a group: such a
row follows the smallest id with an equal set; if there is none it has no component and is kept, by
``drop_near_duplicates`` once per set. Extra columns are not
read by ``near_duplicates``; ``drop_near_duplicates`` keeps them. Empty input: empty result. A very long text is one cell
and read whole; its set is, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import null_safe, text_key
from pairloom.llm.words import BLANK_SEPARATED, hashed_words, mixed
from pairloom.session import materialize

SHINGLE = 5
SLOTS, ROWS = 128, 4
BANDS = SLOTS // ROWS
PERCENT = 75
AGREEMENT = 0.55
BLOCK = 500
# Elements whose permutations are walked together.
GROUP_ELEMENTS = 60_000
FEATURES = "n_shingles long, key_a long, key_b long, bands array<long>"
KEY_BYTES = 6  # a shingle's hash in a stored set

_STEPS = mixed(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = mixed(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word windows."""
    words = hashed_words((text or "").encode("utf-8", "surrogatepass"), BLANK_SEPARATED)
    n = min(len(words), SHINGLE)
    if not n:
        return words
    windows = len(words) - n + 1
    total = np.full(windows, n, np.uint64)
    for k in range(n):
        total += words[k:k + windows] * _FACTORS[k]
    return np.unique(mixed(total))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SLOTS 16-bit values per set; rows of empty sets are meaningless."""
    sizes = np.array([len(s) for s in sets])
    best = np.full((len(sets), SLOTS), np.iinfo(np.int64).max, np.int64)
    row, element = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    order = np.tile(np.arange(SLOTS, dtype=np.uint8), (0, 1))
    for j in range(SLOTS):
        # A set goes on while some slot holds more than any value of this step or later ones could be.
        going = (best.max(axis=1) >= j << 32)[row]
        if not going.all() or j == 1:
            row, element = row[going], element[going]
            order = order[going] if j > 1 else order
        if not len(row):
            break
        drawn = mixed(element ^ _STEPS[j])
        at = j + (((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(SLOTS - j)) >> np.uint64(32)).astype(np.int64)
        value = (j << 32) + (drawn >> np.uint64(32)).astype(np.int64)
        if j == 0:
            slot = at
            first = at
        else:
            if j == 1:
                order = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(row), 1))
                first = first[going]
                order[np.arange(len(row)), first] = 0
            each = np.arange(len(row))
            slot = order[each, at].astype(np.int64)
            order[each, at] = order[:, j]
        np.minimum.at(best.reshape(-1), row * SLOTS + slot, value)
    return (mixed(best.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        out: list[tuple] = []
        held: list[np.ndarray] = []

        def flush() -> None:
            for s, bands in zip(held, signatures(held).view(np.int64).reshape(len(held), BANDS) if held else ()):
                key = mixed(s)
                out.append((len(s), int(key.sum().view(np.int64)), int(mixed(key).sum().view(np.int64)), bands)
                           if len(s) else (0, None, None, None))
            held.clear()

        size = 0
        for text in texts.tolist():
            s = shingles(text)
            if held and size + len(s) > GROUP_ELEMENTS:
                flush()
                size = 0
            held.append(s)
            size += len(s)
        flush()
        n, key_a, key_b, bands = zip(*out) if out else ((),) * 4
        # Keys as whole numbers from the start: with a null among them pandas would round them to floats.
        yield pd.DataFrame({"n_shingles": n, "key_a": pd.array(key_a, "Int64"), "key_b": pd.array(key_b, "Int64"),
                            "bands": pd.Series(bands, dtype=object)})


def packed_set(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([_pack(shingles(t)) for t in texts.tolist()], dtype=object)


def _pack(s: np.ndarray) -> bytes:
    low = np.unique(s & np.uint64(2 ** (8 * KEY_BYTES) - 1))
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :KEY_BYTES] = raw
    return full.view("<u8").reshape(-1)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def similar_sets(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        result, last, left = [], None, np.zeros(0, np.uint64)
        for x, y in zip(a.tolist(), b.tolist()):
            if x is not last:
                last, left = x, _unpack(x)
            result.append(similar(left, _unpack(y)))
        yield pd.Series(result, dtype=bool)


def full_sets(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, set) of the documents named by ``nodes``."""
    held = docs.join(nodes, F.col("doc_id") == F.col("node"), "left_semi").select("doc_id", "text")
    return materialize(held.select(F.col("doc_id").alias("node"), F.pandas_udf(packed_set, "binary")("text").alias("set")))


def verified(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges (a, b) whose documents' full sets are similar. A hub's many edges are split by the runtime."""
    def side(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("set").alias(f"set_{name}"))

    return (
        edges.join(side("b"), "b").join(side("a"), "a")
        .where(F.pandas_udf(similar_sets, "boolean")("set_a", "set_b")).select("a", "b").distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); the root is the smallest reachable node.

    Alternating stars: every node passes its smallest neighbour to its larger neighbours, then to its smaller ones. Both
    keep the components and end in stars around the roots after a number of rounds that grows with the logarithm of the
    largest component.
    """
    pairs = materialize(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        pairs = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            roots = pairs.select(F.col("v").alias("u"), "v").distinct()
            return pairs.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


class Groups:
    """Union-find over the labels of a task's rows."""

    def __init__(self, labels: np.ndarray):
        names, self.of = np.unique(labels, return_inverse=True)
        self.parent = list(range(len(names)))

    def find(self, row: int) -> int:
        at = int(self.of[row])
        while self.parent[at] != at:
            self.parent[at] = self.parent[self.parent[at]]
            at = self.parent[at]
        return at

    def join(self, x: int, y: int) -> bool:
        """Whether two rows were in different groups before they are joined."""
        a, b = self.find(x), self.find(y)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def in_blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key dealt to blocks of about BLOCK rows; every two blocks of a key meet in one group (keys, i, j)."""
    size = rows.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(size, keys).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns(
        {"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("blocks", "other")


def agreeing(block: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per row of block i, the rows of block j that agree enough, as positions in ``block``, and how much they agree. Of
    two rows the one with fewer shingles must be one that can be the smaller of a pair."""
    marks = np.stack(block["bands"].to_list()).astype(np.int64).view(np.uint16)
    mine, size, small = (block[c].to_numpy() for c in ("mine", "n", "small"))
    left, right = (np.flatnonzero(mine == block[k].to_numpy()) for k in ("i", "j"))
    same = block["i"].iat[0] == block["j"].iat[0]
    for n, x in enumerate(left):
        others = right[n + 1:] if same else right
        others = others[(small[x] & (size[x] <= size[others])) | (small[others] & (size[others] <= size[x]))]
        agree = (marks[others] == marks[x]).mean(axis=1)
        enough = agree >= AGREEMENT
        yield int(x), others[enough], agree[enough]


def may_be_linked(block: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's block: pairs of roots that join all groups with members that agree enough."""
    groups, found = Groups(block["root"].to_numpy()), []
    roots = block["root"].tolist()
    if len(set(roots)) > 1:
        for x, others, _ in agreeing(block):
            found += [(roots[x], roots[y]) for y in others.tolist() if groups.join(x, y)]
    return pd.DataFrame(found, columns=["a", "b"])


def links_of_cluster(block: pd.DataFrame) -> pd.DataFrame:
    """Of a cluster's block: verified pairs that join groups, the likeliest tried first."""
    groups, tried = Groups(block["root"].to_numpy()), []
    if len(set(block["root"].tolist())) > 1:
        for x, others, agree in agreeing(block):
            tried += [(-a, x, y) for y, a in zip(others.tolist(), agree.tolist()) if groups.find(x) != groups.find(y)]
    sets: dict[int, np.ndarray] = {}
    nodes, packed, found = block["node"].tolist(), block["set"].tolist(), []
    for _, x, y in sorted(tried):
        if groups.find(x) != groups.find(y):
            for at in (x, y):
                if at not in sets:
                    sets[at] = _unpack(packed[at])
            if similar(sets[x], sets[y]):
                groups.join(x, y)
                found.append((nodes[x], nodes[y]))
    return pd.DataFrame(found, columns=["a", "b"])


def several_groups(members: DataFrame, also: Column) -> DataFrame:
    """The members (band, key, node, root, ...) of buckets that hold several groups and for which ``also`` is true."""
    several = members.groupBy("band", "key").agg(F.min("root").alias("x"), F.max("root").alias("y"), also.alias("also")) \
        .where((F.col("x") != F.col("y")) & F.col("also")).select("band", "key")
    return materialize(members.join(several, ["band", "key"], "left_semi"))


def set_elements(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for packed in batches:
        yield pd.Series([_unpack(data).astype(np.int64) for data in packed.tolist()], dtype=object)


def with_partners(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Of (node, root) those whose set may reach the similarity with one of another root, with its size ``n`` and whether
    it can be the smaller of such a pair. Shingles are counted with partial minima before the shuffle."""
    elements = materialize(
        members.join(sets, "node").select("node", "root", F.pandas_udf(set_elements, "array<long>")("set").alias("s"))
        .select("node", "root", F.explode("s").alias("shingle")))
    between = elements.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y")
    held = elements.join(between.select("shingle"), "shingle", "left_semi").groupBy("node").agg(F.count("*").alias("common"))
    # The smaller of a pair has 2 * 0.75 / 1.75 of its set in common with the larger, that one 0.75 of its own.
    return materialize(
        sets.join(held, "node").withColumn("n", F.length("set") / KEY_BYTES)
        .where(100 * F.col("common") >= PERCENT * F.col("n"))
        .select("node", F.col("n").cast("long").alias("n"),
                ((100 + PERCENT) * F.col("common") >= 2 * PERCENT * F.col("n")).alias("small")))


def linked(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Verified edges (a, b) between classes (node, bands)."""
    kind = classes.schema["node"].dataType.simpleString()
    pair = f"a {kind}, b {kind}"
    banded = classes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.min("node").alias("first"), F.count("*").alias("n")) \
        .where(F.col("n") > 1)
    members = materialize(banded.join(shared, ["band", "key"]).select("band", "key", "node", "first"))
    stars = materialize(members.where(F.col("node") != F.col("first")).select(
        F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    sets = full_sets(members.select("node").distinct(), docs)
    links = materialize(verified(stars, sets))
    root = components(links)
    grouped = members.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members_of_open = several_groups(grouped, F.lit(True))
    able = with_partners(members_of_open.select("node", "root").distinct(), sets)
    still_open = several_groups(members_of_open.join(able.select("node", "n", "small"), "node"), F.max("small"))
    open_members = materialize(still_open.join(classes, "node"))
    between = in_blocks(open_members, ["band", "key"]).groupBy("band", "key", "i", "j").applyInPandas(may_be_linked, pair)
    clusters = components(between).withColumnsRenamed({"node": "of", "root": "cluster"})
    waiting = open_members.select("node", "root", "bands", "n", "small").distinct().join(clusters, F.col("root") == F.col("of"))
    more = in_blocks(waiting.select("cluster", "node", "root", "bands", "n", "small").join(sets, "node"), ["cluster"]) \
        .groupBy("cluster", "i", "j").applyInPandas(links_of_cluster, pair)
    return links.unionByName(materialize(more))


def marked_sets(docs: DataFrame) -> DataFrame:
    """Stored: per row its id, the size and key of its set, and the bands of its signature."""
    texts = docs.select("doc_id", "text")
    return materialize(texts.select("doc_id", F.pandas_udf(features, FEATURES)("text").alias("f")).select("doc_id", "f.*"))


def near_duplicates(docs: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept. ``marked`` are its ``marked_sets``, if at hand."""
    texts = docs.select("doc_id", "text")
    marked = marked_sets(docs) if marked is None else marked
    sets = marked.where(F.col("n_shingles") > 0)
    named = sets.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("node"))
    of_row = null_safe(marked.select("doc_id", "n_shingles", "key_a", "key_b"), named, ["key_a", "key_b"], "left")
    rows = materialize(of_row.select("doc_id", "n_shingles", F.coalesce("node", "doc_id").alias("node")))
    heads = materialize(
        sets.join(named.select("node").distinct(), F.col("doc_id") == F.col("node"), "left_semi")
        .select(F.col("doc_id").alias("node"), "bands").distinct())
    versions = rows.where(F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("node"))).join(
        heads.select(F.col("node").alias("own")), F.col("doc_id") == F.col("own")).select(
        F.col("doc_id").alias("a"), F.col("node").alias("b"))
    root = components(linked(texts, heads).unionByName(versions))
    grouped = rows.join(root, "node", "left").withColumn("component_id", F.coalesce("root", "node"))
    return grouped.select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per group. Of rows with the kept id, the one with the smallest hash of its text stays.

    Of rows without an id, one of each set stays that no row with an id has; those with an empty set all stay.
    """
    marked = marked_sets(docs)
    kept = near_duplicates(docs, marked).where(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    one = Window.partitionBy("doc_id").orderBy(text_key(F.col("text")))
    named = docs.join(kept, "doc_id", "left_semi").withColumn("__nth", F.row_number().over(one))
    key, columns = ["__f.key_a", "__f.key_b"], [f"`{c}`" for c in docs.columns]
    nameless = docs.where(F.col("doc_id").isNull()).select(
        F.struct(*columns).alias("__own"), F.pandas_udf(features, FEATURES)("text").alias("__f"))
    taken = marked.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).select("key_a", "key_b").distinct()
    empty = nameless.where(F.col("__f.n_shingles") == 0)
    first = Window.partitionBy(*key).orderBy(text_key(F.col("__own.text")))
    others = (
        nameless.where(F.col("__f.n_shingles") > 0)
        .join(taken, (F.col("__f.key_a") == F.col("key_a")) & (F.col("__f.key_b") == F.col("key_b")), "left_anti")
        .withColumn("__nth", F.row_number().over(first)).where(F.col("__nth") == 1)
    )
    return named.where(F.col("__nth") == 1).select(*columns).unionByName(empty.select("__own.*")) \
        .unionByName(others.select("__own.*"))
