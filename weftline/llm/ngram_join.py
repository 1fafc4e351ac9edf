"""Join of documents whose sets of 5-word shingles have Jaccard similarity 0.8 or more.

Method: universe partition with a pigeonhole. Two sets of sizes a and b that link differ in at most H = (a + b) / 9
shingles. A size band has a partition of the hash universe into m segments; a document writes the digests of its first
H + 1 non-empty segments, so two linked documents have an equal segment among them. A document with too few non-empty
segments (small ones, or by chance) is allocated more: all its segments, each segment's one-deletion neighbourhood where
it has two shingles or more (which tolerates one difference at the cost of some digests), and if even that does not
reach H + 1 a digest that all such documents of the band share. A document takes part in its own band and, where it can
have larger partners there, in the next.

Documents with equal sets are one class and are joined as one. Segments that two classes share make a run. The run's
members are assigned to the member that is in most runs (its hub; pairs that share too few signatures are dropped first),
and all that meet at a hub are compared exactly, in cells of bounded bytes; a cell returns the links that connect its members,
not all pairs. Where a hub has too many members for one cell, each chunk of them is first compared within itself and with
the hub. Members that are connected with the hub so need no more; only the others are compared with the other chunks, so a
group of near copies costs work in proportion to its size. Connected components follow by rounds of label spreading over
tables in the shared folder.

Defined results: a null or empty text, or one of separators only, has the empty set, links with nothing and is its own
component; fewer than five words are one shingle; rows that repeat doc_id and text are rows of one class; a null
doc_id never names a component that has another; an empty table gives an empty table. ``assign`` ignores other columns,
``deduplicate`` keeps them, whatever their names and types: of each component the row of the smallest doc_id stays (a null
one only where no other exists), and of rows that repeat doc_id and text one (settled by the other columns but for maps).
Shingles are compared by 64-bit hashes, classes by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import LOWER, SPACE_CLASS, UPPER, WORD_CLASS, Scratch, drop_path, new_path, row_order, table, unused, written

SHINGLE = 5
#: Similarity in hundredths.
PERCENT = 80
#: Signatures of a bucket, on average; and the bytes of sets and the members in one chunk of a cell.
BUCKET_SIGS = 200_000
CHUNK_BYTES, CHUNK_ROWS = 8_000_000, 2_048
#: Characters of text that are worked on together.
AT_ONCE = 400_000
#: Signatures beyond H + 1, in hundredths of a set's size, so that linked sets share several.
EXTRA = 4
#: Rounds of pruning; each is exact, more of them only leave less to compare.
ROUNDS = 1
#: Slots for each candidate in the filter that finds their texts, and the limits of its size, as powers of two. At the upper one
#: (16 MB) it passes more texts than asked for beyond some 10 million candidates, which costs shuffle but no result.
SLOTS, LEAST_BITS, MOST_BITS = 64, 16, 27

U = np.uint64
_ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_RANDOM = np.random.default_rng(4)
_BYTE = _RANDOM.integers(1, 2**63, 256).astype(U) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(int(_BASE), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, AT_ONCE * 2)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer((b"\n".join(raw) + b"\n").translate(_ASCII_LOWER), np.uint8)
    if not len(buf):
        return []
    gap = _SEPARATOR[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = powers(len(buf))
    total = np.concatenate((np.zeros(1, U), np.cumsum(_BYTE[buf] * up)))
    words = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))
    first_byte = np.cumsum([0] + [len(r) + 1 for r in raw])
    first = np.searchsorted(starts, first_byte)
    n = len(words)
    out: list[np.ndarray] = []
    if n >= SHINGLE:
        h = words[: n - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            h = h * _BASE + words[k : n - SHINGLE + 1 + k]
        h = mix64(h)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(h[a : b - SHINGLE + 1]))
        elif b > a:
            one = b - a
            for w in words[a:b].tolist():
                one = (one * int(_BASE) + w) % 2**64
            out.append(mix64(np.array([one], U)))
        else:
            out.append(np.empty(0, U))
    return out


def class_of(s: np.ndarray) -> tuple[int, bytes]:
    """(64-bit id, 128-bit id) of a set: sums of two mixes of its members."""
    a, b = mix64(s + U(11)).sum(dtype=U), mix64(s ^ U(0x5555555555555555)).sum(dtype=U)
    return int(np.array(a).view(np.int64)), int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


# -- bands, segments and signatures ------------------------------------------------------------------------------


def band_limits(most: int) -> np.ndarray:
    """Least sizes of the bands, each about 1.5 times the one before."""
    out = [1]
    while out[-1] <= most * 2:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return np.array(out)


_LIMITS = band_limits(1 << 40)


def wished_extra(n: int) -> int:
    """Signatures beyond H + 1 that a set of n shingles writes if it can."""
    return n * EXTRA // 100


def segments_of(s: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(segment of each hash, first hash of each non-empty segment, H) of a set in a band."""
    n, high = len(s), int(_LIMITS[band + 1]) - 1
    m = -(-high * 3 // 10) + 3
    segment = ((s >> U(32)) * U(m)) >> U(32)  # ascending, as the hashes are
    return segment, np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1]))), (n + min(n * 5 // 4, high)) // 9


def bands_of(n: int) -> list[int]:
    band = int(np.searchsorted(_LIMITS, n, "right")) - 1
    return [band, band + 1] if int(_LIMITS[band + 1]) <= n * 5 // 4 else [band]


def allocate(s: np.ndarray, weight: np.ndarray, band: int) -> np.ndarray:
    """The signatures of a set (ascending hashes, and their weights for set digests) in a band."""
    n = len(s)
    segment, begin, differ = segments_of(s, band)
    salt = mix64((segment[begin] << U(8)) + U(band * 2 + 1))
    sums = np.add.reduceat(weight, begin)
    if len(begin) > differ:
        most = differ + 1 + wished_extra(n)
        return mix64(sums[:most] + salt[:most])
    sizes = np.diff(np.append(begin, n))
    whole = mix64(sums + salt)
    of = np.repeat(np.arange(len(begin)), sizes)
    several = sizes[of] > 1
    less = mix64(sums[of[several]] - weight[several] + salt[of[several]])
    parts = [whole, less]
    if int((sizes == 1).sum()) + 2 * int((sizes > 1).sum()) <= differ:
        parts.append(mix64(np.array([band * 2], U)))
    return np.concatenate(parts)


def sure_extra(s: np.ndarray) -> int:
    """How many signatures beyond one a linked document shares with this one, if it is as sure of as many itself."""
    n = len(s)
    if not (wish := wished_extra(n)):
        return 0
    return max(0, min(min(wish, len(begin) - differ - 1) for band in bands_of(n) for _, begin, differ in [segments_of(s, band)]))


def signatures(s: np.ndarray) -> np.ndarray:
    weight = mix64(s + U(0x1234567))
    return np.concatenate([allocate(s, weight, band) for band in bands_of(len(s))])


def parts_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= AT_ONCE:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


# -- distributed steps -------------------------------------------------------------------------------------------


def sizes_and_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, extra, ref, cls) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            n, extra, ref, cls = [], [], [], []
            for a, b in parts_of(texts):
                for s in shingle_sets(texts[a:b]):
                    r, c = class_of(s)
                    n.append(len(s))
                    extra.append(sure_extra(s))
                    ref.append(r)
                    cls.append(c)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(extra, pa.int32()), pa.array(ref, pa.int64()), pa.array(cls, pa.binary())], names=["doc_id", "text_key", "n", "extra", "ref", "cls"])

    return docs.mapInArrow(work, "doc_id long, text_key long, n long, extra int, ref long, cls binary")


def runs_of(docs: DataFrame, buckets: int) -> DataFrame:
    """(run, ref): classes that share a signature with another class."""
    shift = U(64 - (buckets.bit_length() - 1)) if buckets > 1 else None

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            seen: set[int] = set()
            for a, b in parts_of(texts):
                keys, refs = [], []
                for s in shingle_sets(texts[a:b]):
                    if len(s) and (ref := class_of(s)[0]) not in seen:
                        seen.add(ref)
                        got = signatures(s)
                        keys.append(got)
                        refs.append(np.full(len(got), ref, np.int64))
                if not keys:
                    continue
                key, of = np.concatenate(keys), np.concatenate(refs)
                order = np.argsort(key)
                key, of = key[order], of[order]
                bucket = (key >> shift).astype(np.int64) if shift is not None else np.zeros(len(key), np.int64)
                at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                cut = [*at.tolist(), len(key)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int64()), pa.array([key[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)], pa.binary()), pa.array([of[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)], pa.binary())], names=["bucket", "keys", "refs"])

    def meet(got: pa.Table) -> pa.Table:
        key = np.frombuffer(b"".join(got["keys"].to_pylist()), U)
        ref = np.frombuffer(b"".join(got["refs"].to_pylist()), np.int64)
        order = np.argsort(key)
        key, ref = key[order], ref[order]
        same = key[1:] == key[:-1]
        twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
        key, ref = key[twice], ref[twice]
        order = np.lexsort((ref, key))
        key, ref = key[order], ref[order]
        if len(key):
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (ref[1:] != ref[:-1])))
            key, ref = key[new], ref[new]
            _, where, count = np.unique(key, return_inverse=True, return_counts=True)
            key, ref = key[count[where] > 1], ref[count[where] > 1]
        return pa.table([pa.array(key.view(np.int64)), pa.array(ref)], names=["run", "ref"])

    blocks = docs.select("text").mapInArrow(write, "bucket long, keys binary, refs binary")
    return blocks.groupBy("bucket").applyInArrow(meet, "run long, ref long")


CELL = "a binary, b binary, hub long, ref long"


def cell_links(cls: list[bytes], links: list[tuple[int, int]], hub: int = 0, apart: list[int] = ()) -> pa.Table:
    """Links of a cell as (a, b), and the members that it leaves apart from the hub as (hub, ref)."""
    n, m = len(links), len(apart)
    return pa.table({
        "a": pa.array([cls[i] for i, _ in links] + [None] * m, pa.binary()), "b": pa.array([cls[j] for _, j in links] + [None] * m, pa.binary()),
        "hub": pa.array([None] * n + [hub] * m, pa.int64()), "ref": pa.array([None] * n + list(apart), pa.int64()),
    })


def compare_chunk(got: pa.Table) -> pa.Table:
    """The links that connect a chunk's members, all pairs considered; of a hub with more chunks also who is not connected with the hub."""
    cls, ref = got["cls"].to_pylist(), got["ref"].to_pylist()
    links, root = connect([np.frombuffer(x, U) for x in got["hashes"].to_pylist()])
    if not got["several"][0].as_py():
        return cell_links(cls, links)
    hub = got["hub"][0].as_py()
    near = {root[i] for i, r in enumerate(ref) if r == hub}
    return cell_links(cls, links, hub, [r for i, r in enumerate(ref) if root[i] not in near])


def compare_cell(got: pa.Table) -> pa.Table:
    """The links that connect the members that ask with each other and with the rest of the cell."""
    links, _ = connect([np.frombuffer(x, U) for x in got["hashes"].to_pylist()], got["asks"].to_numpy(zero_copy_only=False))
    return cell_links(got["cls"].to_pylist(), links)


def connect(sets: list[np.ndarray], asks: np.ndarray | None = None) -> tuple[list[tuple[int, int]], list[int]]:
    """A spanning forest of the link graph of sets, and each one's root; with ``asks`` of the links that one who asks has."""
    n = len(sets)
    asks = np.ones(n, bool) if asks is None else asks
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    head = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    df = np.diff(np.append(head, len(tokens)))
    token = np.repeat(np.arange(len(head)), df)
    shared = df[token] > 1
    token, own = token[shared], owner[shared]
    # Each member's shared tokens, and each token's members.
    by = np.lexsort((token, own))
    first = np.searchsorted(own[by], np.arange(n + 1))
    held = token[by]
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i in np.flatnonzero(asks).tolist():
        mine = held[first[i] : first[i + 1]]
        if 100 * len(mine) < PERCENT * size[i]:
            continue
        counts, lengths = head[mine], df[mine]
        total = int(lengths.sum())
        at = np.repeat(counts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(total)
        common = np.bincount(owner[at], minlength=n)
        union = size[i] + size - common
        other = ~asks | (np.arange(n) < i)  # those that ask too are met once
        for j in np.flatnonzero((100 * common >= PERCENT * union) & other).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((i, j))
    return links, [find(i) for i in range(n)]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root) of every vertex of the edges (a, b); root is the least vertex of the component.

    Each round every vertex points at the least of its neighbours' roots, and pointers are then followed once, so a
    component of n vertices settles in about log n rounds. Each round is a table; the one before it is dropped.
    """
    spark = edges.sparkSession
    both = scratch.written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "v")
    path = None
    while True:
        to = new_path(spark, "roots")
        roots.write.parquet(to)
        now = spark.read.schema("v binary, root binary").parquet(to)
        if path:
            drop_path(spark, path)
        path = to
        near = both.join(now.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("root").alias("near")).withColumnRenamed("a", "v")
        moved = now.join(near, "v").select("v", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # A root takes on what its members have heard, so whole trees move at once.
        heard = moved.filter("root < old").groupBy(F.col("old").alias("v")).agg(F.min("root").alias("heard"))
        lifted = moved.join(heard, "v", "left").select("v", "old", F.least("root", F.coalesce("heard", "root")).alias("root"))
        step = scratch.written(lifted, "roots-step")
        jump = step.select(F.col("v").alias("root"), F.col("root").alias("next"))
        if not step.filter("root <> old").limit(1).count():
            return now
        roots = step.join(jump, "root", "left").select("v", F.least("root", F.coalesce("next", "root")).alias("root"))


def pruned(runs: DataFrame, extras: DataFrame) -> DataFrame:
    """Runs without members that are in too few runs to link with any other member, nor runs of one.

    Linked x and y share 1 + min(extra_x, extra_y) runs at least, so x is in more runs than min(extra_x, least extra
    of the run's members) wherever it meets a partner.
    """
    each = runs.groupBy("ref").agg(F.count(F.lit(1)).alias("runs")).join(extras, "ref")
    of_run = runs.join(extras, "ref").groupBy("run").agg(F.min("extra").alias("least"), F.count(F.lit(1)).alias("k"))
    kept = runs.join(each, "ref").join(of_run.filter("k > 1"), "run").filter(F.col("runs") > F.least("extra", "least"))
    return kept.select("run", "ref")


def meeting_points(runs: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(hub, ref): which classes are compared with which; all that meet at a hub are.

    Runs of two are pairs. Linked sets share 1 + extra signatures, so a pair with fewer is dropped: it shares its runs of
    two, and at most as many larger ones as its rarer member is in. Members of larger runs go to the run's hub.
    """
    by_run = runs.groupBy("run").agg(F.count(F.lit(1)).alias("k"), F.min("ref").alias("a"), F.max("ref").alias("b"))
    large = runs.join(by_run.filter("k > 2").select("run"), "run")
    large = scratch.written(large, "runs-large")
    degree = runs.groupBy("ref").agg(F.count(F.lit(1)).alias("degree"))
    in_large = large.groupBy("ref").agg(F.count(F.lit(1)).alias("large"))
    facts = classes.groupBy("ref").agg(F.max("n").alias("most"), F.min("n").alias("least"), F.min("extra").alias("extra")).join(in_large, "ref", "left")
    of = lambda x: facts.select(F.col("ref").alias(x), F.col("most").alias(f"most_{x}"), F.col("least").alias(f"least_{x}"), F.col("extra").alias(f"extra_{x}"), F.coalesce("large", F.lit(0)).alias(f"large_{x}"))
    pairs = by_run.filter("k = 2").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).join(of("a"), "a").join(of("b"), "b")
    enough = F.col("shared") + F.least("large_a", "large_b") > F.least("extra_a", "extra_b")
    fits = (F.col("least_a") * 4 <= F.col("most_b") * 5) & (F.col("least_b") * 4 <= F.col("most_a") * 5)
    two = pairs.filter(enough & fits).select(F.col("a").alias("hub"), F.explode(F.array("a", "b")).alias("ref"))
    # The hub of a run is its member that is in most runs; in a group of near copies that is the text they stem from.
    weighed = large.join(degree, "ref")
    hubs = weighed.groupBy("run").agg(F.max(F.struct("degree", "ref"))["ref"].alias("hub"))
    return large.join(hubs, "run").select("hub", "ref").unionByName(two).distinct()


def slots_of(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit map with the low bits of the keys set: built in parts, so the driver gets 2 ** MOST_BITS bits at most."""
    slot = F.col(column).bitwiseAND((1 << bits) - 1)
    words = keys.select(F.shiftright(slot, 5).cast("int").alias("word"), slot.bitwiseAND(31).cast("int").alias("at"))
    got = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    return out


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, linked): rows has (doc_id, text_key, n, extra, ref, cls) of every row; linked (v, root) of classes with links."""
    spark = docs.sparkSession
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = body.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    rows = written(sizes_and_classes(keyed), "shingle-classes")
    classes = rows.filter("n > 0").groupBy("cls", "ref", "n").agg(F.min(F.struct("doc_id", "text_key")).alias("at"), F.min("extra").alias("extra"))
    volume = rows.agg(F.sum("n")).first()[0] or 0
    buckets = 1 << max(3, int(np.ceil(np.log2(max(1.0, 0.4 * volume / BUCKET_SIGS)))))
    scratch = Scratch(spark)
    runs = scratch.written(runs_of(body, buckets), "runs")
    extras = classes.groupBy("ref").agg(F.min("extra").alias("extra"))
    for _ in range(ROUNDS):
        runs = scratch.written(pruned(runs, extras), "runs-pruned")
    meets = scratch.written(meeting_points(runs, classes, scratch), "meets")
    wanted = scratch.written(classes.join(meets.select("ref").distinct(), "ref", "left_semi").select("cls", F.col("at.doc_id").alias("doc_id"), F.col("at.text_key").alias("text_key")), "candidates")
    size = min(MOST_BITS, max(LEAST_BITS, int(SLOTS * wanted.count()).bit_length()))
    shipped = spark.sparkContext.broadcast(slots_of(wanted, "text_key", size))

    def hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets of the texts that may be wanted; the others do not leave their task."""
        bits, low = shipped.value, np.int64((1 << size) - 1)
        for batch in batches:
            slot = batch.column(1).to_numpy() & low
            batch = batch.take(pa.array(np.flatnonzero((bits[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1)))
            texts = batch.column(2).to_pylist()
            for a, b in parts_of(texts):
                sets = shingle_sets(texts[a:b])
                ids = [class_of(s) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([c for _, c in ids], pa.binary()), pa.array([r for r, _ in ids], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "text_key", "cls", "ref", "n", "hashes"])

    found = keyed.mapInArrow(hash_sets, "doc_id long, text_key long, cls binary, ref long, n long, hashes binary").alias("d")
    same = (F.col("d.text_key") == F.col("w.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.cls") == F.col("w.cls"))
    sets = scratch.written(found.join(wanted.alias("w"), same, "left_semi").select("cls", "ref", "n", "hashes"), "shingle-sets")
    linked = components(links_between(meets, sets, scratch), scratch)
    scratch.drop()
    return rows, linked


def links_between(meets: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) of class ids: links that connect what meets at each hub, found cell by cell."""
    sizes = sets.groupBy("ref").agg(F.max("n").alias("n"))
    chunks_of = lambda members, volume: F.greatest(F.ceil(members / CHUNK_ROWS), F.ceil(volume * 8 / CHUNK_BYTES)).cast("int")
    dealt = lambda n: F.pmod(F.xxhash64("ref"), n).cast("int")
    room = meets.join(sizes, "ref").groupBy("hub").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("volume"))
    # Only hubs with more than one chunk are looked up; there is at most one for each CHUNK_ROWS members or CHUNK_BYTES.
    large = scratch.written(room.select("hub", "members", chunks_of(F.col("members"), F.col("volume")).alias("chunks")).filter("chunks > 1"), "hubs-large")
    cells = meets.join(large, "hub", "left").select("hub", "ref", F.when(F.col("chunks").isNull(), 0).otherwise(dealt(F.coalesce("chunks", F.lit(1)))).alias("i"), F.col("chunks").isNotNull().alias("several"))
    hubs = large.select("hub", F.col("hub").alias("ref"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), F.lit(True).alias("several"))
    filled = cells.unionByName(hubs).join(sets.select("ref", "cls", "hashes"), "ref").select("hub", "i", "several", "ref", "cls", "hashes")
    first = scratch.written(filled.groupBy("hub", "i").applyInArrow(compare_chunk, CELL), "links-chunks")
    links = first.filter("a <> b").select("a", "b")
    if not large.limit(1).count():
        return links
    # Who is not connected with the hub meets the other chunks; where that is most of them, chunks meet pair by pair.
    apart = first.filter("ref IS NOT NULL").select("hub", "ref").distinct()
    rest = apart.join(sizes, "ref").groupBy("hub").agg(F.count(F.lit(1)).alias("left"), F.sum("n").alias("volume"))
    plan = scratch.written(large.join(rest, "hub").select("hub", "chunks", chunks_of(F.col("left"), F.col("volume")).alias("turns"), (F.col("left") * 2 > F.col("members")).alias("most")), "hubs-apart")
    members, some = meets.join(plan, "hub"), apart.join(plan.filter("NOT most"), "hub")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = members.filter("NOT most").select("hub", "ref", dealt(F.col("chunks")).alias("i"), upto("turns").alias("j"), F.lit(False).alias("asks"))
    asking = some.select("hub", "ref", dealt(F.col("turns")).alias("j"), upto("chunks").alias("i"), F.lit(True).alias("asks"))
    both = members.filter("most").select("hub", "ref", dealt(F.col("chunks")).alias("own"), upto("chunks").alias("other")).filter("own <> other")
    pairs = both.select("hub", "ref", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") < F.col("other")).alias("asks"))
    cells = asked.unionByName(asking).unionByName(pairs).join(sets.select("ref", "cls", "hashes"), "ref").select("hub", "i", "j", "asks", "cls", "hashes")
    second = scratch.written(cells.groupBy("hub", "i", "j").applyInArrow(compare_cell, CELL), "links-cells")
    return links.unionByName(second.filter("a <> b").select("a", "b"))


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, root, component_id) of every row of docs."""
    rows, linked = link(docs)
    known = rows.join(linked.withColumnRenamed("v", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = known.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return known.join(least, "root", "left")


def assign(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) of every row of docs."""
    got = named(docs)
    return got.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the component's smallest doc_id; rows without shingles all stay."""
    own, wid, wkey, pick = unused(docs.columns, "__text", "__id", "__key", "__row")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    got = written(named(docs).filter("n > 0").groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows")), "components")
    keep = got.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), F.col("doc_id"), F.col("text_key"), F.col("rows"))).alias("at"))
    keep = written(keep.select(F.col("at.doc_id").alias(wid), F.col("at.text_key").alias(wkey), F.col("at.rows").alias("rows")), "survivors")
    worded = F.coalesce(F.regexp_replace("text", SPACE_CLASS + "+", "") != "", F.lit(False))
    keyed = docs.filter(worded).withColumn(own, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))

    def rows_of(some: DataFrame) -> DataFrame:
        return keyed.join(some, (keyed[own] == some[wkey]) & keyed["doc_id"].cast("long").eqNullSafe(some[wid]), "left_semi")

    plain = rows_of(keep.filter("rows = 1").select(wid, wkey)).select(*columns)
    again = rows_of(keep.filter("rows > 1").select(wid, wkey)).groupBy("doc_id", own).agg(F.min_by(F.struct(*columns), row_order(docs)).alias(pick))
    one = again.select(*[F.col(pick)[c].alias(c) for c in docs.columns])
    return docs.filter(~worded).union(plain).union(one)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op4_ngram_jaccard": op4_ngram_jaccard}
ORACLES = {
    "op4_ngram_jaccard": f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_CLASS}') AS words FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {SHINGLE} THEN [array_to_string(words, ' ')]
            ELSE list_distinct([array_to_string(words[i:i + {SHINGLE - 1}], ' ') FOR i IN range(1, len(words) - {SHINGLE - 2})]) END AS shingles FROM w),
    t AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
    f AS (SELECT shingle FROM t GROUP BY shingle HAVING count(*) > 1),
    c AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS common
          FROM (SELECT t.* FROM t SEMI JOIN f USING (shingle)) a JOIN (SELECT t.* FROM t SEMI JOIN f USING (shingle)) b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    e AS (SELECT x, y FROM c WHERE 100 * common >= {PERCENT} * (nx + ny - common)),
    r AS (SELECT doc_id AS v, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON r.v = e.x)
    SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, m.component_id
    FROM s JOIN (SELECT v, min(root) AS component_id FROM r GROUP BY v) m ON m.v = s.doc_id
    """
}
