"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets, and its connected components.

Documents with equal sets form a class, and one set of each class is joined. Two sets of n and m
shingles are linked exactly if they share at least need(n, m) of them.

1. Which shingles can count. Documents are dealt to chunks, and each chunk sends its distinct shingles,
   packed and sorted, to buckets of the hash space. A bucket answers with the level of each: 0 if one
   class alone has it, else the logarithm of the number of its holders. A set whose shared shingles are
   fewer than it must share with any partner has no link and goes no further.
2. The shingles of a set are ordered by level (rare ones first) and hash. Linked sets have a common
   shingle among the first n - least_overlap(n) + 1 of each; those of them that another class has are
   the part that is joined, and their number is the size by which a set is light or heavy.
3. Light sets: every link of different sets shares at least subset_size shingles (three at 75 %), and the
   first three common ones lie among the joined part and the two shingles after it. All subsets of that
   fixed size are enumerated, and light sets meet in the list of a subset.
4. Heavy sets meet each other and light ones in inverted lists, one for each shingle of the joined part.
   The boundary is the size at which the cost over all sets is least: of light ones the rows of their
   subsets, of heavy ones the rows of their entries and the entries that they are scanned against.
5. A list is scanned from its most central set, which is compared with all others. In a list that still
   holds several components, its rest is then compared with PROBES members of its largest component,
   again and again while that joins components; at last with all entries of other components. Sizes and
   positions in the order tell which entries can't be linked; the others are verified on whole sets.

Links inside a component that are already implied are not looked for: a component is what is returned.
Nothing is capped; lists are never gathered into a task, and hot ones are split by adaptive execution.

Shingles are 64-bit hashes and classes 128-bit hashes of the whole set. That one class alone has a shingle
is told by 64 bits of the class: a link is lost only if two near classes agree in these (1 in 1.8e19).
Chunks send a message to each bucket that their shingles fall into: never more messages than shingles.
"""

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import arrow_map, materialise
from lodeseek.llm.wordhash import mix, word_hashes
from lodeseek.session import Scratch, ship_package

WORDS = 5
PERCENT = 75
#: Bytes of text for each chunk and for each bucket of the first step; their work fits in a worker's memory.
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 12 << 20
#: What a row costs that is hashed and shuffled (a subset, or an entry of a list), in comparisons of entries.
ROW_COST = 16
#: Members of the largest component of a list that a round compares with the rest of the list.
PROBES = 4
#: Rounds go on while each joins at least this share of the components that it looked at.
WORTH = 0.02
#: Sizes of one band differ by this factor at most.
BAND = 1.08
#: Rows of subsets in a batch.
BATCH_ROWS = 1 << 17
#: In packed shingles, numbers below this count holders of several classes; from here on they name one class.
_COUNTS = 1 << 16


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text, sorted: of `words` words each, or the whole of a shorter text."""
    h = word_hashes((text or "").encode().lower())
    k = min(words, len(h))
    if not k:
        return np.zeros(0, np.uint64)
    key = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(key)])
    return np.unique(key)


def least_overlap(n: int, percent: int) -> int:
    """What a set of n must share with any partner at least."""
    return -(-percent * n // 100)


def need(n, m, percent: int):
    """What sets of n and m must share to be linked: 100 * i >= percent * (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def _class(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _name(cls: bytes) -> int:
    """A class's name in packed shingles: 64 bits of it, folded over the numbers that are no counts."""
    return _COUNTS + int.from_bytes(cls[:8], "little") % ((1 << 64) - _COUNTS)


def _pack(low: np.ndarray, names: np.ndarray) -> bytes:
    """Shingles and their names; a name is written once and its number with each shingle."""
    known, number = np.unique(names, return_inverse=True)
    number = number.astype(np.uint16 if len(known) <= 1 << 16 else np.uint32)
    return np.array([len(low), len(known)], np.uint32).tobytes() + known.tobytes() + low.tobytes() + number.tobytes()


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, count = (int(x) for x in np.frombuffer(packed, np.uint32, 2))
    known = np.frombuffer(packed, np.uint64, count, 8)
    low = np.frombuffer(packed, np.uint32, size, 8 + 8 * count)
    number = np.frombuffer(packed, np.uint16 if count <= 1 << 16 else np.uint32, size, 8 + 8 * count + 4 * size)
    return low, known[number]


class _Chunk:
    """The sets of a chunk's documents and their distinct shingles, the same for the same rows in any order."""

    def __init__(self, texts: pa.ChunkedArray, buckets: int, words: int):
        self.sets = [shingles(t.as_py(), words) for t in texts]
        self.classes = [_class(s) if len(s) else None for s in self.sets]
        sizes = [len(s) for s in self.sets]
        flat = np.concatenate([*self.sets, np.zeros(0, np.uint64)])
        names = np.array([_name(c) if c else 0 for c in self.classes], np.uint64)
        order = np.argsort(flat, kind="stable")
        ordered, names = flat[order], np.repeat(names, sizes)[order]
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
        self.distinct = ordered[starts]
        if len(starts):
            low, high = np.minimum.reduceat(names, starts), np.maximum.reduceat(names, starts)
            counts = np.diff(np.append(starts, len(ordered)))
            self.names = np.where(low == high, low, np.minimum(counts, _COUNTS - 1).astype(np.uint64))
        else:
            self.names = np.zeros(0, np.uint64)
        bucket = ((self.distinct >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        self.edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


def _levels(low: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each packed shingle: 0 if one class alone has it, else a level that grows with its holders."""
    order = np.argsort(low, kind="stable")
    ordered, n = low[order], names[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    least, most = np.minimum.reduceat(n, starts), np.maximum.reduceat(n, starts)
    held = np.add.reduceat(np.where(n < _COUNTS, n, np.uint64(1)).astype(np.int64), starts)
    level = np.where((least == most) & (least >= _COUNTS), 0, np.clip(4 * np.log2(np.maximum(held, 2)), 1, 255)).astype(np.uint8)
    out = np.empty(len(low), np.uint8)
    out[order] = np.repeat(level, np.diff(np.append(starts, len(low))))
    return out


def row_mark(id_: Column, text: Column) -> Column:
    """A hash of id and text that tells the row that stays of each component."""
    return F.xxhash64(id_, text)


def _sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """One row per document: id, mark (hash of id and text), n, cls, own (shingles no other class has), shared (binary; null if no link is possible)."""
    spark = docs.sparkSession
    ship_package(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = max(1, -(-size // CHUNK_BYTES)), max(1, -(-size // BUCKET_BYTES))
    # The partition takes part, so that repeated rows of one id are dealt to several chunks too.
    rows = docs.select("id", "text", F.pmod(F.xxhash64("id", "text", F.spark_partition_id()), F.lit(chunks)).alias("chunk"), row_mark(F.col("id"), F.col("text")).alias("mark"))
    kind = rows.schema["id"].dataType.simpleString()

    def send(table: pa.Table) -> pa.Table:
        chunk = _Chunk(table.column("text"), buckets, words)
        spans = [(k, a, b) for k, (a, b) in enumerate(itertools.pairwise(chunk.edges)) if b > a]
        low = chunk.distinct.astype(np.uint32)
        return pa.table(
            {
                "chunk": pa.array([table.column("chunk")[0].as_py()] * len(spans), pa.int64()),
                "bucket": pa.array([k for k, _, _ in spans], pa.int64()),
                "packed": pa.array([_pack(low[a:b], chunk.names[a:b]) for _, a, b in spans], pa.binary()),
            }
        )

    def answer(table: pa.Table) -> pa.Table:
        parts = [_unpack(x.as_py()) for x in table.column("packed")]
        levels = _levels(np.concatenate([low for low, _ in parts]), np.concatenate([names for _, names in parts]))
        marks = np.cumsum([0, *(len(low) for low, _ in parts)])
        return pa.table(
            {
                "chunk": table.column("chunk"),
                "bucket": table.column("bucket"),
                "levels": pa.array([levels[a:b].tobytes() for a, b in itertools.pairwise(marks)], pa.binary()),
            }
        )

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = _Chunk(left.column("text"), buckets, words)
        parts = sorted(zip(right.column("bucket").to_pylist(), right.column("levels").to_pylist(), strict=True))
        levels = np.frombuffer(b"".join(x for _, x in parts), np.uint8)
        if len(levels) != len(chunk.distinct):
            raise RuntimeError("the rows of a chunk differ from those that it sent: the input has to be the same when it is read again")
        out: dict[str, list] = {"n": [], "cls": [], "own": [], "shared": []}
        for tokens, cls in zip(chunk.sets, chunk.classes, strict=True):
            at = levels[np.searchsorted(chunk.distinct, tokens)]
            kept = np.flatnonzero(at)
            n = len(tokens)
            possible = n and len(kept) >= least_overlap(n, percent)
            order = kept[np.argsort(at[kept], kind="stable")]
            for k, v in (("n", n), ("cls", cls), ("own", n - len(kept)), ("shared", tokens[order].tobytes() if possible else None)):
                out[k].append(v)
        kinds = {"n": pa.int64(), "cls": pa.binary(), "own": pa.int64(), "shared": pa.binary()}
        return pa.table({"id": left.column("id"), "mark": left.column("mark")} | {k: pa.array(v, kinds[k]) for k, v in out.items()})

    sent = rows.groupBy("chunk").applyInArrow(send, "chunk long, bucket long, packed binary")
    answers = sent.groupBy("bucket").applyInArrow(answer, "chunk long, bucket long, levels binary")
    out = rows.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return out.applyInArrow(judge, f"id {kind}, mark long, n long, cls binary, own long, shared binary")


def subset_size(percent: int) -> int:
    """What two different sets share at least if they are linked: a set of so many in one of one more."""
    return max(1, -(-percent // (100 - percent))) if percent < 100 else 1


def _joined(n, own, percent: int):
    """The size of the part of a set that is joined."""
    return n - least_overlap(n, percent) + 1 - own


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """key (a shingle), cls, n, own, size, at (position in the whole order): the joined part of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, at, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for n, own, shared in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                first = np.frombuffer(shared, np.int64)[: max(0, _joined(n, own, percent))]
                tokens.append(first)
                at.append(np.arange(own, own + len(first), dtype=np.int64))
                times.append(len(first))
            pick = pa.array(np.repeat(np.arange(len(times)), times))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens)), *(batch.column(k).take(pick) for k in (0, 1, 2)), pa.array(np.repeat(times, times).astype(np.int64)), pa.array(np.concatenate(at))],
                names=["key", "cls", "n", "own", "size", "at"],
            )

    return arrow_map(sets.select("cls", "n", "own", "shared"), run, "key long, cls binary, n long, own long, size long, at long")


def _subsets(light: DataFrame, percent: int) -> DataFrame:
    """The same columns for light sets; a key is the hash of a subset, and at is such that n - at bounds what is shared."""
    many = subset_size(percent)
    picks: dict[int, np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            rows = 0

            def flush() -> pa.RecordBatch:
                pick = pa.array(np.repeat([k for k, *_ in held], [len(key) for _, key, *_ in held]))
                key, at, size = (np.concatenate([x[j] for x in held] + [np.zeros(0, np.int64)]) for j in (1, 2, 3))
                cols = [pa.array(key), *(batch.column(k).take(pick) for k in range(3)), pa.array(size), pa.array(at)]
                return pa.RecordBatch.from_arrays(cols, names=["key", "cls", "n", "own", "size", "at"])

            for k, (n, own, shared) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                size = _joined(n, own, percent)
                tokens = np.frombuffer(shared, np.uint64)[: size + many - 1]
                length = len(tokens)
                if length < many:
                    continue
                if length not in picks:
                    picks[length] = np.array(list(itertools.combinations(range(length), many)), np.int64)
                key = np.full(len(picks[length]), many, np.uint64)
                for j in range(many):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + tokens[picks[length][:, j]])
                at = own + picks[length][:, -1] - (many - 1)
                held.append((k, key.view(np.int64), at, np.full(len(key), size)))
                rows += len(key)
                if rows >= BATCH_ROWS:
                    yield flush()
                    held.clear()
                    rows = 0
            yield flush()

    return arrow_map(light.select("cls", "n", "own", "shared"), run, "key long, cls binary, n long, own long, size long, at long")


def _boundary(lists: DataFrame, percent: int) -> int:
    """The size up to which sets are light: where subsets enumerated and entries scanned cost least in all.

    Sizes from 64 on are taken by powers of two; a row for each of them comes to the driver.
    """
    step = F.when(F.col("size") < 64, F.col("size")).otherwise(F.expr("shiftleft(1L, CAST(floor(log2(size)) AS INT))"))
    per_set = lists.groupBy("cls", "size").agg(F.sum(F.col("held") + ROW_COST).alias("scan"))
    by_size = per_set.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("sets"), F.sum("scan").alias("scan")).orderBy("step").collect()
    many = subset_size(percent)
    least = cost = sum(r["scan"] for r in by_size)
    best = 0
    for r in by_size:
        top = r["step"] if r["step"] < 64 else 2 * r["step"] - 1
        cost += ROW_COST * r["sets"] * math.comb(top + many - 1, many) - r["scan"]
        if cost < least:
            least, best = cost, top
    return best


def _can_link(percent: int) -> str:
    """SQL for rows p and q of one list: sizes and positions allow a link, and light sets meet in lists of subsets only."""
    least = f"(({percent} * (p.n + q.n) + {99 + percent}) div {100 + percent})"
    return (
        f"(p.subset OR NOT (p.light AND q.light)) AND {percent} * greatest(p.n, q.n) <= 100 * least(p.n, q.n) "
        f"AND least(p.n - p.at, q.n - q.at) >= {least}"
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b, subset that are linked, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for n, m, x, y in zip(*(batch.column(k).to_pylist() for k in range(3, 7)), strict=True):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                linked.append(100 * both >= percent * (n + m - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:3], names=["a", "b", "subset"]).filter(pa.array(linked, pa.bool_()))

    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("n1"), F.col("shared").alias("s1"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("n2"), F.col("shared").alias("s2"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "subset", "n1", "n2", "s1", "s2")
    return arrow_map(both, run, "a binary, b binary, subset boolean")


def components(edges: DataFrame, write) -> DataFrame:
    """node and root (the smallest node of its component) for the nodes of edges a, b.

    Each round takes the least label among the neighbours and then that label's own label. Rounds are
    written as tables; whether any label has changed is all that comes to the driver.
    """
    both = write(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "op9-edges")
    labels = write(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "op9-labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "near").alias("better"))
        step = write(step, "op9-step")
        jump = step.select(F.col("node").alias("j"), F.col("better").alias("jumped"))
        after = step.join(jump, F.col("better") == F.col("j")).select("node", F.col("root").alias("old"), F.col("jumped").alias("root"))
        after = write(after, "op9-labels")
        if after.where("old <> root").isEmpty():
            return after.select("node", "root")
        labels = after.select("node", "root")


_LIST = ["key", "subset"]
_ENTRY = [*_LIST, "cls", "n", "own", "at", "light"]
_PAIR = ["least(p.cls, q.cls) AS a", "greatest(p.cls, q.cls) AS b", "p.subset AS subset"]


class _Join:
    """Lists of the sets of classes, and the links between classes: a, b and subset (found in a list of subsets)."""

    def __init__(self, sets: DataFrame, percent: int, write):
        self.sets, self.percent = sets, percent
        # No table has more rows than the sets have shingles, but for those of subsets, whose cost is bounded by that.
        most = sets.agg(F.sum("n")).first()[0] or 0
        self.write = lambda df, name: write(df, name, most)
        self.can, self.links = _can_link(percent), []

    def _several(self, rows: DataFrame) -> DataFrame:
        """The keys that more than one row has. Written first, so that a join with a hot key can be split."""
        return self.write(rows.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "op9-lengths")

    def entries(self) -> DataFrame:
        """Entries of all lists that can give a link: of shingles (with a heavy set), and of subsets of light sets."""
        posted = self.write(_postings(self.sets, self.percent), "op9-postings")
        lists = self.write(posted.join(self._several(posted), "key"), "op9-lists")
        self.boundary = _boundary(lists, self.percent)
        entries = lists.withColumns({"subset": F.lit(False), "light": F.col("size") <= self.boundary}).select(*_ENTRY)
        if not self.boundary:
            return entries
        mixed = entries.groupBy("key").agg(F.bool_and("light").alias("all_light")).where("NOT all_light").select("key")
        entries = entries.join(self.write(mixed, "op9-mixed"), "key")
        p = self.percent
        small = self.sets.where(f"n - ({p} * n + 99) div 100 + 1 - own <= {self.boundary}")
        subsets = self.write(_subsets(small, p), "op9-subsets")
        met = subsets.join(self._several(subsets), "key").withColumns({"subset": F.lit(True), "light": F.lit(True)})
        return self.write(entries.select(*_ENTRY).unionByName(met.select(*_ENTRY)), "op9-entries")

    def link(self, pairs: DataFrame) -> DataFrame:
        """Verifies pairs a, b, subset and keeps the links."""
        pairs = pairs.groupBy("a", "b").agg(F.bool_or("subset").alias("subset"))
        found = self.write(_verified(pairs, self.sets, self.percent), "op9-links")
        self.links.append(found)
        return found

    def _merge_classes(self, found: DataFrame) -> DataFrame:
        return components(found, self.write)

    def _merge(self, found: DataFrame) -> DataFrame:
        """node and root of the components that links have joined."""
        a, b = (self.labels.select(F.col("cls").alias(c), F.col("root").alias("r" + c)) for c in "ab")
        return components(found.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")), self.write)

    def _relabel(self, rows: DataFrame, merged: DataFrame, name: str) -> DataFrame:
        kept = [c for c in rows.columns if c not in ("root", "main")]
        rows = rows.withColumnRenamed("root", "old").join(merged, F.col("old") == F.col("node"), "left")
        return self.write(rows.select(*kept, F.coalesce("root", "old").alias("root")), name)

    def _open(self, rows: DataFrame, round_: int) -> DataFrame:
        """Entries that are not in the largest component of their list, with its root (main) and PROBES of its members, chosen by a hash."""
        member = lambda k: F.min(F.struct(F.xxhash64("cls", "key", F.lit(round_ * PROBES + k)).alias("draw"), "cls", "n", "at", "light"))
        by_root = rows.groupBy(*_LIST, "root").agg(F.count(F.lit(1)).alias("held"), F.array(*[member(k) for k in range(PROBES)]).alias("probes"))
        lists = by_root.groupBy(*_LIST).agg(F.max(F.struct("held", "root", "probes")).alias("m"), F.count(F.lit(1)).alias("several")).where("several > 1")
        lists = self.write(lists.select(*_LIST, F.col("m.root").alias("main"), F.col("m.probes").alias("probes")), "op9-main")
        return self.write(rows.join(lists, _LIST).where("root <> main"), "op9-open")

    def _probed(self, few: DataFrame) -> DataFrame:
        """Pairs of the rest of each list with the probes of its main component."""
        probes = F.array_distinct(F.transform("probes", lambda x: x.dropFields("draw")))
        met = few.select(F.struct(*_ENTRY).alias("p"), F.explode(probes).alias("q"))
        return met.where(self.can).selectExpr(*_PAIR)

    def _remaining(self, rows: DataFrame, few: DataFrame) -> DataFrame:
        """All pairs of entries of one list that are in different components and can be linked, by bands of sizes."""
        p = self.percent
        band = lambda n: F.floor(F.log(n) / math.log(BAND)).cast("int")
        most = F.least(F.col("n") * 100 / p, (F.col("n") - F.col("at")) * (100 + p) / p - F.col("n"))
        most = F.greatest(most, F.col("n") * p / 100)
        reach = F.sequence(band(F.col("n") * p / 100) - 1, band(most) + 1)
        few = few.drop("probes").withColumn("band", F.explode(reach))
        rows = rows.withColumn("band", band(F.col("n")))
        once = "p.root <> q.root AND (q.root = p.main OR p.cls < q.cls)"
        return few.alias("p").join(rows.alias("q"), [*_LIST, "band"]).where(f"{once} AND {self.can}").selectExpr(*_PAIR)

    def run(self) -> DataFrame:
        """cls and root for all classes of the sets; self.links has the links that were looked at."""
        entries = self.entries()
        # A heavy centre first: in a list of shingles, light sets are not compared with one another.
        hub = F.min(F.struct("light", (F.col("own") / F.col("n")).alias("share"), "cls", "n", "at")).alias("h")
        hubs = self.write(entries.groupBy(*_LIST).agg(hub).select(*_LIST, "h.*"), "op9-hubs")
        found = self.link(entries.alias("p").join(hubs.alias("q"), _LIST).where(f"p.cls <> q.cls AND {self.can}").selectExpr(*_PAIR))
        merged = self._merge_classes(found)
        self.labels = self._relabel(self.sets.select("cls", F.col("cls").alias("root")), merged, "op9-labelled")
        rows = self._relabel(entries.withColumn("root", F.col("cls")), merged, "op9-rooted")
        for round_ in itertools.count():
            few = self._open(rows, round_)
            looked = few.select("root").distinct().count()
            if not looked:
                return self.labels
            merged = self._merge(self.link(self._probed(few)))
            joined = merged.where("node <> root").count()
            if joined < WORTH * looked:
                break
            self.labels = self._relabel(self.labels, merged, "op9-labelled")
            rows = self._relabel(rows, merged, "op9-rooted")
        # What the last round has joined is looked at once more: links that are implied already do no harm.
        found = self.link(self._remaining(rows, few))
        both = self.links[-2].unionByName(found)
        self.labels = self._relabel(self.labels, self._merge(both), "op9-labelled")
        return self.labels


def _candidates(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, write) -> tuple[DataFrame, DataFrame]:
    """One row per document, and one set of each class that can have a link."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    every = write(_sets(rows, words, percent), "op9-docs")
    # One set of each class; equal sets have equal bytes, whichever comes first.
    sets = every.where("shared IS NOT NULL").groupBy("cls").agg(*(F.max(c).alias(c) for c in ("n", "own", "shared")))
    return every, write(sets, "op9-sets")


def ngram_jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The links between different sets that the join has found and verified: a, b (classes, as binary) and side.

    side is "subsets" for light sets that met in a list of subsets, else "lists". They connect all documents
    that are linked, but links that others imply are not looked for. Nulls and empty texts as in
    ngram_jaccard_join; no documents or no links give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    join = _Join(_candidates(docs, id_col, text_col, words, percent, scratch.write)[1], percent, scratch.write)
    join.run()
    links = join.links[0]
    for more in join.links[1:]:
        links = links.unionByName(more)
    links = materialise(links.groupBy("a", "b").agg(F.bool_or("subset").alias("subset")), "op9-all-links")
    scratch.clear()
    return links.select("a", "b", F.when(F.col("subset"), "subsets").otherwise("lists").alias("side"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Links documents whose shingle sets have a Jaccard similarity of percent / 100 or more.

    Returns one row per input row: id, n_shingles (size of its set), component_id (the smallest id
    reachable by links, itself included) and stays (true for one id and text of each component, that of
    the smallest id; repeated rows of it all have true). Only A-Z are lower-cased. A null text counts as
    empty; a text without words has an empty set and is linked with nothing, not even with its like. Texts
    with equal sets are linked, repeated rows too. Null ids are passed over for component_id, unless a
    component has no others. No input rows give no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    every, sets = _candidates(docs, id_col, text_col, words, percent, scratch.write)
    roots = _Join(sets, percent, scratch.write).run()
    # The smallest id that is not null, and of several texts of that id the one that is first by mark.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("least")
    classes = every.where("cls IS NOT NULL").groupBy("cls").agg(first)
    placed = classes.join(roots, "cls", "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    placed = scratch.write(placed, "op9-classes")
    # Written first: the join can then be split where a component has very many classes.
    firsts = scratch.write(placed.groupBy("root").agg(F.min("least").alias("least_of_all")), "op9-firsts")
    final = placed.join(firsts, "root")
    final = scratch.write(final.select("cls", F.col("least_of_all.id").alias("component"), F.col("least_of_all.mark").alias("least_mark")), "op9-components")
    scratch.clear(every, final)
    chosen = F.col("id").eqNullSafe(F.col("component")) & (F.col("mark") == F.col("least_mark"))
    return every.join(final, "cls", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"),
        (F.col("cls").isNull() | chosen).alias("stays"), "mark",
    )
