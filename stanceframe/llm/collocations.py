"""Phrase collocations from mergeable Misra-Gries summaries, counted exactly in a second pass (operator 12).

Words and pieces: A-Z in lower case, pieces between ``. , ; : ! ?`` and line breaks, words between spaces and
tabs.  Every count is per group (``lang``; null is ``und``).

1. Summaries.  The runs of words are hashed with their group to 64 bits; the upper bits name one of ``parts``
   hash partitions.  A task adds up what it has seen and sends each partition's share; the reader of a
   partition merges the shares into one Misra-Gries summary.  Its capacity is the partition's whole mass divided by
   the threshold, plus one, so what it takes off any count stays below the threshold: every run that is frequent
   stays, whatever arrives in which order.  Counts plus all that was taken off decide who survives.
   Longer runs are looked for only where all their shorter runs survived, round by round (``ROUNDS``).
2. The survivors of a round reach the tasks as a bit table of bounded size (``MAX_BITS``), one segment per
   partition.  Two runs that share a bit or a hash only let a rare run through.
3. Exact counts.  A second pass counts, by their words themselves, all runs that pass the bit tables, and keeps
   those at or above the threshold.

Defined results: null and empty texts have no words; null groups count as ``und``; repeated rows count each time; an
empty table gives no rows; other columns are not read.  A text is never cut; a task holds one block of texts of
``BLOCK_CHARS`` (one text at least) and ``FLUSH`` hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stanceframe.llm.common import batches_of, small_batches, stored
from stanceframe.llm.shingles import Codes, mix

#: Lengths looked for together; a round needs the survivors of the rounds before it.
ROUNDS = ((1,), (2,), (3, 4, 5))
#: Hashes that a task gathers before it sends them on, and hashes in one sent row.
FLUSH, ROW = 1 << 21, 1024
#: Runs that a task adds up in the exact pass before it sends them on.
KEPT = 200_000
#: Counters that a summary is meant to hold, for the number of partitions (the capacity itself follows the mass).
COUNTERS = 1 << 20
#: Bits of a round's table of survivors: at least, at most (32 MB).
MIN_BITS, MAX_BITS = 1 << 20, 1 << 28
BLOCK_CHARS = 4_000_000
#: Salts that spread a common part of phrases, and a group's ranking, over tasks.
SALTS = 16
_U = np.uint64
_STEP = _U(0xD1342543DE82EF95)
_CLEAN = bytes(32 if b == 9 else 10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass(frozen=True)
class Plan:
    """least: occurrences of a phrase; words: its longest length; top: phrases per group; absorb: percent of a phrase's
    occurrences that a longer one must have to take its place."""
    least: int = 100
    words: int = 5
    top: int = 2000
    absorb: int = 100


class Words:
    """The words of a block of texts: exact ids, hashes, and how many words of the piece stand from each word on."""

    def __init__(self, texts: list[str | None], groups: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join(raw).translate(_CLEAN) + b"\n", np.uint8)
        first = np.cumsum([0, *(len(r) + 1 for r in raw)])[:-1]  # each text's first byte
        inside = (data != 32) & (data != 10)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside])))
        start, end = edge[::2], edge[1::2]
        self.words = Codes(data[inside], end - start)
        self.word = self.words.code
        names = pa.array([g if g is not None else "und" for g in groups], pa.string()).dictionary_encode()
        self.groups: list[str] = names.dictionary.to_pylist()
        owner = np.searchsorted(first, start, "right") - 1
        self.group = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[owner]
        piece = np.searchsorted(np.flatnonzero(data == 10), start)
        n = len(start)
        new = np.flatnonzero(np.diff(piece, prepend=-1)) if n else np.zeros(0, np.int64)
        ends = np.append(new[1:], n)
        self.room = np.repeat(ends, ends - new) - np.arange(n) if n else np.zeros(0, np.int64)
        word_hash = self.words.hashes(1)
        group_hash = np.array([xxhash.xxh3_64_intdigest(g.encode(), 2) for g in self.groups], np.uint64)
        self.hash = mix(word_hash[self.word] + group_hash[self.group]) if n else np.zeros(0, np.uint64)

    def __len__(self):
        return len(self.word)


def _known(table: tuple[np.ndarray, int], hashes: np.ndarray) -> np.ndarray:
    bits, log = table
    at = hashes >> _U(64 - log)
    return (bits[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1


def _level_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """What is looked up and sent for runs of n words: lengths must not meet each other."""
    return mix(hashes + _U(n))


def runs(w: Words, tables: list[tuple[np.ndarray, int]], upto: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, hashes) of the runs of 1, 2, ... ``upto`` words whose shorter runs, and they themselves as far as
    ``tables`` (one per finished round) says, survive; places ascending."""
    known = {n: tables[k] for k, ns in enumerate(ROUNDS) if k < len(tables) for n in ns}
    at = np.arange(len(w))
    h = w.hash
    for n in range(1, upto + 1):
        if n > 1:
            alive = np.zeros(len(w) + 1, bool)
            alive[at] = True
            ok = (w.room[at] >= n) & alive[at + 1]  # the run without its last word, and without its first
            at, h = at[ok], h[ok]
            h = mix(h * _STEP + w.hash[at + n - 1])
        sent = _level_hash(h, n)
        if n in known:
            ok = _known(known[n], sent)
            at, h, sent = at[ok], h[ok], sent[ok]
        yield n, at, sent


def _blocks(batches) -> Iterator[Words]:
    for batch in batches:
        texts, groups = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = [t or "" for t in texts]
        for lo, hi in batches_of(texts, BLOCK_CHARS):
            yield Words(texts[lo:hi], groups[lo:hi])


def _add(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts of equal hashes, ascending."""
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


SENT = "part int, mass bigint, hashes binary, counts binary"


def _send(round_: int, tables, log_parts: int, words: int):
    """mapInArrow: texts -> each partition's share of this task's runs of the round's lengths."""
    def rows(held: list) -> Iterator[pa.RecordBatch]:
        h, c = _add(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        cut = np.searchsorted(h, np.arange(1, 1 << log_parts, dtype=np.uint64) << _U(64 - log_parts))
        edges = np.concatenate([[0], cut, [len(h)]])
        out = [(p, lo, min(lo + ROW, edges[p + 1])) for p in np.flatnonzero(np.diff(edges)) for lo in range(edges[p], edges[p + 1], ROW)]
        for k in range(0, len(out), 256):
            part = out[k:k + 256]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(p) for p, _, _ in part], pa.int32()), pa.array([int(c[lo:hi].sum()) for _, lo, hi in part], pa.int64()),
                 pa.array([h[lo:hi].tobytes() for _, lo, hi in part], pa.binary()), pa.array([c[lo:hi].astype("<u4").tobytes() for _, lo, hi in part], pa.binary())],
                names=["part", "mass", "hashes", "counts"])

    def run(batches):
        known = [(t[0].value, t[1]) for t in tables]
        held, size, mass = [], 0, 0
        for w in _blocks(batches):
            for n, _, sent in runs(w, known, min(max(ROUNDS[round_]), words)):
                if n in ROUNDS[round_]:
                    held.append(np.unique(sent, return_counts=True))
                    size, mass = size + len(held[-1][0]), mass + len(sent)
            if size > FLUSH or mass > 2**31:
                held = [_add(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))]
                size = len(held[0][0])
                if size > FLUSH // 2 or mass > 2**31:
                    yield from rows(held)
                    held, size, mass = [], 0, 0
        if size:
            yield from rows(held)
    return run


class Summary:
    """Misra-Gries summary of hashes: at most ``capacity`` counters; ``off`` bounds what any count lacks."""

    def __init__(self, capacity: int):
        self.capacity, self.off = capacity, 0
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting, self.size = [], 0

    def merge(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((hashes, counts))
        self.size += len(hashes)
        if self.size > max(self.capacity // 4, 1 << 16):
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        self.hashes, self.counts = _add(np.concatenate([self.hashes, *(x[0] for x in self.waiting)]),
                                        np.concatenate([self.counts, *(x[1] for x in self.waiting)]))
        self.waiting, self.size = [], 0
        if len(self.hashes) > self.capacity:
            # the count at place capacity + 1 comes off all; each unit takes capacity + 1 units of mass with it
            off = int(-np.partition(-self.counts, self.capacity)[self.capacity])
            self.off += off
            keep = self.counts > off
            self.hashes, self.counts = self.hashes[keep], self.counts[keep] - off

    def survivors(self, least: int) -> np.ndarray:
        self.settle()
        return self.hashes[self.counts + self.off >= least]


def _summarise(least: int, log_parts: int, log_bits: int):
    """mapInArrow over shares sorted by partition, each row with its partition's whole mass: segments of the bit table."""
    width = 1 << (log_bits - log_parts)

    def segment(part: int, s: Summary) -> pa.RecordBatch:
        found = s.survivors(least)
        bits = np.zeros(width, np.uint8)
        bits[((found >> _U(64 - log_bits)).astype(np.int64)) & (width - 1)] = 1
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(found)], pa.int64()), pa.array([s.off], pa.int64()),
                                           pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["part", "found", "off", "bits"])

    def run(batches):
        part, s = None, None
        for batch in small_batches(batches, 256):
            for p, total, h, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if p != part:
                    if s is not None:
                        yield segment(part, s)
                    part, s = p, Summary(total // least + 1)
                s.merge(np.frombuffer(h, "<u8"), np.frombuffer(c, "<u4").astype(np.int64))
        if s is not None:
            yield segment(part, s)
    return run


COUNTED = "part int, grps array<string>, ns array<int>, phrases array<string>, counts array<bigint>"


def _count(tables, words: int, log_parts: int):
    """mapInArrow: texts -> by hash partition, packed: (group, n, phrase, count) of the runs that pass the tables; n = 0
    counts a group's words.  A task adds up by the words themselves and sends what it has when ``KEPT`` are together."""
    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        part = [xxhash.xxh3_64_intdigest(b"\0".join((g.encode(), ph)), 3) >> (64 - log_parts) for g, _, ph in held]
        order = np.argsort(np.array(part, np.int64), kind="stable")
        keys, counts = list(held), list(held.values())
        part = np.array(part, np.int64)[order]
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        out = [(int(part[a]), order[lo:min(lo + ROW, b)].tolist()) for a, b in zip(cut[:-1], cut[1:], strict=True) for lo in range(a, b, ROW)]
        for k in range(0, len(out), 64):
            some = out[k:k + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in some], pa.int32()), pa.array([[keys[i][0] for i in at] for _, at in some], pa.list_(pa.string())),
                 pa.array([[keys[i][1] for i in at] for _, at in some], pa.list_(pa.int32())),
                 pa.array([[keys[i][2].decode() for i in at] for _, at in some], pa.list_(pa.string())),
                 pa.array([[counts[i] for i in at] for _, at in some], pa.list_(pa.int64()))], names=["part", "grps", "ns", "phrases", "counts"])

    def run(batches):
        known = [(t[0].value, t[1]) for t in tables]
        held: dict[tuple[str, int, bytes], int] = {}
        for w in _blocks(batches):
            if not len(w):
                continue
            totals = np.bincount(w.group, minlength=len(w.groups))
            for g in np.flatnonzero(totals).tolist():
                held[w.groups[g], 0, b""] = held.get((w.groups[g], 0, b""), 0) + int(totals[g])
            before = w.group.copy()  # exact number of the run without its last word; at first, of its group
            for n, at, _ in runs(w, known, words):
                pairs = before[at] * w.words.count + w.word[at + n - 1]
                _, where, number, counts = np.unique(pairs, return_index=True, return_inverse=True, return_counts=True)
                for p, c in zip(at[where].tolist(), counts.tolist(), strict=True):
                    key = (w.groups[w.group[p]], n, b" ".join([w.words[k] for k in w.word[p:p + n].tolist()]))
                    held[key] = held.get(key, 0) + c
                before = np.full(len(w), -1, np.int64)
                before[at] = number
            if len(held) > KEPT:
                yield from rows(held)
                held = {}
        if held:
            yield from rows(held)
    return run


def _total(least: int):
    """mapInArrow over packed counts sorted by partition: (grp, n, phrase, c) of a partition's runs at or above the threshold."""
    def frequent(held: dict) -> Iterator[pa.RecordBatch]:
        out = [(*k, c) for k, c in held.items() if k[1] == 0 or c >= least]
        for k in range(0, len(out), 10_000):
            g, n, ph, c = zip(*out[k:k + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(n, pa.int32()), pa.array(ph, pa.string()), pa.array(c, pa.int64())],
                                             names=["grp", "n", "phrase", "c"])

    def run(batches):
        part, held = None, {}
        for batch in small_batches(batches, 64):
            for p, *entry in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if p != part:
                    yield from frequent(held)
                    part, held = p, {}
                for g, n, ph, c in zip(*entry, strict=True):
                    held[g, n, ph] = held.get((g, n, ph), 0) + c
        yield from frequent(held)
    return run


def _log2_up(x: float) -> int:
    return max(int(np.ceil(np.log2(max(x, 1)))), 0)


def _counters(bytes_: int, lengths: int, plan: Plan) -> float:
    """About as many counters as summaries of the whole corpus need."""
    return bytes_ / 6 * lengths / max(plan.least, 1)


def _log_parts(bytes_: int, lengths: int, plan: Plan) -> int:
    return max(6, _log2_up(_counters(bytes_, lengths, plan) / COUNTERS))


def survivor_tables(docs: DataFrame, plan: Plan, bytes_: int) -> list:
    """Bit tables of the rounds, broadcast: (table, log2 of its bits).  ``bytes_`` of text only size them."""
    spark = docs.sparkSession
    tables: list = []
    for k, lengths in enumerate(ROUNDS):
        used = [n for n in lengths if n <= plan.words]
        if not used:
            break
        likely = _counters(bytes_, len(used), plan)
        log_parts = _log_parts(bytes_, len(used), plan)
        log_bits = max(log_parts + 3, min(max(_log2_up(8 * likely), _log2_up(MIN_BITS)), _log2_up(MAX_BITS)))
        shares = docs.mapInArrow(_send(k, tables, log_parts, plan.words), SENT)
        # the window passes a partition's rows on with their whole mass; they spill, none is held by a group
        whole = shares.withColumn("total", F.sum("mass").over(Window.partitionBy("part")))
        seg = whole.select("part", "total", "hashes", "counts").mapInArrow(_summarise(plan.least, log_parts, log_bits), "part int, found bigint, off bigint, bits binary")
        bits = np.zeros(1 << (log_bits - 3), np.uint8)
        width = 1 << (log_bits - log_parts - 3)
        for r in seg.toLocalIterator():  # MAX_BITS bits in all
            bits[r["part"] * width:(r["part"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
        tables.append((spark.sparkContext.broadcast(bits), log_bits))
    return tables


def frequent_runs(docs: DataFrame, plan: Plan, text: str = "text", group: str = "lang") -> DataFrame:
    """(grp, n, phrase, c): exact counts of all runs of 1 to ``words`` words with at least ``least`` occurrences in
    their group, and a row of n = 0 with the number of words of every group that has words."""
    src = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(group).cast("string").alias("g"))
    bytes_ = src.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    tables = survivor_tables(src, plan, bytes_)
    log_parts = _log_parts(bytes_, 1, plan)
    counts = src.mapInArrow(_count(tables, plan.words, log_parts), COUNTED)
    # a partition holds no more runs than the mass it may have, divided by the threshold
    placed = counts.repartition(F.col("part")).sortWithinPartitions("part")
    return stored(placed.mapInArrow(_total(plan.least), "grp string, n int, phrase string, c bigint"), "runs")


def mine(docs: DataFrame, plan: Plan | None = None, text: str = "text", group: str = "lang") -> DataFrame:
    """The best phrases of every group: (group, rank, phrase, a, l, r, n, score).

    A phrase of 2 to ``words`` words with a >= ``least`` occurrences is cut after each of its words; l and r are the
    occurrences of the two parts, n the group's words, score = floor(1000 a n / (l r)); the lowest cut counts, of equal
    ones that of the shortest first part.  Phrases inside a longer one with at least ``absorb`` percent of their
    occurrences go.  Products are taken as decimals of 38 digits."""
    plan = plan or Plan()
    found = frequent_runs(docs, plan, text, group)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    phrases = found.where("n >= 2").withColumnRenamed("c", "a")
    # inside a longer one: the longer one's part of just one word more has as many occurrences, so two parts suffice
    words = F.split("phrase", " ")
    longer = found.where("n >= 3").select("grp", "c", F.explode(F.array(F.slice(words, F.lit(1), F.col("n") - 1), F.slice(words, F.lit(2), F.col("n") - 1))).alias("w"))
    longer = longer.groupBy("grp", F.array_join("w", " ").alias("phrase")).agg(F.max("c").alias("longer"))
    phrases = phrases.join(longer, ["grp", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100).cast("decimal(19,0)") * F.col("longer") < F.col("a") * F.lit(plan.absorb).cast("decimal(19,0)")))
    cuts = (phrases.select("grp", "phrase", "a", F.col("n").alias("size"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
            .withColumn("w", F.split("phrase", " "))
            .select("grp", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
                    F.array_join(F.slice("w", F.col("k") + 1, F.col("size")), " ").alias("right"),
                    F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int").alias("salt")))
    parts = found.where((F.col("n") >= 1) & (F.col("n") < plan.words)).select("grp", F.col("phrase").alias("part"), "c", salts)
    totals = found.where("n = 0").select("grp", F.col("c").alias("n"), salts)
    x = (cuts.join(parts.select("grp", F.col("part").alias("left"), F.col("c").alias("l"), "salt"), ["grp", "left", "salt"])
         .join(parts.select("grp", F.col("part").alias("right"), F.col("c").alias("r"), "salt"), ["grp", "right", "salt"])
         .join(totals, ["grp", "salt"]))
    dec = "decimal(19,0)"
    score = F.expr(f"(cast(1000 as decimal(4,0)) * cast(a as {dec}) * cast(n as {dec})) div (cast(l as {dec}) * cast(r as {dec}))")
    best = x.withColumn("score", score).groupBy("grp", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"), F.first("a").alias("a"), F.first("n").alias("n"))
    best = best.select("grp", "phrase", "a", "m.l", "m.r", "n", "m.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # the best of each salt first, so that a group's last ranking sees SALTS * top rows at most
    salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "salt").orderBy(*order))).where(F.col("rank") <= plan.top)
    out = near.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).where(F.col("rank") <= plan.top)
    return out.select(F.col("grp").alias(group), F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mine_sql(plan: Plan | None = None) -> str:
    """DuckDB's statement of ``mine`` on ``documents``, by counting every run."""
    plan = plan or Plan()
    runs_ = " UNION ALL ".join(f"SELECT lang, {n} AS n, unnest(list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(list_slice(ws, i, i + {n - 1}), ' '))) AS phrase FROM w"
                               for n in range(1, plan.words + 1))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, n, phrase, CAST(count(*) AS BIGINT) AS c FROM ({runs_}) GROUP BY lang, n, phrase HAVING count(*) >= {plan.least}),
c AS (SELECT lang, n AS size, phrase, c AS a, string_split(phrase, ' ') AS ws FROM f WHERE n >= 2),
g AS (SELECT lang, array_to_string(part, ' ') AS phrase, max(a) AS longer FROM (
  SELECT lang, a, unnest([list_slice(ws, 1, size - 1), list_slice(ws, 2, size)]) AS part FROM c WHERE size >= 3) GROUP BY lang, array_to_string(part, ' ')),
k AS (SELECT c.lang, c.phrase, c.a, c.ws, c.size, unnest(generate_series(1, c.size - 1)) AS k FROM c LEFT JOIN g ON g.lang = c.lang AND g.phrase = c.phrase
  WHERE g.longer IS NULL OR 100 * g.longer < {plan.absorb} * c.a),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.c AS l, y.c AS r, t.n, CAST((CAST(1000 AS HUGEINT) * k.a * t.n) // (CAST(x.c AS HUGEINT) * y.c) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(list_slice(k.ws, 1, k.k), ' ')
  JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(list_slice(k.ws, k.k + 1, k.size), ' ') JOIN t ON t.lang = k.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE nth = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM o WHERE rank <= {plan.top}"""
