"""N-gram Jaccard join: token-combination prefixes over word-shingle sets.

Tokens are the members of the sets.  They fall into three classes by the number of sets that hold them:
unique, rare (up to ``RARE``) and frequent; a set's tokens are ordered by class, then hash.  Two sets with
Jaccard similarity of at least t agree on so much that the first ``p = n - ceil(t n) + 1`` tokens of both
share one.  The prefix is therefore extended and indexed like this:

* unique tokens fill the prefix but need no index; most sets end here;
* rare tokens are indexed one by one;
* where unique and rare tokens do not fill the prefix, frequent tokens are split into hashed subclasses
  and indexed by combinations of two of a subclass; the prefix grows until the subclasses' sizes, less
  one each, make up for the missing tokens, which again forces a common index entry.

Candidates of an index entry are first compared with its hub, the member that has the fewest tokens to
itself; pairs whose sizes and numbers of shared tokens rule the similarity out are no candidates.  What
these links connect needs no further comparison; the remaining pairs of a hub's entries, across components,
are all verified in blocks, which return just the links that join components.  So a group of many near
copies costs one comparison per copy, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stanceframe.llm.common import batches_of, free_other_caches, small_batches, stored
from stanceframe.llm.components import connected_components
from stanceframe.llm.shingles import mix, set_digests, shingle_sets

WIDTH, PERCENT = 5, 80
RARE = 8  # a token in more sets than this is frequent
BLOCK = 500_000  # characters that a task turns into tokens at a time
RANGE_BYTES = 16_000_000  # tokens that one group counts at a time
GROUP_BLOCK = 1024  # sets of a group that are compared with each other, or with another block, in one go
SMALL_SIDE = 32 << 20  # a side of a join this small, by its counted rows, is broadcast
_U = np.uint64


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("_t"))


def _when_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if rows * row_bytes <= SMALL_SIDE else df


def set_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and set digest (null for the empty set) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_other_caches("join")
        for batch in small_batches(batches):
            texts = batch.column(1).to_pylist()
            for lo, hi in batches_of(texts, BLOCK):
                size, digest = set_digests(*shingle_sets(texts[lo:hi], WIDTH), hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()),
                     pa.array(digest.view(np.int64), pa.int64(), mask=size == 0)], names=["doc_id", "n_shingles", "node"])

    return _narrow(docs).mapInArrow(run, "doc_id bigint, n_shingles bigint, node bigint")


def prefix_length(n, percent: int = PERCENT):
    """Tokens of a set of n of which a similar set must hold one."""
    return n - -(-percent * n // 100) + 1


def pack_fixed(values: np.ndarray, width: int) -> bytes:
    """Numbers below 2^width, ``width`` bits each."""
    bits = np.unpackbits(values.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(bits[:, 32 - width:]).tobytes()


def unpack_fixed(raw: bytes, width: int, count: int) -> np.ndarray:
    bits = np.zeros((count, 32), np.uint8)
    bits[:, 32 - width:] = np.unpackbits(np.frombuffer(raw, np.uint8), count=count * width).reshape(count, width)
    return np.packbits(bits, axis=1).view(">u4").ravel().astype(np.uint32)


def _low_bits(count: int) -> int:
    return min(31, max(0, 32 - count.bit_length()))


def pack_ascending(values: np.ndarray) -> tuple[bytes, bytes]:
    """32-bit numbers in ascending order: their low bits, and the steps of what is above them as runs of zeros."""
    low = _low_bits(len(values))
    high = (values >> np.uint32(low)).astype(np.int64)
    marks = np.zeros(int(high[-1]) + len(values) if len(values) else 0, bool)
    marks[high + np.arange(len(values))] = True
    return pack_fixed(values & np.uint32((1 << low) - 1), low), np.packbits(marks).tobytes()


def unpack_ascending(low_raw: bytes, high_raw: bytes, count: int) -> np.ndarray:
    low = _low_bits(count)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(high_raw, np.uint8)))[:count] - np.arange(count)
    return (high.astype(np.uint32) << np.uint32(low)) | unpack_fixed(low_raw, low, count)


def _token_rows(docs: DataFrame, bits: int) -> DataFrame:
    """Packed (token, set) entries by range of tokens, some 20 bits a token and 10 its set.  Repeated sets of a task and tokens that are
    frequent inside a block are folded before the shuffle: the latter go as one mark, with a count
    per set of how many of its tokens were folded."""
    shift = _U(64 - bits)

    def rows(nodes: np.ndarray, sizes: np.ndarray, d: np.ndarray, h: np.ndarray) -> Iterator[dict]:
        order = np.argsort(h, kind="stable")
        d, h = d[order].astype(np.uint32), h[order]
        lo = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        hot = np.repeat(np.diff(np.concatenate([lo, [len(h)]])) > RARE, np.diff(np.concatenate([lo, [len(h)]])))
        lead = np.zeros(len(h), bool)
        lead[lo] = True
        of = (h >> shift).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
        begin = np.zeros(len(h), bool)  # a set's size goes with its first token only
        begin[np.unique(d, return_index=True)[1]] = True
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own, place = np.unique(d[a:b], return_inverse=True)
            folded = np.bincount(place[hot[a:b]], minlength=len(own)).astype("<u4")
            size = np.zeros(len(own), "<u4")
            size[place[begin[a:b]]] = sizes[d[a:b][begin[a:b]]]
            keep = ~hot[a:b] | lead[a:b]
            entry = np.where(hot[a:b], len(own), place)[keep]  # a mark is one more than the last set
            part = ((h[a:b][keep] << _U(bits)) >> _U(32)).astype(np.uint32)  # the 32 bits after the range's, ascending
            # 32 bits stand for a token in its range: see _shared_tokens for tokens that agree in them
            low, high = pack_ascending(part)
            yield {"part": int(of[a]), "nodes": nodes[own].tobytes(), "sizes": size.tobytes(), "folded": folded.tobytes(),
                   "count": len(part), "low": low, "high": high, "entry": pack_fixed(entry, len(own).bit_length())}

    schema = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("nodes", "sizes", "folded")), ("count", pa.int32()),
                        *((c, pa.binary()) for c in ("low", "high", "entry"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in batches_of(texts, 8 * BLOCK):
                d, h = zip(*(((x + a), y) for a, b in ((lo + i, lo + j) for i, j in batches_of(texts[lo:hi], BLOCK))
                             for x, y in [shingle_sets(texts[a:b], WIDTH)]), strict=True)
                d, h = np.concatenate(d) - lo, np.concatenate(h)
                size, digest = set_digests(d, h, hi - lo)
                fresh = np.zeros(hi - lo, bool)
                for i, x in enumerate(digest.tolist()):
                    if size[i] > 1 and x not in seen:  # a set of one links with equal sets only
                        seen.add(x)
                        fresh[i] = True
                keep = fresh[d]
                if keep.any():
                    yield pa.RecordBatch.from_pylist(list(rows(digest, size, d[keep], h[keep])), schema=schema)

    return _narrow(docs).mapInArrow(run, "part int, nodes binary, sizes binary, folded binary, count int, low binary, high binary, entry binary")


def _shared_tokens(rows: DataFrame, bits: int) -> DataFrame:
    """Per range of tokens and bucket of sets, packed: the sets, their sizes (once a set, else 0), how many of their tokens
    there other sets hold too, and the rare ones of these.

    A token is known here by its range and the next 32 bits.  Tokens of one set that agree in these count as
    often as they are: a set's entries are taken from one row that holds it, never folded by token.  So what
    counts as shared may be too much, never too little."""
    out = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), *((c, pa.binary()) for c in ("nodes", "sizes", "shared", "rares", "rare"))])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        cols = {c: table[c].to_pylist() for c in ("nodes", "sizes", "folded", "count", "low", "high", "entry")}
        own = [np.frombuffer(x, np.uint64) for x in cols["nodes"]]
        start = np.concatenate([[0], np.cumsum([len(x) for x in own])])
        node = np.concatenate(own)
        size = np.frombuffer(b"".join(cols["sizes"]), "<u4")
        folded = np.frombuffer(b"".join(cols["folded"]), "<u4").astype(np.int64)
        here = np.zeros(len(node), bool)  # of equal sets in several rows, one
        here[np.unique(node, return_index=True)[1]] = True
        token, at, marked = [], [], []
        for k, (n, low, high, e) in enumerate(zip(cols["count"], cols["low"], cols["high"], cols["entry"], strict=True)):
            tok, entry = unpack_ascending(low, high, n), unpack_fixed(e, len(own[k]).bit_length(), n)
            real = entry < len(own[k])
            marked.append(tok[~real])
            place = entry[real].astype(np.int64) + start[k]
            keep = here[place]
            token.append(tok[real][keep])
            at.append(place[keep])
        token, at = np.concatenate(token), np.concatenate(at)
        order = np.argsort(token, kind="stable")
        token, at = token[order], at[order]
        lo = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        length = np.diff(np.concatenate([lo, [len(token)]]))
        df = np.repeat(length, length)
        frequent = (df > RARE) | np.isin(token, np.concatenate(marked))
        rare = (df > 1) & ~frequent
        shared = np.bincount(at[rare | frequent], minlength=len(node)) + np.where(here, folded, 0)
        # sets in order, so that a bucket of sets is a slice
        rank = np.empty(len(node), np.int64)
        by_node = np.argsort(node, kind="stable")
        rank[by_node] = np.arange(len(node))
        rares = np.bincount(at[rare], minlength=len(node))
        r_at, r_tok = at[rare], token[rare].astype("<u4")
        r_order = np.argsort(rank[r_at], kind="stable")
        by_node = by_node[((shared > 0) | (here & (size > 0)))[by_node]]
        r_end = np.concatenate([[0], np.cumsum(rares[by_node])])
        r_tok = r_tok[r_order]
        of = (node[by_node] >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(by_node), np.int64)
        cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(of) else np.zeros(1, np.int64)
        rows_ = [{"bucket": int(of[a]), "part": part, "nodes": node[by_node[a:b]].tobytes(), "sizes": size[by_node[a:b]].tobytes(),
                  "shared": shared[by_node[a:b]].astype("<u4").tobytes(), "rares": rares[by_node[a:b]].astype("<u4").tobytes(),
                  "rare": r_tok[r_end[a]:r_end[b]].tobytes()} for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.Table.from_pylist(rows_, schema=out)

    return rows.groupBy("part").applyInArrow(run, "bucket int, part int, nodes binary, sizes binary, shared binary, rares binary, rare binary")


def _rare_prefixes(shared: DataFrame, percent: int) -> DataFrame:
    """Sets whose unique tokens do not fill the prefix: size, shared tokens (at least those that other sets
    hold too), the rare tokens to index, and whether more is needed.  A bucket of sets is a group of bounded size."""
    out = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("s", pa.int64()), ("keys", pa.list_(pa.int64())), ("short", pa.bool_())])

    def run(_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        def column(c: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(table[c].to_pylist()), kind)

        node, n = column("nodes", np.uint64), column("sizes", "<u4").astype(np.int64)
        part_shared, rares, rare = column("shared", "<u4").astype(np.int64), column("rares", "<u4").astype(np.int64), column("rare", "<u4").astype(np.uint64)
        rare |= np.repeat(np.asarray(table["part"]).astype(np.uint64) << _U(32), [len(x) // 4 for x in table["rare"].to_pylist()])
        names, where = np.unique(node, return_inverse=True)
        sh = np.bincount(where, weights=part_shared, minlength=len(names)).astype(np.int64)
        n = np.bincount(where, weights=n, minlength=len(names)).astype(np.int64)  # each set's size stands once
        owner = np.repeat(where, rares)
        order = np.lexsort((rare, owner))
        owner, rare = owner[order], rare[order]
        begin = np.searchsorted(owner, np.arange(len(names) + 1))
        use = np.flatnonzero(percent * n <= 100 * sh)  # of n, at most n - ceil(t n) unique
        need = [prefix_length(int(k), percent) for k in n[use]] - (n[use] - sh[use])
        keys = [np.unique(rare[begin[i]:min(begin[i] + max(k, 0), begin[i + 1])]).view(np.int64) for i, k in zip(use.tolist(), need.tolist(), strict=True)]
        return pa.table([pa.array(names[use].view(np.int64)), pa.array(n[use]), pa.array(np.minimum(n, sh)[use]), pa.array(keys, pa.list_(pa.int64())),
                         pa.array(need > np.diff(begin)[use])], schema=out)

    return shared.groupBy("bucket").applyInArrow(run, "node bigint, n bigint, s bigint, keys array<bigint>, short boolean")


def _subclasses(band: int, percent: int) -> int:
    """Subclasses of frequent tokens for sets of 2^band to 2^(band+1) - 1 tokens."""
    return max(1, prefix_length(1 << band, percent) // 2)


def combination_keys(tokens: np.ndarray, n: int, rare: int, percent: int) -> list[int]:
    """Index entries of a set's other-than-rare tokens: pairs inside hashed subclasses of its prefix.

    The subclasses depend on the size class; a set whose partners may be of the next smaller size class
    is indexed for both."""
    need = prefix_length(n, percent) - rare
    out: list[int] = []
    for band in sorted({n.bit_length() - 1, (-(-percent * n // 100)).bit_length() - 1}):
        groups = _subclasses(band, percent)
        cls = (mix(tokens ^ _U(0x5851F42D4C957F2D)) % _U(groups)).astype(np.int64)
        # the shortest prefix whose subclasses, less one token each, still hold what is needed
        first = np.zeros(len(tokens), bool)
        first[np.unique(cls, return_index=True)[1]] = True
        gained = np.cumsum(~first)
        end = int(np.searchsorted(gained, need)) + 1
        tok, c = tokens[:end], cls[:end]
        order = np.lexsort((tok, c))
        tok, c = tok[order], c[order]
        cut = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1], [True]])) if len(c) else np.zeros(1, np.int64)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            i, j = np.triu_indices(b - a, 1)
            out += mix(mix(tok[a + i] + _U(band)) * _U(3) + tok[a + j]).view(np.int64).tolist()
    return out


def _texts_of(docs: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """(node, text) of one document of each wanted set; ``wanted``: node, doc_id."""
    return (_narrow(docs).join(_when_small(wanted.select("node", F.col("doc_id").alias("_id")), rows, 16), "_id")
            .select("node", "_t"))


def _set_bytes(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column(1).to_pylist()
            for lo, hi in batches_of(texts, BLOCK):
                d, h = shingle_sets(texts[lo:hi], WIDTH)
                cut = np.searchsorted(d, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo),
                     pa.array([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                    names=["node", "members"])

    return texts.mapInArrow(run, "node bigint, members binary")


def _combinations(texts: DataFrame, percent: int, bits: int) -> DataFrame:
    """Postings of the sets whose rare tokens do not fill the prefix; ``texts``: node, text, rare tokens, shared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, texts, rare, held = (batch.column(k).to_pylist() for k in range(4))
            for lo, hi in batches_of(texts, BLOCK):
                d, h = shingle_sets(texts[lo:hi], WIDTH)
                cut = np.searchsorted(d, np.arange(hi - lo + 1))
                size, keys = [], []
                for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    own = h[a:b] >> _U(32 - bits)  # as the index knows them: range and 32 bits
                    known = np.array(rare[lo + i], np.int64).view(np.uint64)
                    other = h[a:b][~np.isin(own, known)]  # in full, so that no two become one
                    size.append(b - a)
                    keys.append(combination_keys(other, int(b - a), int(b - a) - len(other), percent))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.list_(pa.int64())), pa.array(nodes[lo:hi], pa.int64()),
                                                  pa.array(size, pa.int64()), pa.array(held[lo:hi], pa.int64())],
                                                 names=["keys", "node", "n", "s"])

    return texts.mapInArrow(run, "keys array<bigint>, node bigint, n bigint, s bigint")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    full = (pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y"))
    return full.mapInArrow(run, "a bigint, b bigint")


def _fits(percent: int):
    """Whether sizes n, n2 and shared tokens s, s2 allow the similarity: the intersection is at most the smaller s."""
    most = F.least("s", "s2")
    return 100 * most >= percent * (F.col("n") + F.col("n2") - most)


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Null and empty texts, and texts without words, have n_shingles 0 and are linked with nothing; a null id
    gives a null doc_id and links only where a row with an id holds the same set; repeated rows come out as
    often as they come in; component_id is the smallest id reachable.  Extra columns are ignored."""
    return _set_components(docs, percent).select("doc_id", "n_shingles", "component_id")


def _set_components(docs: DataFrame, percent: int) -> DataFrame:
    """The rows of ``jaccard_components`` with the digest of their set (``node``)."""
    sets = stored(set_table(docs), "join-sets")
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    bits = max(0, int(total * 8 // RANGE_BYTES).bit_length())
    first = stored(sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"),
                                                                      F.count("*").alias("copies")), "join-first")
    prefixes = stored(_rare_prefixes(_shared_tokens(_token_rows(docs, bits), bits), percent), "join-prefixes")
    counts = prefixes.agg(F.count("*"), F.count(F.when(F.col("short"), 1))).first()
    wanted = prefixes.join(first, "node")
    members = stored(_set_bytes(_texts_of(docs, wanted, counts[0])), "join-members")
    # a repeated id may bring texts of other sets along: keep those whose set is the wanted one
    members = _own_sets(members)
    heavy = wanted.where("short").select("node", "doc_id", "keys", "s")
    heavy_texts = (_narrow(docs).join(_when_small(heavy.select("node", F.col("doc_id").alias("_id"), "keys", "s"), counts[1], 512), "_id")
                   .select("node", "_t", "keys", "s"))
    postings = (prefixes.select(F.explode("keys").alias("key"), "node", "n", "s")
                .unionByName(_combinations(heavy_texts, percent, bits).select(F.explode("keys").alias("key"), "node", "n", "s")))
    postings = stored(postings, "join-postings")
    # links to the member of each entry that has the fewest tokens to itself
    lead = (postings.groupBy("key").agg(F.min(F.struct((F.col("n") - F.col("s")).alias("own"), "node", "n", "s")).alias("l"),
                                        F.min("node").alias("_a"), F.max("node").alias("_z"))
            .where("_a <> _z").select("key", F.col("l.node").alias("a"), F.col("l.n").alias("n2"), F.col("l.s").alias("s2")))
    star = (postings.join(lead, "key").where((F.col("node") != F.col("a")) & _fits(percent))
            .select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct())
    star = stored(star, "join-star")
    links = stored(_similar(star, members, percent), "join-links")
    comp = stored(connected_components(links), "join-components")
    # entries of one hub are one group; where its members lie in different components, compare across them
    groups = postings.join(lead.select("key", F.col("a").alias("hub")), "key").select("hub", "node", "n", "s").distinct()
    groups = stored(groups.join(comp, "node", "left").select("hub", "node", "n", "s", F.coalesce("component", "node").alias("c")),
                    "join-groups")
    more = stored(_across(groups, members, percent), "join-more")
    comp = connected_components(links.unionByName(more))
    # the smallest document of each set, then of each component
    groups = first.join(comp, "node", "left").select("node", "doc_id", "copies", F.coalesce("component", "node").alias("c"))
    least = groups.groupBy("c").agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("_m"))
    final = groups.join(least.where("_m > 1"), "c").select("node", "component_id")
    return (sets.join(final, "node", "left")
            .select("doc_id", "n_shingles", "node", F.coalesce("component_id", "doc_id").alias("component_id")))


def _across(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join components inside groups (hub, node, n, s, c); none between components is missed.

    A group is cut into blocks of about ``GROUP_BLOCK`` sets and every pair of blocks compared by itself, so a
    group of any size is spread over tasks that each hold two blocks; small groups travel together.  A pair
    of blocks gives a spanning selection of its links: as many as it joins components, not all pairs."""
    mixed = (groups.groupBy("hub").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size"))
             .where("lo <> hi").select("hub", "size"))
    rows = stored(groups.join(mixed, "hub"), "join-mixed")
    units = (rows.count() // GROUP_BLOCK) + 1
    blocks = F.ceil(F.col("size") / F.lit(GROUP_BLOCK)).cast("int")
    rows = rows.withColumn("_b", F.when(F.col("size") > GROUP_BLOCK, F.pmod(F.xxhash64("node"), blocks).cast("int")).otherwise(0))
    rows = rows.withColumn("_with", F.explode(F.when(F.col("size") > GROUP_BLOCK, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(0)))))
    big = F.col("size") > GROUP_BLOCK
    rows = rows.select("hub", "node", "n", "s", "c", "_b",
                       F.when(big, F.col("hub")).otherwise(F.pmod(F.xxhash64("hub"), F.lit(units))).alias("u"),
                       F.when(big, F.least("_b", "_with")).otherwise(-1).alias("i"),
                       F.when(big, F.greatest("_b", "_with")).otherwise(-1).alias("j")).join(sets, "node")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        hub, node, n, s, c, b = (np.asarray(table[x]) for x in ("hub", "node", "n", "s", "c", "_b"))
        members = [np.frombuffer(x, np.uint64) for x in table["members"].to_pylist()]
        links: list[tuple[int, int]] = []
        order = np.argsort(hub, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], hub[order][1:] != hub[order][:-1], [True]]))
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            at = order[lo:hi]
            side = b[at] if i != j else np.zeros(len(at), np.int64)
            links += spanning_links(node[at], n[at], s[at], c[at], side, [members[k] for k in at], percent)
        return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=schema)

    return rows.groupBy("u", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


def spanning_links(node: np.ndarray, n: np.ndarray, s: np.ndarray, c: np.ndarray, side: np.ndarray, members: list[np.ndarray],
                   percent: int) -> list[tuple[int, int]]:
    """Links between the components ``c`` of a few sets, enough to join all that any link joins.

    With two different ``side`` values only pairs across the sides count."""
    names, comp = np.unique(c, return_inverse=True)
    if len(names) < 2:
        return []
    parent = np.arange(len(names))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size = np.array([len(m) for m in members])
    start = np.concatenate([[0], np.cumsum(size)])
    local = np.unique(np.concatenate(members), return_inverse=True)[1]
    mark = np.zeros(local.max() + 1 if len(local) else 1, bool)
    largest = np.bincount(comp).argmax()
    two = len(np.unique(side)) > 1
    out = []
    for x in np.flatnonzero(comp != largest):  # of any pair across components, one is not in the largest
        root = np.array([find(k) for k in range(len(names))])
        most = np.minimum(s[x], s)
        ok = (root[comp] != root[comp[x]]) & (100 * most >= percent * (n[x] + n - most))
        ok &= (comp == largest) | (node > node[x])  # pairs of two such sets once
        if two:
            ok &= side != side[x]
        ys = np.flatnonzero(ok)
        if not len(ys):
            continue
        mark[local[start[x]:start[x + 1]]] = True
        hits = mark[np.concatenate([local[start[y]:start[y + 1]] for y in ys])]
        both = np.add.reduceat(hits.astype(np.int64), np.concatenate([[0], np.cumsum(size[ys])[:-1]]))
        mark[local[start[x]:start[x + 1]]] = False
        for y in ys[100 * both >= percent * (size[x] + size[ys] - both)]:
            p, q = find(comp[x]), find(comp[y])
            if p != q:
                parent[p] = q
                out.append((int(min(node[x], node[y])), int(max(node[x], node[y]))))
    return out


def _own_sets(members: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for node, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = np.frombuffer(raw.as_py(), np.uint64)
                ok.append(len(h) > 0 and int(set_digests(np.zeros(len(h), np.int64), h, 1)[1].view(np.int64)[0]) == node)
            yield batch.filter(pa.array(ok, pa.bool_()))

    return members.mapInArrow(run, "node bigint, members binary").dropDuplicates(["node"])


def _with_sets(docs: DataFrame) -> DataFrame:
    """Every row with the digest of its set after its columns (null for the empty set)."""
    names = [*docs.columns, "_set"]
    schema = StructType([*docs.schema.fields, StructField("_set", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_other_caches("join")
        for batch in small_batches(batches):
            texts = batch.column(len(names) - 1).to_pylist()
            for lo, hi in batches_of(texts, BLOCK):
                size, digest = set_digests(*shingle_sets(texts[lo:hi], WIDTH), hi - lo)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]),
                                                  pa.array(digest.view(np.int64), pa.int64(), mask=size == 0)], names=names)

    return docs.select(*docs.columns, F.coalesce(F.col("text"), F.lit("")).alias("_set")).mapInArrow(run, schema)


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without those of another document's component; each component keeps its smallest id.

    Rows without id stay.  Where an id is repeated, its rows with equal texts become one, and each of its
    rows with different texts stays or goes by its own text's component."""
    found = stored(_set_components(docs, percent).where("doc_id is not null").select("doc_id", "node", "component_id"), "join-found")
    gone = stored(found.where("doc_id <> component_id").select("doc_id", "node").distinct(), "join-gone")
    twice = stored(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "join-twice")
    n, n_gone = twice.count(), gone.count()
    once = (docs.join(_when_small(twice, n, 8), "doc_id", "left_anti").select(*docs.columns)
            .join(_when_small(gone.select("doc_id"), n_gone, 8), "doc_id", "left_anti").select(*docs.columns))
    again = docs.join(_when_small(twice, n, 8), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    pairs = _when_small(gone.select("doc_id", F.col("node").alias("_set")), n_gone, 16)
    again = _with_sets(again).join(pairs, ["doc_id", "_set"], "left_anti").select(*docs.columns)
    return once.unionByName(again)
