"""Token ids in seekable zstandard files: independent frames, a trailing seek table, frame checksums.

File layout: data frames, then one directory frame, then a skippable frame that holds the seek table of
all of them (the public seekable format: 0x184D2A5E, per frame compressed size, size and the low half of
the xxh64 of its contents, then frame count, descriptor and 0x8F92EAB1).  A data frame holds the ids of
whole documents one after another, little-endian, in 2 bytes each where the vocabulary allows it and 4
elsewhere.  The directory frame is JSON with the id width, followed by the documents' ids, numbers of
tokens and null flags.  A reader fetches the tail, then the directory, then only the frames that hold
the documents it wants; it checks every frame it opens.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stanceframe.llm.common import batches_of, register_cache, stored
from stanceframe.session import scratch_path

SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1  # fixed by the public format
FRAME_BYTES = 1 << 20  # a data frame is closed when it holds this much; a longer document has its own
MAX_CACHED = 1_000_000  # distinct stretches kept per worker; the table is emptied when full

# Unicode White_Space, as the tokenizer's split pattern has it
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Stretches that the tokenizer's own split never crosses: a word with at most one space before it,
#: white space up to its last character, that last character.
_STRETCH = re.compile(f" ?[^{_SPACES}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]")
#: White space outside ASCII: a text that holds any is cut by the expression above.
_WIDE_SPACE = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_ASCII_SPACE = frozenset(b"\x20\x09\x0a\x0b\x0c\x0d")
BLOCK = 8_000_000  # characters that are cut into stretches at a time
PIECE = 1 << 18  # bytes of stretches that are encoded in one go


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class IdEncoder:
    """The tokenizers library with a bounded table of stretches it has already encoded."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_file)
        self.tok.encode_special_tokens = False
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        # only for this kind of tokenizer are the stretches independent; others get whole texts
        self.by_stretch = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                           and pre.get("use_regex", True) and spec.get("normalizer") is None)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.known: dict[bytes, bytes] = register_cache("token files", {})  # ids in 4 bytes each
        # bytes that an id stands for: a byte-level vocabulary writes each byte as one character
        vocab = self.tok.get_vocab()
        self.bytes_of = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        self.bytes_of[list(vocab.values())] = [len(x) for x in vocab]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text.  Texts whose stretches ASCII white space alone divides are cut together, as bytes."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        plain, rest = [], []
        for k, t in enumerate(texts):
            easy = self.by_stretch and not any(s in t for s in self.special) and (t.isascii() or not _WIDE_SPACE.search(t))
            (plain if easy else rest).append(k)
        for group, ids in ((plain, self._by_bytes), (rest, self._by_text)):
            if group:
                for k, got in zip(group, ids([texts[k] for k in group]), strict=True):
                    out[k] = got
        return out

    def _learn(self, stretches: list[bytes], ascii_spaced: bool = False) -> list[bytes]:
        """The ids of different stretches, 4 bytes each; new ones are encoded together.  ``ascii_spaced``: they were cut
        by ASCII white space and hold no other."""
        found = list(map(self.known.get, stretches))
        if None in found:
            at = [k for k, x in enumerate(found) if x is None]
            lines = [k for k in at if stretches[k][-1] not in _ASCII_SPACE] if ascii_spaced else []
            words = [stretches[k] for k in lines]
            ids = [x for lo, hi in batches_of(words, PIECE) for x in self._by_lines(words[lo:hi])]
            if len(lines) < len(at):
                alone = sorted({*at}.difference(lines))
                words += (others := [stretches[k] for k in alone])
                ids += self._one_by_one(others)
                lines += alone
            for k, x in zip(lines, ids, strict=True):
                found[k] = x
            if len(self.known) + len(words) > MAX_CACHED:
                self.known.clear()
            fresh = zip(words, ids, strict=True)
            self.known.update(fresh if max(map(len, words)) <= 64 else [(w, x) for w, x in fresh if len(w) <= 64])
        return found

    def _one_by_one(self, words: list[bytes]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _by_lines(self, words: list[bytes]) -> list[bytes]:
        """The ids of words, encoded as one text and taken apart by the bytes that the ids stand for.

        A word that begins with a space follows the one before it, as in a text; others begin a line.  Where some
        of the words' bounds are no bounds of ids, the words are encoded one by one."""
        bare = np.array([w[0] != 32 for w in words], np.int64)
        end = np.cumsum(np.array([len(w) for w in words], np.int64) + bare)
        text = b"".join([b"\n" + w if x else w for w, x in zip(words, bare.tolist(), strict=True)]).decode()
        ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        bound = np.concatenate([[0], np.cumsum(self.bytes_of[ids])])
        begin = np.concatenate([[0], end[:-1]]) + bare
        a, b = np.searchsorted(bound, begin), np.searchsorted(bound, end)
        if bound[-1] != end[-1] or not np.array_equal(bound[a], begin) or not np.array_equal(bound[b], end):
            return self._one_by_one(words)
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip((4 * a).tolist(), (4 * b).tolist(), strict=True)]

    def _by_text(self, texts: list[str]) -> Iterator[np.ndarray]:
        for t in texts:
            whole = not self.by_stretch or any(s in t for s in self.special)
            parts = [w.encode() for w in ([t] if whole else _STRETCH.findall(t))]
            if whole:  # not a stretch: what is kept of stretches does not hold for it
                yield np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32)
            else:
                yield np.frombuffer(b"".join(self._learn(parts)), np.uint32)

    def _by_bytes(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        first = np.cumsum([0, *(len(r) for r in raw)])  # each text's first byte, and the end
        if not len(data):
            return [np.zeros(0, np.uint32)] * len(texts)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        begin = np.zeros(len(data) + 1, bool)
        begin[first] = True  # a text's start; the end too
        at_start = begin[:-1].copy()
        begin[1:-1] |= space[1:] & ~space[:-1]  # white space after a word
        word = np.flatnonzero(~space[1:] & space[:-1] & ~at_start[1:]) + 1  # a word after white space
        begin[word - 1] = True  # the last of it stands alone, or with the word if it is a space
        begin[word[data[word - 1] != 32]] = True
        offsets = np.flatnonzero(begin).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        ids = self._learn(coded.dictionary.to_pylist(), ascii_spaced=True)
        code = coded.indices.to_numpy(zero_copy_only=False)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        n = size[code]
        end = np.cumsum(n)
        flat = np.frombuffer(b"".join(ids), np.uint32)[np.repeat(start[code] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
        # ids before each text's first stretch
        cut = np.concatenate([[0], end])[np.searchsorted(offsets, first)]
        return [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


_LOADED: dict[str, IdEncoder] = {}


def id_encoder(tokenizer_file: str) -> IdEncoder:
    if tokenizer_file not in _LOADED:
        _LOADED[tokenizer_file] = IdEncoder(tokenizer_file)
    return _LOADED[tokenizer_file]


def open_fs(path: str):
    """(file system, path in it) of a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class FrameWriter:
    """Writes documents' ids to one seekable file."""

    def __init__(self, out, width: int, level: int = 3):
        import zstandard

        self.out, self.width = out, width
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.frames: list[tuple[int, int, int]] = []
        self.pending: list[bytes] = []
        self.held = self.bytes = 0
        self.doc_ids: list[int] = []
        self.nulls: list[bool] = []
        self.lengths: list[int] = []

    def _frame(self, raw: bytes) -> None:
        import xxhash

        packed = self.zip.compress(raw)
        self.out.write(packed)
        self.bytes += len(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def flush(self) -> None:
        if self.pending:
            self._frame(b"".join(self.pending))
            self.pending, self.held = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(f"<u{self.width}").tobytes()
        if self.pending and self.held + len(raw) > FRAME_BYTES:
            self.flush()
        self.pending.append(raw)
        self.held += len(raw)
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.lengths.append(len(ids))

    def close(self) -> int:
        self.flush()
        head = json.dumps({"width": self.width, "docs": len(self.lengths)}).encode()
        self._frame(struct.pack("<I", len(head)) + head + np.array(self.doc_ids, "<i8").tobytes()
                    + np.array(self.lengths, "<i8").tobytes() + np.array(self.nulls, "<u1").tobytes())
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE_MAGIC)  # 0x80: with checksums
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        return self.bytes + 8 + len(table)


class FrameReader:
    """Random access to the documents of one seekable file (a file object with seek and read)."""

    def __init__(self, src, size: int):
        self.src = src
        src.seek(size - 9)
        count, descriptor, magic = struct.unpack("<IBI", src.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table at the end of the file")
        entry = 12 if descriptor & 0x80 else 8
        src.seek(size - 9 - count * entry - 8)
        skip, length = struct.unpack("<II", src.read(8))
        if skip != SKIPPABLE_MAGIC or length != count * entry + 9:
            raise ValueError("damaged seek table")
        table = np.frombuffer(src.read(count * entry), "<u4").reshape(count, entry // 4).astype(np.int64)
        self.table = table
        self.at = np.concatenate([[0], np.cumsum(table[:, 0])])
        raw = self.frame(count - 1)
        n = struct.unpack_from("<I", raw)[0]
        head = json.loads(raw[4:4 + n])
        docs, lo = head["docs"], 4 + n
        self.width = head["width"]
        self.doc_ids = np.frombuffer(raw, "<i8", docs, lo)
        self.lengths = np.frombuffer(raw, "<i8", docs, lo + 8 * docs)
        self.nulls = np.frombuffer(raw, "<u1", docs, lo + 16 * docs).astype(bool)
        # a document's first byte in the uncompressed data, and each frame's
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]) * self.width
        self.begins = np.concatenate([[0], np.cumsum(table[:-1, 1])])

    def frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        packed, length = int(self.table[k, 0]), int(self.table[k, 1])
        self.src.seek(int(self.at[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.src.read(packed), max_output_size=length)
        if len(raw) != length or (self.table.shape[1] > 2
                                  and xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(self.table[k, 2])):
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(position in the directory, ids) of the wanted positions, opening only their frames."""
        rows = np.arange(len(self.lengths)) if wanted is None else np.sort(wanted)
        held, raw = -1, b""
        for r in rows.tolist():
            if self.lengths[r] == 0:
                yield r, np.zeros(0, np.uint32)
                continue
            k = int(np.searchsorted(self.begins, self.starts[r], "right")) - 1
            if k != held:
                held, raw = k, self.frame(k)
            yield r, np.frombuffer(raw, f"<u{self.width}", int(self.lengths[r]),
                                   int(self.starts[r] - self.begins[k])).astype(np.uint32)


def write_token_files(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 0,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id`` and write the ids in ascending order of document id.

    Each task writes one file of its range of ids, under a name of its own attempt, and returns its
    manifest row (path, bytes, docs, tokens, first_doc); only manifests of successful attempts are kept,
    so a lost executor leaves an unlisted file at worst.  Null texts count as empty, null ids come first
    and stay null, repeated ids keep all their rows (equal ids in any order), extra columns are ignored; an empty table gives an
    empty manifest."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = (docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
           .repartitionByRange(n, F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, fs, base, out, w = id_encoder(tokenizer_file), None, "", None, None
        tokens, first = 0, None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not ids:
                continue
            if w is None:
                fs, base = open_fs(folder)
                fs.create_dir(base, recursive=True)
                name = f"ids-{uuid.uuid4().hex}.zst"
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
                w, first = FrameWriter(out, max(enc.width, 4 if end_id > 0xFFFF else 2)), ids[0]
            for lo, hi in batches_of(texts, BLOCK):
                for doc_id, got in zip(ids[lo:hi], enc.encode_all(texts[lo:hi]), strict=True):
                    w.add(doc_id, np.append(got, np.uint32(end_id)))
                    tokens += len(got) + 1
        if w is not None:
            size = w.close()
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"path": [name], "bytes": [size], "docs": [len(w.lengths)], "tokens": [tokens], "first_doc": [first]},
                schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("docs", pa.int64()),
                                  ("tokens", pa.int64()), ("first_doc", pa.int64())]))

    manifest = src.mapInArrow(run, "path string, bytes bigint, docs bigint, tokens bigint, first_doc bigint")
    return stored(manifest, "token-manifest")


def read_token_files(manifest: DataFrame, folder: str, wanted: list[int] | None = None,
                     with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 (and ``ids``).

    ``start`` counts the ids of all documents before it over all files: the files are ordered by their
    first document and their token totals summed (one row per file).  ``wanted`` names documents; then
    only the frames that hold them are read."""
    order = Window.orderBy(F.col("first_doc").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", "bytes", "first_doc",
                            F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("base"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    want = None if wanted is None else np.array(sorted(set(wanted)), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        for batch in batches:
            for f in batch.to_pylist():
                with fs.open_input_file(f"{base}/{f['path']}") as src:
                    r = FrameReader(src, f["bytes"])
                    starts = f["base"] + r.starts // r.width
                    rows = None if want is None else np.flatnonzero(np.isin(r.doc_ids, want) & ~r.nulls)
                    got: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}
                    for k, ids in r.documents(rows):
                        got["doc_id"].append(None if r.nulls[k] else int(r.doc_ids[k]))
                        got["start"].append(int(starts[k]))
                        got["n_tokens"].append(len(ids))
                        got["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                        if with_ids:
                            got["ids"].append(ids.astype(np.int64))
                    cols = list(got)[:4 + with_ids]
                    kinds = {c: pa.int64() for c in cols} | ({"ids": pa.list_(pa.int64())} if with_ids else {})
                    yield pa.RecordBatch.from_arrays([pa.array(got[c], kinds[c]) for c in cols], names=cols)

    return files.repartition(n, "path").mapInArrow(run, schema)


def token_table(docs: DataFrame, tokenizer_file: str, end_id: int = 0) -> DataFrame:
    """Write the files to a fresh shared folder and read every document back."""
    folder = scratch_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, tokenizer_file, end_id), folder)
