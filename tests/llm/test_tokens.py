"""SentencePiece codec against the library, token files as exact round trips."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from stanceframe.llm import sentencepiece_codec as S
from stanceframe.llm import token_files as K

ODD = ["", " ", "  ", "\n", "a", "▁", "▁▁ x", "<s> </s>", "日本 日", "🙂🙂", "x" * 300, "=" * 200, "a\x00b", "ab\x1cc", " 　é\x85z", "a  b \n\n c ",
       "<|endoftext|> x", "it's 12's", "\xa0\xa0x", "word " * 3000]


def _random_texts(n):
    rng = random.Random(5)
    letters = "ab eè  \n\t▁日🙂ﬁé aaaa zzz 00 11 the in ##//==--  abcdefghijklmnopqrstuvwxyzABC.,;é'\x1c\x85"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) * rng.randint(1, 3) for _ in range(n)]


def test_prefix_table_equals_the_library():
    enc = S.PrefixTableEncoder(S.default_model())
    texts = ODD + _random_texts(4000)
    for text, (ids, shown) in zip(texts, enc.encode_all(texts), strict=True):
        want = enc.sp.encode(text)
        assert ids == want, repr(text)
        assert shown == ",".join(map(str, want))
        assert enc.decode(ids) == enc.sp.decode(want)


def test_compatibility_is_the_merge_of_both():
    enc = S.PrefixTableEncoder(S.default_model())
    rng = random.Random(2)
    ids = rng.sample(sorted(enc.halves), 60)
    for a in ids:
        for b in ids:
            symbols = list(enc.text_of[a] + enc.text_of[b])
            while True:  # plain merging, highest score first, leftmost on ties
                best = min(((enc.rank[enc.pieces[x + y]], k) for k, (x, y) in enumerate(zip(symbols, symbols[1:], strict=False))
                            if x + y in enc.pieces), default=None)
                if best is None:
                    break
                symbols[best[1]:best[1] + 2] = [symbols[best[1]] + symbols[best[1] + 1]]
            assert enc.compatible(a, b) == (symbols == [enc.text_of[a], enc.text_of[b]])


def test_encode_table_handles_every_row(docs):
    rows = [(1, None), (2, ""), (2, "twice"), (None, "no id"), (3, "Hello  world\n"), (3, "Hello  world\n")]
    got = sorted(map(tuple, S.encode_table(docs(rows), S.default_model()).collect()), key=repr)
    sp = S.encoder(S.default_model()).sp
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted(((i, len(sp.encode(t or "")), sha(",".join(map(str, sp.encode(t or "")))), sha(sp.decode(sp.encode(t or "")))) for i, t in rows), key=repr)
    assert got == want
    assert S.encode_table(docs([(1, "x")]).limit(0), S.default_model()).count() == 0


def test_id_encoder_equals_the_library():
    enc = K.IdEncoder(K.default_tokenizer())
    texts = ODD + _random_texts(4000)
    want = [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    assert enc.by_stretch and [x.tolist() for x in enc.encode_all(texts)] == want


def test_frames_can_be_read_one_by_one_and_are_checked():
    rng = np.random.default_rng(1)
    out = io.BytesIO()
    w = K.FrameWriter(out, 2)
    held = {}
    for d in range(400):
        held[d] = rng.integers(0, 50_000, int(rng.integers(0, 9000)), dtype=np.uint32)
        w.add(d, held[d])
    w.close()
    raw = out.getvalue()
    r = K.FrameReader(io.BytesIO(raw), len(raw))
    assert len(r.table) > 3 and all((ids == held[int(r.doc_ids[k])]).all() for k, ids in r.documents())
    opened = []
    inner = r.frame
    r.frame = lambda k: opened.append(k) or inner(k)
    assert [k for k, _ in r.documents(np.array([200]))] == [200] and len(opened) == 1
    import zstandard
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert whole.startswith(held[0].astype("<u2").tobytes())  # any reader of the format can read it
    bad = bytearray(raw)
    bad[len(raw) - 9 - 12 * len(r.table) + 8] ^= 1  # a checksum in the seek table
    with pytest.raises(ValueError):
        list(K.FrameReader(io.BytesIO(bytes(bad)), len(bad)).documents())


def test_token_files_round_trip(docs, spark):
    from stanceframe.session import scratch_path
    rows = [(i * 3 % 101, f"text number {i} " * (i % 7)) for i in range(101)] + [(500, None), (501, ""), (None, "no id"), (502, "word " * 20_000)]
    folder = scratch_path(spark, "t-files")
    manifest = K.write_token_files(docs(rows), folder, K.default_tokenizer())
    got = {r["doc_id"]: r for r in K.read_token_files(manifest, folder, with_ids=True).collect()}
    tok = K.id_encoder(K.default_tokenizer()).tok
    start = 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids"]) == (start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    some = K.read_token_files(manifest, folder, wanted=[500, 7]).collect()
    assert sorted(r["doc_id"] for r in some) == [7, 500] and {r["start"] for r in some} == {got[7]["start"], got[500]["start"]}
    assert K.token_table(docs(rows).limit(0), K.default_tokenizer()).count() == 0


def test_new_words_are_encoded_together_and_taken_apart(monkeypatch):
    """Few calls of the library for many new words, the ids those of each word by itself."""
    enc = K.IdEncoder(K.default_tokenizer())
    texts = [t for t in ODD + _random_texts(3000) if t.strip()] + ["'s it's\n's\n\nfoo,bar\tx  y\r\n z9 'll\x1c 'd", " " + "long" * 40 + "\nlong", "a​b ﻿c"]
    want = [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    sent = []
    tok = enc.tok

    class Counting:
        def encode_batch_fast(self, batch, **kw):
            sent.append(len(batch))
            return tok.encode_batch_fast(batch, **kw)

        def __getattr__(self, name):
            return getattr(tok, name)
    enc.tok = Counting()
    assert [x.tolist() for x in enc.encode_all(texts)] == want
    words = {w for t in texts for w in t.split()}
    assert len(words) > 3000 and sum(sent) < len(words) / 2, (sum(sent), len(words))
    assert [x.tolist() for x in enc.encode_all(texts)] == want  # from the table
    # an id that stands for other bytes than its characters: words are encoded by themselves
    other = K.IdEncoder(K.default_tokenizer())
    other.bytes_of = other.bytes_of + 1
    assert [x.tolist() for x in other.encode_all(texts)] == want
