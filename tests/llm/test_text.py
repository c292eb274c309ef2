"""BPE, packing, chat and sharding: exact round trips and brute force."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from listmill.llm import bpe, chat, packing, sharding
from listmill.llm.queries import VOCABULARY, op6_chat, oracle_sql

from ..conftest import DATA

ODD = ["a  b", "a   b\n\n c", " lead", "trail ", "x\n", "\n", "", None, "a \n b", "it's <|endoftext|> ok<|endoftext|>", "tab\tx y", "nbsp  y", "\x1c a\x1cb", "日本語 テキスト", "é ²³ ½x", "ab" * 40_000, "1" * 3000, "👍🏽 ok", "x " * 20_000]
DOCS = "doc_id long, text string, lang string, ids string, sequence_id string, shard string"


def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def odd_documents(spark):
    rows = [(i, t, "en", "x", "y", "z") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[0], rows[2]], DOCS)  # repeated rows, clashing columns


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("abTHé ' \n\t \x1c1,.$<|endoftext>日👍")) | st.characters(codec="utf-8"), max_size=40))
def test_encoders_equal_the_library(text):
    ids = library_cached.encode(text, add_special_tokens=False).ids
    for kind in (bpe.Encoder, bpe.LibraryEncoder):
        own = bpe.encoder(source, kind)
        got = own.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == ids
        assert own.decode(got) == library_cached.decode(ids, skip_special_tokens=False)


library_cached, source = library(), bpe.read_vocabulary(VOCABULARY)


def test_token_digests(spark):
    docs, t = odd_documents(spark), library()
    texts = {i: x or "" for i, x in enumerate(ODD)}
    rows = bpe.token_digests(docs, VOCABULARY).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        ids = t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.token_digests(docs.limit(0), VOCABULARY).count() == 0


def test_packing(spark):
    docs, t = odd_documents(spark), library()
    own = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4") for i, x in enumerate(ODD)}
    rows = packing.packed_digests(docs, VOCABULARY).collect()
    assert sum(r["length"] for r in rows) == sum(map(len, own.values())) + len(own[0]) + len(own[2])
    seqs: dict = {}
    for r in rows:
        ids = own[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    whole = packing.sequences(packing.pack(packing.cut_documents(docs, VOCABULARY)))
    assert {len(r["ids"]) for r in whole.collect()} == {4096}
    assert packing.packed_digests(docs.limit(0), VOCABULARY).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 65, 400))[::-1]
    names, offsets = packing.best_fit(lengths, 64)
    free: list[int] = []
    for n, name, offset in zip(lengths.tolist(), names.tolist(), offsets.tolist(), strict=True):
        fits = [f for f in free if f >= n]
        want = min(fits) if fits else 64
        assert 64 - offset == want
        if not fits:
            assert name == len(free)
            free.append(64)
        assert free[name] == want
        free[name] -= n


CONV = "conv_id long, turn long, role string, text string, formatted string"


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "\\", "\\n</s", None, "", "<\\s>", "a\nb", "é<s>", "[\\INST]"]
    rows = [(c, i, ["user", "assistant", None, "tool</s>"][i % 4], said[(i + c) % len(said)], "x") for c in range(5) for i in range(12)]
    turns = spark.createDataFrame(rows, CONV)
    formatted = chat.format_conversations(turns)
    for r in formatted.collect():
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]]
        assert chat.read_back(r["formatted"]) == want
        learned = [chat.unescape(r["formatted"][a:b]) for a, b in zip(r["loss_start"], r["loss_end"], strict=True)]
        assert learned == [t for role, t in want if role == "assistant"]
    assert chat.conversation_digests(chat.format_conversations(turns.limit(0))).count() == 0


def test_chat_equals_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    cursor = db.execute(oracle_sql()["op6_chat"])
    names = [c[0] for c in cursor.description]
    theirs = sorted(str(sorted(zip(names, r, strict=True))) for r in cursor.fetchall())
    assert sorted(str(sorted(r.asDict().items())) for r in op6_chat(spark, DATA).collect()) == theirs


def test_shards(spark):
    rows = [(i, f"text {i} " * (i % 9 + 1), "en", "", "", "") for i in range(300)] + [(1000 + i, "same", "en", "", "", "") for i in range(200)] + [(2000, None, "en", "", "", ""), (2001, "", "en", "", "", ""), (5, "text 5 ", "en", "", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    out = sharding.shard_by_bytes(docs).collect()
    assert len(out) == len(rows)
    size, slots = [0] * 16, {}
    for r in out:
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert max(size) - min(size) <= max(60, 0.02 * max(size))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r["text_crc32"] for r in out if r["doc_id"] in (2000, 2001)} == {0}
    assert len({r["shard"] for r in out if r["doc_id"] in (2000, 2001)}) == 1
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0


def test_shards_in_levels_keep_every_row(spark, monkeypatch):
    """Several levels and hot groups: sizes and checksums of all rows against plain Python."""
    monkeypatch.setattr(sharding, "FAN", 2)
    monkeypatch.setattr(sharding, "GROUPS_AT_ONCE", 20)
    monkeypatch.setattr(sharding, "HOT", 4)
    rows = [(i, f"é{i} " * (i % 23 + 1), "en", "", "", "") for i in range(400)] + [(1000 + i, "", "en", "", "", "") for i in range(300)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, DOCS)).collect()
    want = sorted((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t, *_ in rows)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    assert len({r["shard"] for r in out if r["doc_id"] >= 1000}) == 1
    size = [sum(r["size"] for r in out if r["shard"] == s) for s in range(16)]
    assert max(size) - min(size) <= 0.1 * max(size)


def test_differencing_is_complete_and_even():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 1000, 500).tolist()
    out = sharding.difference([[(s, i)] for i, s in enumerate(sizes)], 16)
    assert sorted(i for part in out for i in part) == list(range(500))
    sums = [sum(sizes[i] for i in part) for part in out]
    assert max(sums) - min(sums) <= 3
