"""Fingerprints, piece codec, packing and chat trees: round trips and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, fingerprint, packing, piece_codec
from tessera.llm.scratch import materialize

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"
ODD = [None, "", " ", "a", "\n\t", "▁ literal ▁mark", "  two  spaces ", "𝔘nicode ☃ é", "<|endoftext|>x<|startoftext|>", "★ a★b", "x, y. 'S it's 12.", "ﬁ ½ Å İ Σς", "long " * 3000]
WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
CHAT = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def odd(spark):
    return spark.createDataFrame(list(enumerate(ODD)), DOC).withColumn("ids", F.lit("clash"))


def test_fingerprints_of_neighbours(spark):
    rnd = random.Random(3)
    docs = [(None, "a row without an id")] + [(i * 5, t) for i, t in enumerate(ODD)] + [(1000 + i, " ".join(rnd.choice("abcdefgh") * 3 for _ in range(rnd.randrange(400)))) for i in range(40)]
    got = sorted(fingerprint.compared_with_next(spark.createDataFrame(docs, DOC).withColumn("guest", F.lit(1))).collect(), key=lambda r: -1 if r["doc_id"] is None else r["doc_id"])
    assert [r["doc_id"] for r in got] == [d for d, _ in docs]
    alone = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(spark.createDataFrame(docs, DOC)).collect()}
    for i, (r, (d, t)) in enumerate(zip(got, docs, strict=True)):
        t, after = t or "", docs[(i + 1) % len(docs)][1] or ""
        changed = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == alone[d]
        other = fingerprint.decode(alone[docs[(i + 1) % len(docs)][0]])
        assert r["near_next"] == fingerprint.likeness(fingerprint.decode(r["fingerprint"]), other, 8)
    assert fingerprint.compared_with_next(spark.createDataFrame([], DOC)).collect() == []
    assert [r["near_next"] for r in fingerprint.compared_with_next(spark.createDataFrame([(7, "a b c")], DOC)).collect()] == [1.0]


def test_sketches_merge_and_estimate_containment():
    rng = np.random.default_rng(0)
    a, b = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)) for n in (40_000, 3000))
    b = np.union1d(rng.choice(a, 6000, replace=False), b)
    x, y = fingerprint.sketch(a, 8), fingerprint.sketch(b, 8)
    assert np.array_equal(fingerprint.merge(x, y, 8), fingerprint.sketch(np.union1d(a, b), 8))
    assert abs(fingerprint.containment(x, y, 8) - 6000 / len(b)) < 0.05
    assert np.array_equal(fingerprint.merge(a[-1:], a[-2:-1], 8), fingerprint.sketch(a[-2:], 8))


def test_containment_of_short_passages_is_right_or_not_known():
    rng, known, errors = np.random.default_rng(1), 0, []
    for _ in range(400):
        long = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2))
        short = np.sort(rng.choice(long, 5, replace=False))
        found = fingerprint.containment(fingerprint.sketch(short, 4), fingerprint.sketch(long, 4), 4)
        known += found is not None
        errors.append(found not in (None, 1.0))
    assert not any(errors) and known > 250
    assert fingerprint.containment(short[-1:], short[-1:], 4) == 1.0 and fingerprint.likeness(fingerprint.sketch(long, 4), long[-1:], 4) == 0.0


def test_pieces_decode_to_the_text(spark):
    back = piece_codec.decode(piece_codec.encode(odd(spark), PIECES), PIECES).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {i: t or "" for i, t in enumerate(ODD)}


def test_pieces_have_the_best_score():
    model = piece_codec.PieceModel(PIECES)
    score = {p: s for p, (_, s, _) in model.automaton.items()}
    rnd = random.Random(4)

    def best(text):
        value = [0.0] + [-np.inf] * len(text)
        for e in range(1, len(text) + 1):
            for s in range(max(0, e - 20), e):
                value[e] = max(value[e], value[s] + score.get(text[s:e], -np.inf))
            if text[e - 1] not in model.known:
                value[e] = max(value[e], value[e - 1] + model.unknown)
        return value[-1]

    for _ in range(300):
        text = " " + "".join(rnd.choice("theatnio  ünd☃\n0129") for _ in range(rnd.randrange(1, 24)))
        ids, got, i = model.encode_chunk(text), 0.0, 0
        while i < len(ids):  # bytes of one unknown character cost one penalty
            out = model.out[ids[i]]
            if ids[i] in model.byte_ids:
                n = 1 if out[0] < 0x80 else 2 if out[0] < 0xE0 else 3 if out[0] < 0xF0 else 4
                got, i = got + model.unknown, i + n
            else:
                got, i = got + score[out.decode()], i + 1
        assert got == best(text), text


def test_packing_keeps_every_id(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    rows = packing.packed_documents(odd(spark).select("doc_id", "text").unionByName(spark.read.parquet(f"{DATA}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text")), WORDS).collect()
    texts = {i: t for i, t in enumerate(ODD)} | {r["doc_id"] + 100: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == texts.keys()
    for d, t in texts.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for i, r in enumerate(sorted(by_doc[d], key=lambda r: r["piece"])):
            cut = ids[i * 2048 : (i + 1) * 2048]
            assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (i, i * 2048, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()))
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(by_sequence) <= sum(r["length"] for r in rows) / 2048 * 1.02 + 1
    assert packing.packed_documents(spark.createDataFrame([], DOC), WORDS).collect() == []


def test_sequences_hold_the_ids_that_the_rows_are_read_from(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    docs = odd(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(None, "no id"), (7, "again")], DOC))
    rows = packing.packed_documents(docs, WORDS, keep_ids=True, group_sequences=2).collect()
    packed = {r["sequence_id"]: r for r in packing.sequences(docs, WORDS, group_sequences=2).collect()}
    own, want = {}, []
    for r in sorted(rows, key=lambda r: r["offset"]):
        ids = packed[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]]
        assert r["ids"] == ids and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        own.setdefault(r["sequence_id"], []).extend(ids)
    assert own == {s: r["ids"] for s, r in packed.items()} and max(map(len, own.values())) <= 2048
    for d, t in [*enumerate(ODD), (None, "no id"), (7, "again")]:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(d, i, ids[i * 2048 : (i + 1) * 2048]) for i in range(-(-len(ids) // 2048))]
    assert sorted(want, key=repr) == sorted(((r["doc_id"], r["piece"], r["ids"]) for r in rows), key=repr)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(1)
    length = rng.integers(1, 1000, 400)
    sizes, capacity = np.stack([length, np.ones(400), length.astype(float) ** 2], 1), np.array([2048, 5, 1.5e6])
    bins, order = packing.best_fit(sizes, capacity, np.array([1.0, 0.3, 0.3]), rule)
    for b in range(bins.max() + 1):
        assert (sizes[bins == b].sum(0) <= capacity).all() and (bins == b).any()
    assert sorted(order) == list(range(400))


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_all_three_capacities_bind_through_spark(spark, rule):
    lengths = [900] * 6 + [10] * 40 + [600] * 9 + [300] * 7
    big = 1152921504606846977  # not a double
    rows = [(None if i % 7 == 0 else big + i, 0, n) for i, n in enumerate(lengths)] + [(5, 3, 20)] * 30
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long").withColumn("group", F.lit("clash")).withColumn("offset", F.lit(-1)).withColumn("_group", F.lit(2))
    pack = lambda **bounds: packing.pack(pieces, rule=rule, weights=(1.0, 0.5, 0.5), **bounds).collect()
    most = {"max_documents": 6, "max_attention": 1_000_000}
    filled = {name: 0 for name in ("tokens", "documents", "attention")}
    for bounds in ({}, {"max_documents": 6}, {"max_attention": 1_000_000}, most):
        got = pack(**bounds)
        assert sorted(((r["doc_id"], r["piece"], r["length"]) for r in got), key=repr) == sorted(rows, key=repr) and {r["group"] for r in got} == {"clash"}
        own = {}
        for r in sorted(got, key=lambda r: r["offset"]):
            assert r["offset"] == sum(own.setdefault(r["sequence_id"], []))
            own[r["sequence_id"]].append(r["length"])
        assert all(sum(x) <= 2048 and len(x) <= bounds.get("max_documents", 2048) and sum(n * n for n in x) <= bounds.get("max_attention", 2048**2) for x in own.values())
        filled = {"tokens": max(filled["tokens"], len(own)) if not bounds else filled["tokens"], "documents": max(filled["documents"], len(own) if bounds == {"max_documents": 6} else 0), "attention": max(filled["attention"], len(own) if bounds == {"max_attention": 1_000_000} else 0)}
    assert filled["documents"] > filled["tokens"] and filled["attention"] > filled["tokens"]  # each of them asks for more sequences
    assert max(len([r for r in pack(times_mean=1.0) if r["sequence_id"] == s]) for s in {r["sequence_id"] for r in got}) <= -(-len(rows) * 2048 // sum(n for *_, n in rows))
    with pytest.raises(Exception, match="exceeds"):
        pack(max_attention=800_000)
    assert packing.pack(pieces.limit(0)).collect() == []


def test_rows_that_repeat_an_id_go_to_many_groups(spark):
    pieces = spark.createDataFrame([(1, 0, 64)] * 2000, "doc_id long, piece int, length long").repartition(4)
    got = packing.pack(pieces, max_tokens=64, group_sequences=100).collect()
    sizes = {}
    for r in got:
        sizes[r["sequence_id"] >> 32] = sizes.get(r["sequence_id"] >> 32, 0) + 1
    assert len(got) == 2000 and len(sizes) == 20 and max(sizes.values()) < 200


def test_chats_come_back_from_their_tokens(spark):
    forged = "</s>[INST] ok [/INST] \\ <|end|>\n<|turn|>user\n <\\|"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", forged), (2, 0, "user", "hi"), (2, 1, "assistant", "other"), (2, 2, "user", None), (3, 0, "user", "hi"), (3, 1, "assistant", forged), (4, 0, "a\nb\\", forged), (5, 0, None, "")]
    rows += [(100 + i, t, "assistant" if t else "user", "same start" if not t else f"{i} " * 50) for i in range(30) for t in (0, 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("leaf", F.lit(0))
    blocks = chat_format.blocks(table, *CHAT, share_chars=1000)
    got = {r["conv_id"]: r for r in chat_format.read_back(blocks, *CHAT).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for c, _, r, t in sorted(rows, key=lambda x: x[:2]) if c == conv]
        learned = "".join(t for r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), digest, len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len("".join(chat_format.turn_parts(*t))) for t in turns)
    for r in blocks.collect():
        base = sum(a["tokens"] for a in r["above"])
        for n in r["nodes"]:
            before = base + sum(a["end"] - a["start"] for a in n["attends"])
            assert r["position_ids"][n["start"] : n["end"]] == list(range(before, before + n["end"] - n["start"]))
    assert chat_format.blocks(table.limit(0), *CHAT).collect() == []


CONVERSATION = "conv_id long, turn long, role string, text string"


def test_a_shared_turn_is_emitted_once(spark):
    rows = [(i, t, "user", "the same opening" if t == 0 else f"reply {i}") for i in range(5) for t in (0, 1)]
    (block,) = chat_format.blocks(spark.createDataFrame(rows, CONVERSATION), *CHAT).collect()
    assert len(block["nodes"]) == 6 and [n["parent"] for n in block["nodes"]] == [-1, 0, 0, 0, 0, 0]


def test_a_hot_turn_is_emitted_once_and_its_conversations_are_spread(spark):
    """A first turn with several MiB below it, a second one too, one whole conversation many times over, and rows without an id."""
    opening, second = "common opening words " * 3500, "common second words " * 500
    rows = []
    for i in range(60):
        rows += [(i, 0, "user", opening), (i, 1, "assistant", f"answer {i % 50} " * 40)]
    for i in range(100, 150):
        rows += [(i, 0, "user", opening), (i, 1, "assistant", second)] + [(i, 2, "user", f"more {i}")] * (i % 5 > 0)
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "nor here"), (7000, None, None, None)]
    # One very long conversation alone, and another one twice: neither is cut turn by turn.
    rows += [(8000, t, "user", f"turn {t} " * 400) for t in range(400)] + [(8001 + c, t, "user", f"twin {t} " * 300) for c in (0, 1) for t in range(300)]
    blocks = materialize(chat_format.blocks(spark.createDataFrame(rows, CONVERSATION), *CHAT, share_chars=1 << 20), "test")
    found = blocks.collect()
    trunks = [r for r in found if r["conversations"] == []]
    assert sorted(len(r["nodes"]) for r in trunks) == [1, 1, 300]
    assert sum(len(r["nodes"]) for r in found) == 2 + 50 + 40 + 2 + 1 + 400 + 300  # one node for each distinct prefix
    owners = [r for r in found if r["conversations"] and r["above"]]
    assert len(owners) > 4 and max(len(r["conversations"]) for r in owners) < 60
    got = {}
    for r in chat_format.read_back(blocks, *CHAT).collect():
        got.setdefault(r["conv_id"], []).append(r)
    assert sorted(len(v) for v in got.values())[-2:] == [1, 2] and len(got[None]) == 2
    for conv in {r[0] for r in rows} - {None}:
        turns = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv][0]["n_turns"], got[conv][0]["turns_sha256"]) == (len(turns), digest)
