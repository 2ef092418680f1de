import hashlib
import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from layerlake.llm import chat, packing, sharding, tokenbin
from layerlake.llm.common import materialize
from layerlake.llm.encode import SegmentEncoder, vocabulary

DOCS = [
    (1, "The quick brown fox, it's 12 o'clock.\nNew line", "x"),
    (2, None, "x"),
    (None, "no id", None),
    (3, "", "x"),
    (4, "a  b \n c\t<|endoftext|> é ́ " + "word " * 3000, "y"),
    (5, "same", "y"),
    (5, "same", "y"),
    (6, "same", None),
]
EXTRA = "doc_id long, text string, start string"


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, EXTRA)


def ids_of(name, text):
    e = Tokenizer.from_file(vocabulary(name)).encode(text or "", add_special_tokens=False)
    return [*e.ids, 1]


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_segments_equal_library(name):
    enc = SegmentEncoder(vocabulary(name), capacity=50)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet=" \n\tabA'sé.,1　́!\0<|endoftext|>", max_size=40), min_size=1, max_size=5))
    def check(texts):
        ids, ends = enc.encode(texts)
        for t, mine in zip(texts, np.split(ids, ends[:-1])):
            assert mine.tolist() == enc.tok.encode(t, add_special_tokens=False).ids
        assert ends[-1] == len(ids)

    check()


@given(st.lists(st.integers(0, 2**32 - 1), max_size=400), st.floats(0, 1))
@settings(max_examples=100, deadline=None)
def test_blocks_round_trip(ids, p):
    raw = tokenbin.pack_blocks(np.array(ids, np.uint32), p)
    assert tokenbin.unpack_blocks(raw).tolist() == ids
    assert tokenbin.unpack_blocks(raw, 1, 2).tolist() == ids[128:256]


def test_outliers_are_exceptions():
    ids = [7] * 127 + [4_000_000_000]
    raw = tokenbin.pack_blocks(np.array(ids, np.uint32))
    assert len(raw) < 40 and tokenbin.unpack_blocks(raw).tolist() == ids


def test_token_files(spark):
    got = [tuple(r) for r in tokenbin.token_table(docs(spark)).orderBy("start").collect()]
    want, at = [], 0
    for d, t, _ in sorted(DOCS, key=lambda r: (r[0] if r[0] is not None else -1, r[1] or "")):
        ids = ids_of("word_bpe_49k.json", t)
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    assert tokenbin.token_table(docs(spark, [])).count() == 0


def test_packing(spark):
    pieces = packing.pack(docs(spark), length=256)
    got = pieces.collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for s, parts in by.items():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at == 256 or s == len(by) - 1
    for d, t, _ in DOCS:
        ids = ids_of("byte_bpe_50k.json", t)
        mine = sorted((r.start, r.length, bytes(r.ids)) for r in got if r.doc_id == d and r.doc_tokens == len(ids))
        covered = sum(n for _, n, _ in mine)
        assert covered == len(ids) * sum(1 for x in DOCS if (x[0], x[1]) == (d, t))
        for a, n, raw in mine:
            assert raw == array("I", ids[a : a + n]).tobytes()
    whole = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(pieces).collect()}
    assert all(n == 256 for s, n in whole.items() if s < len(whole) - 1)
    assert packing.pack(docs(spark, [])).count() == 0


def test_hilbert_is_a_path():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    key = packing.hilbert_key(cells, 3)
    path = cells[np.argsort(key)]
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shards(spark):
    rows = [(i, ("t%d " % (i % 17)) * (i % 13), None) for i in range(300)] + DOCS
    got = sharding.balanced_shards(docs(spark, rows), 4).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    for s in range(4):
        mine = [r for r in got if r.shard == s]
        assert abs(sum(r.size for r in mine) - total / 4) <= max(r.size for r in got)
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    want = sorted((d is None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == want
    assert sharding.balanced_shards(docs(spark, [])).count() == 0


SAID = r"\### Assistant: </turn> ok"


@given(st.lists(st.tuples(st.text("ab\\#\n<", max_size=6) | st.just("assistant"), st.text("a\\#</turn>\n ", max_size=30)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_render_parse(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_chat(spark):
    rows = [
        (-7, 0, "user", SAID), (-7, 1, "assistant", SAID), (1, 2, "assistant", "réponse 😀 中"), (1, 1, None, None),
        (1, 2, "assistant", "b"), (None, None, "assistant", "x"), (2, 1, "user", "only"), (3, 1, "assistant", ""),
        *[(9, i, "assistant" if i % 2 else "user", f"turn {i} <|endoftext|>") for i in range(40)],
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS ids")
    want = {}
    for c in {r[0] for r in rows}:
        mine = sorted(((t if t is not None else -1), r or "", x or "") for k, t, r, x in rows if k == c)
        loss = "".join(x for _, r, x in mine if r == "assistant")
        want[c] = (
            len(mine),
            hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest(),
            len(loss),
            hashlib.sha256(loss.encode()).hexdigest(),
        )
    for limit in (2_000_000, 50):
        f = materialize(chat.format_conversations(df, limit=limit), "t")
        assert {r[0]: tuple(r)[1:5] for r in chat.digest(f).collect()} == want
        for r in f.collect():
            assert len(r.ids) == len(r["mask"])
            assert any(r["mask"]) == bool(r.loss_spans)
    assert f.count() > len(want)
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


def test_segments_are_the_whole_encoding():
    """Ids, mask and spans of a conversation cut between turns are those of the whole rendering."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    texts = ["Hi", "", "  spaces \n\n", "\n", "### x </turn>\n", "a  b\t", "é漢字 \\", " ", "tail\r\n "]
    turns = [(r, t) for t in texts for r in ("user", "assistant", "tool ")]
    whole, spans = chat.render(turns)
    e = tok.encode(whole, add_special_tokens=False)
    mask, pieces = chat.align(e.offsets, spans)
    ids, masks, found, at = [], [], [], 0
    for turn in turns:
        part, sp = chat.render([turn])
        x = tok.encode(part, add_special_tokens=False)
        m, p = chat.align(x.offsets, sp)
        ids += x.ids
        masks += m.tolist()
        found += [(a + at, b + at) for a, b in p]
        at += len(part)
    assert (ids, masks, found) == (e.ids, mask.tolist(), pieces)


def test_shards_keep_small_groups_whole(spark):
    rows = [(i, f"text {i % 40} " * 5) for i in range(400)] + [(1000 + i, "big") for i in range(200)] + [(None, None), (None, ""), (7, "é" * 3000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start long")
    for slack in (0.0, 0.2):
        got = sharding.balanced_shards(df, 8, slack).collect()
        assert len(got) == len(rows)
        by_text = {}
        for r in got:
            by_text.setdefault(r.text_crc32, set()).add(r.shard)
        total = sum(r.size for r in got)
        sizes = [sum(r.size for r in got if r.shard == k) for k in range(8)]
        assert max(sizes) - total / 8 <= max(r.size for r in got) + slack * total / 8
        small = {zlib.crc32(t.encode()) for t in {f"text {i} " * 5 for i in range(40)}}
        cut = sum(len(by_text[c]) > 1 for c in small)
        assert cut == 0 if slack else cut > 0
        for k in range(8):
            assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_align_equals_a_plain_intersection():
    """Sorted token and turn spans by binary search against looking at every pair of a token and a span."""
    import random

    r = random.Random(6)
    for _ in range(400):
        offsets, at = [], 0
        for _ in range(r.randint(0, 30)):
            at += r.choice([0, 0, 1, 2])
            size = r.choice([1, 1, 2, 3])
            offsets.append((at, at + size))
            at += r.choice([size, size, size, 0])  # bytes of one character share their place
        spans, x = [], 0
        for _ in range(r.randint(0, 6)):
            x += r.randint(0, 6)
            y = x + r.randint(0, 9)
            spans.append((x, y))
            x = y
        offsets = sorted(set(offsets)) if r.random() < 0.5 else sorted(offsets)
        if any(b < a for (_, a), (_, b) in zip(offsets, offsets[1:])):
            continue  # ends ascend in a tokenizer's offsets
        mask, pieces = chat.align(offsets, spans)
        assert mask.tolist() == [any(a < e and b > s for s, e in spans if e > s) for a, b in offsets]
        covered = {c for a, b in offsets for s, e in spans for c in range(max(a, s), min(b, e))}
        assert {c for a, b in pieces for c in range(a, b)} == covered
        assert sum(b - a for a, b in pieces) == len(covered)


def test_byte_level_pieces_are_cut_at_marks():
    enc = SegmentEncoder(vocabulary("byte_bpe_50k.json"))
    texts = ["ab, cd.\nEf ab! it's.", "x<|endoftext|>.", "a\nb\nc\n\nd", "caf\u00e9. 3.14, e\u0301."]
    ids, ends = enc.encode(texts)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [x.ids for x in enc.tok.encode_batch_fast(texts, add_special_tokens=False)]
    assert {"\0ab", "ab", "\0,", "cd", "\0.", "\0\n", "\0Ef", "\0!"} <= set(enc.known)
    assert set(enc._merged([" ab", ",", "***", "\n", "it's", "a.b", "\n\n", ""])) == {0, 1, 2, 3}
