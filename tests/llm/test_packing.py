import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomdex.llm import packing
from tests.llm.cases import awkward


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def test_word_by_word_ids_equal_whole_text_ids():
    import public_tokenizers

    t = tokenizer()
    t.encode_special_tokens = True
    texts = ["", "a  b", "it's don't  'll", "Σας ΣΑΣ", "É É é ́x", "x y\x1cz", "<|endoftext|> a.,", "日本 語,", "가 a", "ﬁ İ ß ẞ", "Wort. wort, WORT.,. 12a a1.", "\n\t\r\v\f", ". , ..", "a" * 5000]
    own = packing.WordIds(public_tokenizers.path(packing.TOKENIZER))
    for text, got in zip(texts, own.ids([x.encode() for x in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("seed", range(4))
def test_pieces_cover_each_example_once_within_limits(seed):
    r = random.Random(seed)
    sizes = [r.choice([1, 2, 3, r.randint(1, 300), r.randint(1, 5000)]) for _ in range(600)]
    packer = packing.Packer(tokens=256, segments=6, loss=200)
    bins = []
    for i, n in enumerate(sizes):
        bins += packer.add(i, n, r.randint(0, n))
    bins += packer.finish()
    covered = defaultdict(list)
    for pieces in bins:
        assert sum(p.length for p in pieces) <= 256 and len(pieces) <= 6 and sum(p.loss for p in pieces) <= 200
        for p in pieces:
            covered[p.item].append((p.start, p.length))
    for i, n in enumerate(sizes):
        at = 0
        for start, length in sorted(covered[i]):
            assert start == at and length > 0
            at += length
        assert at == n


def test_whole_examples_stay_whole():
    packer = packing.Packer(tokens=100, segments=4, loss=50, cut=False)
    bins = [b for i in range(200) for b in packer.add(i, 1 + i % 90, (1 + i % 90) // 2)] + list(packer.finish())
    assert sorted(p.item for b in bins for p in b) == list(range(200))
    assert all(sum(p.length for p in b) <= 100 and len(b) <= 4 and sum(p.loss for p in b) <= 50 for b in bins)
    with pytest.raises(ValueError):
        list(packer.add(1, 101, 0))


def check_pieces(texts: dict, rows):
    t = tokenizer()
    t.encode_special_tokens = True
    ids = {k: [*t.encode(v or "", add_special_tokens=False).ids, 2] for k, v in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for k, v in ids.items():
        got = sorted((r.start, r.length) for r in by_doc[k])
        assert [s for s, _ in got] == np.cumsum([0, *(n for _, n in got)])[:-1].tolist() and sum(n for _, n in got) == len(v)
    padding = 0
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        at = 0
        for r in rows:
            assert r.offset == at
            at += r.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.01 * sum(map(len, ids.values()))


def test_texts(spark):
    r = random.Random(1)
    words = ["alpha", "Beta,", "gamma.", "été", "naïve", "123", "|", "%%%"]
    texts = {i: " ".join(r.choices(words, k=r.choice([0, 1, 5, 300, 9000 if i % 50 == 0 else 20]))) for i in range(300)}
    texts[7] = None
    texts[8] = ""
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, length string").repartition(3)
    check_pieces(texts, packing.pack_texts(df).collect())
    assert packing.pack_texts(df.limit(0)).count() == 0


def test_examples(spark):
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([(10, 5), (5000, 1), (0, 0), (None, 1), (4000, None), (4096, 4096), (10, 5)])], "example_id long, tokens long, loss_tokens long")
    rows = {r.example_id: r for r in packing.pack_examples(df.coalesce(1)).collect()}
    assert len(rows) == 7 and all(rows[i].sequence_id is None for i in (1, 2, 3, 4)) and rows[0].sequence_id == rows[6].sequence_id


def test_conversations_meet_all_three_limits(spark):
    from loomdex.llm.queries import QUERIES

    d = "/root/testdata/sf0.1"
    t = tokenizer()
    t.encode_special_tokens = True
    want = defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{d}/conversations.parquet").collect():
        n = len(t.encode(r.text or "", add_special_tokens=False).ids) + 1
        want[r.conv_id][0] += n
        want[r.conv_id][1] += n if r.role == "assistant" else 0
    rows = QUERIES["pack_conversations"](spark, d).collect()
    assert {r.example_id: [r.tokens, r.loss_tokens] for r in rows} == dict(want)
    by, limits = defaultdict(list), packing.CONVERSATION_LIMITS
    for r in rows:
        over = r.tokens > limits[0] or r.loss_tokens > limits[2]
        assert (r.sequence_id is None) == over
        if not over:
            by[r.sequence_id].append(r)
    bound = Counter()
    for members in by.values():
        members.sort(key=lambda r: r.offset)
        assert [r.offset for r in members] == np.cumsum([0, *(r.tokens for r in members)])[:-1].tolist()
        used = (sum(r.tokens for r in members), len(members), sum(r.loss_tokens for r in members))
        assert all(u <= m for u, m in zip(used, limits, strict=True))
        filled = [u / m for u, m in zip(used, limits, strict=True)]
        bound[filled.index(max(filled))] += 1
    least = max(sum(r.tokens for m in by.values() for r in m) / limits[0], sum(map(len, by.values())) / limits[1], sum(r.loss_tokens for m in by.values() for r in m) / limits[2])
    assert set(bound) == {0, 1, 2} and len(by) <= 1.25 * least + 8


def test_awkward_conversations(spark):
    df = spark.createDataFrame([(1, 0, "assistant", None, 9), (1, 1, "user", "", 9), (None, 0, None, "a b", 9), (2, 0, "assistant", "long " * 60_000, 9), (3, 0, "user", "x", 9), (3, 0, "user", "x", 9)], "conv_id long, turn int, role string, text string, n int")
    rows = {r.example_id: r for r in packing.pack_examples(packing.conversation_examples(df)).collect()}
    assert (rows[1].tokens, rows[1].loss_tokens) == (2, 1) and rows[None].loss_tokens == 0 and rows[2].sequence_id is None and rows[3].tokens == 4
    assert packing.conversation_examples(df.limit(0)).count() == 0


def test_awkward(spark):
    df = awkward(spark)
    rows = packing.pack_texts(df).collect()
    per = defaultdict(int)
    for r in rows:
        per[r.doc_id] += r.length
        assert r.length > 0 and r.offset + r.length <= 4096
    assert per[3] == per[4] == per[5] == per[10] == 1 and per[2] == 2 * per[1] and None in per and per[6] == 60_001
