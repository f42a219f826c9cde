"""Token stores and packing against the tokenizer itself."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarte.llm import grammar, packing, tokens
from quarte.llm.common import stage

SCHEMA = "doc_id long, text string, start string, block string"
ODD = ["", None, " \n", "<|endoftext|> it's A<|startoftext|>b", "É café ﬁ Σίσυφος", "don't we'LL 's'12,3", "x" * 3000, "a\x1cb\x85c\xa0d"]


def direct(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path(tokens.TOKENIZER))
    return [np.array([*e.ids, 2], np.uint32) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def table():
    r = random.Random(4)
    vocab = ["the", "of", "Quick", "brown,", "fox!!", "größe", "12", "it's", "\U0001f642", "###"]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 400)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(200, "the fox " * 4000), (None, "no id"), (7, "same id"), (3, rows[3][1])]
    return rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
def test_words_equal_the_library(texts):
    ids, n = tokens.words(tokens.TOKENIZER).encode([t.encode("utf-8", "ignore") for t in texts])
    want = direct([t.encode("utf-8", "ignore").decode() for t in texts])
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_words_in_use_stay_when_the_cache_is_full(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 40)
    monkeypatch.setattr(tokens, "PARTS", 40)
    coder = tokens.Words(tokens.tokenizer_path(tokens.TOKENIZER))
    learned, library = [], coder.library
    monkeypatch.setattr(coder, "library", lambda words: learned.extend(" ".join(words).split()) or library(words))
    for k in range(30):
        texts = [" ".join(f"often frequent! {chr(97 + k % 26)}{chr(97 + i)}{chr(97 + k // 26)}x \u03c3{k}" for i in range(15))] + ODD[:3]
        ids, n = coder.encode([(t or "").encode() for t in texts])
        want = direct(texts)
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert learned.count("often") == learned.count("frequent") == 1
    assert len(coder.word.place) <= 40 + 30


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=300), st.data())
def test_grammar_round_trip(ids, data):
    ids = np.array(ids * data.draw(st.integers(1, 4)), np.uint32)
    shard = grammar.Shard(grammar.write_shard(ids, np.array([5]), np.array([len(ids)])))
    assert shard.ids(0, len(ids)).tolist() == ids.tolist() and len(shard.symbols) <= len(ids)
    if len(ids):
        a = data.draw(st.integers(0, len(ids) - 1))
        n = data.draw(st.integers(0, len(ids) - a))
        assert shard.ids(a, n).tolist() == ids[a : a + n].tolist()


def test_grammar_compresses_repeats():
    symbols, rules, size = grammar.compress(np.array([1, 2, 3, 4] * 1000 + [7] * 4096, np.uint32), 10)
    assert len(symbols) + 2 * len(rules) < 200 and size.max() > 8


@pytest.mark.parametrize("shard", [1 << 20, 500])
def test_store_equals_direct(spark, monkeypatch, shard):
    monkeypatch.setattr(grammar, "SHARD", shard)
    rows = table()
    df = spark.createDataFrame([(i, t, "s", "b") for i, t in rows], SCHEMA).repartition(3)
    got = sorted(grammar.read_back(stage(grammar.shards(df))).collect(), key=lambda r: r.start)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    ids, at = direct([t for _, t in ordered]), 0
    assert len(got) == len(rows)
    for r, (doc, _), i in zip(got, ordered, ids):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(i), zlib.crc32(i.astype("<u4").tobytes()))
        at += len(i)


@pytest.mark.parametrize("block", [4096, 9])
def test_packing_holds_every_id_once(spark, monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    rows = [r for r in table() if r != (7, "same id") and r[0] != 3]
    df = spark.createDataFrame([(i, t, "s", "b") for i, t in rows], SCHEMA).repartition(3)
    got = packing.pack(df).collect()
    ids = dict(zip([i for i, _ in rows], direct([t for _, t in rows])))
    seen, loads = {i: [] for i in ids}, {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(part.astype("<u4").tobytes()) == r.ids_crc32
        seen[r.doc_id].append((r.start, r.length))
        loads.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, cuts in seen.items():
        at = 0
        for start, n in sorted(cuts):
            assert start == at
            at += n
        assert at == len(ids[doc])
    assert sorted(loads) == list(range(len(loads)))
    for cuts in loads.values():
        at = 0
        for offset, n in sorted(cuts):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    if block == 4096:
        assert len(loads) <= -(-sum(map(len, ids.values())) // packing.CAPACITY) + 1


def test_repeated_rows_are_packed_as_often_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c", "", "")] * 5, SCHEMA)
    assert sorted(r.offset for r in packing.pack(df).collect()) == [0, 4, 8, 12, 16]
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.pack(empty).count() == 0
    assert grammar.read_back(stage(grammar.shards(empty))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_differencing_keeps_to_the_capacity(sizes):
    sizes = np.array(sizes)
    window = packing.pack_block(sizes, 50)
    load = np.bincount(window, sizes)
    assert load.max() <= 50 and load.min() > 0


def test_differencing_is_nearly_equal():
    sizes = np.random.default_rng(1).integers(1, 4096, 4000)
    m = -(-int(sizes.sum()) // 4096)
    window, loads = packing.spread(sizes, m)
    assert (np.bincount(window, sizes, m) == loads).all() and loads.max() - loads.min() < 200


def test_ranges_of_a_stored_table_are_decoded(spark, monkeypatch):
    """Any range of a document's ids comes out of the stored shards, without expanding the rest."""
    monkeypatch.setattr(grammar, "SHARD", 2000)
    rows = table()
    stored = stage(grammar.shards(spark.createDataFrame([(*r, "s", "b") for r in rows], SCHEMA).repartition(3))).collect()
    held = {}
    for row in stored:
        s = grammar.Shard(bytes(row.record))
        for doc, start, n in zip(s.doc_ids.tolist(), s.starts.tolist(), s.sizes.tolist(), strict=True):
            held.setdefault(doc, []).append((s, start, n))
    assert len(stored) > 2
    for doc, text in rows[:70:7]:
        want = direct([text])[0].tolist()
        pieces = held[doc]
        if len(pieces) > 1:
            continue  # a doc_id of several rows
        s, start, n = pieces[0]
        assert n == len(want)
        for a in range(0, n, max(1, n // 5)):
            assert s.ids(start + a, min(17, n - a)).tolist() == want[a : a + 17]


def test_nested_rules_are_written_at_their_places():
    rules = np.array([[1, 2], [10, 10], [11, 3]], np.uint32)
    symbols = np.array([12, 4, 10, 12, 11], np.uint32)
    four = [1, 2, 1, 2]
    assert grammar.expand(symbols, rules, 10, np.array([2, 4, 5])).tolist() == [*four, 3, 4, 1, 2, *four, 3, *four]
    assert grammar.packed(np.array([5, 0, 6], np.uint32), 3) == bytes([0b10000101, 0b1])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab\xe9 \t\n\x0b\x0c\r\x1c\x85\xa0\x00", max_size=12), max_size=6))
def test_words_are_cut_as_python_cuts_bytes(texts):
    texts = [t.encode() for t in texts]
    found, counts = tokens.split(texts)
    assert [w.encode() for w in found.to_pylist()] == [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts]


def test_only_distinct_words_are_looked_up_and_parts_skip_what_is_done(monkeypatch):
    """Slow before: each occurrence of a word was looked up, and lower-cased parts went through the whole tokenizer."""
    coder = tokens.Words(tokens.tokenizer_path(tokens.TOKENIZER))
    whole, encoded = [], coder.encoded
    monkeypatch.setattr(coder, "encoded", lambda words, tokenizer: (whole.append(tokenizer is coder.tokenizer), encoded(words, tokenizer))[1])
    looked, of = [], coder.word.of
    monkeypatch.setattr(coder.word, "of", lambda words, *used: looked.extend(words) or of(words, *used))
    texts = ["The ÉTÉ don't, 12 " * 500, " the été", ""]
    ids, n = coder.encode([t.encode() for t in texts])
    want = direct(texts)
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert len(looked) == 6 and whole == [False]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 2)), max_size=60))
def test_distinct_pairs_equal_sorting_them(pairs):
    key, group = np.array([10 * g + k for g, k in pairs], np.uint64), np.array([g for g, _ in pairs], np.int64)
    got = grammar.distinct(key, group, 5)
    want = np.unique(key, return_inverse=True, return_counts=True)
    assert all(x.tolist() == y.tolist() for x, y in zip(got, want))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.data())
def test_packed_numbers_come_back(bits, data):
    numbers = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=40)), np.uint32)
    raw = np.frombuffer(grammar.packed(numbers, bits) + b"\xff\xff", np.uint8)
    assert grammar.unpacked(raw, len(numbers), bits).tolist() == numbers.tolist()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60))
def test_places_taken_never_touch_and_outrank_what_is_around(rank):
    taken = sorted(grammar.winners(np.array(rank, np.int32)).tolist())
    around = [0, *rank, 0]
    want, at = [], 0
    while at < len(rank):
        end = at
        while end + 1 < len(rank) and rank[end + 1] == rank[at]:
            end += 1
        if rank[at] > around[at] and rank[at] > around[end + 2]:
            want += range(at, end + 1, 2)
        at = end + 1
    assert taken == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=400), st.integers(1, 3))
def test_pairs_left_out_of_later_rounds_are_seldom(ids, times):
    seq = np.array(ids * times, np.uint32)
    live, first_new = np.ones(max(len(seq) - 1, 0), bool), 6
    for _ in range(5):
        seq, rules, live = grammar.replace_round(seq, first_new, live)
        first_new += len(rules)
        assert len(live) == max(len(seq) - 1, 0)
        pairs = list(zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True))
        assert all(pairs.count(pair) < grammar.LEAST for pair, on in zip(pairs, live, strict=True) if not on)


def test_later_rounds_count_few_pairs_and_rules_are_expanded_once(monkeypatch):
    """Slow before: each round counted every pair, and decoding expanded every symbol level by level."""
    r = np.random.default_rng(5)
    ids = np.concatenate([r.integers(0, 40000, 50000), np.tile(r.integers(0, 40000, 60), 600), r.integers(0, 40000, 50000)]).astype(np.uint32)
    counted, bincount = [], np.bincount
    with monkeypatch.context() as m:
        m.setattr(np, "bincount", lambda x, *a, **k: counted.append((len(x), k.get("minlength", 0))) or bincount(x, *a, **k))
        record = grammar.write_shard(ids, np.array([5]), np.array([len(ids)]))
    rounds = [n for n, slots in counted if slots & (slots - 1) == 0 and slots]
    assert rounds[0] == len(ids) - 1 and len(rounds) > 2 and max(rounds[2:]) < 0.3 * len(ids)
    shard = grammar.Shard(record)
    given, expand = [], grammar.expand
    monkeypatch.setattr(grammar, "expand", lambda symbols, *a: given.append(len(symbols)) or expand(symbols, *a))
    assert shard.all().tolist() == ids.tolist()
    assert given == [len(shard.rules)] and len(shard.rules) < 0.1 * len(shard.symbols)
