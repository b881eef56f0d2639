"""Operators on documents against brute force, with blanks, nulls, ties, repeats and clashing names."""

import brute
import pytest
from cases import DOCS, corpus, frame, odd_rows

from riskloom.llm import mixing, packing, quality, simhash, suffix, superkmer, superkmers, token_files

pytestmark = pytest.mark.filterwarnings("ignore")


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_rows())


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    from riskloom.llm.tokens import TOKENIZER, load_tokenizer

    return load_tokenizer(TOKENIZER)


# ------------------------------------------------------------------ simhash

def test_simhash_matches_brute_force(docs, rows):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_classes(docs).collect()}
    assert got == brute.simhash([r[:2] for r in rows])
    assert len({c for _, c in got.values()}) < len(got)


def test_every_three_changed_positions_leave_a_plane():
    from itertools import combinations

    chosen = simhash.planes(3)
    assert len(chosen) == 14
    assert all(any(not set(p) & set(c) for p in chosen) for c in combinations(range(8), 3))


def test_links_at_and_beyond_the_limit(spark):
    base = 0x0123456789ABCDEF
    prints = [base, base ^ 0b111, base ^ (1 | 1 << 20 | 1 << 40), base ^ (1 | 1 << 20 | 1 << 40 | 1 << 50), 0]
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {(r.a, r.b) for r in simhash.fingerprint_links(df, 3).collect()}
    expected = {(a, b) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= 3}
    assert got == expected


@pytest.mark.parametrize("max_bits, long", [(3, 0), (3, 20), (4, 20)])
def test_a_family_of_near_fingerprints_takes_finer_lists(spark, max_bits, long):
    import random

    rng = random.Random(7)
    base = 0x0123456789ABCDEF
    prints = {base ^ sum(1 << b for b in rng.sample(range(48), rng.randint(0, 9))) for _ in range(300)} | {0, -1}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    expected = sorted((a, b) for a in prints for b in prints if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= max_bits)
    assert len(expected) > 10
    assert sorted((r.a, r.b) for r in simhash.fingerprint_links(df, max_bits, long).collect()) == expected


def test_finer_lists_lose_no_pair_and_are_bounded():
    from itertools import combinations

    for plane in simhash.planes(3):
        masks = simhash.finer_masks(plane, 3)
        fixed = sum(255 << 8 * p for p in plane)
        assert all(m & fixed == fixed and bin(m & (1 << 64) - 1).count("1") == 52 for m in masks)  # 12 open bits
        spots = [8 * p + b for p in range(8) if p not in plane for b in (0, 3, 4, 7)]
        assert all(any(not m & sum(1 << b for b in bits) for m in masks) for bits in combinations(spots, 3))


def test_bit_limits_without_a_shared_byte_are_refused():
    with pytest.raises(ValueError):
        simhash.planes(8)


def test_simhash_odd_rows(odd, empty):
    got = simhash.simhash_classes(odd).collect()
    assert len(got) == odd.count()
    text = odd_rows()[1][1]
    fp = brute.simhash([(0, text)])[0][0]
    assert {r.component_id for r in got if r.fingerprint == fp} == {min(r[0] for r in odd_rows() if r[1] == text and r[0] is not None)}
    assert simhash.simhash_classes(empty).count() == 0


def test_keep_first_keeps_one_row_per_class(docs, rows, odd):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    classes = {c for _, c in brute.simhash([r[:2] for r in rows]).values()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(classes)
    once = simhash.keep_first(odd).collect()
    assert len(once) == len({r.component for r in simhash._classed(odd, "doc_id", "text", 3, 3).collect()})


# ------------------------------------------------------------------ suffix and substring dedup

def test_suffix_dedup_matches_brute_force(docs, rows):
    import hashlib

    got = {r.doc_id: (r.n_bytes, sum(x.length for x in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest())
           for r in suffix.removed_bytes(docs).collect()}
    assert got == brute.suffix_dedup([r[:2] for r in rows])


def test_shared_windows_of_aligned_strings():
    import random

    rng = random.Random(2)
    strings = ["".join(rng.choices("ab", k=rng.randint(3, 12))).encode() for _ in range(200)]
    column = [rng.randint(-3, 3) for _ in strings]
    window = 3
    group, owner, inside = suffix.shared_windows(strings, column, window)
    got = {}
    for g, o, i in zip(group.tolist(), owner.tolist(), inside.tolist(), strict=True):
        got.setdefault(g, set()).add((o, i))
    expected = {}
    for o, s in enumerate(strings):
        for i in range(len(s) - window + 1):
            expected.setdefault((column[o] + i, s[i:i + window]), set()).add((o, i))
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in expected.values() if len(x) > 1)


def test_substring_dedup_matches_brute_force(docs, rows):
    import hashlib

    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in superkmer.remove_repeated(docs).collect()}
    assert got == brute.substring_dedup([r[:2] for r in rows])


def test_hot_minimisers_are_compared_by_window(docs, rows, monkeypatch):
    import hashlib

    monkeypatch.setattr(superkmers, "BUCKET_STRINGS", 1)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in superkmer.remove_repeated(docs).collect()}
    assert got == brute.substring_dedup([r[:2] for r in rows])
    got = {r.doc_id: (r.n_bytes, sum(x.length for x in r.removed)) for r in suffix.removed_bytes(docs).collect()}
    assert got == {k: v[:2] for k, v in brute.suffix_dedup([r[:2] for r in rows]).items()}


@pytest.mark.parametrize("unit", [superkmers.Words, superkmers.Bytes])
def test_parts_of_long_texts_hold_each_window_once(unit, monkeypatch):
    import numpy as np

    raw = corpus()[57][1].encode()
    plain = unit.symbols(np.frombuffer(raw, "u1"), np.array([0, len(raw)]))[0]
    monkeypatch.setattr(superkmers, "BLOCK_BYTES", 1000)
    parts = unit.parts(raw)
    assert len(parts) > 10
    windows = []
    for first, part in parts:
        n = len(unit.symbols(np.frombuffer(part, "u1"), np.array([0, len(part)]))[0])
        windows += range(first, first + n - unit.window + 1)
    assert windows == list(range(len(plain) - unit.window + 1))


def test_parts_end_when_words_are_longer_than_a_part(monkeypatch):
    monkeypatch.setattr(superkmers, "BLOCK_BYTES", 50)
    short = [f"w{i}" for i in range(40)]
    for words in (["y" * 700, *short], [*short, "y" * 700, *short], [c * 200 for c in "abcdefghijklmnopqrst"], ["z" * 700], [*short[:12], "y" * 60, "end"]):
        for space in (b" ", b"\n" * 80):
            raw = space.join(w.encode() for w in words)
            parts = []
            for first, part in superkmers.Words.parts(raw + space):
                parts.append([x.decode() for x in part.split()])
                assert words[first:first + len(parts[-1])] == parts[-1]
            windows = [tuple(p[i:i + 13]) for p in parts for i in range(len(p) - 12)]
            assert windows == [tuple(words[i:i + 13]) for i in range(len(words) - 12)]
            assert len(parts) <= len(raw) // 50 + 1


def test_substring_dedup_of_words_longer_than_a_block(spark):
    import hashlib

    short = " ".join(f"w{i}" for i in range(300))
    rows = [(1, short + " " + "y" * 600_000 + " " + short, "s"), (2, "head " + "y" * 600_000 + " " + short + " tail", "s"), (3, short[200:900], "s")]
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in superkmer.remove_repeated(frame(spark, rows)).collect()}
    assert got == brute.substring_dedup([r[:2] for r in rows]) and got[2][1] > 300


@pytest.mark.parametrize("strings", [1, 20_000])
def test_a_repeated_row_that_shares_a_passage_keeps_its_own_bytes(spark, monkeypatch, strings):
    import hashlib
    import random

    rng = random.Random(8)

    def prose(n):
        return "".join(rng.choices("abcdefgh ", k=n))

    passage = prose(400)
    five, nine = prose(500) + passage + prose(500), prose(450) + passage + prose(450)
    inner = prose(300) + passage + prose(200) + passage  # repeats itself, too
    rows = [(5, five, "s"), (5, five, "s"), (9, nine, "s"), (12, inner, "s"), (12, inner, "s"), (12, inner, "s")]
    monkeypatch.setattr(superkmers, "BUCKET_STRINGS", strings)
    expected, seen = brute.suffix_dedup(list(dict.fromkeys(r[:2] for r in rows))), []
    for r in suffix.removed_bytes(frame(spark, rows)).collect():
        seen.append(r.doc_id)
        assert (r.n_bytes, sum(x.length for x in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()) == expected[r.doc_id]
    assert sorted(seen) == [5, 5, 9, 12, 12, 12] and expected[5][1] == 0 and expected[9][1] >= 400


def test_dedup_odd_rows(odd, empty):
    n = odd.count()
    for found in (superkmer.remove_repeated(odd), suffix.removed_bytes(odd)):
        got = found.collect()
        assert len(got) == n
        same = {}
        for r in got:  # equal rows get equal results
            same.setdefault(r.doc_id, set()).add(str(r))
        assert len(same[odd_rows()[0][0]]) == 1
    assert superkmer.remove_repeated(empty).count() == suffix.removed_bytes(empty).count() == 0


def test_suffix_stage_cuts_whole_characters_and_drops_what_is_left_empty(docs, rows):
    cut = suffix.remove_repeated(docs)
    assert cut.columns == docs.columns
    got, full = {r.doc_id: r.text for r in cut.collect()}, {r[0]: r[1] for r in rows}
    gone = {k for k, t in full.items() if t and t.split() and k not in got}
    removed = brute.suffix_dedup([r[:2] for r in rows])
    assert gone and all(removed[k][1] >= removed[k][0] - 3 for k in gone)
    assert got[[r[0] for r in rows][54]] is None
    for k, t in got.items():
        if t is not None and removed[k][1] == 0:
            assert t == full[k]


# ------------------------------------------------------------------ tokens, packing, files

def test_word_encoder_equals_whole_texts(rows, tokenizer):
    import numpy as np

    from riskloom.llm.tokens import WordEncoder

    texts = [r[1] for r in rows]
    got = [np.frombuffer(x, "<u4").tolist() for x in WordEncoder().encode(texts)]
    assert got == brute.token_ids(texts, tokenizer)


def _check_packing(packed, capacity):
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_holds_every_piece_once(docs, rows, tokenizer):
    packed = packing.pack_documents(docs, capacity=512).collect()
    ids = dict(zip([r[0] for r in rows], brute.token_ids([r[1] for r in rows], tokenizer), strict=True))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packed} == {
        (k, p): (s, len(v[s:s + 512]), brute.crc(v[s:s + 512])) for k, v in ids.items() for p, s in enumerate(range(0, len(v), 512))}
    assert _check_packing(packed, 512) <= 1.05 * sum(map(len, ids.values())) / 512 + 1


def test_packing_rounds_unpack_what_is_left(spark):
    import random

    rng = random.Random(3)
    pieces = spark.createDataFrame([(i, rng.randint(1, 100)) for i in range(4000)], "doc_id long, length long").repartition(3).cache()
    packed = packing.pack_pieces(pieces, capacity=100, open_limit=16, per_task=100, merge=4).collect()
    assert sorted((r.doc_id, r.length) for r in packed) == sorted(tuple(r) for r in pieces.collect())
    assert _check_packing(packed, 100) <= 1.1 * sum(r.length for r in packed) / 100 + 16


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert bins.place(6)[:2] == (0, 0) and bins.place(7)[:2] == (1, 0)
    assert bins.place(3) == (1, 7, [1])   # 3 left fits better than 4
    assert bins.place(9)[:2] == (2, 0)
    assert bins.place(8) == (3, 0, [2])   # two are open: the fullest closes
    assert bins.place(10)[2] == [4]       # a full piece is a sequence by itself


def test_token_files_round_trip(docs, rows, tokenizer, empty, odd):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.write_and_digest(docs, shard_ids=1000).collect()}
    ids, at, expected = dict(zip([r[0] for r in rows], brute.token_ids([r[1] for r in rows], tokenizer), strict=True)), 0, {}
    for k in sorted(ids):
        expected[k] = (at, len(ids[k]), brute.crc(ids[k]))
        at += len(ids[k])
    assert got == expected
    assert token_files.write_and_digest(empty).count() == 0
    again = sorted((r.start, r.n_tokens) for r in token_files.write_and_digest(odd).collect())
    assert again[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(again, again[1:])) and len(again) == odd.count()


@pytest.mark.parametrize("parts", [1, 8])
def test_large_ids_beside_nulls_keep_every_digit(spark, monkeypatch, parts):
    ids = [2**53 + 1, 2**60 + 3, None, 7]
    df = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2 * parts)
    try:
        assert sorted((r.doc_id for r in packing.pack_documents(df).collect()), key=str) == sorted(ids, key=str)
        assert sorted((r.doc_id for r in token_files.write_and_digest(df).collect()), key=str) == sorted(ids, key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_packing_odd_rows(odd, empty):
    packed = packing.pack_documents(odd, capacity=128).collect()
    _check_packing(packed, 128)
    rows_ = [(r.doc_id, r.piece) for r in packed]
    assert sum(p == 0 for _, p in rows_) == odd.count() and any(d is None for d, _ in rows_)
    assert packing.pack_documents(empty).count() == 0


def test_text_ids_are_packed_and_written(spark):
    df = spark.createDataFrame([("a", "one two"), (None, None), ("b", "x" * 50)], "doc_id string, text string")
    assert {r.doc_id for r in packing.pack_documents(df).collect()} == {"a", "b", None}
    assert [r.doc_id for r in token_files.write_and_digest(df).orderBy("start").collect()] == [None, "a", "b"]


def test_codes_give_any_id_by_place():
    import numpy as np

    rng = np.random.default_rng(1)
    ids = np.concatenate((rng.integers(0, 256, 500), rng.integers(0, 1 << 16, 500), rng.integers(0, 1 << 32, 500), [0, 255, 256, (1 << 32) - 1])).astype("u4")
    rng.shuffle(ids)
    codes = token_files.Codes(token_files.encode_codes(ids))
    places = rng.integers(0, len(ids), 3000)
    assert len(codes) == len(ids) and (codes.get(places) == ids[places]).all()
    assert len(token_files.Codes(token_files.encode_codes([]))) == 0


# ------------------------------------------------------------------ mixing

def test_mixing_targets_and_taken(docs, rows):
    got = {r.doc_id: r.mix for r in mixing.mix_sources(docs).collect()}
    size = {r[0]: len(brute.words(r[1])) for r in rows}
    held = {}
    for k, _, s in rows:
        held[s] = held.get(s, 0) + size[k]
    targets = brute.targets(held)
    assert len(got) == len(rows)
    for s in held:
        own = [r[0] for r in rows if r[2] == s]
        assert all(got[k].size == size[k] and got[k].source_size == held[s] and abs(got[k].target - targets[s]) < 1e-6 for k in own)
        taken = sum(got[k].copies * size[k] for k in own)
        assert abs(taken - targets[s]) <= max(size[k] for k in own)
        assert all(0 <= got[k].copies <= 3 for k in own)
    assert {k: v.copies for k, v in got.items()} == {r.doc_id: r.mix.copies for r in mixing.mix_sources(docs.repartition(5)).collect()}


def test_mixing_caps_and_odd_rows(spark, odd, empty):
    rows = [(i, "w " * 10, "big") for i in range(30)] + [(100 + i, "w", "tiny") for i in range(3)] + [(200, None, "void")]
    got = mixing.mix_sources(frame(spark, rows)).collect()
    targets = brute.targets({"big": 300, "tiny": 3, "void": 0})
    assert all(abs(r.mix.target - targets[r.source]) < 1e-9 for r in got)
    assert {r.mix.copies for r in got if r.source == "tiny"} == {3}
    assert mixing.mix_sources(odd).count() == odd.count()
    assert mixing.mix_sources(empty).count() == 0
    mixed = mixing.mix_sources(frame(spark, rows))
    assert mixing.take(mixed).count() == sum(r.mix.copies for r in got)


# ------------------------------------------------------------------ quality

def _quality(text):
    w = brute.words(text)
    lines = [x for x in (text or "").split("\n") if brute.words(x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    again = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(w) < 2000 else None
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), None if again is None else len(again)


def test_quality_measures(docs, rows, odd, empty):
    out = quality.quality_rules(docs)
    assert out.columns == [*docs.columns, "quality"]
    got = {r.doc_id: r.quality for r in out.collect()}
    for k, text, _ in rows:
        q, expected = got[k], _quality(text)
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines) == expected[:4]
        if expected[4] is not None:
            assert q.n_repeat_words == expected[4]
        assert q.base_failed == (q.n_words < 50 or 100 * q.n_repeat_words > 50 * q.n_words)
        assert not (q.kept and q.base_failed)
    by_place = [got[r[0]] for r in rows]
    assert all(by_place[i].kept for i in (0, 25, 41, 57)) and not any(by_place[i].kept for i in (50, 52, 53, 54, 55, 56, 59))
    assert out.where("quality.kept").count() == sum(q.kept for q in got.values())
    assert quality.quality_rules(odd).count() == odd.count() and quality.quality_rules(empty).count() == 0
