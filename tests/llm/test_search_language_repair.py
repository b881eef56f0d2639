"""Ranked search, language identification and conversation repair against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import corpus, odd_rows
from pyspark.sql import functions as F

from riskloom.llm import langid, lexical, queries, repair

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    """docs: (id, text) rows; items: (id, text) rows -> sorted (item, rank, doc, score)."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_all, l_all = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in counted:
            m = 100 - 90 + (90 * n * n_all) // l_all
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        found.sort(key=lambda x: x[:3])
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block, items_a_round, shares", [(7, 2, (16, 4, 2)), (2048, 1000, (256, 32, 4))])
def test_ranked_search_against_brute_force(spark, monkeypatch, block, items_a_round, shares):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical, "ROUND_ITEMS", items_a_round)
    monkeypatch.setattr(lexical, "SHARES", shares)
    docs = [(i, t) for i, t, _ in corpus(n=60)] + [(2**53 + 1, "Zebra zebra É1 x\u0000y"), (None, "zebra e z"), (2**53 + 2, "zebra zebra É1 x y"), (None, None), (5, "")]
    rng = random.Random(3)
    items = [(n, " ".join(rng.sample(docs[n][1].split(), 12)) + " THE la") for n in range(0, 12, 3)]
    items += [(None, "zebra É1"), (7, None), (8, "..."), (9, "nowherefound"), (0, "zebra"), (0, "zebra"), (10, docs[57][1])]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, rank int")
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = lexical.rank_documents(d, q)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(docs, items, 10)


def test_ranked_search_ties_repeats_and_empty_tables(spark):
    rows = [(i % 9, "same words here" if i % 2 else "same words there") for i in range(40)] + [(3, "else")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    q = spark.createDataFrame([(1, "same words"), (2, "here")], "item_id long, text string")
    assert sorted((tuple(r) for r in lexical.rank_documents(d, q, k=12).collect()), key=str) == ranked(rows, [(1, "same words"), (2, "here")], 12)
    assert lexical.rank_documents(d.limit(0), q).collect() == []
    assert lexical.rank_documents(d, q.limit(0)).collect() == []
    assert lexical.rank_documents(spark.createDataFrame([(1, "..")], "doc_id long, text string"), q).collect() == []


# ------------------------------------------------------------------ languages

def best_path(scores, switch):
    """Labels of one text by trying the recurrence plainly."""
    value, back = scores[0].astype(float), []
    for s in scores[1:]:
        come = [max(range(len(value)), key=lambda j: (value[j] - (switch if j != i else 0), -j)) for i in range(len(value))]
        value = np.array([value[c] - (switch if c != i else 0) + s[i] for i, c in enumerate(come)])
        back.append(come)
    label = [int(value.argmax())]
    for come in reversed(back):
        label.append(come[label[-1]])
    return label[::-1], value.max()


def path_value(scores, label, switch):
    return sum(float(s[i]) for s, i in zip(scores, label, strict=True)) - switch * sum(a != b for a, b in zip(label, label[1:], strict=False))


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(4)
    counts = [17, 9, 9, 4, 1, 1, 0]
    scores = rng.normal(0, 3, (sum(counts), 4)).astype("f4")
    got, at = langid.label_words(scores, counts, 2.5), 0
    for n in counts:
        if n:
            part = scores[at:at + n]
            assert math.isclose(path_value(part, got[at:at + n].tolist(), 2.5), best_path(part, 2.5)[1], rel_tol=1e-6)
        at += n


def test_language_spans_of_mixed_text(spark):
    learn = [("the cat and the other thing with this house " * 8, "en"), ("der hund und die andere sache mit diesem haus " * 8, "de"),
             ("кот и другая вещь с этим домом " * 8, "ru"), ("кіт та інша річ з цим будинком ї є " * 8, "uk"), ("not learned", None)]
    model = langid.fit(spark.createDataFrame(learn, "text string, lang string"))
    assert model.languages == ["de", "en", "ru", "uk"]
    text = "The cat and the house with this thing. Der Hund und die Sache mit diesem Haus! другая вещь с этим домом"
    texts = [text, None, "", "12 34 !?", "́́", "Ωμέγα άλφα", "кот house", text + "́", "x" * 3000 + " the cat", "🙂 𝒳 𐍈", text]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, language string, row_in string")
    out = langid.identify(docs, model)
    assert out.columns == ["doc_id", "text", "row_in", "language"]
    got = {r.doc_id: r.language for r in out.collect()}
    assert [s.lang for s in got[0].spans] == ["en", "de", "ru"]
    assert [text[s.start:s.start + s.length] for s in got[0].spans] == [
        "The cat and the house with this thing", "Der Hund und die Sache mit diesem Haus", "другая вещь с этим домом"]
    assert got[10] == got[0]
    for i in (1, 2, 3, 4):
        assert (got[i].lang, got[i].score, got[i].spans) == ("und", 0.0, [])
    assert got[5].lang in model.languages and got[9].lang in model.languages  # scripts that nobody writes here
    assert [s.lang for s in got[6].spans] == ["ru", "en"]  # scripts alone force the change
    assert all(0 < got[i].score <= 1 for i in (0, 5, 6, 7, 8))
    assert langid.identify(docs.limit(0), model).count() == 0
    nothing = langid.fit(spark.createDataFrame([], "text string, lang string"))
    assert {r.language.lang for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_language_accuracy_on_held_out_documents(spark):
    out = queries.QUERIES["op12_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert out.count() == docs.count()
    known = out.where("held_out").join(docs.where("lang IS NOT NULL"), "doc_id")
    right, n = known.agg(F.avg(F.when(F.col("lang") == F.col("lang_pred"), 1.0).otherwise(0.0)), F.count("*")).first()
    assert n > 200 and right >= 0.98


def test_language_learning_uses_no_held_out_label(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    hidden = docs.withColumn("lang", F.when(~langid.held_out(F.col("doc_id")), F.col("lang")))
    a, b = (langid.fit(d.where(~langid.held_out(F.col("doc_id")))) for d in (docs, hidden))
    assert a.languages == b.languages and np.array_equal(a.table, b.table)


def test_language_blocks_do_not_change_results(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t, _ in odd_rows()], "doc_id long, text string")
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    whole = sorted(map(str, langid.identify(docs, model).collect()))
    monkeypatch.setattr(langid, "BLOCK_CHARS", 500)
    assert sorted(map(str, langid.identify(docs, model).collect())) == whole


# ------------------------------------------------------------------ conversation repair

def cheapest(rows):
    """rows: (role, text, fault) -> (cost, audit, lines) by a plain forward program over places."""
    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    step = {0: 2, 1: 2, 2: 3, 3: 2}
    word = {2: "user", 3: "assistant"}

    def inserted(table):
        todo = dict(table)
        while todo:
            p = min(todo, key=lambda x: todo[x][:2])
            cost, audit, lines = todo.pop(p)
            new = cost + 2, audit + "I", [*lines, word[step[p]] + ":"]
            q = step[p]
            if q not in table or new[:2] < table[q][:2]:
                table[q] = todo[q] = new
        return table

    table = inserted({0: (0, "", [])})
    for role, text, fault in rows:
        after = {}

        def offer(place, cost, audit, lines, after=after):
            if place not in after or (cost, audit) < after[place][:2]:
                after[place] = cost, audit, lines

        for p, (cost, audit, lines) in table.items():
            offer(p, cost + 3, audit + "D", lines)
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                if (p, role[:1]) in kept:
                    offer(kept[p, role[:1]], cost + cut, audit + "K", [*lines, f"{role}:{text}"])
                offer(step[p], cost + 2 + cut, audit + "R", [*lines, f"{word[step[p]]}:{text}"])
        table = inserted(after)
    return min((table[p] for p in (0, 3) if p in table), key=lambda x: x[:2])


def repaired(turns):
    """turns: (conv, turn, role, text) -> {conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, lines)}."""
    by = {}
    for conv, turn, role, text in turns:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, lines = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults, strict=True)])
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, lines)
    return out


def made_turns(seed, lengths):
    rng = random.Random(seed)
    out = []
    for conv, n in enumerate(lengths):
        for t in range(n):
            role = rng.choice(["user", "assistant"] * 5 + ["system", "tool", "", None, "u"]) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            text = rng.choice(["Well.", "So?", "cut off", " \t\n", "", None, "End! ", "no ", "é."]) if rng.random() < 0.5 else f"line {t} of {conv}."
            turn = None if rng.random() < 0.05 else t + rng.choice([0, 0, 0, 1, 3])
            out.append((conv, turn, role, text))
            if rng.random() < 0.1:
                out.append((conv, turn, role, text))
    return out


def as_dict(fixed, conv="conv_id"):
    lines = {}
    for r in fixed.turns.orderBy("block", "edit").collect():
        lines.setdefault(r[conv], []).append(f"{r.role}:{r.text}")
    return {r[conv]: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, lines.get(r[conv], [])) for r in fixed.report.collect()}


def frame(spark, turns):
    return spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, key string, pos int")


@pytest.mark.parametrize("block, strip", [(1024, 16), (8, 4), (5, 5), (6, 1)])
def test_repair_against_a_plain_program(spark, monkeypatch, block, strip):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "STRIP", strip)
    turns = made_turns(block, [0, 1, 1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 13, 17, 30, 64, 150])
    turns += [(None, *t[1:]) for t in made_turns(block + 1, [11])] + [(2**53 + 1, None, None, None), (2**53 + 2, None, "user", "Well."), (2**53 + 2, None, "user", "Well.")]
    assert as_dict(repair.Repair(frame(spark, turns))) == repaired(turns)


def test_auction_prices_are_shortest_distances():
    rng = random.Random(8)
    strips = repair.Strips()
    for _ in range(200):
        codes = tuple(rng.randint(0, 3) + rng.choice([0, 0, 0, 4, 8]) for _ in range(rng.randint(1, 12)))
        rows = [("xsua"[c & 3], "t", "blank" if c & 4 else "truncated" if c & 8 else None) for c in codes]
        costs, traces = strips.entry(codes, None)
        cost, audit, _ = cheapest(rows)
        assert (costs[0], "".join(op for op, _, _ in traces[0][0])) == (cost, audit)
        end = [0, 4, 2, 0]
        crossing = strips.crossing(codes)
        assert [min(crossing[p][q] + end[q] for q in range(4)) for p in range(4)] == costs


def test_repair_of_an_empty_table(spark):
    fixed = repair.Repair(frame(spark, made_turns(1, [3])).limit(0))
    assert fixed.report.count() == 0 and fixed.turns.count() == 0


def test_repair_query_keeps_conversations_that_lose_all_rows(spark, tmp_path):
    from zlib import crc32

    turns = [(c, t, ("user", "assistant")[t % 2], f"Turn {t} of {c}.") for c in range(200) for t in range(c % 4 + 1)] + [(None, None, None, None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()}
    damaged = []
    for c, t, role, text in turns:
        draw = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        damaged += [(c, t, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    want = {c: (0,) * 6 + ("", hashlib.sha256(b"").hexdigest()) for c, *_ in turns}
    want |= {c: (*x[:-1], hashlib.sha256("\n".join(x[-1]).encode()).hexdigest()) for c, x in repaired(damaged).items()}
    assert got == want and any(x[6] == "" for x in want.values())
