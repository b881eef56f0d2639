"""URL filters, chat formatting, embeddings and the pipeline."""

import math
import random

import brute
import pytest
from cases import corpus
from pyspark.sql import functions as F

from riskloom.llm import chat, components, graph, urls

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/f", "block"),
         ("a.net/fr", "allow"), ("org", "block"), (None, "block")]


def _judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:]
        path = path[:min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for rule, verdict in RULES:
        if rule is None:
            continue
        h, _, p = rule.partition("/")
        p = rule[len(h):]
        if (host or path) and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0, 0, False, "", ""), (len(rule), len(h), verdict == "block", rule, verdict))
    return host, path, best[3] if best else None, best[4] if best else "allow"


def test_urls_against_plain_matching(spark):
    random.seed(2)
    made = [None, "", "no scheme", "http://", "http:///", "http://?x", "x://HOST", "ftp://a.NET/fr/x", "http://a.net/fr", "http://b.a.net/french#x",
            "http://example.com/en/", "http://example.com/en", "http://WWW.example.com/en/x?y://z/en/", "http://xexample.com/en/", "http://org", "http://a..org/",
            "http://com/", "http://" + "a." * 3000 + "com/" + "x/" * 3000, "http://net/es/", "http://q.net/es/1/2/3"]
    made += ["http://" + ".".join(random.choices(["a", "www", "example", "net", "com", "org"], k=random.randint(1, 4))) + "/" + "/".join(random.choices(["en", "es", "fr", "f", ""], k=random.randint(0, 4))) for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate([*made, *made[:3]])], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    got = urls.judge_urls(pages, rules)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    for r in got.collect():
        assert (r.host, r.path, r.rule, r.verdict) == _judge(r.url), r.url
    assert got.count() == pages.count()
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_chat_parts_round_trip(spark):
    text = "\\### user: </turn>\n<image> \\b\\l ok"
    rows = [
        (1, 0, "user", [("text", text, None, None), ("image", None, "img-1", 2.0), ("text", "mid", None, None), ("audio", None, "a-1", 1.5)]),
        (1, 1, "assistant", [("text", text, None, None), ("document", None, "d-1", None)]),
        (1, 1, "assistant", [("odd", "kept", None, None)]),
        (2, None, None, None), (2, 0, "a: b\n", [("text", None, None, None)]), (None, 0, "user", [("text", "x", None, None)]),
    ]
    df = spark.createDataFrame([(*r, "f") for r in rows], f"conv_id long, turn long, role string, parts {chat.PARTS}, formatted string")
    out = chat.format_conversations(df)
    out = out.select("*", chat.read_turns(F.col("formatted")).alias("read"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: r for r in out.collect()}
    # ties on turn and role are ordered by content: the escaped text before "kept"
    assert [(t.role, t.text) for t in got[1].read] == [
        ("user", text + "<image>mid<audio>"), ("assistant", text + "<document>"), ("assistant", "kept")]
    assert got[1].loss == text + "<document>" + "kept"
    assert [(a.turn_index, a.kind, a.ref, a.tokens) for a in got[1].attachments] == [
        (0, "image", "img-1", 512), (0, "audio", "a-1", 38), (1, "document", "d-1", 512)]
    assert got[1].expanded_tokens == 512 + 38 + 512
    assert got[1].formatted.count("</turn>\n") == 3 and got[1].formatted.count("<image>") == 1
    assert [(t.role, t.text) for t in got[2].read] == [("", ""), ("a: b\n", "")] and got[2].loss == ""
    assert [(t.role, t.text) for t in got[None].read] == [("user", "x")]
    assert chat.format_conversations(df.limit(0)).count() == 0


def _vectors():
    random.seed(4)

    def near(v, eps):
        return [x + random.gauss(0, eps) for x in v]

    rows, centres = [], [[random.gauss(0, 1) for _ in range(16)] for _ in range(60)]
    for i, c in enumerate(centres):
        rows += [near(c, 0.05) for _ in range(1 + (i % 7 == 0) * 30)]
    rows += [rows[0], rows[0], [3 * x for x in rows[1]], None, [0.0] * 16, [math.nan] + [1.0] * 15, [math.inf] + [1.0] * 15, [None] + [1.0] * 15, []]
    return [(i * 13 % 997, v) for i, v in enumerate(rows)]


def test_embeddings_against_brute_force(spark, monkeypatch):
    rows = _vectors()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, node int").repartition(3)
    expected = brute.embeddings(rows)
    for unit, shard in ((4000, 2000), (60, 100)):  # one unit; several shards and blocks
        monkeypatch.setattr(graph, "UNIT", unit)
        monkeypatch.setattr(graph, "SHARD", shard)
        got = {r.vec_id: (r.n_links, r.component_id) for r in graph.embedding_classes(df).collect()}
        assert set(got) == set(expected)
        assert all(got[k][0] <= expected[k][0] for k in got)
        assert sum(v[0] for v in got.values()) >= 0.9 * sum(v[0] for v in expected.values())
    assert got.keys() == expected.keys() and sum(got[k][1] == expected[k][1] for k in got) >= 0.95 * len(got)


def test_audit_sees_links_lost_beside_a_large_group(spark):
    """300 near vectors with all their links, and 40 pairs whose links were lost."""
    random.seed(6)
    hot = [random.gauss(0, 1) for _ in range(64)]
    rows = [[x + random.gauss(0, 0.01) for x in hot] for _ in range(300)]
    for _ in range(40):
        v = [random.gauss(0, 1) for _ in range(64)]
        rows += [v, [x + random.gauss(0, 0.01) for x in v]]
    norms = [math.sqrt(sum(x * x for x in v)) for v in rows]
    nodes = spark.createDataFrame([(i, [x / n for x in v], 1) for i, (v, n) in enumerate(zip(rows, norms, strict=True))], "node long, vec array<double>, copies long")
    links = spark.createDataFrame([(i, 299) for i in range(300)], "node long, links long")
    summed, each = graph.audit(nodes, links, 0.9)
    assert summed > 0.99 and abs(each - 300 / 380) < 1e-9
    assert graph.audit(nodes.where("node < 300"), links, 0.9) == (1.0, 1.0)


@pytest.mark.parametrize("unit", [4000, 60])
def test_embeddings_below_the_recall_target_are_compared_exactly(spark, monkeypatch, unit):
    rows, search, calls = _vectors(), graph._search_links, []

    def lossy(*args):
        links, edges = search(*args)
        calls.append(args[3:])
        return links.limit(0), edges.limit(0)

    monkeypatch.setattr(graph, "UNIT", unit)
    monkeypatch.setattr(graph, "_search_links", lossy)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in graph.embedding_classes(df).collect()}
    assert got == brute.embeddings(rows)
    assert calls == [(2, 48), (3, 96), (4, 192)]


def test_no_group_of_a_large_shard_holds_more_than_two_blocks(spark, monkeypatch):
    rng = random.Random(11)
    hot = [rng.gauss(0, 1) for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.02 if i % 3 else 2.0) for x in hot]) for i in range(1200)]
    find = graph.search

    def watched(x, adjacency, queries, entries, threshold, beam):
        if len(x) + len(queries) > 2 * 60 * 1.7:  # blocks are dealt by a hash, so their sizes vary
            raise RuntimeError(f"a group of {len(x)} and {len(queries)} vectors")
        return find(x, adjacency, queries, entries, threshold, beam)

    monkeypatch.setattr(graph, "UNIT", 60)  # one shard of 20 blocks
    monkeypatch.setattr(graph, "SHARD", 10_000)
    monkeypatch.setattr(graph, "search", watched)
    got = {r.vec_id: (r.n_links, r.component_id) for r in graph.embedding_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rounds=1).collect()}
    expected = brute.embeddings(rows)
    assert sum(v[0] for v in got.values()) >= 0.95 * sum(v[0] for v in expected.values())


def test_embeddings_of_several_lengths(spark):
    rng = random.Random(12)
    rows = []
    for d, n in ((8, 40), (3, 10), (5, 1)):
        base = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(max(1, n // 4))]
        rows += [[x + rng.gauss(0, 0.01) for x in base[i % len(base)]] for i in range(n)]
    rows += [rows[45], None, [0.0] * 3]
    rows = [(i, v) for i, v in enumerate(rows)] + [(7, rows[0]), (7, rows[46])]  # an id more than once
    numbered = [(n, v) for n, (_, v) in enumerate(rows)]
    plain = {}
    for d in (8, 3, 5):
        plain |= brute.embeddings([(n, v) for n, v in numbered if v is not None and len(v) == d])
    got = sorted((r.vec_id, r.n_links) for r in graph.embedding_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == sorted((i, plain.get(n, (0, None))[0]) for n, (i, _) in enumerate(rows))


def test_embeddings_without_vectors(spark):
    df = spark.createDataFrame([(1, None), (None, [0.0])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.n_links, r.component_id) for r in graph.embedding_classes(df).collect()} == {(1, 0, 1), (None, 0, None)}
    assert graph.embedding_classes(df.limit(0)).count() == 0


def test_components_of_chains_and_hubs(spark):
    random.seed(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(200, 300)] + [(random.randint(1000, 1100), random.randint(1000, 1100)) for _ in range(70)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    expected = brute.closure(linked, [x for x in links if x[0] != x[1]])
    assert got == expected
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Every stage against brute force on what its predecessor kept."""
    import corpus_pipeline

    rows = [(k, t, "en", s, None if t is None else len(t)) for k, t, s in corpus()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "suffix-array dedup", "mixing", "best-fit packing"]
    kept = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = kept.collect()
        stage(spark, kept, str(tmp_path)).write.parquet(str(tmp_path / f"stage{i}"))
        kept = spark.read.parquet(str(tmp_path / f"stage{i}"))
        after = kept.collect()
        if i < 4:
            assert sorted(kept.columns) == sorted(docs.columns)
        texts = [(r.doc_id, r.text) for r in before]
        if i == 0:
            assert 0 < len(after) < len(before)
        if i == 1:
            assert {r.doc_id for r in after} == {c for _, c in brute.simhash(texts).values()}
        if i == 2:
            removed = brute.suffix_dedup(texts)
            got = {r.doc_id: r for r in after}
            assert all(r.n_chars == len(r.text) for r in after)
            assert all(got[k].text == t for k, t in texts if removed[k][1] == 0)
            assert any(removed[k][1] for k in got)
        if i == 3:
            assert {(r.doc_id, r.text) for r in after} <= set(texts)
            largest, total = {}, 0  # a source's words come within one document of its target
            for r in before:
                n = len(brute.words(r.text))
                largest[r.source], total = max(largest.get(r.source, 0), n), total + n
            assert abs(sum(len(brute.words(r.text)) for r in after) - total) <= sum(largest.values())
        if i == 4:
            assert sum(r.piece == 0 for r in after) == len(before)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(after)


def test_pipeline_of_odd_rows_and_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline
    from cases import odd_rows

    columns = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(k, t, None, s, None) for k, t, s in odd_rows()]
    spark.createDataFrame(odd, columns).write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/none/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r.doc_id for r in got} <= {r[0] for r in odd} and len(got) > 5
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_registered_once_each():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit() or n.startswith("op10")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", ["op2_url_filters", "op3_chat_formatting", "op6_substring_dedup", "op10_quality_rules", "op11_ranked_search", "op13_conversation_repair"])
def test_sql_agrees_on_the_smallest_tables(spark, name):
    import duckdb

    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = __spark_entry__.queries()[name](spark, sf)
    cursor = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(cursor.fetchall(), key=str)
